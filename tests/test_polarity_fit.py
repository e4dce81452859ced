"""The learned polarity lexicon against plain counts, and its held-out measure."""

import datetime
import math
import random
import re
import zlib

from tickertide.operators import polarity_fit as fit
from tickertide.operators import sentiment as senti
from tickertide.operators import text as ops

DAY = datetime.date(2020, 1, 6)


def made(spark, n=300, seed=1):
    """Articles whose words lean with the next day's return of their ticker."""
    draw = random.Random(seed)
    bars, articles, texts = [], [], []
    for k in range(20):
        close = 100.0
        for d in range(40):
            bars.append((f"T{k}", DAY + datetime.timedelta(days=d), close))
            close *= 1 + draw.choice([-0.02, -0.01, 0.0, 0.01, 0.02])
    price = {(t, d): c for t, d, c in bars}
    for i in range(n):
        names = [f"T{draw.randrange(20)}" for _ in range(draw.randrange(1, 3))]
        day = DAY + datetime.timedelta(days=draw.randrange(45))
        moves = [price[t, day + datetime.timedelta(days=1)] / price[t, day] - 1 for t in names if (t, day + datetime.timedelta(days=1)) in price]
        lean = draw.choices(["gain", "record", "loss", "cut", "été"], weights=[4, 4, 1, 1, 1] if sum(moves) > 0 else [1, 1, 4, 4, 1], k=6)
        articles.append((i, names, day if draw.random() > 0.05 else None))
        texts.append((i, " ".join(["The", *lean, "Inc."]) + f" word{i}. Old news!" if i % 50 else None))
    price_rows = spark.createDataFrame([(t, d, c, 1) for t, d, c in bars], "ticker string, date date, close double, volume int")
    return (
        spark.createDataFrame(articles, "article_index bigint, tickers array<string>, date date"),
        price_rows,
        spark.createDataFrame(texts, "article_index bigint, summary string"),
        articles,
        price,
        dict(texts),
    )


def test_labels_and_lexicon_equal_plain_counts(spark):
    articles, bars, texts, rows, price, text_of = made(spark)
    labels = fit.return_labels(articles, bars).cache()
    want = {}
    for i, names, day in rows:
        after = day and day + datetime.timedelta(days=1)
        moves = [price[t, after] / price[t, day] - 1 for t in names if (t, after) in price and (t, day) in price]
        if moves and sum(moves) / len(moves) != 0:
            want[i] = sum(moves) / len(moves) > 0
    assert {r.article_index: r.up for r in labels.collect()} == want
    lexicon = {r.word: r.weight for r in fit.fit_lexicon(texts, labels, min_articles=3).collect()}
    counts, ups = {}, list(want.values())
    for i, up in want.items():
        for w in set(re.findall(r"[^\W\d_]+", (text_of[i] or "").lower())):
            counts.setdefault(w, [0, 0])[not up] += 1
    share = lambda n, total: math.log((n + 1) / (total + 2))
    plain = {w: share(a, sum(ups)) - share(b, len(ups) - sum(ups)) for w, (a, b) in counts.items() if a + b >= 3}
    assert set(lexicon) == set(plain) and all(math.isclose(lexicon[w], plain[w], abs_tol=1e-12) for w in plain)
    assert lexicon["gain"] > 0.2 and lexicon["loss"] < -0.2 and "été" in lexicon


def test_held_out_articles_are_told_better_than_by_the_majority(spark):
    articles, bars, texts, _, _, text_of = made(spark, 900, 2)
    labels = fit.return_labels(articles, bars).cache()
    lexicon = fit.fit_lexicon(texts, labels.filter(~fit.held_out()))
    scores = senti.article_sentiment(texts, ops.score_by_lexicon(ops.sentence_table(texts), lexicon))
    got = {r.part: r for r in fit.hit_rates(scores, labels).collect()}
    known = {r.article_index: r.up for r in labels.collect()}
    apart = [i for i in known if zlib.crc32(str(i).encode()) % 3 == 1]
    assert got["held_out"].n == len(apart) and got["train"].n == len(known) - len(apart)
    ups = sum(known[i] for i in apart) / len(apart)
    assert math.isclose(got["held_out"].majority, max(ups, 1 - ups))
    assert got["held_out"].accuracy > got["held_out"].majority + 0.1


def test_nothing_to_learn_from(spark):
    articles, bars, texts, *_ = made(spark, 20)
    none = fit.return_labels(articles, bars.limit(0))
    assert none.count() == 0 and fit.fit_lexicon(texts, none).count() == 0
    assert fit.fit_lexicon(texts.limit(0), fit.return_labels(articles, bars)).count() == 0
