"""Queries over article text and sentence scores, up to daily sentiment."""

import numpy as np
from pyspark.sql import functions as F

from tickertide.functions import columns as cols
from tickertide.functions import stems
from tickertide.operators import long_texts
from tickertide.operators import polarity_fit as fit
from tickertide.operators import sentence_ends as ends
from tickertide.operators import sentiment as senti
from tickertide.operators import text as ops
from tickertide.plans import fixtures as fx
from tickertide.plans import news_queries as nq
from tickertide.plans.registry import i, query, r, s
from tickertide.session import shared_dir
from tickertide.sources.readers import table
from tickertide.sources.writers import load_or_build

fx.CTES["fx_sentences"] = (
    "SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), "
    "lambda t: regexp_replace(t, '^\\s+|\\s+$', '', 'g')), lambda t: t <> '') AS parts FROM documents WHERE text IS NOT NULL"
)
fx.CTES["fx_sentence_rows"] = (
    "SELECT doc_id AS article_index, unnest(range(len(parts))) AS sentence_no, unnest(parts) AS sentence FROM fx_sentences"
)
fx.CTES["fx_word_sums"] = (
    "SELECT article_index, sentence_no, sum(CASE WHEN weight > 0 THEN weight ELSE 0 END) AS pos, "
    "sum(CASE WHEN weight < 0 THEN -weight ELSE 0 END) AS neg FROM (SELECT article_index, sentence_no, "
    "unnest(CASE WHEN len(words) = 0 THEN [''] ELSE words END) AS word FROM (SELECT *, "
    "regexp_extract_all(lower(sentence), '\\p{L}+') AS words FROM fx_sentence_rows)) LEFT JOIN fx_lexicon USING (word) GROUP BY 1, 2"
)
fx.CTES["fx_polarity"] = (
    "SELECT article_index, sentence_no, CASE WHEN pos >= neg AND pos >= 1 THEN 'positive' WHEN neg >= 1 THEN 'negative' "
    "ELSE 'neutral' END AS label, CASE WHEN pos >= neg AND pos >= 1 THEN pos / (pos + neg + 1) WHEN neg >= 1 THEN "
    "-neg / (pos + neg + 1) ELSE 0 END AS weight FROM fx_word_sums"
)
fx.CTES["fx_article_sentiment"] = (
    "SELECT doc_id AS article_index, coalesce(avg(weight), 0) AS sentiment, count(weight) AS num_sentences FROM documents "
    "LEFT JOIN fx_polarity ON doc_id = article_index GROUP BY 1"
)


def documents(spark, folder):
    return table(spark, folder, "documents").select(F.col("doc_id").alias("article_index"), F.col("text").alias("summary"))


def sentence_rows(spark, folder):
    return ops.sentence_table(documents(spark, folder))


def scored(spark, folder):
    return ops.score_by_lexicon(sentence_rows(spark, folder), fx.lexicon(spark))


def scores(spark, folder):
    return senti.article_sentiment(documents(spark, folder), scored(spark, folder))


@query("one_line_text__h4", "SELECT doc_id AS article_index, md5(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS text_md5 FROM documents")
def _(spark, folder):
    clean = ops.sanitised(documents(spark, folder), "summary")
    return clean.select("article_index", F.md5("summary").alias("text_md5"))


# The sentence graph, step by step: word weights, linked pairs, ranks. Ranks settle within a few
# rounds; a text that has settled keeps its ranks in the later ones.
ROUNDS = 8
fx.CTES["fx_long"] = (
    "SELECT doc_id AS d, parts, len(parts) AS n FROM fx_sentences JOIN documents USING (doc_id) "
    "WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 100"
)
fx.CTES["fx_words"] = (
    "SELECT d, n, i, w, count(*) AS c FROM (SELECT d, n, sentence_no AS i, "
    "unnest(regexp_extract_all(lower(sentence), '\\p{L}+')) AS w FROM fx_sentence_rows JOIN fx_long ON article_index = d) WHERE w NOT IN (" + ", ".join(f"'{w}'" for w in ops.STOP_WORDS) + ") GROUP BY ALL"
)


def _summary_sql(words: str, name: str) -> str:
    """Best sentences of a text from its words per sentence (d, n, i, w, c)."""
    named = lambda part: f"fx_{name}{part}"
    fx.CTES[named("weights")] = (
        f"SELECT d, i, w, c / max(c) OVER (PARTITION BY d, i) * ln(n / (1.0e0 + count(*) OVER (PARTITION BY d, w))) AS v FROM {words}"
    )
    fx.CTES[named("norms")] = f"SELECT d, i, sqrt(sum(v * v)) AS norm FROM {named('weights')} GROUP BY 1, 2"
    fx.CTES[named("links")] = (
        "SELECT p.d, p.i, p.j, count(*) OVER (PARTITION BY p.d, p.i) AS degree FROM (SELECT a.d, a.i, b.i AS j, sum(a.v * b.v) AS dot "
        f"FROM {named('weights')} a JOIN {named('weights')} b ON a.d = b.d AND a.w = b.w GROUP BY ALL) p JOIN {named('norms')} x ON x.d = p.d "
        f"AND x.i = p.i JOIN {named('norms')} y ON y.d = p.d AND y.i = p.j WHERE dot > 0.1e0 * x.norm * y.norm"
    )
    fx.CTES[named("rank0")] = "SELECT d, unnest(range(n)) AS i, 1.0e0 / n AS rank, true AS moving FROM fx_long"
    for k in range(1, ROUNDS + 1):
        last = named(f"rank{k - 1}")
        fx.CTES[named(f"rank{k}")] = (
            "SELECT d, i, CASE WHEN moving THEN spread ELSE rank END AS rank, moving AND "
            "sqrt(sum((spread - rank) * (spread - rank)) OVER (PARTITION BY d)) > 0.1e0 AS moving FROM (SELECT r.d, r.i, r.rank, r.moving, "
            f"coalesce(s.spread, 0) AS spread FROM {last} r LEFT JOIN (SELECT l.d, l.j, sum(q.rank / l.degree) AS spread "
            f"FROM {named('links')} l JOIN {last} q ON q.d = l.d AND q.i = l.i GROUP BY 1, 2) s ON s.d = r.d AND s.j = r.i)"
        )
    fx.STORED |= {named("weights"), named("links")} | {named(f"rank{k}") for k in range(ROUNDS + 1)}
    best = (
        "SELECT d, string_agg(sentence, ' ' ORDER BY i) AS summary FROM (SELECT d, i, parts[i + 1] AS sentence, row_number() OVER "
        f"(PARTITION BY d ORDER BY round(rank, 12) DESC, i) AS place FROM {named(f'rank{ROUNDS}')} JOIN fx_long USING (d)) WHERE place <= 5 GROUP BY 1"
    )
    return (
        "SELECT doc_id AS article_index, trim(regexp_replace(coalesce(summary, text, ''), '\\s+', ' ', 'g')) AS summary "
        f"FROM documents LEFT JOIN ({best}) ON d = doc_id"
    )


fx.STORED |= {"fx_sentences"}


def _stems_sql(words: str) -> str:
    """Stems of distinct words, a step of the suffix rules after the other."""
    found = lambda pattern: f"regexp_matches(w, '{pattern}')"
    cut = lambda n: f"left(w, length(w) - {n})"
    has = lambda value, pattern: f"regexp_matches({value}, '{pattern}')"

    def replaced(table: dict, condition: str, extra: str = "true") -> str:
        pattern = stems.suffix_pattern(table)
        left, suffix = (f"regexp_extract(w, '{pattern}', {k})" for k in (1, 2))
        put = f"CASE {suffix} " + " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in table.items()) + " END"
        return f"CASE WHEN {found(pattern)} AND {has(left, condition)} AND {extra} THEN {left} || {put} ELSE w END"

    rest = "regexp_extract(w, '^(.*?)(ed|ing)$', 1)"
    doubled = "(" + "|".join(c * 2 for c in "bcdfghjkmnpqrtvwxy") + ")$"
    mended = (
        f"CASE WHEN {has(rest, '(at|bl|iz)$')} THEN {rest} || 'e' WHEN {has(rest, doubled)} THEN left({rest}, length({rest}) - 1) "
        f"WHEN {has(rest, stems.MEASURE_IS_1)} AND {has(rest, stems.SHORT_END)} THEN {rest} || 'e' ELSE {rest} END"
    )
    steps = [
        replaced(stems.PLURALS, ""),
        f"CASE WHEN w NOT LIKE '%eed' AND {has(rest, stems.HAS_VOWEL)} THEN {mended} "
        f"WHEN w LIKE '%eed' AND {has(cut(3), stems.MEASURE_OVER_0)} THEN {cut(1)} ELSE w END",
        f"CASE WHEN w LIKE '%y' AND {has(cut(1), stems.HAS_VOWEL)} THEN {cut(1)} || 'i' ELSE w END",
        replaced(stems.DERIVED, stems.MEASURE_OVER_0),
        replaced(stems.FORMED, stems.MEASURE_OVER_0),
        replaced(dict.fromkeys(stems.REMOVED, ""), stems.MEASURE_OVER_1, f"(w NOT LIKE '%ion' OR {found('[st]ion$')})"),
        f"CASE WHEN w LIKE '%e' AND ({has(cut(1), stems.MEASURE_OVER_1)} OR ({has(cut(1), stems.MEASURE_IS_1)} AND NOT "
        f"{has(cut(1), stems.SHORT_END)})) THEN {cut(1)} ELSE w END",
        f"CASE WHEN w LIKE '%ll' AND {found(stems.MEASURE_OVER_1)} THEN {cut(1)} ELSE w END",
    ]
    sql = f"SELECT DISTINCT w AS word, w FROM {words}"
    for step in steps:
        sql = f"SELECT word, {step} AS w FROM ({sql})"
    return f"SELECT word, CASE WHEN regexp_matches(word, '^[a-z]{{3,}}$') THEN w ELSE word END AS stem FROM ({sql})"


fx.CTES["fx_stems"] = _stems_sql("fx_words")
fx.CTES["fx_stemmed"] = "SELECT d, n, i, stem AS w, sum(c) AS c FROM fx_words JOIN fx_stems ON w = word GROUP BY ALL"
fx.STORED |= {"fx_words", "fx_stems", "fx_stemmed"}
_SUMMARIES = _summary_sql("fx_words", "")


def articles(spark, folder):
    return documents(spark, folder).withColumnRenamed("summary", "article")


@query("word_stems__h5", "SELECT word, stem FROM fx_stems")
def _(spark, folder):
    return ops.word_stems(ops.sentence_terms(articles(spark, folder))).select("word", "stem").distinct()


_STEMMED = _summary_sql("fx_stemmed", "stemmed_")


@query("stemmed_summaries__h5", _STEMMED)
def _(spark, folder):
    return ops.summarise(articles(spark, folder), stem=True)


@query("long_summaries__h5", _SUMMARIES)
def _(spark, folder):
    """Every text of more than 40 sentences ranked by the tables of blocks."""
    return long_texts.summaries(articles(spark, folder), longest=40, block=64)


@query("long_stemmed_summaries__h5", _STEMMED)
def _(spark, folder):
    return long_texts.summaries(articles(spark, folder), longest=40, block=64, stem=True)


@query("summaries__h5", _SUMMARIES)
def _(spark, folder):
    return ops.summarise(articles(spark, folder))


@query("sentences__h7", "SELECT article_index, sentence_no, md5(sentence) AS sentence_md5 FROM fx_sentence_rows")
def _(spark, folder):
    rows = sentence_rows(spark, folder)
    return rows.select("article_index", "sentence_no", F.md5("sentence").alias("sentence_md5"))


# Every text with a planted end, so that two abbreviations stand in the corpus.
PLANTED = " Acme Inc. reported lower costs, e.g. rents. Inc. alone is no end."
fx.CTES["fx_planted"] = f"SELECT doc_id, text || '{PLANTED}' AS text FROM documents WHERE text IS NOT NULL"
fx.CTES["fx_tokens"] = (
    "SELECT regexp_replace(t, '^[^\\p{L}]+|[^\\p{L}.]+$', '', 'g') AS core, coalesce(regexp_matches(f, '^\\p{Ll}'), false) AS lower FROM "
    "(SELECT unnest(tokens) AS t, unnest(tokens[2:]) AS f FROM (SELECT list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS tokens "
    "FROM fx_planted))"
)
fx.CTES["fx_periods"] = (
    "SELECT word, count(*) AS n, count(*) FILTER (period) AS n_period, count(*) FILTER (period AND lower) AS n_lower FROM (SELECT "
    "lower(CASE WHEN core LIKE '%.' THEN left(core, length(core) - 1) ELSE core END) AS word, core LIKE '%.' AS period, lower FROM fx_tokens) "
    "WHERE regexp_matches(word, '^\\p{L}+(\\.\\p{L}+)*$') GROUP BY 1"
)
fx.CTES["fx_abbreviations"] = (
    "SELECT word, evidence FROM (SELECT *, 2 * (n_period * ln(0.99e0) + (n - n_period) * ln(1 - 0.99e0) - n_period * ln(p) - (n - n_period) * ln(1 - p)) "
    "AS evidence FROM fx_periods, (SELECT sum(n_period) / sum(n)::DOUBLE AS p FROM fx_periods)) WHERE evidence > 10.83e0 AND n_lower >= 0.1e0 * n_period"
)
fx.CTES["fx_pieces"] = (
    "SELECT doc_id AS d, unnest(range(len(pieces))) AS k, unnest(pieces) AS piece FROM (SELECT doc_id, "
    "string_split(regexp_replace(text, '([.!?])(\\s+)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS pieces FROM fx_planted)"
)
fx.CTES["fx_kept_ends"] = (
    "SELECT d, k, piece, lower(CASE WHEN piece LIKE '%.' THEN regexp_replace(regexp_extract(piece, '(\\S+)\\.$', 1), "
    "'^[^\\p{L}]+|[^\\p{L}.]+$', '', 'g') END) IN (SELECT word FROM fx_abbreviations) AS known FROM fx_pieces"
)
fx.CTES["fx_learned"] = (
    "SELECT d, s, regexp_replace(string_agg(piece, '' ORDER BY k), '^\\s+|\\s+$', '', 'g') AS sentence FROM (SELECT *, "
    "sum(start) OVER (PARTITION BY d ORDER BY k) AS s FROM (SELECT *, coalesce(lag(CASE WHEN known THEN 0 ELSE 1 END) OVER "
    "(PARTITION BY d ORDER BY k), 0) AS start FROM fx_kept_ends)) GROUP BY 1, 2"
)
fx.STORED |= {"fx_planted", "fx_periods", "fx_abbreviations"}


def planted(spark, folder):
    return documents(spark, folder).filter("summary IS NOT NULL").withColumn("summary", F.concat("summary", F.lit(PLANTED)))


@query("abbreviations__h7", f"SELECT word, {r('evidence', 4)} AS evidence FROM fx_abbreviations", digits=4)
def _(spark, folder):
    return ends.abbreviations(ends.period_counts(planted(spark, folder)))


@query("learned_sentences__h7", "SELECT d AS article_index, row_number() OVER (PARTITION BY d ORDER BY s) - 1 AS sentence_no, md5(sentence) AS sentence_md5 "
       "FROM fx_learned WHERE sentence <> ''")
def _(spark, folder):
    texts = planted(spark, folder)
    rows = ends.sentences_with(texts, ends.abbreviations(ends.period_counts(texts)))
    return rows.select("article_index", "sentence_no", F.md5("sentence").alias("sentence_md5"))


_SAMPLES = {
    "first": "parts[1:4]",
    "last": "parts[len(parts) - 3:len(parts)]",
    "uniform": "list_transform(range(4), lambda k: parts[CAST(floor(k * (len(parts) / 4.0e0)) AS BIGINT) + 1])",
    "headtail": "list_concat(parts[1:2], parts[len(parts) - 1:len(parts)])",
}


@query("sentence_samples__h8", "SELECT doc_id AS article_index, "
       + ", ".join(f"md5(array_to_string(CASE WHEN len(parts) <= 4 THEN parts ELSE {e} END, '|')) AS {m}" for m, e in _SAMPLES.items())
       + " FROM fx_sentences")
def _(spark, folder):
    parts = documents(spark, folder).filter("summary IS NOT NULL").withColumn("parts", cols.sentences("summary"))
    picked = [F.md5(F.concat_ws("|", cols.sample_sentences("parts", 4, m))).alias(m) for m in _SAMPLES]
    return parts.select("article_index", *picked)


# ---- a lexicon learned from next-day returns --------------------------------------

fx.CTES["fx_moves"] = (
    "SELECT article_index, avg(next_return) AS move FROM (SELECT article_index, date, unnest(tickers) AS ticker FROM fx_dated) JOIN "
    "(SELECT ticker, date, lead(close) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS next_return FROM fx_bars) USING (ticker, date) "
    "WHERE next_return IS NOT NULL GROUP BY 1"
)
fx.CTES["fx_labels"] = (
    "SELECT article_index, move > 0 AS up, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), CAST(range(strlen(name)) AS BIGINT[])), "
    "lambda crc, k: list_reduce(list_prepend(xor(crc, CAST(ascii(name[k + 1]) AS BIGINT)), CAST(range(8) AS BIGINT[])), "
    "lambda x, bit: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) AS crc FROM (SELECT *, CAST(article_index AS VARCHAR) AS name FROM fx_moves WHERE move <> 0)"
)
fx.CTES["fx_train"] = (
    "SELECT doc_id, up, list_distinct(regexp_extract_all(lower(text), '\\p{L}+')) AS words FROM documents JOIN fx_labels ON doc_id = article_index "
    "WHERE crc % 3 <> 1"
)
fx.CTES["fx_learned_lexicon"] = (
    "SELECT word, ln((n_up + 1.0e0) / (up + 2)) - ln((n_down + 1.0e0) / (down + 2)) AS weight FROM (SELECT word, count(*) FILTER (up) AS n_up, "
    "count(*) FILTER (NOT up) AS n_down FROM (SELECT up, unnest(words) AS word FROM fx_train) GROUP BY 1), "
    "(SELECT count(*) FILTER (up) AS up, count(*) FILTER (NOT up) AS down FROM fx_train) WHERE n_up + n_down >= 5"
)
fx.CTES["fx_learned_sums"] = fx.CTES["fx_word_sums"].replace("fx_lexicon", "fx_learned_lexicon")
fx.CTES["fx_learned_polarity"] = fx.CTES["fx_polarity"].replace("fx_word_sums", "fx_learned_sums")
fx.CTES["fx_learned_scores"] = fx.CTES["fx_article_sentiment"].replace("fx_polarity", "fx_learned_polarity")
fx.STORED |= {"fx_moves", "fx_labels", "fx_train", "fx_learned_lexicon", "fx_learned_polarity"}


def labels(spark, folder):
    return fit.return_labels(nq.dated(spark, folder).select("article_index", "tickers", "date"), fx.bars(spark, folder))


def learned_lexicon(spark, folder, known):
    """From the labelled articles that are not held out; stored, since sentences are scored with it more than once."""
    learned = fit.fit_lexicon(documents(spark, folder), known.filter(~fit.held_out()))
    path = shared_dir(spark, "lexicon")
    return load_or_build(spark, path, lambda: learned)


def learned_scores(spark, folder, known):
    return ops.score_by_lexicon(sentence_rows(spark, folder), learned_lexicon(spark, folder, known))


@query("learned_lexicon__h9", f"SELECT word, {r('weight')} AS weight FROM fx_learned_lexicon")
def _(spark, folder):
    return learned_lexicon(spark, folder, labels(spark, folder))


@query("sentence_polarity__h9", f"SELECT article_index, sentence_no, label, {r('weight', 4)} AS weight FROM fx_learned_polarity", digits=4)
def _(spark, folder):
    out = learned_scores(spark, folder, labels(spark, folder))
    return out.select("article_index", "sentence_no", "label", "weight")


@query("polarity_hit_rates__h9", f"SELECT part, count(*) AS n, {r('avg(CAST(hit AS DOUBLE))')} AS accuracy, {r('greatest(avg(CAST(up AS DOUBLE)), 1 - avg(CAST(up AS DOUBLE)))')} "
       "AS majority FROM (SELECT CASE WHEN crc % 3 = 1 THEN 'held_out' ELSE 'train' END AS part, up, (sentiment >= 0) = up AS hit FROM fx_learned_scores "
       "JOIN fx_labels USING (article_index)) GROUP BY 1")
def _(spark, folder):
    known = load_or_build(spark, shared_dir(spark, "labels"), lambda: labels(spark, folder))
    scores = senti.article_sentiment(documents(spark, folder), learned_scores(spark, folder, known))
    return fit.hit_rates(scores, known)


def _length_scorer(texts):
    """Stands in for a model: longer texts are more positive."""
    n = np.array([len(t) for t in texts], dtype=float)
    return np.stack([n % 7 / 21, n % 5 / 21, 1 - n % 7 / 21 - n % 5 / 21], axis=1)


@query("plugged_in_scorer__h9", "SELECT article_index, sentence_no, 0 AS failed, CASE WHEN p >= q AND p >= u THEN 'positive' WHEN q >= u THEN 'negative' "
       f"ELSE 'neutral' END AS label, {r('CASE WHEN p >= q AND p >= u THEN p WHEN q >= u THEN -q ELSE 0 END')} AS weight FROM "
       "(SELECT *, length(sentence) % 7 / 21.0e0 AS p, length(sentence) % 5 / 21.0e0 AS q, "
       "1 - length(sentence) % 7 / 21.0e0 - length(sentence) % 5 / 21.0e0 AS u FROM fx_sentence_rows)")
def _(spark, folder):
    return ops.score_with(sentence_rows(spark, folder), _length_scorer)


@query("article_sentiment__d12", f"SELECT article_index, {r('sentiment')} AS sentiment, num_sentences FROM fx_article_sentiment")
def _(spark, folder):
    return scores(spark, folder)


@query("metadata_with_sentiment__c3", f"SELECT url_hash, u.article_index, {r('sentiment')} AS sentiment, num_sentences FROM fx_pruned u "
       "LEFT JOIN fx_scores c ON c.article_index = u.article_index AND c.article_index % 4 <> 1")
def _(spark, folder):
    some = fx.article_scores(spark, folder).filter("article_index % 4 <> 1")
    out = senti.attach_sentiment(nq.pruned(spark, folder), some)
    return out.select("url_hash", "article_index", "sentiment", "num_sentences")


@query("unscored_articles__c6", "SELECT article_index FROM fx_article_sentiment WHERE article_index NOT IN (SELECT article_index "
       "FROM fx_scores WHERE num_sentences > 2)")
def _(spark, folder):
    done = fx.article_scores(spark, folder).filter("num_sentences > 2")
    return senti.not_yet_scored(documents(spark, folder), done).select("article_index")


@query("news_daily_sentiment__d13", f"SELECT ticker, {s('date')} AS date, {r('avg(sentiment)')} AS daily_sentiment, count(*) AS n_articles "
       "FROM (SELECT unnest(tickers) AS ticker, TRY_CAST(substr(date_raw, 1, 10) AS DATE) AS date, sentiment FROM fx_pruned u "
       "JOIN fx_scores c ON c.article_index = u.article_index) WHERE date IS NOT NULL GROUP BY 1, 2")
def _(spark, folder):
    scored_urls = senti.attach_sentiment(nq.pruned(spark, folder), fx.article_scores(spark, folder))
    return senti.daily_sentiment(scored_urls)


@query("raw_news_to_daily_sentiment__a3_d5_d6_d13", f"SELECT ticker, {s('date')} AS date, {r('avg(sentiment)')} AS daily_sentiment, "
       "count(*) AS n_articles FROM (SELECT unnest(tickers) AS ticker, TRY_CAST(substr(date_raw, 1, 10) AS DATE) AS date, sentiment "
       "FROM fx_pruned u JOIN fx_scores c ON c.article_index = u.article_index) WHERE date IS NOT NULL GROUP BY 1, 2")
def _(spark, folder):
    news = nq.ops.in_years(nq.raw_news(spark, folder), nq.Y1, nq.Y2)
    urls = nq.ops.number_articles(nq.ops.collapse_urls(news))
    known = nq.valid(spark, folder)
    kept = nq.ops.prune_urls(nq.ops.enrich_from_titles(urls, known), known.filter("ticker <> 'euro'"))
    return senti.daily_sentiment(senti.attach_sentiment(kept, fx.article_scores(spark, folder)))


@query("text_to_daily_sentiment__h7_h9_d12_c3_d13",
       f"SELECT ticker, {s('date')} AS date, {r('avg(sentiment)')} AS daily_sentiment, count(*) AS n_articles FROM (SELECT "
       "unnest(tickers) AS ticker, TRY_CAST(substr(date_raw, 1, 10) AS DATE) AS date, sentiment FROM fx_pruned u "
       "JOIN fx_article_sentiment c ON c.article_index = u.article_index) WHERE date IS NOT NULL GROUP BY 1, 2")
def _(spark, folder):
    return senti.daily_sentiment(senti.attach_sentiment(nq.pruned(spark, folder), scores(spark, folder)))
