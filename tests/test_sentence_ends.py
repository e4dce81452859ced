"""Learned abbreviations and sentences that respect them, against plain counts."""

import math
import re

import regex
from pyspark.sql import functions as F

from tickertide.operators import sentence_ends as ends
from tickertide.operators import text as ops

PROSE = [
    "Acme Inc. reported growth, e.g. in rents. The board met.  It was late! Why?",
    "We met Dr. Who today. He left. Costs fell, e.g. for oil. Inc. is short.",
    "(Inc. said so.) Prices rose at Acme Inc. yesterday. The board left.\nThe end.",
]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "article_index bigint, summary string").repartition(2)


def plain_counts(texts):
    out = {}
    for text in texts:
        tokens = (text or "").split()
        for token, following in zip(tokens, [*tokens[1:], ""]):
            core = regex.sub(r"^[^\p{L}]+|[^\p{L}.]+$", "", token)
            period, word = core.endswith("."), core.removesuffix(".").lower()
            if regex.fullmatch(r"\p{L}+(\.\p{L}+)*", word):
                n = out.setdefault(word, [0, 0, 0])
                n[0] += 1
                n[1] += period
                n[2] += period and bool(regex.match(r"\p{Ll}", following))
    return out


def plain_abbreviations(counts):
    p = sum(n[1] for n in counts.values()) / sum(n[0] for n in counts.values())
    out = {}
    for word, (n, k, lower) in counts.items():
        likelihood = lambda q: k * math.log(q) + (n - k) * math.log(1 - q)
        evidence = 2 * (likelihood(0.99) - likelihood(p))
        if evidence > 10.83 and lower >= 0.1 * k:
            out[word] = evidence
    return out


def plain_sentences(text, known):
    pieces = re.split(r"(?<=[.!?])(?=\s)", text)
    out, held = [], ""
    for piece in pieces:
        held += piece
        last = held.split()[-1] if held.split() else ""
        word = regex.sub(r"^[^\p{L}]+|[^\p{L}.]+$", "", last[:-1]).lower() if last.endswith(".") else None
        if word not in known:
            out.append(held.strip())
            held = ""
    return [s for s in [*out, held.strip()] if s]


def test_counts_and_abbreviations_equal_plain_ones(spark, folder):
    texts = PROSE * 6 + [None, "", " . ", "été. né. le"]
    texts += [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").limit(80).collect()]
    counts = ends.period_counts(table(spark, texts))
    want = plain_counts(texts)
    assert {r.word: [r.n, r.n_period, r.n_lower] for r in counts.collect()} == want
    got = {r.word: r.evidence for r in ends.abbreviations(counts).collect()}
    known = plain_abbreviations(want)
    assert set(got) == set(known) and all(math.isclose(got[w], known[w], rel_tol=1e-9) for w in known)
    assert {"inc", "e.g"} <= set(got) and not {"rents", "board", "left", "end"} & set(got)


def test_sentences_are_not_cut_after_abbreviations(spark):
    texts = PROSE + [None, "", "  ", "One. two", "Acme Inc.", "Inc. Inc. Inc. End. x"]
    known = spark.createDataFrame([("inc",), ("e.g",), ("dr",)], "word string")
    rows = ends.sentences_with(table(spark, texts), known).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.article_index, r.sentence_no)):
        got.setdefault(r.article_index, []).append(r.sentence)
        assert r.sentence_no == len(got[r.article_index]) - 1
    assert got == {k: plain_sentences(t, {"inc", "e.g", "dr"}) for k, t in enumerate(texts) if t and t.strip()}
    assert got[0][0] == "Acme Inc. reported growth, e.g. in rents."


def test_without_abbreviations_sentences_stay_the_same(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(F.col("doc_id").alias("article_index"), F.col("text").alias("summary"))
    none = spark.createDataFrame([], "word string")
    both = ["article_index", "sentence_no", "sentence"]
    plain, got = ops.sentence_table(docs).select(both), ends.sentences_with(docs, none).select(both)
    assert plain.count() == got.count() and plain.exceptAll(got).count() == 0
    assert ends.abbreviations(ends.period_counts(docs.limit(0))).count() == 0


def test_texts_are_counted_once_and_regular_expressions_see_different_tokens(spark, folder):
    """The learned words are read once; tokens are counted before they are taken apart."""
    texts = table(spark, PROSE * 6)
    counts = ends.period_counts(texts)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [token" in plan
    rows = ends.sentences_with(texts, ends.abbreviations(counts))
    assert "token" not in rows._jdf.queryExecution().optimizedPlan().toString()
