"""Stems, and summaries of long texts from tables of blocks, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickertide.functions.stems import stem_table, stemmed
from tickertide.operators import long_texts
from tickertide.operators import text as ops
from test_text import brute_force_central, corpus

# Published examples of the algorithm.
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled
motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss
fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci
valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli
analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize
formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer
airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment
adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous
homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll""".split()


def test_stems_of_published_examples(spark):
    want = dict(zip(STEMS[::2], STEMS[1::2])) | {"as": "as", "été": "été", "büros": "büros", "": "", "s": "s", "x1s": "x1s"}
    rows = spark.createDataFrame([(w,) for w in want], "word string")
    assert {r.word: r.stem for r in stem_table(rows).collect()} == want


def plain_summary(text, terms, parts, keep=5):
    if text is None or len(text.strip()) < ops.MIN_TEXT or not parts:
        return " ".join((text or "").split())
    return " ".join(" ".join(parts[k].split()) for k in brute_force_central(terms, keep))


def test_summaries_with_stems_equal_a_plain_loop(spark, folder):
    articles = corpus(spark, folder, 40)
    parts = ops.sentence_terms(articles).select("article_index", "article", "_parts", "_terms").collect()
    words = {w for r in parts for s in r._terms for w in s}
    stems = {r.word: r.stem for r in stem_table(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    got = {r.article_index: r.summary for r in ops.summarise(articles, stem=True).collect()}
    assert len(got) == len(parts) and any(w != s for w, s in stems.items())
    for r in parts:
        assert got[r.article_index] == plain_summary(r.article, [[stems[w] for w in s] for s in r._terms], r._parts)


def test_stems_change_what_is_linked(spark):
    """Sentences that share stems only: linked with stems, apart without."""
    lines = ["Blue walls stand.", "Green rivers run.", "Old birds sleep.", "Cold winters end.", "Small ships sail.", "Tall trees grow."]
    lines += ["Adjusting lamps.", "Hopeful days.", "Relate stories.", "Adjustment hopefulness relational."]
    df = spark.createDataFrame([(1, " ".join(lines))], "article_index bigint, article string")
    assert ops.summarise(df, keep=1).first().summary == lines[0]
    assert ops.summarise(df, keep=1, stem=True).first().summary == lines[-1]


@pytest.mark.parametrize("block", [5, 16, 1024])
@pytest.mark.parametrize("stem", [False, True])
def test_blocks_give_the_same_summaries(spark, block, stem):
    draw = random.Random(block)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}{e}" for k in range(30) for e in ("", "s")] + ["the", "1"]
    texts = [None, "", "short. Text.", ". " * 90, "x" * 150]
    for n in (6, 12, 33, 70):
        texts.append(" ".join(" ".join(draw.choices(words, k=draw.randrange(0, 9))).strip() + "." for _ in range(n)))
    texts.append(texts[-1])
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[-2])]
    df = spark.createDataFrame(rows, "article_index bigint, article string").repartition(3)
    want = sorted((r.article_index is None, r.article_index or 0, r.summary) for r in ops.summarise(df, stem=stem).collect())
    got = long_texts.summaries(df, longest=5, block=block, stem=stem).collect()
    assert sorted((r.article_index is None, r.article_index or 0, r.summary) for r in got) == want
    none = long_texts.summaries(df.limit(0), longest=5)
    assert none.count() == 0 and none.columns == ["article_index", "summary"]


def test_twenty_thousand_sentences_in_many_tasks(spark):
    """The links of a text are blocks of bounded size, dealt to many tasks; the summary is that of one task."""
    draw = np.random.default_rng(4)
    n, names = 20_000, [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]
    text = " ".join(" ".join(names[k] for k in draw.zipf(1.4, 4) % 120) + "." for _ in range(n))
    df = spark.createDataFrame([(7, text)], "article_index bigint, article string")
    parts = ops.sentence_terms(df).cache()
    assert parts.select(F.size("_parts")).first()[0] == n
    blocks = long_texts._sentence_blocks(long_texts._word_weights(parts, False), 1024)
    links = long_texts._links(blocks, 1024)
    sizes = links.select(F.length("bits").alias("n"), F.spark_partition_id().alias("task")).collect()
    assert len(sizes) == 210 and max(r.n for r in sizes) == 1024 * 1024 // 8
    assert len({r.task for r in sizes}) > 1
    best = long_texts.central_sentences(parts).first()._best
    assert list(best) == ops._central_sentences([list(s) for s in parts.first()._terms], 5)


def test_stems_in_tasks_equal_the_table(spark, folder):
    """One word at a time gives what the table of distinct words gives."""
    texts = spark.read.parquet(f"{folder}/documents.parquet").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("word"))
    made = [f"{a}{b}" for a in ("plat", "hopp", "agr", "fil", "oper", "y", "ro", "") for b in [*STEMS[::2], "ational", "eed", "ied", "ions", "ll", "e", "ying"]]
    words = texts.distinct().union(spark.createDataFrame([(w,) for w in [*made, "été", "x1s", "s", ""]], "word string")).distinct()
    rows = stem_table(words).collect()
    assert len(rows) > 500 and [r.word for r in rows if stemmed(r.word) != r.stem] == []


def test_no_word_is_shuffled_and_no_group_is_made_per_block(spark, folder):
    """Words stay in the row of their text; blocks are rows, not groups with an Arrow stream each."""
    articles = corpus(spark, folder, 20)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan(ops.summarise(articles, stem=True))
    parts = ops.sentence_terms(articles)
    blocks = long_texts._sentence_blocks(long_texts._word_weights(parts, True), 16)
    assert "hashpartitioning" not in plan(blocks)
    ranks = spark.createDataFrame([], "article_index bigint, block int, rank array<double>, degree array<double>, away double")
    links = long_texts._links(blocks, 16)
    assert "CoGroup" not in plan(links) + plan(long_texts._round(links, ranks, F.col("rank")))


@pytest.mark.parametrize("stem", [False, True])
def test_repeated_rows_are_ranked_each_on_their_own(spark, stem):
    texts = [" ".join(f"Word{chr(97 + k * m % 26)} and hopes{chr(97 + k % 5)} rise." for k in range(30)) for m in (3, 7)]
    rows = [(1, texts[0]), (1, texts[0]), (2, texts[0]), (2, texts[1])]
    df = spark.createDataFrame(rows, "article_index bigint, article string").repartition(3)
    want = sorted(map(tuple, ops.summarise(df, stem=stem).collect()))
    assert sorted(map(tuple, long_texts.summaries(df, longest=5, block=8, stem=stem).collect())) == want
