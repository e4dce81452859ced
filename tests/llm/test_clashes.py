"""Columns named like helper columns, and rows equal in id and text that differ elsewhere."""

import pytest
from pyspark.sql import functions as F

from tickertide.llm import chat, exact_dedup, mixing, near_dups, toxicity

EXTRA = ["_key", "_Copy", "_times", "_parts", "_row", "_id", "__text", "__toxic", "key", "size", "row"]
TEXTS = ["one two three four five six seven", "eight nine ten eleven twelve thirteen", "a b c d e f g h", ""]


def documents(spark):
    rows = [(i, text, f"s{i % 2}") for i, text in enumerate(TEXTS)] + [(9, TEXTS[0], "s1")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return docs.withColumns({name: F.concat(F.lit(f"{name} of "), "doc_id") for name in EXTRA})


def labels(spark):
    return spark.createDataFrame([(i, int(i == 3)) for i in range(10)], "doc_id bigint, toxic int")


@pytest.mark.parametrize(
    "stage",
    [
        lambda spark, docs: exact_dedup.kept_documents(docs),
        lambda spark, docs: near_dups.one_per_class(docs),
        lambda spark, docs: mixing.whole_documents(docs),
        lambda spark, docs: mixing.mixed_documents(docs),
        lambda spark, docs: toxicity.clean_documents(docs, labels(spark)),
    ],
    ids=["exact", "near", "whole", "mixed", "toxic"],
)
def test_values_of_clashing_columns_stay(spark, stage):
    docs = documents(spark)
    out = stage(spark, docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows
    for row in rows:
        assert [row[name] for name in EXTRA] == [f"{name} of {row.doc_id}" for name in EXTRA]


def test_of_rows_equal_in_id_and_text_the_same_one_stays(spark):
    rows = [(1, "p q r s t u", source, n) for n in range(3) for source in ("z", "b", None, "a")] + [(2, "v w x y z a", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n int")
    for parts in (1, 5):
        dealt = docs.repartition(parts)
        for stage in (exact_dedup.kept_documents, near_dups.one_per_class):
            got = {r.doc_id: (r.source, r.n) for r in stage(dealt).collect()}
            assert got == {1: (None, 0), 2: (None, 0)}  # a null is left out of the JSON, so `n` comes first
        assert {(r.doc_id, r.source, r.n) for r in mixing.whole_documents(dealt).collect()} == {(1, None, 0), (2, None, 0)}


def test_no_window_exceeds_the_budget_beside_a_large_system_turn(spark):
    turns = [(1, 0, "system", "a " * 40)] + [(1, k, ("user", "assistant")[k % 2], "b " * (40 if k < 5 else 5)) for k in range(1, 9)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_windows(df, budget=60, history=20, stretch=3).orderBy("first_turn").collect()
    assert max(w.n_tokens for w in out) <= 60
    new = [place for w in out for place in range(w.first_turn, w.first_turn + w.n_turns - w.n_repeated)]
    assert new == list(range(9))
    late = [w for w in out if w.first_turn >= 5]
    assert late and all(w.text.startswith("<|im_start|>system") for w in late)
