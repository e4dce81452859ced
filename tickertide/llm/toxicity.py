"""Toxicity by a character n-gram classifier with naive Bayes log-count ratios as feature scale.

A feature is the presence of a hashed n-gram (3 to 5 code points of the text in lower case, blanks
as one space) anywhere in the whole text. Over the labelled documents Spark counts, per n-gram, the
documents of each label; the log ratio r of the smoothed shares weighs the feature. Kept are the
``features`` n-grams whose ratio is surest (ratio over its standard error). A logistic regression with
features r * presence is fitted on the driver; scoring is one pass without a shuffle.

The fit uses at most ``max_rows`` labelled documents, those with the smallest hash of their id; the
held-out fold (crc32 of the id modulo ``folds`` equals 0) is never among them. What the driver holds
is bounded by ``max_rows``, ``features`` and the number of buckets.

Defined results: a null text counts as empty; a text without known n-grams gets the score of the
intercept; a document with several labels counts as toxic if one of them says so; null labels are no
labels; without labels of both kinds every score is the share of toxic ones (0 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tickertide.llm.common import free_name, in_batches, pieces, plain_text
from tickertide.llm.ngrams import code_points, hashed

SIZES = range(3, 6)
BITS = 20
MAX_ROWS = 8_000
FEATURES = 20_000
MIN_DOCS = 4
FOLDS = 5


@dataclass
class Model:
    buckets: np.ndarray  # sorted buckets of the kept n-grams
    weights: np.ndarray  # by bucket, as many
    intercept: float


def held_out(doc_id: str = "doc_id", folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def grams_present(texts: list[str], wanted: np.ndarray | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every n-gram present, each once per text, sorted; only where ``wanted`` says so."""
    flat, starts = code_points(texts)
    found = []
    for n, buckets in hashed(flat, SIZES, bits):
        at = np.arange(len(buckets)) if wanted is None else np.flatnonzero(wanted[buckets])
        text = np.searchsorted(starts, at, "right") - 1
        inside = at + n <= starts[text + 1]
        found.append((text[inside].astype(np.int64) << bits) | buckets[at][inside].astype(np.int64))
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> bits, pairs & ((1 << bits) - 1)


def plain(texts: pa.Array) -> list[str]:
    """Lower case, one space for a run of blanks and one at each end."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(texts), r"[ \t-\r]+", " ")
    return [f" {t} " for t in spaced.to_pylist()]


def _sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, max_rows: int, folds: int) -> DataFrame:
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id, folds))
    known = known.groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = docs.select(F.col(doc_id).alias("_id"), plain_text(text).alias("text"))
    return rows.join(F.broadcast(chosen), "_id")  # at most max_rows rows of two numbers


def _logistic(lists: list[np.ndarray], ratios: np.ndarray, y: np.ndarray, l2: float = 20.0, rounds: int = 300, block: int = 1000):
    """Logistic regression on ratio * presence by accelerated gradient steps, over blocks of rows.

    ``lists``: the features present in each row. Ends when the gradient is small.
    """
    n, width = len(y), len(ratios)
    w, bias = np.zeros(width), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    most = max((float((ratios[x] ** 2).sum()) for x in lists), default=0.0)
    rate = 1.0 / (max(most, 1.0) / 16 + l2 / n)
    look, last, speed, look_b, last_b = w.copy(), w, 1.0, bias, bias
    blocks = [np.concatenate(lists[i : i + block]) for i in range(0, n, block)]
    sizes = np.array([len(x) for x in lists])

    for _ in range(rounds):
        weights, slope, slope_b = ratios * look, np.zeros(width), 0.0
        for i, cols in zip(range(0, n, block), blocks):
            own = sizes[i : i + block]
            row = np.repeat(np.arange(len(own)), own)
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[cols], len(own)) + look_b, -30, 30)))
            gap = (p - y[i : i + block]) / n
            slope += np.bincount(cols, gap[row], width)
            slope_b += gap.sum()
        slope = slope * ratios + l2 / n * look
        if max(np.abs(slope).max(initial=0.0), abs(slope_b)) < 1e-5:
            break
        w, bias = look - rate * slope, look_b - 4 * slope_b
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        push = (speed - 1) / faster
        look, look_b = w + push * (w - last), bias + push * (bias - last_b)
        last, last_b, speed = w, bias, faster
    return w, bias


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_rows: int = MAX_ROWS,
    features: int = FEATURES,
    folds: int = FOLDS,
) -> Model:
    if features > 65_536:
        raise ValueError("at most 65,536 features")
    sample = _sample(docs, labels, doc_id, text, label, max_rows, folds)
    sizes = {r[0]: r[1] for r in sample.groupBy("_label").count().collect()}
    good, bad = sizes.get(0, 0), sizes.get(1, 0)
    if not good or not bad:
        share = bad / max(good + bad, 1)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((share + 1e-9) / (1 - share + 1e-9))))

    def count(batches):
        tally = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                ys = np.array(piece.column("_label").to_pylist())
                row, bucket = grams_present(plain(pc.fill_null(piece.column("text"), "")), None)
                for y in (0, 1):
                    tally[y] += np.bincount(bucket[ys[row] == y], minlength=1 << BITS)
        seen = np.flatnonzero(tally.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(tally[0][seen]), pa.array(tally[1][seen])], ["bucket", "good", "bad"])

    counts = sample.select("_label", "text").mapInArrow(count, "bucket bigint, good bigint, bad bigint")
    counts = counts.groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).filter(F.col("good") + F.col("bad") >= MIN_DOCS)
    share_bad, share_good = (F.col("bad") + 1) / (bad + 2), (F.col("good") + 1) / (good + 2)
    counts = counts.withColumn("ratio", F.log(share_bad / share_good))
    sure = F.abs("ratio") / F.sqrt(1 / (F.col("bad") + 1) + 1 / (F.col("good") + 1))
    kept = counts.orderBy(sure.desc(), "bucket").limit(features).select("bucket", "ratio").collect()
    kept = np.array(sorted((r[0], r[1]) for r in kept)).reshape(-1, 2)
    buckets, ratios = kept[:, 0].astype(np.int64), kept[:, 1]
    wanted = np.zeros(1 << BITS, bool)
    wanted[buckets] = True

    def present(batches):
        for batch in batches:
            for piece in pieces(batch, "text", 4 << 20):
                texts = plain(pc.fill_null(piece.column("text"), ""))
                row, bucket = grams_present(texts, wanted)
                at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))])
                lists = [np.searchsorted(buckets, bucket[a:b]).astype("<u2").tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([piece.column("_id"), piece.column("_label"), pa.array(lists, pa.binary())], ["id", "label", "cols"])

    id_type = sample.schema["_id"].dataType.simpleString()
    rows = sample.select("_id", "_label", "text").mapInArrow(present, f"id {id_type}, label int, cols binary").collect()
    rows.sort(key=lambda r: (str(r[0]), r[2]))
    lists = [np.frombuffer(r[2], "<u2") for r in rows]
    w, bias = _logistic(lists, ratios, np.array([float(r[1]) for r in rows]))
    return Model(buckets, w * ratios, float(bias))


def score(docs: DataFrame, model: Model, text: str = "text", columns: list[str] | None = None, name: str = "score") -> DataFrame:
    """Rows of ``docs`` with a column ``name``: how likely the label is 1."""

    def task():
        weights = np.zeros(1 << BITS)
        weights[model.buckets] = model.weights
        wanted = np.zeros(1 << BITS, bool)
        wanted[model.buckets] = True

        def step(texts: pa.Array):
            row, bucket = grams_present(plain(texts), wanted)
            total = np.bincount(row, weights[bucket], len(texts)) + model.intercept
            return [pa.array(1 / (1 + np.exp(-np.clip(total, -40, 40))), pa.float64())]

        return step

    return in_batches(docs, task, [(name, "double")], columns, text, 4 << 20)


def clean_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents whose score is below one half, with all their columns."""
    name = free_name(docs.columns, "__toxic")
    scored = score(docs, fit(docs, labels, doc_id, text, **options), text, name=name)
    return scored.filter(F.col(name) < 0.5).select(*docs.columns)
