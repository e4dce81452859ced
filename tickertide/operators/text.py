"""Article text: clean-up, sentences, extractive summaries and sentence scores."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tickertide.functions.columns import one_line, sample_sentences, sentences, trim_space
from tickertide.functions.stems import stem_table, stemmed

# Shortest text that is summarised, sentences kept, graph threshold and tolerance.
MIN_TEXT = 100
SUMMARY_SENTENCES = 5
EDGE_THRESHOLD = 0.1
TOLERANCE = 0.1
SMALL_LEXICON = 100_000  # words that may be broadcast

# English function words, left out of the sentence graph unless other words are given.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by "
    "can could did do does doing down during each few for from further had has have having he her here hers herself him "
    "himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other "
    "our ours ourselves out over own same she should so some such than that the their theirs them themselves then there "
    "these they this those through to too under until up very was we were what when where which while who whom why will "
    "with would you your yours yourself yourselves"
).split()

LABELS = ("positive", "negative", "neutral")


def sanitised(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, one_line(column))


def sentence_table(
    articles: DataFrame, text: str = "summary", limit: int = 0, method: str = "first"
) -> DataFrame:
    """One row per sentence: article_index, sentence_no (0-based), sentence."""
    picked = sample_sentences(sentences(text), limit, method)
    return articles.select("article_index", F.posexplode(picked).alias("sentence_no", "sentence"))


# ---- summaries ---------------------------------------------------------------

BLOCK_CELLS = 4_000_000  # largest dense block held while comparing sentences


def weighted_words(owner: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sentence, word and idf-weighted frequency of every word in every sentence, by word.

    ``owner`` holds the sentence (of ``n``) that each ``word`` stands in; words are texts or numbers.
    """
    word, vocabulary = pd.factorize(word)
    size = max(len(vocabulary), 1)
    cell, count = np.unique(word.astype(np.int64) * n + owner, return_counts=True)
    col, row = cell // n, cell % n
    top = np.ones(n)
    np.maximum.at(top, row, count)
    idf = np.log(n / (1 + np.bincount(col, minlength=size)))
    return row, col, count / top[row] * idf[col], size


def _flat(terms: list[list[str]]) -> tuple[np.ndarray, np.ndarray, int]:
    owner = np.repeat(np.arange(len(terms)), [len(words) for words in terms])
    return owner, np.array([w for words in terms for w in words], dtype=object), len(terms)


def weighted_terms(terms: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """``weighted_words`` of lists of words."""
    return weighted_words(*_flat(terms))


def _near_blocks(owner: np.ndarray, word: np.ndarray, n: int) -> Callable[[], Iterator[tuple[int, np.ndarray]]]:
    """Which sentences have a cosine over the threshold, by blocks of rows: first row, mask.

    A graph that fits one block is kept; of a larger one only a block at a time is held, and it is
    made anew whenever it is read, so memory does not grow with the pairs.
    """
    row, col, value, size = weighted_words(owner, word, n)
    norm = np.sqrt(np.bincount(row, value * value, minlength=n))
    rows_at_once = max(1, min(n, BLOCK_CELLS // n))
    words_at_once = max(1, BLOCK_CELLS // n)

    def made() -> Iterator[tuple[int, np.ndarray]]:
        for first in range(0, n, rows_at_once):
            last = min(first + rows_at_once, n)
            dots = np.zeros((last - first, n))
            for start in range(0, size, words_at_once):
                lo, hi = np.searchsorted(col, [start, start + words_at_once])
                dense = np.zeros((n, min(words_at_once, size - start)))
                dense[row[lo:hi], col[lo:hi] - start] = value[lo:hi]
                dots += dense[first:last] @ dense.T
            yield first, dots > EDGE_THRESHOLD * np.outer(norm[first:last], norm)

    if rows_at_once < n:
        return made
    kept = list(made())
    return lambda: iter(kept)


def _central(owner: np.ndarray, word: np.ndarray, n: int, keep: int) -> list[int]:
    """Positions of the most central of the ``n`` sentences of one text, in text order.

    Linked sentences share their rank evenly among their links, iterated until it settles
    (power iteration on the thresholded similarity graph; Erkan and Radev, 2004).
    """
    if n <= keep:
        return list(range(n))
    near = _near_blocks(owner, word, n)
    degree = np.maximum(np.concatenate([mask.sum(axis=1) for _, mask in near()]), 1)
    rank, change = np.full(n, 1.0 / n), 1.0
    while change > TOLERANCE:
        share, spread = rank / degree, np.zeros(n)
        for first, mask in near():
            spread += share[first : first + len(mask)] @ mask
        change = float(np.linalg.norm(spread - rank))
        rank = spread
    # Ranks equal up to rounding noise keep text order.
    best = np.argsort(-np.round(rank, 12), kind="stable")[:keep]
    return sorted(int(i) for i in best)


def _central_sentences(terms: list[list[str]], keep: int) -> list[int]:
    return _central(*_flat(terms), keep)


def _central_of(docs: pa.Array, keep: int, stem: bool) -> pa.Array:
    """``_central`` of each text of a batch (lists of words by sentence); each different word is stemmed once."""
    parts = docs.values
    names = parts.values.dictionary_encode()
    word = names.indices.to_numpy(zero_copy_only=False)
    if stem:
        stems, _ = pd.factorize(np.array([stemmed(w) for w in names.dictionary.to_pylist()], dtype=object))
        word = stems[word]
    starts, best = parts.offsets.to_numpy(), []
    for first, last in itertools.pairwise(docs.offsets.to_numpy().tolist()):
        at = starts[first : last + 1]
        owner = np.repeat(np.arange(last - first), np.diff(at))
        best.append(_central(owner, word[at[0] : at[-1]], last - first, keep))
    return pa.array(best, pa.list_(pa.int32()))


def sentence_terms(
    articles: DataFrame, text: str = "article", stop_words: Sequence[str] = STOP_WORDS
) -> DataFrame:
    """Articles with ``_parts``, the sentences of texts of 100 characters and more, and ``_terms``, their words.

    Rows are dealt out first: what is made of them takes far longer than reading them, and a file of few row
    groups would leave it to as many tasks.
    """
    articles = articles.repartition(int(articles.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def words(s: Column) -> Column:
        return F.regexp_extract_all(F.lower(s), F.lit(r"\p{L}+"), 0)

    long_enough = F.length(trim_space(text)) >= MIN_TEXT
    parts = articles.withColumn("_parts", F.when(long_enough, sentences(text)))
    terms = F.transform("_parts", lambda s: F.filter(words(s), lambda t: ~t.isin(list(stop_words))))
    return parts.withColumn("_terms", F.coalesce(terms, F.array().cast("array<array<string>>")))


def word_stems(parts: DataFrame) -> DataFrame:
    """(article_index, word, stem) of the distinct words of each article; each word is stemmed once."""
    own = parts.select("article_index", F.explode(F.array_distinct(F.flatten("_terms"))).alias("word"))
    return own.join(stem_table(own.select("word").distinct()), "word")


def join_sentences(ranked: DataFrame, text: str = "article") -> DataFrame:
    """Summaries from ``_parts`` and the positions in ``_best``; texts without sentences as they are."""
    picked = F.transform("_best", lambda i: F.get(F.col("_parts"), i))
    no_sentence = F.col("_parts").isNull() | (F.size("_parts") == 0)
    summary = F.when(no_sentence, F.col(text)).otherwise(F.array_join(picked, " "))
    return ranked.select("article_index", one_line(summary).alias("summary"))


def summarise(
    articles: DataFrame,
    text: str = "article",
    keep: int = SUMMARY_SENTENCES,
    stop_words: Sequence[str] = STOP_WORDS,
    stem: bool = False,
) -> DataFrame:
    """Summary of each article: its most central sentences in text order, on one line.

    Texts under 100 characters are returned as they are. Splitting, tokenising and joining run
    in the JVM; only the ranking of one text's sentences is Python, in Arrow batches. With ``stem``
    words count by their stems, made where they stand: no word is shuffled. For texts of thousands of
    sentences see ``long_texts``.
    """
    @F.arrow_udf("array<int>")
    def central(batch: pa.Array) -> pa.Array:
        return _central_of(batch, keep, stem)

    parts = sentence_terms(articles, text, stop_words)
    return join_sentences(parts.withColumn("_best", central("_terms")), text)


# ---- sentence polarity ---------------------------------------------------------

def polarity(p_pos: Column, p_neg: Column, p_neu: Column) -> dict[str, Column]:
    """Label with the largest probability and the signed weight; ties go pos, neg, neutral."""
    best = F.greatest(p_pos, p_neg, p_neu)
    label = (
        F.when(p_pos == best, LABELS[0]).when(p_neg == best, LABELS[1]).otherwise(LABELS[2])
    )
    weight = F.when(p_pos == best, p_pos).when(p_neg == best, -p_neg).otherwise(0.0)
    return {"label": label, "weight": weight}


def score_by_lexicon(table: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Polarity of each sentence from a (word, weight) lexicon.

    With P and N the sums of positive and negative word weights, the probabilities are
    P, N and 1 over (P + N + 1). A lexicon of up to ``SMALL_LEXICON`` words is broadcast: the words
    of a sentence stay in one task, their sums combine there, and one row per sentence is exchanged.
    A larger one is joined by word.
    """
    if lexicon.limit(SMALL_LEXICON + 1).count() <= SMALL_LEXICON:
        lexicon = F.broadcast(lexicon)
    words = F.regexp_extract_all(F.lower("sentence"), F.lit(r"\p{L}+"), 0)
    tokens = table.select("article_index", "sentence_no", F.explode_outer(words).alias("word"))
    weight = F.coalesce(F.col("_w"), F.lit(0.0))
    sums = (
        tokens.join(lexicon.select("word", F.col("weight").alias("_w")), "word", "left")
        .groupBy("article_index", "sentence_no")
        .agg(
            F.sum(F.greatest(weight, F.lit(0.0))).alias("_pos"),
            F.sum(F.greatest(-weight, F.lit(0.0))).alias("_neg"),
        )
    )
    total = F.col("_pos") + F.col("_neg") + 1
    parts = polarity(F.col("_pos") / total, F.col("_neg") / total, 1 / total)
    return sums.withColumns(parts).drop("_pos", "_neg")


def score_with(table: DataFrame, scorer: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """Polarity from any model: ``scorer`` maps texts to rows of (pos, neg, neutral).

    Runs on Arrow batches in each partition. If a batch fails its texts are scored one by one;
    those that fail alone count as neutral and have ``failed`` set.
    """

    def one_by_one(texts: list[str]) -> tuple[np.ndarray, list[bool]]:
        probs, failed = np.tile([0.0, 0.0, 1.0], (len(texts), 1)), [False] * len(texts)
        for i, text in enumerate(texts):
            try:
                probs[i] = np.asarray(scorer([text]), dtype=float).reshape(3)
            except Exception:
                failed[i] = True
        return probs, failed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["sentence"].tolist()
            try:
                probs, failed = np.asarray(scorer(texts), dtype=float).reshape(len(texts), 3), [False] * len(texts)
            except Exception:
                probs, failed = one_by_one(texts)
            yield pd.DataFrame(
                {
                    "article_index": batch["article_index"],
                    "sentence_no": batch["sentence_no"],
                    "p_pos": probs[:, 0],
                    "p_neg": probs[:, 1],
                    "p_neu": probs[:, 2],
                    "failed": failed,
                }
            )

    schema = "article_index bigint, sentence_no int, p_pos double, p_neg double, p_neu double, failed boolean"
    scored = table.select("article_index", "sentence_no", "sentence").mapInPandas(run, schema)
    parts = polarity(F.col("p_pos"), F.col("p_neg"), F.col("p_neu"))
    return scored.withColumns(parts).drop("p_pos", "p_neg", "p_neu")
