"""Language of every word of a text, by script ranges and Viterbi over character n-gram scores.

Learned from labelled texts: per language the counts of hashed n-grams (1 to 4 code points of a word
with its ends) and the scripts its letters come from. A word is a run without blanks; its letters
decide. The script range of its first letter narrows the candidates to the languages that use that
script; each gets the log likelihood of the word's n-grams. Viterbi finds the labels of a text that
score best when every change of language costs ``penalty``: runs of equal labels are the spans of a
text in mixed languages. Words without letters, or in a script no language uses, carry no score.

Viterbi runs in array operations for all texts of a piece at once. A text is cut into stretches of
``STRETCH`` words; for each one the best scores from every language to every language are found,
the stretches are chained, and labels are read back, so a text of any length gets the exact result.

The fit uses at most ``max_rows`` texts, those with the smallest hash of their id. A text is labelled
with the language of most letters (ties: the first in order of names); the score is its share of them.

Defined results: text null or without a letter gives `und`, score 0 and no spans; without labelled
texts everything is `und`; repeated rows repeat their result; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tickertide.llm.common import in_batches, pieces, plain_text
from tickertide.llm.ngrams import code_points, hashed

SIZES = range(1, 5)
BITS = 16
MAX_ROWS = 12_000
PENALTY = 6.0
FOLDS = 3
STRETCH = 128
UNKNOWN = "und"
MIN_SHARE = 0.01  # of a language's letters, for a script to be one of its own
FAR = np.float32(-1e6)

# First code point of each script range (fixed values of the Unicode standard): Latin, Greek, Cyrillic,
# Armenian, Hebrew, Arabic, Syriac and others, Indic, Thai and others, Georgian, Hangul, others, Latin
# additional, Greek extended, others, kana, Han and others, Hangul syllables, others.
SCRIPTS = np.array(
    [0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0xE00, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0xAC00, 0xD7B0]
)
SAME_SCRIPT = {12: 0, 13: 1}  # the additional ranges of Latin and Greek


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # bucket x language, log likelihood over the number of n-gram sizes
    uses: np.ndarray  # script x language


def held_out(doc_id: str = "doc_id", folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 1, F.lit(False))


def script_of(codes: np.ndarray) -> np.ndarray:
    found = np.searchsorted(SCRIPTS, codes, "right") - 1
    for extra, own in SAME_SCRIPT.items():
        found[found == extra] = own
    return found


def split(texts: pa.Array):
    """Distinct words by their letters and marks, number of letters, word -> distinct, words per text."""
    lists = pc.ascii_split_whitespace(texts)
    coded = pc.list_flatten(lists).dictionary_encode()
    letters = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), r"[^\p{L}\p{M}]+", "")
    n_letters = pc.utf8_length(pc.replace_substring_regex(letters, r"\p{M}+", "")).to_numpy()
    return letters.to_pylist(), n_letters, coded.indices.to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64)


def word_grams(letters: list[str]):
    """(bucket, word) of every n-gram of every word, ends marked."""
    codes, starts = code_points([f"\x02{w}\x03" for w in letters])
    word = np.repeat(np.arange(len(letters)), np.diff(starts))
    left = starts[1:][word] - np.arange(len(codes))
    for n, buckets in hashed(codes, SIZES, BITS):
        inside = left[: len(buckets)] >= n
        yield buckets[inside], word[: len(buckets)][inside]


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = MAX_ROWS, folds: int = FOLDS) -> Model:
    known = docs.filter(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id, folds))
    chosen = known.select(F.col(doc_id).alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = known.select(F.col(doc_id).alias("_id"), F.col(lang).alias("lang"), plain_text(text).alias("text"))
    rows = rows.join(F.broadcast(chosen), "_id", "left_semi")  # at most max_rows ids

    def count(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                langs = np.array(piece.column("lang").to_pylist(), dtype=object)
                for lang_ in sorted(set(langs)):
                    texts = piece.column("text").filter(pa.array(langs == lang_)).cast(pa.large_string())
                    letters, n_letters, codes, _ = split(texts)
                    times = np.bincount(codes, minlength=len(letters)) * (n_letters > 0)
                    tally = np.zeros(1 << BITS)
                    for buckets, word in word_grams(letters):
                        tally += np.bincount(buckets, times[word], 1 << BITS)
                    script = script_of(np.fromiter((ord(w[0]) if w else 0 for w in letters), np.int64, len(letters)))
                    scripts = np.bincount(script, times * n_letters, len(SCRIPTS))
                    keys = np.concatenate([np.flatnonzero(tally), -1 - np.flatnonzero(scripts)])
                    sums = np.concatenate([tally[tally > 0], scripts[scripts > 0]]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(keys), pa.string()), pa.array(keys), pa.array(sums)], ["lang", "key", "n"])

    counts = rows.mapInArrow(count, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    table = counts.toPandas()  # at most one row per learned language and bucket
    languages = sorted(table.lang.unique())
    grams, scripts = np.zeros((1 << BITS, len(languages))), np.zeros((len(SCRIPTS), len(languages)))
    column = table.lang.map({name: i for i, name in enumerate(languages)}).to_numpy(dtype=np.int64)
    key, n = table.key.to_numpy(), table.n.to_numpy()
    grams[key[key >= 0], column[key >= 0]] = n[key >= 0]
    scripts[-1 - key[key < 0], column[key < 0]] = n[key < 0]
    logs = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * (1 << BITS))) / len(SIZES)
    return Model(languages, logs.astype(np.float32), scripts >= MIN_SHARE * np.maximum(scripts.sum(0), 1))


def word_scores(model: Model, letters: list[str]) -> np.ndarray:
    out = np.zeros((len(letters), len(model.languages)), np.float32)
    for buckets, word in word_grams(letters):
        for i in range(out.shape[1]):
            out[:, i] += np.bincount(word, model.scores[buckets, i], len(letters)).astype(np.float32)
    script = script_of(np.fromiter((ord(w[0]) if w else 0 for w in letters), np.int64, len(letters)))
    fits = model.uses[script]
    some = fits.any(1) & np.fromiter(map(bool, letters), bool, len(letters))
    # Only differences count: the best candidate gets 0, so scores stay small over long texts.
    out = np.where(fits, out, -np.inf)
    out = np.maximum(out - np.where(some, out.max(1), 0)[:, None], FAR)
    return np.where(some[:, None], out, np.float32(0)).astype(np.float32)


def _stretches(counts: np.ndarray, size: int):
    """Stretches of each text: text, first word (of the piece), number of words; the longest first."""
    starts = np.concatenate([[0], np.cumsum(counts)])
    n = -(-counts // size)
    text = np.repeat(np.arange(len(counts)), n)
    index = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    first = starts[text] + index * size
    return text, first, np.minimum(size, starts[text + 1] - first)


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float, size: int = STRETCH) -> np.ndarray:
    """The best label of every word; ``scores``: words x labels of all texts one after the other."""
    n_labels = scores.shape[1]
    text, first, n = _stretches(counts, size)
    order = np.argsort(-n, kind="stable")
    alive = [int(x) for x in np.searchsorted(-n[order], -np.arange(size), "left")]  # stretches longer than t
    labels = np.zeros(len(scores), np.int16)
    if not len(text):
        return labels
    at = first[order]

    # Best score of each stretch from each label before it (axis 1) to each label at its end (axis 2).
    best = np.where(np.eye(n_labels, dtype=bool), 0, -penalty).astype(np.float64)[None].repeat(len(order), 0)
    best += scores[at][:, None, :]
    for t in range(1, size):
        k = alive[t]
        if not k:
            break
        now = best[:k]
        best[:k] = np.maximum(now, now.max(2, keepdims=True) - penalty) + scores[at[:k] + t][:, None, :]
    across = np.empty_like(best)
    across[order] = best

    # Chain the stretches of each text, k-th stretches of all texts at once. The label before a text is free.
    index = np.arange(len(text)) - np.searchsorted(text, text)
    start = np.zeros(len(text), np.int64)
    total = np.zeros((len(counts), n_labels))
    came = np.zeros((len(text), n_labels), np.int64)
    steps = np.split(np.argsort(index, kind="stable"), np.cumsum(np.bincount(index))[:-1])
    for step in steps:
        sums = total[text[step]][:, :, None] + across[step]
        came[step] = sums.argmax(1)
        total[text[step]] = sums.max(1)
    end = np.zeros(len(text), np.int64)
    last = total.argmax(1)
    for step in steps[::-1]:
        end[step] = last[text[step]]
        start[step] = came[step, end[step]]
        last[text[step]] = start[step]

    # Once more with the label before each stretch known, keeping where each label came from.
    before, after = start[order], end[order]
    now = np.where(np.eye(n_labels, dtype=bool)[before], 0.0, -penalty) + scores[at]
    stayed, top = [], []
    for t in range(1, size):
        k = alive[t]
        if not k:
            break
        best_now = now[:k].argmax(1)
        jump = now[np.arange(k), best_now][:, None] - penalty
        stayed.append(now[:k] >= jump)
        top.append(best_now.astype(np.int16))
        now[:k] = np.maximum(now[:k], jump) + scores[at[:k] + t]
    label = after.copy()
    for t in range(len(stayed), 0, -1):
        k = alive[t]
        labels[at[:k] + t] = label[:k]
        label[:k] = np.where(stayed[t - 1][np.arange(k), label[:k]], label[:k], top[t - 1])
    labels[at] = label
    return labels


def identify(docs: DataFrame, model: Model, text: str = "text", columns: list[str] | None = None, penalty: float = PENALTY) -> DataFrame:
    """Rows of ``docs`` with lang_pred, score and spans (first word, words, language)."""

    def task():
        names = pa.array([*model.languages, UNKNOWN], pa.string())

        def step(texts: pa.Array):
            letters, n_letters, codes, counts = split(texts)
            n_labels = len(model.languages)
            share = np.zeros((len(counts), max(n_labels, 1)))
            labels = np.zeros(len(codes), np.int16)
            text_of = np.repeat(np.arange(len(counts)), counts)
            weight = n_letters[codes] if len(codes) else np.zeros(0)
            if n_labels and len(codes):
                labels = viterbi(word_scores(model, letters)[codes], counts, penalty)
                share = np.bincount(text_of * n_labels + labels, weight, len(counts) * n_labels).reshape(len(counts), n_labels)
            total = share.sum(1)
            known = total > 0
            pred = np.where(known, share.argmax(1), n_labels)
            score = np.where(known, share.max(1) / np.maximum(total, 1), 0.0)
            head = np.ones(len(codes), bool)
            head[1:] = (labels[1:] != labels[:-1]) | (text_of[1:] != text_of[:-1])
            head &= known[text_of]
            at = np.flatnonzero(head)
            starts = np.cumsum(counts) - counts
            ends = np.minimum(np.append(at[1:], len(codes)), (starts + counts)[text_of[at]])
            cuts = np.concatenate([[0], np.cumsum(np.bincount(text_of[at], minlength=len(counts)))]).astype(np.int32)
            span = pa.StructArray.from_arrays(
                [pa.array(at - starts[text_of[at]], pa.int64()), pa.array(ends - at, pa.int64()), names.take(pa.array(labels[at].astype(np.int64)))],
                ["first", "n", "lang"],
            )
            return names.take(pa.array(pred)), pa.array(score), pa.ListArray.from_arrays(pa.array(cuts), span)

        return step

    fields = [("lang_pred", "string"), ("score", "double"), ("spans", "array<struct<first:bigint,n:bigint,lang:string>>")]
    return in_batches(docs, task, fields, columns, text, 4 << 20)
