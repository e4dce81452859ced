"""Substring dedup over an index of reference blocks, cut by content and compared by hash.

A window is ``window`` consecutive words of one document. The corpus is cut into reference blocks by
content: every window points at its anchor, the ``ANCHOR``-word gram of smallest hash in it, and a
block is a run of windows with the same anchor. Equal passages are cut alike wherever they stand, so
all blocks can be indexed by their anchor in one shuffle, where whole blocks are looked up by hash.
There is no Lempel-Ziv parse: blocks that agree in part only (same anchor, other words around it)
have the windows of each distinct block compared one by one in a second, smaller shuffle. A window is a duplicate if its
words also start earlier, and the words that duplicate windows cover are removed.

Of equal blocks (or windows) in one piece of a task only the first goes to the index; the others are
known to be later and go straight to their documents, so a passage in a third of all documents sends
one record per piece. Records travel packed, dealt by hash: to the parts of the index by anchor, to
the parts of the documents by id. Equality is that of two independent 64-bit hashes.

Defined results: a null text has no words; fewer words than a window are never removed; earlier means
smaller id (null last), then earlier start; rows that repeat an id with another text are told apart
by the CRC of the text, rows equal in both are one document and share its result; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import io
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tickertide.llm.common import pieces, stored, texts_of

WINDOW = 20
ANCHOR = 8
PART_BYTES = 32 << 20  # of text, per part of the index and of the documents
MAX_PARTS = 100_000
NO_ID = np.iinfo(np.int64).max

# What a part of the index or of the documents receives.
REMOVED, BOUNDARY, INDEX, TEXT = 0, 1, 2, 3
RECORD = np.dtype([("key", "<u8"), ("same", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("salt", "<u4"), ("n", "<u4")])
SPAN = np.dtype([("doc", "<i8"), ("at", "<i4"), ("salt", "<u4"), ("n", "<u4")])
SCHEMA = "part int, kind int, body binary"

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _part(x: np.ndarray, parts: int) -> np.ndarray:
    return (_mixed(x.astype(np.uint64) + np.uint64(0x51ED27)) % np.uint64(parts)).astype(np.int32)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, and the number of words of each."""
    lists = pc.ascii_split_whitespace(texts)
    flat = pc.list_flatten(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    return flat.filter(full), np.bincount(doc[full.to_numpy(zero_copy_only=False)], minlength=len(texts)).astype(np.int64)


class _Hashes:
    """Hashes of words, and of any run of words, of one piece."""

    def __init__(self, words: pa.Array):
        import xxhash

        coded = words.dictionary_encode()
        distinct = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        self.words = distinct[coded.indices.to_numpy()]
        n = len(self.words)
        self.powers, self.backs = (np.full(n + 1, base, np.uint64) for base in (_BASE, _BACK))
        self.powers[0] = self.backs[0] = 1
        self.powers, self.backs = np.cumprod(self.powers), np.cumprod(self.backs)
        # The second hash must be independent of the grams below, so it takes other word hashes.
        other = _mixed(self.words ^ np.uint64(0xA5A5A5A55A5A5A5A))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(other * self.powers[:-1], out=self.sums[1:])

    def run(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[first]) * self.backs[first] + (end - first).astype(np.uint64))

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each position (n a power of two)."""
        h, size, factor = self.words, 1, 0xD6E8FEB86659FD93
        while size < n:
            h = h[:-size] * np.uint64(factor) + h[size:] if len(h) > size else h[:0]
            factor, size = factor * factor % (1 << 64), size * 2
        return _mixed(h)


def _first_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the first smallest value among the ``width`` values from each position."""
    best, at, reach = values, np.arange(len(values), dtype=np.int32), 1
    while reach < width:
        step = min(reach, width - reach)
        if len(best) <= step:
            return at[:0]
        less = best[step:] < best[:-step]
        best, at, reach = np.where(less, best[step:], best[:-step]), np.where(less, at[step:], at[:-step]), reach + step
    return at


def _blocks(words: pa.Array, counts: np.ndarray, window: int):
    """Blocks of all documents of a piece: anchor hash, block hash, document, first window, number of windows."""
    hashes = _Hashes(words)
    grams = hashes.grams(ANCHOR)
    anchors = _first_smallest(grams, window - ANCHOR + 1)
    starts = np.concatenate([[0], np.cumsum(counts)])
    doc = np.repeat(np.arange(len(counts), dtype=np.int32), np.maximum(counts - window + 1, 0))
    n_windows = np.maximum(counts - window + 1, 0)
    before = np.concatenate([[0], np.cumsum(n_windows)])
    at = (np.arange(before[-1]) - before[doc] + starts[doc]).astype(np.int64)  # first word of each window
    anchor = anchors[at]
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(at) else np.zeros(0, np.int64)
    n = np.diff(np.concatenate([new, [len(at)]]))
    first = at[new]
    return grams[anchor[new]], hashes.run(first, first + n + window - 1), doc[new], first - starts[doc[new]], n


def _packed(parts: np.ndarray, rows: np.ndarray, kind: int):
    """Rows dealt to their parts: (part, kind, bytes)."""
    order = np.argsort(parts, kind="stable")
    rows, parts = rows[order], parts[order]
    cuts = np.flatnonzero(np.diff(parts)) + 1
    for chunk, p in zip(np.split(rows, cuts), np.split(parts, cuts)):
        if len(p):
            yield int(p[0]), kind, chunk.tobytes()


def _spans(records: np.ndarray) -> np.ndarray:
    out = np.empty(len(records), SPAN)
    for name in SPAN.names:
        out[name] = records[name]
    return out


def _ordered(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records by key, content and place, and which of them are the first of their content."""
    records = records[np.lexsort((records["at"], records["salt"], records["doc"], records["same"], records["key"]))]
    if len(records):
        records = records[np.concatenate([[True], records[1:] != records[:-1]])]  # rows given twice are one document
    first = np.ones(len(records), bool)
    first[1:] = (records["key"][1:] != records["key"][:-1]) | (records["same"][1:] != records["same"][:-1])
    return records, first


def _dealt(records: np.ndarray, parts: int):
    """To the index the first of each content, to their documents those that follow it."""
    records, first = _ordered(records)
    yield from _packed(_part(records["key"][first], parts), records[first], INDEX)
    later = _spans(records[~first])
    yield from _packed(_part(later["doc"], parts), later, REMOVED)


def _batch(rows) -> pa.RecordBatch:
    rows = list(rows)
    part, kind, body = ([r[i] for r in rows] for i in range(3))
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(body, pa.binary())], ["part", "kind", "body"])


def _ids(batch: pa.RecordBatch, texts: pa.Array, salted: bool) -> tuple[np.ndarray, np.ndarray]:
    ids = pc.fill_null(batch.column("doc_id"), NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
    if not salted:
        return ids, np.zeros(len(ids), np.uint32)
    return ids, np.fromiter((zlib.crc32(t.encode()) for t in texts.to_pylist()), np.uint32, len(ids))


def _cut_documents(window: int, parts: int, salted: bool):
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                texts = texts_of(piece)
                ids, salts = _ids(piece, texts, salted)
                key, same, doc, at, n = _blocks(*words_of(texts), window)
                records = np.empty(len(key), RECORD)
                for name, value in (("key", key), ("same", same), ("doc", ids[doc]), ("salt", salts[doc]), ("at", at), ("n", n)):
                    records[name] = value
                yield _batch(_dealt(records, parts))

    return run


def _sent_texts(parts: int, salted: bool):
    """Texts on their way to the part of their document, compressed."""

    def run(batches):
        import zstandard

        for batch in batches:
            for piece in pieces(batch, "text"):
                ids, salts = _ids(piece, texts_of(piece), salted)
                table = pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(salts), piece.column("text")], ["doc_id", "salt", "text"]
                )
                to = _part(ids, parts)
                order = np.argsort(to, kind="stable")
                rows = []
                for rows_of in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                    if len(rows_of):
                        sink = io.BytesIO()
                        with pa.ipc.new_stream(sink, table.schema) as writer:
                            writer.write_batch(table.take(pa.array(rows_of)))
                        rows.append((int(to[rows_of[0]]), TEXT, zstandard.compress(sink.getvalue(), 3)))
                yield _batch(rows)

    return run


def _received(batches):
    """Rows of a part: kind and body. They come sorted by kind, texts last."""
    for batch in batches:
        yield from zip(batch.column("kind").to_pylist(), batch.column("body").to_pylist())


def _looked_up(parts: int, boundaries: bool):
    """A part of the index: later blocks are removed; where an anchor has several blocks, their firsts are boundaries."""

    def run(batches):
        held = []
        for kind, body in _received(batches):
            if kind == INDEX:
                held.append(np.frombuffer(body, RECORD))
        if not held:
            return
        records, first = _ordered(np.concatenate(held))
        later = _spans(records[~first])
        rows = list(_packed(_part(later["doc"], parts), later, REMOVED))
        if boundaries:
            heads = records[first]
            key = heads["key"]
            shared = np.zeros(len(heads), bool)
            shared[1:] = key[1:] == key[:-1]
            shared[:-1] |= key[1:] == key[:-1]
            heads = _spans(heads[shared])
            rows += _packed(_part(heads["doc"], parts), heads, BOUNDARY)
        yield _batch(rows)

    return run


def _by_document(spans: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    spans = spans[np.lexsort((spans["salt"], spans["doc"]))]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(spans["doc"]) != 0) | (np.diff(spans["salt"]) != 0)])) if len(spans) else []
    return {(int(spans["doc"][a]), int(spans["salt"][a])): spans[a:b] for a, b in zip(new, [*new[1:], len(spans)])}


def _texts_with_spans(batches, kind_wanted: int):
    """For each run of texts of a part: ids, salts, texts and, per text, its spans of a kind (or None)."""
    import zstandard

    held, by_document = [], None
    for kind, body in _received(batches):
        if kind == kind_wanted:
            held.append(np.frombuffer(body, SPAN))
        elif kind == TEXT:
            if by_document is None:
                by_document = _by_document(np.concatenate(held) if held else np.zeros(0, SPAN))
            table = pa.ipc.open_stream(zstandard.decompress(body)).read_next_batch()
            for piece in pieces(table, "text"):
                salts = piece.column("salt").to_numpy()
                keys = pc.fill_null(piece.column("doc_id"), NO_ID).to_pylist()
                yield piece, keys, salts, [by_document.get((k, int(s))) for k, s in zip(keys, salts)]


def _windows_at_boundaries(window: int, parts: int):
    def run(batches):
        for piece, keys, salts, spans in _texts_with_spans(batches, BOUNDARY):
            chosen = [i for i, s in enumerate(spans) if s is not None]
            if not chosen:
                continue
            words, counts = words_of(texts_of(piece).take(pa.array(chosen)))
            hashes, starts = _Hashes(words), np.concatenate([[0], np.cumsum(counts)])
            grams = hashes.grams(4)
            made = []
            for i, start in zip(chosen, starts):
                n = spans[i]["n"].astype(np.int64)
                at = np.repeat(spans[i]["at"] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                first = at + start
                rows = np.empty(len(at), RECORD)
                rows["key"] = _mixed(grams[first] + grams[first + window - 4] * np.uint64(3))
                rows["same"] = hashes.run(first, first + window)
                rows["doc"], rows["salt"], rows["at"], rows["n"] = keys[i], salts[i], at, 1
                made.append(rows)
            yield _batch(_dealt(np.concatenate(made), parts))

    return run


def _without_spans(window: int):
    def run(batches):
        for piece, _, _, spans in _texts_with_spans(batches, REMOVED):
            words, counts = words_of(texts_of(piece))
            starts = np.concatenate([[0], np.cumsum(counts)])
            cover = np.zeros(len(words) + 1, np.int32)
            for start, own in zip(starts, spans):
                if own is not None:
                    np.add.at(cover, own["at"] + start, 1)
                    np.add.at(cover, own["at"] + own["n"].astype(np.int64) + window - 1 + start, -1)
            gone = np.cumsum(cover)[:-1] > 0
            kept = np.concatenate([[0], np.cumsum(~gone)])[starts]
            lists = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words.filter(pa.array(~gone)).cast(pa.string()))
            text = pc.binary_join(lists, " ")
            # Removed spans: runs of removed words within a document.
            doc = np.repeat(np.arange(len(counts)), counts)
            first = gone & np.concatenate([[True], ~gone[:-1] | (doc[1:] != doc[:-1])])[: len(gone)]
            last = gone & np.concatenate([~gone[1:] | (doc[1:] != doc[:-1]), [True]])[: len(gone)]
            a, b = np.flatnonzero(first), np.flatnonzero(last)
            at = np.concatenate([[0], np.cumsum(np.bincount(doc[a], minlength=len(counts)))]).astype(np.int32)
            span = pa.StructArray.from_arrays([pa.array(a - starts[doc[a]], pa.int64()), pa.array(b - a + 1, pa.int64())], ["first", "n"])
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(counts - np.diff(kept), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(at), span),
                    text,
                ],
                ["doc_id", "n_words", "n_removed", "spans", "kept_text"],
            )

    return run


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, spans (first word, words), kept_text."""
    if window < ANCHOR:
        raise ValueError(f"a window has at least {ANCHOR} words")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    # Ids that tell rows apart need no CRC beside them; zeros cost nothing on the way.
    seen = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    most, total = seen.agg(F.max(F.when(F.col("doc_id").isNull(), 2).otherwise(F.col("n"))), F.sum("bytes")).first()
    salted = bool(most and most > 1)
    parts = min(MAX_PARTS, max(1, -(-(total or 0) // PART_BYTES)))

    def dealt(table: DataFrame) -> DataFrame:
        return table.repartitionById(parts, F.col("part")).sortWithinPartitions("kind")

    def indexed(records: DataFrame, boundaries: bool, label: str) -> DataFrame:
        found = dealt(records).mapInArrow(lambda batches: _forwarded(batches, _looked_up(parts, boundaries)), SCHEMA)
        return stored(found, label)

    texts = rows.mapInArrow(_sent_texts(parts, salted), SCHEMA)
    found = indexed(rows.mapInArrow(_cut_documents(window, parts, salted), SCHEMA), True, "blocks")
    inner = dealt(texts.unionByName(found.filter(F.col("kind") == BOUNDARY))).mapInArrow(_windows_at_boundaries(window, parts), SCHEMA)
    edges = indexed(inner, False, "windows")
    removed = found.filter(F.col("kind") == REMOVED).unionByName(edges)
    schema = "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<first:bigint,n:bigint>>, kept_text string"
    return dealt(texts.unionByName(removed)).mapInArrow(_without_spans(window), schema)


def _forwarded(batches, look_up):
    """Spans already known to be later pass through a part of the index as they are."""
    held = []

    def rest():
        for batch in batches:
            known = pc.not_equal(batch.column("kind"), INDEX)
            through = batch.filter(known)
            if through.num_rows:
                held.append(through)
            yield batch

    yield from look_up(rest())
    yield from held
