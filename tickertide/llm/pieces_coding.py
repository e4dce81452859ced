"""SentencePiece encoding and decoding with a table of distinct chunks.

The vocabulary has no piece in which a word marker follows another character, so no piece crosses
the beginning of a marked word: the ids of a text are those of its chunks (a run of markers and the
word behind it) one after the other. In every piece of a batch the distinct chunks are found, each
is segmented once by the library, and the ids are joined back by position with array operations.
Decoding works alike: ids are cut before each piece that begins with a marker, distinct chunks are
decoded once; ``encode`` can add the decoded text from its own table. It refuses a vocabulary with crossing pieces.

The table belongs to a task and is emptied when it holds ``TABLE`` chunks, so memory is bounded; a
table for the whole corpus would have to shuffle every word of it.

Defined results: a null text counts as empty and has no ids besides begin and end; control strings
in a text are ordinary text; repeated rows repeat their result; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tickertide.llm.common import in_batches, pieces

MARK = "▁"
TABLE = 200_000
PIECE = 2 << 20


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def crossing_pieces(model: bytes) -> list[str]:
    """Pieces with a marker behind another character; chunks are exact only without any."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = (lib.id_to_piece(i) for i in range(lib.get_piece_size()))
    return [name for name in names if MARK in name.lstrip(MARK)]


def chunks_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Chunks of all texts, as the strings that the library encodes to them, and the number per text.

    The library puts one marker before every string, so a chunk of m markers and a word is written
    with m - 1 blanks; a lone marker becomes an empty string.
    """
    flat = pc.split_pattern(pc.replace_substring(texts, MARK, " "), " ")
    counts = np.where(pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), 0, pc.list_value_length(flat).to_numpy())
    words = pc.list_flatten(flat.filter(pa.array(counts > 0)))
    blank = np.flatnonzero(pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False))
    if not len(blank):
        return words, counts
    # A run of blanks joins the word behind it, or stands alone at the end of its text.
    doc = np.repeat(np.arange(len(counts)), counts)
    keep, put = np.ones(len(words), bool), {}
    breaks = np.flatnonzero((np.diff(blank) > 1) | (np.diff(doc[blank]) > 0)) + 1
    for run in np.split(blank, breaks):
        last = run[-1]
        if last + 1 < len(words) and doc[last + 1] == doc[last]:
            put[last + 1] = " " * len(run) + words[int(last) + 1].as_py()
            keep[run] = False
        else:
            put[last] = " " * (len(run) - 1)
            keep[run[:-1]] = False
    at = np.array(sorted(put))
    mask = np.zeros(len(words), bool)
    mask[at] = True
    words = pc.replace_with_mask(words, pa.array(mask), pa.array([put[i] for i in at], words.type))
    return words.filter(pa.array(keep)), np.bincount(doc[keep], minlength=len(counts))


def by_position(lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Indexes into a flat table with rows of ``lengths`` that lay out the rows ``codes`` one by one."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    n = lengths[codes]
    ends = np.cumsum(n)
    return np.repeat(starts[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def edges(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def encode(
    docs: DataFrame,
    model: bytes,
    text: str = "text",
    columns: list[str] | None = None,
    decoded: bool = False,
    table: int = TABLE,
) -> DataFrame:
    """Rows of ``docs`` with n_tokens and ids: little-endian unsigned 32-bit ids with begin and end.

    ``decoded`` adds the text that the library makes of the ids, from the same table: a chunk is
    decoded once, and a blank stands for the marker between chunks.
    """
    if crossing := crossing_pieces(model):
        raise ValueError(f"pieces cross word markers: {crossing[:5]}")

    def task():
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        begin, end = (np.array([i], "<u4").tobytes() for i in (lib.bos_id(), lib.eos_id()))
        lone = lib.piece_to_id(MARK)
        known: dict[str, tuple[bytes, str]] = {}

        def learn(words: list[str]) -> None:
            for at in range(0, len(words), 20_000):
                some = words[at : at + 20_000]
                ids = [x if w else [lone] for w, x in zip(some, lib.encode(some, num_threads=1))]
                texts = lib.decode(ids, num_threads=1) if decoded else [""] * len(ids)
                flat = np.array([i for x in ids for i in x], "<u4").tobytes()
                at = edges(np.fromiter(map(len, ids), np.int64, len(ids))).tolist()
                known.update((w, (flat[4 * a : 4 * b], t)) for w, a, b, t in zip(some, at[:-1], at[1:], texts))

        def step(texts: pa.Array):
            words, counts = chunks_of(texts)
            coded = words.dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            if len(known) > table:
                known.clear()
            learn([w for w in distinct if w not in known])
            rows = [known[w][0] for w in distinct]
            lengths = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
            codes = coded.indices.to_numpy()
            flat = np.frombuffer(b"".join(rows), "<u4")[by_position(lengths, codes)].tobytes()
            at = edges(lengths[codes])[edges(counts)] * 4
            packed = [begin + flat[a:b] + end for a, b in zip(at[:-1], at[1:])]
            made = [pa.array(np.diff(at) // 4 + 2, pa.int64()), pa.array(packed, pa.binary())]
            if decoded:
                chunks = pa.array([known[w][1] for w in distinct], pa.string()).take(coded.indices)
                made.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(edges(counts), pa.int32()), chunks), " "))
            return made

        return step

    fields = [("n_tokens", "bigint"), ("ids", "binary")] + [("decoded", "string")] * decoded
    return in_batches(docs, task, fields, columns, text, PIECE)


def decode(encoded: DataFrame, model: bytes, columns: list[str], ids: str = "ids", table: int = TABLE) -> DataFrame:
    """Rows of ``encoded`` (``columns`` of them) with ``decoded``, the text of their ids."""
    rows = encoded.select(*dict.fromkeys([*columns, ids]))

    def run(batches):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        opens = np.array([lib.id_to_piece(i).startswith(MARK) for i in range(lib.get_piece_size())])
        silent = np.array([lib.is_control(i) for i in range(lib.get_piece_size())])
        known: dict[bytes, str] = {}

        def text_of(packed: bytes) -> str:
            if len(known) > table:
                known.clear()
            row = np.frombuffer(packed, "<u4")
            row = row[~silent[row]]
            cuts = np.flatnonzero(opens[row]) * 4
            flat = row.tobytes()
            bounds = [0, *cuts[cuts > 0].tolist(), len(flat)]
            keys = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            new = list({k for k in keys if k not in known})
            known.update(zip(new, lib.decode([np.frombuffer(k, "<u4").tolist() for k in new], num_threads=1) if new else []))
            return " ".join([known[k] for k in keys])

        for batch in batches:
            for piece in pieces(batch, ids, PIECE):
                made = [text_of(p or b"") for p in piece.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in columns), pa.array(made, pa.string())], [*columns, "decoded"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", decoded string")
