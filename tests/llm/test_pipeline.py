"""The whole pipeline against a plain version of its five stages, row by row, on planted documents."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import public_tokenizers
import sentencepiece

import corpus_pipeline
from tickertide.llm import mixing

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
INSULTS = ["idiot", "moron", "stupid", "trash", "scum"]
BLANK = re.compile(r"[\x20\x09-\x0D]+")


def planted(seed=5):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abdelmnorst", k=draw.randrange(2, 8))) for _ in range(300)]
    rows = []

    def add(text, source=None):
        rows.append((len(rows), text, "en", source or draw.choice(["web", "Books", "é", None, "wiki"]), 0))

    for _ in range(110):
        add(" ".join(draw.choices(words, k=draw.randrange(8, 120))) + ".")
    for _ in range(45):
        add(" ".join(draw.choices(words, k=10) + draw.choices(INSULTS, k=12)))
    for k in range(25):  # copies that differ in blanks, in classes of several
        add(rows[k % 9][1].replace(" ", draw.choice([" ", "  ", "\n", "\t "])))
    for k in range(20, 45):  # near copies and chains of them
        changed = rows[k][1].split()
        changed[-1 if k % 2 else 0] = "other"
        add(" ".join(changed))
        changed[len(changed) // 2] = "again"
        add(" ".join(changed))
    for text in (None, "", " \n", "one", "one", "Two words", "two, words!", "word " * 3000):
        add(text)
    rows.append((None, "a row without an id " * 3, None, "web", 0))
    marks = [(i, draw.randrange(2), int(any(w in (t or "") for w in INSULTS))) for i, t, *_ in rows if i is not None and draw.random() < 0.7]
    return rows, marks


def without_toxic(rows):
    return [r for r in rows if not any(w in (r[1] or "") for w in INSULTS)]


def without_copies(rows):
    best = {}
    for r in rows:
        key = BLANK.sub("", r[1] or "")
        place = (-len(r[1] or ""), r[0] is None, r[0] or 0)
        if key not in best or place < best[key][0]:
            best[key] = (place, r)
    return [r for _, r in best.values()]


def without_near_copies(rows):
    grams = []
    for r in rows:
        words = re.findall(r"\w+", (r[1] or "").lower())
        grams.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        if grams[a] and grams[b] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
            parent[root(a)] = root(b)
    kept = {}
    for k, r in enumerate(rows):
        kept[root(k)] = min(kept.get(root(k), r), r, key=lambda x: (x[0] is None, x[0] or 0))
    return list(kept.values())


def plain_targets(sizes):
    """Water level: sources in order of code points, null last, weights 1, 2, 3; at most thrice their size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    left, free, target = float(sum(sizes.values())), set(order), {}
    while True:
        level = left / sum(weight[s] for s in free) if free else 0.0
        full = [s for s in free if 3 * sizes[s] <= level * weight[s]]
        if not full:
            return target | {s: level * weight[s] for s in free}
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.discard(s)


def mixed(rows):
    key = {id(r): hashlib.sha256(f"{'null' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest() for r in rows}
    draw = {k: hashlib.md5(f"{mixing.SEED}:{v}".encode()).hexdigest() for k, v in key.items()}
    size = {id(r): len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    totals = {}
    for r in rows:
        totals[r[3]] = totals.get(r[3], 0) + size[id(r)]
    target, out = plain_targets(totals), []
    for source, total in totals.items():
        whole = math.floor(target[source] / total) if total else 0
        rest, at = math.floor(target[source] - whole * total + 0.5), 0
        for r in sorted((r for r in rows if r[3] == source and size[id(r)]), key=lambda r: (draw[id(r)], key[id(r)])):
            out += [r] * (whole + (at < rest))
            at += size[id(r)]
    return out


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    rows, marks = planted()
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, want = spark.read.parquet(f"{tmp_path}/documents.parquet"), rows
    plain = [without_toxic, without_copies, without_near_copies, mixed]
    sizes = [len(rows)]
    for (name, stage), step in zip(corpus_pipeline.STAGES, plain):
        docs, want = stage(spark, docs, str(tmp_path)), step(want)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert sorted(map(repr, (tuple(r) for r in docs.collect()))) == sorted(map(repr, want)), name
        sizes.append(len(want))
    assert all(a != b for a, b in zip(sizes, sizes[1:]))  # every stage decides something
    coder = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = [np.array(coder.encode(r[1] or "", add_bos=True, add_eos=True), "<u4") for r in want]
    coded = [(r[0], r[3], len(i), i.tobytes()) for r, i in zip(want, ids)]
    got = [(r.doc_id, r.source, r.n_tokens, bytes(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, coded))
