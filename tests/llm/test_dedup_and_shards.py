"""Exact dedup, near copies, substrings and shards against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tickertide.llm import exact_dedup, near_dups, sharding, substrings

DOCS = "doc_id bigint, text string, digest string, row string, lang string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", None) for i, t in rows], DOCS).repartition(3)


ODD = [
    (3, "a b"), (1, "ab"), (2, " a\tb\n"), (7, None), (6, ""), (None, " "), (9, "a b"), (9, "a b"),
    (4, "é"), (5, "é "), (8, "x" * 100_000),
]


def test_exact_dedup_cases(spark):
    rows = [r.asDict() for r in exact_dedup.exact_dedup(table(spark, ODD)).collect()]
    assert len(rows) == len(ODD)
    ab = [r for r in rows if r["text_sha256"] == hashlib.sha256(b"ab").hexdigest()]
    # Most code points wins (id 2), also over repeated rows.
    assert {r["keep_id"] for r in ab} == {2} and {r["group_size"] for r in ab} == {5}
    assert [r["doc_id"] for r in ab if r["kept"]] == [2]
    empty = [r for r in rows if r["text_sha256"] == hashlib.sha256(b"").hexdigest()]
    assert {r["keep_id"] for r in empty} == {None} and len(empty) == 3 and sum(r["kept"] for r in empty) == 1
    assert sum(r["kept"] for r in rows) == 4


def test_exact_dedup_of_repeated_rows_and_hot_group(spark):
    rows = [(1, "same text")] * 300 + [(i, f"own {i}") for i in range(2, 400)]
    out = exact_dedup.exact_dedup(table(spark, rows), support=0.1)
    assert out.filter("kept").count() == 399
    assert out.filter("doc_id = 1").agg(F.max("group_size"), F.sum(F.col("kept").cast("int"))).first()[:] == (300, 1)
    kept = exact_dedup.kept_documents(table(spark, rows), support=0.1)
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")] and kept.count() == 399
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0


def _least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, n, held = (low + high) // 2, 1, 0
        for s in sizes:
            if held + s > middle:
                n, held = n + 1, 0
            held += s
        low, high = (low, middle) if n <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("seed", [1, 2])
def test_shards_are_minimax(spark, seed):
    draw = random.Random(seed)
    texts = ["".join(draw.choices("abé", k=draw.randint(0, 300))) for _ in range(120)]
    rows = [(i, draw.choice(texts)) for i in range(300)] + [(None, None), (5, "again")]
    out = sharding.shard_documents(table(spark, rows), shards=6, points=4, window=10).collect()
    assert len(out) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    # A null id stands before all others.
    ordered = sorted(groups.items(), key=lambda g: (min(i for i in g[1] if i is not None) if any(i is not None for i in g[1]) else -1))
    sizes = [len(ids) * (len(t.encode()) + 8) for t, ids in ordered]
    by_shard = {}
    for r in out:
        by_shard.setdefault(r.shard, []).append(r)
    assert max(sum(r.size for r in x) for x in by_shard.values()) == _least_capacity(sizes, 6)
    for x in by_shard.values():
        assert sorted(r.slot for r in x) == list(range(len(x)))
    shard_of = {}
    for r in out:
        assert shard_of.setdefault(r.text_crc32, r.shard) == r.shard


def test_shards_of_few_or_no_documents(spark):
    out = sharding.shard_documents(table(spark, [(1, "a"), (2, "a"), (3, None)]), shards=24).collect()
    assert sorted(r.slot for r in out if r.text_crc32 == 0) == [0] and all(0 <= r.shard < 24 for r in out)
    assert sharding.shard_documents(table(spark, [])).count() == 0


def _without_repeats(rows, window):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words, gone = WORDS.findall(t or ""), set()
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            gone.update(range(p, p + window)) if key in seen else seen.add(key)
        out[i] = (len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_substrings_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(substrings, "PART_BYTES", 3000)  # several parts
    draw = random.Random(seed)
    passages = [[draw.choice("abcdefgh") + str(draw.randint(0, 3)) for _ in range(draw.randint(5, 60))] for _ in range(12)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(draw.randint(0, 5)):
            words += draw.choice(passages)[draw.randint(0, 6) :] if draw.random() < 0.6 else draw.choices("xyz", k=draw.randint(0, 40))
        rows.append((i * 7 % 61, draw.choice([" ", "\n", " \t "]).join(words)))
    rows += [(100, None), (101, ""), (102, "w " * 500), (None, " ".join(passages[0]))]
    out = substrings.dedup_substrings(table(spark, rows))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in out.collect()} == _without_repeats(rows, 20)


def test_substrings_spans_repeated_rows_and_empty_table(spark):
    text = " ".join(str(i) for i in range(30))
    out = substrings.dedup_substrings(table(spark, [(1, text), (2, "z " + text), (2, "z " + text), (2, "other")])).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in out) == [(1, 30, 0), (2, 1, 0), (2, 31, 30), (2, 31, 30)]
    assert [[tuple(s) for s in r.spans] for r in out if r.n_removed] == [[(1, 30)], [(1, 30)]]
    assert substrings.dedup_substrings(table(spark, [])).count() == 0


def test_substrings_of_long_windows(spark):
    """Blocks of more than 255 windows."""
    draw = random.Random(9)
    rows = [(i, " ".join(f"w{draw.randint(0, 10**6)}" for _ in range(585))) for i in range(40)]
    rows += [(100 + i, t) for i, t in rows]
    out = substrings.dedup_substrings(table(spark, rows), window=300)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in out.collect()} == _without_repeats(rows, 300)


def test_hashes_of_runs_depend_on_words_only():
    import pyarrow as pa

    words, _ = substrings.words_of(pa.array(["a b c d e f a b c d e f b a"], pa.large_string()))
    hashes = substrings._Hashes(words)
    import numpy as np

    first = np.arange(0, 9)
    runs = hashes.run(first, first + 5).tolist()
    assert runs[0] == runs[6] and runs[1] == runs[7] or len(set(runs)) == len(runs) - 2


def _classes(rows, ngram=5, threshold=0.8):
    sets = []
    for _, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        sets.append({tuple(w[i : i + ngram]) for i in range(max(1, len(w) - ngram + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    return {tuple(sorted(x)) for x in ids.values()}


@pytest.mark.parametrize("hubs,block", [(3, 256), (1, 8)])
def test_near_classes_against_all_pairs(spark, hubs, block):
    """A large group of near copies whose pairs lie on both sides of the threshold, and small ones."""
    draw = random.Random(4)
    base = [f"w{draw.randint(0, 500)}" for _ in range(160)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(draw.randint(0, 7)):
            words[draw.randrange(len(words))] = f"v{draw.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    for i in range(90, 150):
        rows.append((i, " ".join(f"u{draw.randint(0, 10**6)}" for _ in range(draw.randint(1, 60)))))
    rows += [(150, rows[95][1]), (151, rows[95][1].upper()), (152, "short one"), (153, "Short, one!"), (154, ""), (155, None), (156, "%%% &&&")]
    out = near_dups.near_classes(table(spark, rows), hubs=hubs, block=block).collect()
    found = {}
    for r in out:
        found.setdefault(r.class_id, []).append(r.doc_id)
    assert {tuple(sorted(x)) for x in found.values()} == _classes(rows)
    assert all(r.class_id == min(found[r.class_id]) and r.class_size == len(found[r.class_id]) for r in out)
    assert sum(r.kept for r in out) == len(found)


@pytest.mark.parametrize("hubs,cell", [(3, 1024), (1, 16)])
def test_near_links_against_all_pairs(spark, hubs, cell):
    """Every link counts, in a group larger than the hubs and cells, in small ones and through copies."""
    draw = random.Random(5)
    rows = []
    for n, size in enumerate((80, 7, 2, 1)):
        base = [f"g{n}w{j}" for j in range(150)]
        for _ in range(size):
            words = list(base)
            for _ in range(draw.randint(0, 6)):
                words[draw.randrange(len(words))] = f"v{draw.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows), rows[3][1].upper()), (len(rows) + 1, None), (len(rows) + 2, "only these")]
    texts = {i: tuple(re.findall(r"\w+", (t or "").lower())) for i, t in rows}
    sets = {w: {w[i : i + 5] for i in range(max(1, len(w) - 4))} for w in texts.values() if w}
    links = {w: sum(w != v and 5 * len(s & t) >= 4 * len(s | t) for v, t in sets.items()) for w, s in sets.items()}
    out = near_dups.near_classes(table(spark, rows), hubs=hubs, cell=cell).collect()
    assert {r.doc_id: r.links for r in out} == {i: links.get(w, 0) for i, w in texts.items()}
    assert max(links.values()) > 10 and sum(links.values()) % 2 == 0


def test_near_classes_of_repeated_rows_nulls_and_nothing(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "g h")]
    out = near_dups.near_classes(table(spark, rows)).collect()
    assert sorted((r.class_id, r.class_size) for r in out) == [(1, 3), (1, 3), (1, 3), (2, 1)] and sum(r.kept for r in out) == 2
    assert near_dups.one_per_class(table(spark, rows)).count() == 2
    assert near_dups.near_classes(table(spark, [])).count() == 0


def test_components_of_a_path_and_bands(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    labels = {r.node: r.label for r in near_dups.components(links).collect()}
    assert {labels[i] for i in range(41)} == {0} and labels[101] == 100
    bands, rows = near_dups.choose_bands(0.8, 0.99999, 96)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99999 and bands * rows <= 96
