"""License scans, filter audit and hard negatives against plain versions, and their defined cases."""

import itertools
import math
import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from tickertide.llm import audit, licenses, negatives, queries

DOCS = "doc_id bigint, text string, lang string, source string, n_words string, spans string, good string, id string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, k, "s", "x", "y", "z", "w") for i, t, k in rows], DOCS).repartition(3)


# ---- licences -------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_places(words):
    out = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return sorted(out)


def plain_chains(words, templates, min_match, max_gap):
    """Longest matches by trying every length, chained by the rules of the docstring."""
    texts = [plain_words(t) for _, t in templates]
    stands = lambda run: any(t[i : i + len(run)] == run for t in texts for i in range(len(t)))
    matches, reach = [], 0
    for first in range(len(words)):
        n = 0
        while first + n < len(words) and stands(words[first : first + n + 1]):
            n += 1
        if n >= min_match and first + n > reach:
            matches.append((first, n))
        reach = max(reach, first + n)
    done, open_ones = [], {}
    for first, n in matches:
        run = words[first : first + n]
        for k, t in enumerate(texts):
            starts = [i for i in range(len(t) - n + 1) if t[i : i + n] == run]
            if not starts:
                continue
            chain = open_ones.get(k)
            if chain:
                front = max(0, chain["end"] - first)
                later = [s for s in starts if s + front >= chain["reached"]]
                if later and front < n and first - chain["end"] <= max_gap:
                    chain.update(end=first + n, reached=min(later) + n, covered=chain["covered"] + n - front)
                    continue
                if first + n <= chain["end"]:
                    continue
                done.append(chain)
            open_ones[k] = {"template": k, "first": first, "end": first + n, "reached": min(starts) + n, "covered": n}
    return done + list(open_ones.values())


def scanned(text, templates=licenses.TEMPLATES, **kw):
    scanner = licenses.Scanner(templates, licenses.PHRASES, **kw)
    counts, places, chains = scanner.scan(*licenses._texts(pa.array([text], pa.large_string())))
    return int(counts[0]), sorted(places.get(0, [])), chains.get(0, [])


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics_by_trying_every_length(seed):
    draw = random.Random(seed)
    texts = [[draw.randrange(4) for _ in range(draw.randrange(2, 25))] for _ in range(4)]
    automaton = licenses.Automaton(texts)
    words = [draw.randrange(4) for _ in range(80)]
    for end, (state, length) in enumerate(automaton.statistics(words), 1):
        stands = lambda n: any(t[i : i + n] == words[end - n : end] for t in texts for i in range(len(t) - n + 1))
        assert length == max(n for n in range(end + 1) if stands(n))
        if length:
            run = words[end - length : end]
            where = {(k, i + length) for k, t in enumerate(texts) for i in range(len(t)) if t[i : i + length] == run}
            assert automaton.places[state] == where


@pytest.mark.parametrize("seed", range(8))
def test_phrases_and_chains_equal_plain_search(seed):
    draw = random.Random(seed)
    templates = [("a", "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9"), ("b", "w3 w4 w5 w1 w2 w3 w4 w0 w0 w1 w2"), ("c", "w5 w6 the mit license w1 w2 w3")]
    words = [w for _, t in templates for w in t.split()] + ["cc", "by", "é", "apache", "license", "Ω7"]
    for _ in range(25):
        out = []
        while len(out) < 120:
            if draw.random() < 0.5:
                t = draw.choice(templates)[1].split()
                at = draw.randrange(len(t))
                out += t[at : at + draw.randrange(1, 9)]
            elif draw.random() < 0.4:
                out += draw.choice(["CC BY", "GNU General Public License", "Apache License", "MIT License"]).split()
            else:
                out.append(draw.choice(words))
        text = "".join(w + draw.choice([" ", ", ", "\n", "-", "\x00"]) for w in out)
        n, places, chains = scanned(text, templates, min_match=3, max_gap=4)
        plain = plain_words(text)
        assert n == len(plain) and places == plain_places(plain)
        want = plain_chains(plain, templates, 3, 4)
        assert sorted((c.template, c.first, c.end, c.covered) for c in chains) == sorted((c["template"], c["first"], c["end"], c["covered"]) for c in want)


def test_chunks_of_a_long_text_give_the_same(monkeypatch):
    text = ("é" * 5000 + " gnu General\tpublic-license " + licenses.TEMPLATES[1][1] + " x" * 40 + "cc by\n") * 12
    whole = scanned(text)
    for size in (7, 64, 1000):
        monkeypatch.setattr(licenses, "CHUNK", size)
        assert scanned(text) == whole
    assert len([1 for _, label in whole[1] if label == "gpl"]) == 12 and max(c.covered for c in whole[2]) == len(plain_words(licenses.TEMPLATES[1][1]))


def test_words_longer_than_the_compared_bytes():
    long = "x" * 30
    templates = [("a", f"{long}a {long}b c d"), ("b", "p q r s")]
    with pytest.raises(ValueError):
        licenses.Scanner(templates, {})
    scanner = licenses.Scanner([("a", f"{long}a c d e")], {})
    for last, want in (("a", 4), ("b", 0)):
        chains = scanner.scan(*licenses._texts(pa.array([f"{long}{last} c d e"], pa.large_string())))[2]
        assert sum(c.covered for c in chains.get(0, [])) == want


def test_license_query_on_planted_rows(spark, tmp_path):
    notice = licenses.TEMPLATES[4][1]
    changed = notice.replace("published by the Free", "put out by the Free")
    rows = [
        (1, None, None), (2, "", "en"), (3, "Gnu\tGENERAL public.license; gnu general public license", "en"), (4, notice, "de"), (4, notice, "de"),
        (5, "gnu general public licenses, açapache license, mit  license2", "en"), (6, "words " * 40 + changed, "en"),
        (7, "Licensed under CC BY-NC 4.0.", None), (8, "the " * 200_000 + "MIT License", "en"), (None, "apache license", "en"), (9, "÷ 12 _ x", "en"),
    ]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(queries.QUERIES["op11_license_scans"](spark, str(tmp_path)).collect(), key=str)
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, text, _ in rows:
        plain = plain_words(text)
        places = plain_places(plain)
        r = by_id[i]
        starts = [p for p, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(plain), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({k for _, k in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert (by_id[1].score, by_id[9].score, by_id[1].labels) == (0.0, 0.0, "")
    assert by_id[7].labels == "cc-by,cc-by-nc-4.0" and by_id[4].labels == "gpl" and by_id[6].n_spans == 1
    part = licenses.scan_licenses(documents(spark, [(1, "released under the mit", "x")]), columns=["doc_id"]).first()
    assert part.score == 0.8 and part.places == [] and [s.label for s in part.spans] == ["mit"]
    assert licenses.scan_licenses(documents(spark, [])).count() == 0


# ---- filter audit ------------------------------------------------------------------

def plain_failures(rows):
    out = []
    for i, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words))
        failed += "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        out.append(failed + "E" * (i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)))
    return out


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {k or "" for _, _, k in rows}:
        docs = [(i, f) for (i, _, k), f in zip(rows, plain_failures(rows)) if (k or "") == part]
        shares = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                failing = [d for d in docs if x in d[1]]
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(f == x for _, f in docs),
                                          sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                shares[x] += len(gone)
        for key, row in out.items():
            if key[0] == part:
                row.append(shares[key[1][key[2] - 1]])
    return out


def test_audit_equals_plain_chains(spark):
    draw = random.Random(3)
    texts = [None, "", " \t", "A B", "x #", " ".join(f"w{i}" for i in range(100)), "W " * 150, " ".join(f"W{i}" for i in range(99)), "é" * 30, "wörd x | y"]
    rows = [(draw.randrange(40), draw.choice(texts), draw.choice(["en", "de", None, ""])) for _ in range(120)]
    rows += [(7, "same", "en"), (7, "same", "en"), (7, "same", "de"), (9, "same", "en"), (None, "same", "en"), (None, "same", None), (3, "long " * 100_000, "fr")]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1])) for i in range(30)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = audit.audit(documents(spark, rows), marks).collect()
    want = plain_audit(rows, labels)
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in got} == want and len(got) == len(want)
    assert audit.audit(documents(spark, []), marks).count() == 0
    assert audit.audit(documents(spark, rows[:3]), marks.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


@pytest.mark.parametrize("n", range(1, 6))
def test_least_squares_give_shapley_values(n):
    draw = random.Random(n)
    game = [0] + [draw.randrange(-50, 1000) for _ in range((1 << n) - 1)]
    want = [Fraction(0)] * n
    for i in range(n):
        for c in range(1 << n):
            if not c >> i & 1:
                size = c.bit_count()
                want[i] += Fraction(math.factorial(size) * math.factorial(n - size - 1), math.factorial(n)) * (game[c | 1 << i] - game[c])
    assert audit.shapley_values(game) == want


def test_audit_counts_copies_before_the_shuffle(spark):
    rows = [(i, "same text" if i % 2 else f"text {i}", "en") for i in range(4000)]
    marks = spark.createDataFrame([(1, 1, 1)], "doc_id bigint, quality int, toxic int")
    sets = {r.failed: (r.n, r.good, r.toxic) for r in audit.failure_sets(documents(spark, rows), marks).collect() if r.n}
    a = 1
    assert sets == {a: (2001, 1, 1), a | 16: (1999, 0, 0)}


# ---- hard negatives ----------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int, score string, block string, anchor_id string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, k, "a", "b", "c") for i, v, k in rows], VECTORS).repartition(3)


def plain_negatives(rows, every, k, m, window):
    found = {}
    data = {}
    for i, v, label in sorted((r for r in rows if r[0] is not None and r[2] is not None and r[1] is not None), key=lambda r: (r[0], r[2], [float(x or 0) for x in r[1]])):
        if all(x is not None and math.isfinite(x) for x in v):
            data.setdefault(i, (label, [math.floor(256 * float(np.float32(x))) for x in v]))
    for a, (label, v) in data.items():
        if a % every:
            continue
        score = {j: sum(x * y for x, y in zip(v, w)) for j, (_, w) in data.items() if j != a}
        ordered = sorted(score, key=lambda j: (-score[j], j))
        for p in [j for j in ordered if data[j][0] == label][:k]:
            fits = [j for j in ordered if data[j][0] != label and window[0] * score[p] <= 100 * score[j] <= window[1] * score[p]]
            for rank, j in enumerate(fits[:m], 1):
                found[a, p, rank] = (j, score[p], score[j])
    return found


@pytest.mark.parametrize("seed,block,stretch,spread", [(1, 16384, 16384, 0.0), (2, 40, 3, 0.3), (3, 7, 1, 2.0)])
def test_negatives_equal_plain_search(spark, seed, block, stretch, spread):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, 9)) * spread
    rows = [(i, [float(x) for x in np.float32(centres[i % 6] + draw.normal(size=9) * 0.2)], int(draw.integers(4))) for i in range(300)]
    rows += [(300 + i, rows[0][1], i % 3) for i in range(30)] + [(400, [0.0] * 9, 1), (410, [0.0] * 9, 2)]  # ties, zeros
    got = negatives.mine_negatives(negatives.integer_vectors(vectors(spark, rows), 256), 10, 5, 5, (80, 100), block, stretch).collect()
    assert {(r.anchor_id, r.positive_id, r.rank): (r.negative_id, r.positive_score, r.negative_score) for r in got} == plain_negatives(rows, 10, 5, 5, (80, 100))
    assert len(got) > 100


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (0, [0.5, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.1], 2), (3, None, 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1)]
    rows += [(6, [inf, 1.0], 2), (8, [0.9, 0.1], None), (None, [0.9, 0.1], 2), (9, [0.9], 2), (10, [], 2), (11, [0.9, 0.1], 2), (12, [-9.0, 0.0], 2)]
    got = negatives.mine_negatives(negatives.integer_vectors(vectors(spark, rows), 256), 100).collect()
    assert [(r.anchor_id, r.positive_id, r.rank, r.negative_id) for r in got] == [(0, 1, 1, 2), (0, 1, 2, 11)]
    for few in ([], rows[4:5], [(100, [], 1)], rows[:1]):
        assert negatives.mine_negatives(negatives.integer_vectors(vectors(spark, few), 256)).count() == 0
    with pytest.raises(ValueError):
        negatives.mine_negatives(negatives.integer_vectors(vectors(spark, [(0, [1e30], 1)]), 256))


def test_large_components_are_summed_in_integers(spark):
    rows = [(0, [2.0**21, 1.0], 1), (1, [2.0**21, 0.5], 1), (2, [2.0**21, 0.25], 2), (3, [2.0**21, -1.0], 2)]
    got = negatives.mine_negatives(negatives.integer_vectors(vectors(spark, rows), 256), 100).collect()
    assert {(r.anchor_id, r.positive_id, r.rank): (r.negative_id, r.positive_score, r.negative_score) for r in got} == plain_negatives(rows, 100, 5, 5, (80, 100))


def test_scan_gives_up_rows_before_the_last_dimension():
    draw = np.random.default_rng(5)
    columns = draw.integers(-100, 100, size=(40, 500)).astype(float)
    anchor = (draw.normal(size=40) * 2.0 ** -np.arange(40) * 1000).round()
    looked = []
    rule = negatives.nearest_rule(5)

    def shrink(lower, upper, alive):
        looked.append(len(lower))
        return rule(lower, upper, alive)

    rows, scores = negatives.vertical_scan(columns, columns.min(1), columns.max(1), anchor, np.ones(500, bool), shrink)
    assert set(np.argsort(-(anchor @ columns), kind="stable")[:5]) <= set(rows) and (scores == (anchor @ columns)[rows]).all()
    assert len(rows) < 50 and looked[2] < 500
