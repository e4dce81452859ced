"""Language, toxicity, neighbours, mixing, pieces, chat and the pipeline."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_pipeline import plain_targets

import corpus_pipeline
from tickertide.llm import ann, chat, language, mixing, pieces_coding, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, score string, spans string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, l, s, "x", "y") for i, t, l, s in rows], DOCS).repartition(2)


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_is_optimal(seed):
    draw = np.random.default_rng(seed)
    for _ in range(30):
        counts = draw.integers(0, 40, size=draw.integers(1, 8))
        scores = draw.normal(size=(counts.sum(), draw.integers(1, 5))).astype(np.float32) * 3
        penalty = float(draw.uniform(0, 5))
        labels = language.viterbi(scores, counts, penalty, size=int(draw.integers(1, 12)))
        at = 0
        for n in counts:
            own, got = scores[at : at + n].astype(float), labels[at : at + n]
            at += n
            if n:
                best = own[0].copy()
                for row in own[1:]:
                    best = np.maximum(best, best.max() - penalty) + row
                value = own[np.arange(n), got].sum() - penalty * (got[1:] != got[:-1]).sum()
                assert value == pytest.approx(best.max(), abs=1e-4)


def test_viterbi_of_many_labels():
    scores = np.zeros((9, 300), np.float32)
    scores[:5, 290] = scores[5:, 140] = 50
    for size in (3, 64):
        assert language.viterbi(scores, np.array([9]), 1.0, size=size).tolist() == [290] * 5 + [140] * 4


def test_language_held_out_accuracy_and_cases(spark, folder):
    docs = spark.read.parquet(folder.replace("0.001", "0.01") + "/documents.parquet")
    model = language.fit(docs)
    out = language.identify(docs, model, columns=["doc_id", "lang"]).filter(language.held_out())
    assert out.filter("lang = lang_pred").count() >= 0.95 * out.filter("lang IS NOT NULL").count()
    odd = [(1, None, None, None), (2, "123 %% ", "en", None), (3, "", None, None), (4, "я не", None, None), (4, "the and of", "q", None)]
    rows = language.identify(table(spark, odd), model, columns=["doc_id"]).collect()
    assert sorted((r.doc_id, r.lang_pred == "und", r.score) for r in rows)[:3] == [(1, True, 0.0), (2, True, 0.0), (3, True, 0.0)]
    assert all(r.lang_pred in model.languages for r in rows if r.doc_id == 4)
    none = language.fit(table(spark, [(1, "a b", None, None)]))
    assert [r.lang_pred for r in language.identify(table(spark, odd[-1:]), none).collect()] == ["und"]
    assert language.identify(table(spark, []), model).count() == 0


def test_language_spans_of_mixed_text(spark):
    draw = random.Random(1)
    words = {"en": ["the", "thing", "with", "that", "other"], "de": ["und", "nicht", "schön", "über", "auch"], "ru": ["и", "он", "привет"]}
    rows = [(i, " ".join(draw.choices(words[k], k=30)), k, None) for i in range(60) for k in words]
    model = language.fit(table(spark, rows))
    text = " ".join(draw.choices(words["en"], k=200) + draw.choices(words["de"], k=50) + draw.choices(words["ru"], k=40))
    (row,) = language.identify(table(spark, [(1, text, None, None)]), model).collect()
    assert [tuple(s) for s in row.spans] == [(0, 200, "en"), (200, 50, "de"), (250, 40, "ru")]
    assert row.lang_pred == "en" and 0 < row.score < 1


def test_toxicity_held_out_and_cases(spark, folder):
    folder = folder.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model, columns=["doc_id"]).filter(toxicity.held_out()).join(labels, "doc_id").toPandas()
    bad, good = (out.score[out.toxic == y].to_numpy() for y in (1, 0))
    assert (bad[:, None] > good[None, :]).mean() > 0.85
    odd = table(spark, [(1, None, None, None), (2, "", None, None), (2, "", None, None), (3, "idiot " * 50_000, None, None)])
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows) and odd.columns[:4] == ["doc_id", "text", "lang", "source"]
    assert toxicity.clean_documents(docs, labels).columns == docs.columns
    one = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert toxicity.score(odd, one).agg(F.max("score")).first()[0] < 1e-6
    assert toxicity.score(table(spark, []), toxicity.fit(docs, labels.limit(0))).count() == 0


def test_neighbours_find_most_and_score_exactly(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(20, 16))
    x = (centres[draw.integers(0, 20, 3000)] + 0.3 * draw.normal(size=(3000, 16))).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(4000, None, 0), (4020, [0.0] * 16, 0), (4040, [float("nan")] * 16, 0), (4060, [1.0], 0), (4080, [None] * 16, 0), (None, [1.0] * 16, 0)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")
    out = ann.neighbours(vectors, cell=500).toPandas()
    d = x.astype(np.float64)
    hit = 0
    for q, g in out.groupby("query_id"):
        scores = d @ d[q]
        scores[q] = -np.inf
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and (g.score.diff().dropna() <= 0).all()
        assert np.allclose(scores[g.vec_id], g.score, atol=1e-9)
        hit += len(set(np.argsort(-scores)[:20]) & set(g.vec_id))
    assert sorted(out.query_id.unique()) == list(range(0, 3000, 20)) and hit >= 0.9 * 20 * 150


def test_neighbours_of_few_equal_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (3, [0.0, 1.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    out = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.neighbours(few).orderBy("rank").collect()]
    assert out == [(0, 1, 2, 0.0), (0, 2, 3, 0.0)]
    assert ann.neighbours(few.limit(0)).count() == 0


def test_hilbert_neighbours_touch():
    grid = np.array([[a, b, c] for a in range(4) for b in range(4) for c in range(4)])
    path = grid[np.argsort(ann.hilbert_keys(grid, 2))]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_mix_meets_targets_and_caps(spark):
    draw = random.Random(2)
    rows = [(i, "w " * draw.randint(0, 60), None, draw.choice(["a", "a", "a", "b", "é", None])) for i in range(800)] + [(9, None, None, "empty"), (10, "w", None, "tiny")]
    out = mixing.mix(table(spark, rows), shard_digits=1).collect()
    assert len(out) == len(rows) and all(r.taken <= 3 * r["size"] for r in out)
    assert all(sum(p.n * p.times for p in r.parts) == r.taken and sum(p.n for p in r.parts) == r["size"] for r in out)
    by = {}
    for r in out:
        x = by.setdefault(r.source, [0, r.source_size, r.target])
        x[0] += r.taken
    total = sum(x[1] for x in by.values())
    assert sum(x[2] for x in by.values()) == pytest.approx(total)
    assert by["tiny"][2] == 3 and by["empty"][:] == [0, 0, 0]
    assert all(abs(taken - target) <= 3 for taken, _, target in by.values())
    again = {(r.doc_id, r.taken) for r in mixing.mix(table(spark, rows).repartition(5), shard_digits=1).collect()}
    assert {(r.doc_id, r.taken) for r in out} == again
    mixed = mixing.mixed_documents(table(spark, rows), shard_digits=1)
    assert mixed.columns == table(spark, []).columns
    assert mixed.agg(F.sum(mixing.n_words("text"))).first()[0] == sum(r.taken for r in out)
    assert mixing.mix(table(spark, [])).count() == 0


def test_mix_keeps_sources_far_below_the_common_block(spark):
    """A common block of 1,000 words: small sources still meet their targets, capped ones exactly."""
    sizes = {"a": 20_000, "b": 20_000, "c": 20_000, "d": 200, "e": 1, "f": 700, "g": 999}
    rows = [(1000 * k + i, "w " * (n // 10 if i < 9 else n - 9 * (n // 10)), None, s) for k, (s, n) in enumerate(sizes.items()) for i in range(10)]
    out = mixing.mix(table(spark, rows), blocks=-(-sum(sizes.values()) // 1000)).collect()
    taken = {s: sum(r.taken for r in out if r.source == s) for s in sizes}
    targets = {r.source: r.target for r in out}
    capped = [s for s in sizes if targets[s] == 3 * sizes[s]]
    assert {"d", "e", "f", "g"} <= set(capped) and all(taken[s] == targets[s] for s in capped)
    assert all(abs(taken[s] - targets[s]) <= sizes[s] / mixing.OWN_BLOCKS * 2 for s in sizes)
    assert all(r.taken <= 3 * r["size"] for r in out)


def test_mix_stage_passes_whole_documents(spark):
    draw = random.Random(8)
    rows = [(i, f"{i}\n\n" + "w \t" * draw.randint(0, 300), None, draw.choice(["a", "b", "c", "d", None])) for i in range(300)]
    rows += [(300, None, None, "a"), (301, "all of it", None, "tiny")]
    words = {i: len((t or "").split()) for i, t, _, _ in rows}
    targets = {r.source: r.target for r in mixing.mix(table(spark, rows)).select("source", "target").distinct().collect()}
    out = corpus_pipeline.mix_sources(spark, table(spark, rows), "").collect()
    texts = {i: t for i, t, _, _ in rows}
    assert all(r.text == texts[r.doc_id] for r in out)
    for s, target in targets.items():
        assert abs(sum(words[r.doc_id] for r in out if r.source == s) - target) <= 302
    assert sum(r.doc_id == 301 for r in out) == 3
    assert max(sum(r.doc_id == i for r in out) for i in words) == 3
    assert corpus_pipeline.mix_sources(spark, table(spark, []), "").count() == 0


def _highest_quotients(sizes, repeat=3):
    """Plain Sainte-Lague: each word goes to the source with the largest target / (2 * seats + 1)."""
    targets = plain_targets(sizes)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    won = {s: repeat * sizes[s] if targets[s] >= repeat * sizes[s] else 0 for s in order}
    free = [s for s in order if targets[s] < repeat * sizes[s]]
    for _ in range(sum(sizes.values()) - sum(won.values())):
        best = max((s for s in free if won[s] < repeat * sizes[s]), key=lambda s: (targets[s] / (2 * won[s] + 1), -order.index(s)))
        won[best] += 1
    return won


def test_mix_stage_deals_words_by_highest_quotients(spark):
    """One-word documents show the quotas; rounded targets 1.5, 3 and 4.5 would take ten words of nine."""
    draw = random.Random(11)
    cases = [{"a": 3, "b": 3, "c": 3}, {"only": 5}, {"a": 40, "b": 1, None: 2}]
    cases += [{f"s{k:02}": draw.choice([1, 2, 7, 30, 90]) for k in range(n)} for n in (5, 17)]
    for sizes in cases:
        rows = [(1000 * k + i, "w", None, s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
        out = corpus_pipeline.mix_sources(spark, table(spark, rows), "").collect()
        assert {s: sum(r.source == s for r in out) for s in sizes} == _highest_quotients(sizes)


def test_pieces_equal_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces_coding.model_bytes(path)
    draw = random.Random(5)
    parts = [" ", "  ", "▁", "a", "the", "\n", "é", "\u0000", "😀", "<s>", "</s>", "<unk>", "\t", "中", "ing", "%%", "\r", "   "]
    texts = [None, "", " ", "  ", "▁", "a ", " a  b ", "x" * 50_000] + ["".join(draw.choices(parts, k=draw.randint(0, 12))) for _ in range(400)]
    docs = table(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    both = pieces_coding.encode(docs, model, columns=["doc_id"], decoded=True, table=50)
    rows = both.collect()
    for r in rows:
        ids = lib.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids) and r.decoded == lib.decode(ids)
    alone = {r.doc_id: r.decoded for r in pieces_coding.decode(both.drop("decoded"), model, ["doc_id"]).collect()}
    assert alone == {r.doc_id: r.decoded for r in rows}
    assert pieces_coding.encode(table(spark, []), model).count() == 0


TURNS = "conv_id bigint, turn bigint, role string, text string, tokens string, place string"


def _windows(spark, rows, **options):
    turns = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS).repartition(3)
    return chat.format_windows(turns, **options)


def test_chat_reads_back_every_turn_once(spark):
    draw = random.Random(6)
    odd = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\|", "\\", "<<||", "", None, "a\nb", "é😀 <|"]
    rows = []
    for conv in range(12):
        for turn in range(draw.randint(1, 40) if conv else 300):
            role = "system" if turn == 0 and conv % 2 else draw.choice(["user", "assistant", None, "we\\ird\n<|role"])
            rows.append((conv, turn, role, draw.choice(odd + ["some words here " * draw.randint(1, 9)])))
    rows += [(None, 1, "assistant", "x"), (50, None, "user", "first"), (50, 1, "assistant", "b"), (50, 1, "assistant", "a"), (50, 1, "assistant", "a"), (51, 3, "system", "only")]
    windows = _windows(spark, rows, budget=60, history=20, stretch=3)
    want = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    for r in chat.digests(windows).collect():
        turns = want.pop(r.conv_id)
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert not want


def test_chat_windows_keep_budget_system_and_history(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", f"word{i} " * 5) for i in range(1, 200)]
    out = _windows(spark, rows, budget=64, history=18, stretch=4).orderBy("first_turn").collect()
    assert all(w.n_tokens <= 64 for w in out) and sum(w.n_turns - w.n_repeated for w in out) == 200
    for before, w in zip(out, out[1:]):
        turns = chat.read_turns(w.text)
        assert turns[0] == ("system", "be kind") and w.n_repeated == 3
        assert turns[1:3] == chat.read_turns(before.text)[-2:]
    big = _windows(spark, [(1, 0, "user", "a " * 500), (1, 1, "assistant", "b")], budget=10).collect()
    assert len(big) == 2 and chat.format_windows(spark.createDataFrame([], TURNS)).count() == 0


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= before
        before = ids
    out = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in out.collect()} <= before and out.columns == ["doc_id", "source", "n_tokens", "ids"]
