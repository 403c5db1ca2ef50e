"""Mixing, exact top-k search and the pipeline, against brute force."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, exact_dedup, mixing, quality, simhash, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, h string, s string, passes int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", "z", 1) for i, t, s in rows], SCHEMA)


def brute_mix(rows):
    size = lambda t: len((t or "").replace("\x0b", " ").replace("\x0c", " ").encode().split())
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, target, free = sum(sizes.values()), {}, set(sizes)
    while free:
        left = total - sum(target.values())
        level = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if level[s] > 3 * sizes[s]}
        target |= {s: 3.0 * sizes[s] for s in over} if over else level
        free -= over or free
    return sizes, target


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 50), rng.choice(["a", "b", "c", "d", None])) for i in range(800)]
    rows += [(1000 + i, "v " * 20, "huge") for i in range(1500)] + [(9000, None, "empty"), (9001, "", "empty"), (9002, "one two", "tiny"), (None, "null id", "a"), (None, "other null", "a"), (5, "twice", "b")]
    sizes, target = brute_mix(rows)
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 50, (s, taken[s], target[s])
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs(spark, rows).repartition(7)).collect()))
    times = {(r.doc_id, r.source): r.times for r in got if r.doc_id is not None and r.doc_id >= 9000 or r.source == "huge"}
    blended = Counter((r.doc_id, r.source) for r in mixing.blend(docs(spark, rows)).collect())
    assert all(blended[k] == n for k, n in times.items())
    assert mixing.mix(docs(spark, rows).limit(0)).count() == 0 and mixing.blend(docs(spark, rows).limit(0)).count() == 0


def brute_top(rows, k, every):
    vs = [(i, [__import__("math").floor(1024 * c) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and abs(c) < float("inf") for c in v)]
    out = set()
    for q, qv in {(i, tuple(v)) for i, v in vs if i % every == 0}:
        scores = sorted({(-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(qv, v)))), i) for i, v in vs if i != q and len(v) == len(qv)})
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)}
    return out


def test_top_k(spark):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)]) for i in range(1500)]
    rows += [(2000 + i, rows[i][1]) for i in range(50)]  # ties
    rows += [(3000, None), (3001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (3002, [float("nan")] * 6), (3003, [float("inf")] * 6), (3100, [0.0] * 6), (3200, [1.0, 2.0]), (3201, [1.0, 2.0]), (None, [1.0] * 6), (3300, []), (3301, []), (3004, [1e15] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, id int, v int").repartition(3)
    got = {tuple(r) for r in topk.top_k(df).collect()}
    assert got == brute_top(rows, 10, 100)
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.filter("vec_id = 100")).count() == 0


def test_top_k_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(400)]
    monkeypatch.setattr(topk, "BLOCK_BYTES", 200)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(df, 3, 20).collect()} == brute_top(rows, 3, 20)


def test_top_k_of_repeated_rows(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    rows += [(7, [9.0, 9.0, 9.0, 9.0])] * 60 + [(8, [-9.0, -9.0, -9.0, -9.0])] * 60 + [(100, rows[100][1])] * 15
    rows += [(9, [8.0 + j, 9.0, 9.0, 9.0]) for j in range(3)] * 20
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "vec_id long, embedding array<double>").coalesce(1)
        assert {tuple(r) for r in topk.top_k(df).collect()} == brute_top(rows, 10, 100)


def test_top_k_holds_a_bounded_part_of_the_scores(spark, monkeypatch):
    import tracemalloc

    import numpy as np

    x = np.random.default_rng(5).normal(size=(10_000, 8))
    x[::50] *= 30  # beyond single precision
    x[7_000:7_400] = x[:400]  # ties
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").coalesce(1)
    tasks, put = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, *a, **b: tasks.append((self, run)) or put(self, run, *a, **b))
    topk.top_k(df, 3, 4)
    (source, run), = tasks
    batches = source.toArrow().combine_chunks().to_batches()
    tracemalloc.start()
    found = [r for b in run(iter(batches)) for r in zip(*b.to_pydict().values())]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    v = np.floor(x * 1024)
    scores = v[::4] @ v.T  # 2,500 x 10,000: 200 MB
    scores[np.arange(2_500), np.arange(0, 10_000, 4)] = -np.inf
    best = np.argsort(-scores, axis=1, kind="stable")[:, :3]
    assert set(found) == {(4 * q, int(i), int(scores[q, i])) for q in range(2_500) for i in best[q]}
    assert peak < 50e6, peak


def test_top_k_components_beyond_a_long(spark):
    xs = [0.1, -0.1, 0.0, 1e15, 1e16, -1e16, 1e300, -1e300, 1.7e308]
    rows = spark.createDataFrame([(i, [c]) for i, c in enumerate(xs)] + [(90, [None]), (91, [float("nan")]), (92, [float("-inf")])], "vec_id long, embedding array<double>")
    ids, got = topk._by_width(topk.components(rows).toArrow().to_batches())[1]
    assert dict(zip(ids.tolist(), got[:, 0].tolist())) == {r.id: r.v[0] for r in topk.vectors(rows).collect()}


def test_cover_tree_covers():
    import numpy as np

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.1, (400, 3)) for c in (0, 5, 9)])
    tree = topk.cover_tree(x)
    assert tree.children and sorted(np.concatenate([c.points for c in tree.children])) == list(range(len(x)))
    stack = [tree]
    while stack:
        n = stack.pop()
        assert np.sqrt(((x[n.points] - n.centre) ** 2).sum(axis=1)).max() <= n.radius + 1e-9
        stack += n.children


def _corpus(rng):
    rows, labels = [], []
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    for i in range(240):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(30, 120))).capitalize() + "."
        good = i % 6 != 0
        rows.append((i, text if good else " ".join(w.upper() + "!!" for w in text.split()), f"s{i % 4}"))
        labels.append((i, int(good), 0))
    rows += [(500 + i, rows[i + 1][1] + "\n", "s1") for i in range(0, 40, 2)]  # copies but for white space
    return rows, labels


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    rows, labels = _corpus(random.Random(7))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    source = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    source.write.parquet(str(tmp_path / "documents.parquet"))
    sf, at = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    lab = spark.read.parquet(f"{sf}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, sf)
        before = at.collect()
        if name == "quality_classifier":
            good = {r.doc_id for r in quality.classify(at, lab).collect() if r.predicted}
            assert {r.doc_id for r in out.collect()} == good and {i for i, q, _ in labels if q} <= good and not {i for i, q, _ in labels if not q} & good
        elif name == "exact_dedup":
            best = {}
            for r in before:
                key = "".join(r.text.split())
                best[key] = min(best.get(key, (0, 1 << 60)), (-len(r.text), r.doc_id))
            assert sorted(r.doc_id for r in out.collect()) == sorted(b[1] for b in best.values())
        elif name == "simhash_near_dedup":
            groups = {r.doc_id: r.component_id for r in simhash.near_dedup(at).collect()}
            assert sorted(r.doc_id for r in out.collect()) == sorted(set(groups.values()))
        elif name == "mix_sources":
            times = Counter({r.doc_id: r.times for r in mixing.mix(at).collect()})
            assert Counter(r.doc_id for r in out.collect()) == +times
        else:
            texts = {r.doc_id: r.text for r in before}
            tok = bpe.tokenizer(bpe.default_vocabulary())
            got = out.collect()
            assert len(got) == len(before) and all(r.round_trip and len(r.ids) == r.n_tokens and tok.decode(__import__("numpy").array(r.ids, "<u4").tobytes()) == texts[r.doc_id] for r in got)
        if name != "byte_bpe":
            assert out.columns == source.columns
            out.write.parquet(str(tmp_path / name))
            at = spark.read.parquet(str(tmp_path / name))
        kept.append(out.count())
    whole = corpus_pipeline.run(spark, sf)
    digest = lambda df: sorted(hashlib.md5(str((r.doc_id, r.ids)).encode()).hexdigest() for r in df.collect())
    assert digest(whole) == digest(out) and len(kept) == 5
    assert exact_dedup.survivors(at.limit(0)).count() == 0


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_oracle_names():
    from ledgerlens.llm import queries

    assert {f"op{n}" for n in range(1, 11)} | {"pipeline"} == {q.split("_")[0] for q in queries.queries()}
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert F is not None
