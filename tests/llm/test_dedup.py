"""Exact dedup, SimHash near-dedup and removal of repeated strings, against brute force."""

import collections
import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import exact_dedup, simhash, suffix_dedup
from ledgerlens.llm.suffix_dedup import Run, common, front_coded, merge

SCHEMA = "doc_id long, text string, digest string, key string, fp int, id string, chunk string"


def docs(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "y", 1, "z", None) for i, t in rows], SCHEMA)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "ab"), (6, "a  b"), (6, "a  b"), (7, "ab "), (None, "ab"), (None, None), (8, "é x"), (9, "éx"), (10, "w" * 5000)]


def test_exact_dedup_brute(spark):
    groups = collections.defaultdict(list)
    for i, t in EDGES:
        groups[(t or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})].append((-len(t or ""), i is None, i))
    got = collected(exact_dedup.exact_dedup(docs(spark, EDGES)))
    want = []
    for text, members in groups.items():
        first = True
        for m in sorted(members, key=lambda m: (m[0], m[1], m[2] or 0)):
            want.append((m[2], min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2], len(members), first, hashlib.sha256(text.encode()).hexdigest()))
            first = False
    assert got == sorted(want, key=repr)


def test_exact_dedup_survivors(spark):
    d = docs(spark, EDGES)
    kept = exact_dedup.survivors(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(3, " \t\n"), (6, "a  b"), (7, "ab "), (8, "é x"), (10, "w" * 5000)])
    assert exact_dedup.exact_dedup(d.limit(0)).count() == 0 and exact_dedup.survivors(d.limit(0)).count() == 0


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["a", "B", "É", "c d", "　"]) for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(100, None), (101, " \n"), (102, "one"), (103, "One two"), (104, "x " * 40000)]
    got = {r.doc_id: r.fingerprint for r in simhash.near_dedup(docs(spark, rows)).collect()}
    assert got == {i: f"{brute_fingerprint(t):016x}" for i, t in rows}
    # the built-in hash is the same function
    assert spark.sql("SELECT xxhash64('a b c')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_links_find_every_pair(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(25):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(rng.randint(0, 6)):
            for b in rng.sample(range(64), rng.randint(1, 3)):
                f ^= 1 << b
            fps.add(f)
    fps |= {0, 1 << 63, 3 << 62, (1 << 64) - 1}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    parent = {f: f for f in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in signed:
        for b in signed:
            if (a ^ b) % (1 << 64) and bin((a ^ b) % (1 << 64)).count("1") <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame)).collect()}
    assert {f: roots.get(f, f) for f in signed} == {f: root(f) for f in signed}


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)], "u long, v long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}
    assert simhash.components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [0, simhash.BROADCAST_ROWS])
def test_components_of_stars(spark, monkeypatch, broadcast):
    """Stars around their least, their greatest and a middle node, of which one holds most edges; a bridge; a path."""
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", broadcast)
    edges = [(i, 0) for i in range(1, 3000)] + [(9000, i) for i in range(5000, 6500)]
    edges += [(max(i, 7500), min(i, 7500)) for i in range(7000, 8000) if i != 7500] + [(9000, 2999), (20001, 20000), (20002, 20001)]
    rooted = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in [*range(3000), *range(5000, 6500), 9000]} | {i: 7000 for i in range(7000, 8000)} | {i: 20000 for i in range(20000, 20003)}
    assert rooted == want


def test_near_dedup_groups(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base), (3, base), (4, base.upper().lower()), (9, "something else entirely " * 30), (None, base), (7, None), (8, "")]
    got = {r.doc_id: r.component_id for r in simhash.near_dedup(docs(spark, rows)).collect()}
    assert got[5] == got[4] == got[None] == 3 and got[9] == 9 and got[7] == got[8] == 7
    assert sorted(r.doc_id for r in simhash.survivors(docs(spark, rows + [(3, base)])).collect()) == [3, 7, 9]
    assert simhash.near_dedup(docs(spark, rows).limit(0)).count() == 0


def brute_survivors(rows):
    """The rows that stay, by comparing every pair: linked fingerprints or five-word similarity of 0.8 and more."""
    runs = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        runs.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    prints, parent = [brute_fingerprint(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(runs[i] & runs[j])
            if runs[i] == runs[j] or shared >= 0.8 * (len(runs[i]) + len(runs[j]) - shared) or bin(prints[i] ^ prints[j]).count("1") <= 2:
                parent[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[root(i)].append((d is None, d))
    return sorted((min(g)[1] for g in groups.values()), key=str)


def test_survivors_against_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))
    vocabulary = [word() for _ in range(600)]
    rows = []
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 400))]
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            other, share = list(base), rng.choice([0.004, 0.01, 0.018, 0.03, 0.06])
            for _ in range(max(1, int(share * len(base)))):
                other[rng.randrange(len(other))] = word()
            rows.append(" ".join(other) if rng.random() < 0.8 else " ".join(other).upper())
    rows += ["one", "One", "one two", "one two three four", "a b c d e", "x y " * 50, "x y " * 60, None, "", " \n", "é " * 30]
    rng.shuffle(rows)
    rows = [(i if rng.random() < 0.95 else None, t) for i, t in enumerate(rows)]
    frame = docs(spark, rows + [(rows[0][0], rows[0][1])]).repartition(5)
    got = simhash.survivors(frame)
    assert got.columns == frame.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == brute_survivors(rows)


def test_candidates_of_a_large_group(spark):
    """Near copies of one text by the hundred: all are linked though no variant gathers more than a few of them."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    rows = []
    for i in range(300):
        other = list(base)
        for _ in range(rng.randint(1, 4)):
            other[rng.randrange(300)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(other)))
    assert [r.doc_id for r in simhash.survivors(docs(spark, rows)).collect()] == [0]

def test_pairs_alike_within_a_looser_group(spark):
    """Texts below 0.8 to all others of their group but one are found, whichever texts stand for the group."""
    rng = random.Random(21)
    word = lambda: f"z{rng.randrange(10**7)}"
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    rows = []
    for _ in range(150):
        one = list(base)
        at = rng.randrange(210)
        one[at : at + 90] = [word() for _ in range(90)]
        rows.append(" ".join(one))
        other, at = list(one), rng.randrange(270)
        other[at : at + 28] = [word() for _ in range(min(28, 300 - at))]
        rows.append(" ".join(other))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want = brute_survivors(rows)
    assert 100 < len(want) < 200
    assert sorted((r.doc_id for r in simhash.survivors(docs(spark, rows)).collect()), key=str) == want


def test_a_shingle_of_many_texts_is_cut_into_blocks(spark, monkeypatch):
    """With as many blocks as texts the pairs are those of one block."""
    monkeypatch.setattr(simhash, "BLOCK", 1)
    rng = random.Random(23)
    word = lambda: f"z{rng.randrange(10**7)}"
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for _ in range(25):
        one = base[:80] + [word() for _ in range(40)]
        rows += [" ".join(one), " ".join(one[:110] + [word() for _ in range(6)])]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want = brute_survivors(rows)
    assert len(want) < 40
    assert sorted((r.doc_id for r in simhash.survivors(docs(spark, rows)).collect()), key=str) == want


def test_common_shingles_are_counted_packed(spark, monkeypatch):
    """The sample's shingles leave the workers as a row a part and HELD hashes, not one each; counts are those of brute force."""
    monkeypatch.setattr(simhash, "HELD", 1000)
    rng = random.Random(24)
    texts = [" ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(1, 300))) for _ in range(60)] + ["", None, " ".join(f"x{i}" for i in range(3000)), "a a a a a a a"] + ["b c"] * 300
    sets = [simhash.shingles((t or "").lower().encode().split(), simhash.WORDS) for t in texts]
    want = collections.Counter(int(h) for s in sets for h in s)
    packed = list(simhash.counted(iter(sets), 16))
    assert sum(map(len, sets)) / len(packed) > 400 and max(map(len, packed)) <= 16
    assert sorted(sum(len(simhash.unpack_sorted(h)) for _, h, _ in p) for p in packed)[-2] <= 1000  # one text alone has more
    got = {}
    for part in range(16):
        rows = [(h, c) for p in packed for at, h, c in p if at == part]
        found, times = simhash.summed(rows)
        got |= dict(zip(found.tolist(), times.tolist()))
    assert got == want and want[int(simhash.shingles([b"b", b"c"], simhash.WORDS)[0])] == 300
    assert list(simhash.counted(iter(sets[:0]), 16)) == list(simhash.counted([simhash.shingles([], 5)], 16)) == []
    found, times = simhash.common_shingles(docs(spark, list(enumerate(texts))).repartition(3), "text")
    assert dict(zip(found.tolist(), times.tolist())) == {h: n for h, n in want.items() if n >= simhash.OFTEN}
    assert [len(x) for x in simhash.common_shingles(docs(spark, [(1, None)]), "text")] == [0, 0]


def test_one_passage_changed_added_or_dropped(spark):
    rng = random.Random(22)
    word = lambda: f"z{rng.randrange(10**7)}"
    rows = []
    for k in range(90):
        n = rng.randint(60, 400)
        base = [word() for _ in range(n)]
        share = 0.79 + 0.001 * k  # the similarity, about
        at, kind = rng.randrange(n // 2), k % 3
        if kind == 0:
            size = max(1, int(n * (1 - share) / (1 + share)) - 4)
            other = base[:at] + [word() for _ in range(size)] + base[at + size :]
        elif kind == 1:
            other = base[:at] + [word() for _ in range(max(1, int(n / share - n) - 4))] + base[at:]
        else:
            other = base[:at] + base[at + max(1, int(n * (1 - share)) - 4) :]
        rows += [" ".join(base), " ".join(other)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want = brute_survivors(rows)
    assert 90 <= len(want) < 150
    assert sorted((r.doc_id for r in simhash.survivors(docs(spark, rows)).collect()), key=str) == want


def brute_removed(rows, length):
    seen = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, bytes(x for x, g in zip(b, gone) if not g), len(b), sum(gone), spans))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_brute(spark, seed):
    rng = random.Random(seed)
    rnd = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    base = [rnd(rng.randint(0, 900)) for _ in range(20)]
    rows = [(i, rng.choice(base)) for i in range(12)]
    for i in range(20, 70):
        t = rnd(rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(base)
            a = rng.randint(0, len(s))
            t += s[a : a + rng.choice([150, 199, 200, 201, 250, 400])] + rnd(rng.randint(0, 60))
        rows.append((i, t))
    rows += [(200, None), (201, ""), (202, "a" * 1000), (203, "ab" * 300), (204, "é" * 350), (205, rnd(250) * 3), (206, "x" * 199), (207, "y" * 200), (208, "z" * 201), (None, base[0]), (209, rnd(30000) + base[1] * 2)]
    got = sorted(((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs(spark, rows)).collect()), key=repr)
    assert got == brute_removed(rows, 200)


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.remove_repeats(docs(spark, EDGES).limit(0)).count() == 0


def test_loser_tree_merges_front_coded_runs():
    rng = random.Random(9)
    runs, every = [], []
    for source in range(5):
        rows = sorted((bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))), b"l", k, False) for k in range(rng.randint(1, 40)))
        every += [r[0] for r in rows]
        runs.append(Run(source, front_coded(rows)))
    got = list(merge(runs))
    assert [g[1] for g in got] == sorted(every)
    assert all(g[0] == common(a[1], g[1]) for a, g in zip(got, got[1:]))


def test_queries_over_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for q in (exact_dedup.query, simhash.query, suffix_dedup.query):
        df = q(spark, sf)
        assert df.count() == n and df.select(F.countDistinct("doc_id")).first()[0] == n
