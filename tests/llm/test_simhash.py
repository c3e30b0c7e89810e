import re

import numpy as np
import pytest
import xxhash

from sparrowmill.llm.components import components
from sparrowmill.llm.simhash import deduplicate, links, near_duplicates, op4_simhash, similar

SF = "/root/testdata/sf0.001"


def fingerprint(text):
    text = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(fps):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_op4_matches_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {i: fingerprint(t) for i, t in texts.items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op4_simhash(spark, SF).collect()}
    assert {i: x[0] for i, x in got.items()} == {i: f"{x:016x}" for i, x in want.items()}
    assert {i: x[1] for i, x in got.items()} == closure(want)


def _joined(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def _bits(a, b):
    return bin((a ^ b) & (2**64 - 1)).count("1")


def _noisy(rng, base, n, most):
    out = set()
    while len(out) < n:
        x = base & (2**64 - 1)
        for bit in rng.integers(0, 64, rng.integers(1, most + 1)):
            x ^= 1 << int(bit)
        out.add(x - 2**64 if x >= 2**63 else x)
    return out


@pytest.mark.parametrize("distance", [1, 3, 5])
def test_links_join_what_all_pairs_join(spark, distance):
    rng = np.random.default_rng(distance)
    base = [int(x) for x in rng.integers(-(2**63), 2**63, 30)]
    fps = sorted({0, -1, 1}.union(*({b} | _noisy(rng, b, 6, 5) for b in base)))
    got = [tuple(r) for r in links(spark.createDataFrame([(x,) for x in fps], "fp long"), distance).collect()]
    assert all(a != b and _bits(a, b) <= distance for a, b in got)
    assert _joined(got) == _joined((a, b) for a in fps for b in fps if a < b and _bits(a, b) <= distance)


@pytest.mark.parametrize("most", [2, 4])
def test_a_large_group_of_near_copies_gives_few_links(spark, most):
    rng = np.random.default_rng(most)
    fps = sorted(_noisy(rng, 0x1234567890ABCDEF, 1200, most) | {int(x) for x in rng.integers(-(2**63), 2**63, 300)})
    got = [tuple(r) for r in links(spark.createDataFrame([(x,) for x in fps], "fp long"), 3).collect()]
    every = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if _bits(a, b) <= 3]
    assert all(_bits(a, b) <= 3 for a, b in got) and _joined(got) == _joined(every)
    print("all pairs:", len(every), "links:", len(got))
    assert len(got) < 64 * len(fps) and (most > 2 or len(got) < len(every) / 2)


def test_components_that_do_not_settle_are_an_error(spark):
    with pytest.raises(RuntimeError, match="settle"):
        components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"), most_rounds=2)


def test_components_of_long_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (200, 199), (199, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {199: 199, 200: 199}


def test_odd_inputs(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, " \t", "z"), (4, "one two", None), (4, "one two", None), (None, "one two", "q"), (5, "w " * 50_000, "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.id, r.component_id) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (None, 4), (5, 5)], key=str)
    kept = deduplicate(df, near_duplicates(df))
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 4, 5]
    assert near_duplicates(df.limit(0)).count() == 0


def test_similar_verifies_and_groups(spark):
    rng = np.random.default_rng(4)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 9000, n)]
    base = word(400)
    rows = [(1, base), (2, base), (3, base[:200] + ["new"] + base[201:]), (4, base[:60] + word(340)), (5, word(400)), (6, [])]
    df = spark.createDataFrame([(i, " ".join(w), "x") for i, w in rows] + [(7, None, "x")], "doc_id long, text string, t string")
    got = {r.id: r.component_id for r in similar(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6}
    assert sorted(r.doc_id for r in deduplicate(df, similar(df)).collect()) == [1, 4, 5, 6]
    assert similar(df.limit(0)).count() == 0
