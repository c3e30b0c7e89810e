"""Recall of the near-dedup stage against all pairs' five-word Jaccard coefficients."""

import numpy as np
import pyarrow as pa

from sparrowmill.llm.simhash import _shingle_sets, across, parities, shared_prefixes, similar, wide
from sparrowmill.llm.texts import unique


def _shingles(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def _jaccard(x, y):
    return len(x & y) / len(x | y)


def _planted(rng):
    """Pairs of texts with one to eight words changed, and a group of more than a prefix's pairs are counted for."""
    rows = []
    for case in range(120):
        n = int(rng.integers(60, 400))
        base = rng.integers(0, 10**6, n).tolist()
        other = list(base)
        for i in rng.choice(n, max(1, round(n * rng.uniform(0.01, 0.026))), replace=False):
            other[i] = int(rng.integers(10**6, 10**7))
        rows += [(2 * case, base), (2 * case + 1, other)]
    line = rng.integers(0, 10**6, 200).tolist()
    for i in range(50):
        rows.append((1000 + i, [*line, *rng.integers(10**6, 10**7, 1 + i % 9).tolist()]))
    return rows


def test_near_duplicates_are_those_of_all_pairs(spark):
    rows = _planted(np.random.default_rng(17))
    sets = [(i, _shingles(w)) for i, w in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = 0
    for k, (i, x) in enumerate(sets):
        for j, y in sets[k + 1 :]:
            if _jaccard(x, y) >= 0.8:
                near += i < 1000 and _jaccard(x, y) < 0.85
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert near >= 15
    got = {r.id: r.component_id for r in similar(spark.createDataFrame([(i, " ".join(map(str, w))) for i, w in rows], "doc_id long, text string")).collect()}
    want = {i: find(i) for i in root}
    print("pairs from 0.8 to 0.85:", near, "texts in a group:", sum(want[i] != i for i in want), "of them found:", sum(want[i] != i and got[i] == want[i] for i in want))
    assert got == want


def test_pairs_of_a_frequent_shingle_are_found(spark):
    """Near copies all of whose shingles many texts have that are not similar, and that go on alike: their first texts are none of the two."""
    rng = np.random.default_rng(12)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 10**7, n)]
    rows, wanted = [], set()
    for case in range(6):
        base = word(60)
        rows += [(1000 * case + i, " ".join(base + word(5))) for i in range(2)]
        wanted.add((1000 * case, 1000 * case + 1))
        for i in range(120):  # three quarters of it, at either end or around the middle
            at = int(rng.integers(0, 16))
            rows.append((1000 * case + 10 + i, " ".join(word(at) + base[at : at + 45] + word(15 - at))))
    texts = dict(rows)
    got = {}
    for r in similar(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.id] = r.component_id
    assert all(_jaccard(_shingles(texts[a].split()), _shingles(texts[b].split())) >= 0.8 for a, b in wanted)
    assert [pair for pair in sorted(wanted) if got[pair[0]] != got[pair[1]]] == []


def test_texts_of_one_frequent_passage_are_no_candidates(spark):
    """Two thirds of each of many texts are one passage: none of their pairs is similar. Those that are go on as candidates."""
    rng = np.random.default_rng(13)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 10**7, n)]
    line = word(100)
    texts = [line + word(60) for _ in range(150)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(1000 + i, " ".join([*t[:150], *word(2), *t[152:]])) for i, t in enumerate(texts[:20])]
    _, stored = unique(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    name = {r.n: r.least_id for r in stored.collect()}
    none = spark.createDataFrame([], "node long, root long")
    found = across(shared_prefixes(stored, 5, 0.8), none, wide(stored, 5, 42), 0.8)
    assert {tuple(sorted((name[r.a], name[r.b]))) for r in found.collect()} == {(i, 1000 + i) for i in range(20)}


def test_parities_differ_in_no_more_bits_than_sets_in_elements():
    rng = np.random.default_rng(14)
    texts = []
    for _ in range(200):
        base = rng.integers(0, 10**6, rng.integers(1, 900))
        other = np.where(rng.random(len(base)) < rng.uniform(0, 0.3), base + 10**6, base)
        texts += [" ".join(map(str, base)), " ".join(map(str, other))]
    row, h = _shingle_sets(pa.array([*texts, None]), 5)
    bits = parities(row, h, len(texts) + 1)
    sets = [set(h[row == i].tolist()) for i in range(len(texts))]
    apart = np.array([np.bitwise_count(bits[i] ^ bits[i + 1]).sum() for i in range(0, len(texts), 2)])
    assert (apart <= [len(sets[i] ^ sets[i + 1]) for i in range(0, len(texts), 2)]).all() and len(set(apart)) > 20 and not bits[-1].any()
