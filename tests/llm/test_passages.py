import itertools

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sparrowmill.llm.passages import GAP, SEED, align, align_all, chains, op3_passages, passages, plain_chains, seeds, widen, without_passages


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=9))
def test_the_best_chain_is_the_best_of_all(points):
    points = sorted(set(points))

    def value(path):
        return SEED * len(path) - GAP * sum((c - a) + (d - b) for (a, b), (c, d) in zip(path, path[1:]))

    best = max(value(p) for n in range(1, len(points) + 1) for p in itertools.combinations(points, n) if all(a < c and b < d for (a, b), (c, d) in zip(p, p[1:])))
    assert abs(value(chains([p[0] for p in points], [p[1] for p in points], least=SEED)[0][4]) - best) < 1e-6


def test_equal_stretches_share_a_seed():
    rng = np.random.default_rng(2)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 5000, n)]
    for n in (19, 30):
        same = word(n)
        row, _, h = seeds(pa.array([" ".join(word(40) + same + word(7)), " ".join(word(3) + same + word(90)), None, "a b", " ".join(same[:9])]))
        assert set(h[row == 0]) & set(h[row == 1]) and not (row == 2).any() and not (row == 3).any() and (row == 4).sum() == 1


def test_alignment_counts_edits():
    a = list(range(100, 160))
    b = a[:20] + [1] + a[21:40] + a[42:]
    assert align([7] * 5 + a, [8] * 3 + b, [(9, 7), (30, 28), (50, 46)]) == (5, 65, 3, 61, 57)


def _corpus():
    rng = np.random.default_rng(9)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 30_000, n)]
    passage, short = word(70), word(25)
    fuzzy = list(passage)
    for i in (12, 40, 60):
        fuzzy[i] = f"edit{i}"
    texts = {1: word(80) + passage + word(30), 2: word(10) + passage, 3: fuzzy + word(200), 4: word(100) + short, 5: short + word(60), 6: word(150)}
    rows = [(i, " ".join(t)) for i, t in texts.items()] + [(7, " ".join(texts[6])), (8, None), (9, ""), (10, " ".join(passage[:8])), (None, " ".join(texts[1]))]
    return rows, passage


def test_passages_are_found_and_nothing_else(spark):
    rows, passage = _corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, t string")
    texts, pairs = passages(df)
    name = {r.n: r.least_id for r in texts.collect()}
    got = pairs.collect()
    linked = {frozenset((name[r.first], name[r.other])) for r in got}
    assert len(set().union(*linked)) == 3 and linked <= {frozenset(x) for x in ((1, 2), (1, 3), (2, 3))}
    words = {i: (t or "").split() for i, t in rows}
    for r in got:
        assert r.similarity >= 0.8 and r.matched >= 60
        assert len(set(words[name[r.other]][r.other_from : r.other_to]) & set(passage)) >= 64
    assert passages(df.limit(0))[1].count() == 0


def test_cutting_leaves_one_copy_of_a_passage(spark):
    rows, passage = _corpus()
    df = spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in rows if i], "doc_id long, text string, n_chars int, cuts string")
    out = without_passages(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got.keys() == {i for i, _ in rows if i}
    assert sum(len(set(passage) & set((r.text or "").split())) >= 60 for r in got.values()) == 1
    before = dict(rows)
    assert all(r.text == before[i] for i, r in got.items() if i > 3) and all(r.n_chars == len(r.text or "") for r in got.values())


def test_op3_on_the_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = op3_passages(spark, sf).collect()
    text = {r.doc_id: (r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in rows:
        if r.kind == "copy":
            assert text[r.doc_id] == text[r.other_id]
        else:
            a = text[r.doc_id].lower().split()[r.word_from : r.word_to]
            b = text[r.other_id].lower().split()[r.other_word_from : r.other_word_to]
            assert min(len(a), len(b)) >= 40 and len(set(a) & set(b)) >= 0.7 * len(set(a))
    copies = {r.doc_id for r in rows if r.kind == "copy"}
    first = {}
    for i in sorted(text):
        if len(text[i].split()) >= 40 and text[i] in first:
            assert i in copies
        first.setdefault(text[i], i)


def test_plain_chains_are_what_the_tree_finds():
    rng = np.random.default_rng(11)
    links = []
    for i in range(300):
        a = np.sort(rng.integers(0, rng.integers(2, 400), rng.integers(1, 7)))
        links.append((a, a + rng.integers(0, 9) + (rng.random(len(a)) < 0.1)))
    size = [len(x) for x, _ in links]
    link, a, b, _, plain = plain_chains(np.repeat(np.arange(300), size), np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links]), np.zeros(sum(size), bool))
    for i, (x, y) in enumerate(links):
        at = link == i
        assert list(zip(a[at].tolist(), b[at].tolist())) == sorted(set(zip(x.tolist(), y.tolist())))
        assert len(set(plain[at])) == 1
        if plain[at][0]:
            assert [c[4] for c in chains(x.tolist(), y.tolist())] == [list(zip(a[at].tolist(), b[at].tolist()))]
    assert 60 < len(set(link[plain])) < 300


def test_many_alignments_are_each_ones():
    rng = np.random.default_rng(12)
    cases = []
    for _ in range(1500):
        a = rng.integers(0, 50, rng.integers(30, 300))
        b = a.copy()
        edited = rng.random(len(a)) < rng.choice([0, 0.05, 0.15, 0.3, 0.6])
        b[edited] = rng.integers(100, 150, edited.sum())
        cut, more = rng.integers(0, 20), rng.integers(0, 30)
        b, d = np.concatenate([rng.integers(200, 300, more), b[cut:]]), cut - more
        places = [x for x in range(cut, len(a) - 5) if (a[x : x + 5] == b[x - d : x - d + 5]).all()]
        if places:
            cases.append((a, b, d, sorted(rng.choice(places, min(len(places), 3), replace=False).tolist())))
    off = [np.append(0, np.cumsum([len(c[j]) for c in cases])) for j in (0, 1)]
    start, stop, matched, sure = align_all(*(np.concatenate([c[j] for c in cases]) for j in (0, 1)), *off, np.array([c[3][0] for c in cases]), np.array([c[3][-1] for c in cases]), np.array([c[2] for c in cases]))

    def passage(fa, ta, n):
        return (fa, ta, n) if ta - fa >= 40 and n >= 0.8 * (ta - fa) - 1e-9 else None

    for i in np.flatnonzero(sure):
        a, b, d, places = cases[i]
        a, b = a.tolist(), b.tolist()
        fa, ta, fb, _, n = widen(a, b, align(a, b, [(x, x - d) for x in places]))
        assert fa - fb == d and passage(fa, ta, n) == passage(start[i], stop[i], matched[i])
    assert sure.sum() > 500
