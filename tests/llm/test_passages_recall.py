"""Recall of passages against brute force."""

import numpy as np
import pyarrow as pa

from sparrowmill.llm.passages import AFTER, BEFORE, END, K, LEAST_WORDS, MOST, SIMILARITY, WINDOW, _all_pairs, frequent_pairs, frequent_seeds, passages, promising, seeds, signatures, word_hashes
from sparrowmill.llm.texts import dealing, unique


def _fuzzy(rng, n, edits):
    """Two texts of words of their own around a passage of `n` words, of which `edits` places differ."""
    base = rng.integers(0, 30_000, n)
    other = base.copy()
    other[rng.choice(n, edits, replace=False)] = 1_000_000 + rng.integers(0, 1_000_000, edits)
    around = rng.integers(2_000_000, 9_000_000, 240)
    return np.concatenate([around[:60], base, around[60:120]]), np.concatenate([around[120:180], other, around[180:]])


def test_planted_fuzzy_passages_are_found_as_by_brute_force(spark):
    """Brute force: on some diagonal of the two texts `LEAST_WORDS` words or more match at the similarity."""

    def brute(a, b):
        for d in range(-len(a), len(b)):
            x = max(0, -d)
            same = np.array(a[x : x + len(b) - x - d] == b[x + d : x + d + len(a) - x], float)
            s = np.append(0.0, np.cumsum(same - SIMILARITY))
            if len(s) > LEAST_WORDS and (s[LEAST_WORDS:] - np.minimum.accumulate(s)[:-LEAST_WORDS] > -1e-9).any():
                return True
        return False

    rng = np.random.default_rng(21)
    cases = [_fuzzy(rng, n, e) for n, e in ((40, 8), (50, 10), (60, 12), (60, 9), (80, 16)) for _ in range(40)]
    assert all(brute(a, b) for a, b in cases[::10])
    rows = [(2 * i + j, " ".join(map(str, t))) for i, c in enumerate(cases) for j, t in enumerate(c)]
    texts, pairs = passages(spark.createDataFrame(rows, "doc_id long, text string"))
    name = {r.n: r.least_id for r in texts.collect()}
    got = {min(name[r.first], name[r.other]) // 2 for r in pairs.collect() if name[r.first] // 2 == name[r.other] // 2}
    share = [sum(40 * g <= i < 40 * g + 40 for i in got) / 40 for g in range(5)]
    print("recall of 40, 50, 60 and 80 words at 0.8 and 60 at 0.85:", share)
    assert min(share) >= 0.95


def test_passages_of_lines_that_first_occur_elsewhere_are_found(spark):
    """Three frequent lines stand together in two texts each; each line's first text is another, that holds it alone."""
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 10**7, n)]
    rows = []
    for case in range(12):
        lines = [word(20) for _ in range(3)]
        joint = [w for line in lines for w in line]
        rows += [(100 * case + i, " ".join(word(30) + joint + word(30))) for i in range(2)]
        for part in range(0, 56, 2):  # every short part of the passage, over its lines' ends too, in texts of its own
            rows.append((100 * case + 2 + part // 2, " ".join(word(30) + joint[part : part + 12] + word(30))))
            rows.append((100 * case + 40 + part // 2, " ".join(word(30) + joint[part : part + 12] + word(30))))
    texts, pairs = passages(spark.createDataFrame(rows, "doc_id long, text string"))
    name = {r.n: r.least_id for r in texts.collect()}
    got = {tuple(sorted((name[r.first], name[r.other]))): r for r in pairs.collect()}
    assert got.keys() == {(100 * case, 100 * case + 1) for case in range(12)}
    assert min(r.matched for r in got.values()) == 60


def test_signatures_have_a_bit_of_each_word_around():
    rng = np.random.default_rng(6)
    texts = [[str(i) for i in rng.integers(0, 9, n)] for n in (90, 3, 0, 7, 40)]
    _, h = word_hashes(pa.array([" ".join(t) for t in texts]))
    bits = {w: int(x) >> 63 for w, x in zip([w for t in texts for w in t], h)}
    row, _, place, signature = signatures(pa.array([" ".join(t) for t in texts]))
    assert len(row) > 20
    for r, p, s in zip(row, place, signature.tolist()):
        t = texts[r]
        after = [bits[w] for w in t[p + K : p + K + AFTER]]
        want = after + [END >> i & 1 for i in range(len(after), AFTER)] + [bits[w] for w in t[max(0, p - BEFORE) : p][::-1]]
        assert [s >> i & 1 for i in range(64)] == (want + [0] * 64)[:64]


def test_what_holds_a_passage_in_place_is_promising():
    """Brute force over all places of LEAST_WORDS words around a seed; of other seeds few are."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 10**9, (600, 120))
    other = base.copy()
    other[rng.random(other.shape) < rng.uniform(0.1, 0.6, (600, 1))] += 1
    other[:, 50 : 50 + K] = base[:, 50 : 50 + K]
    sig = []
    for x in (base, other):
        row, _, place, s = signatures(pa.array([" ".join(map(str, t)) for t in x]), window=1)
        sig.append(s[place == 50])
        assert row[place == 50].tolist() == list(range(600))
    got = promising(*sig)
    same = base == other
    want = np.array([max(same[i, a : a + LEAST_WORDS].sum() for a in range(50 + K - LEAST_WORDS, 51)) >= SIMILARITY * LEAST_WORDS for i in range(600)])
    assert 100 < want.sum() < 400 and got[want].all()
    shuffled = promising(sig[0], np.roll(sig[1], 1))
    print("random seeds that go on:", shuffled.mean())
    assert shuffled.mean() < 0.1


def test_runs_of_one_word_meet_runs_as_long(spark):
    """Many short runs at texts' ends come first in the order; the long ones still meet."""
    rng = np.random.default_rng(4)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 10**7, n)]
    for one in ("the", "for", "of", "x"):
        rows = [(i, " ".join(word(30) + [one] * 12)) for i in range(120)] + [(1000 + i, " ".join(word(30) + [one] * 60 + word(30))) for i in range(3)]
        texts, pairs = passages(spark.createDataFrame(rows, "doc_id long, text string"))
        name = {r.n: r.least_id for r in texts.collect()}
        got = {frozenset((name[r.first], name[r.other])) for r in pairs.collect()}
        assert set().union(*got) == {1000, 1001, 1002}


def test_every_pair_of_texts_with_a_passage_is_found(spark):
    """Each of many texts begins a frequent line; those of a group go on alike, but for words of each one's own, after another
    text of the same beginning. All pairs within 40 words of which 32 match are found, however many texts have the line."""
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 10**7, n)]
    line, rows, wanted = word(12), [], set()
    rows += [(i, " ".join(word(20) + line + word(40))) for i in range(300)]
    for g in range(4):
        after = word(36)
        for i in range(40):  # one word in nine of each text's own: 44 of 48 match its neighbours, but for places they share
            mine = [f"own{g}-{i}-{j}" if j % 9 == (i % 9) else w for j, w in enumerate(after)]
            rows.append((1000 + 100 * g + i, " ".join(word(20) + line + mine + word(20))))
        ids = [1000 + 100 * g + i for i in range(40)]
        wanted |= {(a, b) for a in ids for b in ids if a < b}
    texts, pairs = passages(spark.createDataFrame(rows, "doc_id long, text string"))
    name = {r.n: r.least_id for r in texts.collect()}
    got = {tuple(sorted((name[r.first], name[r.other]))) for r in pairs.collect()}
    assert wanted <= got and all(a >= 1000 and a // 100 == b // 100 for a, b in got)


def test_a_passage_of_frequent_lines_with_words_between_is_found(spark):
    """Two frequent lines of twenty words, a word between them in one text and four in the other: no seed alone allows a passage in place."""
    rng = np.random.default_rng(9)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 10**7, n)]
    x, y = word(20), word(20)
    rows = [(i, " ".join(word(30) + (x if i % 2 else y) + word(30))) for i in range(400)]
    rows += [(1000, " ".join(word(30) + x + word(1) + y + word(30))), (1001, " ".join(word(30) + x + word(4) + y + word(30)))]
    texts, pairs = passages(spark.createDataFrame(rows, "doc_id long, text string"))
    name = {r.n: r.least_id for r in texts.collect()}
    assert {tuple(sorted((name[r.first], name[r.other]))) for r in pairs.collect()} == {(1000, 1001)}


def test_a_pair_of_texts_is_met_once_for_a_passage_and_not_for_each_seed(spark, monkeypatch):
    """Texts of one long passage share some fifty frequent seeds. Each pair has one row, and all its seeds count."""
    rng = np.random.default_rng(10)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 10**7, n)]
    one = word(150)
    rows = [(i, " ".join(word(30 + i % 7) + one + word(40))) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, stored = unique(df, "doc_id", "text")
    row, _, h = seeds(pa.array([t for _, t in rows]))
    key, many = np.unique(h, return_counts=True)
    shift = dealing(stored)[1]
    keys = np.unique(key[many > MOST] >> shift)
    assert len(keys) > 40
    met = frequent_pairs(frequent_seeds(stored, keys, shift, K, WINDOW), K, LEAST_WORDS, SIMILARITY).collect()
    every = [(a, b) for a in range(90) for b in range(a + 1, 90)]
    assert len(met) == len({(r.first, r.other) for r in met}) == len(every)
    texts, pairs = passages(df)
    name = {r.n: r.least_id for r in texts.collect()}
    assert sorted((*sorted((name[r.first], name[r.other])), r.matched) for r in pairs.collect()) == [(a, b, 150) for a, b in every]
    monkeypatch.setattr("sparrowmill.llm.passages.ROUND", 1500)  # several rounds
    _, again = passages(df)
    assert sorted(again.collect()) == sorted(pairs.collect())


def test_rows_of_one_key_are_paired_in_portions():
    rng = np.random.default_rng(11)
    key = np.sort(rng.integers(0, 400, 3000)).astype(np.uint64)
    n = np.concatenate([np.sort(rng.integers(0, 9, c)) for c in np.unique(key, return_counts=True)[1]])
    many = dict(zip(*np.unique(key, return_counts=True)))
    portions = list(_all_pairs(key, n, 12, 100))
    assert len(portions) > 50 and max(len(x) for x, _ in portions) <= 100
    got = sorted((int(a), int(b)) for x, y in portions for a, b in zip(x, y))
    assert got == sorted((a, b) for a in range(3000) for b in range(a + 1, min(3000, a + 12)) if key[a] == key[b] and n[a] != n[b] and many[key[a]] <= 12)
