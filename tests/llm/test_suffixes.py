import collections
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparrowmill.llm import suffixes
from sparrowmill.llm.suffixes import common, front_code, merge, offsets, op9_suffix_dedup, read_run, without_repeats


def brute(texts, width):
    seen = collections.Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        on = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                on[i : i + width] = b"\1" * width
        kept = bytes(b for b, x in zip(t, on) if not x)
        out.append((len(t), sum(on), sum(1 for i in range(len(t)) if on[i] and (i == 0 or not on[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@settings(deadline=None, max_examples=80)
@given(st.lists(st.lists(st.tuples(st.binary(max_size=12).map(lambda b: bytes(x % 3 for x in b)), st.binary(max_size=3)), max_size=12), max_size=7))
def test_merge_is_a_sort_with_right_common_prefixes(lists):
    runs = [sorted((a, b, i, j) for j, (a, b) in enumerate(x)) for i, x in enumerate(lists)]
    assert [[y[1:] for y in read_run(front_code(r))] for r in runs] == runs
    got = list(merge([front_code(r) for r in runs]))
    assert [x[1:3] for x in got] == sorted(x[:2] for r in runs for x in r)
    assert [x[0] for x in got] == [common(a, b) for a, b in zip([b"", *[x[1] for x in got]], [x[1] for x in got])]


@settings(deadline=None, max_examples=80)
@given(st.lists(st.tuples(st.binary(min_size=0, max_size=6), st.binary(max_size=6)), min_size=2, max_size=14))
def test_offsets_match_all_pairs(pairs):
    width, gram = 8, b"gg"
    items = sorted((gram + bytes(x % 2 for x in a), bytes(x % 2 for x in b)) for a, b in pairs)
    group = [(common(items[i - 1][0], a) if i else 0, a, b) for i, (a, b) in enumerate(items)]
    want = [{o for j, (c, d) in enumerate(items) if j != i for o in range(width + 1) if common(b, d) >= o and common(a, c) >= width - o} for i, (a, b) in enumerate(items)]
    assert [{o for o in range(width + 1) if x >> o & 1} for x in offsets(group, width)] == want


@pytest.mark.parametrize("hot", [1 << 15, 2])
def test_op_matches_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = np.random.default_rng(11)
    words = [bytes(rng.integers(97, 101, 5).astype(np.uint8)).decode() for _ in range(400)]
    prose = lambda n: " ".join(words[i] for i in rng.integers(0, 400, n))
    shared = [prose(n) for n in (6, 8, 12, 40)]
    texts = [None, "", "short", "z" * 300, "ab" * 120, "é" * 70] + [prose(30)] * 3
    for i in range(60):
        parts = [prose(int(rng.integers(1, 30))), shared[i % 4], prose(int(rng.integers(0, 9))), shared[int(rng.integers(0, 4))]]
        t = " ".join(parts)
        texts.append(t if i % 3 else t[:50] + "#" + t[50:])
    df = spark.createDataFrame([(i if i % 9 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, mask string")
    rows = without_repeats(df, width=40, gram=12).collect()
    raw = [(t or "").encode() for t in texts]
    want = collections.Counter((i if i % 9 else None, *x) for i, x in enumerate(brute(raw, 40)))
    assert collections.Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.spans) == r.n_removed for r in rows)
    assert without_repeats(df.limit(0)).count() == 0


def test_op9_on_the_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op9_suffix_dedup(spark, sf).collect()}
    assert got == dict(zip([i for i, _ in docs], brute([t for _, t in docs], 200)))
