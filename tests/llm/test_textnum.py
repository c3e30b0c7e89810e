import re

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sparrowmill.llm.textnum import Rolling, Words, minimizers, slices, xxh64

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab C\n\té\x0b z", max_size=60)), max_size=6)


@settings(deadline=None, max_examples=80)
@given(TEXTS)
def test_words_and_shingles_match_a_plain_loop(texts):
    w = Words(pa.array(texts, pa.string()))
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert [bytes(x).decode() for x in w.values().to_pylist()] == [x for row in want for x in row]
    doc, start, length = w.shingles(3)
    got = [[] for _ in texts]
    for d, s, n in zip(doc, start, length):
        got[d].append(w.joined[s : s + n].tobytes().decode())
    assert got == [[" ".join(r[i : i + 3]) for i in range(max(1, len(r) - 2))] if r else [] for r in want]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.binary(max_size=150), min_size=1, max_size=20))
def test_xxh64_matches_the_library(parts):
    buf = np.frombuffer(b"".join(parts) + bytes(8), np.uint8)
    n = np.array([len(p) for p in parts])
    got = xxh64(buf, np.cumsum(n) - n, n)
    assert got.tolist() == [xxhash.xxh64_intdigest(p, 42) for p in parts]


def test_equal_windows_have_equal_hashes_and_minimizers_are_local():
    a = np.frombuffer(b"xx" + b"hello brave new world" * 2, np.uint8)
    h = Rolling(a).windows(8)
    assert (h[2:10] == h[23:31]).all()
    assert len(np.unique(h[2:23])) == 21
    r = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    picked = set(minimizers(r, 16).tolist())
    for i in range(500 - 15):
        assert i + int(np.argmin(r[i : i + 16])) in picked
    assert len(minimizers(r[:3], 16)) == 0


def test_slices_cover_every_row_once():
    b = pa.record_batch({"t": pa.array(["a" * 50, None, "", "b" * 500, "c"])})
    assert [x for s in slices(b, "t", 60) for x in s.column("t").to_pylist()] == b.column("t").to_pylist()
