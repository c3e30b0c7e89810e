import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparrowmill.llm import bpe_tree, materialise, packing
from sparrowmill.llm.tokens import word_bpe

SF = "/root/testdata/sf0.001"
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
WHOLE = Tokenizer.from_file(P.path("word_bpe_49k.json"))
ODD = st.text(alphabet="ab'slr evdtm1٣ \n\t  \x1cÉéΣİß.!<|>漢🎉́", max_size=80)


@settings(deadline=None, max_examples=150)
@given(ODD)
@example("I'll we've 'stop ''s it's\n\n  x")
@example("a <|endoftext|> b")
def test_word_ids_match_the_library(text):
    assert word_bpe(P.path("word_bpe_49k.json")).encode([text])[0].tolist() == WHOLE.encode(text, add_special_tokens=False).ids


@settings(deadline=None, max_examples=150)
@given(ODD, st.integers(1, 9))
@example("ab'" + "s more'll  \n x", 1)
def test_the_tree_matches_the_library(text, leaf):
    tree = bpe_tree.Tree(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, leaf)
    assert tree.encode(text) == LIBRARY.encode_ordinary(text)
    assert tree.decode(tree.encode(text)) == text.encode()


def test_op10_matches_the_library(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in bpe_tree.op10_byte_bpe(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = LIBRARY.encode_ordinary(t)
        assert got[i][1:] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_encode_and_decode_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "a b" * 9000, None)], "doc_id long, text string, ids string")
    enc = bpe_tree.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert sorted((r.id, len(r.ids)) for r in enc.collect()) == [(1, 0), (2, 0), (2, len(LIBRARY.encode_ordinary("a b" * 9000)))]
    assert {bytes(r.bytes) for r in bpe_tree.decode(enc, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()} == {b"", b"a b" * 9000}
    assert bpe_tree.round_trip(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_a_bin_is_the_fullest_that_brute_force_finds():
    rng = np.random.default_rng(3)
    for _ in range(40):
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, 40, 6), rng.integers(1, 4, 6))}
        got = packing.fullest(counts, 50)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c - (n == max(counts)) + 1)}
        assert sum(n * t for n, t in got.items()) == max(counts) + max(s for s in sums if s <= 50 - max(counts))
        assert all(t <= counts[n] for n, t in got.items())


def _check_packed(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_op1(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = packing.op1_packing(spark, SF).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by.keys() == texts.keys()
    total = 0
    for i, t in texts.items():
        ids = np.array([*WHOLE.encode(t, add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        want = [(k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by[i]) == want
    assert _check_packed(rows, 2048) <= -(-total // 2048) + 2


@pytest.mark.parametrize("salted", [3, 50_000])
def test_pack_ties_repeats_nulls_and_nothing(spark, salted, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", salted)
    rows = [(i % 7 if i % 5 else None, 0, 0, 3 + i % 4, 1, "x") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, piece int, start long, length long, ids_crc32 long, rank_from string")
    out = packing.pack(df, 10).collect()
    assert len(out) == 60 and _check_packed(out, 10) <= 30
    assert packing.pack(df.limit(0), 10).count() == 0


def test_the_permutation_is_one():
    for n in (1, 2, 3, 17, 1000, 4097):
        assert sorted(materialise.feistel(np.arange(n), n, 42).tolist()) == list(range(n))
    assert materialise.feistel(np.arange(1000), 1000, 1).tolist() != materialise.feistel(np.arange(1000), 1000, 2).tolist()


def test_shards_hold_every_sequence_in_slot_order(spark, tmp_path):
    df = spark.createDataFrame([(i, "word " * (i * 7 % 90) if i % 6 else None, "x") for i in range(120)] + [(5, "word " * 35, "x")], "doc_id long, text string, slot string")
    out = f"file://{tmp_path}/shards"
    rows = materialise.materialise(df, out, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, tokens=16, shard=32).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    read = {}
    for k in range(-(-len(rows) // 32)):
        got = list(materialise.read_shard(f"{out}/shard-{k:08d}.bin"))
        assert [s for s, _ in got] == list(range(32 * k, min(32 * k + 32, len(rows))))
        assert [s for s, _ in materialise.read_shard(f"{out}/shard-{k:08d}.bin", 5)] == [s for s, _ in got][5:]
        read |= dict(got)
    seen = {}
    for r in rows:
        assert zlib.crc32(read[r.slot].tobytes()) == r.crc32 and len(read[r.slot]) == r.n_tokens
        seen.setdefault(r.id, []).append((r.piece, read[r.slot].tolist()))
    for i, t in {r.doc_id: r.text for r in df.collect()}.items():
        if i != 5:
            assert [x for _, p in sorted(seen[i]) for x in p] == [*LIBRARY.encode_ordinary(t or ""), 50256]
    assert materialise.materialise(df.limit(0), out + "0", P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_shards_of_a_run_before_are_replaced(spark, tmp_path):
    """A null id has slots too; a second run over the same staged table and folder leaves the same bytes and nothing beside them."""
    from sparrowmill.session import Stored

    df = spark.createDataFrame([(None if i % 9 == 0 else i, "some words " * (i % 13)) for i in range(70)], "doc_id long, text string")
    out = f"file://{tmp_path}/shards"
    placed, total = materialise.slots(Stored(materialise.stage(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, tokens=16)).df, 42)
    files = []
    for _ in range(2):
        rows = materialise.write_shards(placed, total, out, 16, 32).collect()
        files.append({f.name: f.read_bytes() for f in (tmp_path / "shards").iterdir()})
    assert files[0] == files[1] and len(files[0]) == -(-total // 32)
    assert sorted(r.slot for r in rows) == list(range(total)) and sum(r.id is None for r in rows) >= 8


def test_blocks_of_sequences_take_less_than_at_the_streams_own_level():
    rng = np.random.default_rng(3)
    text = [f"the {w} of a {v} is not what it was in {w}" for w, v in rng.integers(0, 300, (400, 2)).tolist()]
    ids = [np.frombuffer(" ".join(text[i : i + 12]).encode(), np.uint8).astype("<u2").tobytes() for i in rng.integers(0, 388, 255)]
    rows = pa.table({"slot": pa.array(np.sort(rng.permutation(8192)[:255])), "ids": pa.array(ids, pa.binary())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(rows)
    block = materialise.block(rows)
    assert pa.ipc.open_stream(block).read_all() == rows and len(block) < 0.95 * sink.getvalue().size


def test_a_table_stored_at_a_higher_level_is_smaller(spark):
    from pathlib import Path

    from sparrowmill.session import Stored

    df = spark.range(30_000).selectExpr("concat_ws(' ', 'the', id % 97, 'of a', hash(id) % 900, 'is not', id % 89, 'in', hash(id, 2) % 700) AS t").coalesce(1)
    size = {level: sum(p.stat().st_size for p in Path(Stored(df, level=level).path.removeprefix("file://").removeprefix("file:")).glob("*.parquet")) for level in (1, 9)}
    assert 0 < size[9] < 0.97 * size[1]
