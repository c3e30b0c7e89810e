import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparrowmill.functions import text as T
from sparrowmill.functions import vectors as V
from sparrowmill.model import Model, Tokenizer, evaluate, quantize_table
from sparrowmill.operators import embed, quantize, retrieval, schedule, split
from sparrowmill.sources import files, tables
from sparrowmill.streaming import incremental


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def sources(spark, sizes):
    return schedule.usable(spark.createDataFrame([(f"s{i:02d}", n) for i, n in enumerate(sizes)], "source string, size bigint"))


def takes(spark, sizes, target, chunk):
    rows = schedule.schedule(sources(spark, sizes), chunk, target).collect()
    out = [0] * len(sizes)
    for r in rows:
        out[int(r.source[1:])] += r.row_end - r.row_start
    return out


def greedy(sizes, target, chunk):
    """The plain loop: the source least far along (by exact share, then index) takes a chunk."""
    from fractions import Fraction

    got = [0] * len(sizes)
    while sum(got) < min(target, sum(sizes)):
        i = min((i for i in range(len(sizes)) if got[i] < sizes[i]), key=lambda i: (Fraction(got[i], sizes[i]), i))
        got[i] += min(chunk, sizes[i] - got[i], target - sum(got))
    return got


def test_schedule_golden_values(spark):
    assert takes(spark, [100, 100, 10000], 1000, 100) == [100, 100, 800]
    assert takes(spark, [10, 20, 30], 1000, 100) == [10, 20, 30]
    four = takes(spark, [1_000_000] * 4, 100, 10)
    assert sum(four) == 100 and max(four) - min(four) <= 10


@settings(deadline=None, max_examples=8)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=5), st.integers(1, 900), st.integers(1, 60))
def test_schedule_is_the_greedy_one(spark, sizes, target, chunk):
    assert takes(spark, sizes, target, chunk) == greedy(sizes, target, chunk)


def test_tiers_nest_and_offsets(spark):
    t = {(r.tier, r.source): r.take_rows for r in schedule.tiers(sources(spark, [50, 500, 70]), 10, {"a": 60, "b": 200, "all": None}).collect()}
    assert all(t["a", s] <= t["b", s] <= t["all", s] for s in ("s00", "s01", "s02")) and t["all", "s01"] == 500
    df = spark.createDataFrame([("x", i, n) for i, n in enumerate([3, 1, 4, 2])] + [("y", i, n) for i, n in enumerate([0, 2, 0])], "k string, i bigint, n int")
    got = {(r.k, r.i): r.start for r in schedule.offsets(df, "k", "i", "n", chunk=2).collect()}
    assert [got["x", i] for i in range(4)] == [0, 3, 4, 8] and [got["y", i] for i in range(3)] == [0, 0, 2]


def test_batches_by_rank(spark):
    s = spark.createDataFrame([("src_a", 40), ("src_b", 60)], "source string, size bigint")
    assert split.batch_windows(s, 8).count() == 12
    assert {r.source: r.batches for r in split.source_distribution(split.batch_windows(s, 2)).collect()} == {"src_a": 20, "src_b": 30}
    plan = split.rank_plan(split.batch_windows(s, 4), 0, 3).collect()
    assert sorted(r.rank for r in plan) == [0] * 8 + [1] * 8 + [2] * 8 and len({(r.source, r.start) for r in plan}) == 24


def test_seeds_and_text(spark):
    assert one(spark, T.batch_seed(42, F.lit(3), F.lit("msmarco"), F.lit(1024))) == "3670835513354418040"
    assert one(spark, T.title_and_text(F.lit("  A \x1f"), F.lit("b\n"))) == "A b" and one(spark, T.title_and_text(F.lit(None).cast("string"), F.lit(" b "))) == "b"
    assert one(spark, T.flatten(F.lit("a\n\tb"))) == "a  b"
    assert list(spark.range(1).select(*T.parse_slug(F.lit("int4-row-512"))).first()) == [4, "row", 512]
    assert list(spark.range(1).select(*T.parse_slug(F.lit("xint4-row-512"))).first()) == [None, None, None]


def test_vectors(spark):
    v = one(spark, V.normalize(F.array(F.lit(3.0), F.lit(4.0), F.lit(0.0))))
    assert v == pytest.approx([0.6, 0.8, 0.0])
    assert one(spark, V.normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0, 0]
    assert one(spark, V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(-2.0), F.lit(0.0)))) == -1


def test_hard_negatives_ties_nan_and_short_arrays(spark):
    nan = float("nan")
    rows = [(1, [9, 1, 2, 3, 4], [1.0, 0.95, 0.5, 0.5, nan]), (2, [9, 1], [nan, 0.1]), (3, [], []), (4, None, [1.0]), (5, [9, 1, 2], [1.0, 0.1])]
    s = spark.createDataFrame(rows, "query_id bigint, document_ids array<bigint>, scores array<double>")
    kept = split.hard_negatives(s, n=2)
    assert [(r.query_id, r.negatives) for r in kept.collect()] == [(1, [3, 2])]
    assert tuple(split.negatives_summary(s, kept).first()) == (5, 1, 4)
    assert [r.negatives for r in split.hard_negatives(s, n=1).where("query_id = 5").collect()] == [[1]]
    many = spark.createDataFrame([(1, list(range(50)))], "k bigint, negs array<int>")
    got = split.sample_negatives(many, "k", "negs", 7).first().sampled
    assert len(set(got)) == 7
    with pytest.raises(Exception, match="more negatives"):
        split.sample_negatives(many, "k", "negs", 51).collect()


def test_split_is_disjoint_capped_and_stable(spark):
    df = spark.range(1000).select(F.concat(F.lit("s"), F.col("id") % 3).alias("source"), "id")
    a = {tuple(r) for r in split.stratified_split(df, "id", 1, 0.2, 50).collect()}
    assert len(a) == 1000 and a == {tuple(r) for r in split.stratified_split(df.orderBy(F.desc("id")), "id", 1, 0.2, 50).collect()}
    total = [r for r in split.split_summary(spark.createDataFrame(list(a), "source string, id bigint, split string")).collect() if r.source == "TOTAL"][0]
    assert (total.n_train, total.n_eval, total.n_both) == (850, 150, 0)


@pytest.mark.parametrize("bits,axis", [(8, "dim"), (8, "row"), (4, "dim"), (4, "row"), (2, "row")])
def test_quantize_round_trip(spark, tmp_path, bits, axis):
    rng = np.random.default_rng(bits)
    w = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)] if i else [0.0] * 8) for i in range(20)], "token_id bigint, vec array<float>")
    q = quantize.quantize(w, bits, axis)
    top = 2 ** (bits - 1) - 1
    assert all(-top <= c <= top for r in q.collect() for c in r.codes)
    if bits < 8:
        p = q.select("codes", quantize.unpack(quantize.pack(F.col("codes"), bits), bits).alias("u")).collect()
        assert all(r.codes == r.u for r in p)
        with pytest.raises(Exception, match="whole bytes"):
            w.select(quantize.pack(F.array(F.lit(1)), bits)).collect()
    back = quantize.dequantized(q, axis)
    s = F.col("scale") if axis == "row" else F.array_max("scales")
    assert back.where(F.exists(F.zip_with("vec", "back", lambda x, y: F.abs(x - y)), lambda e: e > s * 0.5001)).count() == 0
    error = quantize_table(w, f"file://{tmp_path}/a.bin", 8, bits, axis)
    m = Model.load(spark, f"file://{tmp_path}/a.bin")
    assert (m.bits, m.axis, m.dim, m.vocab_size) == (bits, axis, 8, 20) and error["max_error"] == pytest.approx(quantize.error_stats(back).first().max_error, abs=1e-6)


def test_pooling(spark):
    w = np.arange(12, dtype=float).reshape(4, 3)
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, [3, 3]), (2, []), (3, None)], "row_idx bigint, ids array<int>")
    got = {r.row_idx: r.embedding for r in embed.pool(df, w).collect()}
    assert got == {0: [6, 7, 8], 1: [9, 10, 11], 2: [0, 0, 0], 3: [0, 0, 0]}
    masked = {r.row_idx: r.embedding for r in embed.pool(df, w, ignored=(3,)).collect()}
    assert masked[0] == [3, 11 / 3, 13 / 3] and masked[1] == [0, 0, 0]
    with pytest.raises(Exception, match="beyond"):
        embed.pool(spark.createDataFrame([([7],)], "ids array<int>"), w).collect()
    with pytest.raises(Exception, match="out of range"):
        spark.createDataFrame([([70000],)], "ids array<int>").select(embed.checked_ids(F.col("ids"))).collect()


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", c, i + 1) for i, c in enumerate("abcdefghij")], "qid string, id string, rank int")
    rel = spark.createDataFrame([("q", "a"), ("q", "c"), ("none", "z")], "qid string, id string")
    got = {r.qid: r for r in retrieval.per_query(ranked, rel).collect()}
    assert got["q"].ndcg == pytest.approx((1 + 0.5) / (1 + 1 / np.log2(3))) and got["none"].ndcg == 0
    assert (got["q"].mrr, got["q"].accuracy_1, got["q"].recall_3, got["q"].precision_10) == (1, 1, 1, 0.2)
    loss = retrieval.in_batch_loss(spark.createDataFrame([(0, 0, [1.0, 0.0], [1.0, 0.0]), (0, 1, [0.0, 1.0], [0.0, 1.0])], "batch int, i int, q array<double>, d array<double>"))
    assert loss.first().loss == pytest.approx(np.log(1 + np.exp(-20)))


def test_sources(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([("q1", "d1", 1), (None, "d2", 2)], "query string, document string, x int").coalesce(1).write.parquet(f"{d}/p0")
    spark.createDataFrame([("q3", "d3", 3)], "query string, document string, x int").coalesce(1).write.parquet(f"{d}/p1")
    import glob

    urls = sorted(glob.glob(f"{d}/p1/*.parquet")) + sorted(glob.glob(f"{d}/p0/*.parquet"))
    rows = sorted(tuple(r) for r in tables.open_pairs(spark, urls).collect())
    assert rows == [(0, "q3", "d3"), (1, "q1", "d1"), (2, "", "d2")]
    assert tables.rows_between(tables.open_pairs(spark, urls), 1, 2, 3).count() == 2
    with pytest.raises(IndexError):
        tables.rows_between(tables.open_pairs(spark, urls), 2, 2, 3)
    with pytest.raises(ValueError, match="string column"):
        tables.open_pairs(spark, urls, ("query", "x"))
    cat = tables.catalog(spark, {"b": {"test": ["t"], "train": ["u2", "u1"]}, "a": {"dev": ["v"]}}).collect()
    assert [tuple(r) for r in cat] == [("a", ["v"]), ("b", ["u1", "u2"])]
    (tmp_path / "l.txt").write_bytes(b"one\r\ntwo\rx\n\nlast")
    assert [r.text for r in tables.lines(spark, f"{d}/l.txt").collect()] == ["one", "two\rx", "", "last"]
    ids = spark.createDataFrame([(0, [10, 20, 30]), (1, [40]), (2, []), (3, [5])], "row_idx bigint, ids array<int>")
    assert tables.export_csr(ids, f"{d}/csr") == 4 and sorted((r.row_idx, r.ids) for r in tables.import_csr(spark, f"{d}/csr").collect()) == [(0, [10, 20, 30]), (1, [40]), (2, []), (3, [5])]
    c, q, r = tables.retrieval_task(
        spark.createDataFrame([(1, " T ", "x "), (2, "", " y")], "_id int, title string, text string"),
        spark.createDataFrame([(7, "ask"), (8, None), (9, "no positive")], "_id int, text string"),
        spark.createDataFrame([(7, 1, "1"), (7, 1, "1"), (8, 2, "2"), (9, 2, "0.5")], "`query-id` int, `corpus-id` int, score string"),
    )
    assert {tuple(x) for x in c.collect()} == {("1", "T x"), ("2", "y")} and [tuple(x) for x in q.collect()] == [("7", "ask")] and [tuple(x) for x in r.collect()] == [("7", "1")]
    with pytest.raises(ValueError, match="missing"):
        tables.require_all(c, c.where("id = '1'"), "id")


def test_token_table_resumes_and_guards(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([("a", i, [i], [i, i + 1]) for i in range(10)], "source string, row_idx bigint, query_ids array<int>, doc_ids array<int>")
    assert tables.append_tokens(rows.where("row_idx < 4"), path, "words") == 4
    assert tables.append_tokens(rows, path, "words") == 6 and tables.append_tokens(rows, path, "words") == 0
    df, meta = tables.read_tokens(spark, path)
    assert df.count() == 10 and meta["sources"] == {"a": [10, 10, 20]}
    with pytest.raises(ValueError, match="policy"):
        tables.append_tokens(rows, path, "words", True)
    assert tables.one_policy([{}, {"add_special_tokens": True}]) is True
    with pytest.raises(ValueError, match="mixed"):
        tables.one_policy([{}, {"add_special_tokens": False}])


def test_files(spark, tmp_path):
    d = f"file://{tmp_path}"
    s = spark.createDataFrame([("a", 1, "eval"), ("a", 2, "train")], "source string, id bigint, split string")
    assert files.write_split(f"{d}/s", s, 1, 0.2, 10)["counts"] == {"a/eval": 1, "a/train": 1}
    with pytest.raises(ValueError, match="stored"):
        files.write_split(f"{d}/s", s, 1, 0.3, 10)
    files.write_split(f"{d}/s", s, 2, 0.3, 10, force=True)
    t = schedule.tiers(sources(spark, [5, 9]), 2, {"a": 6, "full": None})
    files.write_tiers(f"{d}/tiers.json", t)
    assert sorted(map(tuple, files.read_tiers(spark, f"{d}/tiers.json").collect())) == sorted(map(tuple, t.collect()))
    r = files.Results(f"{d}/r.json", {"k": 1})
    r.add("nq", {"ndcg": 0.5})
    assert files.Results(f"{d}/r.json", {"k": 1}).todo(["nq", "fever"]) == ["fever"]
    with pytest.raises(ValueError, match="another"):
        files.Results(f"{d}/r.json", {"k": 2})
    assert files.Results(f"{d}/r.json", {"k": 2}, strict=False).message
    corpus = spark.createDataFrame([(1, "x")], "id bigint, text string")
    files.write_surface(f"{d}/e", corpus, corpus.withColumnRenamed("id", "qid"), spark.createDataFrame([(1, 10), (1, 9), (1, 9)], "qid bigint, id bigint"), {"n": 1})
    assert sorted(map(tuple, files.read_surface(spark, f"{d}/e")[2].collect())) == [("1", "10"), ("1", "9")]
    (tmp_path / "q.json").write_text(json.dumps({"aggregates": {"12_mean_ndcg@10": {"512": 0.47}}}))
    assert tables.quality_json(spark, f"{d}/q.json", 512).first().ndcg12 == 0.47 and tables.quality_json(spark, f"{d}/q.json", 64).first().ndcg12 is None


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    d = str(tmp_path)
    docs = spark.createDataFrame([(i, f"alpha beta {i}") for i in range(6)], "doc_id bigint, text string")
    vocab = embed.vocabulary(docs, "text", 5)
    docs.where("doc_id < 3").write.parquet(f"{d}/in/a")
    run = lambda: incremental.tokenized_stream(spark, f"{d}/in/*", "doc_id bigint, text string", vocab, f"{d}/out", f"{d}/cp")
    run()
    docs.where("doc_id >= 3").write.parquet(f"{d}/in/b")
    run()
    run()
    got = sorted((r.doc_id, r.ids) for r in spark.read.parquet(f"{d}/out").collect())
    assert got == sorted((r.doc_id, r.ids) for r in embed.token_ids(docs, vocab, "text").collect()) and len(got) == 6
    tasks = spark.createDataFrame([(4, "row"), (32, None)], "bits int, axis string")
    assert incremental.remaining(tasks, tasks.where("bits = 32"), ["bits", "axis"]).count() == 1


def test_model_end_to_end(spark, tmp_path):
    docs = spark.createDataFrame([("a", "red fox"), ("b", "blue whale"), ("c", "")], "id string, text string")
    vocab = spark.createDataFrame([("red", 1), ("fox", 2), ("blue", 3), ("whale", 4)], "token string, token_id int")
    w = spark.createDataFrame([(i, [float(i == j) for j in range(8)]) for i in range(5)], "token_id bigint, vec array<float>")
    quantize_table(w, f"file://{tmp_path}/m.bin", 8, 8, "row")
    m, t = Model.load(spark, f"file://{tmp_path}/m.bin"), Tokenizer(vocab)
    got = {r.id: r.embedding for r in m.embed_documents(docs, t).collect()}
    assert np.linalg.norm(got["a"]) == pytest.approx(1) and not any(got["c"])
    num = docs.select((F.ascii("id") - 96).cast("bigint").alias("id"), "text")
    q = spark.createDataFrame([(1, "fox")], "qid bigint, text string")
    rel = spark.createDataFrame([(1, 1)], "qid bigint, id bigint")
    assert [r.ndcg10 for r in evaluate(num, q, rel, lambda df: m.embed_documents(df, t), (8, 4)).collect()] == [1.0, 1.0]


def test_wordpiece_file(spark):
    import public_tokenizers as P

    df = spark.createDataFrame([("a red fox",), (None,), ("",)], "text string")
    got = [r.ids for r in embed.wordpiece(df, P.path("word_bpe_49k.json")).collect()]
    assert len(got[0]) == 3 and got[1:] == [[], []]


def test_scratch_tables_go_and_kept_ones_stay(spark):
    from sparrowmill.session import Stored, scratch

    with scratch() as keep:
        a = Stored(spark.range(3))
        with scratch() as inner:
            b, c = Stored(spark.range(4)), inner(Stored(spark.range(5)))
        with pytest.raises(Exception, match="exist|FILE_NOT_FOUND"):
            b.df.count()
        assert c.df.count() == 5
        keep(a)
    assert a.df.count() == 3
    with pytest.raises(Exception, match="exist|FILE_NOT_FOUND"):
        c.df.count()


def _rows(spark, n, start=0):
    return spark.createDataFrame([("a", i, [i], [i, i + 1]) for i in range(start, n)], "source string, row_idx bigint, query_ids array<int>, doc_ids array<int>")


def test_a_stopped_append_leaves_no_rows(spark, tmp_path):
    """A run that stopped after it wrote rows and before the manifest: the rows don't count, and the next append writes them once."""
    path = f"file://{tmp_path}/t"
    _rows(spark, 5).write.partitionBy("source").parquet(f"{path}/tokens/batch=000000-stopped")
    assert tables.append_tokens(_rows(spark, 5), path, "words") == 5
    _rows(spark, 9, 5).write.partitionBy("source").parquet(f"{path}/tokens/batch=000001-stopped")
    assert tables.read_tokens(spark, path)[0].count() == 5
    assert tables.append_tokens(_rows(spark, 7), path, "words") == 2
    df, meta = tables.read_tokens(spark, path)
    assert sorted(r.row_idx for r in df.collect()) == list(range(7)) and meta["sources"] == {"a": [7, 7, 14]}
    assert len(list((tmp_path / "t/tokens").iterdir())) == 2


def test_lost_rows_are_an_error(spark, tmp_path):
    import shutil

    path = f"file://{tmp_path}/t"
    for n in (4, 9):
        tables.append_tokens(_rows(spark, n), path, "words")
    shutil.rmtree(sorted((tmp_path / "t/tokens").iterdir())[1] / "source=a")
    with pytest.raises(ValueError, match="manifest"):
        tables.read_tokens(spark, path)
    with pytest.raises(ValueError, match="manifest"):
        tables.append_tokens(_rows(spark, 12), path, "words")


def test_a_tier_needs_its_sources(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    tables.append_tokens(_rows(spark, 6), path, "words")
    tier = lambda *s: spark.createDataFrame([("xs", 10, 10, *x) for x in s], "tier string, target_rows bigint, actual_rows bigint, source string, take_rows bigint")
    assert sorted(r.row_idx for r in tables.open_tier(spark, path, tier(("a", 4), ("b", 0)), "xs").collect()) == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="takes 7"):
        tables.open_tier(spark, path, tier(("a", 7)), "xs")
    with pytest.raises(FileNotFoundError, match="source b"):
        tables.open_tier(spark, path, tier(("a", 4), ("b", 1)), "xs")


def test_triples_round_trip_and_checks(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    docs = spark.createDataFrame([(3, [3]), (4, [4, 4]), (5, [5]), (6, [])], "id bigint, ids array<int>")
    queries = spark.createDataFrame([(1, [1]), (2, [2])], "id bigint, ids array<int>")
    pairs = spark.createDataFrame([(1, 3, [5, 4]), (2, 4, [6, 5])], "query_id bigint, positive bigint, negatives array<bigint>")
    x = split.gather_triples(pairs, queries, docs, 2)
    got = {r.query_id: (r.query_ids, r.positive_ids, r.negative_ids) for r in x.collect()}
    assert got == {1: ([1], [3], [[5], [4, 4]]), 2: ([2], [4, 4], [[], [5]])}
    with pytest.raises(Exception, match="no tokens"):
        split.gather_triples(pairs.withColumn("positive", F.lit(9).cast("bigint")), queries, docs, 2).collect()
    with pytest.raises(Exception, match="not 3 negatives"):
        split.gather_triples(pairs, queries, docs, 3).collect()
    ranks = {r.id: r["rank"] for r in split.dense_ids(pairs, "query_id").collect()}
    assert ranks == {1: 0, 2: 1}
    numbered = x.join(split.dense_ids(pairs, "query_id").toDF("query_id", "pair_idx"), "query_id")
    meta = tables.write_triples(numbered, path, "src", 2)
    assert (meta["n_pairs"], meta["total_query_tokens"], meta["total_positive_tokens"], meta["total_negative_tokens"]) == (2, 2, 3, 4)
    assert tables.read_triples(spark, path)[0].count() == 2
    files.write_json(f"{path}/meta.json", meta | {"n_pairs": 3})
    with pytest.raises(ValueError, match="expected 3"):
        tables.read_triples(spark, path)
    files.write_json(f"{path}/meta.json", meta | {"n_negatives_per_pair": 50})
    with pytest.raises(ValueError, match="not 50 negatives"):
        tables.read_triples(spark, path)
    files.write_json(f"{path}/meta.json", meta | {"add_special_tokens": "yes"})
    with pytest.raises(TypeError):
        tables.read_triples(spark, path)


def test_a_wordpiece_file_is_matched_greedily(spark, tmp_path):
    from tokenizers import Tokenizer
    from tokenizers.models import WordPiece
    from tokenizers.normalizers import BertNormalizer
    from tokenizers.pre_tokenizers import BertPreTokenizer

    vocab = {w: i for i, w in enumerate(["[UNK]", "un", "##aff", "##able", "##a", "##f", "red", "fox", "##es", "r", "##e", "##d", "!", "u", "##n"])}
    t = Tokenizer(WordPiece(vocab, unk_token="[UNK]"))
    t.normalizer, t.pre_tokenizer = BertNormalizer(lowercase=True), BertPreTokenizer()
    t.save(f"{tmp_path}/wp.json")

    def greedy(word):
        out, at = [], 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if ("##" * (at > 0) + word[at:e]) in vocab), None)
            if end is None:
                return [vocab["[UNK]"]]
            out.append(vocab["##" * (at > 0) + word[at:end]])
            at = end
        return out

    texts = ["Unaffable red FOXES!", "", None, "blue", "unred reded", "una unf"]
    got = [r.ids for r in embed.wordpiece(spark.createDataFrame([(x,) for x in texts], "text string").coalesce(1), f"{tmp_path}/wp.json").collect()]
    assert got == [[i for w in (x or "").lower().replace("!", " !").split() for i in greedy(w)] for x in texts]


def test_containing_is_substring_search(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab "), 40)) for _ in range(60)] + [None, ""]
    items = ["ab", "aab ", "bbbbbb", "", "zzz", "ab", None, "a"]
    d = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    q = spark.createDataFrame(list(enumerate(items)), "qid bigint, item string")
    got = sorted(map(tuple, embed.containing(d, q).collect()))
    assert got == sorted((j, i) for i, t in enumerate(texts) for j, x in enumerate(items) if t is not None and x is not None and x in t)


def test_mined_negatives_are_those_of_all_scores(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(90, 4)), 1)
    rows = [(i, v[i].tolist(), int(i % 4)) for i in range(90)]
    e = spark.createDataFrame(rows, "id bigint, embedding array<double>, label int").repartition(5)
    got = {r.query_id: r for r in embed.mined_negatives(e, e.where("id % 9 = 0").withColumnRenamed("id", "qid"), 0.95, 7).collect()}
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    for q in range(0, 90, 9):
        s = np.round(u @ u[q], 6)
        p = min((i for i in range(90) if i != q and i % 4 == q % 4), key=lambda i: (-s[i], i))
        ok = sorted((i for i in range(90) if i not in (q, p) and s[i] < 0.95 * s[p]), key=lambda i: (-s[i], -i))
        assert (got[q].positive, got[q].n_eligible, got[q].negatives) == (p, len(ok), ok[:7])


def test_deployed_variants_are_the_fixed_ones():
    from sparrowmill.operators import sweep

    assert sum(map(len, sweep.GROUPS.values())) == 12 and len(sweep.cells()) == 78
    assert sweep.scaled(64)["int4_dim"] == ((4, "dim", 64), (4, "dim", 32), (4, "dim", 16), (4, "dim", 8))
    assert quantize.variant(2, "row") == "int2_row" and quantize.cell_name(3, "hybrid") == "int3_hybrid"
    for bits, axis in ((2, "dim"), (3, "row"), (8, "hybrid"), (8, None)):
        with pytest.raises(ValueError, match="not deployed"):
            quantize.variant(bits, axis)


def test_words_are_those_of_the_jvm(spark):
    texts = ["Éa b-c", "  ", None, "", "x", "Straße 12ab,ÄÖ", "日本 語", "a" * 1000, "don't stop\n\tnow"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, text string").coalesce(1)
    flat, start = embed.split_words(df.toPandas().text.pipe(lambda s: __import__("pyarrow").array(s, from_pandas=True)))
    want = [r.w for r in df.select(T.words(F.col("text")).alias("w")).collect()]
    assert [flat[a:b].to_pylist() for a, b in zip(start, start[1:])] == want
    vocab = embed.vocabulary(df, "text", 6)
    assert [len(r.ids) for r in embed.token_ids(df, vocab, "text").collect()] == [len(w) for w in want]


def test_command_line(spark, tmp_path, capsys):
    import public_tokenizers as P

    from sparrowmill.__main__ import main

    d = str(tmp_path)
    spark.createDataFrame([("a", 0, "red fox", "a red fox ran"), ("a", 1, "whale", "blue whale"), ("b", 0, "x", "")], "source string, row_idx bigint, query string, document string").write.parquet(f"{d}/pairs")
    file = P.path("word_bpe_49k.json")
    main(["tokenize", f"{d}/pairs", f"{d}/tokens", "--tokenizer", file])
    main(["tokenize", f"{d}/pairs", f"{d}/tokens", "--tokenizer", file])
    files.write_tiers(f"{d}/tiers.json", spark.createDataFrame([("xs", 2, 2, "a", 1), ("xs", 2, 2, "b", 1)], "tier string, target_rows bigint, actual_rows bigint, source string, take_rows bigint"))
    main(["subset", f"{d}/tokens", f"{d}/tiers.json", "xs", "--side", "query"])
    spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(49_408)], "token_id bigint, vec array<float>").write.parquet(f"{d}/w")
    main(["quantize", f"{d}/w", f"{d}/m.bin", "--dim", "2", "--bits", "8"])
    spark.createDataFrame([(1, "red fox"), (2, "")], "doc_id bigint, text string").write.parquet(f"{d}/docs")
    main(["embed", f"{d}/m.bin", f"{d}/docs", "--tokenizer", file, "--out", f"{d}/v"])
    main(["bench", f"{d}/m.bin", f"{d}/docs", "--tokenizer", file])
    said = capsys.readouterr().out
    assert "3 rows appended" in said and "0 rows appended" in said and "docs_per_s" in said and "doc_ids" not in said
    got = {r.doc_id: r.embedding for r in spark.read.parquet(f"{d}/v").collect()}
    assert np.linalg.norm(got[1]) == pytest.approx(1) and got[2] == [0, 0]


def test_checkpoint_defaults_from_the_shape(spark, tmp_path):
    path = f"file://{tmp_path}/c.bin"
    w = np.arange(12, dtype="<f4").reshape(4, 3)
    tables.write_tensors(path, {"embedding.weight": w, "other": np.zeros(2, "<f4")}, {"stage": "1"})
    df, meta = tables.checkpoint(spark, path)
    assert meta == {"vocab_size": "4", "dim": "3", "stage": "1"}
    assert {r.token_id: r.vec for r in df.collect()} == {i: r.tolist() for i, r in enumerate(w)}
    tables.write_tensors(path, {"embedding.weight": w}, {"dim": "8"})
    with pytest.raises(ValueError, match="dim 8"):
        tables.checkpoint(spark, path)
