"""Vocabularies and weight tables that do not go to every task whole."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowmill.operators import embed, quantize, sweep
from sparrowmill.plans import catalogue

SF = "/root/testdata/sf0.001"
NAMES = ["vocabulary", "embed_fp32", "embed_int8_dim", "embed_int4_row", "embedding_parity", "triples", "stream_incremental", "retrieval_ndcg10", "deployment_groups"]


@pytest.fixture
def few_near(monkeypatch):
    monkeypatch.setattr(embed, "NEAR", 40)
    monkeypatch.setattr(embed, "MOST_TOKENS", 40)
    catalogue._known.clear()
    yield
    catalogue._known.clear()


@pytest.mark.parametrize("name", NAMES)
def test_queries_with_words_that_are_joined(spark, few_near, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    rel = con.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in rel.description]
    want = sorted((tuple(r) for r in rel.fetchall()), key=str)
    assert sorted((tuple(r) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=str) == want


def test_more_words_than_16_bits(spark):
    n = 70_000
    docs = spark.range(n).select(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" top")).alias("text"))
    got = {r.token: r.token_id for r in embed.vocabulary(docs, "text", n).collect()}
    words = ["top", *sorted(f"w{i}" for i in range(n))][: n - 1]
    assert got == {w: i + 1 for i, w in enumerate(words)}


def test_pooling_of_joined_rows(spark, few_near):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(100, 3)).astype(np.float32)
    w = embed.collect_weights(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "token_id bigint, vec array<float>"))
    assert len(w.near) == 40 and w.far is not None
    ids = [[99, 1, 99, 39, 40], [], None, [41], [2, 3]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "i bigint, ids array<int>").repartition(3)
    got = {r.i: r.embedding for r in embed.pool(df, w).collect()}
    for i, x in enumerate(ids):
        assert np.allclose(got[i], m[x].astype(float).mean(0) if x else np.zeros(3), atol=1e-12)
    with pytest.raises(Exception, match="beyond"):
        embed.pool(spark.createDataFrame([([100],)], "ids array<int>"), w).collect()
    with pytest.raises(ValueError, match="0 to n - 1"):
        embed.collect_weights(spark.createDataFrame([(i, [1.0]) for i in [*range(60), 61]], "token_id bigint, vec array<float>"))


def test_rows_of_a_cell_are_those_of_its_table(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(30, 8)).astype(np.float32)
    m[3] = 0
    w = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "token_id bigint, vec array<float>")
    for bits, axis, dim in sweep.cells(dims=(8, 4)):
        want = np.array([r.vec for r in sweep.table(w, bits, axis, dim).orderBy("token_id").collect()], np.float32)
        cut = quantize.slice_table(w, dim)
        largest = quantize.magnitudes(quantize.over_top(cut) if axis == "hybrid" else cut)
        assert (quantize.fake_rows(m[:, :dim], bits, axis, largest) == want).all()


def test_texts_are_encoded_in_portions(spark, monkeypatch):
    import public_tokenizers as P
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = ["a red fox", None, "", "w" * 50, "x y " * 9, *["blue whale"] * 20]
    monkeypatch.setattr(embed, "PORTION", 30)
    parts = list(embed.portions(pa.array(texts)))
    assert [t for p in parts for t in p.to_pylist()] == texts
    assert all(len(p) == 1 or sum(len(t or "") for t in p.to_pylist()) <= 30 for p in parts)
    file = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    big = ["red fox " * 2000] * 300  # 4.8 MB in one batch
    monkeypatch.undo()
    got = spark.createDataFrame([(t,) for t in [*texts, *big]], "text string").coalesce(1)
    got = [r.ids for r in embed.wordpiece(got, P.path("word_bpe_49k.json")).collect()]
    assert got == [file.encode(t or "", add_special_tokens=False).ids for t in [*texts, *big]]


def test_percentiles_are_selected_by_digits(spark):
    rng = np.random.default_rng(3)
    given = {"a": rng.normal(size=3001), "b": np.repeat([0.5, -0.0, 0.25, 3e300], [5, 4, 3, 2]), "c": np.array([7.0]), "d": 1 + rng.integers(0, 9, 800) * 2.0**-52}
    rows = [(k, v.tolist()) for k, x in given.items() for v in np.array_split(x, 7)] + [("a", None), ("a", [])]
    x = spark.createDataFrame(rows, "tag string, xs array<double>").repartition(5)
    shares = (0.0, 0.01, 0.5, 0.99, 1.0)
    got = quantize.percentiles(x, shares)
    each = x.select("tag", F.explode("xs").alias("e")).groupBy("tag").agg(F.percentile("e", F.array(*map(F.lit, shares))).alias("p"))
    assert got == {r.tag: r.p for r in each.collect()} and set(got) == set(given)
    plans = [quantize.error_stats(x.select(F.col("xs").alias("vec"), F.col("xs").alias("back")))]
    assert not any("percentile" in p._jdf.queryExecution().toString() for p in plans)
