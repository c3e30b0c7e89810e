"""Every query of the library over the driver's tables, with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import embed, quantize, retrieval, schedule, split, sweep
from ..session import stored, table
from ..streaming import incremental

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


# Shared pieces ---------------------------------------------------------------------------------------------------

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
#: Token ids, pooled and unit vectors of documents and of the benchmark's items, as CTEs.
SQL_VOCAB = f"""
toks AS (SELECT doc_id, unnest({TOKENS}) AS tok FROM documents),
vc AS (SELECT tok, count(*) AS c FROM toks GROUP BY tok),
vr AS (SELECT tok, row_number() OVER (ORDER BY c DESC, tok) AS token_id FROM vc),
vocab AS (SELECT tok, token_id FROM vr WHERE token_id <= (SELECT count(*) - 1 FROM embeddings)),
qtoks AS (SELECT item_id, unnest({TOKENS}) AS tok FROM benchmark),
bag AS (SELECT doc_id AS id, coalesce(token_id, 0) AS t, count(*) AS c FROM toks LEFT JOIN vocab USING (tok) GROUP BY ALL),
qbag AS (SELECT item_id AS id, coalesce(token_id, 0) AS t, count(*) AS c FROM qtoks LEFT JOIN vocab USING (tok) GROUP BY ALL)"""
SQL_W = "w AS (SELECT vec_id AS t, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings)"
SQL_UNIT = """
{p}pool AS (SELECT id, d, sum(c * x) / sum(c) AS x FROM {p}bag JOIN w USING (t) WHERE d <= {dim} GROUP BY id, d),
{p}norm AS (SELECT id, sqrt(sum(x * x)) AS n FROM {p}pool GROUP BY id),
{p}unit AS (SELECT id, d, x / CASE WHEN n < 1.1920928955078125e-07 THEN 1 ELSE n END AS x FROM {p}pool JOIN {p}norm USING (id))"""
SQL_RANKED = """
sims AS (SELECT q.id AS qid, u.id, round(sum(q.x * u.x), 9) AS score FROM qunit q JOIN unit u USING (d) GROUP BY q.id, u.id),
ranked AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sims),
qrels AS (SELECT DISTINCT b.item_id AS qid, d.doc_id AS id FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
rel AS (SELECT qid, count(*) AS n_rel FROM qrels GROUP BY qid)"""


def _search(dim: int = 64) -> str:
    return f"WITH {SQL_VOCAB}, {SQL_W}, {SQL_UNIT.format(p='', dim=dim)}, {SQL_UNIT.format(p='q', dim=dim)}, {SQL_RANKED}"


def weights(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("token_id"), F.col("embedding").alias("vec"))


_known: dict = {}


def words_of(spark: SparkSession, sf: str):
    """The vocabulary of a table's documents by id, counted once for a session and its files."""
    docs = table(spark, sf, "documents")
    key = (spark.sparkContext.applicationId, tuple(docs.inputFiles()))
    if key not in _known:
        _known.clear()
        _known[key] = embed.collect_vocabulary(embed.vocabulary(docs, "text", weights(spark, sf).count()))
    return _known[key]


def encoded(spark: SparkSession, sf: str, name: str = "documents", id_col: str = "doc_id") -> DataFrame:
    return embed.token_ids(embed.spread(table(spark, sf, name).select(F.col(id_col).alias("id"), "text")), words_of(spark, sf), "text", keep_text=False)


def vectors(spark: SparkSession, sf: str, name: str = "documents", id_col: str = "doc_id") -> DataFrame:
    """(id, embedding): texts without a word have no vector here."""
    v = embed.embed_texts(table(spark, sf, name), words_of(spark, sf), embed.collect_weights(weights(spark, sf)), id_col)
    return v.where("n_tokens > 0").select("id", "embedding")


def relevance(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, id): documents that contain an item's text."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("item"))
    return embed.containing(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), items).select(F.col("item").alias("qid"), "id")


def ranked(spark: SparkSession, sf: str, k: int, dim: int | None = None) -> DataFrame:
    d, q = vectors(spark, sf), vectors(spark, sf, "benchmark", "item_id").withColumnRenamed("id", "qid")
    if dim:
        d, q = (x.withColumn("embedding", V.truncate(F.col("embedding"), dim)) for x in (d, q))
    return embed.nearest(d, q, k)


# Retrieval -------------------------------------------------------------------------------------------------------


@query(
    _search()
    + """, hits AS (SELECT qid, sum(1 / log2(rank + 1)) AS dcg FROM ranked JOIN qrels USING (qid, id) WHERE rank <= 10 GROUP BY qid)
SELECT qid, n_rel, round(coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n_rel, 10) + 1) r(i)), 6) AS ndcg10 FROM rel LEFT JOIN hits USING (qid)"""
)
def retrieval_ndcg10(spark, sf):
    per = retrieval.per_query(ranked(spark, sf, 10), relevance(spark, sf), deep=10)
    return per.select("qid", "n_rel", F.round("ndcg", 6).alias("ndcg10"))


@query(_search() + " SELECT qid, id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 10")
def retrieval_top10(spark, sf):
    return ranked(spark, sf, 10).select("qid", "id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


_AT = ", ".join(f"avg(CASE WHEN h{n} > 0 THEN 1.0 ELSE 0 END) AS a{n}, avg(h{n} / {n}.0) AS p{n}, avg(h{n} * 1.0 / n_rel) AS r{n}" for n in (1, 3, 5, 10))


@query(
    _search()
    + f""", h AS (SELECT qid, rank, row_number() OVER (PARTITION BY qid ORDER BY rank) AS k FROM ranked JOIN qrels USING (qid, id) WHERE rank <= 100),
g AS (SELECT rel.qid, n_rel, {", ".join(f"count(*) FILTER (WHERE rank <= {n}) AS h{n}" for n in (1, 3, 5, 10))},
 coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rank <= 10), 0) AS dcg, coalesce(1.0 / min(rank) FILTER (WHERE rank <= 10), 0) AS rr, coalesce(sum(k * 1.0 / rank), 0) / least(n_rel, 100) AS ap
 FROM rel LEFT JOIN h USING (qid) GROUP BY rel.qid, n_rel),
m AS (SELECT count(*) AS n_queries, avg(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n_rel, 10) + 1) r(i))) AS ndcg, avg(rr) AS mrr, avg(ap) AS map, {_AT} FROM g)
SELECT n_queries, round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr, round(map, 6) AS map, {", ".join(f"round(a{n}, 6) AS accuracy_{n}, round(p{n}, 6) AS precision_{n}, round(r{n}, 6) AS recall_{n}" for n in (1, 3, 5, 10))} FROM m"""
)
def retrieval_metrics_all(spark, sf):
    return retrieval.means(retrieval.per_query(ranked(spark, sf, 100), relevance(spark, sf)))


_DIMS = (64, 32, 16, 8)


def _sweep(dim: int) -> str:
    return (
        f"SELECT {dim}::BIGINT AS dim, round(avg(coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n_rel, 10) + 1) r(i))), 6) AS ndcg10 FROM ("
        + _search(dim)
        + " SELECT n_rel, dcg FROM rel LEFT JOIN (SELECT qid, sum(1 / log2(rank + 1)) AS dcg FROM ranked JOIN qrels USING (qid, id) WHERE rank <= 10 GROUP BY qid) USING (qid)) s"
    )


@query(" UNION ALL ".join(_sweep(d) for d in _DIMS))
def matryoshka_sweep(spark, sf):
    d, q = (stored(vectors(spark, sf, n, i)) for n, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    qrels, out = stored(relevance(spark, sf)), None
    for dim in _DIMS:
        c, r = d.withColumn("embedding", V.truncate(F.col("embedding"), dim)), q.select(F.col("id").alias("qid"), V.truncate(F.col("embedding"), dim).alias("embedding"))
        one = retrieval.per_query(embed.nearest(c, r, 10), qrels).agg(F.lit(dim).cast("bigint").alias("dim"), F.round(F.avg("ndcg"), 6).alias("ndcg10"))
        out = one if out is None else out.union(one)
    return out


@query("""WITH q AS (SELECT DISTINCT b.item_id AS qid, d.doc_id AS id FROM documents d JOIN benchmark b ON contains(d.text, b.text))
SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS n_corpus, count(*) AS n_qrels, count(DISTINCT qid) AS n_queries_scored FROM q""")
def retrieval_counts(spark, sf):
    return retrieval.counts(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), relevance(spark, sf))


# Mixing plan -----------------------------------------------------------------------------------------------------

CHUNK = 8
SQL_PLAN = """
src AS (SELECT source, count(*) AS size FROM documents WHERE source <> 'src3' GROUP BY source),
idx AS (SELECT source, size, row_number() OVER (ORDER BY source) - 1 AS source_idx FROM src),
ch AS (SELECT source, source_idx, size, k * 8 AS row_start, least(8, size - k * 8) AS len FROM idx, LATERAL (SELECT unnest(range(0, (size - 1) // 8 + 1)) AS k)),
ord AS (SELECT *, row_number() OVER w - 1 AS chunk_no, sum(len) OVER (w ROWS UNBOUNDED PRECEDING) - len AS before FROM ch WINDOW w AS (ORDER BY row_start::DOUBLE / size, source_idx))"""


def _sources(spark, sf):
    return schedule.usable(schedule.sizes(table(spark, sf, "documents")), ("src3",))


def _targets(sources: DataFrame) -> dict[str, int | None]:
    """A tenth and two fifths of all rows, and all."""
    total = sources.agg(F.sum("size")).first()[0] or 0
    return {"xs": total // 10, "small": total * 2 // 5, "full": None}


def _tiers(spark, sf):
    s = _sources(spark, sf)
    return schedule.tiers(s, CHUNK, _targets(s))


@query(f"WITH {SQL_PLAN} SELECT chunk_no::BIGINT AS chunk_no, source_idx::BIGINT AS source_idx, source, row_start::BIGINT AS row_start, (row_start + least(len, half - before))::BIGINT AS row_end FROM ord, (SELECT sum(size)::BIGINT // 2 AS half FROM src) WHERE before < half")
def mix_schedule(spark, sf):
    """Half of all rows."""
    s = _sources(spark, sf)
    return schedule.schedule(s, CHUNK, (s.agg(F.sum("size")).first()[0] or 0) // 2).drop("before")


@query(f"""WITH {SQL_PLAN}, g AS (SELECT *, CASE WHEN lag(source_idx) OVER (ORDER BY chunk_no) = source_idx THEN 0 ELSE 1 END AS new FROM ord),
r AS (SELECT *, sum(new) OVER (ORDER BY chunk_no ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT run::BIGINT AS run, source_idx::BIGINT AS source_idx, source, min(row_start)::BIGINT AS row_start, max(row_start + len)::BIGINT AS row_end FROM r GROUP BY run, source_idx, source""")
def mix_coalesced(spark, sf):
    return schedule.coalesced(schedule.schedule(_sources(spark, sf), CHUNK))


_SQL_TIERS = f"""WITH {SQL_PLAN}, t AS (SELECT unnest(['xs', 'small', 'full']) AS tier, unnest([sum(size)::BIGINT // 10, sum(size)::BIGINT * 2 // 5, NULL]) AS target_rows FROM src),
tk AS (SELECT tier, target_rows, source, sum(greatest(0, least(len, coalesce(target_rows, 1000000000000) - before)))::BIGINT AS take_rows FROM ord, t GROUP BY ALL),
tt AS (SELECT tier, target_rows, (sum(take_rows) OVER (PARTITION BY tier))::BIGINT AS actual_rows, source, take_rows FROM tk)"""


@query(_SQL_TIERS + " SELECT * FROM tt")
def mix_tiers(spark, sf):
    return _tiers(spark, sf)


@query(_SQL_TIERS + " SELECT tier, max(target_rows) AS target_rows, max(actual_rows) AS actual_rows, count(*) FILTER (WHERE take_rows > 0) AS sources_touched FROM tt GROUP BY tier")
def mix_summary(spark, sf):
    return schedule.tier_summary(_tiers(spark, sf))


SQL_ROWS = "rows AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row_idx FROM documents)"


def _rows(spark, sf):
    """The documents with their place in their source, numbered by chunks and within them."""
    docs = table(spark, sf, "documents").withColumn("one", F.lit(1).cast("bigint"))
    return schedule.offsets(docs, "source", "doc_id", "one").withColumnRenamed("start", "row_idx").drop("one")


@query(_SQL_TIERS + f", {SQL_ROWS} SELECT source, doc_id, row_idx::BIGINT AS row_idx FROM rows JOIN tt USING (source) WHERE tier = 'small' AND row_idx < take_rows")
def tier_prefix(spark, sf):
    return schedule.prefix(_rows(spark, sf), _tiers(spark, sf), "small").select("source", "doc_id", "row_idx")


@query(f"""WITH x AS (SELECT source, len({TOKENS}) AS n FROM documents) SELECT source, count(*) AS n_rows, sum(n)::BIGINT AS n_tokens FROM x GROUP BY source
UNION ALL SELECT 'TOTAL', count(*), sum(n)::BIGINT FROM x""")
def token_stats_rollup(spark, sf):
    return schedule.subset_stats(table(spark, sf, "documents").select("source", F.size(T.words(F.col("text"))).alias("n_tokens")))


@query(f"""WITH x AS (SELECT source, doc_id, len({TOKENS})::BIGINT AS n FROM documents)
SELECT source, doc_id, n, (sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS start FROM x""")
def csr_offsets(spark, sf):
    x = table(spark, sf, "documents").select("source", "doc_id", F.size(T.words(F.col("text"))).cast("bigint").alias("n"))
    return schedule.offsets(x, "source", "doc_id", "n").select("source", "doc_id", "n", "start")


@query("WITH x AS (SELECT lang, source, char_length(text) AS n FROM documents) SELECT lang, source, count(*) AS n_rows, sum(n)::BIGINT AS n_chars FROM x WHERE n >= 500 GROUP BY lang, source")
def min_length_counts(spark, sf):
    x = table(spark, sf, "documents").where(F.char_length("text") >= 500)
    return x.groupBy("lang", "source").agg(F.count("*").alias("n_rows"), F.sum(F.char_length("text")).alias("n_chars"))


@query("SELECT doc_id, translate(text, chr(10) || chr(9), '  ') AS line FROM documents WHERE char_length(text) >= 300")
def min_length_flatten(spark, sf):
    x = table(spark, sf, "documents").where(F.char_length("text") >= 300)
    return x.select("doc_id", T.flatten(F.col("text")).alias("line"))


@query("""SELECT page_id, CASE WHEN t <> '' THEN t || ' ' || b ELSE b END AS text FROM (SELECT page_id, trim(coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '')) AS t, trim(url) AS b FROM pages)""")
def title_text_projection(spark, sf):
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return table(spark, sf, "pages").select("page_id", T.title_and_text(title, F.col("url")).alias("text"))


@query("""WITH x AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, text AS query, t2 AS document FROM x WHERE role = 'user' AND r2 = 'assistant'""")
def qa_pairs(spark, sf):
    w = W.partitionBy("conv_id").orderBy("turn")
    x = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("r2"), F.lead("text").over(w).alias("t2"))
    return x.where("role = 'user' AND r2 = 'assistant'").select("conv_id", "turn", F.col("text").alias("query"), F.col("t2").alias("document"))


@query(f"WITH x AS (SELECT len({TOKENS}) AS n FROM documents) SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_tokens, count(*) FILTER (WHERE n = 0) AS n_empty, round(avg(n), 6) AS mean_tokens FROM x")
def embed_counters(spark, sf):
    return embed.counters(table(spark, sf, "documents").select(T.words(F.col("text")).alias("ids")))


@query(f"WITH {SQL_VOCAB} SELECT tok AS token, token_id FROM vocab")
def vocabulary(spark, sf):
    v = embed.vocabulary(table(spark, sf, "documents"), "text", weights(spark, sf).count())
    return v.select("token", F.col("token_id").cast("bigint").alias("token_id"))


@query(f"WITH {SQL_VOCAB}, {SQL_W}, {SQL_UNIT.format(p='', dim=64)} SELECT id, max(CASE WHEN d = 1 THEN round(x, 6) END) AS x1, max(CASE WHEN d = 64 THEN round(x, 6) END) AS x64, round(sum(x), 5) AS total FROM unit GROUP BY id")
def embed_fp32(spark, sf):
    v = vectors(spark, sf)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return v.select("id", F.round(F.element_at("embedding", 1), 6).alias("x1"), F.round(F.element_at("embedding", 64), 6).alias("x64"), F.round(total, 5).alias("total"))


# Quantization ----------------------------------------------------------------------------------------------------

SQL_E = "e AS (SELECT vec_id AS token_id, unnest(embedding)::FLOAT AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings)"


def _sql_scale(bits: int, axis: str) -> str:
    key = "token_id" if axis == "row" else "d"
    return f"sc AS (SELECT {key}, greatest((max(abs(x))::DOUBLE / {2 ** (bits - 1) - 1})::FLOAT, 1.1754943508222875e-38::FLOAT) AS scale FROM e GROUP BY {key})"


def _sql_codes(bits: int, axis: str) -> str:
    q = 2 ** (bits - 1) - 1
    key = "token_id" if axis == "row" else "d"
    return f"{SQL_E}, {_sql_scale(bits, axis)}, cd AS (SELECT token_id, d, x, scale, greatest(-{q}, least({q}, round_even((x::DOUBLE / scale::DOUBLE)::FLOAT::DOUBLE, 0)::INTEGER)) AS code FROM e JOIN sc USING ({key}))"


@query(f"WITH {SQL_E}, {_sql_scale(8, 'row')} SELECT token_id, round(scale::DOUBLE, 9) AS scale FROM sc")
def quant_scales_row(spark, sf):
    return quantize.row_scales(weights(spark, sf), 8).select("token_id", F.round(F.col("scale").cast("double"), 9).alias("scale"))


@query(f"WITH {SQL_E}, {_sql_scale(4, 'dim')} SELECT d::BIGINT AS d, round(scale::DOUBLE, 9) AS scale FROM sc")
def quant_scales_dim(spark, sf):
    return quantize.dim_scales(weights(spark, sf), 4).select(F.col("d").cast("bigint").alias("d"), F.round(F.col("scale").cast("double"), 9).alias("scale"))


def _codes_query(bits, axis):
    sql = f"WITH {_sql_codes(bits, axis)} SELECT token_id, string_agg(code::VARCHAR, ',' ORDER BY d) AS codes FROM cd GROUP BY token_id"

    @query(sql, f"quant_codes_int{bits}_{axis}")
    def run(spark, sf):
        return quantize.quantize(weights(spark, sf), bits, axis).select("token_id", F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"))


for _b, _a in ((8, "dim"), (8, "row"), (4, "dim"), (4, "row"), (2, "row"), (3, "dim")):
    _codes_query(_b, _a)


def _pack_query(bits, axis):
    q, per = 2 ** (bits - 1) - 1, 8 // bits
    sql = f"""WITH {_sql_codes(bits, axis)}, byt AS (SELECT token_id, d // {per} AS b, sum((code + {q}) << ((d % {per}) * {bits}))::INTEGER AS v FROM cd GROUP BY token_id, d // {per})
SELECT token_id, string_agg(lpad(upper(to_hex(v)), 2, '0'), '' ORDER BY b) AS packed, true AS same FROM byt GROUP BY token_id"""

    @query(sql, f"pack_int{bits}_{axis}")
    def run(spark, sf):
        x = quantize.quantize(weights(spark, sf), bits, axis).withColumn("packed", quantize.pack(F.col("codes"), bits))
        return x.select("token_id", "packed", (quantize.unpack(F.col("packed"), bits) == F.col("codes")).alias("same"))


_pack_query(4, "dim")
_pack_query(4, "row")
_pack_query(2, "row")


def _error_sql(bits, axis):
    return f"""SELECT '{quantize.cell_name(bits, axis)}' AS variant, round(max(er), 6) AS max_error, round(avg(er), 6) AS mean_error, round(quantile_cont(er, 0.99), 6) AS p99_error
FROM (WITH {_sql_codes(bits, axis)} SELECT abs(x::DOUBLE - (code * scale)::FLOAT::DOUBLE) AS er FROM cd) s"""


@query(" UNION ALL ".join(_error_sql(b, a) for b, a in ((8, "dim"), (8, "row"), (4, "dim"), (4, "row"), (3, "row"), (2, "row"))))
def dequant_error(spark, sf):
    return quantize.error_table({quantize.cell_name(b, a): quantize.fake_quantize(weights(spark, sf), b, a) for b, a in ((8, "dim"), (8, "row"), (4, "dim"), (4, "row"), (3, "row"), (2, "row"))})


@query(f"""WITH e0 AS (SELECT vec_id AS token_id, unnest(embedding)::FLOAT AS own, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings),
tp AS (SELECT token_id, greatest(max(abs(own)), 1.1754943508222875e-38::FLOAT) AS top FROM e0 GROUP BY token_id),
e AS (SELECT token_id, d, own, top, (own::DOUBLE / top::DOUBLE)::FLOAT AS x FROM e0 JOIN tp USING (token_id)), {_sql_scale(4, 'dim')},
b AS (SELECT own, ((greatest(-7, least(7, round_even((x::DOUBLE / scale::DOUBLE)::FLOAT::DOUBLE, 0)::INTEGER)) * scale)::FLOAT * top)::FLOAT AS back FROM e JOIN sc USING (d)),
er AS (SELECT abs(own::DOUBLE - back::DOUBLE) AS er FROM b)
SELECT round(max(er), 6) AS max_error, round(avg(er), 6) AS mean_error, round(quantile_cont(er, 0.99), 6) AS p99_error FROM er""")
def fake_quant_hybrid(spark, sf):
    return quantize.error_stats(quantize.hybrid_quantize(weights(spark, sf), 4))


def _embed_query(bits, axis):
    each = "sum(c * code) * max(scale)::DOUBLE / sum(c)" if axis == "dim" else "sum(c * code * scale::DOUBLE) / sum(c)"
    sql = f"""WITH {SQL_VOCAB}, {_sql_codes(bits, axis)}, p AS (SELECT id, d, {each} AS x FROM bag JOIN cd ON cd.token_id = bag.t GROUP BY id, d)
SELECT id, round(max(CASE WHEN d = 0 THEN x END), 6) AS x1, round(sum(x), 5) AS total, round(sqrt(sum(x * x)), 6) AS length FROM p GROUP BY id"""

    @query(sql, f"embed_int{bits}_{axis}")
    def run(spark, sf):
        codes, scales = embed.quantized_weights(quantize.quantize(weights(spark, sf), bits, axis), axis)
        v = embed.embed_texts(table(spark, sf, "documents"), words_of(spark, sf), codes, "doc_id", scales=scales, normalized=False).where("n_tokens > 0")
        total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
        return v.select("id", F.round(F.element_at("embedding", 1), 6).alias("x1"), F.round(total, 5).alias("total"), F.round(V.norm(F.col("embedding")), 6).alias("length"))


for _b, _a in ((8, "dim"), (8, "row"), (4, "dim"), (4, "row"), (2, "row")):
    _embed_query(_b, _a)


@query(" UNION ALL ".join(f"SELECT {b} AS bits, count(*) FILTER (WHERE quiet) AS n_silent FROM (WITH {SQL_E}, {_sql_scale(b, 'dim')} SELECT token_id, bool_and(abs(x::DOUBLE) < 0.5 * scale::DOUBLE) AS quiet FROM e JOIN sc USING (d) GROUP BY token_id) s" for b in (8, 4, 3, 2)))
def silent_rows(spark, sf):
    return quantize.silent_rows(weights(spark, sf))


@query(f"WITH {SQL_E}, {_sql_scale(2, 'dim')} SELECT token_id FROM e JOIN sc USING (d) GROUP BY token_id HAVING bool_and(abs(x::DOUBLE) < 0.5 * scale::DOUBLE)")
def silent_row_ids(spark, sf):
    return quantize.silent_row_ids(weights(spark, sf), 2)


_SHAPE = ", ".join(f"round(quantile_cont(x, {q}), 6) AS {n}" for q, n in ((0.0, "p0"), (0.01, "p1"), (0.5, "p50"), (0.99, "p99"), (1.0, "p100")))


@query(f"""WITH {SQL_E}, r AS (SELECT stddev_pop(x::DOUBLE) AS row_std, sqrt(sum(x::DOUBLE * x::DOUBLE)) AS row_norm, max(abs(x::DOUBLE)) AS row_max FROM e GROUP BY token_id),
c AS (SELECT stddev_pop(x::DOUBLE) AS col_std, sqrt(sum(x::DOUBLE * x::DOUBLE)) AS col_norm, max(abs(x::DOUBLE)) AS col_max FROM e GROUP BY d),
u AS ({" UNION ALL ".join(f"SELECT '{n}' AS what, {n} AS x FROM {n[0]}" for n in ("row_std", "row_norm", "row_max", "col_std", "col_norm", "col_max"))})
SELECT what, {_SHAPE}, round(stddev_pop(x), 6) AS std FROM u GROUP BY what""")
def weight_percentiles(spark, sf):
    return quantize.weight_summary(weights(spark, sf))


@query(f"""WITH {SQL_E}, r AS (SELECT max(abs(x::DOUBLE)) AS m FROM e GROUP BY token_id), c AS (SELECT max(abs(x::DOUBLE)) AS m FROM e GROUP BY d)
SELECT (SELECT round(max(m) / min(m) FILTER (WHERE m > 0), 6) FROM r) AS row_range, (SELECT count(*) FROM r WHERE m = 0) AS zero_rows, (SELECT round(max(m) / min(m), 6) FROM c) AS col_range""")
def dynamic_range(spark, sf):
    return quantize.dynamic_range(weights(spark, sf))


# Negatives, splits, batches --------------------------------------------------------------------------------------

SQL_SCORES = """
q AS (SELECT vec_id AS query_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, q.label = e.label AS pos, vec_id AS id, round(list_cosine_similarity(v, embedding::DOUBLE[]), 6) AS score FROM q JOIN embeddings e ON vec_id <> query_id),
top AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY pos DESC, score DESC, id) AS rn FROM s),
p AS (SELECT query_id, id AS positive, score AS ps FROM top WHERE rn = 1),
el AS (SELECT query_id, positive, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS k, count(*) OVER (PARTITION BY query_id) AS n_eligible
 FROM s JOIN p USING (query_id) WHERE id <> positive AND score < 0.95 * ps)"""


def _mined(spark, sf, n: int = 50):
    """The negatives of a stated set of queries (every twentieth vector) among all vectors."""
    e = embed.spread(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label"))
    return embed.mined_negatives(e, e.where("id % 20 = 0").withColumnRenamed("id", "qid"), n=n)


@query(f"WITH {SQL_SCORES} SELECT query_id, positive, n_eligible, string_agg(id::VARCHAR, ',' ORDER BY k) AS negatives FROM el WHERE n_eligible >= 50 AND k <= 50 GROUP BY query_id, positive, n_eligible")
def hard_negatives(spark, sf):
    return _mined(spark, sf).where("n_eligible >= 50").select("query_id", "positive", "n_eligible", F.array_join(F.transform("negatives", lambda x: x.cast("string")), ",").alias("negatives"))


@query(f"WITH {SQL_SCORES}, c AS (SELECT count(DISTINCT query_id) AS k FROM el WHERE n_eligible >= 450) SELECT (SELECT count(*) FROM q) AS n_pre, k AS n_kept, (SELECT count(*) FROM q) - k AS n_dropped FROM c")
def negatives_dropped(spark, sf):
    asked = table(spark, sf, "embeddings").where("vec_id % 20 = 0")
    return split.negatives_summary(asked, _mined(spark, sf, 1).where("n_eligible >= 450"))


#: Given candidate lists: a vector's places as ids and its components as scores, the first as the positive; every seventh list empty.
_SQL_GIVEN = """g AS (SELECT vec_id AS query_id, CASE WHEN vec_id % 7 = 0 THEN [] ELSE embedding::DOUBLE[] END AS s FROM embeddings),
x AS (SELECT query_id, s[1] AS top, unnest(s) AS score, generate_subscripts(s, 1) AS id FROM g),
el AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS k, count(*) OVER (PARTITION BY query_id) AS n_eligible FROM x WHERE id > 1 AND score < 0.95 * top)"""


def _given(spark, sf):
    e = table(spark, sf, "embeddings")
    s = F.when(F.col("vec_id") % 7 == 0, F.array().cast("array<double>")).otherwise(F.col("embedding").cast("array<double>"))
    return e.select(F.col("vec_id").alias("query_id"), F.transform("embedding", lambda _, i: (i + 1).cast("bigint")).alias("document_ids"), s.alias("scores"))


@query(f"WITH {_SQL_GIVEN} SELECT query_id, 1::BIGINT AS positive, n_eligible, string_agg(id::VARCHAR, ',' ORDER BY k) AS negatives FROM el WHERE n_eligible >= 20 AND k <= 20 GROUP BY query_id, n_eligible")
def hard_negatives_of_lists(spark, sf):
    x = split.hard_negatives(_given(spark, sf), n=20)
    return x.select("query_id", "positive", "n_eligible", F.array_join(F.transform("negatives", lambda v: v.cast("string")), ",").alias("negatives"))


@query(f"WITH {_SQL_GIVEN} SELECT (SELECT count(*) FROM g) AS n_pre, count(DISTINCT query_id) AS n_kept, (SELECT count(*) FROM g) - count(DISTINCT query_id) AS n_dropped FROM el WHERE n_eligible >= 20")
def negatives_dropped_of_lists(spark, sf):
    s = _given(spark, sf)
    return split.negatives_summary(s, split.hard_negatives(s, n=20))


SQL_SPLIT = """
ids AS (SELECT DISTINCT source, doc_id AS id FROM documents),
n AS (SELECT source, least(round_even(count(*) * 0.2, 0)::BIGINT, 100) AS n_eval FROM ids GROUP BY source),
r AS (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || source || ':' || id)) AS rn FROM ids),
sp AS (SELECT source, id, CASE WHEN rn <= n_eval THEN 'eval' ELSE 'train' END AS split FROM r JOIN n USING (source))"""


def _split(spark, sf):
    return split.stratified_split(table(spark, sf, "documents"), "doc_id", 42, 0.2, 100)


@query(f"WITH {SQL_SPLIT} SELECT * FROM sp")
def stratified_split(spark, sf):
    return _split(spark, sf)


@query(f"""WITH {SQL_SPLIT}, a AS (SELECT coalesce(source, 'TOTAL') AS source, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'eval') AS n_eval FROM sp GROUP BY ROLLUP (source))
SELECT source, n_train, n_eval, 0::BIGINT AS n_both, round(n_eval / (n_train + n_eval), 6) AS fraction FROM a""")
def split_counts(spark, sf):
    return split.split_summary(_split(spark, sf))


@query(f"""WITH {SQL_SPLIT}, two AS (SELECT source, id, split FROM sp UNION ALL SELECT source, id, 'train' FROM sp WHERE split = 'eval' AND id % 3 = 0),
b AS (SELECT source, id, count(*) FILTER (WHERE split = 'train') AS t, count(*) FILTER (WHERE split = 'eval') AS e FROM two GROUP BY source, id),
a AS (SELECT coalesce(source, 'TOTAL') AS source, sum(t)::BIGINT AS n_train, sum(e)::BIGINT AS n_eval, count(*) FILTER (WHERE t > 0 AND e > 0) AS n_both FROM b GROUP BY ROLLUP (source))
SELECT source, n_train, n_eval, n_both, round(n_eval / (n_train + n_eval), 6) AS fraction FROM a""")
def split_disjointness(spark, sf):
    """The check on a split that isn't one: every third held-out id also stands among the training ids."""
    s = _split(spark, sf)
    return split.split_summary(s.union(s.where("split = 'eval' AND id % 3 = 0").withColumn("split", F.lit("train"))))


@query("""SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)) ORDER BY sha256('42007:' || doc_id), doc_id LIMIT 3000""")
def distractor_sample(spark, sf):
    return split.distractors(table(spark, sf, "documents"), relevance(spark, sf).select(F.col("id").alias("doc_id")), "doc_id", 3000)


_SURFACE = """WITH q AS (SELECT DISTINCT b.item_id AS qid, d.doc_id AS id FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
n AS (SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT id FROM q) ORDER BY sha256('42007:' || doc_id), doc_id LIMIT 3000),
c AS (SELECT id FROM q UNION SELECT id FROM n)
SELECT c.id, length(text)::BIGINT AS n_chars, (SELECT count(*) FROM q WHERE q.id = c.id) AS n_queries FROM c JOIN documents ON doc_id = c.id"""


@query(_SURFACE)
def eval_surface(spark, sf):
    """The held-out corpus: all positives and the distractors, with their texts; a missing text is an error."""
    q = stored(relevance(spark, sf))
    c = q.select("id").union(split.distractors(table(spark, sf, "documents"), q.select(F.col("id").alias("doc_id")), "doc_id", 3000)).distinct()
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    text = F.when(F.col("text").isNotNull(), F.col("text")).otherwise(F.raise_error(F.lit("a document has no text")))
    n = q.groupBy("id").agg(F.count("*").alias("n_queries"))
    return c.join(docs, "id", "left").join(n, "id", "left").select("id", F.length(text).cast("bigint").alias("n_chars"), F.coalesce("n_queries", F.lit(0)).alias("n_queries"))


SQL_WIN = """
sz AS (SELECT source, count(*) AS size FROM documents GROUP BY source),
wn AS (SELECT source, k * 16 AS start, 16 AS n FROM sz, LATERAL (SELECT unnest(range(0, size // 16)) AS k))"""


def _windows(spark, sf):
    return split.batch_windows(schedule.sizes(table(spark, sf, "documents")), 16)


@query(f"WITH {SQL_WIN} SELECT source, start::BIGINT AS start, n::BIGINT AS n FROM wn")
def batch_plan(spark, sf):
    return _windows(spark, sf)


@query(f"""WITH {SQL_WIN}, o AS (SELECT source, start, row_number() OVER (ORDER BY sha256('45:' || source || ':' || start), source, start) - 1 AS p, count(*) OVER () AS total FROM wn)
SELECT (p // 3)::BIGINT AS step, (p % 3)::BIGINT AS rank, source, start::BIGINT AS start FROM o WHERE p // 3 < total // 3""")
def rank_shards(spark, sf):
    return split.rank_plan(_windows(spark, sf), epoch=3, world=3, seed=42)


@query(f"WITH {SQL_WIN} SELECT ((SELECT sum(size // 16) FROM sz) // 3)::BIGINT AS steps")
def step_counts(spark, sf):
    return split.step_count(schedule.sizes(table(spark, sf, "documents")), 16, 3)


@query(f"WITH {SQL_WIN}, b AS (SELECT source, count(*) AS batches FROM wn GROUP BY source) SELECT source, batches, round(batches / sum(batches) OVER (), 6) AS fraction FROM b")
def source_distribution(spark, sf):
    return split.source_distribution(_windows(spark, sf))


@query("""SELECT i AS step, round(CASE WHEN i < 100 THEN 0.2 * i / 100 ELSE 0.2 * greatest(0.0, (1000 - i) / 900.0) END, 9) AS lr FROM range(0, 1000) t(i)""")
def lr_schedule(spark, sf):
    return split.learning_rates(spark, 1000, 0.2, 0.1)


@query(f"""WITH {SQL_SCORES}, ng AS (SELECT query_id, id, k - 1 AS j FROM el WHERE n_eligible >= 50 AND k <= 50),
h AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY sha256('42:' || query_id || ':' || j), id) AS rn FROM ng)
SELECT query_id, string_agg(id::VARCHAR, ',' ORDER BY rn) AS sampled FROM h WHERE rn <= 7 GROUP BY query_id""")
def negative_sample(spark, sf):
    x = split.sample_negatives(_mined(spark, sf).where("n_eligible >= 50"), "query_id", "negatives", 7)
    return x.select("query_id", F.array_join(F.transform("sampled", lambda v: v.cast("string")), ",").alias("sampled"))


@query("""SELECT source, ('0x' || substr(sha256('42:' || source), 9, 8))::BIGINT AS source_seed, (('0x' || substr(sha256('42:3:' || source || ':1024'), 1, 16))::UBIGINT)::VARCHAR AS batch_seed FROM (SELECT DISTINCT source FROM documents)""")
def seeds(spark, sf):
    s = table(spark, sf, "documents").select("source").distinct()
    return s.select("source", T.source_seed(42, F.col("source")).alias("source_seed"), T.batch_seed(42, F.lit(3), F.col("source"), F.lit(1024)).alias("batch_seed"))


@query("""WITH u AS (SELECT DISTINCT text FROM documents), i AS (SELECT text, min(doc_id) AS least_id, count(*) AS n FROM documents GROUP BY text) SELECT d.doc_id, i.least_id, i.n AS copies FROM documents d JOIN i USING (text)""")
def encode_once(spark, sf):
    """Which row stands for each text, so that a costly step runs once per text; shuffled by a digest, not by the text."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.join(d.groupBy("h").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies")), "h").select("doc_id", "least_id", "copies")


@query("""WITH t AS (SELECT doc_id FROM labels), d AS (SELECT doc_id FROM documents WHERE n_chars > 2000) SELECT
 (SELECT count(*) FROM (SELECT doc_id FROM t INTERSECT SELECT doc_id FROM d)) AS n_both, (SELECT count(*) FROM (SELECT doc_id FROM t EXCEPT SELECT doc_id FROM d)) AS n_only_left,
 (SELECT count(*) FROM (SELECT doc_id FROM t UNION SELECT doc_id FROM d)) AS n_any, NOT EXISTS (SELECT doc_id FROM t WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS subset""")
def set_checks(spark, sf):
    docs = table(spark, sf, "documents")
    both = table(spark, sf, "labels").select("doc_id", F.lit(1).alias("l"), F.lit(0).alias("r"), F.lit(0).alias("a")).union(docs.select("doc_id", F.lit(0), (F.col("n_chars") > 2000).cast("int"), F.lit(1)))
    x = both.groupBy("doc_id").agg(F.max("l").alias("l"), F.max("r").alias("r"), F.max("a").alias("a"))  # one pass for all four
    return x.agg(F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("n_both"), F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("n_only_left"), F.count_if((F.col("l") == 1) | (F.col("r") == 1)).alias("n_any"), (F.count_if((F.col("l") == 1) & (F.col("a") == 0)) == 0).alias("subset"))


@query("WITH x AS (SELECT doc_id, source, source IN ('src0', 'src1') OR lang = 'fr' AS policy FROM documents) SELECT source, count(DISTINCT policy) AS n_policies, bool_and(policy) AS policy FROM x GROUP BY source")
def policy_check(spark, sf):
    x = table(spark, sf, "documents").select("source", (F.col("source").isin("src0", "src1") | (F.col("lang") == "fr")).alias("policy"))
    return x.groupBy("source").agg(F.countDistinct("policy").alias("n_policies"), F.every("policy").alias("policy"))


@query(_SQL_TIERS + f""", {SQL_ROWS}, h AS (SELECT source, max(CASE WHEN tier = 'xs' THEN take_rows END) AS have, max(CASE WHEN tier = 'full' THEN take_rows END) AS want FROM tt GROUP BY source)
SELECT source, doc_id, row_idx::BIGINT AS row_idx FROM rows JOIN h USING (source) WHERE row_idx >= have AND row_idx < want""")
def incremental_upgrade(spark, sf):
    """What the full tier adds to the rows that the smallest one has."""
    rows, tiers = _rows(spark, sf), _tiers(spark, sf)
    have = schedule.prefix(rows, tiers, "xs")
    return incremental.upgrade(rows, have, tiers, "full").select("source", "doc_id", "row_idx")


@query("WITH p AS (SELECT DISTINCT item_id AS query_id FROM benchmark) SELECT query_id AS id, row_number() OVER (ORDER BY query_id) - 1 AS rank FROM p UNION ALL SELECT DISTINCT doc_id, dense_rank() OVER (ORDER BY doc_id) - 1 FROM documents")
def dense_ids(spark, sf):
    a, b = (split.dense_ids(table(spark, sf, t), c) for t, c in (("benchmark", "item_id"), ("documents", "doc_id")))
    return a.union(b)


_SQL_TRIPLES = f"""WITH {SQL_VOCAB},
p AS (SELECT item_id AS query_id, min(doc_id) AS positive FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id),
n AS (SELECT query_id, positive, j, (positive + 17 * j) % (SELECT max(doc_id) + 1 FROM documents) AS id FROM p, (SELECT unnest(range(1, 4)) AS j)),
t AS (SELECT d.doc_id AS id, coalesce(string_agg(token_id::VARCHAR, '-' ORDER BY i), '') AS ids FROM (SELECT doc_id, unnest({TOKENS}) AS tok, generate_subscripts({TOKENS}, 1) AS i FROM documents) x LEFT JOIN vocab USING (tok) RIGHT JOIN documents d ON d.doc_id = x.doc_id GROUP BY d.doc_id)"""
_SQL_TRIPLES = _SQL_TRIPLES.replace("string_agg(token_id::VARCHAR", "string_agg(CASE WHEN i IS NOT NULL THEN coalesce(token_id, 0)::VARCHAR END")


@query(_SQL_TRIPLES + """ SELECT p.query_id, p.positive, a.ids AS positive_ids, string_agg(c.ids, ',' ORDER BY n.j) AS negative_ids
FROM p JOIN t a ON a.id = p.positive JOIN n USING (query_id, positive) JOIN t c ON c.id = n.id GROUP BY p.query_id, p.positive, a.ids""")
def triples(spark, sf):
    """Each item that a document contains, the first such document, and three others by a rule: their tokens, encoded once, brought to the pairs."""
    docs = encoded(spark, sf)
    top = table(spark, sf, "documents").agg(F.max("doc_id")).first()[0] + 1
    pairs = relevance(spark, sf).groupBy(F.col("qid").alias("query_id")).agg(F.min("id").alias("positive"))
    pairs = pairs.withColumn("negatives", F.transform(F.sequence(F.lit(1), F.lit(3)), lambda j: (F.col("positive") + 17 * j) % top))
    x = split.gather_triples(pairs, encoded(spark, sf, "benchmark", "item_id"), docs, 3)

    def text(c):
        return F.array_join(F.transform(c, lambda i: i.cast("string")), "-")

    return x.select("query_id", "positive", text(F.col("positive_ids")).alias("positive_ids"), F.array_join(F.transform("negative_ids", text), ",").alias("negative_ids"))


# Result tables ---------------------------------------------------------------------------------------------------

#: The published points, as (slug, size in MB, tokens a second, quality).
POINTS = [
    ("fp32-dim-1024", 125.02, 7545581, 0.474926), ("fp32-dim-128", 15.63, 9521761, 0.440249), ("fp32-dim-256", 31.25, 9317021, 0.462411), ("fp32-dim-512", 62.51, 8805278, 0.469748),
    ("fp32-dim-64", 7.81, 9671980, 0.414774), ("int2-row-1024", 7.94, 8318109, 0.418488), ("int2-row-512", 4.03, 9013426, 0.419512), ("int4-dim-1024", 15.63, 8557591, 0.465777),
    ("int4-dim-128", 1.95, 9425513, 0.431234), ("int4-dim-256", 3.91, 9473004, 0.449802), ("int4-dim-512", 7.82, 9033115, 0.462941), ("int4-row-512", 7.94, 8757383, 0.469662),
    ("int8-dim-1024", 31.26, 8430565, 0.474720), ("int8-dim-128", 3.91, 9732201, 0.438987), ("int8-dim-256", 7.82, 9383756, 0.462428), ("int8-dim-512", 15.63, 9047456, 0.469988), ("int8-row-256", 7.94, 9440706, 0.462324),
]
_SQL_POINTS = "p(slug, size_mb, tok_s, ndcg12) AS (VALUES " + ", ".join(f"('{s}', {m}::DOUBLE, {t}::BIGINT, {n}::DOUBLE)" for s, m, t, n in POINTS) + ")"
_PATTERN = r"^(fp|int)(\d+)-(dim|row)-(\d+)"
_SQL_SLUG = f"regexp_extract(slug, '{_PATTERN}', 2)::INTEGER AS bits, regexp_extract(slug, '{_PATTERN}', 3) AS axis, regexp_extract(slug, '{_PATTERN}', 4)::INTEGER AS dim"


def points(spark):
    return spark.createDataFrame(POINTS, "slug string, size_mb double, tok_s bigint, ndcg12 double")


@query(f"WITH {_SQL_POINTS} SELECT slug, {_SQL_SLUG}, slug AS built FROM p")
def slug_parse(spark, sf):
    x = points(spark).select("slug", *T.parse_slug(F.col("slug")))
    return x.withColumn("built", T.slug(F.col("bits"), F.col("axis"), F.col("dim")))


@query(f"WITH {_SQL_POINTS} SELECT slug, tok_s, ndcg12 FROM p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.tok_s > p.tok_s AND o.ndcg12 > p.ndcg12)")
def pareto_frontier(spark, sf):
    return retrieval.pareto(points(spark)).select("slug", "tok_s", "ndcg12")


@query(f"WITH {_SQL_POINTS} SELECT slug, {_SQL_SLUG}, t.size_mb, t.tok_s, q.ndcg12 FROM p t JOIN (SELECT slug, ndcg12 FROM p WHERE size_mb > 5) q USING (slug)")
def quality_throughput_join(spark, sf):
    p = points(spark)
    return p.select("slug", *T.parse_slug(F.col("slug")), "size_mb", "tok_s").join(p.where("size_mb > 5").select("slug", "ndcg12"), "slug")


#: Made-up results: quality of three tasks at three dimensions, one missing.
RESULTS = [("fever", 512, 0.47, 6571), ("fever", 256, 0.45, 6571), ("nq", 512, 0.71, 26), ("nq", 256, 0.69, 26), ("scifact", 512, 0.80, 41), ("scifact", 256, None, 41)]
_SQL_RESULTS = "r(task, dim, ndcg, n_queries) AS (VALUES " + ", ".join(f"('{t}', {d}, {'NULL' if v is None else v}::DOUBLE, {n}::BIGINT)" for t, d, v, n in RESULTS) + ")"


def results(spark):
    return spark.createDataFrame(RESULTS, "task string, dim int, ndcg double, n_queries bigint")


@query(f"WITH {_SQL_RESULTS} SELECT dim, round(avg(ndcg), 6) AS mean, round(sum(ndcg * n_queries) / sum(CASE WHEN ndcg IS NOT NULL THEN n_queries END), 6) AS weighted_mean FROM r GROUP BY dim")
def weighted_means(spark, sf):
    return retrieval.weighted_means(results(spark))


@query(f"WITH {_SQL_RESULTS} SELECT dim, round(avg(ndcg) FILTER (WHERE task NOT IN ('climate-fever', 'fever')), 6) AS mean_headline, round(avg(ndcg), 6) AS mean_all FROM r GROUP BY dim")
def headline_means(spark, sf):
    return retrieval.task_means(results(spark))


@query(f"WITH {_SQL_RESULTS} SELECT task, max(CASE WHEN dim = 512 THEN ndcg END) AS dim_512, max(CASE WHEN dim = 256 THEN ndcg END) AS dim_256 FROM r GROUP BY task")
def pivot_summary(spark, sf):
    return retrieval.pivot(results(spark), [512, 256])


@query(f"WITH {_SQL_POINTS}, m AS (SELECT {_SQL_SLUG}, ndcg12 AS value FROM p) SELECT bits, axis, dim, value, value - 0.0005 * (dim / 256) AS expected, round(value - (value - 0.0005 * (dim / 256)), 6) AS delta, abs(value - (value - 0.0005 * (dim / 256))) < 0.001 AS ok FROM m")
def metric_deltas(spark, sf):
    m = points(spark).select(*T.parse_slug(F.col("slug")), F.col("ndcg12").alias("value"))
    return retrieval.deltas(m, m.withColumn("value", F.col("value") - 0.0005 * (F.col("dim") / 256)), ["bits", "axis", "dim"])


SQL_PAIRS = "pr AS (SELECT a.vec_id // 32 AS batch, a.vec_id // 2 AS i, list_transform(a.embedding[1:{d}], lambda x: x::DOUBLE) AS q, list_transform(b.embedding[1:{d}], lambda x: x::DOUBLE) AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)"


def _sql_loss(d: int) -> str:
    return f"""SELECT batch, avg(top + ln(lse) - own) AS loss FROM (
 SELECT s.batch, s.i, max(top) AS top, sum(exp(s - top)) AS lse, max(CASE WHEN i = j THEN s END) AS own FROM (
  SELECT x.batch, x.i, y.i AS j, 20 * list_cosine_similarity(x.q, y.v) AS s, max(20 * list_cosine_similarity(x.q, y.v)) OVER (PARTITION BY x.batch, x.i) AS top
  FROM (WITH {SQL_PAIRS.format(d=d)} SELECT * FROM pr) x JOIN (WITH {SQL_PAIRS.format(d=d)} SELECT * FROM pr) y ON x.batch = y.batch) s GROUP BY s.batch, s.i) g GROUP BY batch"""


def _pairs(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    p = e.groupBy(F.expr("vec_id div 2").alias("i")).agg(F.min_by("embedding", "vec_id").alias("q"), F.max_by("embedding", "vec_id").alias("d"), F.count("*").alias("n"))
    return p.where("n = 2").select(F.expr("i div 16").alias("batch"), "i", "q", "d")


@query(f"SELECT batch, round(loss, 6) AS loss FROM ({_sql_loss(64)}) z")
def infonce_loss(spark, sf):
    return retrieval.in_batch_loss(_pairs(spark, sf)).select("batch", F.round("loss", 6).alias("loss"))


_SQL_HARD = f"""pr AS (SELECT a.vec_id // 32 AS batch, a.vec_id // 2 AS i, a.embedding::DOUBLE[] AS q, b.embedding::DOUBLE[] AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0),
cand AS (SELECT batch, i AS j, v FROM pr UNION ALL SELECT batch, NULL, list_reverse(v) FROM pr UNION ALL SELECT batch, NULL, list_reverse(q) FROM pr),
s AS (SELECT pr.batch, i, j, 20 * list_cosine_similarity(q, cand.v) AS s FROM pr JOIN cand ON pr.batch = cand.batch),
t AS (SELECT batch, i, max(s) AS top, max(CASE WHEN i = j THEN s END) AS own FROM s GROUP BY batch, i),
l AS (SELECT s.batch, s.i, max(top) + ln(sum(exp(s - top))) - max(own) AS loss FROM s JOIN t ON s.batch = t.batch AND s.i = t.i GROUP BY s.batch, s.i)"""


@query(f"WITH {_SQL_HARD} SELECT batch, round(avg(loss), 6) AS loss FROM l GROUP BY batch")
def infonce_loss_hard(spark, sf):
    """With two negatives of each pair's own, which all of the batch meet."""
    p = _pairs(spark, sf).withColumn("negatives", F.array(F.reverse("d"), F.reverse("q")))
    return retrieval.in_batch_loss(p).select("batch", F.round("loss", 6).alias("loss"))


@query(f"WITH z AS ({_sql_loss(64)}), r AS (SELECT batch // 4 AS step, batch % 4 % 3 AS rank, avg(loss) AS loss FROM z GROUP BY ALL) SELECT step, round(avg(loss), 6) AS loss FROM r GROUP BY step")
def rank_mean_loss(spark, sf):
    """Batches dealt to three ranks, one of which has two of each four."""
    x = retrieval.in_batch_loss(_pairs(spark, sf)).select(F.expr("batch div 4").alias("step"), (F.col("batch") % 4 % 3).alias("rank"), "loss")
    return retrieval.rank_mean(x).select("step", F.round("loss", 6).alias("loss"))


@query(f"SELECT batch, round(avg(loss), 6) AS loss FROM ({' UNION ALL '.join(_sql_loss(d) for d in (64, 32, 16))}) z GROUP BY batch")
def matryoshka_loss(spark, sf):
    return retrieval.matryoshka_loss(_pairs(spark, sf), {64: 1.0, 32: 1.0, 16: 1.0}).select("batch", F.round("loss", 6).alias("loss"))


_TOLERANCE = 0.002


@query(f"""WITH {SQL_VOCAB}, {SQL_W}, {SQL_UNIT.format(p='', dim=64)}, {_sql_codes(8, 'dim')},
qp AS (SELECT id, d, sum(c * code) * max(scale)::DOUBLE / sum(c) AS x FROM bag JOIN cd ON cd.token_id = bag.t GROUP BY id, d), qn AS (SELECT id, sqrt(sum(x * x)) AS n FROM qp GROUP BY id),
df AS (SELECT unit.id, max(abs(unit.x - qp.x / CASE WHEN qn.n < 1.1920928955078125e-07 THEN 1 ELSE qn.n END)) AS worst FROM unit JOIN qp ON qp.id = unit.id AND qp.d + 1 = unit.d JOIN qn ON qn.id = unit.id GROUP BY unit.id)
SELECT count(*) AS n_rows, count(*) FILTER (WHERE worst <= {_TOLERANCE}) AS n_ok, round(max(worst), 6) AS worst FROM df""")
def embedding_parity(spark, sf):
    """Every document's vector by 8-bit codes against the one by 32-bit floats, in their greatest difference."""
    codes, scales = embed.quantized_weights(quantize.quantize(weights(spark, sf), 8, "dim"), "dim")
    a = vectors(spark, sf).select("id", F.col("embedding").alias("a"))
    b = embed.embed_texts(table(spark, sf, "documents"), words_of(spark, sf), codes, "doc_id", scales=scales).select("id", F.col("embedding").alias("b"))
    worst = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y)))
    return a.join(b, "id").select(worst.alias("w")).agg(F.count("*").alias("n_rows"), F.count_if(F.col("w") <= _TOLERANCE).alias("n_ok"), F.round(F.max("w"), 6).alias("worst"))


_SQL_ARTIFACTS = """s AS (SELECT count(*) AS v, max(len(embedding)) AS d FROM embeddings),
m AS (SELECT bits, axis, fault, 'int' || bits || '_' || axis || '_' || fault AS artifact, v AS vocab, d, v - CASE WHEN fault = 'rows' THEN 1 ELSE 0 END AS n_rows,
 (d * bits + 7) // 8 + CASE WHEN fault = 'bytes' THEN 1 ELSE 0 END AS row_bytes, CASE WHEN axis = 'row' THEN v ELSE d END - CASE WHEN fault = 'scales' THEN 1 ELSE 0 END AS n_scales
 FROM s, (VALUES (8), (4), (2)) b(bits), (VALUES ('row'), ('dim')) a(axis), (VALUES ('none'), ('rows'), ('bytes'), ('scales')) f(fault)),
e AS (SELECT artifact, concat_ws('; ', CASE WHEN bits = 2 AND axis = 'dim' THEN 'two bits by dimension are not deployed' END, CASE WHEN vocab <> n_rows THEN 'rows differ from the vocabulary' END,
 CASE WHEN (d * bits + 7) // 8 <> row_bytes THEN 'wrong bytes to a row' END, CASE WHEN CASE WHEN axis = 'row' THEN vocab ELSE d END <> n_scales THEN 'wrong number of scales' END) AS errors FROM m)"""


@query(f"WITH {_SQL_ARTIFACTS} SELECT artifact, errors = '' AS ok, errors FROM e")
def artifact_validate(spark, sf):
    """The weight table as artifacts of six variants, sound and with a row, a byte or a scale amiss."""
    size = weights(spark, sf).agg(F.count("*").alias("v"), F.max(F.size("vec")).cast("bigint").alias("d"))
    kinds = spark.createDataFrame([(b, a, f) for b in (8, 4, 2) for a in ("row", "dim") for f in ("none", "rows", "bytes", "scales")], "bits bigint, axis string, fault string")
    x = kinds.crossJoin(size)  # one row

    def amiss(fault: str):
        return F.when(F.col("fault") == fault, 1).otherwise(0)

    meta = F.create_map(*(c for k, v in (("bits", "bits"), ("axis", "axis"), ("dim", "d"), ("vocab_size", "v"), ("variant", "axis"), ("tokenizer", "axis")) for c in (F.lit(k), F.col(v).cast("string"))))
    x = x.select(F.concat(F.lit("int"), F.col("bits").cast("string"), F.lit("_"), F.col("axis"), F.lit("_"), F.col("fault")).alias("artifact"), meta.alias("metadata"), (F.col("v") - amiss("rows")).alias("n_rows"),
                 (F.expr("(d * bits + 7) div 8") + amiss("bytes")).alias("row_bytes"), (F.when(F.col("axis") == "row", F.col("v")).otherwise(F.col("d")) - amiss("scales")).alias("n_scales"))
    return quantize.artifact_errors(x)


# Sweeps, streams and library tokenizers --------------------------------------------------------------------------


@query("""SELECT b.bits, CASE WHEN b.bits = 32 THEN NULL ELSE a.axis END AS axis, d.dim, CASE WHEN b.bits = 32 THEN 'fp32' ELSE 'int' || b.bits || '_' || a.axis END AS name
FROM (VALUES (1024), (512), (256), (128), (64), (32)) d(dim), (VALUES (32), (8), (4), (3), (2)) b(bits), (VALUES ('row'), ('dim'), ('hybrid')) a(axis) WHERE b.bits < 32 OR a.axis = 'dim'""")
def sweep_grid(spark, sf):
    return sweep.grid(spark, sweep.cells())


_CELLS = sweep.cells(dims=(64, 32))


def _sql_cell(bits: int, axis: str | None, dim: int) -> str:
    """NDCG@10 of one cell, over the tokens and relevant pairs that all cells share."""
    raw = f"raw AS (SELECT * FROM (SELECT vec_id AS token_id, unnest(embedding)::FLOAT AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings) WHERE d < {dim})"
    if bits == 32:
        w = f"{raw}, w AS (SELECT token_id AS t, x::DOUBLE AS x, d + 1 AS d FROM raw)"
    elif axis == "hybrid":
        q = 2 ** (bits - 1) - 1
        w = f"""{raw}, tp AS (SELECT token_id, greatest(max(abs(x)), 1.1754943508222875e-38::FLOAT) AS top FROM raw GROUP BY token_id), e AS (SELECT token_id, d, top, (x::DOUBLE / top::DOUBLE)::FLOAT AS x FROM raw JOIN tp USING (token_id)),
{_sql_scale(bits, 'dim')}, w AS (SELECT token_id AS t, ((greatest(-{q}, least({q}, round_even((x::DOUBLE / scale::DOUBLE)::FLOAT::DOUBLE, 0)::INTEGER)) * scale)::FLOAT * top)::FLOAT::DOUBLE AS x, d + 1 AS d FROM e JOIN sc USING (d))"""
    else:
        w = f"{_sql_codes(bits, axis).replace(SQL_E, raw.replace('raw AS', 'e AS', 1))}, w AS (SELECT token_id AS t, (code * scale)::FLOAT::DOUBLE AS x, d + 1 AS d FROM cd)"
    ranked_ = SQL_RANKED.split("qrels AS")[0].rstrip().rstrip(",")
    return f"""SELECT {bits} AS bits, {f"'{axis}'" if axis else 'NULL'} AS axis, {dim} AS dim, round(avg(coalesce(dcg, 0) / ideal), 6) AS ndcg10 FROM (
 WITH {w}, {SQL_UNIT.format(p='', dim=dim)}, {SQL_UNIT.format(p='q', dim=dim)}, {ranked_}
 SELECT ideal, dcg FROM rel LEFT JOIN (SELECT qid, sum(1 / log2(rank + 1)) AS dcg FROM ranked JOIN qrels USING (qid, id) WHERE rank <= 10 GROUP BY qid) USING (qid)) s"""


def _sql_cells(wanted) -> str:
    shared = SQL_VOCAB.replace("bag AS (", "bag AS MATERIALIZED (").replace("qbag AS MATERIALIZED (", "qbag AS MATERIALIZED (")
    return f"""WITH {shared}, qrels AS MATERIALIZED (SELECT DISTINCT b.item_id AS qid, d.doc_id AS id FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
rel AS MATERIALIZED (SELECT qid, n_rel, (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n_rel, 10) + 1) r(i)) AS ideal FROM (SELECT qid, count(*) AS n_rel FROM qrels GROUP BY qid)), cells AS ({' UNION ALL '.join(_sql_cell(*c) for c in wanted)})"""


def _evaluated(spark, sf):
    c = encoded(spark, sf).where(F.size("ids") > 0)
    q = encoded(spark, sf, "benchmark", "item_id").where(F.size("ids") > 0).withColumnRenamed("id", "qid")
    return weights(spark, sf), c, q, stored(relevance(spark, sf))


@query(_sql_cells(_CELLS) + " SELECT * FROM cells")
def quant_sweep(spark, sf):
    """Every cell of the grid at the dimensions that the weights have."""
    return sweep.evaluate(*_evaluated(spark, sf), _CELLS)


_GROUPS = sweep.scaled(64)


@query(_sql_cells([c for g in _GROUPS.values() for c in g]) + ", g(\"group\", bits, axis, dim) AS (VALUES " + ", ".join(f"('{g}', {b}, '{a}', {d})" for g, cs in _GROUPS.items() for b, a, d in cs) + """)
SELECT "group", 'int' || bits || '-' || axis || '-' || dim AS slug, bits, axis, dim, ndcg10 FROM g JOIN cells USING (bits, axis, dim)""")
def deployment_groups(spark, sf):
    """The deployed variants, at the same shares of the weights' dimension."""
    return sweep.deployment(*_evaluated(spark, sf), _GROUPS)


def _sql_heldout(dim: int) -> str:
    return f"""SELECT source, {dim}::BIGINT AS dim, count(*) AS n_queries, round(avg(coalesce(dcg, 0) / ideal), 6) AS ndcg10 FROM (
 WITH {SQL_W}, {SQL_UNIT.format(p='', dim=dim)}, {SQL_UNIT.format(p='q', dim=dim)}, sims AS (SELECT q.id AS qid, u.id, round(sum(q.x * u.x), 9) AS score FROM qunit q JOIN unit u USING (d) GROUP BY q.id, u.id),
 ranked AS (SELECT source, qid, id, row_number() OVER (PARTITION BY source, qid ORDER BY score DESC, id) AS rank FROM sims JOIN documents ON doc_id = id)
 SELECT source, qid, ideal, dcg FROM rel LEFT JOIN (SELECT source, qid, sum(1 / log2(rank + 1)) AS dcg FROM ranked JOIN qrels USING (source, qid, id) WHERE rank <= 10 GROUP BY source, qid) USING (source, qid)) s GROUP BY source"""


_HELDOUT_DIMS = (64, 32, 16)
_SQL_HELDOUT = f"""WITH {SQL_VOCAB}, qrels AS MATERIALIZED (SELECT DISTINCT source, b.item_id AS qid, d.doc_id AS id FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
rel AS MATERIALIZED (SELECT source, qid, n_rel, (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n_rel, 10) + 1) r(i)) AS ideal FROM (SELECT source, qid, count(*) AS n_rel FROM qrels GROUP BY source, qid)),
h AS MATERIALIZED ({' UNION ALL '.join(_sql_heldout(d) for d in _HELDOUT_DIMS)})"""


def _heldout(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    d, q = stored(vectors(spark, sf).join(docs, "id")), vectors(spark, sf, "benchmark", "item_id").withColumnRenamed("id", "qid")
    qrels = stored(relevance(spark, sf).join(docs, "id").select("source", "qid", "id"))
    return retrieval.by_part(d, q, qrels, "source", _HELDOUT_DIMS)


@query(_SQL_HELDOUT + """, c AS (SELECT source, count(*) AS n_corpus FROM documents GROUP BY source), n AS (SELECT source, count(*) AS n_qrels FROM qrels GROUP BY source)
SELECT source, dim, n_corpus, n_queries, n_qrels, ndcg10 FROM h JOIN c USING (source) JOIN n USING (source)""")
def heldout_by_source(spark, sf):
    """Each source's own corpus searched by the queries that it answers, at several dimensions."""
    docs = table(spark, sf, "documents")
    n = relevance(spark, sf).join(docs.select(F.col("doc_id").alias("id"), "source"), "id").groupBy("source").agg(F.count("*").alias("n_qrels"))
    return _heldout(spark, sf).join(docs.groupBy("source").agg(F.count("*").alias("n_corpus")), "source").join(n, "source").select("source", "dim", "n_corpus", "n_queries", "n_qrels", "ndcg10")


@query(_SQL_HELDOUT + " SELECT dim, round(avg(ndcg10), 6) AS mean, round(sum(ndcg10 * n_queries) / sum(n_queries), 6) AS weighted_mean FROM h GROUP BY dim")
def heldout_means(spark, sf):
    return retrieval.weighted_means(_heldout(spark, sf).select("dim", F.col("ndcg10").alias("ndcg"), "n_queries"))


@query()
def wordpiece_encode(spark, sf):
    """Ids of a tokenizer file, if one is installed; no SQL has its merges."""
    import public_tokenizers as P

    x = embed.wordpiece(table(spark, sf, "documents").select("doc_id", "text"), P.path("word_bpe_49k.json"))
    return x.select("doc_id", F.size("ids").alias("n_tokens"))


@query(f"SELECT doc_id, source, len({TOKENS})::INTEGER AS n_tokens FROM documents")
def stream_incremental(spark, sf):
    """All documents through a stream that runs what is there and stops; the result is what was appended."""
    import uuid

    from ..session import shared_dir
    from ..streaming.incremental import tokenized_stream

    out = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents")
    vocab = words_of(spark, sf)
    # A pattern, as a stream's path must be a folder or a pattern and the table may be one file.
    tokenized_stream(spark, f"{sf}/documents.parque[t]", docs.schema, vocab, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows").select("doc_id", "source", F.size("ids").alias("n_tokens"))
