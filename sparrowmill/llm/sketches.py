"""Document fingerprints: invertible Bloom lookup sketches, in DataFrame and SQL functions alone.

A text's paragraphs are its stretches between line ends and sentence ends, of 96 characters at most, counted from
their beginning. Each paragraph's 64-bit digest goes to three cells, one in each third of the sketch, that hold a
count, the digests' XOR and the XOR of their checks. Two versions' fingerprints subtract cell by cell; what is common
cancels, and peeling (a cell with one digest gives it away and frees two others) recovers the digests that differ.
If cells are left, the pair is tried again with a larger sketch: as many fingerprints side by side as keep DENSE
digests each, a digest's leading bits say which; one that still doesn't peel is doubled, by one more bit, until all do.
Different digests differ in a bit, so that ends, and nothing is estimated. From the number of recovered digests follows
the likeness, the Jaccard coefficient of the paragraphs.

All of this happens within a row, so the text is shuffled once, to stand beside its successor, and nothing else is.

Defined cases: a null text is empty and has an empty sketch; two empty ones are alike (1.0); a text of line and
sentence ends alone has its own digest as its only paragraph; repeated paragraphs count once; very long texts make
larger sketches in the comparison, the fingerprint's size is fixed. Rows of one id stand in the order of their texts; a
row without an id has no place in the order and is its own successor. Ids are integers, others are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Cells in a third of the fingerprint (a power of two), and signed digests for which a sketch of that size is tried again.
THIRD, DENSE = 16, 24
#: Bits of a digest from which its cell in each third is read; the others, in this order, deal it to larger sketches, then these.
PLACES = (0, 20, 40)
SPLITS = (*range(63, 43, -1), *range(39, 23, -1), *range(19, 3, -1), *range(43, 39, -1), *range(23, 19, -1), *range(3, -1, -1))

#: The masked bits of a digest that each cell wants, third by third; to sort many digests the upper two of four bits are read first.
_CELLS = "array(" + ", ".join(f"named_struct('m', {(THIRD - 1) << p}L, 'v', {v << p}L, 'h', {1 << THIRD * j + v}L)" for j, p in enumerate(PLACES) for v in range(THIRD)) + ")"
_UPPER = "array(" + ", ".join(f"named_struct('m', {12 << p}L, 'v', {v << p}L, 'low', array({', '.join(f"named_struct('m', {3 << p}L, 'v', {w << p}L)" for w in range(4))}))" for p in PLACES for v in range(0, THIRD, 4)) + ")"
_EMPTY = "named_struct('n', 0, 'k', 0L, 'c', 0L)"
_CHECK = "(xxhash64({0}) & 4294967295)"


def _let(value: str, name: str, body: str) -> str:
    """SQL: `body` with `name` for `value`, which is computed once and, as an aggregate's start, not copied."""
    return f"aggregate(array_repeat(0, 0), {value}, ({name}, none) -> {name}, {name} -> {body})"


def paragraphs(text: str) -> str:
    """SQL: the distinct digests of `text`'s paragraphs."""
    units = rf"array_distinct(transform(filter(regexp_extract_all({text}, '[^.!?\\n]{{1,96}}', 0), x -> trim(x) <> ''), x -> xxhash64(trim(x))))"
    return f"CASE WHEN {text} = '' THEN CAST(array() AS array<bigint>) WHEN trim(translate({text}, '.!?\\n', '')) = '' THEN array(xxhash64({text})) ELSE {units} END"


def signed(digests: str, n: int) -> str:
    """SQL: digests as cells of their own, each counted `n` times."""
    return f"transform({digests}, k -> named_struct('n', {n}, 'k', k, 'c', {_CHECK.format('k')}))"


def _put(items: str, cell: str, at: str) -> str:
    """SQL: `cell` and those of `items` whose bits are those of `at`, taken together."""
    return f"aggregate({items}, {cell}, (a, x) -> IF((x.k & {at}.m) = {at}.v, named_struct('n', a.n + x.n, 'k', a.k ^ x.k, 'c', a.c ^ x.c), a))"


def cells(items: str) -> str:
    """SQL: the sketch of signed digests: an array of cells (n, k, c), third by third."""
    return f"flatten(transform({_UPPER}, u -> {_let(f'filter({items}, x -> (x.k & u.m) = u.v)', 'g', f'transform(u.low, w -> {_put("g", _EMPTY, "w")})')}))"


def subtracted(a: str, b: str) -> str:
    """SQL: what is in the sketch `a` and not in `b`, and the reverse with negative counts."""
    return f"zip_with({a}, {b}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'c', x.c ^ y.c))"


def peeled(sketch: str) -> str:
    """SQL: struct(found, ok): the number of digests that peeling recovers, and whether no cell is left. Each pass but the
    last takes one cell's digest at least, so there are no more passes than cells."""
    pure = f"array_distinct(transform(filter(s.cells, y -> abs(y.n) = 1 AND y.c = {_CHECK.format('y.k')}), y -> named_struct('n', -y.n, 'k', y.k, 'c', y.c)))"
    hit = " | ".join(f"shiftleft(1L, CAST(shiftrightunsigned(x.k, {p}) & {THIRD - 1} AS int) + {THIRD * j})" for j, p in enumerate(PLACES))
    rest = _let(f"aggregate(p, 0L, (a, x) -> a | {hit})", "h", f"zip_with(s.cells, {_CELLS}, (y, i) -> IF((h & i.h) = 0, y, {_put('p', 'y', 'i')}))")
    step = _let(pure, "p", f"IF(size(p) = 0, named_struct('cells', s.cells, 'found', s.found, 'more', false), named_struct('cells', {rest}, 'found', s.found + size(p), 'more', true))")
    end = "named_struct('found', s.found, 'ok', forall(s.cells, y -> y.n = 0 AND y.k = 0 AND y.c = 0))"
    return f"aggregate(sequence(1, {3 * THIRD + 1}), named_struct('cells', {sketch}, 'found', 0, 'more', true), (s, r) -> IF(s.more, {step}, s), s -> {end})"


def differing(a: str, b: str, digests_a: str, digests_b: str) -> str:
    """SQL: how many digests are on one side only: by subtracting the sketches `a` and `b`, or else larger ones of the digests."""
    tried = f"transform(s.todo, g -> IF(size(g) > {DENSE}, named_struct('end', named_struct('found', 0, 'ok', false), 'g', g), named_struct('end', {peeled(cells('g'))}, 'g', g)))"
    bit = f"(shiftright(z.k, element_at(array({', '.join(map(str, SPLITS))}), r)) & 1)"
    halves = f"filter(flatten(transform(filter(t, y -> NOT y.end.ok), y -> array(filter(y.g, z -> {bit} = 0), filter(y.g, z -> {bit} = 1)))), g -> size(g) > 0)"
    found = "s.found + aggregate(t, 0, (f, y) -> f + IF(y.end.ok, y.end.found, 0))"
    step = _let(tried, "t", f"named_struct('todo', {halves}, 'found', {found})")
    # Past the last bit a sketch holds one digest, or the same from both sides, and peels.
    again = f"aggregate(sequence(1, {len(SPLITS)}), named_struct('todo', array(concat({signed(digests_a, 1)}, {signed(digests_b, -1)})), 'found', 0), (s, r) -> IF(size(s.todo) = 0, s, {step}), s -> s.found + aggregate(s.todo, 0, (f, g) -> f + {peeled(cells('g'))}.found))"
    return _let(peeled(subtracted(a, b)), "e", f"CAST(IF(e.ok, e.found, {again}) AS bigint)")


def as_text(cells_: str) -> str:
    """SQL: cells as lowercase hexadecimal: 4 digits of count, 16 of digests, 8 of checks for each."""
    return f"lower(array_join(transform({cells_}, c -> concat(lpad(hex(c.n & 65535), 4, '0'), lpad(hex(c.k), 16, '0'), lpad(hex(c.c), 8, '0'))), ''))"


def likeness(n: str, differ: str) -> str:
    """SQL: the Jaccard coefficient of two sets of `n` members together of which `differ` are on one side only."""
    return f"IF({n} = 0, 1D, ({n} - {differ}) / ({n} + {differ}))"


def _sketched(df: DataFrame, text: str, digests: str, sketch: str) -> DataFrame:
    return df.withColumn(digests, F.expr(paragraphs(text))).withColumn(sketch, F.expr(cells(signed(digests, 1))))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) for each row: one pass, no shuffle."""
    t = _sketched(df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")), "t", "digests", "sketch")
    return t.select("id", F.expr(as_text("sketch")).alias("fingerprint"))


def _chunk(id_: Column) -> Column:
    return F.shiftright(id_.cast("bigint"), 10)


def _chunks_before(chunks: DataFrame) -> DataFrame:
    """(chunk, before): the preceding chunk, before the first the last.

    Windows over groups of 2^20 chunks, then over groups of 2^20 groups, then over the at most 2^14 of those that 64 bits
    have, so that no task sees more than 2^20 rows however sparse the ids are. Only the first of a group asks the next level.
    """
    levels = [chunks.distinct().select(F.col("chunk").alias("key"), F.shiftright("chunk", 20).alias("group"), F.col("chunk").alias("high"))]
    for shift in (20, 20):
        below = levels[-1]
        levels.append(below.groupBy(F.col("group").alias("key")).agg(F.max("high").alias("high")).withColumn("group", F.shiftright("key", shift)))
    levels[-1] = levels[-1].withColumn("group", F.lit(0))
    every = W.partitionBy("group").orderBy("key")
    whole = every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    found = levels[-1].select("key", F.coalesce(F.lag("high").over(every), F.last("high").over(whole)).alias("before"))
    for below in levels[-2::-1]:
        own = below.withColumn("before", F.lag("high").over(every))
        up = found.select(F.col("key").alias("group"), F.col("before").alias("up"))
        found = own.join(up, "group").select("key", F.coalesce("before", "up").alias("before"))
    return found.select(F.col("key").alias("chunk"), "before")


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, digests, sketch, next_t, next_digests, next_sketch): each row beside its successor by id, after the last the first.

    The text is shuffled once, by chunks of 1,024 ids. Only the first and last rows of chunks are read again from that
    shuffle, to meet those of the chunk before.
    """
    if not isinstance(df.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col} must be an integer column")
    t = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    # Both uses filter alike, so that they share one exchange.
    dealt = t.where("id IS NOT NULL").withColumn("chunk", _chunk(F.col("id"))).where("chunk IS NOT NULL").repartition("chunk")
    w = W.partitionBy("chunk").orderBy("id", "t")
    own, following = ["t", "digests", "sketch"], ["next_t", "next_digests", "next_sketch"]
    inside = _sketched(dealt, *own).select("id", *own, *(F.lead(c).over(w).alias(n) for c, n in zip(own, following))).where("next_t IS NOT NULL")
    edges = dealt.select("chunk", "id", "t", (F.row_number().over(w) == 1).alias("first"), F.lead("id").over(w).isNull().alias("last")).where("first OR last")
    roles = F.array(F.when(F.col("last"), F.struct(F.col("chunk").alias("at"), F.lit(True).alias("own"))), F.when(F.col("first"), F.struct(F.col("before").alias("at"), F.lit(False).alias("own"))))
    met = edges.join(_chunks_before(t.where("id IS NOT NULL").select(_chunk(F.col("id")).alias("chunk"))), "chunk").select("id", "t", F.explode(F.array_compact(roles)).alias("r"))
    met = met.groupBy("r.at").agg(F.max(F.when(F.col("r.own"), F.struct("id", "t"))).alias("x"), F.max(F.when(~F.col("r.own"), F.col("t"))).alias("next_t")).select("x.id", "x.t", "next_t")
    met = met.union(t.where("id IS NULL").select("id", "t", F.col("t").alias("next_t")))
    met = _sketched(_sketched(met, *own), *following).select("id", *own, *following)
    return inside.union(met)


def versions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row, see op7's contract."""
    q = "CAST(floor(char_length(t) / 4) AS int)"
    x = with_next(df, id_col, text_col).withColumn("edited", F.expr(f"concat(substring(t, 1, char_length(t) - {q}), substring(next_t, 1, {q}))"))
    x = _sketched(x, "edited", "edited_digests", "edited_sketch")
    for role in ("edited", "next"):
        x = x.withColumn(f"{role}_differ", F.expr(differing("sketch", f"{role}_sketch", "digests", f"{role}_digests")))
    return x.select(
        "id", F.expr("CAST(char_length(t) AS bigint)").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.expr(as_text("sketch")).alias("fingerprint"), F.expr(as_text("edited_sketch")).alias("edited_fingerprint"),
        *(F.expr(likeness(f"(size(digests) + size({r}_digests))", f"{r}_differ")).alias(f"near_{r}") for r in ("edited", "next")),
    )


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    return versions(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
