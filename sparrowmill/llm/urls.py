"""URL filters by association rules, in DataFrame and SQL functions alone.

Listed rules (host, path) decide first: a rule fits its host and all subdomains if the path starts with the rule's,
and the longest wins. Their verdicts are the labels from which Spark's FP-growth mines combinations of URL tokens
(host labels, path segments, query keys) over all urls: a url that no listed rule decides counts towards a
combination's support but not towards a verdict, so a combination must be mostly labelled to pass the confidence.
Tokens that always stand together are mined as one, and of a url's tokens the MOST_ITEMS most telling are.
Mined rules, pruned by support and confidence, match the other urls through an inverted index from token to rule.
Where a url has more tokens than that, the best of all combinations of each url's tokens is found by exact_best().

Defined cases: a null url, and one without `://`, has an empty host and path, no token, and is allowed; repeated rows
are judged alike; no url at all mines no rule.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Stored

#: The listed rules of the query: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: A url's tokens that are mined at most.
MOST_ITEMS = 12
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest listed rule that fits, or null."""
    tries = []
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:])):
        tries.append(F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*tries, F.lit(None).cast("struct<rule:string,verdict:string>"))


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a url, marked by their place."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))

    def marked(mark: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))

    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_distinct(F.concat(marked("h:", F.split(host, r"\.")), marked("p:", F.split(path, "/")), marked("q:", keys)))


def classes(urls: DataFrame, support: float) -> list[list[str]]:
    """The frequent tokens of `urls` (tokens, verdict or null), together where they stand in the same urls; the most telling first.

    At a support s there are at most (tokens in a url on average) / s. Which urls a token stands in is told by its count and
    by sums of the urls' hashes.
    """
    need = -(-support * urls.count() // 1)
    part = [F.shiftrightunsigned("s", 21 * i).bitwiseAND(F.lit((1 << 21) - 1)) for i in range(3)]
    each = urls.select(F.explode("tokens").alias("token"), "verdict", F.xxhash64("tokens").alias("s"))
    found = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("block"), F.count_if(F.col("verdict") == "allow").alias("allow"), *(F.sum(p).alias(f"s{i}") for i, p in enumerate(part)))
    alike: dict[tuple, list[str]] = {}
    for r in found.where(F.col("n") >= need).orderBy(F.desc(F.greatest("block", "allow") / F.col("n")), F.desc("n"), "token").collect():
        alike.setdefault((r.n, r.s0, r.s1, r.s2), []).append(r.token)
    return list(alike.values())


def mine(urls: DataFrame, support: float = 0.002, confidence: float = 0.7, most_items: int = MOST_ITEMS, alike: list[list[str]] | None = None) -> DataFrame:
    """(antecedent, wanted, verdict, confidence, support) from `urls` (tokens, verdict or null); `wanted` is a token of each class in the antecedent.

    Tokens that stand in the same urls are one item, so copies of a long url are no burden. Of a url's items the
    `most_items` most telling are mined, so an antecedent has as many at most and at a support s there are fewer than
    2 ** (most_items + 2) / s combinations, whatever the number of urls and the length of their paths. `alike` are the classes, if they are known.
    """
    spark = urls.sparkSession
    alike = classes(urls, support) if alike is None else alike
    strings = "array<string>"
    first = F.array(*(F.lit(c[0]) for c in alike)).cast(strings)
    items = F.slice(F.array_intersect(first, "tokens"), 1, most_items)
    items = urls.select(F.when(F.col("verdict").isNotNull(), F.concat(items, F.array(F.concat(F.lit("y:"), F.col("verdict"))))).otherwise(items).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    verdict = F.element_at("consequent", 1)
    rules = model.associationRules.where(verdict.startswith("y:") & ~F.exists("antecedent", lambda x: x.startswith("y:")))
    rules = Stored(rules.select(F.xxhash64(F.array_sort("antecedent")).alias("rule"), F.col("antecedent").alias("wanted"), F.substring(verdict, 3, 99).alias("verdict"), "confidence", "support")).df
    table = spark.createDataFrame([(c[0], c) for c in alike], f"token string, tokens {strings}")
    whole = rules.select("rule", "verdict", F.explode("wanted").alias("token")).join(F.broadcast(table), "token").groupBy("rule", "verdict").agg(F.array_sort(F.flatten(F.collect_list("tokens"))).alias("antecedent"))
    return rules.join(whole, ["rule", "verdict"]).select("antecedent", "wanted", "verdict", "confidence", "support")


def exact_best(urls: DataFrame, alike: list[list[str]], support: float, confidence: float) -> DataFrame:
    """(signature, best) for each signature (sorted items, a token of each class of `alike`) of the urls (tokens, verdict or null)
    without a verdict: the best rule of all subsets of the signature, whatever their number.

    Of the subsets that the same urls of a verdict have, the one of all their common items is in no more other urls and is
    longer, so it is the best. Those sets are reached from the common items of all by adding an item and what then is common too.
    """
    strings = "array<string>"
    items = F.array_sort(F.array_intersect(F.array(*(F.lit(c[0]) for c in alike)).cast(strings), "tokens"))
    total = urls.count()
    need = -(-support * total // 1)
    patterns = Stored(urls.select(items.alias("items"), "verdict").groupBy("items", "verdict").agg(F.count("*").alias("n"))).df
    marked = patterns.where("verdict IS NOT NULL AND size(items) > 0")
    wanted = patterns.where("verdict IS NULL AND size(items) > 0").select(F.col("items").alias("signature"))

    def closed(rows: DataFrame, keys: list[str]) -> DataFrame:
        """Of rows (keys, shared, n) with `need` urls or more together, what they all share."""
        found = rows.groupBy(*keys).agg(F.sum("n").alias("hits"), F.collect_set("shared").alias("all")).where(F.col("hits") >= need)
        least = F.aggregate("all", F.element_at("all", 1), lambda x, y: F.array_intersect(x, y))
        return found.select("signature", "verdict", F.array_sort(least).alias("set"), "hits").distinct()

    shared = F.array_intersect("signature", "items").alias("shared")
    met = Stored(wanted.crossJoin(marked).select("signature", "verdict", shared, "n").groupBy("signature", "verdict", "shared").agg(F.sum("n").alias("n"))).df
    new = Stored(closed(met, ["signature", "verdict"]))
    sets, size = new.df, 0
    while True:
        inside = new.df.join(met, ["signature", "verdict"]).where(F.size(F.array_except("set", "shared")) == 0)
        grown = closed(inside.select("signature", "verdict", "set", "shared", "n", F.explode(F.array_except("shared", "set")).alias("item")), ["signature", "verdict", "set", "item"])
        new = Stored(grown.join(sets.select("signature", "verdict", "set"), ["signature", "verdict", "set"], "left_anti"))
        if new.df.isEmpty():
            break
        sets = sets.union(new.df)
        size += 1
        if size % 8 == 0:
            sets = Stored(sets).df
    sets = Stored(sets.where(F.size("set") > 0)).df
    had = sets.select("set").distinct().crossJoin(patterns.groupBy("items").agg(F.sum("n").alias("n"))).where(F.size(F.array_except("set", "items")) == 0).groupBy("set").agg(F.sum("n").alias("n"))
    table = sets.sparkSession.createDataFrame([(c[0], c) for c in alike], f"item string, tokens {strings}")
    whole = sets.select("set").distinct().select("set", F.explode("set").alias("item")).join(F.broadcast(table), "item").groupBy("set").agg(F.array_sort(F.flatten(F.collect_list("tokens"))).alias("antecedent"))
    rules = sets.join(had, "set").withColumn("confidence", F.col("hits") / F.col("n")).where(F.col("confidence") >= confidence).join(whole, "set")
    rules = rules.withColumn("support", F.col("hits") / F.lit(total)).withColumn("length", F.size("antecedent"))
    return rules.groupBy("signature").agg(F.max(F.struct("confidence", "length", "support", "verdict", "antecedent")).alias("best"))


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, support: float = 0.002, confidence: float = 0.7, most_items: int = MOST_ITEMS) -> DataFrame:
    """(id, host, path, rule, verdict, mined, mined_confidence) for each row of `df`."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    urls = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).select("id", host.alias("host"), path.alias("path"), listed(host, path, rules).alias("own"), tokens(F.col("url"), host, path).alias("tokens"))
    seen = urls.select("tokens", "own.verdict")
    alike = classes(seen, support)
    mined = Stored(mine(seen, support, confidence, most_items, alike)).df.withColumn("rule_id", F.xxhash64(F.concat_ws("\n", "antecedent"), "verdict"))
    index = mined.select(F.explode("wanted").alias("token"), "rule_id", F.size("wanted").alias("n"), F.size("antecedent").alias("length"), "antecedent", "verdict", "confidence", "support")
    # Tokens that no rule has can't decide; what is left of a url's tokens is one of few signatures, and each is matched once.
    items = F.array(*(F.lit(c[0]) for c in alike)).cast("array<string>")
    cut = (seen.agg(F.max(F.size(F.array_intersect(items, F.col("tokens"))))).first()[0] or 0) > most_items
    known = items if cut else F.array(*(F.lit(r.token) for r in index.select("token").distinct().collect())).cast("array<string>")
    urls = urls.withColumn("signature", F.when(F.col("own").isNull(), F.array_sort(F.array_intersect("tokens", known)))).drop("tokens")
    found = (
        urls.where(F.size("signature") > 0).select("signature").distinct()
        .select("signature", F.explode("signature").alias("token"))
        .join(index, "token")
        .groupBy("signature", "rule_id")
        .agg(F.count("*").alias("hits"), *(F.first(c).alias(c) for c in ("n", "length", "antecedent", "verdict", "confidence", "support")))
        .where("hits = n")
        .groupBy("signature")
        .agg(F.max(F.struct("confidence", "length", "support", "verdict", "antecedent")).alias("best"))
    )
    if cut:
        found = exact_best(seen, alike, support, confidence)
    # Stored, so that both sides are exchanged and a hot signature's urls can be split; urls without one are dealt by their place.
    found = Stored(found.select(F.xxhash64("signature").alias("key"), F.col("signature").alias("_signature"), "best")).df
    key = F.when(F.size("signature") > 0, F.xxhash64("signature")).otherwise(F.xxhash64("id", "host", "path"))
    out = urls.withColumn("own_key", key).join(found, (F.col("own_key") == F.col("key")) & (F.col("signature") == F.col("_signature")), "left")
    return out.select(
        "id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "best.verdict", F.lit("allow")).alias("verdict"),
        F.concat_ws(" ", "best.antecedent").alias("mined"), F.col("best.confidence").alias("mined_confidence"),
    )


def op5_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("id", "page_id")
