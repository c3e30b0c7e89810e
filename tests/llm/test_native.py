import collections
import hashlib
import itertools
import random
import re

import pytest

from sparrowmill.llm import sketches, urls

SF = "/root/testdata/sf0.001"


def plain_rule(url):
    i = (url or "").find("://")
    rest = url[i + 3 :] if url is not None and i >= 0 else ""
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = host.translate({i: i + 32 for i in range(65, 91)})
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else (None, None)


def plain_tokens(url, host, path):
    m = re.match(r"(?s)^.*?://[^?#]*\?([^#]*)", url or "")
    keys = [x.split("=")[0] for x in m[1].split("&")] if m else []
    return {"h:" + x for x in host.split(".") if x} | {"p:" + x for x in path.split("/") if x} | {"q:" + x for x in keys if x}


def plain_judge(rows, support, confidence):
    seen = [(i, *plain_rule(u), plain_tokens(u, *plain_rule(u)[:2])) for i, u in rows]
    count = collections.Counter()
    for _, _, _, (_, v), t in seen:
        items = sorted(t | ({"y:" + v} if v else set()))
        for n in range(1, len(items) + 1):
            count.update(itertools.combinations(items, n))
    need = -(-support * len(rows) // 1)
    rules = []
    for items, n in count.items():
        y = [x for x in items if x.startswith("y:")]
        rest = tuple(x for x in items if not x.startswith("y:"))
        if len(y) == 1 and rest and n >= need and n / count[rest] >= confidence:
            rules.append((n / count[rest], len(rest), n / len(rows), y[0][2:], list(rest)))
    out = {}
    for i, host, path, (rule, v), t in seen:
        best = max((r for r in rules if set(r[4]) <= t), default=None) if v is None else None
        out[i] = (host, path, rule, v or (best[3] if best else "allow"))
    return out


def test_op5_matches_brute_force(spark):
    rows = [(r.page_id, r.url) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.op5_url_filters(spark, SF).collect()}
    assert got == plain_judge(rows, 0.002, 0.7)


def test_mined_rules_decide_other_urls(spark):
    rows = [(i, f"http://spam{i % 3}.shop.net/es/buy/{i}?ref=1") for i in range(40)] + [(100 + i, f"http://spam{i}.shop.org/buy/{i}") for i in range(5)] + [(200 + i, f"http://good.org/read/{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, support=0.05, confidence=0.7).collect()}
    assert got == plain_judge(rows, 0.05, 0.7)
    assert got[100][3] == "block" and got[200][3] == "allow"


def test_long_paths_do_not_multiply_combinations(spark):
    """Copies of a url of forty tokens, copies of one that lack a token each, and a token that tells them apart."""
    segments = [f"s{i}" for i in range(40)]
    rows = [(i, "http://a.net/es/" + "/".join(segments)) for i in range(50)] + [(100 + i, "http://a.org/" + "/".join(x for j, x in enumerate(segments) if j != i % 40)) for i in range(100)]
    rows += [(300 + i, f"http://b{i}.com/x") for i in range(50)] + [(400, "http://c.org/es/s1/s2"), (401, "http://c.org/q")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    tokens = df.select(urls.tokens(df.url, urls.host_of(df.url), urls.path_of(df.url)).alias("tokens"), urls.listed(urls.host_of(df.url), urls.path_of(df.url))["verdict"].alias("verdict"))
    mined = urls.mine(tokens, 0.1, 0.7).collect()
    assert mined and all(len(r.wanted) <= urls.MOST_ITEMS for r in mined) and len(mined) < 2 ** (urls.MOST_ITEMS + 2) / 0.1
    got = {r.id: r.verdict for r in urls.judge(df, support=0.1).collect()}
    assert got[400] == "block" and got[401] == "allow" and got[0] == "block" and got[300] == "allow"


def test_urls_of_more_tokens_than_are_mined_are_judged_by_all(spark):
    """Of fourteen or so tokens that are each as telling as another, some few together tell; brute force counts all combinations."""
    rng = random.Random(4)
    rows = []
    for i in range(60):
        path = [f"s{j}" for j in range(13) if rng.random() < 0.8]
        told = {"s3", "s7", "s9"} <= set(path)
        end = rng.choice(("org", "net" if told else "com"))
        rows.append((i, f"http://a.{end}/" + "/".join(["es", *path] if end == "net" else path)))
    rows += [(100 + i, "http://a.org/" + "/".join(f"s{j}" for j in range(13) if j != i)) for i in range(13)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    want = plain_judge(rows, 0.1, 0.4)
    assert {v[3] for v in want.values() if v[2] is None} == {"block", "allow"}
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, support=0.1, confidence=0.4, most_items=2).collect()}
    assert got == want


def test_tokens_that_stand_together_are_one_item(spark):
    rows = [(["a", "b", "c"], "block")] * 30 + [(["a", "b"], None)] * 30 + [(["d"], "allow")] * 10
    df = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    assert sorted(map(sorted, urls.classes(df, 0.1))) == [["a", "b"], ["c"], ["d"]]
    got = {(tuple(r.antecedent), r.verdict) for r in urls.mine(df, 0.1, 0.7).collect()}
    assert got == {(("c",), "block"), (("a", "b", "c"), "block"), (("d",), "allow")}


def test_urls_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "no scheme", "z"), (None, "HTTP://WWW.Example.COM/en/A?x#y", "w"), (5, "a://com", "w"), (5, "a://com", "w"), (6, "x://é.NET/es/" + "q" * 70_000, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = sorted(((r.id or 0, r.host, r.rule, r.verdict) for r in urls.judge(df).collect()))
    assert len(got) == 7
    assert {(i, h, r, v) for i, h, r, v in got} == {(1, "", None, "allow"), (2, "", None, "allow"), (3, "", None, "allow"), (0, "www.example.com", "www.example.com/en/", "allow"), (5, "com", None, "allow"), (6, "é.net", "net/es/", "block")}
    assert urls.judge(df.limit(0)).count() == 0


def plain_units(t):
    if t and not t.translate({ord(c): None for c in ".!?\n"}).strip(" "):
        return {t}
    return {x.strip(" ") for x in re.findall(r"[^.!?\n]{1,96}", t) if x.strip(" ")}


def likeness(a, b):
    a, b = plain_units(a), plain_units(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check_versions(rows, got):
    rows = sorted((i, t or "") for i, t in rows)
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        q = len(t) // 4
        e = t[: len(t) - q] + u[:q]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert got[i].near_edited == pytest.approx(likeness(t, e)) and got[i].near_next == pytest.approx(likeness(t, u))


def test_op7_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in sketches.op7_fingerprints(spark, SF).collect()}
    assert got.keys() == {i for i, _ in rows}
    check_versions(rows, got)
    alone = {r.id: r.fingerprint for r in sketches.fingerprints(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert alone == {i: r.fingerprint for i, r in got.items()}
    by_text = {}
    for i, t in rows:
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    assert len(set(by_text.values())) == len({frozenset(plain_units(t or "")) for t in by_text})


def test_sketches_across_chunks_and_odd_rows(spark):
    rows = [(i * 700, f"Line {i}.\nAnother line {i % 3}!\nCommon words here" * (i % 5)) for i in range(60)] + [(-5, None), (10**9, "..!"), (10**12, "x" * 30_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, cells string")
    check_versions(rows, {r.id: r for r in sketches.versions(df).collect()})
    one = sketches.versions(df.where("doc_id = 700")).collect()
    assert [(r.id, r.near_edited > 0, r.near_next) for r in one] == [(700, True, 1.0)]
    assert sketches.versions(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b", 0), (1, "a b", 0), (None, None, 0)], "doc_id long, text string, place int")
    assert sketches.versions(twice).count() == 3 and sketches.fingerprints(twice).count() == 3


def test_no_python_in_the_native_plans(spark):
    for df in (urls.op5_url_filters(spark, SF), sketches.op7_fingerprints(spark, SF)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
