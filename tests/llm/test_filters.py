import collections
import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sparrowmill.llm import quality, toxicity

SF = "/root/testdata/sf0.01"
W = re.compile(r"[^\x20\x09-\x0D]+")


def base(t):
    t = t or ""
    w = W.findall(t)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if W.search(x)]
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


@settings(deadline=None, max_examples=120)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té|#", max_size=80)), max_size=6))
def test_base_counts_match_a_plain_loop(texts):
    c = quality.base_counts(pa.array(texts, pa.string()))
    assert list(zip(*(c[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")))) == [base(t) for t in texts]


def test_op8_on_the_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = quality.op8_quality(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        n, chars, symbols, lines, words = base(docs[r.doc_id])
        failed = n < 10 or 100 * words > 20 * n
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, lines, words, failed)
        assert not (failed and r.kept)
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert all(r.kept for r in rows if r.doc_id in good and not r.base_failed)


def test_bands_reject_repetition_and_noise():
    rng = np.random.default_rng(0)
    words = [bytes(rng.integers(97, 117, rng.integers(2, 9)).astype(np.uint8)) for _ in range(3000)]
    prose = b" ".join(words[i] for i in (rng.zipf(1.3, 900) - 1) % 3000)
    noise = bytes(rng.integers(33, 126, 6000).astype(np.uint8))
    assert quality.compression([prose, b"same words " * 500, noise, prose[:3000] + noise, b"", b"short"])[2] == [True, False, False, False, True, True]


def test_quality_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1.0), (None, "", None), (2, "w " * 40_000, 0.5), (2, "a b c d e f g h i j k", 0.5)], "doc_id long, text string, ratio double")
    assert sorted((r.id or 0, r.n_words, r.base_failed) for r in quality.judge(df).collect()) == [(0, 0, True), (1, 0, True), (2, 11, False), (2, 40_000, True)]
    kept = quality.keep_quality(df)
    assert kept.columns == df.columns and [r.text for r in kept.collect()] == ["a b c d e f g h i j k"]
    assert quality.judge(df.limit(0)).count() == 0


def test_op2_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in toxicity.op2_toxicity(spark, SF).collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for i, r in rows.items())
    labels = [(rows[r.doc_id], r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    test = [(r.predicted, y) for r, y in labels if r.held_out]
    assert np.mean([p == y for p, y in test]) >= 0.95


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(5)
    words = [f"term{i:03d}" for i in range(60)]
    rows = [(i, " ".join(["filler"] + [words[j] for j in rng.integers(0, 30, 6)] if i % 2 else ["filler"] + [words[j] for j in rng.integers(25, 60, 6)]), i % 2) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.fit(docs.select("doc_id", "toxic"), docs, per_class=150)
    dense = np.zeros((len(m.ids), len(m.idf)))
    for t in range(len(m.idf)):
        for b in range(m.most.shape[1]):
            a, z = m.start[t, b], m.start[t, b + 1]
            dense[m.example[a:z], t] = m.value[a:z]
    assert len(m.ids) > 200
    for term, value in m.vectors(pa.array([r[1] for r in rows[::9]]), {}):
        q = np.zeros(len(m.idf))
        q[term] = value
        sims = dense @ q
        want = sorted(range(len(sims)), key=lambda i: (-round(sims[i], 12), i))[:10]
        ids, got = m.nearest(term, value, 10)
        assert np.allclose(sorted(got), sorted(sims[want])) and ids.tolist() == [i for i in want if sims[i] > 0]


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(i, f"vile words here {i}" if i % 4 == 0 else f"kind words here {i}", "x") for i in range(200)] + [(None, None, "x"), (900, "", "x"), (901, "vile " * 60_000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(0, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    m = toxicity.fit(labels, docs)
    got = {r.id: r.predicted for r in toxicity.score(docs, m).collect()}
    assert got[0] == 1 and got[1] == 0 and got[None] == 0 and got[900] == 0 and got[901] == 1
    assert {r.doc_id for r in toxicity.keep_clean(docs, m).collect()} == {None, 900} | {i for i in range(200) if i % 4}
    empty = toxicity.fit(labels.limit(0), docs)
    assert {r.score for r in toxicity.score(docs, empty).collect()} == {0.0}


def test_scores_are_the_votes_of_all_examples(spark):
    """The whole score against brute force over every example: cosines, the nearest k, their weighted votes, the prior."""
    rng = np.random.default_rng(7)
    words = [f"term{i:03d}" for i in range(40)]
    rows = [(i, " ".join(["filler"] + [words[j] for j in rng.integers(0, 22, 5)] if i % 5 == 0 else ["filler"] + [words[j] for j in rng.integers(18, 40, 5)]), int(i % 5 == 0)) for i in range(300)]
    docs = spark.createDataFrame(rows + [(900, "", 0), (901, "unseen words alone", 0)], "doc_id long, text string, toxic int")
    m = toxicity.fit(docs.select("doc_id", "toxic").where("doc_id < 300"), docs, per_class=80)
    text = dict((i, t) for i, t, _ in rows)
    assert len(m.ids) > 100

    def vector(t):
        found = collections.Counter(m.terms[f] for w in t.lower().split() for f in toxicity.features(w) if f in m.terms)
        v = np.zeros(len(m.idf))
        for j, n in found.items():
            v[j] = n * m.idf[j]
        return v / np.linalg.norm(v) if v.any() else v

    examples = np.stack([vector(text[i]) for i in m.ids])
    for r in toxicity.score(docs, m).collect():
        v = vector(text.get(r.id, "" if r.id == 900 else "unseen words alone"))
        if not v.any():
            assert r.score == m.rest and not r.evidence
            continue
        sims = examples @ v
        near = [i for i in sorted(range(len(sims)), key=lambda i: (-round(sims[i], 12), i))[:15] if sims[i] > 1e-12]
        vote = m.weight[near] * 4 * sims[near] ** toxicity.POWER / (1.05 - np.minimum(sims[near], 1))
        assert abs(r.score - ((vote * m.toxic[near]).sum() + m.prior) / (vote.sum() + 1)) < 1e-9
        assert [int(e.id) for e in r.evidence] == [m.ids[i] for i in near[:3]]


def test_the_sample_is_of_different_texts(spark):
    rows = [(i, "the same toxic text" if i < 60 else f"vile text number {i}" if i < 100 else f"kind text number {i}", int(i < 100)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.fit(docs.select("doc_id", "toxic"), docs, per_class=30)
    assert sum(i < 60 for i in m.ids) <= 1 and (m.toxic == 1).sum() >= 20


def test_scores_of_training_rows_left_out_are_calibrated(spark):
    """A fifth of the training rows, scored by a model of the others: in every tenth of the scores as many are toxic as they say."""
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    m = toxicity.fit(labels.where((fold != 0) & (fold != 1)), docs)
    left_out = docs.join(labels.where(fold == 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id")
    rows = toxicity.score(left_out, m).join(left_out.select(F.col("doc_id").alias("id"), "toxic"), "id").collect()
    s, y = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    tenth = np.clip((s * 10).astype(int), 0, 9)
    error = sum(abs(s[tenth == i].mean() - y[tenth == i].mean()) * (tenth == i).mean() for i in range(10) if (tenth == i).any())
    print("rows", len(s), "accuracy", ((s >= 0.5) == y).mean(), "calibration error", error)
    assert len(s) > 500 and ((s >= 0.5) == y).mean() > 0.95 and error < 0.05


def test_kept_is_what_the_bands_say(spark):
    """The method's verdict again from its definition: ratios of whole texts and of chunks against the limits of their length."""
    import zstandard

    rng = np.random.default_rng(1)
    noise = ["".join(rng.choice([chr(c) for c in range(33, 127)], 60)) for _ in range(400)]
    planted = [(-1, " ".join(noise[:12])), (-2, " ".join(noise)), (-3, " ".join(f"{'x' * 40}{i}" for i in range(300)))]
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    docs = {r.doc_id: (r.text or "").encode() for r in rows.collect()}
    rejected = 0
    for r in quality.judge(rows).collect():
        t = docs[r.id]
        ratio = lambda x: len(zstandard.compress(x, 3)) / len(x)
        fine = True
        if len(t) >= 64:
            low, high = [b[1:] for b in quality.BANDS if b[0] <= len(t)][-1]
            chunks = [t[i : i + 1024] for i in range(0, len(t), 1024)] if len(t) > 1024 else []
            chunks = [ratio(c) for c in chunks if len(c) >= 512]
            fine = low <= ratio(t) <= high and sum(not 0.30 <= c <= 0.80 for c in chunks) <= 0.25 * len(chunks)
        assert r.kept == (fine and not r.base_failed)
        rejected += not r.kept and not r.base_failed
    assert rejected >= 3
