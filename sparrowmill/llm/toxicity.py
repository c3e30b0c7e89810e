"""Toxicity by the nearest labelled examples.

fit() takes a bounded sample of the different labelled texts (`per_class` of each label, the least hashes of their ids), picks the
words, prefixes and suffixes whose association with the label is significant and strong, and indexes the examples' TF-IDF
vectors over them: postings in blocks of examples, with each term's greatest weight in each block. score() finds the
exact `k` nearest by cosine for every row: blocks go by their upper bound until none can beat the k-th, and the
neighbours' distance-weighted votes, each class weighted back to its share among all labels, give the score.

Only the fit is bounded; every row is scored over its whole text. Defined cases: a null or empty text, and one with
none of the terms, has no neighbour and gets the (weighted, smoothed) share of toxic examples without any term;
rows with a null label or id don't train, copies of a text train once; repeated labels of an id count once, toxic if any is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stored
from .textnum import Words, slices

_EDGE = re.compile(r"^\W+|\W+$")
BLOCK = 64
#: How many times likelier in one class a term must be, and the power of a neighbour's similarity in its vote: chosen on the
#: training rows alone, the fifth of them with crc32(id) mod 5 = 1 scored by a model of the others.
LIFT, POWER = 2.0, 3.0


def features(word: str) -> set[str]:
    """A word without its edges' punctuation, its prefixes of 4 and 5 and its suffix of 4 characters."""
    w = _EDGE.sub("", word)
    if not w:
        return set()
    return {"=" + w} | {"^" + w[:n] for n in (4, 5) if len(w) >= n} | ({"$" + w[-4:]} if len(w) >= 4 else set())


def _words(column: pa.Array) -> tuple[Words, np.ndarray, list[bytes]]:
    w = Words(pc.utf8_lower(column.fill_null("")))
    d = w.values().dictionary_encode()
    return w, d.indices.to_numpy(), d.dictionary.to_pylist()


@dataclass
class Model:
    """Terms, idf, and the index over the examples; its size is bounded by the sample's."""

    terms: dict[str, int]
    idf: np.ndarray
    ids: list
    toxic: np.ndarray
    weight: np.ndarray
    example: np.ndarray
    value: np.ndarray
    start: np.ndarray  # (terms, blocks + 1): where a term's postings of a block begin
    most: np.ndarray  # (terms, blocks): greatest value
    rest: float
    prior: float

    def vectors(self, column: pa.Array, known: dict) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, unit weights) of each text."""
        w, index, words = _words(column)
        if len(known) > 100_000:
            known.clear()
        of, n = [], np.zeros(len(words), np.int64)
        for j, x in enumerate(words):
            t = known.get(x)
            if t is None:
                t = known[x] = tuple(self.terms[f] for f in features(x.decode("utf-8", "replace")) if f in self.terms)
            n[j] = len(t)
            of.extend(t)
        first = np.cumsum(n) - n
        at = np.flatnonzero(n[index] > 0)
        size = n[index[at]]
        doc = np.repeat(w.doc[at], size)
        term = np.array(of, np.int64)[np.repeat(first[index[at]], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] if len(at) else np.zeros(0, np.int64)
        key, tf = np.unique(doc * len(self.idf) + term, return_counts=True) if len(term) else (np.zeros(0, np.int64), np.zeros(0))
        doc, term = (key // len(self.idf), key % len(self.idf)) if len(key) else (key, key)
        value = tf * self.idf[term] if len(key) else tf
        cut = np.searchsorted(doc, np.arange(w.rows + 1))
        out = []
        for a, b in zip(cut, cut[1:]):
            v = value[a:b]
            out.append((term[a:b], v / np.sqrt((v * v).sum()) if b > a else v))
        return out

    def nearest(self, term: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest cosine above zero (ties: the earlier), exactly."""
        best = value @ self.most[term]
        ids, sims, kth = np.zeros(0, np.int64), np.zeros(0), 0.0
        for b in np.argsort(-best, kind="stable"):
            if best[b] <= 0 or len(ids) >= k and best[b] < kth - 1e-9:
                break
            block = np.zeros(BLOCK)
            for t, v in zip(term, value):
                a, z = self.start[t, b], self.start[t, b + 1]
                block[self.example[a:z] - b * BLOCK] += v * self.value[a:z]
            hit = np.flatnonzero(block > 0)
            ids, sims = np.append(ids, hit + b * BLOCK), np.append(sims, block[hit])
            if len(ids) > k:
                keep = np.lexsort((ids, -np.round(sims, 12)))[:k]
                ids, sims = ids[keep], sims[keep]
            kth = sims.min() if len(sims) >= k else 0.0
        keep = np.lexsort((ids, -np.round(sims, 12)))
        return ids[keep], sims[keep]

    def score(self, term: np.ndarray, value: np.ndarray, k: int = 15, power: float = POWER) -> tuple[float, list]:
        """A score from 0 to 1 and its evidence, the nearest three (id, similarity, label)."""
        if not len(term):
            return self.rest, []
        ids, sims = self.nearest(term, value, k)
        vote = self.weight[ids] * 4 * sims**power / (1.05 - np.minimum(sims, 1.0))  # far neighbours leave it to the prior
        s = ((vote * self.toxic[ids]).sum() + self.prior) / (vote.sum() + 1.0)
        return float(s), [(self.ids[i], float(x), int(self.toxic[i])) for i, x in zip(ids[:3], sims[:3])]


def _significant(counts: DataFrame, n: np.ndarray, most: int, lift: float, least: int = 4) -> list[str]:
    """The features with the greatest likelihood ratios, of those that pass a threshold that grows with their number."""
    tried = counts.where(F.col("a") + F.col("b") >= least)
    m = max(1, tried.count())
    a, b, total, pos = F.col("a"), F.col("b"), float(n.sum()), float(n[1])

    def part(x, row, col):
        return F.when(x > 0, x * F.log(x * total / (row * col))).otherwise(0.0)

    row = a + b
    g2 = 2 * (part(a, row, F.lit(pos)) + part(b, row, F.lit(total - pos)) + part(pos - a, total - row, F.lit(pos)) + part(total - pos - b, total - row, F.lit(total - pos)))
    # A term must also be `lift` times likelier in one class: long texts have more of every common word.
    toxic, clean = (a + 0.5) / (pos + 1), (b + 0.5) / (total - pos + 1)
    apart = (toxic >= lift * clean) | (clean >= lift * toxic)
    return [r.feature for r in tried.withColumn("g2", g2).where(apart & (F.col("g2") >= 2 * np.log(m) + 8)).orderBy(F.desc("g2"), "feature").limit(most).collect()]


def fit(labelled: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 4096, most_terms: int = 2048, lift: float = LIFT) -> Model:
    """`labelled` (id, label) chooses rows of `docs` (id, text). The sample, the terms and so the model are bounded by the parameters."""
    once = labelled.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    once = Stored(once).df
    by_class = {r.label: r.n for r in once.groupBy("label").agg(F.count("*").alias("n")).collect()}
    # Copies would make a text's rare words look frequent: each text counts once in a class, and the sample is of different texts.
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("h"))
    different = Stored(texts.join(once, "id").groupBy("h", "label").agg(F.min("id").alias("id"))).df
    picked = None
    for label in (0, 1):
        x = different.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(per_class).select("id", "label")
        picked = x if picked is None else picked.union(x)
    sample = Stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(picked), "id").dropDuplicates(["t", "label"])).df

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[str, list[int]] = {}
        for batch in batches:
            for part in slices(batch, "t"):
                label = part.column("label").to_numpy()
                w, index, words = _words(part.column("t"))
                fs = [features(x.decode("utf-8", "replace")) for x in words]
                at = np.unique(w.doc * max(1, len(words)) + index)
                doc, word = at // max(1, len(words)), at % max(1, len(words))
                cut = np.searchsorted(doc, np.arange(w.rows + 1))
                for d in range(w.rows):
                    for f in set().union(*(fs[j] for j in word[cut[d] : cut[d + 1]])):
                        of.setdefault(f, [0, 0])[label[d]] += 1
        if of:
            yield pa.record_batch({"feature": pa.array(list(of)), "a": pa.array([x[1] for x in of.values()]), "b": pa.array([x[0] for x in of.values()])})

    seen = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = np.array([seen.get(0, 0), seen.get(1, 0)], float)
    counts = Stored(sample.repartition(16).mapInArrow(count, "feature string, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))).df
    names = _significant(counts, n, most_terms, lift) if n.min() > 0 else []
    df = {r.feature: r.n for r in counts.where(F.col("feature").isin(names)).select("feature", (F.col("a") + F.col("b")).alias("n")).collect()} if names else {}
    idf = np.log((1 + n.sum()) / (1 + np.array([df[x] for x in names], float))) + 1 if names else np.zeros(0)
    model = Model({x: i for i, x in enumerate(names)}, idf, [], *[np.zeros(0)] * 4, *[np.zeros((0, 0))] * 2, 0.0, 0.0)
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for part in slices(batch, "t"):
                v = shared.value.vectors(part.column("t"), known)
                yield pa.record_batch({"id": part.column("id"), "label": part.column("label"), "terms": pa.array([x[0] for x in v], pa.list_(pa.int64())), "value": pa.array([x[1] for x in v], pa.list_(pa.float64()))})

    kind = sample.schema["id"].dataType.simpleString()
    rows = sorted(sample.mapInArrow(vector, f"id {kind}, label int, terms array<long>, value array<double>").collect(), key=lambda r: (r.label, r.terms, r.value, str(r.id)))  # like vectors stand in the same blocks
    share = np.array([by_class.get(c, 0) / max(1.0, n[c]) for c in (0, 1)])
    share = share / max(1e-9, share.max()) if share.max() > 0 else share
    toxic = np.array([r.label for r in rows], np.int64)
    weight = share[toxic] if len(rows) else np.zeros(0)
    bare = np.array([not r.terms for r in rows], bool)
    model.prior = float((weight * toxic).sum() / weight.sum()) if len(rows) else 0.0
    model.rest = float(((weight * toxic)[bare].sum() + model.prior) / (weight[bare].sum() + 1.0)) if len(rows) else 0.0
    rows = [r for r in rows if r.terms]
    model.toxic, model.weight, model.ids = toxic[~bare], weight[~bare], [r.id for r in rows]
    blocks = len(rows) // BLOCK + 1
    term = np.array([t for r in rows for t in r.terms], np.int64)
    example = np.repeat(np.arange(len(rows)), [len(r.terms) for r in rows]) if rows else np.zeros(0, np.int64)
    value = np.array([v for r in rows for v in r.value])
    order = np.lexsort((example, term))
    term, model.example, model.value = term[order], example[order], value[order]
    model.start = np.searchsorted(term * blocks + model.example // BLOCK, np.arange(len(names))[:, None] * blocks + np.arange(blocks + 1)[None, :])
    model.most = np.zeros((len(names), blocks))
    np.maximum.at(model.most, (term, model.example // BLOCK), model.value)
    return model


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", k: int = 15, power: float = POWER) -> DataFrame:
    """(id, score, predicted, evidence) for each row: one pass, no shuffle. The model is broadcast; its size doesn't grow with the data."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()
    proof = pa.list_(pa.struct([("id", pa.string()), ("similarity", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for part in slices(batch, "t"):
                s = [shared.value.score(t, v, k, power) for t, v in shared.value.vectors(part.column("t"), known)]
                evidence = [[{"id": str(i), "similarity": x, "toxic": y} for i, x, y in e] for _, e in s]
                x = np.array([a for a, _ in s])
                yield pa.record_batch({"id": part.column("id"), "score": pa.array(x), "predicted": pa.array((x >= 0.5).astype(np.int32)), "evidence": pa.array(evidence, proof)})

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, score double, predicted int, evidence array<struct<id:string,similarity:double,toxic:int>>")


def keep_clean(df: DataFrame, model: Model, text_col: str = "text", k: int = 15) -> DataFrame:
    """The rows of `df` that score below 0.5, with their columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array([shared.value.score(t, v, k)[0] < 0.5 for t, v in shared.value.vectors(part.column(text_col), known)], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(labels.where(~held_out()), docs)
    return score(docs, model).withColumnRenamed("id", "doc_id").select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence")
