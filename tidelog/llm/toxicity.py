"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; a sample of all training texts, labels put aside, is the unlabelled set. A linear
numpy classifier minimises the class-prior-corrected risk: prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior *
E_pos[loss(-)]). Where the second part falls below zero, steps go against it, as negative-class risk can't be negative.

Features of a text are its distinct words and those words' beginnings; the few that stand out among the positives against
the unlabelled set are kept. A text's margin is a sum over its distinct words, so texts of any length are scored whole.

Bounds, all parameters: at most max_positive and max_unlabelled texts are fitted on, those of smallest hash of the key, one for each key
however often it comes; at most max_features features reach the driver. Scores cover all rows.

Defined results: null and empty texts have no words and get the score of the bias. Several labels of one key: toxic if any
says so. A null key or label labels nothing. Without confirmed positives all scores are 0. Repeated rows get equal scores; other columns stay,
and a column named score is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import few_parts, release_memory, ship, stored
from tidelog.llm.decontaminate import words

SPACE = 1 << 22
STARTS = (4, 5, 6)


def held_out(key: str = "doc_id") -> Column:
    """Whether a row's label is kept for tests: crc32 of the key's text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(word: bytes) -> list[int]:
    """The hashed word and, marked as such, its beginnings of four to six characters."""
    text = word.decode("utf-8", "replace")
    return [zlib.crc32(b"w" + word) % SPACE, *(zlib.crc32(b"s" + text[:n].encode()) % SPACE for n in STARTS if len(text) >= n)]


@dataclass
class ToxicityModel:
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = float("-inf")
    prior: float = 0.0

    def scorer(self, cached: int = 200_000):
        """text -> score in 0..1."""
        weights, of = self.weights, {}

        def margin(word: bytes) -> float:
            found = of[word] = sum(weights.get(x, 0.0) for x in features(word))
            return found

        def score(text: str | None) -> float:
            if len(of) > cached:
                of.clear()
            get = of.get
            total = self.bias + sum([m if (m := get(w)) is not None else margin(w) for w in set(words(text))])
            return float(1 / (1 + np.exp(-min(max(total, -60.0), 60.0)))) if total > -60 else 0.0

        return score


def fit_nnpu(rows_p: list[list[int]], rows_u: list[list[int]], n_features: int, prior: float, *, steps: int = 400, warm: int = 150, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the risk. rows: the features of each text, repeats counting."""

    def packed(rows):
        at = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        return at, np.array([j for x in rows for j in x], np.int64), len(rows)

    p, u = packed(rows_p), packed(rows_u)
    weight, bias = np.zeros(n_features), 0.0
    first, second = np.zeros(n_features + 1), np.zeros(n_features + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    margin = lambda x: np.bincount(x[0], weight[x[1]], x[2]) + bias

    def gradient(x, slope):  # of the mean over the rows, by the margin's slopes
        slope = slope / max(1, x[2])
        return np.append(np.bincount(x[1], slope[x[0]], n_features), slope.sum())

    for step in range(1, steps + 1):
        zp, zu = margin(p), margin(u)
        sp, su = sigmoid(zp), sigmoid(zu)
        if step <= warm:  # logistic loss, which is convex
            positive, negative = prior * gradient(p, sp - 1), gradient(u, su) - prior * gradient(p, sp)
            risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        else:  # sigmoid loss, which is bounded: a few far texts can't push the risk below zero
            rise = gradient(p, sp * (1 - sp))
            positive, negative = -prior * rise, gradient(u, su * (1 - su)) - prior * rise
            risk = su.mean() - prior * sp.mean()
        g = positive + negative if risk >= 0 else -negative
        g[:-1] += decay * weight
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weight, bias = weight - move[:-1], bias - move[-1]
    return weight, bias


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", max_positive: int = 4_000, max_unlabelled: int = 16_000, max_features: int = 2_000, prior: float | None = None) -> ToxicityModel:
    """A model from the rows that are not held out. prior: the share of toxic texts; None: as among their labels."""
    spark = docs.sparkSession
    ship(spark)
    open_ = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label")).where(F.col("_key").isNotNull() & F.col("_label").isNotNull() & ~held_out("_key"))
    known = open_.groupBy("_key").agg(F.max("_label").alias("_label"))
    n, n_toxic = known.agg(F.count(F.lit(1)), F.sum(F.when(F.col("_label") == 1, 1).otherwise(0))).first()
    if not n_toxic:
        return ToxicityModel()
    prior = min(0.9, max(1e-4, n_toxic / n if prior is None else prior))
    mix = F.xxhash64(F.col("_key"), F.lit("toxicity"))
    ids = docs.select(F.col(key).alias("_key")).where(F.col("_key").isNotNull() & ~held_out("_key"))
    chosen_p = known.where(F.col("_label") == 1).select("_key").orderBy(mix, "_key").limit(max_positive)
    chosen_u = ids.distinct().orderBy(mix, "_key").limit(max_unlabelled)
    chosen = stored(chosen_p.select("_key", F.lit(True).alias("_positive")).unionByName(chosen_u.select("_key", F.lit(False).alias("_positive"))), "chosen")
    # at most max_positive + max_unlabelled rows of a key and a flag
    joined = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).join(F.broadcast(chosen), "_key")
    # of a key that comes often, one text: that of smallest hash
    sample = joined.groupBy("_key", "_positive").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text")).select("_positive", "_text")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [[x for w in set(words(t)) for x in features(w)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int32()))], names=["_positive", "_features"])
        release_memory()

    # before the workers, so that each part is one run of a worker, and written as one file; 2,000 texts a part, as they may be long
    sample = few_parts(sample, max_positive + max_unlabelled, each=2_000)
    rows = stored(sample.mapInArrow(featured, "_positive boolean, _features array<int>"), "features")
    n_p, n_u = rows.agg(F.sum(F.col("_positive").cast("int")), F.sum((~F.col("_positive")).cast("int"))).first()
    if not n_p or not n_u:
        return ToxicityModel(prior=prior)
    each = rows.select("_positive", F.explode(F.array_distinct("_features")).alias("_feature"))
    counts = each.groupBy("_feature").agg(F.sum(F.col("_positive").cast("int")).alias("_p"), F.sum((~F.col("_positive")).cast("int")).alias("_u"))
    lift = F.log((F.col("_p") + 0.5) / F.lit(float(n_p))) - F.log((F.col("_u") + 0.5) / F.lit(float(n_u)))
    # by how much more often than in the unlabelled set, weighed by how often at all
    best = counts.where((F.col("_p") >= max(3, n_p // 500)) & (lift > 0.7)).orderBy((lift * F.sqrt(F.col("_p"))).desc(), "_feature").limit(max_features)
    picked = [r[0] for r in best.select("_feature").collect()]
    if not picked:
        return ToxicityModel(prior=prior)
    number = {x: i for i, x in enumerate(picked)}
    # at most max_features rows; from Arrow, as rows from a list would go through Python workers of their own kind, which live on in every executor
    wanted = F.broadcast(spark.createDataFrame(pa.table({"_feature": pa.array(picked, pa.int32())})))
    flat = rows.withColumn("_n", F.monotonically_increasing_id()).select("_n", "_positive", F.explode("_features").alias("_feature")).join(wanted, "_feature")
    by: dict[bool, dict[int, list[int]]] = {True: {}, False: {}}
    for r in flat.groupBy("_n", "_positive").agg(F.collect_list("_feature").alias("x")).collect():  # bounded by the sample and max_features
        by[r[1]][r[0]] = [number[x] for x in r[2]]
    pad = lambda found, total: [*found.values(), *[[]] * (total - len(found))]
    weight, bias = fit_nnpu(pad(by[True], n_p), pad(by[False], n_u), len(picked), prior)
    return ToxicityModel({x: float(weight[i]) for x, i in number.items()}, float(bias), prior)


def score(docs: DataFrame, model: ToxicityModel, *, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score of every row's whole text."""
    ship(docs.sparkSession)
    keep = [i for i, c in enumerate(docs.columns) if c != name]
    at = docs.columns.index(text)
    schema = T.StructType([docs.schema.fields[i] for i in keep] + [T.StructField(name, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array([of(x) for x in part.column(at).to_pylist()], pa.float64())], names=schema.names)
        del of
        release_memory()

    return docs.mapInArrow(run, schema)
