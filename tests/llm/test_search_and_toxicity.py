"""op5 by brute force; op8 by held-out rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import toxicity
from tidelog.llm.common import stored
from tidelog.llm.topk import Search, _seeded, distances, exact_top_k, far_apart
from tidelog.llm.toxicity import ToxicityModel, features, fit_nnpu, held_out, score, train


def by_hand(rows, is_query, k, scale=1024):
    sound = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {(i, q) for i, q in sound if is_query(i)}:
        scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v, strict=True)))), j) for j, v in sound if j != i and len(v) == len(q))[:k]
        out += [(i, n, j, -s) for n, (s, j) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["random", "ties", "clusters", "huge", "overflow"])
def test_top_k(spark, kind):
    R = random.Random(len(kind))
    if kind == "random":
        rows = [(i, [R.gauss(0, 0.2) for _ in range(16)]) for i in range(400)]
    elif kind == "ties":
        rows = [(i, [float(R.randint(-1, 1)) for _ in range(3)]) for i in range(300)] + [(9, [1.0, 1.0, 1.0])] * 15
    elif kind == "clusters":
        centres = [[R.gauss(0, 1) for _ in range(8)] for _ in range(5)]
        rows = [(i, [x + R.gauss(0, 0.01) for x in R.choice(centres)]) for i in range(500)]
    elif kind == "overflow":
        rows = [(i, [R.choice([1e160, -1e160, 1e300, 2.0, 0.0]) for _ in range(3)]) for i in range(40)] + [((1 << 63) - 1, [1e160, 1.0, 1.0])]
    else:
        rows = [(i, [R.choice([1e13, -1e13, 3.0]) for _ in range(4)]) for i in range(60)]
    width = len(rows[0][1])
    rows += [(1000, None), (1010, [None] * width), (1020, [float("nan")] * width), (1030, [float("inf")] + [0.0] * (width - 1)), (None, [1.0] * width), (1040, []), (1050, []), (1060, [0.5])]
    rows += [rows[0], (0, rows[1][1])]  # a repeated query, and one id with two vectors
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).repartition(3)
    for block, sample in ((1024, 1024), (7, 5)):
        got = exact_top_k(table, F.col("vec_id") % 10 == 0, k=4, query_block=block, sample=sample)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(map(tuple, got.collect())) == by_hand(rows, lambda i: i % 10 == 0, 4)
    assert exact_top_k(table.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_limits_hold():
    G = np.random.default_rng(1)
    x, q = np.floor(G.normal(0, 200, (300, 12))), np.floor(G.normal(0, 200, (20, 12)))
    pivots = far_apart(x[:50], 6)
    s = Search(np.arange(20), q, pivots, np.full(20, -np.inf), 3)
    assert (s.limits(x, distances(x, pivots)) >= q @ x.T).all()


def test_pivots_eliminate():
    """In clusters nearly all pairs go by their limits, most by whole blocks; without structure none do. Results are those of the full product either way."""
    G, k = np.random.default_rng(4), 5
    centres = G.normal(0, 1, (40, 32))
    near = np.floor(1024 * (centres[G.integers(0, 40, 6000)] + G.normal(0, 0.02, (6000, 32))))
    for x, most in ((near, 0.05), (np.floor(1024 * G.normal(0, 1, (2000, 64))), 1.0)):
        pivots, order = far_apart(x[:1000], 64), np.arange(len(x))
        table = distances(x, pivots)
        order = np.argsort(table.argmin(1), kind="stable")
        q = np.arange(0, len(x), 100)
        s = Search(q, x[q], pivots, _seeded(q, x[q], (np.arange(1000), x[:1000]), k), k)
        for at in range(0, len(x), 256):
            some = np.sort(order[at : at + 256])
            s.block(some, x[some], table[some])
        assert s.pairs == len(q) * len(x) and s.evaluated <= most * s.pairs
        scores = x[q] @ x.T
        scores[np.arange(len(q)), q] = -np.inf
        want = np.array([np.lexsort((np.arange(len(x)), -row))[:k] for row in scores])
        assert (s.best == want).all()


def crowd(n, seed=1):
    R = random.Random(seed)
    say = lambda k: [R.choice(["alpha", "beta", "gamma", "delta", "omega", "river", "stone"]) + str(R.randrange(40)) for _ in range(k)]
    docs, labels = [], []
    for i in range(n):
        bad = R.random() < 0.15
        own = say(R.randint(5, 80))
        for _ in range(R.randint(2, 5) if bad else 0):
            own.insert(R.randrange(len(own)), R.choice(["vilest", "grubnard" + R.choice("abcd"), "scoundrel"]))
        docs.append((i, " ".join(own), bad))
        if R.random() < 0.6:
            labels.append((i, int(bad)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark, odd_texts):
    docs, labels = crowd(1500)
    table = spark.createDataFrame([(i, t) for i, t, _ in docs] + [(10_000 + i, x) for i, x in enumerate(odd_texts)] + [(None, "vilest")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    marks = spark.createDataFrame(labels + [(None, 1), (3, None), (labels[0][0], labels[0][1])], "doc_id long, toxic int")
    model = train(table, marks)
    got = score(table, model).withColumn("out", held_out()).collect()
    assert len(got) == table.count() and all(0 <= r.score <= 1 for r in got)
    truth = {i: bad for i, _, bad in docs}
    tested = [(r.score, truth[r.doc_id]) for r in got if r.out and r.doc_id in truth]
    assert len(tested) > 200
    caught = [s >= 0.3 for s, bad in tested if bad]
    wrong = [s >= 0.3 for s, bad in tested if not bad]
    assert sum(caught) / len(caught) > 0.95 and sum(wrong) / len(wrong) < 0.02
    assert score(table.limit(0), model).count() == 0


def test_labels_of_held_out_rows_are_not_learnt(spark):
    docs, labels = crowd(300, 2)
    table = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    turned = marks.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert train(table, marks) == train(table, turned)


def test_nothing_to_learn_from(spark):
    table = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = train(table, none)
    assert model == ToxicityModel()
    assert [r.score for r in score(table, model).collect()] == [0.0, 0.0]
    assert train(table.limit(0), spark.createDataFrame([(1, 1), (3, 1), (4, 1), (5, 0)], "doc_id long, toxic int")).weights == {}


def test_risk_does_not_fall_below_zero():
    R = random.Random(4)
    p = [[R.randrange(50)] for _ in range(40)]
    u = [[R.randrange(50)] for _ in range(200)]  # the same texts: no weights tell them apart
    weight, bias = fit_nnpu(p, u, 50, 0.3)
    assert np.isfinite(weight).all() and math.isfinite(bias) and np.abs(weight).max() < 60
    assert len(features(b"ab")) == 1 and len(features("wörtlich".encode())) == 4


def fit_by_hand(rows_p, rows_u, n, prior, steps, warm, rate=0.05, decay=1e-4):
    """The same descent in plain loops, with gradients by small differences of the risk as it is defined."""

    def risks(w, step):
        z = lambda x: sum(w[j] for j in x) + w[n]
        if step <= warm:
            plus, minus = (lambda v: math.log1p(math.exp(-v))), (lambda v: math.log1p(math.exp(v)))
        else:
            plus, minus = (lambda v: 1 / (1 + math.exp(v))), (lambda v: 1 / (1 + math.exp(-v)))
        mean = lambda f, rows: sum(f(z(x)) for x in rows) / len(rows)
        return prior * mean(plus, rows_p), mean(minus, rows_u) - prior * mean(minus, rows_p)

    w, m, v = [0.0] * (n + 1), [0.0] * (n + 1), [0.0] * (n + 1)
    for step in range(1, steps + 1):
        negative = risks(w, step)[1]
        g = []
        for j in range(n + 1):
            up, down = [x + 1e-5 * (i == j) for i, x in enumerate(w)], [x - 1e-5 * (i == j) for i, x in enumerate(w)]
            a, b = risks(up, step), risks(down, step)
            own = sum(a) - sum(b) if negative >= 0 else b[1] - a[1]  # a negative risk below zero is gone against
            g.append(own / 2e-5 + (decay * w[j] if j < n else 0))
        for j in range(n + 1):
            m[j], v[j] = 0.9 * m[j] + 0.1 * g[j], 0.999 * v[j] + 0.001 * g[j] ** 2
            w[j] -= rate * (m[j] / (1 - 0.9**step)) / (math.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    return w


def test_fit_by_hand():
    R = random.Random(3)
    rows_p = [[R.choice([0, 0, 1, 2]) for _ in range(R.randint(1, 3))] for _ in range(12)]
    rows_u = [[R.choice([0, 1, 2, 3, 3, 3]) for _ in range(R.randint(0, 3))] for _ in range(30)]
    for prior in (0.2, 0.6):  # with the larger, the negative risk falls below zero
        weight, bias = fit_nnpu(rows_p, rows_u, 4, prior, steps=40, warm=20)
        assert np.allclose([*weight, bias], fit_by_hand(rows_p, rows_u, 4, prior, 40, 20), atol=2e-3)


def test_sample_is_bounded_by_rows(spark):
    """A key that comes often gives one text."""
    docs, labels = crowd(300)
    docs = [(i, t) for i, t, _ in docs]
    many = spark.createDataFrame(docs, "doc_id long, text string").union(spark.createDataFrame([docs[0]] * 3000 + [(docs[0][0], "another text")], "doc_id long, text string"))
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    one = train(spark.createDataFrame(docs, "doc_id long, text string"), table)
    other = train(many.where(F.col("text") != "another text"), table)
    assert one.weights.keys() == other.weights.keys() and abs(one.bias - other.bias) < 1e-6
    assert train(many, table).prior == one.prior


def test_training_starts_no_workers_for_rows_of_a_list(spark, monkeypatch):
    """Rows from a list go through Python workers of another kind than the operators' own; both kinds would be kept in every executor."""
    from pyspark import RDD

    rows = [(i, "bad words here" if i % 2 else "good words there") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")

    def refused(self):
        raise AssertionError("rows of a list")

    monkeypatch.setattr(RDD, "_to_java_object_rdd", refused)
    assert train(docs, labels).weights


def test_sample_is_few_files(spark, monkeypatch):
    """Hadoop's local file system starts processes for every file, so their number follows the rows, not the partitions of shuffles."""
    made = []
    monkeypatch.setattr(toxicity, "stored", lambda df, name, **how: made.append((name, stored(df, name, **how))) or made[-1][1])
    rows = [(i, "good words there" if i % 4 else "bad words here") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        model = train(docs, labels)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    files, tables = {n: len(df.inputFiles()) for n, df in made}, dict(made)
    assert files["features"] <= max(spark.sparkContext.defaultParallelism, 20_000 // 2_000), files  # 20,000 texts at most, 2,000 a part
    assert tables["features"].count() == tables["chosen"].count() and model.weights


def test_held_out_rows_of_the_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = score(docs, train(docs, labels)).join(known, "doc_id").where(held_out()).select("lang", "toxic", "score").collect()
    caught = [r for r in rows if r.toxic == 1 and r.score >= 0.3]
    print({x: (sum(r.lang == x for r in caught), sum(r.lang == x and r.toxic == 1 for r in rows)) for x in ("en", "de", "fr", "es")}, sum(r.toxic == 0 and r.score >= 0.3 for r in rows))
    assert len(caught) >= 0.85 * sum(r.toxic == 1 for r in rows)  # 105 of 120 when this was written; Spanish, of which 22 texts are known, 2 of 11
    assert sum(r.toxic == 0 and r.score >= 0.3 for r in rows) <= 0.01 * len(rows)
