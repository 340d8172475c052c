"""op7 and op9 by brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests_llm_hand import cut_by_hand, hand_components, hand_fingerprint, hits_by_hand
from tidelog.llm import simhash
from tidelog.llm.common import stored
from tidelog.llm.decontaminate import SuffixAutomaton, cut_leaks, find_leaks
from tidelog.llm.decontaminate import words as own_words
from tidelog.llm.simhash import BKForest, components, fingerprint, keep_one, linked, near_duplicates


def corpus(seed, n, letters="abc"):
    R = random.Random(seed)
    say = lambda k: " ".join(R.choice(letters) for _ in range(k))
    items = [(i, say(R.choice([0, 1, 3, 5, 8, 9, 14, 30]) if letters == "abcdefgh" else R.choice([0, 6, 7, 8, 9, 14, 30]))) for i in range(20)] + [(3, say(9)), (None, say(10)), (21, None), (22, "Same Words, repeated; same words REPEATED same words repeated")]
    docs = []
    for i in range(n):
        parts = [say(R.randint(0, 20))]
        for _ in range(R.randint(0, 3)):
            w = (R.choice(items)[1] or "").split()
            a = R.randint(0, max(0, len(w) - 8))
            parts += [" ".join(w[a : a + R.randint(4, 20)]), say(R.randint(0, 6))]
        docs.append((i, " ".join(parts)))
    return items, docs


@pytest.mark.parametrize("letters, most", [("abc", 250_000), ("abcdefgh", 250_000), ("abcdefgh", 40)])
def test_leaks_by_hand(spark, words, odd_texts, letters, most):
    items, docs = corpus(len(letters), 40, letters)
    docs += [(1000 + i, x) for i, x in enumerate(odd_texts)] + [(0, docs[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).repartition(3)
    got = find_leaks(table, bench, most_words=most)
    by = {(r.doc_id, r.text): r for r in got.collect()}
    assert got.count() == len(docs)
    for i, text in docs:
        r, (hit, found) = by[i, text], hits_by_hand(text, items, words)
        assert r._n_words == len(words(text))
        assert {p for s in r._spans for p in range(s.a, s.b)} == hit
        assert sum(s.b - s.a for s in r._spans) == len(hit)
        assert set(r._items) == found and len(r._items) == len(found)
    assert find_leaks(table.limit(0), bench).count() == 0
    assert find_leaks(table, bench.limit(0)).where(F.size("_items") > 0).count() == 0


def test_words_agree(words, odd_texts):
    for x in odd_texts:
        assert [w.decode() for w in own_words(x)] == words(x)


def test_automaton_holds_every_window():
    R, made, sequences = random.Random(9), SuffixAutomaton(4), []
    for i in range(30):
        own = [bytes([R.choice(b"xyz")]) for _ in range(R.randint(1, 15))]
        sequences.append((str(i), own))
        made.add(str(i), own)
    made.seal()
    for _, own in sequences:
        for k in range(1, len(own) + 1):
            for at in range(len(own) - k + 1):
                part, state = own[at : at + k], 0
                for w in part:
                    state = made.next[state][made.number[w]]
                holding = {i for i, s in sequences if any(s[j : j + k] == part for j in range(len(s) - k + 1))}
                assert made.items[state] == holding


def test_cut(spark, words):
    passage = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, passage), (2, "alpha beta gamma delta epsilon zeta eta theta iota")], "item_id long, text string")
    rows = [(1, "Before, all is well here and stays so (One TWO three four-five six seven eight nine ten) after."), (2, passage), (3, "clean text; one two three four"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in cut_leaks(docs, bench, max_coverage=0.6).collect()}
    assert got == {1: "Before, all is well here and stays so ( ) after.", 3: rows[2][1], 4: None, 5: ""}


@pytest.mark.parametrize("most", [250_000, 40])
def test_cut_takes_one_worker_a_task(spark, words, odd_texts, most):
    """Finding and cutting is one pass of one Python worker, whether the items fit one part or not; what is cut agrees with the brute force."""
    items, docs = corpus(8, 40, "abcdefgh")
    docs += [(1000 + i, x) for i, x in enumerate(odd_texts)] + [(0, docs[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1)).repartition(3)
    got = cut_leaks(table, bench, most_words=most)
    assert got.columns == table.columns
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    known = [(i, x or "") for i, x in items]
    want = [(i, new) for i, x in docs if (new := cut_by_hand(x or "", known, words)) is not None]
    assert len(want) < len(docs)
    assert sorted((r.doc_id, r.text or "") for r in got.collect()) == sorted(want)
    assert sum(r.text is None for r in got.collect()) == 1
    few = cut_leaks(table, bench, most_words=most, min_items=3, max_coverage=0.9).collect()
    marked = find_leaks(table, bench, most_words=most).collect()
    assert sorted(r.doc_id for r in few) == sorted(r.doc_id for r in marked if len(r._items) < 3 or sum(s.b - s.a for s in r._spans) <= 0.9 * r._n_words)


def test_fingerprints(lowered, odd_texts):
    R = random.Random(3)
    texts = odd_texts + [" ".join(R.choice(["A", "bb", "Ccc", "é"]) for _ in range(R.randint(0, 12))) for _ in range(200)]
    for x in texts:
        assert fingerprint(x) == hand_fingerprint(x, lowered)


def flipped(R, n, centres):
    out = set(centres)
    while len(out) < n:
        x = R.choice(sorted(out)) if R.random() < 0.5 else R.choice(centres)
        for _ in range(R.randint(1, 4)):
            x ^= 1 << R.randrange(64)
        out.add(x)
    return sorted(out)


def test_forest_finds_all_within_radius():
    R = random.Random(6)
    fp = np.array(flipped(R, 400, [R.getrandbits(64) for _ in range(6)]), np.uint64)
    group = np.sort(np.array([R.randrange(3) for _ in fp]))
    forest = BKForest(group, fp)
    q, node = forest.search(group, fp)
    want = {(i, j) for i in range(len(fp)) for j in range(len(fp)) if group[i] == group[j] and int(np.bitwise_count(fp[i] ^ fp[j])) <= 3}
    assert set(zip(q.tolist(), node.tolist(), strict=True)) == want and len(q) == len(want)
    u, v = linked(group, fp, np.ones(len(fp), bool), np.ones(len(fp), bool), slice_=37)
    assert len(u) == len(fp) - len(set(_classes(want, len(fp))))  # a forest: one link less than members in each class


def _classes(pairs, n):
    root = list(range(n))
    for _ in range(n):
        moved = False
        for a, b in pairs:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                moved = True
        if not moved:
            break
    return root


@pytest.mark.parametrize("most", [16_384, 5])
def test_links_of_fingerprints(spark, most):
    from tidelog.llm.simhash import links

    R = random.Random(8)
    fps = flipped(R, 150, [R.getrandbits(64) for _ in range(4)])
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    stars = components(links(spark.createDataFrame([(x,) for x in signed], "fp long"), most)).collect()
    top = {r.u: r.v for r in stars}
    got = [top.get(x, x) for x in signed]
    want = hand_components(fps, list(range(len(fps))))
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_spread(spark, how):
    from tidelog.llm.common import spread_join

    rows = [(7, i) for i in range(3000)] + [(8, None)] * 40 + [(i, i) for i in range(100, 2000)] + [(99, 1)]
    left = spark.createDataFrame(rows, "k long, _part long")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("_part").alias("top")).where("k <> 99")
    got = spread_join(left, right, ["k"], weight="n", total=left.count(), salt=F.xxhash64("_part"), how=how, share=100)
    assert got.columns == ["k", "_part", "n", "top"]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, left.join(right, "k", how).collect()))
    was = {x: spark.conf.get(x) for x in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for x, y in zip(was, ("-1", "false"), strict=True):
            spark.conf.set(x, y)
        most = lambda df: max(r[1] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)), F.max("top")).collect())
        spread = spread_join(left, right, ["k"], weight="n", total=left.count(), salt=F.xxhash64("_part"), how=how, share=100)
        assert most(spread) < 1500 < 3000 <= most(left.join(right, "k", how))
    finally:
        for x, y in was.items():
            spark.conf.set(x, y)


def test_a_hub_and_a_large_component(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(5000, i) for i in range(3000, 5000)]
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 3000)} | {i: 3000 for i in range(3001, 5001)}


def test_small_tables_are_few_files(spark, monkeypatch):
    made = []
    monkeypatch.setattr(simhash, "stored", lambda df, name: made.append((name, stored(df, name))) or made[-1][1])
    star = spark.createDataFrame([(x, 1) for x in range(2, 300)] + [(400, 399)], "u long, v long")
    assert components(star).count() == 299 and [n for n, _ in made] == ["edges"]  # stars need no round
    made.clear()
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        chain = [f"{'a b c d e f g h i j k l m n o p ' * 9}{i} {i + 1}" for i in range(200)]
        assert keep_one(spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")).count() <= 200
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    most = spark.sparkContext.defaultParallelism
    assert {"distinct", "labels", "kept"} <= {n for n, _ in made} and all(len(df.inputFiles()) <= most for n, df in made if n != "fingerprints"), [(n, len(df.inputFiles())) for n, df in made]


def test_copies_by_hand(spark, lowered, odd_texts):
    R = random.Random(5)
    base = [" ".join(R.choice("red blue green grey black white pink".split()) + str(R.randrange(30)) for _ in range(120)) for _ in range(6)]
    rows = [(i, x) for i, x in enumerate(base)] + [(50 + i, base[i % 6] + " end") for i in range(12)] + [(200 + i, x) for i, x in enumerate(odd_texts)] + [(None, base[0]), (2, base[2]), (None, "alone with no key at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).repartition(3)
    fps = [hand_fingerprint(t, lowered) for _, t in rows]
    want = hand_components(fps, [k for k, _ in rows])
    got = near_duplicates(docs).collect()
    key = lambda k, f, c: (k is None, k or 0, f, c is None, c or 0)
    assert sorted(key(r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted(key(k, f"{f:016x}", c) for (k, _), f, c in zip(rows, fps, want, strict=True))
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    own = kept.collect()
    classes = {}
    for (k, t), c, f in zip(rows, want, fps, strict=True):
        classes.setdefault(c if c is not None else ("null", f), []).append(k)
    assert len(own) == len(classes)
    assert sorted(r.doc_id for r in own if r.doc_id is not None) == sorted(c for c in classes if not isinstance(c, tuple))
    assert near_duplicates(docs.limit(0)).count() == 0 and keep_one(docs.limit(0)).count() == 0
