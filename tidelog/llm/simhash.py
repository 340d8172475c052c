"""SimHash near-duplicates: 64-bit fingerprints, BK-trees keyed by Hamming distance, connected components.

Fingerprints are reduced to distinct ones. Two that differ in at most three bits agree in two of five blocks of bits, so
each is dealt to ten shards, one for each pair of blocks, by those blocks' bits. In each shard a BK-tree is built:
a child's key is its Hamming distance to the parent, and a search at distance d from a node follows only the edges from
d - 3 to d + 3. A shard emits a spanning forest of its links. Links become components by rounds of large-star and
small-star over stored tables. A fingerprint that very many rows share, a hub and a very large component are each dealt to
many tasks.

The trees live in the tasks that own their shards. Broadcasting them would broadcast the corpus's fingerprints, whose
number has no bound. A shard of more than `most` fingerprints is cut into chunks, and each pair of chunks is a cell of
its own (tree of one, searches of the other), so no task needs more than two chunks at once and no link is lost.

Defined results: null and empty texts, and those of white space only, have fingerprint zero and are linked like any other;
fewer words than a shingle make one shingle of them all; a null doc_id is no candidate for a component's smallest id
(null where all are null). Repeated rows and ties share a component. Texts of any length are taken whole. An empty table gives no rows. Other columns are left out by
near_duplicates and kept by keep_one, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import few_parts, filled, fresh, release_memory, ship, spread_join, stored
from tidelog.llm.common import own as whole

#: Widths of the blocks of bits, from the lowest. Two fingerprints at distance 3 agree in two of the five at least.
BLOCKS = (13, 13, 13, 13, 12)
RADIUS = 3


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint: bit k is 1 if set in over half the shingles' hashes."""
    from xxhash import xxh64_intdigest

    split = text.encode().lower().split() if text else []
    if not split:
        return 0
    raw = memoryview(b" ".join(split))
    ends = np.cumsum([len(w) + 1 for w in split]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(split) < shingle:
        hashes = [xxh64_intdigest(raw, seed)]
    else:
        hashes = [xxh64_intdigest(raw[a:b], seed) for a, b in zip(starts[: len(split) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    own, total = np.array(hashes, np.uint64), np.zeros(64, np.int64)
    for at in range(0, len(own), 4096):
        part = own[at : at + 4096]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(own), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, row, fp) of every row: its key, a hash of its text, and the fingerprint as a signed long."""
    ship(docs.sparkSession)
    own = docs.select(F.col(key).alias("doc"), F.xxhash64(filled(text)).alias("row"), filled(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fp = np.array([fingerprint(x) for x in part.column(2).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp)], names=["doc", "row", "fp"])
        release_memory()

    return own.mapInArrow(run, f"doc {own.schema['doc'].dataType.simpleString()}, row long, fp long")


class BKForest:
    """BK-trees over groups of distinct fingerprints, a tree for each group, built level by level as by insertion in order."""

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        """group: ascending numbers; fp: unsigned 64-bit."""
        n = len(fp)
        self.fp = fp
        self.groups, first = np.unique(group, return_index=True)
        self.roots = first
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        at = first[np.searchsorted(self.groups, group)]
        left = np.flatnonzero(at != np.arange(n))
        while len(left):
            d = np.bitwise_count(fp[left] ^ fp[at[left]]).astype(np.int64)
            _, lead, same = np.unique(at[left] * 65 + d, return_index=True, return_inverse=True)
            child = left[lead]
            parent[child], edge[child] = at[child], d[lead]
            at[left] = child[same]
            left = left[at[left] != left]
        inner = np.flatnonzero(parent >= 0)
        order = np.argsort(parent[inner] * 256 + edge[inner] + 64, kind="stable")
        self.child = inner[order]
        self.key = (parent[inner] * 256 + edge[inner] + 64)[order]

    def search(self, group: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """(query number, place) of all fingerprints within the radius in the query's group."""
        at = np.searchsorted(self.groups, group)
        there = np.flatnonzero((at < len(self.groups)) & (self.groups[np.minimum(at, len(self.groups) - 1)] == group)) if len(self.groups) else np.zeros(0, np.int64)
        query, node = there, self.roots[at[there]]
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        while len(query):
            d = np.bitwise_count(fp[query] ^ self.fp[node]).astype(np.int64)
            near = d <= radius
            hits.append((query[near], node[near]))
            low = np.searchsorted(self.key, node * 256 + d - radius + 64, "left")
            high = np.searchsorted(self.key, node * 256 + d + radius + 64, "right")
            number = high - low
            query = np.repeat(query, number)
            node = self.child[np.repeat(low - np.concatenate([[0], np.cumsum(number)[:-1]]), number) + np.arange(number.sum())] if len(number) else query
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in hits]), np.concatenate([x for _, x in hits])


def united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (place of each one's representative, the smallest of its class) after a[i] and b[i] have been put together."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def linked(group: np.ndarray, fp: np.ndarray, is_tree: np.ndarray, asks: np.ndarray, slice_: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in each group: rows with is_tree make the tree, rows that ask are searched in it."""
    rows = np.flatnonzero(is_tree)
    forest = BKForest(group[rows], fp[rows])
    label, queries = np.arange(len(fp)), np.flatnonzero(asks)
    for at in range(0, len(queries), slice_):
        own = queries[at : at + slice_]
        q, place = forest.search(group[own], fp[own])
        label = united(label, own[q], rows[place])
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def _block(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, sum(BLOCKS[:i])).bitwiseAND(F.lit((1 << BLOCKS[i]) - 1))


def links(distinct: DataFrame, most: int = 16_384) -> DataFrame:
    """(u, v), u != v: links between the fp of distinct that connect all that differ in three bits or fewer."""
    ship(distinct.sparkSession)
    fp = F.col("fp")
    shards = [F.shiftleft(F.lit(n).cast("long"), 26) + F.shiftleft(_block(fp, i), 13) + _block(fp, j) for n, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))]
    dealt = distinct.select("fp", F.explode(F.array(*shards)).alias("_shard"))
    large = dealt.groupBy("_shard").count().where(F.col("count") > most).select("_shard", F.ceil(F.col("count") / most).cast("int").alias("_chunks"))
    chunked = dealt.join(stored(large, "large"), "_shard", "left").withColumn("_own", F.when(F.col("_chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("_chunks"))).cast("int"))
    each = F.when(F.col("_chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_chunks") - 1))
    cells = chunked.select("_shard", "fp", "_own", F.explode(each).alias("_other"))
    cells = cells.select("_shard", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", "fp")
    cells = cells.repartition("_shard", "_i", "_j").sortWithinPartitions("_shard", "_i", "_j", "_own", "fp")

    def run(batches: Iterator[pa.RecordBatch], enough: int = 100_000) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held) if held else np.zeros((0, 5), np.int64)
            held.clear()
            if not len(rows):
                return
            new = (np.diff(rows[:, :3], axis=0) != 0).any(1)
            group = np.concatenate([[0], np.cumsum(new)])
            whole = np.ones(len(rows), bool) if last else group < group[-1]
            held.append(rows[~whole])
            rows, group = rows[whole], group[whole]
            size = np.bincount(group) if len(group) else np.zeros(0, np.int64)
            many = size[group] > 1
            rows, group = rows[many], group[many]
            if len(rows):
                same = rows[:, 1] == rows[:, 2]
                u, v = linked(group, rows[:, 4].view(np.uint64), same | (rows[:, 3] == rows[:, 1]), same | (rows[:, 3] == rows[:, 2]))
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
            if sum(map(len, held)) >= enough:
                yield from done(False)
        yield from done(True)

    return cells.mapInArrow(run, "u long, v long").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u is found once and is no v: then each v is the smallest of its component, as u > v."""
    ends = edges.select(F.col("u").alias("_x"), F.lit(1).alias("_u"), F.lit(0).alias("_v")).unionByName(edges.select(F.col("v").alias("_x"), F.lit(0).alias("_u"), F.lit(1).alias("_v")))
    return ends.groupBy("_x").agg(F.sum("_u").alias("_u"), F.max("_v").alias("_v")).where(F.col("_u") + F.col("_v") > 1).isEmpty()


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(u, v): each vertex of edges but a component's smallest, with that smallest. most: about how many rows edges are at most, if known."""
    pairs = lambda df: df.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stored(pairs(edges) if most is None else few_parts(pairs(edges), most), "edges")
    met = lambda some, least, most: spread_join(some, least, ["u"], weight="_n", total=most, salt=F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    while not _are_stars(edges):
        n = edges.count()
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(few_parts(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("_n")), 2 * n), "least")
        edges = stored(few_parts(pairs(met(both.where(F.col("v") > F.col("u")), least, 2 * n)), n), "large-star")
        n = edges.count()
        least = stored(few_parts(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")), n), "least")
        edges = stored(few_parts(pairs(met(edges, least, n).unionByName(least.select("u", F.col("m").alias("v")))), 2 * n), "small-star")
    return edges


def _classes(docs: DataFrame, key: str, text: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(doc, row, fp) of every row and, of every fp, (fp, component_id, _root, _rows)."""
    own = stored(fingerprints(docs, key=key, text=text), "fingerprints")
    distinct = stored(few_parts(own.groupBy("fp").agg(F.min("doc").alias("_least"), F.count(F.lit(1)).alias("_rows")), own.count()), "distinct")
    n = distinct.count()
    # each of the ten shards of a fingerprint links it to one other at most, but where shards are cut into chunks
    stars = components(links(distinct.select("fp"), most), 10 * n)
    rooted = distinct.join(stars, F.col("fp") == F.col("u"), "left").select("fp", "_least", "_rows", F.coalesce("v", "fp").alias("_root"))
    smallest = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    labelled = spread_join(rooted, smallest, ["_root"], weight="_n", total=n, salt=F.col("fp"))
    return own, stored(few_parts(labelled.select("fp", "component_id", "_root", "_rows"), n), "labels")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", most: int = 16_384) -> DataFrame:
    """(key, fingerprint, component_id) of every row: 16 hex digits, and the smallest key that is reachable over links."""
    own, labels = _classes(docs, key, text, most)
    # own is read from files, so a row's number is the same whenever it is read again
    joined = spread_join(own, labels, ["fp"], weight="_rows", total=own.count(), salt=F.monotonically_increasing_id())
    return joined.select(F.col("doc").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", most: int = 16_384) -> DataFrame:
    """One row of docs for each component: that of the smallest key, rows without a key last; of repeated rows, one."""
    own, labels = _classes(docs, key, text, most)
    least = own.groupBy("fp").agg(F.min(F.struct(F.col("doc").isNull().alias("n"), F.col("doc").alias("d"), F.col("row").alias("r"))).alias("x"))
    first = least.join(labels, "fp").groupBy("_root").agg(F.min("x").alias("x"))
    copies = own.groupBy("doc", "row").agg(F.count(F.lit(1)).alias("_copies"))
    kept = first.select(F.col("x.d").alias("_d"), F.col("x.r").alias("_r")).join(copies, F.col("_d").eqNullSafe(F.col("doc")) & (F.col("_r") == F.col("row"))).select("_d", "_r", "_copies")
    kept = stored(few_parts(kept, labels.count()), "kept")
    row, d, r, n = fresh(docs.columns, "_row", "_d", "_r", "_copies")
    rows, kept = docs.withColumn(row, F.xxhash64(filled(text))), kept.toDF(d, r, n)
    of = lambda some: rows.join(some, whole(key).eqNullSafe(F.col(d)) & (F.col(row) == F.col(r)), "left_semi")
    once, more = of(kept.where(F.col(n) == 1)), of(kept.where(F.col(n) > 1))
    return once.unionByName(more.dropDuplicates([key, row])).select(*[whole(c) for c in docs.columns])
