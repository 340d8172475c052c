"""Exact top-k by inner product with a pivot table.

Components are quantised to integers. For every vector the distances to the pivots (the origin and vectors far from each
other, picked from a bounded sample) are computed once and stored in blocks: the pivot table. By the triangle
inequality |d(q,p) - d(x,p)| is no more than d(q,x), and q.x = (|q|^2 + |x|^2 - d(q,x)^2) / 2; the largest such bound over
the pivots limits the score from above. Rows of a block are near the same pivot, and a block knows the least and largest distance to each
pivot: a block whose limit is below a query's k-th best score so far (to begin with, that over the sample) is left out whole. In the other blocks a query's
candidates are evaluated in the order of their limits, until the limit is below the k-th best score. All results are exact. How many pairs are left to
evaluate depends on the vectors: clusters are skipped, while for directions without structure in many dimensions no bound by pivots says much.
`Search.pairs` and `Search.evaluated` count.

One job holds all blocks against all queries. Queries are stored in parts of about query_block rows; each task reads the blocks of its own partition once, and then
one part after the other from the shared folder, so neither a task nor the driver holds more than one part. Each task gives k rows a query, and those meet in one ranking.

Defined results: a vector that is null, or holds a null or a component that isn't finite, takes no part, nor does a row without id;
an empty vector has score 0 with other empty ones. Only vectors of one length are compared. A query's own rows (those of its id) are
no candidates. Repeated rows are candidates of their own; a query that is repeated is answered once. Fewer candidates than k: all
of them. An empty table gives no rows. Components of any finite size are multiplied exactly; scores beyond the range of long are cut to it. Vectors of any length
are taken whole. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import open_fs, scratch, ship, stored

BLOCK = "dim int, n int, kind string, ids binary, vecs binary, table binary"
EXACT = 2.0**53


def quantised(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """(id, vec) of the rows that take part; components floor(scale * x) as doubles."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & sound).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1)
            flat = np.floor(scale * x.flatten().to_numpy(zero_copy_only=False))
            ends = np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["id", "vec"])

    return rows.mapInArrow(run, "id long, vec array<double>")


def far_apart(sample: np.ndarray, pivots: int) -> np.ndarray:
    """The origin, then vectors of the sample, each the farthest from those before; vectors whose squares overflow are no pivots."""
    sample = sample[np.abs(sample).max(axis=1, initial=0) < 1e100]
    out = [np.zeros(sample.shape[1])]
    near = ((sample - out[0]) ** 2).sum(1)
    while len(out) < pivots and len(sample) and near.max() > 0:
        out.append(sample[int(near.argmax())])
        near = np.minimum(near, ((sample - out[-1]) ** 2).sum(1))
    return np.array(out)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """To each pivot; infinite where squares overflow."""
    with np.errstate(over="ignore"):
        return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], axis=1)


def _pivots(of: dict, dim: int) -> np.ndarray:
    return of.get(dim, np.zeros((1, dim)))


def pivot_table(rows: DataFrame, pivots: dict[int, np.ndarray], block_rows: int = 1024, together: int = 16) -> DataFrame:
    """rows (id, vec) in blocks of one length, with the distances to the pivots. `together` blocks are filled at a time, by the nearest pivot."""

    def packed(dim: int, ids: list, vecs: list) -> Iterator[dict]:
        own = np.array(ids, np.int64)
        x = np.array(vecs, np.float64).reshape(len(own), dim)
        table = distances(x, _pivots(pivots, dim))
        order = np.lexsort((own, table.min(1), table.argmin(1)))
        for at in range(0, len(own), block_rows):
            some = order[at : at + block_rows]
            some = some[np.argsort(own[some], kind="stable")]
            part = x[some]
            kind = next(k for k in ("<i2", "<i4", "<f8") if k == "<f8" or not part.size or np.abs(part).max() <= np.iinfo(k).max)
            yield {"dim": dim, "n": len(some), "kind": kind, "ids": own[some].tobytes(), "vecs": part.astype(kind).tobytes(), "table": table[some].astype("<f8").tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        names = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("vecs", pa.binary()), ("table", pa.binary())])
        most = block_rows * together
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = x.values.to_numpy()
                ids, vecs = held.setdefault(len(v), ([], []))
                ids.append(i)
                vecs.append(v)
                if len(ids) >= most or len(ids) * len(v) >= 1 << 22:
                    yield pa.RecordBatch.from_pylist(list(packed(len(v), *held.pop(len(v)))), names)
        for dim, (ids, vecs) in held.items():
            yield pa.RecordBatch.from_pylist(list(packed(dim, ids, vecs)), names)

    return stored(rows.mapInArrow(run, BLOCK), "pivots")


class Search:
    """The queries of one length, with their k best so far. pairs: (query, row) pairs met; evaluated: those whose product was taken."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, seed: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        with np.errstate(over="ignore"):
            self.square, self.table = (x**2).sum(1), distances(x, pivots)
        self.seed = seed  # the k-th best score over the sample, or -inf
        self.score, self.best = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)  # a place without a candidate has score -inf
        self.pairs = self.evaluated = 0

    def least(self) -> np.ndarray:
        return np.maximum(self.seed, self.score[:, -1]).astype(float)

    def _limit(self, apart: np.ndarray, squares: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            found = (squares - apart**2) / 2 + 1e-9 * squares + 1e-3  # room for rounding
        return np.where(np.isfinite(found), found, np.inf)  # what overflows limits nothing

    def limits(self, x: np.ndarray, table: np.ndarray) -> np.ndarray:
        """The most that each query can score with each row of x."""
        apart = np.zeros((len(self.x), len(x)))
        with np.errstate(over="ignore", invalid="ignore"):
            for p in range(self.table.shape[1]):
                np.fmax(apart, np.abs(self.table[:, p, None] - table[None, :, p]), out=apart)
            return self._limit(apart, self.square[:, None] + (x**2).sum(1)[None, :])

    def open_(self, x: np.ndarray, table: np.ndarray) -> np.ndarray:
        """The queries that can score enough with any row of a block, by its least and largest distances to the pivots."""
        with np.errstate(over="ignore", invalid="ignore"):
            low, high = table.min(0), table.max(0)
            apart = np.fmax(0, np.fmax(low[None] - self.table, self.table - high[None])).max(1)
            return np.flatnonzero(self._limit(apart, self.square + (x**2).sum(1).max()) >= self.least())

    def products(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Exact products of queries number q with the rows of x: (len(q), n), or (len(q), w) for x of shape (len(q), w, dim)."""
        own = self.x[q]
        with np.errstate(over="ignore"):
            plain = not x.size or np.abs(own).max(initial=0) * np.abs(x).max(initial=0) * x.shape[-1] < EXACT
        if plain:
            return own @ x.T if x.ndim == 2 else np.einsum("qd,qwd->qw", own, x)
        wide = np.vectorize(int, otypes=[object])
        a, b = wide(own), wide(x)
        out = np.array([(b @ a[i] if x.ndim == 2 else b[i] @ a[i]) for i in range(len(q))], object)
        return np.clip(out, -(1 << 63), (1 << 63) - 1)

    def offer(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Takes candidates, (len(q), w) each, where the score isn't -inf."""
        scores = np.concatenate([self.score[q].astype(scores.dtype), scores], axis=1)
        ids = np.concatenate([self.best[q], ids], axis=1)
        order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        if scores.dtype == object and self.score.dtype != object:
            self.score = self.score.astype(object)
        self.score[q], self.best[q] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)

    def block(self, ids: np.ndarray, x: np.ndarray, table: np.ndarray) -> None:
        n = len(ids)
        self.pairs += len(self.ids) * n
        if not n or not len(active := self.open_(x, table)):
            return
        limit = np.full((len(self.ids), n), -np.inf)
        limit[active] = self.limits(x, table)[active] if len(active) == len(self.ids) else Search.limits(_Some(self, active), x, table)
        limit[self.ids[:, None] == ids[None, :]] = -np.inf
        order = np.zeros(limit.shape, np.int64)
        order[active] = np.argsort(-limit[active], axis=1)
        at, width = 0, 32
        while at < n:
            most = limit[active, order[active, at]]
            active = active[(most >= self.least()[active]) & (most > -np.inf)]
            if not len(active):
                return
            width = min(n - at, max(16, min(2 * width, (1 << 22) // max(1, len(active) * max(1, x.shape[1])))))
            some = order[active, at : at + width]
            mine = np.take_along_axis(limit[active], some, 1)
            scores = np.where(mine == -np.inf, -np.inf, self.products(active, x[some]))
            self.evaluated += int((mine > -np.inf).sum())
            self.offer(active, ids[some], scores)
            at += width


class _Some:
    """Some of a search's queries, for their limits alone."""

    def __init__(self, of: Search, q: np.ndarray):
        self.x, self.table, self.square, self._limit = of.x[q], of.table[q], of.square[q], of._limit


def _seeded(ids: np.ndarray, x: np.ndarray, sample: tuple[np.ndarray, np.ndarray] | None, k: int) -> np.ndarray:
    """The k-th best score of each query over the sample, a little lowered; -inf where the sample has fewer."""
    seed = np.full(len(ids), -np.inf)
    if sample is None or len(sample[0]) <= k:
        return seed
    search = Search(ids, x, np.zeros((1, x.shape[1])), seed, k)
    scores = np.where(ids[:, None] == sample[0][None, :], -np.inf, search.products(np.arange(len(ids)), sample[1]))
    seed = -np.sort(-scores, axis=1)[:, k - 1].astype(float)
    return seed - np.abs(np.where(np.isfinite(seed), seed, 0)) * 1e-12


def exact_top_k(vectors: DataFrame, is_query: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = 10, scale: float = 1024, pivots: int = 64, sample: int = 1024, query_block: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors that is_query picks, the k best other rows; ties to smaller ids.

    sample: rows, those of smallest hash, from which pivots and first limits come.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = quantised(vectors, key, vector, scale)
    few = rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()  # bounded by the parameter
    seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {len(r[1]) for r in few}:
        own = [r for r in few if len(r[1]) == dim]
        seeds[dim] = np.array([r[0] for r in own], np.int64), np.array([r[1] for r in own], np.float64).reshape(len(own), dim)
    chosen = {dim: far_apart(x, pivots) for dim, (_, x) in seeds.items()}
    blocks = pivot_table(rows, chosen)
    queries = quantised(vectors.where(is_query), key, vector, scale).distinct().withColumn("_n", F.xxhash64("id", "vec"))
    parts = max(1, -(-queries.count() // query_block))
    home = scratch(spark, "queries")
    part = F.pmod(F.xxhash64("id", F.lit("part")), F.lit(parts)).cast("int")
    queries.withColumn("_part", part).repartition("_part").write.partitionBy("_part").parquet(home)
    found = stored(blocks.mapInArrow(_searching(home, parts, chosen, seeds, k), "query_id long, _n long, vec_id long, score long"), "found")
    order = Window.partitionBy("query_id", "_n").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searching(home: str, parts: int, chosen: dict, seeds: dict, k: int, most_bytes: int = 128 << 20):
    """For mapInArrow over blocks: all queries under home against them, k rows a query for each most_bytes of blocks."""

    def queries(part: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, path = open_fs(f"{home}/_part={part}")
        if store.get_file_info(path).type != fs.FileType.Directory:
            return
        names = [x.path for x in store.get_file_info(fs.FileSelector(path)) if x.base_name.endswith(".parquet")]
        table = pa.concat_tables([pq.ParquetFile(store.open_input_file(x)).read(["id", "_n", "vec"]) for x in sorted(names)])
        ids, n, vecs = table["id"].to_numpy(), table["_n"].to_numpy(), table["vec"].combine_chunks()
        size = vecs.value_lengths().to_numpy()
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = vecs.flatten().to_numpy(zero_copy_only=False)
        for dim in np.unique(size):
            at = np.flatnonzero(size == dim)
            yield int(dim), ids[at], n[at], np.array([flat[ends[i] : ends[i + 1]] for i in at], np.float64).reshape(len(at), dim)

    def against(held: list[dict]) -> Iterator[pa.RecordBatch]:
        for part in range(parts):
            for dim, ids, n, x in queries(part):
                if not any(b["dim"] == dim for b in held):
                    continue
                search = Search(ids, x, _pivots(chosen, dim), _seeded(ids, x, seeds.get(dim), k), k)
                for b in held:
                    if b["dim"] == dim:
                        rows = np.frombuffer(b["vecs"], b["kind"]).astype(np.float64).reshape(b["n"], dim)
                        search.block(np.frombuffer(b["ids"], np.int64), rows, np.frombuffer(b["table"], "<f8").reshape(b["n"], -1))
                there = search.score != -np.inf
                q = np.nonzero(there)[0]
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(n[q]), pa.array(search.best[there]), pa.array([int(v) for v in search.score[there]], pa.int64())], names=["query_id", "_n", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for b in batch.to_pylist():
                held.append(b)
                size += len(b["vecs"]) + len(b["table"])
                if size >= most_bytes:
                    yield from against(held)
                    held, size = [], 0
        if held:
            yield from against(held)

    return run
