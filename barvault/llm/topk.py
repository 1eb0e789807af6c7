"""Exact top-k inner products by the threshold algorithm over sorted lists of each dimension."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barvault.llm.support import ship_package
from barvault.session import materialise

K = 5
SCALE = 256
BLOCK = 65_536  # vectors
COMPONENTS = 1 << 22  # of the vectors of a block, which are fewer if they are long
QUERY_BLOCK = 65_536
ROUND = 16
FIRST_DEPTH = 4
GROWTH = 4
DENSE = 4  # lists are read while their entries are at most one in DENSE of the rows
PRODUCTS = 1 << 22
LONG = 2**63


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; null for vectors that are null or have null or non-finite components.

    A component beyond a long's range takes the nearest long.
    """
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    edge = float(LONG)
    units = F.transform(
        x,
        lambda v: F.when(v * scale >= edge, F.lit(LONG - 1))
        .when(v * scale < -edge, F.lit(-LONG))
        .otherwise(F.floor(v * scale)),
    )
    return F.when(vector.isNotNull() & ~bad, units)


def _products(rows: np.ndarray, query: np.ndarray, exact_in_doubles: bool) -> np.ndarray:
    """Inner products as integers: in doubles while they are exact there, else with Python's, cut off at a long."""
    if exact_in_doubles:
        return rows @ query
    exact = (sum(int(a) * int(b) for a, b in zip(r, query, strict=True)) for r in rows)
    return np.array([max(-LONG, min(LONG - 1, score)) for score in exact], dtype=object)


def _read_lists(
    rows: np.ndarray, ids: np.ndarray, lists: np.ndarray, query: np.ndarray, k: int, exact_in_doubles: bool, floor: float | None
) -> tuple[np.ndarray, np.ndarray] | None:
    """The threshold algorithm for one query; None where the lists would have to be read too far to be of use."""
    n = len(rows)
    up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)

    def bound(depth: int) -> float:
        edge = np.zeros(len(query), dtype=rows.dtype)
        edge[up], edge[down] = rows[lists[up, n - depth - 1], up], rows[lists[down, depth], down]
        return _products(edge[None, :], query, exact_in_doubles)[0]

    width = len(up) + len(down)
    if not width:
        return None
    deepest = n // (DENSE * width)
    met = np.zeros(n, bool)
    scores, best = np.empty(0, dtype=rows.dtype), np.empty(0, dtype=np.int64)
    done, depth = 0, min(n, FIRST_DEPTH)
    while True:
        new = np.zeros(n, bool)
        new[lists[up, n - depth : n - done].ravel()] = True
        new[lists[down, done:depth].ravel()] = True
        new &= ~met
        met |= new
        fresh = np.flatnonzero(new)
        scores, best = _top(
            np.concatenate([scores, _products(rows[fresh], query, exact_in_doubles)]), np.concatenate([best, fresh]), ids, k
        )
        if met.all():
            return scores, best
        least = scores[-1] if len(best) == k else None
        if floor is not None and (least is None or least < floor):
            least = floor
        if least is not None and bound(depth) < least:
            return scores, best
        if depth >= deepest or (least is not None and bound(deepest) >= least):
            return None
        done, depth = depth, min(deepest, depth * GROWTH)


def threshold_top(
    rows: np.ndarray, ids: np.ndarray, lists: np.ndarray, query: np.ndarray, k: int, exact_in_doubles: bool, floor: float | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Scores and row numbers of the k best rows for one query, by falling score, then by rising id.

    ``lists`` has the row numbers of each dimension in rising order of its component. They are read from the top where
    the query's component is positive and from the bottom where it is negative, some entries of every list at a
    time; each row met is scored once. A row not met yet scores at most the sum of the query's products with the
    last components read. Reading stops when that bound is below the k-th score, or below ``floor``, a score that k
    rows elsewhere reach; on a tie it goes on, since an unseen row may have the smaller id. Where the bound after as many
    entries as a quarter of the rows is not below the k-th score known so far, random accesses to most rows would
    follow: all rows are then met and multiplied at once.
    """
    found = _read_lists(rows, ids, lists, query, k, exact_in_doubles, floor)
    return found or _top(_products(rows, query, exact_in_doubles), np.arange(len(rows)), ids, k)


def _top(scores: np.ndarray, at: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(scores) > 4 * k and scores.dtype != object:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= least
        scores, at = scores[near], at[near]
    order = sorted(range(len(scores)), key=lambda i: (-scores[i], ids[at[i]]))[:k]
    return scores[order], at[order]


class Block:
    """The vectors of one block with their sorted lists, built once for all queries that come by."""

    def __init__(self, ids: list[int | None], units: np.ndarray, k: int) -> None:
        self.ids = np.array([float("inf") if i is None else i for i in ids], dtype=object)
        self.k = k
        self.most = float(np.abs(units.astype(float)).max(initial=0))
        self.lists = np.argsort(units.T, axis=1, kind="stable").astype(np.int32)
        self.units = units
        self.floats = units.astype(float)
        self.objects = None

    def answers(self, queries: np.ndarray, floors: list[int | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place of the query, scores, row numbers) of up to k rows each, rows below the query's floor left out."""
        exact = self.most * float(np.abs(queries.astype(float)).max(initial=0)) * max(1, queries.shape[1]) < 2.0**53
        if not exact and self.objects is None:
            self.objects = self.units.astype(object)
        rows, asked = (self.floats, queries.astype(float)) if exact else (self.objects, queries.astype(object))
        whole = []
        for i, (query, floor) in enumerate(zip(asked, floors, strict=True)):
            found = _read_lists(rows, self.ids, self.lists, query, self.k, exact, floor)
            if found is None:
                whole.append(i)
            else:
                yield i, *self._reaching(*found, floor)
        step = max(1, PRODUCTS // len(rows))
        for first in range(0, len(whole), step):
            some = whole[first : first + step]
            products = asked[some] @ rows.T if exact else [_products(rows, asked[i], False) for i in some]
            for i, scores in zip(some, products, strict=True):
                at = np.arange(len(rows)) if floors[i] is None else np.flatnonzero(scores >= floors[i])
                yield i, *_top(scores[at], at, self.ids, self.k)

    @staticmethod
    def _reaching(scores: np.ndarray, at: np.ndarray, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        kept = np.array([floor is None or s >= floor for s in scores], dtype=bool)
        return scores[kept], at[kept]


FOUND = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("own", pa.int64())])


def _matrix(units: pa.ListArray, dim: int) -> np.ndarray:
    return units.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(units), dim)


def _answered(block: Block, queries: pa.RecordBatch, dim: int) -> pa.RecordBatch:
    asked = _matrix(queries["units"], dim)
    rows, ids, floors = (queries[c].to_pylist() for c in ("row", "vec_id", "floor"))
    out = []
    for i, scores, at in block.answers(asked, floors):
        own = max(-LONG, min(LONG - 1, sum(int(v) * int(v) for v in asked[i])))
        for score, j in zip(scores, at, strict=True):
            name = block.ids[j]
            out.append((rows[i], ids[i], None if name == float("inf") else name, int(score), own))
    columns = list(zip(*out, strict=True)) or [[]] * len(FOUND)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)


def _stream(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Answers of sorted rows: of each (dim, block, lane) the vectors come first, then the queries stream past them."""
    here, held, block = None, [], None
    for batch in batches:
        keys = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dim", "block", "lane", "asks")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
        for start, stop in zip(cuts, cuts[1:]):
            if start == stop:
                continue
            part, (dim, *_, asks) = batch.slice(start, stop - start), keys[start]
            if here != tuple(keys[start, :3]):
                here, held, block = tuple(keys[start, :3]), [], None
            if not asks:
                held.append((part["vec_id"].to_pylist(), _matrix(part["units"], dim)))
                continue
            if held:
                block, held = Block([i for ids, _ in held for i in ids], np.concatenate([u for _, u in held]), k), []
            if block is not None:
                yield _answered(block, part, dim)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    scale: int = SCALE,
    block: int = BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each query row, its own row left out.

    Vectors are dealt into blocks by hash, at most ``block`` of them or ``COMPONENTS`` components in each on average. A
    task sorts the lists of one block once and lets the queries stream past it, so it holds one block and one batch of
    queries. Blocks are searched in rounds: one, then up to 16, then up to 256 of them, and so on. The k + 1 best of
    all earlier rounds are written, and the last of them is the query's floor: the threshold that ends the reading of
    lists in the next round, where rows below it are not returned. A round of few blocks copies them, once for every
    ``query_block`` queries over the number of its blocks, so that no task has all queries. Each row is read in one
    round only; a query goes to every block.

    Vectors of different length are never compared. Every row of the table is a candidate of its own, also a
    repeated one; a repeated query row is answered again. A null id is no query and comes last among equal scores.
    Scores beyond a long take the nearest long. Fewer than k candidates give as many rows as there are; no queries or
    no vectors give no row.
    """
    ship_package(vectors.sparkSession)
    valid = materialise(
        vectors.select(
            F.col(key).cast("bigint").alias("vec_id"),
            quantised(F.col(vector), scale).alias("units"),
            F.coalesce(is_query, F.lit(False)).alias("asks"),
        )
        .where("units IS NOT NULL")
        .withColumn("dim", F.size("units"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    size = valid.agg(F.count(F.lit(1)).alias("rows"), F.count_if("asks").alias("queries"), F.sum("dim").alias("components")).first()
    blocks = max(1, -(-size["rows"] // block), -(-(size["components"] or 0) // COMPONENTS))
    # rows are dealt by their number too, so that one row repeated very often fills no block
    rows = valid.withColumn("block", F.pmod(F.xxhash64("vec_id", "row"), F.lit(blocks))).drop("asks")
    queries = valid.where("asks AND vec_id IS NOT NULL").drop("asks")
    best, start, stop = None, 0, 1
    while start < blocks:
        lanes = max(1, -(-size["queries"] // (query_block * (stop - start))))
        floored = queries.withColumn("floor", F.lit(None).cast("bigint"))
        if best is not None:
            floors = best.groupBy("query_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor"))
            floors = floors.where(F.col("n") == k + 1).select(F.col("query_row").alias("row"), "floor")
            floored = queries.join(floors, "row", "left")
        found = _search(rows.where(F.col("block").between(start, stop - 1)), floored, range(start, stop), lanes, k)
        best = materialise(_best(found if best is None else best.unionByName(found), k))
        start, stop = stop, min(blocks, stop * ROUND)
    # the query's own row is the first with its id and its score with itself, if it is among the k + 1 best at all
    own = F.coalesce((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.lit(False))
    mine = F.min(F.when(own, F.col("nth"))).over(Window.partitionBy("query_row"))
    return (
        best.withColumn("nth", _rank())
        .withColumn("mine", mine)
        .where(F.col("mine").isNull() | (F.col("nth") != F.col("mine")))
        .withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy("nth")))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _rank() -> Column:
    return F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))


def _best(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("nth", _rank()).where(F.col("nth") <= k + 1).drop("nth")


def _search(rows: DataFrame, queries: DataFrame, blocks: range, lanes: int, k: int) -> DataFrame:
    """(query_row, query_id, vec_id, score, own) of the k + 1 best rows of each block for each query."""
    columns = ["dim", "block", "lane", "asks", "row", "vec_id", "units", "floor"]
    placed = rows.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"),
        F.lit(False).alias("asks"), F.lit(None).cast("bigint").alias("floor"),
    )
    asked = queries.select(
        "*", F.explode(F.expr(f"sequence({blocks.start}L, {blocks.stop - 1}L)")).alias("block"),
        F.pmod(F.xxhash64(F.lit(7), "row"), F.lit(lanes)).cast("int").alias("lane"), F.lit(True).alias("asks"),
    )
    on = ["dim", "block", "lane"]
    # a stated number of partitions: by their few megabytes Spark would put many blocks into one task
    return (
        placed.select(*columns)
        .unionByName(asked.select(*columns))
        .repartition(2 * len(blocks) * lanes, *on)
        .sortWithinPartitions(*on, "asks")
        .mapInArrow(lambda batches: _stream(batches, k + 1), "query_row bigint, query_id bigint, vec_id bigint, score bigint, own bigint")
    )
