"""Exact top-k inner products with a pivot-distance index.

Vectors become integers; one extra coordinate, sqrt(M - |v|^2) with M the greatest squared length, turns the order by
inner product into the order by distance. Each vector is keyed by its nearest pivot and its distance to it, dealt by
ranges of (pivot, distance, id) and stored in sorted blocks, so each block is an annulus of one pivot. A query first
scans the block it lies in; its k-th best there bounds the search, and the triangle inequality
|d(q, pivot) - d(v, pivot)| <= d(q, v) leaves only the annuli within that distance. Queries travel in groups, one for
each home block, to the blocks that at least one of them needs.

Pivots come from a bounded sample (`sample` vectors by hash), and their number grows with the square root of the table up
to `most_pivots`; they affect speed only. Vectors with a component beyond `wide` would spoil the bounds of all others; they
form blocks of their own, which every query sees, and as queries they see every block. A product that float64 might round
is taken in whole numbers. Block descriptions are broadcast:
at most `max_blocks`, plus one for each pivot and task. Ids that a third of the vectors share as an equal vector are
spread by the third key, the id, and by a number of the row.

Edge cases: a vector that is null, or holds a null, NaN or infinite component, takes no part, as query or candidate; a
shorter vector counts as padded with zeros; rows with the query's own id are no candidates; of rows that share a query's
id one counts as the query (the least by pivot, distance and components), while repeated candidate rows each count; a null
id takes no part; an empty table gives no rows; other columns aren't read. Scores beyond the range of long are its ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLOCK = "block long, pivot int, low double, high double, ids binary, vectors binary, queries binary"
HIT = "query_id long, vec_id long, score long"


@dataclass(frozen=True)
class Index:
    scale: int = 256
    pivots: int = 32
    most_pivots: int = 1024
    wide: int = 1 << 26
    sample: int = 4096
    block_rows: int = 2048
    max_blocks: int = 1 << 16


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and v, the scaled floors, of all vectors that take part."""
    x = F.col("embedding")
    sound = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    most = float(np.finfo(np.float64).max)

    def whole(c):
        scaled = F.greatest(F.lit(-most), F.least(F.lit(most), c.cast("double") * scale))
        return F.when(F.abs(scaled) < float(1 << 52), F.floor(scaled).cast("double")).otherwise(scaled)  # beyond that doubles are whole

    return vectors.filter(sound).select(F.col("vec_id").cast("long"), F.transform(x, whole).alias("v"))


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.asarray(column.offsets).astype(np.int64)
    flat = np.asarray(column.values)
    sizes = np.diff(at)
    if len(sizes) and (sizes == dims).all():
        return flat[at[0] : at[-1]].reshape(-1, dims).astype(np.float64)
    out = np.zeros((len(sizes), dims))
    for i, n in enumerate(sizes):
        out[i, :n] = flat[at[i] : at[i] + n]
    return out


def spread(points: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first choice of up to n distinct points."""
    if not len(points):
        return points
    chosen = [0]
    far = ((points - points[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def lifted(v: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([v, np.sqrt(np.maximum(most - (v * v).sum(1), 0))[:, None]], axis=1)


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (points**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact; beyond the range of int64, its ends."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = q @ v.T
        sure = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))[None, :] < 2.0**53  # bounds every partial sum
    out = np.where(sure, s, 0).astype(np.int64)
    if not sure.all():
        rows: dict[int, list[int]] = {}
        for i in np.flatnonzero(~sure.all(1)).tolist():
            own = [int(x) for x in q[i].tolist()]
            for j in np.flatnonzero(~sure[i]).tolist():
                if j not in rows:
                    rows[j] = [int(x) for x in v[j].tolist()]
                out[i, j] = max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(own, rows[j], strict=True))))
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(scores) > 8 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def search(vectors: DataFrame, every: int = 50, k: int = 5, index: Index = Index()) -> DataFrame:
    """Queries: ids divisible by `every`. Returns query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    work = common.Workspace(spark, "topk")
    whole = integers(vectors, index.scale)
    is_wide = F.exists("v", lambda c: F.abs(c) > index.wide)
    squares = F.when(~is_wide, F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    n, dims, most = whole.agg(F.count("*"), F.max(F.size("v")), F.max(squares)).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims, most = int(dims), float(most or 0)
    slack = max(1e-3, math.sqrt(16 * (dims + 3) * np.finfo(np.float64).eps * most))  # what rounding can do to a distance
    sample = common.hash_sample(whole.filter(~is_wide), "vec_id", index.sample).select("v").toArrow()
    n_pivots = max(index.pivots, min(index.most_pivots, math.isqrt(n) // 4))
    pivots = spark.sparkContext.broadcast(spread(lifted(matrix(sample.column("v"), dims), most), n_pivots))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), dims)
            wide = (np.abs(v) > index.wide).any(1) | (not len(pivots.value))
            narrow = np.where(wide[:, None], 0, v)
            d = distances(lifted(narrow, most), pivots.value) if len(pivots.value) else np.zeros((len(v), 1))
            near = d.argmin(1)
            rows = [v[i].astype("<f8" if wide[i] else "<i4").tobytes() for i in range(len(v))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(np.where(wide, -1, near).astype(np.int32)), pa.array(np.where(wide, 0, d[np.arange(len(d)), near])), pa.array(rows, pa.binary())], ["vec_id", "pivot", "distance", "v"])

    rows_each = max(index.block_rows, math.ceil(n / index.max_blocks))
    keyed = whole.mapInArrow(key, "vec_id long, pivot int, distance double, v binary").withColumn("row", F.xxhash64(F.monotonically_increasing_id()))
    keyed = work.keep(keyed, "keyed")
    asks = F.col("vec_id") % every == 0
    chosen = keyed.filter(asks).groupBy("vec_id").agg(F.min(F.struct("pivot", "distance", "v", "row")).alias("least")).select("vec_id", F.col("least.row").alias("row"), F.lit(True).alias("query"))
    both = keyed.filter(asks).join(chosen, ["vec_id", "row"], "left").withColumn("query", F.coalesce("query", F.lit(False)))
    keyed = both.unionByName(keyed.filter(~asks).withColumn("query", F.lit(False)))
    parts = max(1, min(common.partitions(spark), math.ceil(n / rows_each)))
    order = ["pivot", "distance", "vec_id", "row"]
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        made = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, made
            part, pivot = held[0][4], held[0][1]
            row = {"block": [part << 32 | made], "pivot": [pivot], "low": [held[0][2]], "high": [held[-1][2]], "ids": [np.array([h[0] for h in held], "<i8").tobytes()], "vectors": [b"".join(h[3] for h in held)], "queries": [np.array([h[5] for h in held], "u1").tobytes()]}
            made, held = made + 1, []
            return pa.RecordBatch.from_pydict(row, pa.schema([("block", pa.int64()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("queries", pa.binary())]))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[1] != held[0][1] or len(held) >= rows_each):
                    yield flush()
                held.append(row)
        if held:
            yield flush()

    blocks = work.keep(dealt.select("vec_id", "pivot", "distance", "v", "part", "query").mapInArrow(block, BLOCK), "blocks")
    about = blocks.select("block", "pivot", "low", "high").toArrow()
    known = spark.sparkContext.broadcast({c: about.column(c).to_numpy() for c in about.column_names})

    def unpack(ids: bytes, v: bytes, wide: bool) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(ids, "<i8"), np.frombuffer(v, "<f8" if wide else "<i4").reshape(-1, dims).astype(np.float64) if dims else np.zeros((len(ids) // 8, 0))

    def hits(q_ids: np.ndarray, s: np.ndarray, ids: np.ndarray, least: np.ndarray | None) -> tuple[list, list, list, list]:
        out: tuple[list, list, list, list] = ([], [], [], [])
        for i, q in enumerate(q_ids.tolist()):
            use = np.flatnonzero((ids != q) & (s[i] >= least[i] if least is not None else True))
            use = use[best(s[i, use], ids[use], k)]
            out[0].extend([q] * len(use))
            out[1].extend(ids[use].tolist())
            out[2].extend(s[i, use].tolist())
            out[3].append(int(s[i, use[-1]]) if len(use) == k else -(1 << 63))
        return out

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block with queries: its own best as rows of HIT, and a row for each block that they must still see."""
        about = known.value
        for batch in batches:
            for row in batch.to_pylist():
                wide = row["pivot"] < 0
                ids, v = unpack(row["ids"], row["vectors"], wide)
                mine = np.flatnonzero(np.frombuffer(row["queries"], "u1"))
                if not len(mine):
                    continue
                q = v[mine]
                q_ids, v_ids, s, kth = hits(ids[mine], products(q, v), ids, None)
                open_ = np.ones((len(q), len(about["block"])), bool)
                if not wide:
                    few = np.array([x == -(1 << 63) for x in kth])
                    reach = np.where(few, np.inf, np.sqrt(np.maximum((q * q).sum(1) + most - 2 * np.array(kth, np.float64), 0)) * (1 + 1e-9) + slack)
                    d = distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), pivots.value)[:, about["pivot"]]
                    short = np.maximum(np.maximum(about["low"] - d, d - about["high"]), 0) * (1 - 1e-9) - 2 * slack
                    open_ = (short <= reach[:, None]) | (about["pivot"] < 0)
                open_ &= about["block"] != row["block"]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids, pa.int64()), pa.array(v_ids, pa.int64()), pa.array(s, pa.int64()), *(pa.nulls(len(q_ids), t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()))], names)
                for b in np.flatnonzero(open_.any(0)):
                    use = np.flatnonzero(open_[:, b])
                    cells = [None, None, None, int(about["block"][b]), ids[mine[use]].astype("<i8").tobytes(), q[use].astype("<f8" if wide else "<i4").tobytes(), np.array(kth, "<i8")[use].tobytes(), wide]
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types, strict=True)], names)

    names = ["query_id", "vec_id", "score", "block", "q_ids", "q_vectors", "kth", "q_wide"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()]
    first = work.keep(blocks.mapInArrow(home, f"{HIT}, block long, q_ids binary, q_vectors binary, kth binary, q_wide boolean"), "first")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, v = unpack(row["ids"], row["vectors"], row["pivot"] < 0)
                q_ids, q = unpack(row["q_ids"], row["q_vectors"], row["q_wide"])
                got = hits(q_ids, products(q, v), ids, np.frombuffer(row["kth"], "<i8"))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got[:3]], ["query_id", "vec_id", "score"])

    visits = first.filter("block is not null").select("block", "q_ids", "q_vectors", "kth", "q_wide").join(blocks.select("block", "pivot", "ids", "vectors").hint("shuffle_hash"), "block")
    more = visits.select("q_ids", "q_vectors", "kth", "q_wide", "pivot", "ids", "vectors").mapInArrow(probe, HIT)
    every_hit = first.filter("query_id is not null").select("query_id", "vec_id", "score").unionByName(more)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every_hit.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.read(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 5
"""
