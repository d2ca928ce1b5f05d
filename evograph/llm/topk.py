"""Exact top-k inner products by distributed histogram selection.

Vectors are quantised to integers and packed into blocks. Every block of queries meets
every block of candidates in a cell of its own. A pass scores all cells and counts each
query's scores in equal bins of its current range; the counts are summed over all cells,
and the bin that holds the kth best score becomes the next range, until a bin is one
score wide. A cell reports bins from its best score down to where its own count reaches
k: bins below cannot hold the kth of all. The last pass filters scores from the kth value
on; of the ties at that value a cell needs no more than are missing, by smallest vec_id.

Scores are exact: float products are used only while every partial sum stays below the
precision of the type, else 64-bit integers. ``scale * x`` must fit a long.

Defined results: vectors that are null or hold a null or non-finite component take no
part; an empty vector scores zero; vectors of different length never meet; a query does
not meet rows of its own vec_id; repeated rows count each; fewer candidates than k are all
returned; rows with a null vec_id are neither; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from evograph.session import materialize

K, SCALE = 20, 64
QUERY_BLOCK, CANDIDATE_BLOCK, BINS = 1024, 4096, 1024


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of long) of the rows that take part."""
    x = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(
        F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _pack(a: np.ndarray) -> bytes:
    """Little-endian, in the narrowest of 16, 32 and 64 bits."""
    most = int(np.abs(a).max(initial=0))
    return a.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes()


def _unpack(data: bytes, n: int, dim: int) -> np.ndarray:
    size = len(data) // (n * dim) if dim else 8
    return np.frombuffer(data, f"<i{size}").astype(np.int64).reshape(n, dim)


def _blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """dim, ids and data: up to ``rows`` vectors of one length in a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, list[int]]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            part = held.pop(dim)
            ids = np.array([i for i, _ in part], "<i8")
            data = np.array([v for _, v in part], "<i8").reshape(len(part), dim)
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([ids.tobytes()]), pa.array([_pack(data)])], ["dim", "ids", "data"])
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) >= rows:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)
    return vectors.mapInArrow(run, "dim int, ids binary, data binary")


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    most = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    for kind, exact in ((np.float32, 1 << 24), (np.float64, 1 << 53)):
        if most < exact:
            return (q.astype(kind) @ c.astype(kind).T).astype(np.int64)
    return q @ c.T


def _cells(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """A stated query set against all rows, in blocks: each pair of blocks is a group of two rows."""
    n_q = F.lit(queries.agg(F.max("q_block")).first()[0])
    n_c = F.lit(candidates.agg(F.max("c_block")).first()[0])
    none = F.lit(None).cast("array<long>")
    q = queries.select("q_block", F.explode(F.sequence(F.lit(0).cast("long"), n_c)).alias("c_block"), "dim",
                       F.lit(0).alias("kind"), "ids", "data", "low", "width", "missing")
    c = candidates.select(F.explode(F.sequence(F.lit(0).cast("long"), n_q)).alias("q_block"), "c_block", "dim",
                          F.lit(1).alias("kind"), "ids", "data", none.alias("low"), none.alias("width"), none.alias("missing"))
    both = q.unionByName(c)
    # tasks by the number of cells; a cell is two rows of bounded size
    return both.repartition("q_block", "c_block").sortWithinPartitions("q_block", "c_block", "kind")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(q_block, query ids, low, width, missing, candidate ids, scores) of each cell; own rows are marked by a mask."""
    held = None
    for b in batches:
        for i in range(b.num_rows):
            row = [c[i].as_py() for c in b.columns]
            q_block, c_block, dim, kind = row[:4]
            ids = np.frombuffer(row[4], "<i8")
            data = _unpack(row[5], len(ids), dim)
            if kind == 0:
                held = (q_block, c_block, dim, ids, data, *(np.array(x, np.int64) for x in row[6:9]))
            elif held[:3] == (q_block, c_block, dim):
                yield q_block, held[3], *held[5:], ids, _scores(held[4], data), held[3][:, None] != ids[None, :]


def _counted(cells: DataFrame, k: int) -> DataFrame:
    """q_block, at (place in the block), bin, n: bins of the current range, from the best down to the kth of the cell.
    Bin BINS is all above the range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q_block, q_ids, low, width, _, _, s, other in _met(batches):
            n = len(q_ids)
            place = (s - low[:, None]) // width[:, None]  # below 0: out of sight
            place = np.where(place >= BINS, BINS, place)
            seen = other & (place >= 0)
            flat = (np.arange(n)[:, None] * (BINS + 1) + place)[seen]
            h = np.bincount(flat, minlength=n * (BINS + 1)).reshape(n, BINS + 1)
            above = np.cumsum(h[:, ::-1], axis=1)[:, ::-1] - h  # in better bins
            q, bin_ = np.nonzero((h > 0) & (above < k))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(q), q_block)), pa.array(q.astype(np.int64)), pa.array(bin_.astype(np.int64)),
                 pa.array(h[q, bin_].astype(np.int64))], ["q_block", "at", "bin", "n"])
    return cells.mapInArrow(run, "q_block long, at long, bin long, n long")


def _filtered(cells: DataFrame) -> DataFrame:
    """Scores above the kth value (``low``), and of those equal to it the ``missing`` with the smallest ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q_block, q_ids, low, _, missing, ids, s, other in _met(batches):
            order = np.argsort(ids, kind="stable")
            s, other, ids = s[:, order], other[:, order], ids[order]
            tie = other & (s == low[:, None])
            q, c = np.nonzero((other & (s > low[:, None])) | (tie & (np.cumsum(tie, axis=1) <= missing[:, None])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(q), q_block)), pa.array(q.astype(np.int64)), pa.array(q_ids[q]), pa.array(ids[c]),
                 pa.array(s[q, c])], ["q_block", "at", "query_id", "vec_id", "score"])
    return cells.mapInArrow(run, "q_block long, at long, query_id long, vec_id long, score long")


def _with_state(queries: DataFrame, state: DataFrame) -> DataFrame:
    """Query blocks with low, width and missing as arrays in the order of their ids; a block is bounded."""
    rows = state.groupBy("q_block").agg(F.array_sort(F.collect_list(F.struct("at", "low", "width", "missing"))).alias("s"))
    return queries.join(rows, "q_block").select(
        "q_block", "dim", "ids", "data", F.col("s.low").alias("low"), F.col("s.width").alias("width"),
        F.col("s.missing").alias("missing"))


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """Blocks with numbers from 0; their ids alone, one narrow row per block, are ranked."""
    at = materialize(df.withColumn("__id", F.monotonically_increasing_id()), "topk_blocks")
    rank = at.select("__id", (F.row_number().over(Window.orderBy("__id")) - 1).cast("long").alias(name))
    return materialize(at.join(rank, "__id").drop("__id"), name)


def _start(queries: DataFrame, largest: float, k: int) -> DataFrame:
    """The first range of each query: no score is beyond the product of the norms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q_block, dim, ids, data in zip(*(c.to_pylist() for c in b.columns)):
                n = len(ids) // 8
                norms = np.sqrt((_unpack(data, n, dim).astype(float) ** 2).sum(axis=1))
                reach = np.ceil(norms * largest * (1 + 1e-9)).astype(np.int64) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, q_block)), pa.array(np.arange(n)), pa.array(-reach),
                     pa.array((2 * reach) // BINS + 1), pa.array(np.full(n, k))], ["q_block", "at", "low", "width", "missing"])
    return queries.select("q_block", "dim", "ids", "data").mapInArrow(
        run, "q_block long, at long, low long, width long, missing long")


def _refined(state: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """The bin that holds the kth best score becomes the range; ``missing`` of its scores are among the k."""
    # a query has at most BINS + 1 bins
    each = counts.groupBy("q_block", "at").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"))
    start = F.struct(F.lit(k).cast("long").alias("left"), F.lit(None).cast("long").alias("bin"))
    pick = F.aggregate(F.reverse("bins"), start, lambda a, x: F.when(a["bin"].isNotNull(), a).otherwise(F.struct(
        F.when(a["left"] > x["n"], a["left"] - x["n"]).otherwise(a["left"]).alias("left"),
        F.when(a["left"] > x["n"], F.lit(None)).otherwise(x["bin"]).cast("long").alias("bin"))))
    p = F.col("p")
    return (state.drop("missing").join(each, ["q_block", "at"], "left").withColumn("p", F.when(F.size("bins") > 0, pick))
            .select("q_block", "at",
                    # with fewer scores than k there is no kth: the range keeps its low end, which is below all scores
                    (F.col("low") + F.coalesce(p["bin"], F.lit(0)) * F.col("width")).alias("low"),
                    F.ceil(F.col("width") / BINS).cast("long").alias("width"),
                    F.when(p["bin"].isNull(), F.lit(k)).otherwise(p["left"]).cast("long").alias("missing")))


def search(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of every other row for each row that ``is_query``."""
    spark = vectors.sparkSession
    v = materialize(quantised(vectors, scale), "topk_vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n, n_q, largest = v.agg(F.count("*"), F.count(F.when(is_query, 1)), F.max(norm)).first()
    if not n_q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    candidates = _numbered(_blocks(v.repartition(ceil(n / CANDIDATE_BLOCK)), 2 * CANDIDATE_BLOCK), "c_block")
    queries = _numbered(_blocks(v.where(is_query).repartition(ceil(n_q / QUERY_BLOCK)), 2 * QUERY_BLOCK), "q_block")
    state = materialize(_start(queries, largest, k), "topk_state")
    while True:
        last = state.agg(F.max("width")).first()[0] == 1
        counts = _counted(_cells(_with_state(queries, state), candidates), k).groupBy("q_block", "at", "bin").agg(F.sum("n").alias("n"))
        state = materialize(_refined(state, counts, k), "topk_state")
        if last:
            break
    kept = _filtered(_cells(_with_state(queries, state), candidates))
    # a query has at most k rows from each cell
    rank = F.row_number().over(Window.partitionBy("q_block", "at").orderBy(F.desc("score"), "vec_id"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
