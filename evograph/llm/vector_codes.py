"""Vector code compression with per-dimension value dictionaries.

Components become integers (floor of ``scale * x``), and a vector is cut into equal consecutive
parts, each told by the index of its nearest codebook entry. Rows are kept in blocks: per dimension
the block's distinct integers (its dictionary) and each row's code in it. To assign a block, the squared
differences of every distinct integer to all entries are tabulated once per dimension; the distance of a part to an
entry is then a sum of table cells, gathered by dictionary codes, so a value that occurs often is subtracted and
squared once. The blocks are written once and read in every round. Sums and counts per entry are added up
inside a task and then over all tasks; the codebooks (``entries`` vectors) pass through the driver.

Defined results: vectors that are null, hold a null or non-finite component, or whose length is not a positive
multiple of the number of parts are dropped, and of the rest those whose length differs from that of the smallest vec_id.
Codebooks start from the smallest distinct vec_ids, of a repeated vec_id with its smallest vector; rows with a null
vec_id are coded but start no entry; with fewer vec_ids there are fewer entries, with none one entry of zeros. Repeated rows count each. An empty table gives
no rows. Extra columns are ignored. Arithmetic is exact: values so large that a squared distance might pass
64 bits raise an error that says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evograph.session import materialize

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
BLOCK = 4096
#: Copies of a label's sum, so that the rows of one label are not joined in one task.
SALTS = 32


def quantised(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """vec_id, label, v (array of long) of the rows that take part but for those of another length."""
    x = F.col("embedding")
    fine = x.isNotNull() & (F.size(x) > 0) & (F.size(x) % parts == 0) & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    # as doubles first: a huge component must reach the check of the range, not wrap
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long"), "label", v.alias("v"))


def _blocks(rows: DataFrame, dim: int) -> DataFrame:
    """Blocks of up to BLOCK rows: vec_ids, labels, values (the dictionaries, one after the other), sizes (of the
    dictionaries) and codes (one dimension after the other, 16 bits each)."""
    labels = rows.schema["label"].dataType.simpleString()

    def packed(part: pa.Table) -> pa.RecordBatch:
        n = part.num_rows
        v = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
        values, sizes, codes = [], [], np.empty((dim, n), "<u2")
        for d in range(dim):
            known, codes[d] = np.unique(v[:, d], return_inverse=True)
            values.append(known)
            sizes.append(len(known))
        one = np.array([0, n], np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(one, part.column(c).combine_chunks()) for c in ("vec_id", "label")]
            + [pa.array([np.concatenate(values).astype("<i8").tobytes()]), pa.array([np.array(sizes, "<i4").tobytes()]),
               pa.array([codes.tobytes()])], ["vec_ids", "labels", "values", "sizes", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            while n >= BLOCK:
                t = pa.Table.from_batches(held)
                yield packed(t.slice(0, BLOCK))
                held, n = t.slice(BLOCK).to_batches(), n - BLOCK
        if n:
            yield packed(pa.Table.from_batches(held))
    return rows.select("vec_id", "label", "v").mapInArrow(
        run, f"vec_ids array<long>, labels array<{labels}>, values binary, sizes binary, codes binary")


def _dictionaries(b: pa.RecordBatch, at: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per dimension the distinct integers of a block and the code of each row."""
    values, sizes, codes = (b.column(c)[at].as_py() for c in ("values", "sizes", "codes"))
    ends = np.cumsum(np.frombuffer(sizes, "<i4"))
    words = np.split(np.frombuffer(values, "<i8"), ends[:-1])
    return list(zip(words, np.frombuffer(codes, "<u2").reshape(len(words), -1)))


def _assigned(block: list[tuple[np.ndarray, np.ndarray]], book: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part (ties to the lower index) and the squared distance to it, both (parts, rows)."""
    width, n = len(block) // parts, len(block[0][1])
    near, best = np.empty((parts, n), np.int64), np.empty((parts, n), np.int64)
    for p in range(parts):
        distance = np.zeros((n, len(book)), np.int64)
        for d in range(p * width, (p + 1) * width):
            values, codes = block[d]
            table = values[:, None] - book[None, :, d]
            distance += (table * table)[codes]
        near[p] = distance.argmin(axis=1)
        best[p] = distance[np.arange(n), near[p]]
    return near, best


def _sums(blocks: DataFrame, book: np.ndarray, parts: int) -> DataFrame:
    """d, entry, n, total: how many rows chose the entry in the part of dimension d, and the sum of their values there."""
    dim, width = book.shape[1], book.shape[1] // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((dim, len(book)), np.int64), np.zeros((dim, len(book)), np.int64)
        for b in batches:
            for at in range(b.num_rows):
                block = _dictionaries(b, at)
                near, _ = _assigned(block, book, parts)
                for d, (values, codes) in enumerate(block):
                    # whole rows of the (entry, dictionary code) table: exact sums of integers
                    m = np.bincount(near[d // width] * len(values) + codes, minlength=len(book) * len(values))
                    m = m.reshape(len(book), len(values))
                    n[d] += m.sum(axis=1)
                    total[d] += m @ values
        d, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (d, entry, n[d, entry], total[d, entry])],
                                         ["d", "entry", "n", "total"])
    schema = "d long, entry long, n long, total long"
    return blocks.select("values", "sizes", "codes").mapInArrow(run, schema).groupBy("d", "entry").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"))


def _coded(blocks: DataFrame, book: np.ndarray, parts: int) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error of every row."""
    labels = blocks.schema["labels"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                near, best = _assigned(_dictionaries(b, at), book, parts)
                code = [r.tobytes().hex() for r in np.ascontiguousarray(near.T.astype(np.uint8))]
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_ids")[at].values, b.column("labels")[at].values, pa.array(code, pa.string()),
                     pa.array(best.sum(axis=0))], ["vec_id", "label", "code", "error"])
    return blocks.mapInArrow(run, f"vec_id long, label {labels}, code string, error long")


def compress(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every row that takes part, and the codebooks: row j holds entry j of every part.

    ``entries`` is at most 256 (a code is one byte)."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    spark = vectors.sparkSession
    v = materialize(quantised(vectors, scale, parts), "codes_vectors")
    empty = spark.createDataFrame([], v.select("vec_id", "label").schema).selectExpr(
        "vec_id", "label", "string(null) code", "bigint(null) error")
    first = v.select("vec_id", F.size("v").alias("dim")).orderBy(F.col("vec_id").asc_nulls_last(), "dim").first()
    if first is None:
        return empty, np.empty((0, 0), np.int64)
    dim = first["dim"]
    v = v.where(F.size("v") == dim)
    reach = v.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()[0]
    if (2 * reach + 1) ** 2 * dim >= 2 ** 63:
        raise ValueError(f"components up to {reach:g} after scaling: squared distances would pass 64 bits")
    # the smallest vec_ids, a bounded number of rows
    start = (v.where("vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v"))
             .orderBy("vec_id").limit(entries).collect())
    book = np.array([r["v"] for r in sorted(start, key=lambda r: r["vec_id"])] or [[0] * dim], np.int64)
    blocks = materialize(_blocks(v, dim), "codes_blocks")
    for _ in range(rounds):
        # dim x entries rows
        for d, j, n, total in _sums(blocks, book, parts).collect():
            book[j, d] = total // n
    return _coded(blocks, book, parts), book


def books_text(book: np.ndarray, parts: int = PARTS) -> str:
    """All integers of the codebooks by part, entry and position in the part, joined by commas."""
    if not book.size:
        return ""
    return ",".join(map(str, book.reshape(len(book), parts, -1).transpose(1, 0, 2).ravel().tolist()))


def with_label_error(coded: DataFrame) -> DataFrame:
    """The rows with label_error: the sum of ``error`` over the rows of their label (null is a label).

    A label may hold a third of all rows: its sum is made in parts and joined to salted rows."""
    salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")
    rows = materialize(coded.withColumn("__salt", salt), "codes_rows")
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error")).select(
        F.col("label").alias("__label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__s"))
    return rows.join(sums, rows["label"].eqNullSafe(F.col("__label")) & (F.col("__salt") == F.col("__s"))).select(
        *coded.columns, "label_error")


def digests(vectors: DataFrame, **parameters: int) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    coded, book = compress(vectors, **parameters)
    digest = sha256(books_text(book, parameters.get("parts", PARTS)).encode()).hexdigest()
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
