"""Best-fit packing of tokenized documents into sequences, in bulk-synchronous rounds.

A round range-sorts all open pieces and all gaps together by size (largest first,
gaps before pieces of their size). Each task sweeps its range: a piece takes its
successor, the smallest gap of the range that holds it; among pieces that want the
same gap the larger one, then the smaller id, ranks first; what is left of a gap
goes back into the sweep. Pieces that found none in their range then take gaps of
the ranges before theirs (nearest range first, smallest gap first): tasks only
report how many pieces and slots they have left, the driver turns these counts (one
row per task) into intervals, and pieces and slots meet by rank in a join. Gaps are
updated, new sequences are opened for the largest pieces as far as the remaining
tokens exceed the remaining gaps, and the next round begins.

Defined results: a null or empty text is the one end token; repeated documents are
packed each on its own; an empty table gives no pieces; pieces of exactly the
capacity are sequences of their own; extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from evograph.session import materialize, scratch_path

CAPACITY = 2048
END_ID = 0
#: Rows of one range in a round.
RANGE_ROWS = 32_768


@lru_cache(maxsize=2)
def _encoder(tokenizer: str):
    """Text -> unsigned 32-bit ids, as ``tokenizers`` gives for a byte-level BPE file without adding special tokens; the file's
    added tokens that a text holds are found in it, as there.

    When the file's ids follow its merges, the same ids come several times faster from ``tiktoken``."""
    import public_tokenizers
    with open(tokenizer, encoding="utf-8") as f:
        whole = json.load(f)
    model, added = whole["model"], whole.get("added_tokens") or []
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    octet = {chr(b): b for b in printable} | {
        chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    vocab = {bytes(octet[c] for c in t): i for t, i in model["vocab"].items() if all(c in octet for c in t)}
    merged = ["".join(m) if not isinstance(m, str) else m.replace(" ", "") for m in model["merges"]]
    plain = [t for t, i in sorted(model["vocab"].items(), key=lambda x: x[1])][256:256 + len(merged)]
    if plain == merged and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
        import tiktoken
        ranks = {t: i for t, i in vocab.items() if i < 256 + len(merged)}
        enc = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                special_tokens={t["content"]: t["id"] for t in added})
        return lambda text: enc.encode_to_numpy(text, allowed_special="all")
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer)
    return lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
           keep_ids: bool = False) -> DataFrame:
    """item (unique), doc_id, piece, start, length, ids_crc32 and, if asked for, the ids of every piece."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for b in batches:
            out: list[list] = [[] for _ in names]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for n, (s, e) in enumerate(zip(cuts, cuts[1:])):
                    row = [doc, n, s, e - s, zlib.crc32(ids[s:e].tobytes()), ids[s:e]]
                    for col, v in zip(out, row):
                        col.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    cut = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
    return materialize(cut.withColumn("item", F.monotonically_increasing_id()), "pieces")


_SWEPT = "kind string, id long, seq long, size long, pid int, low long, high long"


def _sweep(rows: DataFrame, parts: int, capacity: int, first_seq: int | None = None) -> DataFrame:
    """One sweep over each range of ``rows`` (kind 0 gap / 1 piece, id, size). Out come

    - ``match``: piece ``id`` is put into sequence ``seq``;
    - ``item``: piece ``id`` found no gap; ``low`` is its rank in the range;
    - ``gap``: sequence ``id`` has ``size`` left; [low, high) are its slots for pieces of later ranges.

    ``first_seq``: the rows are one range, the last; pieces without a gap open sequences from this number on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        pool: dict[int, list[int]] = {}
        sizes: list[int] = []
        floor, fresh = None, first_seq
        out: list[tuple] = []
        left = 0

        def put(size: int, seq: int) -> None:
            if size not in pool:
                pool[size] = []
                insort(sizes, size)
            pool[size].append(seq)

        def batch(rs: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rs))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                              ["kind", "id", "seq", "size", "pid", "low", "high"])
        for b in batches:
            for kind, key, size in zip(*(c.to_pylist() for c in b.columns)):
                floor = size
                if kind == 0:
                    put(size, key)
                    continue
                at = bisect_left(sizes, size)
                if at == len(sizes) and fresh is not None:
                    out.append(("match", key, fresh, size, pid, None, None))
                    put(capacity - size, fresh)
                    fresh += 1
                elif at == len(sizes):
                    out.append(("item", key, None, size, pid, left, None))
                    left += 1
                else:
                    gap = sizes[at]
                    seq = pool[gap].pop()
                    if not pool[gap]:
                        del pool[gap], sizes[at]
                    out.append(("match", key, seq, size, pid, None, None))
                    if gap > size:
                        put(gap - size, seq)
                if len(out) >= 1 << 15:
                    yield batch(out)
                    out = []
        slot = 0
        for size in sizes if first_seq is None else ():
            for seq in pool[size]:
                n = size // floor  # all later ranges hold pieces of at most this range's smallest size
                out.append(("gap", seq, None, size, pid, slot, slot + n))
                slot += n
        if out:
            yield batch(out)

    order = [F.desc("size"), F.col("kind"), F.col("id")]
    ranges = rows.repartitionByRange(parts, *order) if first_seq is None else rows.coalesce(1)
    return ranges.sortWithinPartitions(*order).mapInArrow(run, _SWEPT)


def _carried(counts: list) -> list[tuple]:
    """Intervals (k, n, gap_pid, slot, item_pid, item): the n pieces from rank ``item`` on meet the n slots from
    ``slot`` on. ``counts``: a row per range with pid, n_items and n_slots, in order of size."""
    stack, out, k = [], [], 0
    for c in counts:
        item = 0
        while item < c["n_items"] and stack:
            pid, lo, hi = stack.pop()
            n = min(hi - lo, c["n_items"] - item)
            out.append((k, n, pid, lo, c["pid"], item))
            item, k = item + n, k + n
            if lo + n < hi:
                stack.append((pid, lo + n, hi))
        if c["n_slots"]:
            stack.append((c["pid"], 0, c["n_slots"]))
    return out


def assign(items: DataFrame, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS) -> DataFrame:
    """item, seq for ``items`` (item, size) of sizes 1 to ``capacity``."""
    spark: SparkSession = items.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = items.agg(F.count("*"), F.count(F.when(F.col("size") * 2 > capacity, 1))).first()
    n_rows, n_large = first
    pool = items.select(F.lit(1).alias("kind"), F.col("item").alias("id"), F.col("size").cast("long"))
    placed: list[DataFrame] = []
    next_seq, opened = 0, False
    while n_rows:
        last = next_seq if n_rows <= range_rows else None
        swept = materialize(_sweep(pool, max(1, min(most, ceil(n_rows / range_rows))), capacity, last), "pack_sweep")
        if last is not None:
            placed.append(swept.select(F.col("id").alias("item"), "seq"))
            break
        counts = (swept.groupBy("pid").agg(
            F.count(F.when(F.col("kind") == "item", 1)).alias("n_items"),
            F.sum(F.when(F.col("kind") == "item", F.col("size"))).alias("tokens"),
            F.min(F.when(F.col("kind") == "item", F.col("size"))).alias("least"),
            F.max(F.when(F.col("kind") == "gap", F.col("high"))).alias("n_slots"),
            F.count(F.when(F.col("kind") == "gap", 1)).alias("n_gaps"),
            F.sum(F.when(F.col("kind") == "gap", F.col("size"))).alias("room"),
            F.count(F.when(F.col("kind") == "match", 1)).alias("n_match")).orderBy("pid").collect())
        counts = [r.asDict() | {"n_slots": r["n_slots"] or 0} for r in counts]  # a row per task
        placed.append(swept.where("kind = 'match'").select(F.col("id").alias("item"), "seq"))
        left = sum(r["n_items"] for r in counts)
        if not left:
            break
        meet = _carried(counts)
        moved = sum(m[1] for m in meet)
        taken = {r["pid"]: 0 for r in counts}
        for _, n, _, _, pid, _ in meet:
            taken[pid] += n
        tokens, room = sum(r["tokens"] or 0 for r in counts), sum(r["room"] or 0 for r in counts)
        new = max(0, ceil((tokens - room) / capacity))
        if not opened:
            new, opened = max(new, n_large), True  # no two large pieces share a sequence
        elif not new and not moved and not any(r["n_match"] for r in counts):
            new = ceil(tokens / capacity)  # nothing fits any more
        new = min(new, left - moved)
        rank, at = [], 0
        for r in counts:
            rank.append((r["pid"], taken[r["pid"]], at - taken[r["pid"]]))
            at += r["n_items"] - taken[r["pid"]]
        # both helper tables have a row or two per task
        ranks = F.broadcast(spark.createDataFrame(rank, "pid int, taken long, shift long"))
        rest = swept.where("kind = 'item'").join(ranks, "pid").withColumn("rank", F.col("low") + F.col("shift"))
        open_ = rest.where((F.col("low") >= F.col("taken")) & (F.col("rank") < new)).select(
            "id", (F.col("rank") + next_seq).alias("seq"), "size")
        joined = open_.withColumn("fresh", F.lit(True))
        if meet:
            ways = F.broadcast(spark.createDataFrame(
                meet, "k long, n long, gap_pid int, slot long, item_pid int, item long"))
            want = (swept.where("kind = 'item'").join(ways, (F.col("pid") == F.col("item_pid"))
                    & (F.col("low") >= F.col("item")) & (F.col("low") < F.col("item") + F.col("n")))
                    .select("id", "size", (F.col("k") + F.col("low") - F.col("item")).alias("k")))
            lo, hi = F.greatest("low", "slot"), F.least("high", F.col("slot") + F.col("n"))
            give = (swept.where("kind = 'gap' AND high > low").join(ways, (F.col("pid") == F.col("gap_pid"))
                    & (F.col("low") < F.col("slot") + F.col("n")) & (F.col("high") > F.col("slot")))
                    .select(F.col("id").alias("seq"), F.explode(F.sequence(
                        F.col("k") + lo - F.col("slot"), F.col("k") + hi - F.col("slot") - 1)).alias("k")))
            joined = joined.unionByName(want.join(give, "k").select("id", "seq", "size", F.lit(False).alias("fresh")))
        joined = materialize(joined, "pack_carry")
        placed.append(joined.select(F.col("id").alias("item"), "seq"))
        next_seq += new
        n_items = left - moved - new
        if not n_items:
            break
        used = joined.groupBy("seq").agg(F.sum("size").alias("used"), F.max("fresh").alias("fresh"))
        old = swept.where("kind = 'gap'").select(F.col("id").alias("seq"), F.col("size").alias("room"))
        gaps = (old.join(used.where("NOT fresh"), "seq", "left")
                .select("seq", (F.col("room") - F.coalesce("used", F.lit(0))).alias("size"))
                .unionByName(used.where("fresh").select("seq", (F.lit(capacity) - F.col("used")).alias("size"))))
        least = min(r["least"] for r in counts if r["n_items"])
        pool = (gaps.where(F.col("size") >= least).select(F.lit(0).alias("kind"), F.col("seq").alias("id"), "size")
                .unionByName(rest.where((F.col("low") >= F.col("taken")) & (F.col("rank") >= new))
                             .select(F.lit(1).alias("kind"), "id", "size")))
        n_rows = n_items + sum(r["n_gaps"] for r in counts) + new
    if not placed:
        return spark.createDataFrame([], "item long, seq long")
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
         keep_ids: bool = False, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The pieces of ``docs`` with ``sequence_id`` and ``offset``; offsets of a sequence leave no hole."""
    from pyspark.sql import Window
    cut = pieces(docs, tokenizer, capacity, end_id, keep_ids)
    narrow = cut.select("item", F.col("length").alias("size"))
    full = cut.where(F.col("length") == capacity).select(
        "*", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    seqs = materialize(assign(narrow.where(F.col("size") < capacity), capacity, range_rows), "pack_assigned")
    # a sequence has at most ``capacity`` pieces
    before = Window.partitionBy("seq").orderBy(F.desc("size"), "item").rowsBetween(Window.unboundedPreceding, -1)
    place = (narrow.where(F.col("size") < capacity).join(seqs, "item")
             .select("item", F.col("seq").alias("sequence_id"),
                     F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("offset")))
    rest = cut.where(F.col("length") < capacity).join(place, "item")
    return full.unionByName(rest).drop("item")
