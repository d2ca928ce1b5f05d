"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint has 8 positional bytes. Two fingerprints that differ in at
most 4 bits differ in at most 4 bytes, so they share at least ``8 - 4`` positional
bytes: that is the guaranteed minimum of the count filter. Lists over single bytes
would be all-pairs in disguise (256 values), so the index has one list for every
combination of that many positions and the bytes there (70 lists of 32 bits for
distance 4). A pair that meets in a list has reached the minimum; it is kept at
the first combination that it shares (its tally is over all 8 bytes), and verified
by the Hamming distance.

Equal fingerprints are one class before the index is built. A list with more than
``LIST_LIMIT`` classes is never expanded into pairs: its members go, whole, to an
exact second index of midpoints (two fingerprints are within 4 bits exactly if some
word is within 2 bits of both), whose lists link every member to one of them. Tasks
replace lists that are already long in their own rows by one marker before the
shuffle, so a list that holds a third of all classes does not travel.

Components come from alternating large-star and small-star steps, each written to
the shared folder.

Defined results: null and word-less texts have fingerprint zero and link like any
other; repeated rows get one row each; an empty table gives an empty result; extra
columns are ignored by ``components`` and passed through by ``keep_first``. A null
doc_id takes part with its text but never names a component with a non-null member.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from evograph.session import materialize

SHINGLE, MAX_BITS, SEED = 4, 4, 42
LIST_LIMIT = 64
_CHUNK = 1 << 16


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the lower-cased text's k-word shingles."""
    from xxhash import xxh64_intdigest
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    k = min(k, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - k + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        pairs = zip(starts[at:min(at + _CHUNK, n)].tolist(), ends[at + k - 1:min(at + _CHUNK, n) + k - 1].tolist())
        h = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in pairs], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and text_hash of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), k) for t in b.column(1)], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64()), b.column(2)], ["doc_id", "fp", "text_hash"])
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(
        run, "doc_id long, fp long, text_hash long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _rows(key: np.ndarray, fp: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(key), _CHUNK):
        k = key[at:at + _CHUNK]
        yield pa.RecordBatch.from_arrays(
            [pa.array(k.view("<i8")), pa.array(fp[at:at + _CHUNK].view("<i8")), pa.array(np.full(len(k), kind, np.int8))],
            ["key", "fp", "kind"])


_SCHEMA = "key long, fp long, kind byte"
#: kinds: an entry of a list; a list that some task found long; a member of a long list.
_ENTRY, _LONG, _MEMBER = 2, 1, 0


def _index(classes: DataFrame, max_bits: int) -> DataFrame:
    least = max(1, 8 - max_bits)
    combos = list(combinations(range(8), least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        def flush():
            fps = np.concatenate(held)
            octets = fps.view(np.uint8).reshape(-1, 8)
            hot = np.zeros(len(fps), bool)
            for c, at in enumerate(combos):
                key = np.zeros(len(fps), np.uint64)
                for p in at:
                    key = (key << np.uint64(8)) | octets[:, p].astype(np.uint64)
                if least > 6:  # a whole word; lists of different combinations are told apart by mixing
                    key = (key ^ np.uint64(c + 1)) * np.uint64(0x9E3779B97F4A7C15)
                else:
                    key |= np.uint64(c) << np.uint64(8 * least)
                _, where, n = np.unique(key, return_inverse=True, return_counts=True)
                long = n[where] > LIST_LIMIT
                hot |= long
                yield from _rows(key[~long], fps[~long], _ENTRY)
                if long.any():
                    keys = np.unique(key[long])
                    yield from _rows(keys, keys, _LONG)
            yield from _rows(fps[hot], fps[hot], _MEMBER)
        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False).astype("<i8").view("<u8"))
            size += len(held[-1])
            if size >= 1 << 19:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()
    return classes.select("fp").mapInArrow(run, _SCHEMA)


def _pairs(index: DataFrame, max_bits: int) -> DataFrame:
    """Verified pairs (kind _ENTRY: key and fp are the two ends) and members of long lists (kind _MEMBER)."""
    least = max(1, 8 - max_bits)

    def judged(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs and members of the whole lists given, which are sorted by key."""
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        n = np.diff(np.concatenate((start, [len(key)])))
        long = np.repeat(n > LIST_LIMIT, n)
        members, a_all, b_all = fp[long], [], []
        key, fp = key[~long], fp[~long]
        first_of = None
        for d in range(1, LIST_LIMIT):
            i = np.flatnonzero(key[d:] == key[:-d]) if len(key) > d else np.empty(0, np.int64)
            if not len(i):
                break
            a, b = np.minimum(fp[i], fp[i + d]), np.maximum(fp[i], fp[i + d])
            x = a ^ b
            close = (_popcount(x) <= max_bits) & (a != b)
            a, b, x, k = a[close], b[close], x[close], key[i][close]
            if len(a):
                same = x.view(np.uint8).reshape(-1, 8) == 0
                tally = same.sum(axis=1)
                # a pair is told in the list of the first positions that it shares
                first_of = first_of or {c: n for n, c in enumerate(combinations(range(8), least))}
                order = np.argsort(~same, axis=1, kind="stable")[:, :least]
                code = np.array([first_of[tuple(r)] for r in order.tolist()], np.uint64)
                here = (tally >= least) & ((code == (k >> np.uint64(8 * least))) if least <= 6 else True)
                a_all.append(a[here])
                b_all.append(b[here])
        none = np.empty(0, np.uint64)
        return np.concatenate(a_all or [none]), np.concatenate(b_all or [none]), members

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = fp = np.empty(0, np.uint64)
        long_key = None  # a list known to be long: what follows of it goes straight on
        for b in batches:
            k, f = (b.column(i).to_numpy().view("<u8") for i in (0, 1))
            kind = b.column(2).to_numpy()
            yield from _rows(f[kind == _MEMBER], f[kind == _MEMBER], _MEMBER)
            marks = np.unique(k[kind == _LONG])
            if len(marks):
                long_key = marks[-1] if long_key is None or marks[-1] > long_key else long_key
            entry = kind == _ENTRY
            k, f = k[entry], f[entry]
            # rows come by key, marks before entries: entries of a marked list follow their mark
            marked = np.isin(k, np.append(marks, [long_key] if long_key is not None else []).astype(np.uint64))
            yield from _rows(f[marked], f[marked], _MEMBER)
            key, fp = np.concatenate((key, k[~marked])), np.concatenate((fp, f[~marked]))
            if not len(key):
                continue
            last = np.searchsorted(key.view("<i8"), key.view("<i8")[-1])
            a, c, members = judged(key[:last], fp[:last]) if last else (fp[:0],) * 3
            yield from _rows(a, c, _ENTRY)
            yield from _rows(members, members, _MEMBER)
            key, fp = key[last:], fp[last:]
            if len(key) > LIST_LIMIT:
                long_key = key[-1]
                yield from _rows(fp, fp, _MEMBER)
                key, fp = key[:0], fp[:0]
        if len(key):
            a, c, members = judged(key, fp)
            yield from _rows(a, c, _ENTRY)
            yield from _rows(members, members, _MEMBER)

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # members and marks need no sorting of their own; kind puts a mark before the entries of its list
    return index.repartition(parts, "key").sortWithinPartitions("key", "kind").mapInArrow(run, _SCHEMA)


def _midpoint_links(members: DataFrame, max_bits: int) -> DataFrame:
    """Links among the members of long lists: all words within half the distance of a member are its keys."""
    bits = [np.uint64(1) << np.uint64(i) for i in range(64)]
    masks = np.array([sum(c, np.uint64(0)) for r in range((max_bits + 1) // 2 + 1) for c in combinations(bits, r)], np.uint64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy().view("<u8")
            for at in range(0, len(fps), 64):
                f = fps[at:at + 64]
                yield from _rows((f[:, None] ^ masks[None, :]).ravel(), np.repeat(f, len(masks)), _ENTRY)

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, centre = None, None
        for b in batches:
            k, f = (b.column(i).to_numpy().view("<u8") for i in (0, 1))
            new = np.concatenate(([last_key is None or k[0] != last_key], k[1:] != k[:-1]))
            at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
            c = np.where(at < 0, np.uint64(centre or 0), f[np.maximum(at, 0)])
            last_key, centre = k[-1], c[-1]
            far = (c != f) & (_popcount(c ^ f) <= max_bits)
            two = np.unique(np.stack((np.minimum(c, f)[far], np.maximum(c, f)[far]), axis=1), axis=0)
            yield from _rows(np.ascontiguousarray(two[:, 0]), np.ascontiguousarray(two[:, 1]), _ENTRY)

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (members.mapInArrow(spread, _SCHEMA).repartition(parts, "key").sortWithinPartitions("key", "fp")
            .mapInArrow(star, _SCHEMA).select(F.col("key").alias("u"), F.col("fp").alias("v")).distinct())


def links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """u, v: enough verified pairs of distinct fingerprints to connect all that are within ``max_bits``;
    outside long lists these are all such pairs."""
    found = materialize(_pairs(_index(classes, max_bits), max_bits), "simhash_pairs")
    plain = found.where(F.col("kind") == _ENTRY).select(F.col("key").alias("u"), F.col("fp").alias("v"))
    members = materialize(found.where(F.col("kind") == _MEMBER).select("fp").distinct(), "simhash_members")
    if members.isEmpty():
        return plain
    return plain.unionByName(_midpoint_links(members, max_bits))


def connected(edges: DataFrame) -> DataFrame:
    """node, label (the component's smallest node) of every node with an edge."""
    e = materialize(edges.where("u <> v").select("u", "v"), "cc_edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        big = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
               .distinct().where("u <> v"))
        down = big.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        e = materialize(small, "cc_round")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before = now


def components(docs: DataFrame, k: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of the component), text_hash, label (of the component) of every row."""
    fps = materialize(fingerprints(docs, k), "simhash")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash_classes")
    labels = connected(links(classes, max_bits))
    named = classes.join(labels, classes.fp == labels.node, "left").select(
        "fp", "rep", F.coalesce("label", "fp").alias("label"))
    first = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = materialize(named.join(first, "label").select("fp", "component_id", "label"), "simhash_names")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id", "text_hash", "label")


def keep_first(docs: DataFrame, k: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` for each component, with its own columns: that of the smallest doc_id (nulls last),
    of several the one with the smallest text hash, and of equal rows any one."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("m")
    firsts = components(docs, k, max_bits).groupBy("label").agg(least).select(
        F.col("m.doc_id").alias("__doc"), F.col("m.text_hash").alias("__hash"))
    plain = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])
    doc, text = (F.col(f"__c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    kept = plain.withColumn("__text_hash", F.xxhash64(text)).join(
        firsts, doc.cast("long").eqNullSafe(F.col("__doc")) & (F.col("__text_hash") == F.col("__hash")), "left_semi")
    one = F.row_number().over(Window.partitionBy(doc, "__text_hash").orderBy(doc))
    return kept.withColumn("__one", one).where("__one = 1").select(*plain.columns).toDF(*docs.columns)
