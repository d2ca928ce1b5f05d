"""INV-*: the repository inventory (work queue) as tables.

The queue of the original system is a database table mutated row by row by
worker processes.  Here every lifecycle step is a set-based DataFrame
transformation from the current table (plus an input table of claims,
status updates or heartbeats) to the next table and the history rows it
produces.  ``now`` is always an argument, never read from the clock.
Keys are ``(owner, repo)``; every join is an equi-join on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DoubleType, LongType, StringType, StructField, StructType,
                               TimestampNTZType)

K = ["owner", "repo"]

# Star-range steps of the partitioned discovery, the stale claim
# timeout and the history message of a reclaim.
STAR_STEPS = [50, 50, 100, 100, 200, 200, 300, 500, 1000, 2000, 5000, 10000, 30000]
STALE_TIMEOUT_MINUTES = 30
STALE_MESSAGE = "stale reclaim"

INVENTORY_SCHEMA = StructType([
    StructField("owner", StringType()), StructField("repo", StringType()), StructField("stars", LongType()),
    StructField("language", StringType()), StructField("tag1", StringType()), StructField("tag2", StringType()),
    StructField("status", StringType()), StructField("error_msg", StringType()),
    StructField("processed_at", TimestampNTZType()), StructField("worker_id", StringType()),
    StructField("claimed_at", TimestampNTZType()), StructField("extraction_start_at", TimestampNTZType()),
    StructField("extraction_end_at", TimestampNTZType()),
    StructField("loc_v1", LongType()), StructField("loc_v2", LongType()),
    StructField("classes_v1", LongType()), StructField("classes_v2", LongType()),
    StructField("coupling_v1", DoubleType()), StructField("coupling_v2", DoubleType()),
    StructField("conforms_v1", BooleanType()), StructField("conforms_v2", BooleanType()),
    StructField("added_nodes", LongType()), StructField("removed_nodes", LongType()),
    StructField("added_edges", LongType()), StructField("removed_edges", LongType()),
    StructField("new_cycles", LongType()), StructField("broken_cycles", LongType()),
    StructField("intent_status", StringType()), StructField("top_hubs", StringType()),
    StructField("coupling_anomalies", StringType()), StructField("report_content", StringType()),
    StructField("graph_v1_path", StringType()), StructField("graph_v2_path", StringType()),
    StructField("report_path", StringType()),
])
COLUMN_DEFAULTS = {"status": "pending", "language": "java"}

HISTORY_COLUMNS = ["owner", "repo", "from_status", "to_status", "transitioned_at", "error_msg", "worker_id"]


def _ts(now) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp_ntz")


def upsert_discovered(inventory: DataFrame, discovered: DataFrame) -> DataFrame:
    """INV-01: new (owner, repo) enter as pending; known ones get the new stars and language.

    Several discoveries of one key in the batch: the last one (highest
    ``seq``) wins, as with sequential upserts.  One full outer join on the key.
    """
    last = (discovered.groupBy(*K)
            .agg(F.max_by(F.struct("stars", "language"), "seq").alias("d"))
            .select(*K, F.col("d.stars").alias("d_stars"), F.col("d.language").alias("d_language"),
                    F.lit(True).alias("_found")))
    inv = inventory.withColumn("_known", F.lit(True))
    j = inv.join(last, K, "full")
    out = []
    for c in inventory.columns:
        if c == "stars":
            out.append(F.coalesce("d_stars", "stars").alias(c))
        elif c == "language":
            out.append(F.coalesce("d_language", "language").alias(c))
        elif c == "status":
            out.append(F.when(F.col("_known").isNull(), F.lit("pending")).otherwise(F.col("status")).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def star_ranges(spark, min_stars: int = 500) -> DataFrame:
    """INV-02: 13 growing steps give 14 inclusive ranges; the last is open (high NULL)."""
    rows, cur = [], min_stars
    for i, step in enumerate(STAR_STEPS):
        rows.append((i, cur, cur + step))
        cur = cur + step + 1
    rows.append((len(STAR_STEPS), cur, None))
    return spark.createDataFrame(rows, "range_idx int, low bigint, high bigint")


def assign_range(df: DataFrame, min_stars: int = 500) -> DataFrame:
    """INV-02: the star range of every row (14-row literal table, broadcast range join)."""
    r = F.broadcast(star_ranges(df.sparkSession, min_stars))
    cond = (F.col("stars") >= r["low"]) & (r["high"].isNull() | (F.col("stars") <= r["high"]))
    return df.join(r, cond, "left")


def eligible(inventory: DataFrame, now, timeout_minutes: int = STALE_TIMEOUT_MINUTES) -> Column:
    cutoff = _ts(now) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(timeout_minutes))
    return (F.col("status") == "pending") | ((F.col("status") == "processing") & (F.col("claimed_at") < cutoff))


def next_batch(inventory: DataFrame, n: int, now, timeout_minutes: int = STALE_TIMEOUT_MINUTES) -> DataFrame:
    """INV-03: the ``n`` claimable rows with most stars (NULL last, then owner, repo).

    ``orderBy().limit()`` plans as a distributed top-k (TakeOrderedAndProject).
    """
    return (inventory.where(eligible(inventory, now, timeout_minutes))
            .orderBy(F.desc_nulls_last("stars"), "owner", "repo").limit(n))


def assign_workers(batch: DataFrame, k: int) -> DataFrame:
    """INV-04: disjoint split of a (bounded) batch over ``k`` workers, round robin by rank."""
    w = Window.orderBy(F.desc_nulls_last("stars"), "owner", "repo")
    return batch.withColumn("worker_no", ((F.row_number().over(w) - 1) % k).cast("int"))


def apply_claims(inventory: DataFrame, claims: DataFrame, now,
                 timeout_minutes: int = STALE_TIMEOUT_MINUTES) -> tuple[DataFrame, DataFrame]:
    """INV-05: claimed rows become processing with ``claimed_at = now`` and the worker id.

    ``claims(owner, repo, worker_id)``.  Of several claims of a row the smallest
    worker id wins; only rows that are claimable at ``now`` are claimed.  Returns
    (new inventory, history rows); history keeps the true previous status.
    """
    c = claims.groupBy(*K).agg(F.min("worker_id").alias("c_worker")).withColumn("_claimed", F.lit(True))
    j = inventory.join(c, K, "left")
    hit = F.col("_claimed").isNotNull() & F.coalesce(eligible(inventory, now, timeout_minutes), F.lit(False))
    cols = []
    for col in inventory.columns:
        if col == "status":
            cols.append(F.when(hit, F.lit("processing")).otherwise(F.col("status")).alias(col))
        elif col == "claimed_at":
            cols.append(F.when(hit, _ts(now)).otherwise(F.col("claimed_at")).alias(col))
        elif col == "worker_id":
            cols.append(F.when(hit, F.col("c_worker")).otherwise(F.col("worker_id")).alias(col))
        else:
            cols.append(F.col(col))
    hist = j.where(hit).select(*K, F.col("status").alias("from_status"), F.lit("processing").alias("to_status"),
                               _ts(now).alias("transitioned_at"), F.lit(None).cast("string").alias("error_msg"),
                               F.col("c_worker").alias("worker_id"))
    return j.select(*cols), hist


def apply_status(inventory: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """INV-06: ``updates(owner, repo, status, error_msg, ts[, sequence][, worker_id])`` set status,
    error and ``processed_at``.  The last update of a row by ``(ts, sequence)`` decides; every update
    of a queue row is one history row, whose previous status is that of the update before it (for
    the first one: of the queue)."""
    u = updates.select(*K, F.col("status").alias("u_status"), F.col("error_msg").alias("u_error"),
                       F.col("ts").alias("u_ts"),
                       (F.col("worker_id") if "worker_id" in updates.columns else F.lit(None).cast("string"))
                       .alias("u_worker"), F.lit(True).alias("_upd"),
                       (F.col("sequence") if "sequence" in updates.columns else F.lit(0)).cast("long").alias("_seq"))
    place = ["u_ts", "_seq", "u_status", "u_error", "u_worker"]
    last = u.groupBy(*K).agg(F.max(F.struct(*place)).alias("_last")).select(*K, "_last.*", F.lit(True).alias("_upd"))
    for c in ("error_msg", "processed_at"):
        if c not in inventory.columns:
            inventory = inventory.withColumn(c, F.lit(None).cast(INVENTORY_SCHEMA[c].dataType))
    j = inventory.join(last, K, "left")
    hit = F.col("_upd").isNotNull()
    cols = []
    for col in inventory.columns:
        if col == "status":
            cols.append(F.when(hit, F.col("u_status")).otherwise(F.col("status")).alias(col))
        elif col == "error_msg":
            cols.append(F.when(hit, F.col("u_error")).otherwise(F.col("error_msg")).alias(col))
        elif col == "processed_at":
            cols.append(F.when(hit, F.col("u_ts")).otherwise(F.col("processed_at")).alias(col))
        else:
            cols.append(F.col(col))
    # a row of the queue sees few updates in a batch
    w = Window.partitionBy(*K).orderBy(*place)
    seq = u.withColumn("_prev", F.lag("u_status").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    hist = (inventory.select(*K, F.col("status").alias("_queue_status")).join(seq, K)
            .select(*K, F.when(F.col("_first"), F.col("_queue_status")).otherwise(F.col("_prev")).alias("from_status"),
                    F.col("u_status").alias("to_status"), F.col("u_ts").alias("transitioned_at"),
                    F.col("u_error").alias("error_msg"), F.col("u_worker").alias("worker_id")))
    return j.select(*cols), hist


def apply_heartbeats(inventory: DataFrame, beats: DataFrame) -> DataFrame:
    """INV-07: ``claimed_at`` becomes the latest heartbeat, only for rows still processing.

    Beats are reduced to one row per key (partial aggregation) before the join.
    """
    b = beats.groupBy(*K).agg(F.max("ts").alias("beat"))
    j = inventory.join(b, K, "left")
    return j.select(*[F.when((F.col("status") == "processing") & F.col("beat").isNotNull(), F.col("beat"))
                      .otherwise(F.col("claimed_at")).alias(c) if c == "claimed_at" else F.col(c)
                      for c in inventory.columns])


def requeue_stale(inventory: DataFrame, now, timeout_minutes: int = STALE_TIMEOUT_MINUTES
                  ) -> tuple[DataFrame, DataFrame]:
    """INV-08: processing rows claimed before ``now - timeout`` return to pending.

    A NULL ``claimed_at`` is never stale.  History: processing -> pending with
    the reclaim message.
    """
    cutoff = _ts(now) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(timeout_minutes))
    stale = (F.col("status") == "processing") & (F.col("claimed_at") < cutoff)
    stale = F.coalesce(stale, F.lit(False))
    cols = []
    for c in inventory.columns:
        if c == "status":
            cols.append(F.when(stale, F.lit("pending")).otherwise(F.col(c)).alias(c))
        elif c in ("worker_id", "claimed_at"):
            cols.append(F.when(stale, F.lit(None)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    hist = inventory.where(stale).select(*K, F.lit("processing").alias("from_status"),
                                         F.lit("pending").alias("to_status"), _ts(now).alias("transitioned_at"),
                                         F.lit(STALE_MESSAGE).alias("error_msg"),
                                         F.lit(None).cast("string").alias("worker_id"))
    return inventory.select(*cols), hist


def current_status(events: DataFrame) -> DataFrame:
    """INV-09: latest status per repository from the history (tie-break on ``event_id``)."""
    order = F.struct("transitioned_at", "event_id") if "event_id" in events.columns else F.col("transitioned_at")
    return events.groupBy(*K).agg(F.max_by("to_status", order).alias("status"),
                                  F.max("transitioned_at").alias("since"))


def align_schema(df: DataFrame, schema: StructType = INVENTORY_SCHEMA,
                 defaults: dict | None = None) -> DataFrame:
    """INV-10: add the missing columns of ``schema`` (with defaults), keep existing data."""
    defaults = COLUMN_DEFAULTS if defaults is None else defaults
    out = []
    for f in schema.fields:
        if f.name in df.columns:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            d = defaults.get(f.name)
            out.append(F.lit(d).cast(f.dataType).alias(f.name))
    extra = [c for c in df.columns if c not in schema.fieldNames()]
    return df.select(*out, *extra)


def status_counts(inventory: DataFrame) -> DataFrame:
    """INV-11."""
    return inventory.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def recent_transitions(events: DataFrame, inventory: DataFrame, n: int = 10, key: str = "repo_key") -> DataFrame:
    """INV-12: newest history rows joined to their queue row (top-n is the feature)."""
    inv = inventory.select(key, F.col("owner").alias("q_owner"), F.col("repo").alias("q_repo"))
    ev = events.select(key, "from_status", "to_status", "transitioned_at", "error_msg",
                       *(["event_id"] if "event_id" in events.columns else []))
    order = [F.desc("transitioned_at")] + ([F.desc("event_id")] if "event_id" in events.columns else [])
    return (ev.join(inv, key).orderBy(*order).limit(n)
            .select(F.col("q_owner").alias("owner"), F.col("q_repo").alias("repo"), "from_status", "to_status",
                    "transitioned_at", "error_msg"))


def missing_metrics(inventory: DataFrame) -> DataFrame:
    """INV-13: crawled rows whose metrics were never filled."""
    return inventory.where((F.col("status") == "crawled") & F.col("loc_v1").isNull())


def hub_and_anomaly_strings(hubs: DataFrame, anomalies: DataFrame, transitions: DataFrame) -> DataFrame:
    """INV-15: ``"id1, id2, id3"`` and ``"id (coupling: c, z-score: z)"`` joined by ", ".

    Both lists are per new version; hubs are bounded by k, anomalies are kept
    whole and ordered by node position.
    """
    from evograph.operators.intents import python_float_str
    h = (hubs.groupBy("project", F.col("version").alias("v_new"))
         .agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("id")))).alias("h"))
         .select("project", "v_new", F.array_join(F.transform("h", lambda x: x["id"]), ", ").alias("top_hubs")))
    a = (anomalies.groupBy("project", F.col("version").alias("v_new"))
         .agg(F.array_sort(F.collect_list(F.struct(
             "implicit", "ord", F.concat(F.col("id").cast("string"), F.lit(" (coupling: "),
                                         F.col("coupling").cast("string"), F.lit(", z-score: "),
                                         python_float_str(F.col("z_raw")), F.lit(")")).alias("t")))).alias("a"))
         .select("project", "v_new", F.array_join(F.transform("a", lambda x: x["t"]), ", ").alias("coupling_anomalies")))
    return (transitions.select("project", "v_old", "v_new").join(h, ["project", "v_new"], "left")
            .join(a, ["project", "v_new"], "left")
            .select("project", "v_old", "v_new", F.coalesce("top_hubs", F.lit("")).alias("top_hubs"),
                    F.coalesce("coupling_anomalies", F.lit("")).alias("coupling_anomalies")))


def backfill_metrics(inventory: DataFrame, per_transition: DataFrame,
                     key: tuple[str, str, str] = ("graph_project", "tag1", "tag2")) -> DataFrame:
    """INV-14: fill the derived columns of crawled rows that lack them.

    ``per_transition`` holds one row per (project, v_old, v_new) with the
    derived columns (sizes, conformance, diff, cycles, verdict, hub and
    anomaly strings).  Rows that already have metrics, or whose transition is
    unknown, are left as they are.  Equi-join on the transition key.
    """
    p, a, b = key
    derived = [c for c in per_transition.columns if c not in ("project", "v_old", "v_new")]
    pt = per_transition.select(F.col("project").alias(p), F.col("v_old").alias(a), F.col("v_new").alias(b),
                               *[F.col(c).alias(f"_n_{c}") for c in derived], F.lit(True).alias("_has"))
    j = inventory.join(pt, [p, a, b], "left")
    todo = (F.col("status") == "crawled") & F.col("loc_v1").isNull() & F.col("_has").isNotNull()
    out = [F.when(todo, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in derived else F.col(c)
           for c in inventory.columns]
    return j.select(*out)


def extraction_duration(inventory: DataFrame) -> DataFrame:
    """INV-16: seconds between extraction start and end."""
    return inventory.withColumn(
        "extraction_seconds",
        F.unix_timestamp(F.col("extraction_end_at").cast("timestamp"))
        - F.unix_timestamp(F.col("extraction_start_at").cast("timestamp")))
