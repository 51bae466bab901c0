"""Structured Streaming versions of the periodic re-pull.

* :func:`first_seen_stream` -- "seen before, ever" suppression (T1/T2): each micro-
  batch keeps its first row per key (partial ``min`` aggregate), drops keys already
  in the snapshot table (anti-join) and appends the rest.  A replayed batch id is
  a no-op because its keys are already in the snapshot.  State lives in the
  snapshot table, not in the streaming state store, so it is unbounded in size
  but not in memory.
* :func:`facet_stream` -- incremental counts (T3) in ``complete`` mode, each batch
  overwriting the result table; :func:`count_updates_stream` -- the same in ``update``
  mode: a batch writes only the groups that it changed, with state in RocksDB.
* :func:`ingest_stream` -- the whole ingestion run (T1) per micro-batch of landed
  payload files (:func:`landed_stream`), each pull a run of an append-only store.

All run with ``trigger(availableNow=True)``: everything that has landed is
processed in bounded micro-batches and the query stops -- the cron-style run.
Checkpoints and outputs go under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dedup import first_per_key
from ..session import cut_lineage, planned_bytes, staged

# Largest micro-batch (bytes of its written first rows) whose keys are broadcast to probe the snapshot.
BROADCAST_BATCH_BYTES = 16 << 20


def _read_or_none(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """The table at ``path``, or None if there is no such path.  Any other failure is raised:
    a table that cannot be read must not pass for an empty one."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _ensure_table(spark: SparkSession, path: str, schema) -> None:
    if _read_or_none(spark, path, schema) is None:
        spark.createDataFrame([], schema).write.mode("ignore").parquet(path)


def unseen(firsts: DataFrame, seen: DataFrame, keys: Sequence[str],
           limit: int = BROADCAST_BATCH_BYTES) -> DataFrame:
    """Rows of ``firsts`` (one per key) whose key is not in ``seen``.

    ``seen`` is the whole history and keeps growing; a plain anti-join would
    shuffle all of it for every micro-batch.  While the batch's files are small
    (``firsts`` is written; measured bytes), its keys are broadcast into a semi-join over
    the snapshot scan, so the snapshot is only read, and the few keys found are
    anti-joined back.  Larger batches use the shuffle join.
    """
    keys = list(keys)
    if limit > 0 and planned_bytes(firsts) <= limit:
        known = seen.join(F.broadcast(firsts.select(*keys)), keys, "left_semi")
        return firsts.join(known, keys, "left_anti")
    return firsts.join(seen, keys, "left_anti")


def first_seen_stream(stream: DataFrame, key: str | Sequence[str], order: Sequence[str],
                      snapshot_path: str, checkpoint_path: str,
                      prepare: Callable[[DataFrame], DataFrame] | None = None,
                      limit: int = BROADCAST_BATCH_BYTES) -> None:
    """Run the stream to completion, appending first-ever rows per key to ``snapshot_path``."""
    spark = stream.sparkSession
    keys = [key] if isinstance(key, str) else list(key)
    shaped = prepare(stream) if prepare else stream
    _ensure_table(spark, snapshot_path, shaped.schema)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        firsts = cut_lineage(first_per_key(batch, keys, order), "firsts")
        seen = batch.sparkSession.read.schema(shaped.schema).parquet(snapshot_path).select(*keys)
        unseen(firsts, seen, keys, limit).write.mode("append").parquet(snapshot_path)

    q = (shaped.writeStream.foreachBatch(per_batch)
         .option("checkpointLocation", checkpoint_path)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def first_seen_stream_stateful(stream: DataFrame, key: str | Sequence[str], out_path: str,
                               checkpoint_path: str, watermark: tuple[str, str] | None = None) -> None:
    """T2 with the streaming state store instead of a snapshot table.

    Without ``watermark`` this is ``dropDuplicates(key)``: the same "seen before, ever"
    rule with state (in RocksDB) that grows with the number of keys (which row of a key wins
    inside one micro-batch is not defined; :func:`first_seen_stream` keeps the first
    by sequence).  With ``watermark=(event_time_col, delay)`` it is
    ``dropDuplicatesWithinWatermark``: bounded state, but a key seen again after the
    watermark has passed counts as new -- a different rule, so it is opt-in.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if watermark:
        deduped = stream.withWatermark(*watermark).dropDuplicatesWithinWatermark(keys)
    else:
        deduped = stream.dropDuplicates(keys)
    with rocksdb_state(stream.sparkSession):
        q = (deduped.writeStream.format("parquet").option("path", out_path)
             .option("checkpointLocation", checkpoint_path).outputMode("append")
             .trigger(availableNow=True).start())
        q.awaitTermination()


def facet_stream(stream: DataFrame, group_cols: Sequence[str], result_path: str, checkpoint_path: str) -> None:
    """Run ``groupBy(group_cols).count()`` in complete mode; the result table is rewritten per batch."""
    counts = stream.groupBy(*group_cols).count().withColumnRenamed("count", "n")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(result_path)

    q = (counts.writeStream.outputMode("complete").foreachBatch(per_batch)
         .option("checkpointLocation", checkpoint_path)
         .trigger(availableNow=True).start())
    q.awaitTermination()


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB: on the executors' disks, uploaded to the
    checkpoint location, so it is bounded neither by the heap nor lost with an executor."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def count_updates_stream(stream: DataFrame, group_cols: Sequence[str], result_path: str, checkpoint_path: str) -> None:
    """T3 in update mode: every batch writes the groups whose count it changed, with their new count, to
    ``batch=<id>`` of the result.  A replayed batch overwrites its own folder.  Read the
    result with :func:`latest_counts`."""
    counts = stream.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n"))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{result_path}/batch={batch_id}")

    with rocksdb_state(stream.sparkSession):
        q = (counts.writeStream.outputMode("update").foreachBatch(per_batch)
             .option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start())
        q.awaitTermination()


def latest_counts(spark: SparkSession, result_path: str, group_schema: str) -> DataFrame:
    """The newest count of every group written by :func:`count_updates_stream`; ``group_schema`` is the DDL of its
    group columns.  Counts only grow, but the newest batch decides: a partial aggregate per group."""
    schema = T.StructType.fromDDL(group_schema)
    keys = schema.names
    full = T.StructType([*schema, T.StructField("n", T.LongType()), T.StructField("batch", T.LongType())])
    written = _read_or_none(spark, result_path, full)
    if written is None:  # no batch yet
        written = spark.createDataFrame([], full)
    return written.groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))


def file_stream(spark: SparkSession, folder: str, schema, name_glob: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """T1 source: landed parquet files in ``folder`` (optionally only names matching
    ``name_glob``), schema fixed up front."""
    r = spark.readStream.schema(schema)
    if name_glob:
        r = r.option("pathGlobFilter", name_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(folder)


def payload_stream(spark: SparkSession, path: str) -> DataFrame:
    """T1 source for feed payloads: one whole landed JSON file per row."""
    from pyspark.sql import functions as F
    return (spark.readStream.format("text").option("wholetext", True).load(path)
            .select("value", F.input_file_name().alias("path")))


# -- T1: the whole ingestion run per micro-batch ---------------------------------------

def with_payload_context(payloads: DataFrame) -> DataFrame:
    """Request context of landed payloads from their path:
    ``.../pull=<n>/source=<feed>/[query_ord=<n>/][page_ord=<n>/][country=<code>/]<file>``.
    A path without a pull number belongs to pull 0.  Context that a packed file has as a column is kept where
    it is given; the path fills the rest."""
    p = F.col("path")

    def part(name: str, pattern: str):
        return F.nullif(F.regexp_extract(p, f"/{name}=({pattern})/", 1), F.lit(""))
    context = {"pull": F.coalesce(part("pull", "[0-9]+").cast("long"), F.lit(0).cast("long")), "source": part("source", "[a-z]+"),
               "query_ord": part("query_ord", "[0-9]+").cast("int"), "page_ord": part("page_ord", "[0-9]+").cast("int"),
               "country": part("country", "[a-z]+")}
    return payloads.withColumns({n: F.coalesce(F.col(n), c) if n in payloads.columns else c for n, c in context.items()})


#: Rows of a packed landed file: a payload and its request context (what is NULL comes from the path).
PACKED_DDL = "value string, query_ord int, page_ord int, country string"


def landed_stream(spark: SparkSession, root: str, packed: bool = False) -> DataFrame:
    """Landed payload files under ``root`` (see :func:`with_payload_context`), one whole
    file per row, with its modification time (``landed_at``).

    ``packed`` reads Parquet files of many payloads, a row each (``PACKED_DDL``).  A pull of many pages is to
    land packed: with a file per page, listing, opening and logging the files costs far more than their content.

    A trigger takes every file that has landed: a pull's caps and first-of-fingerprint rule
    need the whole pull, so a bound on files per trigger is not offered.  A pull is to land
    whole (written elsewhere and moved, or complete before the stream starts)."""
    # the context comes from the path, so partition discovery (which would insist on
    # the same key=value levels under every feed) is switched off
    r = spark.readStream.option("recursiveFileLookup", True)
    df = r.schema(PACKED_DDL).parquet(root) if packed else r.format("text").option("wholetext", True).load(root)
    df = df.select("*", F.col("_metadata.file_path").alias("path"),
                   F.col("_metadata.file_modification_time").alias("landed_at"))
    return with_payload_context(df)


def ingest_stream(stream: DataFrame, store_root: str, gazetteer: DataFrame, queries: DataFrame,
                  checkpoint_path: str, per_page: int | None = None) -> None:
    """Run the batch ingestion (adapters, query search and caps, normalise, dedup,
    geocode, upserts, metrics) on the pulls of every micro-batch of landed payloads.

    The pulls of a batch run one after the other in order of their number, each on the
    store that the one before left, so a backlog of pulls in one batch gives what the
    pulls give in batches of their own.  Each run appends the rows it touched under its run number, one
    more than the last finished run's, and then its row in ``<store_root>/runs`` (``ingest.write_run``).  A pull
    with a row for its stream and batch is skipped, so a replayed batch is a no-op, and a batch that
    failed half way goes on with the pulls that are missing.  A run's "now" is the latest modification
    time of the pull's files, the same on every replay; location keys without a place are in
    ``<store_root>/unresolved/run=<n>``.  One stream writes a store root at a time.
    """
    from ..plans import ingest as I
    from ..sources import feeds as FD

    spark = stream.sparkSession
    cap = FD.DEFAULT_PER_QUERY if per_page is None else per_page
    stream_id = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint_path).hex[:12]

    def run_pull(s: SparkSession, landed: DataFrame, run_at, batch_id: int, pull: int, run: int) -> None:
        payloads = {src: landed.where(F.col("source") == src) for src in FD.SOURCE_ORDER}
        raw, errors = I.fetch(payloads, queries, cap)
        store = I.read_store(s, store_root, run - 1)
        touched, metrics, unresolved = I.run(raw, store, gazetteer, F.lit(run_at).cast("timestamp"), errors)
        unresolved.write.mode("overwrite").parquet(f"{store_root}/unresolved/run={run}")
        I.write_run(touched, metrics, store_root, run, stream_id, batch_id, pull)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        # The landed files are read once, into the shared folder, for the adapters of all pulls.
        batch = staged(batch, "landed-batch")
        pulls = batch.groupBy("pull").agg(F.max("landed_at").alias("t")).orderBy("pull").collect()
        done = I.finished_runs(s, store_root).where((F.col("stream") == stream_id) & (F.col("batch_id") == batch_id))
        mine = {r.pull for r in done.select("pull").collect()}
        run = I.last_run(s, store_root)
        for p in pulls:
            if p.pull not in mine:
                run += 1
                run_pull(s, batch.where(F.col("pull") == p.pull), p.t, batch_id, p.pull, run)

    q = (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_path)
         .trigger(availableNow=True).start())
    q.awaitTermination()
