"""SparkSession construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Settings every plan in this package is written against.  They are applied only
# when the session does not already carry a value, so a cluster's own settings win.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "jobatlas", extra: dict | None = None) -> SparkSession:
    """Local/test session.  On a cluster, use the cluster's session and call
    :func:`ensure_checkpoint_dir` instead."""
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "16g"))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_LOCAL_CKPT: str | None = None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there (or in the context's checkpoint dir).
    Only a ``local[...]`` session with neither set -- the test case -- gets an
    invented folder under the machine's temp dir; any other master must name a
    shared folder, because executors on other machines cannot see a local one.
    """
    global _LOCAL_CKPT
    d = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
         or _LOCAL_CKPT)
    if not d:
        master = spark.sparkContext.master or ""
        if master != "local" and not master.startswith("local["):  # not local-cluster[...]
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder on shared storage "
                               "(stage tables and stream checkpoints are written there)")
        d = _LOCAL_CKPT = tempfile.mkdtemp(prefix="jobatlas-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # noqa: BLE001 - core conf may be read-only at run time; keep ours
            pass
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder, for written intermediate tables."""
    return os.path.join(ensure_checkpoint_dir(spark), *parts)


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage by writing ``df`` as a Parquet table in the shared checkpoint folder
    and reading it back.

    Computes the plan once (an eager ``Dataset.checkpoint`` of an unpersisted plan
    computes it twice), survives executor loss, and the re-read table carries
    real file sizes, so later join-strategy choices are made on measured sizes.
    """
    spark = df.sparkSession
    path = shared_path(spark, "tables", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.parquet(path)


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """:func:`cut_lineage` for plans of many stages: the schema is known, so no job reads it back from the files."""
    return observed_stage(df, name)[0]


def observed_stage(df: DataFrame, name: str = "stage", **sums: Column) -> tuple[DataFrame, dict[str, int]]:
    """:func:`staged`, and ``sums`` added up by an ``Observation`` while the table is written, so no job
    scans it for them.  The observed rows are those of the write's own tasks, which count once
    each however often an executor is lost."""
    spark = df.sparkSession
    path = shared_path(spark, "tables", f"{name}-{uuid.uuid4().hex}")
    seen = Observation() if sums else None
    (df.observe(seen, *[F.sum(c).alias(k) for k, c in sums.items()]) if seen else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), {k: int(v or 0) for k, v in seen.get.items()} if seen else {}


def planned_bytes(df: DataFrame) -> int:
    """The planner's size of ``df``; for a table just read back from :func:`cut_lineage` the
    bytes of its files, so this is a measured bound for a broadcast."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition for CPU-heavy row-wise work when the input arrives in
    fewer partitions than the cluster can run at once (e.g. one big row group or a few
    exploded payload files).  A no-op when the input is already spread, which is the
    normal case for large, many-file inputs.  Meant for plain file scans: on a plan
    with an exchange, asking for the partition count makes AQE run the upstream
    stages -- use ``df.hint("rebalance")`` there instead."""
    n = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
