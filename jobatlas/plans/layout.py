"""Storage layouts standing in for the original's database indexes.

* location index  -> offices written clustered by latitude band then longitude, so
  Parquet row-group min/max statistics prune viewport range filters;
* skills index    -> none: a filter over the skill arrays reads one column (F2);
* b-tree indexes  -> jobs partitioned by work type (3 values) and sorted by office id
  inside each file (row-group pruning for office lookups).

None of these shuffles a hot key into one task: the jobs writes only sort
within partitions, and the offices range partitioning is over (band, longitude, id),
so even many offices at one point are spread over several range partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAT_BANDS = 64


def write_offices_clustered(offices: DataFrame, path: str, files: int | None = None,
                            bands: int = LAT_BANDS, tie_break: str = "id") -> None:
    """Offices range-partitioned by (latitude band, longitude, id) and sorted the same
    way inside each file; ``files=None`` lets AQE size the range partitions."""
    band = F.floor((F.col("lat") + 90.0) / (180.0 / bands)).cast("int").alias("_band")
    keys = ["_band", "lng"] + ([tie_break] if tie_break in offices.columns else [])
    staged = offices.select("*", band)
    ranged = staged.repartitionByRange(files, *keys) if files else staged.repartitionByRange(*keys)
    (ranged
     .sortWithinPartitions("_band", "lng").drop("_band")
     .write.mode("overwrite").parquet(path))


def write_jobs_by_work_type(jobs: DataFrame, path: str) -> None:
    (jobs.sortWithinPartitions("work_type", "office_id")
     .write.mode("overwrite").partitionBy("work_type").parquet(path))
