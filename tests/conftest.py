import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[*]").appName("jobatlas-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="jobatlas-test-ckpt-"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def raw_jobs(spark, rows):
    """RawJob DataFrame from partial dicts (missing fields blank / 0)."""
    from jobatlas.schemas import RAW_JOB_DDL, RAW_JOB_COLUMNS
    defaults = {c: "" for c in RAW_JOB_COLUMNS}
    defaults.update(skills_raw=[], salary_min=0, salary_max=0, source_ord=0, query_ord=0, page_ord=0, pos=0)
    full = []
    for i, r in enumerate(rows):
        d = {**defaults, "pos": i, **r}
        full.append(tuple(d[c] for c in RAW_JOB_COLUMNS))
    return spark.createDataFrame(full, RAW_JOB_DDL)
