"""Layout helpers: clustered offices prune row groups; skills are filtered without an index."""

import tempfile

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from conftest import SMOKE
from jobatlas.operators.pins import PinFilter
from jobatlas.plans import layout as L
from jobatlas.sources import tables as T


def test_all_of_these_skills_is_one_filter_of_the_jobs(spark):
    jobs = T.jobs(spark, SMOKE)
    key = ("l_orderkey", "l_linenumber", "l_partkey", "office_id")
    found = jobs.where(PinFilter(skills=("red", " Economy ")).job_predicates(jobs)[0]).select(*key).collect()
    want = [tuple(r[k] for k in key) for r in jobs.select(*key, "skills").collect() if {"red", "economy"} <= set(r.skills)]
    assert sorted(map(tuple, found)) == sorted(want) and want


def test_offices_clustered_files_cover_latitude_bands(spark):
    out = tempfile.mkdtemp(prefix="layout-") + "/offices"
    offices = T.offices(spark, "/root/testdata/sf0.01")
    L.write_offices_clustered(offices, out, files=4, bands=8)
    back = spark.read.parquet(out)
    assert back.count() == offices.count()
    import glob
    spans = []
    for f in glob.glob(f"{out}/*.parquet"):
        st = pq.ParquetFile(f).metadata.row_group(0).column(
            [c.name for c in pq.ParquetFile(f).schema_arrow].index("lat")).statistics
        spans.append(st.max - st.min)
    assert spans and max(spans) < 160          # no file spans the whole latitude range


def test_jobs_by_work_type(spark):
    out = tempfile.mkdtemp(prefix="layout-") + "/jobs"
    L.write_jobs_by_work_type(T.jobs(spark, SMOKE).drop("skills"), out)
    back = spark.read.parquet(out)
    assert back.where(F.col("work_type") == "remote").count() == \
        T.jobs(spark, SMOKE).where(F.col("work_type") == "remote").count()


def test_offices_at_one_point_spread_over_files(spark):
    """A hot point (every office at the same coordinates) still fills several files."""
    import glob
    out = tempfile.mkdtemp(prefix="layout-") + "/offices"
    offices = spark.range(4000).select(F.col("id"), F.lit(52.5).alias("lat"), F.lit(13.4).alias("lng"))
    L.write_offices_clustered(offices, out, files=4, bands=8)
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{out}/*.parquet")]
    assert sum(sizes) == 4000 and len([n for n in sizes if n > 0]) >= 3
