"""J6 keyword search by pieces, L5 places of a hot office, finite request boxes."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import raw_jobs
from jobatlas.operators.pins import PinFilter, rank_detail
from jobatlas.sources import feeds as FD


@pytest.mark.parametrize("small", [True, False])
def test_ten_thousand_keywords(spark, small):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    terms = [word() for _ in range(9_990)] + ["", None, "  ", "A", "bC", "a b", "😀", "x😀y", "\0", "ab\0cd"]
    texts = [" ".join(word() for _ in range(rng.randint(0, 12))) for _ in range(60)] + ["x😀y", "ab", "cd", "Ab\0cD"]
    rows = [{"title": t, "description": texts[-i], "skills_raw": [texts[(i * 7) % 60], "cd"][: i % 3], "source": "remoteok"}
            for i, t in enumerate(texts)]
    raw = raw_jobs(spark, rows)
    queries = spark.createDataFrame([(i, t, 5) for i, t in enumerate(terms)], "query_ord int, keywords string, per_page int")
    out = FD.apply_queries(raw, FD.search(queries, small))
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.pos, r.query_ord, r._per_page) for r in out.collect())
    want = sorted((i, n, 5) for i, r in enumerate(rows) for n, t in enumerate(terms)
                  if any((t or "").lower() in x.lower() for x in (r["title"], r["description"], *r["skills_raw"])) or not t)
    assert got == want and out.columns == [*raw.columns, "_per_page"]


def test_an_empty_search_list_finds_nothing(spark):
    queries = spark.createDataFrame([], "query_ord int, keywords string, per_page int")
    assert FD.apply_queries(raw_jobs(spark, [{"title": "a"}]), queries).collect() == []


def test_places_of_a_hot_office_spread_over_tasks(spark):
    rng = random.Random(3)
    rows = [(1 if rng.random() < 0.4 else rng.randint(2, 300), i, f"2024-01-{rng.randint(1, 28):02d}" if rng.random() < 0.9 else None,
             f"2024-02-{rng.randint(1, 3):02d}") for i in range(6000)] + [(None, 7000, "2024-01-01", None), (None, 7001, None, None)]
    df = spark.createDataFrame(rows, "office_id long, id long, posted string, created string").select(
        "office_id", "id", F.col("posted").cast("date").alias("posted_date"), F.col("created").cast("timestamp").alias("created_at"))
    ranked = rank_detail(df.repartition(5))
    got = {r.id: r.place for r in ranked.where("office_id IS NOT NULL").collect()}
    want = {}
    for office in {r[0] for r in rows if r[0]}:
        own = [r for r in rows if r[0] == office]
        newest = sorted(own, key=lambda r: r[1])
        newest = sorted(newest, key=lambda r: r[3] or "", reverse=True)
        newest = sorted(newest, key=lambda r: r[2] or "", reverse=True)
        want.update({r[1]: n for n, r in enumerate(newest, 1)})
    assert got == want
    assert {r.place for r in ranked.where("office_id IS NULL").collect()} == {1, 2}
    assert all("_range" in line for line in ranked._jdf.queryExecution().executedPlan().toString().splitlines() if "row_number()" in line)
    hot = df.where("office_id = 1").count()
    spread = df.repartitionByRange(8, "office_id", F.col("posted_date").desc_nulls_last(), F.col("created_at").desc_nulls_last(), "id")
    parts = spread.where("office_id = 1").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 2 and max(r["count"] for r in parts) < hot


@pytest.mark.parametrize("bbox, used", [("1,2,3,4", True), ("1e999,2,3,4", False), ("1,2,3,-1e400", False), ("1,2,3", False), ("1,2,3,nan", False)])
def test_boxes_that_overflow_are_ignored(bbox, used):
    assert PinFilter.from_params({"bbox": bbox}).has_viewport is used


def test_few_keywords_do_not_cut_long_texts_into_pieces(spark):
    """a short search list asks each text for its pieces; the hits are those of the cut."""
    terms = ["the", "und", "", "ment", "EN", "İx", "\0", None]
    rows = [{"title": t, "description": "Σ " * 50 + t, "skills_raw": ["src1", t][:i % 3], "source": "remoteok"}
            for i, t in enumerate(["The moment", "rund", "İX", "a\0b", "", "then"])]
    raw = raw_jobs(spark, rows)
    few = FD.search(spark.createDataFrame([(i, t, 5) for i, t in enumerate(terms)], "query_ord int, keywords string, per_page int"))
    out = FD.apply_queries(raw, few)
    assert few.grams and "regexp_extract_all" not in out._jdf.queryExecution().executedPlan().toString()
    cut = FD.apply_queries(raw, FD.Search(few.queries, few.lengths, few.small))
    assert sorted((r.pos, r.query_ord) for r in out.collect()) == sorted((r.pos, r.query_ord) for r in cut.collect())
