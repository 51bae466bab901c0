"""Structured Streaming runs: landed JSON payloads end to end, and replay idempotence."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from jobatlas.operators.normalize import drop_incomplete, normalize
from jobatlas.sources import feeds as FD
from jobatlas.streaming import incremental as INC


def _land(folder, name, doc):
    with open(os.path.join(folder, name), "w") as fh:
        fh.write(json.dumps(doc))


def _prepare(stream):
    raw = FD.jooble(stream)
    norm = drop_incomplete(normalize(raw))
    return norm.select("dedup_hash", "company_name", "title", "city", "country",
                       F.struct("source_ord", "query_ord", "page_ord", "pos").alias("seq"))


def test_payload_stream_first_seen_and_replay(spark):
    land = tempfile.mkdtemp(prefix="land-")
    out = tempfile.mkdtemp(prefix="out-")
    _land(land, "p1.json", {"jobs": [
        {"id": 1, "company": "Acme", "title": "Engineer", "location": "Berlin, Germany"},
        {"id": 2, "company": "acme", "title": "ENGINEER", "location": "berlin, germany"},
        {"id": 3, "company": "Initech", "title": "Analyst", "location": "Paris, France"}]})
    snap, ck = f"{out}/snapshot", f"{out}/checkpoint"
    INC.first_seen_stream(INC.payload_stream(spark, land), "dedup_hash", ["seq"], snap, ck, _prepare)
    first = {(r.company_name, r.title) for r in spark.read.parquet(snap).collect()}
    assert first == {("Acme", "Engineer"), ("Initech", "Analyst")}

    # a new landed file: one known posting, one new
    _land(land, "p2.json", {"jobs": [
        {"id": 4, "company": "ACME", "title": "engineer", "location": "Berlin, Germany"},
        {"id": 5, "company": "Globex", "title": "Designer", "location": "Remote"}]})
    INC.first_seen_stream(INC.payload_stream(spark, land), "dedup_hash", ["seq"], snap, ck, _prepare)
    assert spark.read.parquet(snap).count() == 3

    # replaying everything with a fresh checkpoint (a lost checkpoint) changes nothing
    INC.first_seen_stream(INC.payload_stream(spark, land), "dedup_hash", ["seq"], snap, f"{out}/ck2", _prepare)
    snap_rows = spark.read.parquet(snap)
    assert snap_rows.count() == 3
    assert snap_rows.select("dedup_hash").distinct().count() == 3


def test_facet_stream_complete_mode(spark):
    land = tempfile.mkdtemp(prefix="land-")
    out = tempfile.mkdtemp(prefix="out-")
    spark.createDataFrame([("remote",), ("onsite",), ("remote",)], "work_type string") \
        .write.mode("overwrite").parquet(f"{land}/a")
    stream = INC.file_stream(spark, f"{land}/a", "work_type string")
    INC.facet_stream(stream, ["work_type"], f"{out}/r", f"{out}/ck")
    got = {r.work_type: r.n for r in spark.read.parquet(f"{out}/r").collect()}
    assert got == {"remote": 2, "onsite": 1}


def test_count_updates_over_several_batches_and_a_replay(spark):
    land, out = tempfile.mkdtemp(prefix="land-"), tempfile.mkdtemp(prefix="out-")
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    def add(*skills):
        spark.createDataFrame([(k,) for k in skills], "skill string").coalesce(1).write.mode("append").parquet(land)

    def run(checkpoint, result):
        stream = INC.file_stream(spark, land, "skill string", max_files_per_trigger=1)
        INC.count_updates_stream(stream, ["skill"], result, checkpoint)
        return {r.skill: r.n for r in INC.latest_counts(spark, result, "skill string").collect()}

    assert INC.latest_counts(spark, f"{out}/none", "skill string").count() == 0
    add("a", "b", "a", None)
    assert run(f"{out}/ck", f"{out}/r") == {"a": 2, "b": 1, None: 1}
    add("b", "c")
    add("b")
    assert run(f"{out}/ck", f"{out}/r") == {"a": 2, "b": 3, "c": 1, None: 1}
    third = spark.read.parquet(f"{out}/r").where("batch = 2").collect()
    assert len(third) == 1  # only what the batch changed
    # the same batches once more, over the folders they have written
    assert run(f"{out}/ck2", f"{out}/r") == {"a": 2, "b": 3, "c": 1, None: 1}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider


def test_stateful_dedup_stream(spark):
    land = tempfile.mkdtemp(prefix="land-")
    out = tempfile.mkdtemp(prefix="out-")
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, v int").write.parquet(f"{land}/one")
    INC.first_seen_stream_stateful(INC.file_stream(spark, f"{land}/one", "k string, v int"), "k",
                                   f"{out}/r", f"{out}/ck")
    assert sorted(r.k for r in spark.read.parquet(f"{out}/r").collect()) == ["a", "b"]


def test_unseen_paths_agree(spark):
    """The broadcast probe and the shuffle anti-join return the same new keys."""
    from jobatlas.session import cut_lineage
    firsts = cut_lineage(spark.range(0, 3000).select((F.col("id") * 2).alias("k"), F.col("id").alias("v")))
    seen = spark.range(0, 5000).select((F.col("id") * 3).alias("k"))
    small = {tuple(r) for r in INC.unseen(firsts, seen, ["k"], limit=1 << 30).collect()}
    big = {tuple(r) for r in INC.unseen(firsts, seen, ["k"], limit=0).collect()}
    assert small == big and len(small) == 3000 - 1000   # multiples of 6 below 6000 are known


def test_ingest_stream_matches_batch_run_and_replays_cleanly(spark):
    """The whole ingestion per micro-batch over landed files, committed as store versions."""
    from test_ingest import JOOBLE, REMOTEOK
    from jobatlas.plans import ingest as I
    land = tempfile.mkdtemp(prefix="land-")
    root = tempfile.mkdtemp(prefix="store-") + "/store"
    os.makedirs(f"{land}/source=remoteok")
    os.makedirs(f"{land}/source=jooble/query_ord=0")
    with open(f"{land}/source=remoteok/a.json", "w") as fh:
        fh.write(REMOTEOK)
    with open(f"{land}/source=jooble/query_ord=0/a.json", "w") as fh:
        fh.write(JOOBLE)
    with open(f"{land}/source=jooble/query_ord=0/b.json", "w") as fh:
        fh.write("not json")
    gaz = spark.createDataFrame([("berlin|germany", 52.5, 13.4, 0), ("paris|france", 48.9, 2.35, 0)],
                                "location_key string, lat double, lng double, rank int")
    queries = FD.queries_frame(spark, [""], 100)
    ck = tempfile.mkdtemp(prefix="ck-")

    INC.ingest_stream(INC.landed_stream(spark, land), root, gaz, queries, ck)
    def metrics(run):
        return I.finished_runs(spark, root).where(F.col("run") == run).first()

    m1 = metrics(1)
    assert (m1.fetched, m1.after_dedup, m1.inserted, m1.skipped, m1.geocode_fail, m1.errors) == (5, 3, 2, 0, 1, 1)
    assert {r.title for r in I.read_store(spark, root).jobs.collect()} == {"Engineer", "Analyst"}
    assert [r.location_key for r in spark.read.parquet(f"{root}/unresolved/run=1").collect()] == ["remote"]

    _land(f"{land}/source=jooble/query_ord=0", "c.json", {"jobs": [
        {"id": 12, "company": "Initech", "title": "Analyst", "location": "Paris, France"},
        {"id": 13, "company": "Hooli", "title": "Dev", "location": "Paris, France"}]})
    INC.ingest_stream(INC.landed_stream(spark, land), root, gaz, queries, ck)
    m2 = metrics(2)
    assert (m2.fetched, m2.inserted, m2.skipped, m2.errors) == (2, 1, 1, 0)
    assert I.read_store(spark, root).jobs.count() == 3 and I.read_store(spark, root, 1).jobs.count() == 2
    assert spark.read.parquet(f"{root}/jobs/run=2").count() == 2  # the touched rows alone

    # same checkpoint, nothing new: no batch, no run
    INC.ingest_stream(INC.landed_stream(spark, land), root, gaz, queries, ck)
    assert I.last_run(spark, root) == 2
    # a lost checkpoint re-pulls everything: known postings only update, nothing is inserted
    INC.ingest_stream(INC.landed_stream(spark, land), root, gaz, queries, tempfile.mkdtemp(prefix="ck-"))
    assert I.last_run(spark, root) == 3 and metrics(3).inserted == 0
    assert I.read_store(spark, root).jobs.count() == 3


def _land_pull(root, n, pages):
    folder = f"{root}/pull={n}/source=remoteok/page_ord=0"
    os.makedirs(folder)
    with open(f"{folder}/a.json", "w") as fh:
        json.dump(pages, fh)


def test_a_backlog_of_pulls_equals_pulls_of_their_own(spark):
    """Caps hold per pull, and a later pull updates what an earlier one inserted."""
    from jobatlas.plans import ingest as I

    def items(n, price):
        return [{"id": str(i), "company": f"C{i}", "position": "Engineer", "location": "Berlin, Germany", "url": f"u{n}",
                 "salary_min": str(price)} for i in range(6 * n, 6 * n + 8)]
    gaz = spark.createDataFrame([("berlin|germany", 52.5, 13.4, 0)], "location_key string, lat double, lng double, rank int")
    queries = FD.queries_frame(spark, [""], 7)

    def jobs(together):
        land, root = tempfile.mkdtemp(prefix="land-"), tempfile.mkdtemp(prefix="store-") + "/store"
        ck = tempfile.mkdtemp(prefix="ck-")
        for n in (0, 1, 2):
            _land_pull(land, n, items(n, 3_000_000_000 + n))
            if not together:
                INC.ingest_stream(INC.landed_stream(spark, land), root, gaz, queries, ck)
        INC.ingest_stream(INC.landed_stream(spark, land), root, gaz, queries, ck)
        store = I.read_store(spark, root)
        names = store.companies.select(F.col("id").alias("company_id"), "name")
        places = store.offices.join(names, "company_id").select(F.col("id").alias("office_id"), "name")
        return {(r.name, r.source_url, r.salary_min) for r in store.jobs.join(places, "office_id").collect()}

    alone = jobs(False)
    assert jobs(True) == alone
    # pull n brings companies 6n .. 6n + 6 (a cap of 7); the shared one has the later pull's fields
    assert alone == {(f"C{i}", f"u{min(i // 6, 2)}", 3_000_000_000 + min(i // 6, 2)) for i in range(19)}


def test_a_replayed_batch_and_a_run_that_stopped_half_way(spark):
    """A batch whose runs are all there adds nothing; a run without its last row is written anew."""
    import shutil
    from jobatlas.plans import ingest as I
    land, root, ck = tempfile.mkdtemp(prefix="land-"), tempfile.mkdtemp(prefix="store-") + "/store", tempfile.mkdtemp(prefix="ck-")
    gaz = spark.createDataFrame([("berlin|germany", 52.5, 13.4, 0)], "location_key string, lat double, lng double, rank int")
    queries = FD.queries_frame(spark, [""], 7)
    for n in (1, 2):
        _land_pull(land, n, [{"id": str(i), "company": f"C{i}", "position": "Dev", "location": "Berlin, Germany"} for i in range(n, n + 2)])

    def go():
        INC.ingest_stream(INC.landed_stream(spark, land), root, gaz, queries, ck)
        store = I.read_store(spark, root)
        return sorted(r.name for r in store.companies.collect()), store.jobs.count(), sorted(
            (r.run, r.pull, r.inserted) for r in I.finished_runs(spark, root).collect())

    want = (["C1", "C2", "C3"], 3, [(1, 1, 2), (2, 2, 1)])
    assert go() == want
    # The stream forgets that it ended its batch, so the batch is given out again.
    for f in os.listdir(f"{ck}/commits"):
        os.remove(f"{ck}/commits/{f}")
    assert go() == want
    # The second pull's run stopped before its last row, with other rows left behind in one of its tables.
    for f in os.listdir(f"{ck}/commits"):
        os.remove(f"{ck}/commits/{f}")
    shutil.rmtree(f"{root}/runs/run=2")
    spark.read.parquet(f"{root}/companies/run=1").write.mode("overwrite").parquet(f"{root}/companies/run=2")
    assert sorted(r.name for r in I.read_store(spark, root).companies.collect()) == ["C1", "C2"]
    assert go() == want


def test_an_unreadable_run_folder_stops_the_run(spark):
    import pytest
    land, root = tempfile.mkdtemp(prefix="land-"), tempfile.mkdtemp(prefix="store-") + "/store"
    _land_pull(land, 0, [{"id": "1", "company": "A", "position": "B", "location": "Berlin, Germany"}])
    os.makedirs(f"{root}/runs/run=1")
    with open(f"{root}/runs/run=1/part-0.parquet", "w") as fh:
        fh.write("not a parquet file")
    gaz = spark.createDataFrame([("berlin|germany", 52.5, 13.4, 0)], "location_key string, lat double, lng double, rank int")
    with pytest.raises(Exception):
        INC.ingest_stream(INC.landed_stream(spark, land), root, gaz, FD.queries_frame(spark, [""], 7), tempfile.mkdtemp(prefix="ck-"))
    assert os.listdir(root) == ["runs"] and os.listdir(f"{root}/runs") == ["run=1"]


def test_runs_hold_only_touched_rows(spark):
    from jobatlas.plans import ingest as I
    from jobatlas.schemas import COMPANIES_DDL, JOBS_DDL, OFFICES_DDL
    root = tempfile.mkdtemp(prefix="store-")
    metrics = spark.createDataFrame([(0,) * len(I.METRICS)], ", ".join(f"{c} long" for c in I.METRICS))
    assert I.last_run(spark, root) == 0 and I.read_store(spark, root).cache.collect() == []
    for n in range(1, 5):
        none = [spark.createDataFrame([], d) for d in (COMPANIES_DDL, OFFICES_DDL, JOBS_DDL)]
        cache = spark.createDataFrame([(k, float(n), 0.0, None) for k in ("k", f"k{n}")], I.GEOCODE_CACHE_DDL)
        I.write_run(I.Store(*none, cache), metrics, root, n)
        for back in range(1, n + 1):
            got = {r.location_key: r.latitude for r in I.read_store(spark, root, back).cache.collect()}
            assert got == {"k": back, **{f"k{i}": i for i in range(1, back + 1)}}
        assert spark.read.parquet(f"{root}/cache/run={n}").count() == 2
    # A filter on the key reaches the scan below the fold.
    plan = I.read_store(spark, root).cache.where("location_key = 'k2'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(location_key,k2)" in plan


def test_a_run_counts_while_it_writes(spark):
    """No Spark job scans a stage table for the metrics: two runs took 167 with such scans."""
    from jobatlas.plans.registry import QUERIES
    import jobatlas.plans.q_ingest  # noqa: F401 - registers the query
    sc = spark.sparkContext
    sc.setJobGroup("run-metrics", "")
    try:
        assert len(QUERIES["run_metrics"](spark, "/root/testdata/sf0.001").collect()) == 2
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("run-metrics")) <= 150


def test_a_pull_lands_in_packed_files(spark):
    """files do not grow in number with the pages, and a packed page has the context that a file of its own had."""
    from jobatlas.plans import q_ingest, q_stream
    land = tempfile.mkdtemp(prefix="land-")
    pages = [(f'{{"results": [{i}]}}', i, "gb") for i in range(200)]
    assert q_ingest.landed(spark, "/root/testdata/sf0.01", "adzuna").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    q_stream.land_pull(spark, "/root/testdata/sf0.01", f"{land}/pull=3", ["adzuna"])
    files = [f for d, _, fs in os.walk(land) for f in fs if f.endswith(".parquet")]
    want = {(r.value, r.page_ord, r.country) for r in q_ingest.landed(spark, "/root/testdata/sf0.01", "adzuna").collect()}
    assert len(files) <= max(spark.sparkContext.defaultParallelism, 8) < len(want)
    spark.createDataFrame(pages, "value string, page_ord int, country string").coalesce(1).write.parquet(f"{land}/pull=3/source=jooble/query_ord=2")
    out = tempfile.mkdtemp(prefix="out-")
    q = INC.landed_stream(spark, land, packed=True).writeStream.format("parquet").option("path", f"{out}/o").option(
        "checkpointLocation", f"{out}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{out}/o").collect()
    assert {(r.value, r.page_ord, r.country) for r in got if r.source == "adzuna"} == want
    assert {(r.value, r.page_ord, r.country, r.query_ord) for r in got if r.source == "jooble"} == {(*p, 2) for p in pages}
    assert {r.pull for r in got} == {3} and all(r.landed_at for r in got)
