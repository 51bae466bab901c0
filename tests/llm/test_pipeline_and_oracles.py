"""The pipeline against its operators' brute force, SQL oracles, and the registration contract."""

import re

import pytest

import corpus_pipeline
from jobatlas.llm import decontaminate, queries
from test_brute_force import SMOKE, slow_components, slow_kept, slow_simhash


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    from tools.oracle_check import compare, duck_connection
    ok, why = compare(queries.QUERIES[name](spark, SMOKE), duck_connection(SMOKE), queries.ORACLES[name])
    assert ok, why


def test_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == [
        "language_id", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "mixing"]

    def step(name, df):
        out = stages[name](spark, df, SMOKE).collect()
        return out, spark.createDataFrame(out, docs.schema) if name != "mixing" else None

    before = {r.doc_id: r for r in docs.collect()}
    rows, df = step("language_id", docs)
    assert {r.doc_id: r for r in rows} == before  # all have letters and one language

    comps = slow_components({d: slow_simhash(r.text) for d, r in before.items()}, 2)
    rows, df = step("simhash_near_dedup", df)
    assert sorted(r.doc_id for r in rows) == sorted(set(comps.values())) and all(before[r.doc_id] == r for r in rows)

    given = {r.doc_id: r for r in rows}
    split, kept = slow_kept({d: r.text for d, r in given.items()}, 50)
    rows, df = step("substring_dedup", df)
    want = {d: given[d].text if len(kept[d]) == len(split[d]) else " ".join(kept[d])
            for d in given if kept[d] or not split[d]}
    assert {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)
    assert df.columns == columns

    bench = spark.read.parquet(f"{SMOKE}/benchmark.parquet")
    bad = {r.doc_id for r in decontaminate.leaks(df, bench).collect()}
    phrase = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    assert {d for d, t in want.items() for b in bench.collect() if phrase(b.text) in phrase(t)} <= bad
    rows, df = step("benchmark_decontamination", df)
    assert {r.doc_id for r in rows} == set(want) - bad and df.columns == columns

    last, _ = step("mixing", df)
    assert {r.doc_id for r in last} <= {r.doc_id for r in rows} and last
    assert {r.doc_id for r in corpus_pipeline.run(spark, SMOKE).collect()} == {r.doc_id for r in last}
