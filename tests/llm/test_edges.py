"""Empty tables, nulls, ties, repeated rows, long texts and clashing names for every operator and stage."""

import pytest

from jobatlas.llm import chat, decontaminate, langid, mixing, quality, simhash, sitetree, substring, syncmers, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = DOCS + ", id long, tag string, key int, topic_ string, fp long, n_words int, score double"
LONG = "long words " * 30_000


def docs(spark, rows, ddl=DOCS):
    width = ddl.count(",") + 1
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], ddl)


ODD = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (None, "no id at all", "en", None, 12), (3, "42 !!", None, "b", 5),
       (4, "ordinary words in a row", "en", "b", 23), (4, "ordinary words in a row", "en", "b", 23),
       (4, "the same id with other words", "en", "b", 28), (5, LONG, "de", "c", len(LONG)), (None, None, None, None, None)]


@pytest.fixture(scope="module", params=["empty", "odd", "extra"])
def table(request, spark):
    if request.param == "empty":
        return docs(spark, [])
    return docs(spark, ODD, EXTRA if request.param == "extra" else DOCS)


def count(df):
    return len(df.collect())


def test_language_id(table):
    out = langid.accepted(table)
    assert out.columns == table.columns
    # Without a letter there is no language; only labelled rows outside the fold teach one.
    assert all(any(c.isalpha() for c in r.text or "") for r in out.collect())


def test_simhash(table):
    rows = simhash.near_duplicates(table).collect()
    assert len(rows) == table.count()
    assert {r.fp for r in rows if r.id in (1, 2)} <= {0}
    assert len({r.component_id for r in rows if r.fp == 0}) <= 1
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    if rows:
        # Texts: the blank ones, "no id", "42 !!", "ordinary", "the same id", the long one: one row of each.
        assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in kept.collect()) == sorted(
            [(1, ""), (0, "no id"), (3, "42 !!"), (4, "ordin"), (4, "the s"), (5, "long ")])


def test_substring(table):
    out = substring.remove_repeats(table, window=3, prefix=1)
    assert out.columns == table.columns + ["n_words", "n_removed", "kept_text"]
    assert count(out) == table.count()


def test_substring_rows_that_repeat_an_id_do_not_take_from_each_other(spark):
    t = docs(spark, [(4, "a b c d", "en", "x", 7), (4, "z a b c d", "en", "x", 9), (None, "b c d", "en", "x", 5)])
    got = {(r.doc_id, r.text): r.kept_text for r in substring.remove_repeats(t, 3, 1).collect()}
    assert got == {(4, "a b c d"): "a b c d", (4, "z a b c d"): "z a b c d", (None, "b c d"): ""}


def test_decontamination(table, spark):
    bench = spark.createDataFrame([(1, "ordinary words in a row"), (1, "quite another item of some words"), (2, None), (None, "short"),
                                   (3, "the same ID, with other words")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(table, bench).collect()}
    assert found == ({(4, 1), (4, 3)} if table.count() else set())
    out = decontaminate.clean(table, bench)
    assert out.columns == table.columns
    assert count(out) == (6 if table.count() else 0)
    assert count(decontaminate.clean(table, bench.limit(0))) == table.count()


def test_mixing(table, spark):
    out = mixing.mix(table)
    assert set(table.columns) <= set(out.columns)
    assert all(0 <= r.probability <= 1 for r in out.collect())


def test_mixing_with_columns_named_like_its_own(spark):
    ddl = DOCS + ", Probability double, weight double, gap double, tokens long, __source string, rate double"
    rows = [(i, "some words here", "en", "ab"[i % 2], 15, 7.0, 8.0, 9.0, 99, "kept", 5.0) for i in range(4)]
    out = mixing.mix(spark.createDataFrame(rows, ddl))
    assert sorted(c.lower() for c in out.columns) == sorted(
        ["__source", "rate", "doc_id", "text", "lang", "source", "n_chars", "tokens", "topic", "probability", "weight", "gap"])
    assert [(r.doc_id, r.tokens, r.probability, r.weight, r.gap, r["__source"], r.rate) for r in out.orderBy("doc_id").collect()] == [
        (i, 3, 1.0, 1.0, 0.0, "kept", 5.0) for i in range(4)]


def test_quality(table, spark):
    from pyspark.sql import functions as F
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (5, None, 0), (None, 1, 1), (99, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    for marks in (labels, labels.limit(0), labels.where("quality = 1")):
        rows = quality.classify(table, marks, lambda i: F.lit(1)).collect()
        assert len(rows) == table.count() and all(0 <= r.score <= 1 for r in rows)


def test_syncmers(table):
    rows = syncmers.fingerprint_pairs(table).collect()
    assert len(rows) == table.count()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, None, None), (2, "http://a/\r\nb", "<p>x</p>"), (3, "u", "<p>x</p>"), (3, "u", "<p>x</p>"),
                                  (None, "v", "<p>x</p>"), (4, "w", "\r\n\r\nWARC/1.0\r\n" * 5), (5, "ü", "é" * 100_000)], PAGES)


def test_warc(spark, pages):
    assert count(warc.round_trip(pages.limit(0))) == 0
    rows = warc.round_trip(pages).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in rows) == [
        (0, 8, "revisit", 3), (1, 0, "response", 0), (2, 8, "revisit", 3), (3, 8, "response", 0), (3, 8, "response", 0),
        (4, 70, "response", 0), (5, 200_000, "response", 0)]


def test_html(spark, pages):
    assert count(sitetree.extract(pages.limit(0))) == 0
    got = {r.page_id: r.text for r in sitetree.extract(pages).collect() if r.page_id}
    assert got == {1: "", 2: "x", 3: "x", 4: " ".join(["WARC/1.0"] * 5), 5: "é" * 100_000}


def test_chat(spark):
    ddl = "conv_id long, turn long, role string, text string, pieces string"
    rows = [(1, None, None, None, "x"), (1, 2, "assistant", "b", "x"), (1, 2, "assistant", "a", "x"), (None, 1, "user", "q", "x"),
            (2, 1, "assistant", LONG, "x"), (3, 0, "we\\n\nird<|im_start|>", "<|im_sep|><\\|", "x")]
    t = spark.createDataFrame(rows, ddl)
    assert count(chat.parse_chats(chat.format_chats(t.limit(0)))) == 0
    got = {r.conv_id: ([tuple(x) for x in r.turns], r.loss_text) for r in chat.parse_chats(chat.format_chats(t)).collect()}
    assert got == {1: ([("", ""), ("assistant", "a"), ("assistant", "b")], "ab"), None: ([("user", "q")], ""),
                   2: ([("assistant", LONG)], LONG), 3: ([("we\\n\nird<|im_start|>", "<|im_sep|><\\|")], "")}
