"""Example vectors of the normaliser, fingerprint and batch dedup (FIXTURES.md parts B and C)."""

from pyspark.sql import functions as F

from conftest import raw_jobs
from jobatlas.functions import text as X
from jobatlas.operators.dedup import dedup_batch
from jobatlas.operators.normalize import drop_incomplete, normalize


def _norm(spark, rows):
    return normalize(raw_jobs(spark, rows)).collect()


def test_basic_fields(spark):
    (n,) = _norm(spark, [dict(source="remoteok", company_name="  Acme   Corp ", title="  Senior Go Engineer ",
                              location_raw="Bengaluru, India", work_type_raw="remote",
                              skills_raw=["Go", "go", "Kubernetes"],
                              description="We use PostgreSQL and Docker heavily.")])
    assert n.company_name == "Acme Corp"
    assert n.title == "Senior Go Engineer"
    assert (n.city, n.country) == ("Bengaluru", "India")
    assert n.work_type == "remote"
    assert n.experience_level == "senior"
    assert n.skills[:2] == ["go", "kubernetes"]


def test_skills_dedup_and_mine(spark):
    (n,) = _norm(spark, [dict(source="remotive", company_name="DataCo", title="Backend Developer",
                              location_raw="Remote", skills_raw=["Python", "python", "  "],
                              description="Experience with PostgreSQL, redis and Kafka required. "
                                          "Bonus: machine learning.")])
    assert n.skills.count("python") == 1
    for want in ("postgresql", "redis", "kafka", "machine learning"):
        assert want in n.skills
    assert n.skills[0] == "python"


def test_work_type_cases(spark):
    cases = [("", "New York, USA", "office based", "onsite"), ("hybrid", "London", "", "hybrid"),
             ("", "", "work from home role", "remote"), ("full remote", "Anywhere", "", "remote"),
             ("remote", "", "hybrid possible", "hybrid")]
    rows = [dict(company_name="X", title="Dev", work_type_raw=w, location_raw=l, description=d)
            for w, l, d, _ in cases]
    got = [r.work_type for r in sorted(_norm(spark, rows), key=lambda r: r.title)]
    out = normalize(raw_jobs(spark, rows)).orderBy("pos").select("work_type").collect()
    assert [r.work_type for r in out] == [c[3] for c in cases]
    assert len(got) == len(cases)


def test_location_key(spark):
    cases = [("Bengaluru", "India", "bengaluru|india"), ("", "Remote", "remote"), ("Berlin", "", "berlin"),
             ("", "", "remote"), ("  Paris ", " France ", "paris|france")]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "city string, country string")
    got = [r[0] for r in df.select(X.location_key("city", "country")).collect()]
    assert got == [c[2] for c in cases]


def test_skill_quirks(spark):
    df = spark.createDataFrame([([".NET"], ""), ([], "ci/cd and objective-c"), ([], "we use redis, docker.")],
                               "tags array<string>, d string")
    got = [r[0] for r in df.select(X.normalize_skills("tags", "d")).collect()]
    assert got == [["net"], [], ["redis"]]


def test_seniority_vectors(spark):
    cases = [("Sr. Engineer", "", "", "senior"), ("Mid-Level Dev", "", "", "mid"), ("Entry level", "", "", "entry"),
             ("Entrylevel", "", "", "entrylevel"), ("Internship", "", "", ""),
             ("Lead of senior team", "", "", "lead"), ("Dev", "Junior", "senior", "junior"),
             ("Désenior", "", "", "senior"), ("Principal", "", "", "principal"), ("jr. dev", "", "", "junior")]
    df = spark.createDataFrame([c[:3] for c in cases], "t string, e string, d string")
    got = [r[0] for r in df.select(X.classify_experience("t", "e", "d")).collect()]
    assert got == [c[3] for c in cases]


def test_split_location_vectors(spark):
    cases = [("San Francisco, CA, USA", ("San Francisco", "USA")), ("WORLDWIDE", ("", "Worldwide")),
             ("India", ("", "India")), (", ,", ("", "")), ("", ("", "")), ("anywhere", ("", "Anywhere"))]
    df = spark.createDataFrame([(c,) for c, _ in cases], "raw string")
    got = [(r.l.city, r.l.country) for r in df.select(X.split_location("raw").alias("l")).collect()]
    assert got == [e for _, e in cases]


def test_parse_dates(spark):
    cases = [("2024-01-01T23:30:00-08:00", "2024-01-01"), ("2024-01-05T00:00:00.0000000", "2024-01-05"),
             ("05.01.2024", "2024-01-05"), ("2024/01/05", "2024-01-05"), ("2024-13-01", None), ("", None),
             ("2024-01-05 10:11:12", "2024-01-05"), ("2024-01-05T25:00:00Z", None), ("2024-02-30", None),
             ("2024-01-05Z", None), ("2024-1-05", None), (" 2024-01-05 ", "2024-01-05")]
    df = spark.createDataFrame([(c,) for c, _ in cases], "s string")
    got = [r[0] for r in df.select(X.parse_posted_date("s").cast("string")).collect()]
    assert got == [e for _, e in cases]


def test_lenient_int(spark):
    df = spark.createDataFrame([("",), ("90000",), ("90000.0",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(X.lenient_int("s")).collect()] == [0, 90000, 90000, 0, 0]


def test_fingerprint_known_value(spark):
    df = spark.createDataFrame([("Acme Corp", "Senior Engineer", "Bengaluru", "India"),
                                ("acme corp", "senior   engineer", "bengaluru", "india"),
                                ("Acme, Corp.", "Senior Engineer!", "Bengaluru", "India"),
                                ("Acme Corp", "Sr. Engineer", "Bengaluru", "India")], "a string, b string, c string, d string")
    h = [r[0] for r in df.select(X.dedup_hash("a", "b", "c", "d")).collect()]
    assert h[0] == "3465ef4bd93ca79752a83f5a0dcdd3a4aac64d249db7538b64359261eaf0f504"
    assert h[0] == h[1] == h[2]
    assert h[3] != h[0]


def test_fingerprint_differs(spark):
    base = ("Acme", "Engineer", "Berlin", "Germany")
    rows = [base, ("Acme", "Designer", "Berlin", "Germany"), ("Acme", "Engineer", "Munich", "Germany"),
            ("Globex", "Engineer", "Berlin", "Germany")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    h = [r[0] for r in df.select(X.dedup_hash("a", "b", "c", "d")).collect()]
    assert len(set(h)) == 4


def test_batch_dedup_keeps_first_in_order(spark):
    raw = raw_jobs(spark, [dict(company_name="Acme", title="Engineer", city="Berlin"),
                           dict(company_name="acme", title="engineer", city="berlin"),
                           dict(company_name="Globex", title="Designer", city="Paris", country="France"),
                           dict(company_name="Acme", title="Engineer", city="Berlin")])
    out = dedup_batch(drop_incomplete(normalize(raw))).orderBy("pos").collect()
    assert [(r.company_name, r.pos) for r in out] == [("Acme", 0), ("Globex", 2)]


def test_hashless_rows_kept(spark):
    df = spark.createDataFrame([("", 1), (None, 2), ("h", 3), ("h", 4)], "dedup_hash string, pos int") \
        .withColumn("source_ord", F.lit(0)).withColumn("query_ord", F.lit(0))
    out = sorted(r.pos for r in dedup_batch(df, order=["source_ord", "query_ord", "pos"]).collect())
    assert out == [1, 2, 3]


def test_incomplete_dropped(spark):
    raw = raw_jobs(spark, [dict(company_name="  ", title="Dev"), dict(company_name="A", title="  "),
                           dict(company_name="A", title="Dev")])
    assert drop_incomplete(normalize(raw)).count() == 1


def test_keep_unicode_fingerprint(spark):
    df = spark.createDataFrame([("株式会社", "エンジニア"), ("株式会社", "デザイナー"), ("Acme", "Ingénieur"),
                                ("Acme", "Ingenieur")], "a string, b string")
    default = [r[0] for r in df.select(X.dedup_hash("a", "b", F.lit(""), F.lit(""))).collect()]
    uni = [r[0] for r in df.select(X.dedup_hash("a", "b", F.lit(""), F.lit(""), keep_unicode=True)).collect()]
    assert default[0] == default[1]          # non-Latin roles collide by default (original behaviour)
    assert uni[0] != uni[1] and uni[2] != uni[3]


def test_strip_html_matches_plain_tag_regex(spark):
    """strip_html equals replacing every <[^>]*> by a space, including '<' after the last '>'."""
    from pyspark.sql import functions as F
    from jobatlas.functions import text as X
    cases = ["", None, "x<y", "<b>bold</b> tail < x", "<<a>>", "é<br>ü<", ">", "<a <b> c", "a < b " * 500]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = df.select(X.strip_html("t").alias("a"), F.regexp_replace("t", X.HTML_TAG, " ").alias("b")).collect()
    assert all(r.a == r.b for r in got)
