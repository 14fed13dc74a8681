import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillion.functions import scoring, text
from quillion.operators import curate, entities, intervals, ranking, sections
from quillion.plans import registry
from quillion.sources import files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    return None if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


#: These build whole records, as ``profile_scores`` does; they are left to the full comparison with SQL.
LONG = {"extract_names", "profile_features", "profile_matches", "profile_rationales", "profile_suggestions"}


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) - LONG))
def test_matches_sql(spark, sql, name):
    found = registry.queries()[name](spark, SF)
    names = sorted(found.columns)
    rows = sorted([shown(r[n]) or "" for n in names] for r in found.collect())
    cursor = sql.execute(registry.oracle_sql()[name])
    own = [c[0] for c in cursor.description]
    assert sorted(own) == names
    assert rows == sorted([shown(r[own.index(n)]) or "" for n in names] for r in cursor.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column).first()[0]


def test_cleaning(spark):
    assert one(spark, text.clean_text(F.col("t")), t="ﬁne — “x”\n• a  b\nPage 1 of 2\n\n\n\nz") == 'fine - "x"\n- a b\n\nz'
    assert one(spark, text.clean_text(F.lit(None).cast("string"))) == ""


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("t")), t="Looking for C++, node.js and 3.5 the") == ["c++", "node.js", "3.5"]


@pytest.mark.parametrize("months, points", [(0, 0), (5, 2), (6, 5), (12, 9), (47, 14), (48, 18), (96, 25), (None, 0)])
def test_experience_bands(spark, months, points):
    assert one(spark, scoring.experience(F.col("m").cast("int")), m=months) == points


def test_rounds_half_to_even(spark):
    assert one(spark, scoring.skills(F.lit(1), target=8)) == 2


def test_education_scores(spark):
    entries = F.array(F.struct(F.lit("BSc").alias("degree"), F.lit(9.0).alias("gpa")), F.struct(F.lit("HSC").alias("degree"), F.lit(None).cast("double").alias("gpa")))
    assert one(spark, scoring.education(entries)) == 12


def test_months(spark):
    f = lambda a, b: one(spark, text.months_between_marks(F.lit(a), F.lit(b), F.lit("2024-03")))
    assert f("2020-01", "2021-03") == 14
    assert f("2024-01", "Present") == 2
    assert f("2025-01", "2024-01") == 0
    assert f("x", "2024-01") == 0


def test_sections(spark):
    cv = "Jane Roe\nSKILLS:\nspark\n\nWork Experience\n- did things with tools.\nLanguages\nEnglish"
    found = sections.split_sections(spark.createDataFrame([(cv,), (None,)], "text string")).select("sections").collect()
    assert found[0][0] == {"header": "Jane Roe", "skills": "spark", "experience": "- did things with tools.", "languages": "English"}
    assert found[1][0] == {"header": ""}


def test_split_is_stable_and_complete(spark):
    rows = curate.hash_split(spark.range(1000), "id", {"test": 100, "train": 900})
    counts = dict(rows.groupBy("split").count().collect())
    assert sum(counts.values()) == 1000 and 60 < counts["test"] < 140


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("café".encode("latin-1"))
    (tmp_path / "b.docx").write_bytes(b"broken")
    rows = {r.path.rpartition("/")[2]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].text == "café"
    assert rows["b.docx"].text is None and "BadZipFile" in rows["b.docx"].error


def test_store_versions(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    files.save_store(spark.range(3), path)
    files.save_store(spark.range(5), path)
    assert files.load_store(spark, path).count() == 5


def test_stream_last_write(spark, tmp_path):
    from quillion.streaming import uploads

    spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 2, "y")], "k string, ts int, v string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, ts int, v string").parquet(f"{tmp_path}/in")
    done = uploads.last_write(stream, "k", "ts").writeStream.outputMode("complete").format("memory").queryName("last").trigger(availableNow=True).start()
    done.awaitTermination()
    assert sorted(map(tuple, spark.table("last").collect())) == [("a", 3, "z"), ("b", 2, "y")]


def test_certifications_and_languages(spark):
    lines = "AWS Certified Developer 2021\n\nplays chess\n  Scrum Master "
    tongues = "English (Native)\nBengali, fluent speaker\nTools: spanish\nsome French at b2 level\nKlingon (Native)"
    rows = spark.createDataFrame([(lines, tongues), ("", None), (None, "")], "a string, b string")
    found = rows.select(entities.certifications(F.col("a")).alias("c"), entities.languages(F.col("b")).alias("l")).collect()
    assert [(c.name, c.issuer, c.year) for c in found[0].c] == [("AWS Certified Developer 2021", "", 2021), ("Scrum Master", "", None)]
    assert [tuple(x) for x in found[0].l] == [("English", "Native"), ("Bengali", "fluent speaker"), ("French", "b2")]
    assert [(r.c, r.l) for r in found[1:]] == [([], []), ([], [])]


def test_languages_on_long_lines(spark):
    rows = spark.createDataFrame([("word " * 100_000 + "x",), ("- English (Native)",), ("speaks English (Native), Thai (A1)",)], "a string")
    found = [[tuple(x) for x in r.l] for r in rows.select(entities.languages(F.col("a")).alias("l")).collect()]
    assert found == [[], [("English", "Native")], [("English", "native")]]


def test_fusion(spark):
    rows = spark.createDataFrame([(["Java", "sql", ""], ["SQL", "Go"]), (None, ["x"]), (["x", "y"], None)], "a array<string>, b array<string>")
    found = rows.select(entities.merged(F.col("a"), F.col("b")).alias("m"), entities.longer(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r.m for r in found] == [["Java", "sql", "Go"], ["x"], ["x", "y"]]
    assert [r.n for r in found] == [["Java", "sql", ""], ["x"], ["x", "y"]]
    items = spark.createDataFrame([(["Member of a club", "- Volunteer", "President of a club"],)], "i array<string>")
    assert items.select(entities.leadership(F.col("i")).alias("k")).first().k == ["President of a club"]


def test_merged_days(spark):
    rows = spark.createDataFrame([(1, "2020-01-01", "2020-01-11"), (1, "2020-01-05", "2020-01-15"), (1, "2020-02-01", "2020-02-02"), (1, "2020-03-02", "2020-03-01"), (2, "2020-01-01", None)], "k int, s string, e string")
    found = intervals.merged_days(rows.select("k", F.to_date("s").alias("s"), F.to_date("e").alias("e")), "k", "s", "e").collect()
    assert [tuple(r) for r in found] == [(1, 15, 2)]


@pytest.mark.parametrize("n, expected", [(0, []), (5, [(0, 5)]), (480, [(0, 480)]), (481, [(0, 480), (440, 41)]), (920, [(0, 480), (440, 480)])])
def test_token_windows(spark, n, expected):
    found = intervals.token_windows(spark.createDataFrame([(7, n)], "id int, n int"), "id", F.col("n")).orderBy("start").collect()
    assert [(r.start, r.length) for r in found] == expected


def test_duration_and_bands(spark):
    rows = spark.createDataFrame([(0,), (5,), (24,), (27,), (None,)], "m int")
    assert [r[0] for r in rows.select(scoring.format_duration(F.col("m"))).collect()] == ["", "5m", "2y", "2y 3m", ""]
    from statistics import NormalDist

    got = spark.range(0, 101, 10).select("id", *scoring.band_probabilities(F.col("id").cast("double"))).collect()
    for s, weak, average, strong in got:
        assert abs(weak - NormalDist().cdf((50 - s - 1e-6) / 12)) < 1e-6 and abs(weak + average + strong - 1) < 1e-9


def test_education(spark):
    body = "Bachelor of Science in Physics\nDhaka University | 2015 - 2019\nCGPA: 3.6\n\nHSC\nNotre Dame College, 2014\n\nplays chess well"
    rows = spark.createDataFrame([(body,), ("",), (None,)], "a string")
    found = rows.select(entities.education(F.col("a")).alias("e")).collect()
    assert [tuple(x) for x in found[0].e] == [("Bachelor", "Dhaka University", 2015, 3.6, "Physics"), ("HSC", "Notre Dame College", 2014, 3.6, "")]
    assert [r.e for r in found[1:]] == [[], []]


def test_many_projects(spark):
    rows = spark.createDataFrame([("\n".join(f"Title{i} - Tool" for i in range(5000)),)], "a string")
    assert rows.select(F.size(entities.projects(F.col("a")))).first()[0] == 5000


def test_projects(spark):
    body = "Shop - React + Redux\n- cart and checkout.\ngithub.com/a/shop\nBlog (Django)\nwrites posts\n\nSolver\nuses c++ code"
    rows = spark.createDataFrame([(body,), ("",), (None,)], "a string")
    found = rows.select(entities.projects(F.col("a"), ("react", "django", "c++")).alias("p")).collect()
    assert [tuple(x) for x in found[0].p] == [
        ("Shop", ["react"], "- cart and checkout. github.com/a/shop", "github.com/a/shop"),
        ("Blog (Django)", ["django"], "writes posts", None),
        ("Solver", ["c++"], "uses c++ code", None),
    ]
    assert [r.p for r in found[1:]] == [[], []]


def test_search_of_several_queries(spark):
    """Each query is scored as if it were alone, and none is dropped without an error."""
    docs = spark.createDataFrame([(1, "red fox runs"), (2, "blue fox"), (3, "red red hen"), (4, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "red fox"), (50, "blue hen"), (100, "")], "item_id long, text string")
    for score in (ranking.bm25_corpus, ranking.bm25_pair):
        found = sorted(tuple(r) for r in score(docs, queries, query_col="item_id").collect())
        alone = [(i, *r) for i in (0, 50, 100) for r in score(docs, queries.where(f"item_id = {i}").select("text")).collect()]
        assert found == sorted(alone) and len(found) == 12
        with pytest.raises(Exception, match="more than one query"):
            score(docs, queries.select("text")).collect()
    best = ranking.top_k(ranking.bm25_pair(docs, queries, query_col="item_id"), 2, by="item_id").collect()
    assert sorted((r.item_id, r.rank, r.doc_id) for r in best) == [(0, 1, 1), (0, 2, 3), (50, 1, 2), (50, 2, 3), (100, 1, 1), (100, 2, 2)]


def test_phone_only_contacts_stay(spark, tmp_path):
    rows = [(1, "call 555-123-4567 now"), (2, "a@b.com"), (3, "nothing"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.email, r.phone) for r in registry.queries()["extract_contacts_all"](spark, str(tmp_path)).collect()}
    assert set(found) == {1, 2, 3, 4} and found[1] == ("", "555-123-4567") and found[2] == ("a@b.com", "")


def test_means_round_as_in_sql(spark):
    texts = [" ".join(["one two three four five six seven eight nine ten."] * 37 + ["one two three four five six seven eight nine ten eleven."] * 3), "Banana banana cat dog cat dog"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    features = text.macro_features(F.col("t"))
    found = rows.select("t", *[features[n].alias(n) for n in ("mean_sentence_len", "flesch_reading_ease")]).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id INT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    own = con.execute(f"SELECT mean_sentence_len, flesch_reading_ease FROM ({registry.oracle_sql()['text_macro_features']}) ORDER BY doc_id").fetchall()
    assert [(r.mean_sentence_len, r.flesch_reading_ease) for r in found] == own and own[0][0] == 10.07 and own[1][1] == 59.74
