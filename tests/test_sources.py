"""Adapters, the versioned store and the check of records."""

import json
import random
import shutil
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillion.operators import curate, evaluate, ranking, validate
from quillion.sources import adapters, store


def test_rebuild(spark):
    row = {
        "personal_info": json.dumps({"name": "Jane Roe", "email": "unknown", "summary": "Builds things."}),
        "experience": "[{'title': 'Engineer', 'company': 'Acme', 'dates': {'start': '2020', 'end': '2021'}, 'responsibilities': ['Ran it', '']}, 'x']",
        "education": json.dumps([{"degree": {"level": "BSc", "field": "Physics"}, "institution": {"name": "Dhaka"}, "dates": {"expected_graduation": "2019"}}, {"degree": "MSc", "institution": "X"}]),
        "skills": json.dumps({"technical": {"languages": [{"name": "Go"}, "sql"], "years": 3}}),
        "projects": json.dumps([{"name": "Shop", "technologies": ["React", None], "description": "sells"}]),
        "certifications": json.dumps([{"name": "AWS", "issuer": "Amazon"}, "CKA"]), "achievements": json.dumps([{"description": "won"}]),
    }
    rows = spark.createDataFrame([(1, *row.values()), (2, *[None] * 7), (3, *["prose ["] * 7)], "id int, " + ", ".join(f"{k} string" for k in row))
    got = {r.id: r.text for r in adapters.rebuild(rows).collect()}
    assert got[1].split("\n") == [
        "Jane Roe", "SUMMARY", "Builds things.", "EXPERIENCE", "Engineer at Acme | 2020 - 2021", "  - Ran it", "EDUCATION", "BSc Physics at Dhaka (2019)", "MSc at X", "SKILLS", "Go, sql",
        "PROJECTS", "Shop [React]", "  sells", "CERTIFICATIONS", "AWS - Amazon", "CKA", "ACHIEVEMENTS", "won",
    ]
    assert got[2] == got[3] == ""


def test_flatten_and_plain(spark):
    rows = spark.createDataFrame([("{}", "ran", " nan ", None), (None, None, None, "t")], "personal_info string, experience string, skills string, text string")
    assert [r[0] for r in rows.select(adapters.flatten({c: F.col(c) for c in rows.columns})).collect()] == ["ran", ""]
    assert [(r.text, r.sections) for r in adapters.plain(rows).collect()] == [("", {}), ("t", {})]


def test_netsol(spark):
    school = json.dumps([{"university": "Dhaka", "degree_title": "BSc", "end_date": "2019"}, 3, {"university": "X", "institution": "Y"}])
    rows = spark.createDataFrame([("Jane", '["sql"]', school, "[]", "a job"), (None, "nan", None, "", None)], "candidate_name string, skills string, education string, experience string, job_description string")
    first, second = adapters.netsol(rows).collect()
    assert json.loads(first.sections["personal_info"]) == {"name": "Jane"} and set(first.sections) == {"personal_info", "skills", "education"}
    found = [{k: json.loads(v) if v.startswith("{") else v for k, v in e.items()} for e in json.loads(first.sections["education"])]
    assert found == [{"dates": {"end": "2019"}, "degree": {"level": "BSc"}, "institution": {"name": "Dhaka"}}, {"university": "X", "institution": "Y"}]
    assert first.text.startswith('Name: Jane Skills: ["sql"] Education: [') and first.text.endswith("Job Description: a job")
    assert (second.sections, second.text) == ({}, "")


def test_store(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    assert store.versions(spark, path) == [] and store.count_saved(spark, path) == 0 and store.load(spark, path, "id long").count() == 0
    with pytest.raises(FileNotFoundError):
        store.load(spark, path)
    store.save(spark.range(3), path)
    store.save(spark.range(5), path)
    assert store.count_saved(spark, path) == 5
    store.remove(spark, path, spark.range(2), "id")
    assert sorted(r.id for r in store.load(spark, path).collect()) == [2, 3, 4]
    newest = Path(store.versions(spark, path)[0].removeprefix("file:"))
    for file in newest.glob("*.parquet"):
        file.write_bytes(b"broken")
        (newest / f".{file.name}.crc").unlink(missing_ok=True)
    assert store.load(spark, path).count() == 5
    shutil.rmtree(newest)
    store.clear(spark, path)
    assert store.count_saved(spark, path) == 0
    store.vacuum(spark, path, 1)
    assert len(store.versions(spark, path)) == 1


def test_appends(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    store.append_new(spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string"), path, ["k"])
    store.save_batches(path, ["k"])(spark.createDataFrame([(2, "z"), (3, "c")], "k int, v string"), 0)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    rows = spark.range(40)
    done = f"file://{tmp_path}/done"
    rows.where("id < 10").select("id", F.lit("old").alias("w")).write.parquet(done)
    store.resume(rows, done, "id", lambda part: part.select("id", F.lit("new").alias("w")), 3)
    assert {r.w: r.n for r in spark.read.parquet(done).groupBy("w").agg(F.count("*").alias("n")).collect()} == {"old": 10, "new": 30}
    lines = f"file://{tmp_path}/lines"
    store.write_lines(rows, lines)
    assert spark.read.json(lines).count() == 40
    assert [tuple(r) for r in store.write_summary(rows.select((F.col("id") % 4 == 0).alias("b")), f"file://{tmp_path}/sum", "b").collect()] == [(False, 30, 0.75), (True, 10, 0.25)]


def test_comparison(spark):
    cv = "struct<name:string,email:string,phone:string,skills:array<string>,experience:array<struct<title:string,company:string>>,education:array<struct<degree:string,institution:string>>,projects:array<struct<name:string>>,certifications:array<struct<name:string>>,languages:array<struct<language:string>>>"
    full = ("Jane", "j@x.org", "1", ["go", "sql"], [("Lead", "Acme"), ("", "")], [("BSc", "X")], [("Shop",), ("",)], [], [("Thai",)])
    rows = spark.createDataFrame([("a", ("", None, None, None, None, None, None, None, None), None, None), ("b", full, 70, "Average")], f"cv_id string, cv {cv}, total_score int, label string")
    found = store.comparison(rows).collect()
    assert [(r.cv_id, r.name, r.score, r.skills, r.experience, r.flagged) for r in found] == [("b", "Jane", 70, 2, 2, 0), ("a", "Unknown", 0, 0, 0, 0)]
    first = store.detailed(rows).first()
    assert (first.skills, first.experience, first.education, first.projects, first.languages) == ("go, sql", "Lead @ Acme", "BSc @ X", "Shop", "Thai")


def test_validate(spark):
    cases = {
        json.dumps({"name": "x", "total_score": 3, "skills": ["a"], "education": [{"year": None, "gpa": "3.5"}], "extra": 1}): [],
        json.dumps({"name": 3, "skills": "a", "education": [{"year": "soon"}, 4], "experience": [{"title": None, "duration_months": 2.5}]}): ["name", "skills", "education.0.year", "education.1", "experience.0.title", "experience.0.duration_months"],
        "{broken": ["invalid JSON"], "[1]": ["invalid JSON"], "": ["invalid JSON"],
    }
    rows = spark.createDataFrame([(k,) for k in cases], "j string")
    for r in rows.select("j", validate.errors(F.col("j")).alias("e")).collect():
        assert r.e == cases[r.j]


def test_metrics(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0, ["sql", "go"], "sql here"), ("a", 3.0, 1.0, None, None), ("b", 2.0, 2.0, ["x"], "x")], "g string, p double, q double, s array<string>, t string")
    assert tuple(evaluate.wins(rows, "p", "q").first()) == (1, 1, 1, 2.0, 1.6667, 2.0, 2.0)
    assert sorted(map(tuple, evaluate.grounded_ratio(rows, "s", "t", "g").collect())) == [("a", 2, 1, 0.5), ("b", 1, 1, 1.0)]
    spans = spark.createDataFrame([(1, "X", "a"), (1, "X", "b"), (2, "Y", "c")], "doc_id int, type string, text string")
    found = spark.createDataFrame([(1, "X", "a"), (2, "Z", "c")], "doc_id int, type string, text string")
    got = {r.type: (r.precision, r.recall, r.f1) for r in evaluate.span_scores_by_type(spans, found).collect()}
    assert got == {"X": (1.0, 0.5, 0.666667), "Y": (0.0, 0.0, 0.0), "Z": (0.0, 0.0, 0.0)}
    runs = spark.sql("SELECT 'r' AS run, timestamp'2024-01-01 00:00:00' AS b, timestamp'2024-01-01 00:00:02' AS e, NULL AS x UNION ALL SELECT 'r', timestamp'2024-01-01 00:00:01', timestamp'2024-01-01 00:00:04', 'bad'")
    assert tuple(evaluate.rates(runs, "run", "b", "e", "x").first()) == ("r", 2, 1, 4.0, 0.5)
    grid = spark.createDataFrame([(1.0, 3.0, 1.0), (2.0, 1.0, 2.0), (3.0, 2.0, 3.0)], "a double, b double, y double")
    assert tuple(evaluate.best_blend(grid, "a", "b", "y").first()) == (1.0, 1.0)
    many = spark.createDataFrame([(float(v), float(w)) for v, w in [(1, 5), (1, 4), (2, 9), (100, 9), (7, 1)]], "a double, b double")
    assert abs(evaluate.spearman(many, "a", "b").first().rho - 2.5 / 9.5) < 1e-6


def test_leaks_leave_the_pool(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(["common", "words", "here", *words[i : i + 20]])) for i in range(0, 40, 10)]
    near = texts[0][1] + " more"
    pool = spark.createDataFrame([*texts, (100, near), (101, texts[0][1]), (102, None), (103, "")], "id long, text string")
    held = spark.createDataFrame([(1000, texts[0][1]), (1001, "common words here"), (1002, None)], "id long, text string")
    assert sorted(tuple(r) for r in curate.near_leaks(pool, held).collect()) == [(0, 1000), (100, 1000), (101, 1000)]
    assert sorted(r.id for r in curate.drop_leaks(pool, held).collect()) == [10, 20, 30, 102, 103]
    assert curate.drop_leaks(pool, held.limit(0)).count() == 8 and curate.near_leaks(pool.limit(0), held).count() == 0


def shuffled_bytes(spark):
    """What all stages of the session have written to shuffles so far."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    context.listenerBus().waitUntilEmpty()
    stages = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_leaks_shuffle_less_than_the_texts(spark):
    rng = random.Random(3)
    texts = [(i, " ".join("".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(200))) for i in range(2000)]
    near = [(5000 + i, texts[i][1] + " more") for i in range(0, 2000, 100)]
    odd = [(7000, texts[0][1]), (7001, texts[0][1]), (7001, texts[0][1]), (None, texts[0][1]), (7002, None), (7003, " .,")]
    pool = spark.createDataFrame([*texts, *near, *odd], "id long, text string")
    held = pool.where("id % 50 = 0 OR id = 7001 OR id IS NULL")
    before = shuffled_bytes(spark)
    found = Counter((r.a_id, r.b_id) for r in curate.near_leaks(pool, held).where("a_id != b_id").collect())
    written = shuffled_bytes(spark) - before
    first = {0: 1, 5000: 1, 7000: 1, 7001: 2}  # ids of one group, and how many rows have them
    want = Counter({(a, b): first[a] * first[b] for a in first for b in first if a != b})
    want.update({pair: 1 for i in range(100, 2000, 100) for pair in ((i, 5000 + i), (5000 + i, i))})
    assert found == want
    assert 0 < written < sum(len(t) for _, t in texts) / 2


def test_query_blocks(spark):
    query = spark.createDataFrame([(i, f"alpha beta{i}") for i in range(20)] + [(20, None)], "q int, text string")
    docs = spark.createDataFrame([(1, "alpha beta3 beta3"), (2, ""), (2, ""), (3, None)], "doc_id int, text string")
    blocks = ranking.query_blocks(query, "q", "text", 300)
    assert len(blocks) > 1 and sorted(r.q for b in blocks for r in b.collect()) == list(range(21))
    whole = ranking.bm25_corpus(docs, query, query_col="q").collect()
    apart = [r for b in blocks for r in ranking.bm25_corpus(docs, b, query_col="q").collect()]
    assert sorted(whole) == sorted(apart) and len(whole) == 84 and [r.q for r in whole if r.score == max(x.score for x in whole)] == [3]
    assert {r.score for r in whole if r.doc_id != 1} == {0.0}
