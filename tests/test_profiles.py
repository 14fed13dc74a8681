"""Parsers of profiles, fusion, labels and checks on small texts."""

from pyspark.sql import functions as F

from quillion.functions import scoring, text
from quillion.operators import entities, evaluate, experience, fusion, labels, matching, people, sections, skills, structured

NOW = (2024, 6)


def of(spark, column, *values, kind="string"):
    rows = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in rows.select(column(F.col("x"))).collect()]


def test_experience(spark):
    found = of(
        spark, lambda x: experience.experience(x, NOW),
        "Web Developer - 09/2015 to 05/2019\nLuna Web Design, New York\nmade sites\n\nData Analyst, Acme Corp\nJan 2020 - Present\n- numbers\n- 2018 - 2019 in a bullet",
        "Software Engineer\nStartup Labs | Remote\n2012 - 2014\nwork", "Summer 2023\nIntern at Foo Inc", "2022-01 - 2022-04\nx", "nothing here", "", None,
    )
    short = [[(r.title, r.company, r.start, r.end, r.duration_months) for r in roles] for roles in found]
    assert short[0][0] == ("Web Developer", "Luna Web Design", "2015-09", "2019-05", 44)
    assert short[0][1] == ("Data Analyst", "Acme Corp", "Jan 2020", "Present", 53) and len(short[0]) == 2
    assert short[1] == [("Software Engineer", "Startup Labs", "2012", "2014", 24)]
    assert short[2][0][2:] == ("Jun 2023", "Sep 2023", 3) and short[3][0][2:] == ("2022-01", "2022-04", 3)
    assert short[4:] == [[], [], []]


def test_marks(spark):
    assert of(spark, lambda x: experience.month_number(x, 6), "Mar 2020", "2020-03", "03/2020", "2020", "x") == [24243, 24243, 24243, 24246, None]
    months = lambda a, b: of(spark, lambda x: experience.months_between(F.lit(a), x, NOW), b)[0]
    assert (months("2020-01", "2021-03"), months("2024-01", "till date"), months("2024-05", "2020-01"), months("x", "2020")) == (14, 5, 0, 0)


def test_names(spark):
    texts = ["Jane Roe\nEngineer", "CURRICULUM\nDr Omar Haddad\nx", "Spring Boot\nAnna Maria Silva", "Acme Labs\nDhaka University\nPython Docker\njane roe", "Senior Developer\nVersion 2.0", None]
    assert of(spark, lambda x: people.name_from_text(x, ("python", "docker", "spring boot")), *texts) == ["Jane Roe", "Omar Haddad", "Anna Maria Silva", "", "", ""]


def test_skills(spark):
    terms = ("Python", "C++", "Node.js", "Machine Learning", "Go", "CI/CD")
    texts = ["Knows python, c++ and node.js.", "machine\nlearning; ci/cd", "going golang", None]
    assert of(spark, lambda x: skills.extract_skills(x, terms), *texts) == [["c++", "node.js", "python"], ["ci/cd", "machine learning"], [], []]
    assert of(spark, skills.expand, ["React.js, Next.js", "C++", " "], None, kind="array<string>") == [["react.js, next.js", "c++", "react.js", "next.js"], []]
    spans = [["Python, SQL,", "mail me a@b.com", "python"], None]
    assert of(spark, lambda x: skills.merge_spans(F.array(F.lit("Go")), x), *spans, kind="array<string>") == [["Go", "Python", "SQL"], ["Go"]]


def test_structured():
    assert structured.parse_value("{'a': 1, 'b': None}") == {"a": 1, "b": None}
    assert structured.parse_value('{"a": null}') == {"a": None}
    assert structured.parse_value("""['{"a": 1}', '{"b": 2}{"c": 3}', 'plain', ('x')]""") == [{"a": 1}, {"b": 2}, {"c": 3}, "plain", "x"]
    assert structured.parse_value("('a', {'b': 1})") == ["a", {"b": 1}]
    assert [structured.parse_value(x) for x in (None, "", " nan ", "[]", "{}", "plain text", "{broken", "12", "(" * 3000)] == [None] * 9


def test_headings(spark):
    lines = ["SKILL HIGHLIGHTS:", "── EDUCATION ──", "- Skills", "I like my tools.", "Licenses & Certifications", "x" * 70, ""]
    assert of(spark, sections.heading, *lines) == ["skills", "education", None, None, "certifications", None, None]


def test_fusion_parts(spark):
    marks = [("Jan 2020", "Mar 2021"), ("2020", "2021"), ("2020", ""), ("x", "2021"), ("2023", "now")]
    rows = spark.createDataFrame([([(a, b, 0) for a, b in marks] + [("2020", "2021", 7)],)], "r array<struct<start:string,end:string,duration_months:int>>")
    assert [x.duration_months for x in rows.select(fusion.fill_months(F.col("r"), NOW).alias("r")).first().r] == [14, 23, 0, 0, 17, 7]
    assert of(spark, fusion.canon_degree, "MSc CS", "B.Tech", "PhD", "Certificate", None) == ["Master", "Bachelor", "Ph.D.", "Certificate", ""]
    assert of(spark, fusion.parse_answer, 'Sure: {"a": {"b": 1}} ok', '{"c": 2}', "none", None) == ['{"a": {"b": 1}}', '{"c": 2}', None, None]
    assert of(spark, lambda x: fusion.grounded(F.array(F.lit("Docker "), F.lit("go")), x), "uses docker daily", None) == [["docker"], []]
    gaps = fusion.education_gaps(F.array(F.struct(F.lit("BSc").alias("degree"), F.lit("X").alias("institution"))), F.col("x"), F.array(F.lit("X"), F.lit("Y")))
    assert of(spark, lambda x: gaps, ["bsc", "MSc", "PhD"], kind="array<string>") == [[("MSc", "Y"), ("PhD", None)]]


def test_labels(spark):
    assert of(spark, labels.canon_degree, "Ph.D in X", "MBA", "M.Eng", "B.A.", "HND", "School", None) == ["Ph.D.", "MBA", "Master", "Bachelor", "Diploma", "", ""]
    assert of(spark, lambda x: labels.canon_skills(x)[0], ["SQL", "sql", "English", "CI / CD"], kind="array<string>") == [["sql", "ci cd"]]
    assert labels.tag_tokens("Jane Roe uses C++, and C++", [("SKILL", "c++"), ("PERSON", "Jane Roe")])[1][:3] == ["B-PERSON", "I-PERSON", "O"]
    assert of(spark, labels.score_in, '{"final_score": "7.5"}', '{"scores": {"aggregated_scores": {"a": "x", "b": 3}}}', "{}", None) == [7.5, 3.0, None, None]
    assert of(spark, labels.file_kind, "/a/match_1.json", "mismatch_2", "b/other", "invalid_x") == ["match", "mismatch", "unknown", "invalid"]
    assert [r[0] for r in labels.normalised(spark.createDataFrame([(1.0,), (4.0,)], "s double"), "s").collect()] == [0.25, 1.0]
    assert [r[0] for r in labels.in_percent(spark.createDataFrame([(0.5,), (1.0,)], "s double"), "s").collect()] == [50.0, 100.0]
    assert of(spark, lambda x: F.struct(*labels.split_pair(x)), "a SEP b SEP c", "a") == [("a", "b SEP c"), ("a", None)]


def test_checks(spark):
    assert of(spark, lambda x: F.size(scoring.warnings(x, F.lit("Strong"))), 75, 90, 101, kind="int") == [1, 0, 1]
    assert of(spark, scoring.tier, 7.0, 5.0, 1.0, -5.0, kind="double") == ["Strong", "Average", "Weak", "Strong"]
    assert of(spark, lambda x: scoring.colour(x, F.lit(10)), 7, 4, 1, kind="int") == ["green", "orange", "red"]
    assert of(spark, text.parser_clean, "a\x00b  \n\n\n\nc ") == ["ab\n\nc"] and of(spark, text.ocr_clean, "hell0o t0 me; «x»")[0].endswith('"x"')
    assert matching.default_weights("2,1,1,0") == {"semantic": 0.5, "skill": 0.25, "rubric": 0.25, "bm25": 0.0} and matching.default_weights("") == matching.WEIGHTS
    vectors = of(spark, matching.embed, "red fox", None)
    assert abs(sum(x * x for x in vectors[0]) - 1) < 1e-9 and set(vectors[1]) == {0.0}
    rows = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "t int, g int")
    assert tuple(evaluate.summary_metrics(rows, "t", "g").first()) == (0.75, 0.733333, 0.733333, 4)
    assert of(spark, lambda x: entities.longer(x, x), ["a"], kind="array<string>") == [["a"]]


def test_texts_are_parsed_once(spark, tmp_path):
    """Few keys in one file become several tasks, and no plan splits, parses or counts a text again."""
    import json

    from quillion.operators import profiles
    from quillion.plans import profiles as plans

    spark.range(3 * plans.PROFILES_A_TASK).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert plans._rows(spark, str(tmp_path)).rdd.getNumPartitions() == 3
    for query, split in ((plans.split_sections, 1), (plans.extract_experience, 1), (plans.extract_education, 1)):
        plan = query(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("aggregate(") == split, (query.__name__, plan.count("aggregate("))
    rows = spark.createDataFrame([("Jane Roe\njane@mail.example\nSkills\npython",), (None,)], "text string")
    found = profiles.extract(rows, NOW, ("python",), fields=("name", "email", "skills")).select(F.to_json("cv")).collect()
    assert [json.loads(r[0]) for r in found] == [{"name": "Jane Roe", "email": "jane@mail.example", "skills": ["python"]}, {"name": "", "email": "", "skills": []}]
