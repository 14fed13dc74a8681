"""Queries over profiles that are made from the customers' keys, and the truth about them in SQL.

The SQL states each value from the key alone and reads no text, so it is no second parser.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import entities, evaluate, experience, fusion, labels, matching, profiles, sections, skills
from ..sources import synthetic as made

#: The month that open ends run to, and that marks without a month take.
NOW = (2024, 6)
JOB_EVERY = 5
#: Profiles in a task; how many changes speed and no result.
PROFILES_A_TASK = 2_500


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of all customers.  A file of keys is one or a few tasks, its texts and their records are many times as large: the keys are dealt out first."""
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    return made.profiles(keys.repartition(max(1, -(-keys.count() // PROFILES_A_TASK)), "c_custkey"), "c_custkey")


def _records(spark: SparkSession, sf_dir: str, fields: tuple[str, ...]) -> DataFrame:
    """Records of the free texts, with the fields that are read."""
    return profiles.extract(_rows(spark, sf_dir).select("key", "text"), NOW, made.SKILLS, fields=fields)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.score(_records(spark, sf_dir, profiles.SCORED))


def split_sections(spark, sf_dir):
    """Sections under the default headings."""
    # No plain explode here and below: its test for empty arrays would be moved below and split or parse each text again.
    rows = sections.split_sections(_rows(spark, sf_dir).select("key", "text")).select("key", F.explode_outer("sections").alias("section", "body"))
    return rows.where("section IN ('header', 'summary', 'education', 'skills', 'experience')").select("key", "section", F.size(F.split("body", "\n")).cast("bigint").alias("lines"))


def extract_names(spark, sf_dir):
    rows = _records(spark, sf_dir, ("name", "email", "phone"))
    return rows.select("key", "cv.name", "cv.email", "cv.phone")


def extract_experience(spark, sf_dir):
    """Roles of the free texts."""
    rows = sections.split_sections(_rows(spark, sf_dir).select("key", "text"))
    found = rows.select("key", F.posexplode_outer(experience.experience(sections.section(F.col("sections"), "experience"), NOW)).alias("pos", "r")).where("pos IS NOT NULL")
    return found.select("key", F.col("pos").cast("bigint").alias("pos"), "r.title", "r.company", "r.start", "r.end", F.col("r.duration_months").cast("bigint").alias("months"))


def extract_skills(spark, sf_dir):
    found = skills.extract_skills(F.col("text"), made.SKILLS)
    return _rows(spark, sf_dir).select("key", F.array_join(found, ",").alias("skills"))


def extract_education(spark, sf_dir):
    rows = sections.split_sections(_rows(spark, sf_dir).select("key", "text"))
    found = rows.select("key", F.posexplode_outer(entities.education(sections.section(F.col("sections"), "education"))).alias("pos", "e")).where("pos IS NOT NULL")
    return found.select("key", F.col("pos").cast("bigint").alias("pos"), "e.*")


def extract_projects(spark, sf_dir):
    """Projects of a text with two titles, of which the second has a link."""
    body = F.concat(F.lit("Shop"), F.col("key").cast("string"), F.lit(" - React + SQL\n- sells things.\nBlog (Docker)\nwrites posts\ngithub.com/a/blog"), F.col("key").cast("string"))
    rows = _rows(spark, sf_dir).select("key", F.posexplode(entities.projects(body, made.SKILLS)).alias("pos", "p"))
    return rows.select("key", F.col("pos").cast("bigint").alias("pos"), "p.name", F.array_join("p.tools", ",").alias("tools"), "p.description", "p.link")


def structured_profiles(spark, sf_dir):
    """Records of sections that hold data."""
    rows = profiles.extract(_rows(spark, sf_dir), NOW, made.SKILLS, sections_col="data").select("key", "cv")
    months = F.aggregate(F.transform("cv.experience", lambda r: r["duration_months"]), F.lit(0), lambda a, m: a + m)
    one = lambda c, f: F.get(F.col(f"cv.{c}"), F.lit(0))[f]
    return rows.select(
        "key", "cv.name", F.size("cv.experience").cast("bigint").alias("roles"), months.cast("bigint").alias("months"), one("experience", "company").alias("company"), one("experience", "description").alias("description"),
        one("education", "degree").alias("degree"), one("education", "institution").alias("school"), one("education", "year").cast("bigint").alias("year"), one("education", "gpa").alias("gpa"),
        F.array_join("cv.skills", ",").alias("skills"), one("certifications", "issuer").alias("issuer"), F.size("cv.certifications").cast("bigint").alias("certifications"),
        F.array_join(F.transform("cv.languages", lambda x: F.concat(x["language"], F.lit(":"), F.coalesce(x["proficiency"], F.lit("-")))), ",").alias("languages"),
        one("projects", "description").alias("project"), F.array_join(one("projects", "tools"), ",").alias("tools"), F.array_join("cv.leadership", ",").alias("leadership"),
    )


def profile_scores(spark, sf_dir):
    """Scores of the free texts' records."""
    rows = _scored(spark, sf_dir)
    scores = [F.col("criteria_scores")[i]["score"].alias(k) for i, k in enumerate(scoring.MAX_POINTS)]
    return rows.select("key", *scores, "total_score", "label")


def profile_rationales(spark, sf_dir):
    # No plain explode: its test for empty arrays would be moved below and build the records twice.
    rows = _scored(spark, sf_dir).select("key", F.explode_outer("criteria_scores").alias("c"))
    return rows.select("key", "c.name", "c.rationale")


def profile_suggestions(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    return rows.select("key", F.size("suggestions").cast("bigint").alias("n"), F.get("suggestions", F.lit(0)).alias("first"))


def profile_features(spark, sf_dir):
    rows = _records(spark, sf_dir, (*profiles.SCORED, "achievements"))
    named = scoring.profile_features(F.col("cv"))
    return rows.select("key", *[c.cast("double").alias(n) for n, c in named.items()])


def profile_warnings(spark, sf_dir):
    """Plausibility of labels that are dealt by key."""
    score, given = F.col("key") % 120 - 5, F.when(F.col("key") % 3 == 0, "Strong").when(F.col("key") % 3 == 1, "Weak").otherwise("Good")
    found = scoring.warnings(score, given, F.col("key") % 70, score + F.col("key") % 5)
    return _rows(spark, sf_dir).select("key", F.size(found).cast("bigint").alias("n"), F.get(found, F.lit(0)).alias("first"))


def profile_matches(spark, sf_dir):
    """The five best profiles for each job; jobs are every fifth nation, their skills dealt by key."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    # Profiles without a vector meet no job: they go before their texts are parsed.
    rows = _rows(spark, sf_dir).select("key", "text").join(vectors, F.col("key") == F.col("vec_id"))
    rows = profiles.score(profiles.extract(rows, NOW, made.SKILLS, fields=profiles.SCORED))
    records = rows.select(F.col("key").alias("id"), "cv.skills", "total_score", F.col("embedding").alias("vector"), "text")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").where(F.col("n_nationkey") % JOB_EVERY == 0)
    wanted = F.concat_ws(", ", *[made._of(made.SKILLS, F.col("n_nationkey") + k) for k in (0, 3, 4)])
    jobs = nation.join(vectors, F.col("n_nationkey") == F.col("vec_id")).select(F.col("n_nationkey").alias("job_id"), F.concat(F.lit("We want: "), wanted).alias("job_text"), F.col("embedding").alias("job_vector"))
    best = matching.rank(matching.match(records, jobs, made.SKILLS), 5)
    return best.select("job_id", "rank", "id", "final_match_score", "skill_overlap", F.array_join("missing_skills", ",").alias("missing"))


def fused_records(spark, sf_dir):
    """A rule's and a model's reading of one profile made into one."""
    key = F.col("key")
    langs = F.array(F.struct(F.lit("English").alias("language"), F.lit("C1").alias("proficiency")))
    role = lambda t: F.struct(t.alias("title"), F.lit("Acme").alias("company"), F.lit("Jan 2020").alias("start"), F.lit("2021").alias("end"), F.lit(0).alias("duration_months"))
    school = lambda d: F.struct(d.alias("degree"), F.lit("X").alias("institution"))
    thing = lambda n: F.struct(n.alias("name"))

    def side(name, found, roles, degree):
        return F.struct(
            name.alias("name"), F.lit("").alias("email"), F.lit("1").alias("phone"), found.alias("skills"), F.array(thing(F.lit("Shop"))).alias("projects"), F.array(thing(F.lit("AWS"))).alias("certifications"),
            langs.alias("languages"), roles.alias("experience"), F.array(school(degree)).alias("education"), F.array(F.lit("Head")).alias("leadership"), F.array(F.lit("Prize")).alias("achievements"),
        )

    rules = side(F.lit("Rule"), F.array(F.lit("SQL"), F.lit("Go")), F.array(role(F.lit("Engineer")), role(F.lit("Analyst"))), F.lit("BSc"))
    model = side(F.when(key % 2 == 0, "Model").otherwise(""), F.array(F.lit("sql"), F.lit("Rust")), F.array(role(F.lit("Lead")), role(F.when(key % 3 == 0, "Head").otherwise(""))), F.lit("MSc"))
    fused = fusion.fuse(rules, model)
    roles = fusion.fill_months(fused["experience"], NOW)
    return _rows(spark, sf_dir).select(
        "key", fused["name"].alias("name"), F.array_join(fused["skills"], ",").alias("skills"), F.array_join(F.transform(roles, lambda r: r["title"]), ",").alias("titles"),
        F.get(roles, F.lit(0))["duration_months"].cast("bigint").alias("months"), fusion.canon_degree(F.get(fused["education"], F.lit(0))["degree"]).alias("degree"), F.size(fused["projects"]).cast("bigint").alias("projects"),
    )


def tagged_tokens(spark, sf_dir):
    """How many tokens of each tag a profile's first lines and skills have."""
    rows = _rows(spark, sf_dir)
    values = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("PERSON", made.person(F.col("key"))), ("SKILL", F.lit("apache spark")))])
    rows = rows.select("key", F.concat_ws(" ", made.person(F.col("key")), F.lit("knows Apache Spark, and more")).alias("text"), values.alias("values"))
    found = labels.tag_texts(rows, "key", "text", "values")
    return found.select("key", F.array_join("tags", " ").alias("tags"))


def tagging_scores(spark, sf_dir):
    """Mean accuracy and averaged F1 of labels dealt by key."""
    rows = _rows(spark, sf_dir).select((F.col("key") % 3).alias("truth"), F.when(F.col("key") % 7 == 0, 0).otherwise(F.col("key") % 3).alias("guess"))
    return evaluate.summary_metrics(rows, "truth", "guess")


_QUERIES = (
    split_sections, extract_names, extract_experience, extract_skills, extract_education, extract_projects, structured_profiles, profile_scores, profile_rationales,
    profile_suggestions, profile_features, profile_warnings, profile_matches, fused_records, tagged_tokens, tagging_scores,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def _pick(values: tuple, index: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[({index}) % {len(values)} + 1]"


def oracle_sql() -> dict[str, str]:
    k = "c_custkey"
    name = f"({_pick(made.FIRST, k)} || ' ' || {_pick(made.LAST, f'{k} // 7')})"
    skill_list = f"list_sort(([{', '.join(repr(s) for s in made.SKILLS)}])[1:{k} % 11 + 1])"
    months = f"greatest(0, (2002 + 4 * j + {k} % 3 - 2000 - 4 * j - {k} % 3) * 12 + {NOW[1]} - (({k} + j * 5) % 12 + 1))"
    total_months = f"coalesce(list_sum(list_transform(range(0, {k} % 4), lambda j: {months})), 0)"
    y = f"({total_months} / 12.0::DOUBLE)"
    bands = f"CASE WHEN {y} <= 0 THEN 0 WHEN {y} < 0.5 THEN 2 WHEN {y} < 1 THEN 5 WHEN {y} < 2 THEN 9 WHEN {y} < 4 THEN 14 WHEN {y} < 6 THEN 18 WHEN {y} < 8 THEN 22 ELSE 25 END"
    degree = _pick(tuple(d[1] for d in made.DEGREES), k)
    gpa = f"(3 + ({k} % 10) / 10.0::DOUBLE)"
    base = f"CASE {degree} WHEN 'PhD' THEN 15 WHEN 'Master' THEN 13 ELSE 10 END"
    scored = f"""s AS (SELECT {k} AS key, {bands} AS experience, 0 AS projects, round_even(least(({k} % 11 + 1) / 10.0::DOUBLE, 1.0) * 20, 0)::INT AS skills,
 least({base} + CASE WHEN {gpa} >= 3.5 THEN 2 ELSE 0 END, 15)::INT AS education, (2 * ({k} % 3))::INT AS certifications, CASE {k} % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 5 END AS languages,
 CASE WHEN {k} % 2 = 0 THEN 2 ELSE 0 END AS leadership FROM customer),
t AS (SELECT *, round_even((experience / 25.0::DOUBLE * 0.25 + projects / 20.0::DOUBLE * 0.2 + skills / 20.0::DOUBLE * 0.2 + education / 15.0::DOUBLE * 0.15 + certifications / 10.0::DOUBLE * 0.1 + languages / 5.0::DOUBLE * 0.05 + leadership / 5.0::DOUBLE * 0.05) / 1.0 * 100, 0)::INT AS total_score FROM s)"""
    label = "CASE WHEN total_score >= 72 THEN 'Strong' WHEN total_score >= 50 THEN 'Average' ELSE 'Weak' END"
    order = list(scoring.MAX_POINTS)
    shares = ", ".join(f"{{'f': {n} / {scoring.MAX_POINTS[n]}.0::DOUBLE, 'o': {i}, 'tips': {len(scoring.TIPS[n])}, 'tip': '{scoring.TIPS[n][0].replace(chr(39), chr(39) * 2)}'}}" for i, n in enumerate(order))
    low = f"list_sort(list_filter([{shares}], lambda x: x.f < 0.6))"
    words = lambda n, what: f"'{n}' AS name, {what} AS rationale"
    reasons = [
        words("experience", f"({k} % 4)::VARCHAR || ' roles totalling ' || printf('%.1f', {y}) || ' years of experience'"), words("projects", "'0 projects (0 with a live/GitHub link)'"),
        words("skills", f"({k} % 11 + 1)::VARCHAR || ' matched skills (target 10)'"), words("education", f"'Highest credential is ''' || {degree} || ''' which awards ' || ({base})::VARCHAR || ' base points'"),
        words("certifications", f"({k} % 3)::VARCHAR || ' certifications at 2/cert'"), words("languages", f"({k} % 4)::VARCHAR || ' languages spoken'"), words("leadership", f"CASE WHEN {k} % 2 = 0 THEN '1' ELSE '0' END || ' leadership/volunteer roles'"),
    ]
    role = f"{_pick(made.TITLES, f'{k} + j')} AS title, {_pick(made.COMPANIES, f'{k} + j')} AS company"
    job = lambda i: _pick(made.SKILLS, f"n_nationkey + {i}")
    s, g = f"({k} % 120 - 5)", f"CASE {k} % 3 WHEN 0 THEN 'Strong' WHEN 1 THEN 'Weak' ELSE 'Good' END"
    warned = f"""list_filter([CASE WHEN {s} < 0 OR {s} > 100 THEN 'total_score ' || {s} || ' is outside 0–100 range' END, CASE WHEN {k} % 3 = 2 THEN 'label ''Good'' is not one of: Strong, Average, Weak' END,
 CASE WHEN {k} % 3 = 0 AND {s} < 80 THEN 'Label is ''Strong'' but score is only ' || {s} END, CASE WHEN {k} % 3 = 1 AND {s} >= 50 THEN 'Label is ''Weak'' but score is ' || {s} || ' (should be < 50)' END,
 CASE WHEN {k} % 70 > 60 THEN 'Unusually high skill count: ' || ({k} % 70) || ' — possible extraction error' END, CASE WHEN {s} > 0 AND {k} % 5 > 2 THEN 'Section scores sum to ' || ({s} + {k} % 5) || ' but total_score is ' || {s} END], lambda x: x IS NOT NULL)"""
    return {
        "split_sections": " UNION ALL ".join(
            f"SELECT {k} AS key, '{n}' AS section, ({lines})::BIGINT AS lines FROM customer WHERE {lines} > 0"
            for n, lines in (("header", "3"), ("summary", "1"), ("education", "3"), ("skills", f"({k} % 11 + 1)"), ("experience", f"(3 * ({k} % 4))"))
        ),
        "extract_names": f"SELECT {k} AS key, {name} AS name, 'person' || {k} || '@mail.example' AS email, '555-' || lpad(({k} % 1000)::VARCHAR, 3, '0') || '-4321' AS phone FROM customer",
        "extract_experience": f"SELECT {k} AS key, j AS pos, {role}, {_pick(made.MONTHS, f'{k} + j * 5')} || ' ' || (2000 + 4 * j + {k} % 3) AS start, (2002 + 4 * j + {k} % 3)::VARCHAR AS \"end\", ({months})::BIGINT AS months FROM (SELECT {k}, unnest(range(0, {k} % 4)) AS j FROM customer)",
        "extract_skills": f"SELECT {k} AS key, array_to_string({skill_list}, ',') AS skills FROM customer",
        "extract_education": f"SELECT {k} AS key, 0::BIGINT AS pos, {degree} AS degree, {_pick(made.SCHOOLS, k)} AS institution, (2010 + {k} % 9)::INT AS year, {gpa} AS gpa, {_pick(tuple(d[2] for d in made.DEGREES), k)} AS field FROM customer",
        "extract_projects": f"SELECT {k} AS key, 0::BIGINT AS pos, 'Shop' || {k} AS name, 'sql' AS tools, '- sells things.' AS description, NULL AS link FROM customer UNION ALL SELECT {k}, 1, 'Blog (Docker)', 'docker', 'writes posts github.com/a/blog' || {k}, 'github.com/a/blog' || {k} FROM customer",
        "structured_profiles": f"""SELECT {k} AS key, {name} AS name, ({k} % 4)::BIGINT AS roles, (14 * ({k} % 4))::BIGINT AS months, CASE WHEN {k} % 4 > 0 THEN {_pick(made.COMPANIES, k)} END AS company,
 CASE WHEN {k} % 4 > 0 THEN 'Built it; Ran it; Tools: git' END AS description, 'BSc' AS degree, {_pick(made.SCHOOLS, k)} AS school, (2010 + {k} % 9)::BIGINT AS year, {gpa} AS gpa, 'docker,git,go,linux,sql' AS skills, 'AWS' AS issuer, 1::BIGINT AS certifications,
 'English:C1,Thai:-' AS languages, 'Role: Lead; Sells.' AS project, 'react' AS tools, 'Captain of a team' AS leadership FROM customer""",
        "profile_scores": f"WITH {scored} SELECT key, {', '.join(order)}, total_score, {label} AS label FROM t",
        "profile_rationales": " UNION ALL ".join(f"SELECT {k} AS key, {r} FROM customer" for r in reasons),
        "profile_suggestions": f"WITH {scored}, l AS (SELECT key, {low} AS low FROM t) SELECT key, CASE WHEN len(low) = 0 THEN 1 ELSE least(5, list_sum(list_transform(low, lambda x: x.tips))) END::BIGINT AS n, coalesce(low[1].tip, '{scoring.NO_TIP}') AS first FROM l",
        "profile_features": f"""SELECT {k} AS key, (CASE {degree} WHEN 'PhD' THEN 5 WHEN 'Master' THEN 4 ELSE 3 END)::DOUBLE AS highest_degree_level, {y} AS total_experience_years, ({k} % 11 + 1)::DOUBLE AS skill_count, 0.0::DOUBLE AS project_count, 0.0::DOUBLE AS has_github_link,
 ({k} % 3)::DOUBLE AS certification_count, ({k} % 4)::DOUBLE AS language_count, (CASE WHEN {k} % 2 = 0 THEN 1 ELSE 0 END)::DOUBLE AS leadership_count, 0.0::DOUBLE AS achievement_count, {gpa} AS avg_gpa, ({k} % 4)::DOUBLE AS experience_entry_count, 1.0::DOUBLE AS education_entry_count FROM customer""",
        "profile_warnings": f"SELECT {k} AS key, len(w)::BIGINT AS n, w[1] AS first FROM (SELECT {k}, {warned} AS w FROM customer)",
        "profile_matches": f"""WITH {scored},
c AS (SELECT key AS id, total_score, {skill_list.replace(k, 'key')} AS held, embedding::DOUBLE[] AS v FROM t JOIN embeddings ON vec_id = key),
j AS (SELECT n_nationkey AS job_id, list_sort(list_distinct([{job(0)}, {job(3)}, {job(4)}])) AS wanted, embedding::DOUBLE[] AS w FROM nation JOIN embeddings ON vec_id = n_nationkey WHERE n_nationkey % {JOB_EVERY} = 0),
m AS (SELECT job_id, id, total_score, round(len(list_intersect(wanted, held)) / len(wanted), 4) AS o, array_to_string(list_sort(list_filter(wanted, lambda x: NOT list_contains(held, x))), ',') AS missing, round(greatest(0.0, least(1.0, list_inner_product(v, w))), 4) AS s FROM c CROSS JOIN j),
f AS (SELECT job_id, id, o AS skill_overlap, missing, round((s * 0.5::DOUBLE + o * 0.3::DOUBLE + total_score / 100.0::DOUBLE * 0.2::DOUBLE)::VARCHAR::DECIMAL(38, 20), 4)::DOUBLE AS final_match_score FROM m)
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY final_match_score DESC, id)::INT AS rank, id, final_match_score, skill_overlap, missing FROM f QUALIFY rank <= 5""",
        "fused_records": f"SELECT {k} AS key, CASE WHEN {k} % 2 = 0 THEN 'Model' ELSE 'Rule' END AS name, 'SQL,Go,Rust' AS skills, CASE WHEN {k} % 3 = 0 THEN 'Lead,Head' ELSE 'Engineer,Analyst' END AS titles, 23::BIGINT AS months, 'Master' AS degree, 1::BIGINT AS projects FROM customer",
        "tagged_tokens": f"SELECT {k} AS key, 'B-PERSON I-PERSON O B-SKILL I-SKILL O O' AS tags FROM customer",
        "tagging_scores": f"""WITH r AS (SELECT {k} % 3 AS t, CASE WHEN {k} % 7 = 0 THEN 0 ELSE {k} % 3 END AS g FROM customer), c AS (SELECT unnest([0, 1, 2]) AS c),
x AS (SELECT c, sum((t = c AND g = c)::INT) AS ok, sum((t = c)::INT) AS n, sum((g = c)::INT) AS m FROM c, r GROUP BY c), f AS (SELECT *, 2 * ok / (n + m) AS f1 FROM x)
SELECT round(sum(ok) / sum(n), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * n) / sum(n), 6) AS weighted_f1, sum(n)::BIGINT AS n FROM f""",
    }
