"""Nulls, empty tables, repeated rows, clashing names, long texts and near matches."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillion.llm import byte_bpe, decontaminate, hashing, html_extract, lang_id, ngram_join, pii, quality_rules, queries, token_output, warc
from quillion.llm.common import fresh, table

SF = "/root/testdata/sf0.001"
CLEAN = "This sentence has some words that a reader may read, and it goes on for a while. Another one follows here, and it says a thing or two more."


@pytest.fixture(scope="module")
def odd(spark):
    """Columns named like those inside of operators, null ids and texts, repeated rows."""
    rows = [(1, CLEAN), (1, CLEAN), (2, None), (None, CLEAN + " More."), (None, None), (3, ""), (4, "Call 2021-03-05 now!!")]
    names = "_q _qt _t _w _total _keep ends kept ids key host row page node comp grp text_ n_words Size".split()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(n) for n in names})
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, odd, name, stage):
    for docs in (odd, odd.limit(0)):
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == odd.columns
            extra = [c for c in odd.columns if c not in ("doc_id", "text", "n_chars")]
            assert all(r[c] == c for r in out.collect() for c in extra)
        n = {"quality rules": 3, "n-gram Jaccard join": 5}.get(name, 7)
        assert out.count() == (n if docs is odd else 0)


def test_clashing_names(spark, odd):
    passed = [c for c in odd.columns if c not in ("text", "n_chars")]
    judged = quality_rules.judge(odd)
    assert set(odd.columns) <= set(judged.columns) and judged.where("kept").count() == 3
    coded = byte_bpe.round_trip(odd).collect()
    assert len(coded) == 7 and all(r.ends == "ends" for r in coded)
    private = pii.pseudonymise_texts(odd).collect()
    assert len(private) == 7 and all(r[c] == c for r in private for c in passed if c != "doc_id")
    assert token_output.encode_table(odd).count() == 7
    assert ngram_join.link_components(odd).count() == 7
    assert decontaminate.find_passages(odd, table(spark, SF, "benchmark")).count() == 0
    assert lang_id.identify(odd, None).count() == 7
    pages = odd.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), *[c for c in passed if c != "doc_id"])
    assert html_extract.extract(pages).count() == 7 and html_extract.extract(pages.limit(0)).count() == 0
    assert warc.archive_table(pages).count() == 7 and warc.archive_table(pages.limit(0)).count() == 0
    assert fresh(["_Qa", "b"], "_q") == "__q"


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    assert quality_rules.judge(none).count() == byte_bpe.round_trip(none).count() == pii.pseudonymise_texts(none).count() == 0
    assert decontaminate.find_passages(none, table(spark, SF, "benchmark")).count() == 0
    assert lang_id.identify(none, None).count() == 0


def test_words_of_long_texts(monkeypatch):
    """Passes of any size give the same words, also for words that are longer than a pass."""
    r = random.Random(1)
    texts = ["".join(r.choice("ab é\n\tßz_9.") for _ in range(r.randrange(90))) for _ in range(200)] + ["x" * 90 + " " + "y" * 300, None, ""]
    for words, code in ((hashing.byte_words, lambda t: t and t.encode()), (hashing.char_words, lambda t: t)):
        whole = [w.tolist() for _, each in words([code(t) for t in texts]) for w in each]
        for size in (16, 40):
            monkeypatch.setattr(hashing, "PASS_CHARS", size)
            monkeypatch.setattr(hashing, "_POWERS", [])
            monkeypatch.setattr(hashing.passes, "__defaults__", (size,))
            assert [w.tolist() for _, each in words([code(t) for t in texts]) for w in each] == whole
            monkeypatch.undo()


def test_token_offsets():
    bpe = byte_bpe.codec("byte_bpe_50k.tiktoken")
    texts = ["", "plain words, and more", "é中😀 \n x" * 50]
    for text, ids, ends in zip(texts, *bpe.encode(texts)):
        data = text.encode()
        assert bpe.decode(ids, ends) == data
        assert all(bpe.decode_span(ids, ends, a, a + 5) == data[a : a + 5] for a in range(len(data)))
    with pytest.raises(ValueError):
        bpe.decode(ids, ends + 1)


def test_wavelet_select():
    ids = np.random.default_rng(3).integers(0, 300, 9000).astype(np.uint32)
    m = token_output.WaveletMatrix.of(ids)
    for token in (0, 7, 299, 5000):
        assert (m.locate(token) == np.flatnonzero(ids == token)).all()


@pytest.mark.parametrize("widths", [(1, 1), (1, 2), (2, 1), (2, 2)])
def test_dates_are_permuted(widths):
    """Two dates of a format never share a pseudonym, and pseudonyms are of the format."""
    p = pii.Permuter(b"k")
    for either in (False, True):
        form = pii.date_format(*widths, either)
        values = [(y, a, b) for y in [*range(1895, 1910), 2000, 2099, 2100, 1, 9999] for a, b in form.pairs[pii.isleap(y)]]
        found = [form.permuted(p, b"x", *v) for v in values]
        assert len(set(found)) == len(values)
        assert all((a, b) in form.rank[pii.isleap(y)] and (y in pii.MODERN) == (v[0] in pii.MODERN) for v, (y, a, b) in zip(values, found))
    for text in ("born 1899-12-31.", "on 1/2/1985,", "14/02/2021 or 02/14/2021"):
        new = pii.pseudonymise(text, p)[0]
        assert new != text and len(new) == len(text) and [c.isdigit() for c in new] == [c.isdigit() for c in text]


def test_long_secrets():
    p = pii.Permuter(b"k")
    small = [np.array([a, b, c]) for a in range(3) for b in range(4) for c in range(5)]
    found = {tuple(p.digits(b"x", v, np.array([3, 4, 5]))) for v in small}
    assert len(found) == 60 and all((np.array(v) < [3, 4, 5]).all() for v in found)
    blob = "0af9" * 250_000
    new, spans = pii.pseudonymise(f"key {blob} end", p)
    assert spans == [("secret", 4, 1_000_000)] and len(new) == 1_000_008 and blob not in new


def similarity(a, b):
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common)


def test_near_passages(spark):
    """Edited passages: all that reach the similarity are found, but for a share below one in a hundred."""
    r = random.Random(5)
    items = [[f"w{r.randrange(3000)}" for _ in range(r.choice([30, 45, 60]))] for _ in range(40)]
    bench = spark.createDataFrame([(None if k == 0 else k, " ".join(w)) for k, w in enumerate(items)] + [(99, None), (98, " ")], "item_id long, text string")
    bag = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    docs, want = [], set()
    for i in range(1500):
        k = r.randrange(40)
        w = list(items[k])
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = "other"
        text = [f"v{r.randrange(999)}" for _ in range(20)]
        text[10:10] = w
        n = len(items[k])
        if max(similarity(bag(text[a : a + n]), bag(items[k])) for a in range(len(text) - n + 1)) >= 0.8:
            want.add((i, k or None))
        docs.append((i, " ".join(text)))
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_passages(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert found <= want and len(found) >= 0.99 * len(want) and (any(k is None for _, k in found))
    left = decontaminate.drop_contaminated(spark.createDataFrame([(1, " ".join(items[0]))], "doc_id long, text string"), bench)
    assert left.count() == 0


def test_letters():
    assert not any(map(lang_id.has_letter, ("", "12 ²½Ⅷ①_ -", "\u0301")))
    assert all(map(lang_id.has_letter, ("1a", "é", "中", "ª")))


def test_kept_by_rule(spark):
    words = "one two three four five six seven eight nine ten".split()
    bare = " ".join(words * 2) + " and more words that never see a mark"
    lines = {
        "prose": (CLEAN, True), "bare": (bare, False), "bar": ("Home | News | Sport | About us", False), "few bars": ("a | b and then some words follow, as it were, without another bar.", True),
        "loud": ("Buy now!! Best price!! Order today!!", False), "notice": ("Tous droits réservés.", False), "long mention": (CLEAN + " " + CLEAN + " The privacy policy of the state was new.", True),
    }
    rows = spark.createDataFrame([(k, t) for k, (t, _) in lines.items()], "k string, line string")
    assert {r.k: r.ok for r in rows.select("k", (~quality_rules.line_fails(F.col("line"))).alias("ok")).collect()} == {k: ok for k, (_, ok) in lines.items()}


def test_templates(spark):
    """Classes, their nesting and slots on a small host, against vectors counted by hand."""
    menu = "<ul class=menu2>" + "".join(f"<li><a href=#>L{k}</a></li>" for k in range(3)) + "</ul>"
    html = lambda k: (
        f"<body><div class=top>Our site</div>{menu}<div class=box><h2>Title {k}</h2>" + "".join(f"<p>Text {k}.{n}</p>" for n in range(k % 3 + 1)) + ("<div class=rare>Extra</div>" if k == 1 else "")
        + "</div><div class=end>Bye</div></body>"
    )
    pages = spark.createDataFrame([(k, f"http://h.x/{k}", html(k)) for k in range(6)], "page_id long, url string, html string")
    rows = pages.select(F.lit("h.x").alias("host"), F.col("page_id").alias("row"), "html")
    text = html_extract.deduce_templates(rows).first().template
    template = html_extract.read_template(text)
    page = html_extract.Page(html(0))
    by_name = {r: e[5] for r, e in page.roles.items()}
    own = {"".join(t): r for r, t in by_name.items() if t}
    body = page.order[0]
    vector = lambda r: template.class_of[r][0]
    assert vector(body) == vector(own["Our site"]) == vector(own["Bye"]) == vector(own["Title 0"]) != vector(own["Text 0.0"])
    assert template.class_of[own["Text 0.0"]][1] is not None and template.class_of[body][1] is None
    assert len(template.place) == 8 and template.fixed[own["Our site"]] and template.closed[own["L0L1L2"]] and not template.fixed[own["Title 0"]]
    found = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    for k in range(6):
        assert found[k].split("\n\n") == [f"Title {k}", *[f"Text {k}.{n}" for n in range(k % 3 + 1)], *["Extra"] * (k == 1)]
    swapped = "<body><div class=end>Bye</div><div class=box><p>T</p></div><div class=top>Our site</div></body>"
    assert not template.fits(html_extract.Page(swapped)) and template.fits(page)


def test_inline_site_parts(spark):
    page = (
        "<body><article><p>Text <span class='advert'>Buy now</span>on<button>Share</button><label>Your mail</label><select><option>One</select>"
        "<svg><text>x</text></svg>.</p><p class='share-price'>Price</p><p class='legal-text'>Law</p><div class='side-by-side'>Both</div>"
        "<div class='comment-list'>Nice</div><div class='ad-slot-3'>Buy</div></article></body>"
    )
    out = html_extract.extract(spark.createDataFrame([(1, "http://a/1", page)], "page_id long, url string, html string"))
    assert out.first().text == "Text on.\n\nPrice\n\nLaw\n\nBoth"


@pytest.mark.parametrize("name", sorted(set(queries.oracle_sql()) - {"op6_ngram_join"}))  # op6: see test_ngram_join
def test_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = queries.queries()[name](spark, SF)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(repr(tuple(r[n] for n in names)) for r in found.collect()) == sorted(map(repr, cursor.fetchall()))
