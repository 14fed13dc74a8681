"""The training-data operators against brute force on small tables."""

import hashlib
import html as markup
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillion.llm import byte_bpe, decontaminate, html_extract, lang_id, ngram_join, pii, quality_rules, token_output, url_filter, warc
from quillion.llm.common import table

SF = "/root/testdata/sf0.001"
ODD = ["", None, " \n\t ", "a", "A a", "one two three", "x" * 9000, "word " * 3000, "é " * 50, "don't 'tis 're ''s\u00a0\u2028x", "İ<|endoftext|>!"]


@pytest.fixture(scope="module")
def docs(spark):
    """Whole documents, odd texts, repeated rows, a null id and a column that clashes."""
    base = table(spark, SF, "documents").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10_000 + i, t, None) for i, t in enumerate(ODD)] + [(10_005, "one two three", None), (None, "no id here at all", None)], "doc_id long, text string, lang string")
    return base.unionByName(odd).withColumn("kept", F.lit("x")).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def by_id(found):
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_quality(docs, rows):
    found = quality_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for i, t in rows:
        w, t = split(t), t or ""
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {p for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        lines = [x for x in t.split("\n") if split(x)]
        n, r = len(w), len(covered)
        want.append((i, n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n))
    assert by_id(found) == sorted(want, key=str)


def test_quality_lines(spark):
    good = "This is a sentence of some words that a reader may read.\n" * 1 + "Another one follows here and says something else to them all."
    texts = [good, good + "\nLicensed under the MIT License.", "Home | News | Sport | About | Contact\n" * 9 + good]
    out = [r.clean_text for r in quality_rules.judge(spark.createDataFrame([(t,) for t in texts], "text string")).collect()]
    assert out == [good] * 3
    kept = quality_rules.keep_documents(spark.createDataFrame([(t, len(t)) for t in texts], "text string, n_chars long")).collect()
    assert [tuple(r) for r in kept] == [(good, len(good))] * 2


def test_urls(spark):
    rules = [(a, h + p, h, p) for a, h, p in url_filter.DEFAULT_RULES]
    urls = [None, "", "x", "http://", "http://ORG", "http://a.org/", "https://Example.org/es/x?y", "http://b.example.org/en/12#z", "http://x.com/fr/1", "http://com/de/", "http://notexample.org/es/",
            "http://a.b/c://d.org/", "http://adult-x.example.net/en", "http://example.org/es/", "http://x.example.org/en/1", "http://a.org/x", "http://a.org/x", "ftp://é.com/de/\n?"]
    found = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(1)), url_filter.rule_table(spark))
    want = []
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(len(r), r, a) for a, r, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        want.append((i, host, path, rule, verdict))
    assert by_id(found) == sorted(want, key=str)
    assert url_filter.judge_urls(table(spark, SF, "pages").limit(0), url_filter.rule_table(spark)).count() == 0


def test_byte_bpe(docs, rows):
    import base64

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    noise = ["".join(r.choice(list(" \n\t'strevlmd1é!*　“中😀\u0301")) for _ in range(r.randint(0, 40))) for _ in range(500)]
    assert [x.tolist() for x in byte_bpe.codec("byte_bpe_50k.tiktoken").encode(noise)[0]] == [known.encode_ordinary(t) for t in noise]
    found = byte_bpe.decode_ids(byte_bpe.encode_texts(docs.select("doc_id", "text"))).select("doc_id", "n_tokens", F.sha2("ids", 256), F.sha2("decoded", 256))
    want = []
    for i, t in rows:
        ids = known.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert by_id(found) == sorted(want, key=str)


def test_token_shards(spark, docs, rows):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    some = [(i, t) for i, t in rows if i is not None and i != 10_005]
    found = token_output.encode_table(docs.where("doc_id IS NOT NULL AND doc_id != 10005")).select("doc_id", "start", "n_tokens", F.crc32("ids"))
    want, start = [], 0
    for i, t in sorted(some):
        ids = [*known.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert by_id(found) == sorted(want, key=str)
    assert token_output.encode_table(docs.limit(0)).count() == 0
    r = random.Random(7)
    letters = [*"abcXYZ019 \n\t'!,.<|>%é\u0301ßıİſK中\u3000\xa0😀≠’", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", " the "]
    noise = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(3000)]
    flat, sizes = token_output.encoder("word_bpe_49k.json").encode(noise, 2)
    want = [[*e.ids, 2] for e in known.encode_batch(noise, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == want


@pytest.mark.parametrize("n, top", [(0, 5), (1, 1), (700, 3), (5000, 49_000)])
def test_wavelet_matrix(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    m = token_output.WaveletMatrix.from_bytes(memoryview(token_output.WaveletMatrix.of(ids).to_bytes()))
    assert (m.decode() == ids).all()
    if n:
        at = np.array([0, n // 2, n - 1])
        token = int(ids[n // 2])
        assert (m.access(at) == ids[at]).all()
        assert m.count(token) == (ids == token).sum() and m.count(token, 1, n // 2) == (ids[1 : n // 2] == token).sum()
        assert (m.locate(token) == np.flatnonzero(ids == token)).all()


def test_warc(spark):
    long = "é<p>x\r\n\r\nWARC/1.1\r\n" * 4000
    pages = [(1, "u", None), (2, "u", "x" * 99), (3, None, "x" * 99), (7, "u", "y" * 100), (5, "u\r\nv", "y" * 100), (9, "u", "y" * 100), (4, "u", long), (8, "u", long), (5, "u", "y" * 100)]
    found = warc.archive_table(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("key", F.lit(0)))
    rows = [(r.key, r.payload_bytes, r.record_type, r.refers_to, r.complete, bytes(r.payload).decode() if r.payload is not None else None) for r in found.collect()]
    size = len(long.encode())
    want = [(1, 0, "response", None, True, ""), (2, 99, "response", None, True, "x" * 99), (3, 99, "response", None, True, "x" * 99), (5, 100, "response", None, True, "y" * 100), (5, 100, "response", None, True, "y" * 100),
            (7, 100, "revisit", 5, True, None), (9, 100, "revisit", 5, True, None), (4, size, "response", None, True, long), (8, size, "revisit", 4, True, None)]
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_warc_incomplete():
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    assert warc.http_payload(head + b"3;x=y\r\nabc\r\n2\r\nde\r\n0\r\n\r\n") == b"abcde"


def test_warc_malformed(spark, tmp_path):
    """What can't be read is an incomplete record, and reading goes on."""
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    for body in (b"", b"3\r\nab", b"3\r\nabc", b"zz\r\nabc\r\n0\r\n\r\n", b"-1\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"5\r\nab\r\n0\r\n\r\n"):
        assert warc.http_payload(head + body) is None
    assert warc.http_payload(head + b"0\r\n\r\n") == b"" and warc.http_payload(b"HTTP/1.1 200 OK\r\n\r\nabc") == b"abc"

    def record(key, block, kind="response", more="", length=None):
        length = len(block) if length is None else length
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{key}>\r\nWARC-Page-Key: {key}\r\n{more}Content-Length: {length}\r\n\r\n".encode() + block + b"\r\n\r\n"

    ok = head + b"2\r\nok\r\n0\r\n\r\n"
    part = lambda n, of, block, total="": record(f"{of}{n}", block, "response" if n == 1 else "continuation", f"WARC-Segment-Number: {n}\r\nWARC-Segment-Origin-ID: <{of}1>\r\n" + total)
    data = (
        record(1, ok) + record(2, ok, length="many") + record(3, head + b"9\r\nok\r\n0\r\n\r\n") + record(4, ok)
        + part(2, 5, ok[20:], f"WARC-Segment-Total-Length: {len(ok)}\r\n") + part(1, 5, ok[:20])  # whole, in the wrong order
        + part(1, 6, ok[:20]) + part(3, 6, ok[20:], f"WARC-Segment-Total-Length: {len(ok)}\r\n")  # the second is missing
        + part(1, 7, ok[:20]) + part(2, 7, ok[20:], "WARC-Segment-Total-Length: 7\r\n")
        + record(8, ok)[:-30]
    )
    (tmp_path / "a.warc").write_bytes(data)
    found = {r.record_id: (r.complete, r.payload) for r in warc.read_archives(spark, f"file://{tmp_path}").collect()}
    good, bad = (True, b"ok"), (False, None)
    assert found == {"<1>": good, "<2>": bad, "<3>": bad, "<4>": good, "<51>": good, "<61>": bad, "<71>": bad, "<8>": bad}


def clusters(rows, n, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = [0] * len(rows)
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and min(len(sets[a]), len(sets[b])) * 100 >= max(len(sets[a]), len(sets[b])) * percent:
                parent[find(a)] = find(b)
                links[a], links[b] = links[a] + 1, links[b] + 1
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s), least.get(find(k)) if s else i, links[k]) for k, ((i, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_ngram_join(docs, rows, n, percent):
    want = sorted(clusters(rows, n, percent), key=str)
    assert by_id(ngram_join.link_components(docs, n, percent, links=True)) == want
    assert ngram_join.link_components(docs.limit(0), n, percent, links=True).count() == 0


def test_ngram_join_chain(spark, monkeypatch):
    """Near copies of one text, each linked with some of the others, dealt into several blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 40)
    monkeypatch.setattr(ngram_join, "GROUPS_PER_TASK", 8)
    r = random.Random(3)
    base = [f"w{r.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"v{r.randrange(99)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(ngram_join.link_components(docs, 4, 85, links=True)) == sorted(clusters(rows, 4, 85), key=str)


def test_decontaminate(spark, docs):
    bench = table(spark, SF, "benchmark")
    items = {r.item_id: r.text for r in bench.collect()}
    some = sorted(items)[:6]
    planted = [(20_000 + k, f"before words here {items[i].upper()} and after.") for k, i in enumerate(some)] + [(30_000, " ".join(items[some[0]].split()[: len(items[some[0]].split()) // 2]))]
    found = decontaminate.find_passages(spark.createDataFrame(planted, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found if r.similarity == 1} >= {(20_000 + k, i) for k, i in enumerate(some)}
    assert not [r for r in found if r.doc_id == 30_000]
    plain = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if f" {plain(t)} " in f" {plain(r.text)} "}
    got = decontaminate.find_passages(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.similarity == 1} == want
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - len({r.doc_id for r in got})
    assert decontaminate.find_passages(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("n", [2, 3, 10, 97, 1000])
def test_permutation(n):
    p = pii.Permuter(b"k")
    assert sorted(p.number(b"x", v, n) for v in range(n)) == list(range(n))


def test_pii(spark):
    p = pii.Permuter(b"k")
    text = "a.b7@mail.example.com 97.51.17.173 +1 (017) 555-7713 4539 1488 0343 6467 9807915762804490 2021-03-05 123-45-6789 DE89 3704 0044 0532 0130 00 " + "0af" * 14
    new, spans = pii.pseudonymise(text, p)
    assert [k for k, *_ in spans] == ["email", "ip", "phone", "card", "number", "date", "ssn", "iban", "secret"]
    assert not any(text[a : a + n] in new for _, a, n in spans)
    card = re.search(r"(?<![-\d])\d{4} \d{4} \d{4} \d{4}", new)[0].replace(" ", "")
    assert pii.luhn_sum(card) % 10 == 0
    assert pii.pseudonymise(text, p)[0] == new != pii.pseudonymise(text, pii.Permuter(b"other"))[0]
    clean = "Version 2.0, 4.0. 3. on page 12 (1) at 10:30, 999.1.1.1 and 1.2.3.4.5, 2021-13-45"
    assert pii.pseudonymise(clean, p) == (clean, [])
    out = pii.pseudonymise_texts(spark.createDataFrame([(None,), ("",)], "text string")).collect()
    assert [tuple(r) for r in out] == [(None, []), ("", [])]


def test_html(spark):
    pages = table(spark, SF, "pages")
    found = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(</article>|<footer|$)", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", markup.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h\d)[^>]*>", inside)]
        assert found[r.page_id] == "\n\n".join(b for b in blocks if b)


def test_html_site_parts(spark):
    page = (
        "<html><head><title>T</title></head><body><header><h1>Site</h1></header><div class='cookie-notice'>We use</div><nav><a>m</a></nav>"
        "<article><h1>Head &amp; more</h1><p>One<br>two <i>three</i><p>Four</p><div class=ad>Buy</div><form><input>Send</form>"
        "<section class='comments'><p>Nice</p></section><script>var a='</p>'</script><!-- x --><ul><li>L1<li>L2</ul></article><aside>S</aside><footer>F"
    )
    rows = [(1, "http://h/1", page), (2, None, None), (3, "x", ""), (4, "http://h/4", "<p>plain"), (5, "http://h/5", "<div>a<!-- open"), (6, "http://h/6", "no markup < 3")]
    found = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {1: "Head & more\n\nOne two three\n\nFour\n\nL1\n\nL2", 2: "", 3: "", 4: "plain", 5: "a", 6: "no markup < 3"}


def test_html_template(spark):
    """Without an article element, what is the same on all pages of a host is the site's."""
    rows = [(k, f"http://h.x/{k}", f"<body><div class=top>Our site</div><div class=body><p>Text number {k}.</p></div><div class=end>Bye</div></body>") for k in range(5)]
    found = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {k: f"Text number {k}." for k in range(5)}


def test_html_keeps_article_text(spark):
    """Copies of one page, and sections of an article whose ids or classes hold a word of site parts."""
    copy = "<body><article><h1>A copied page</h1><h2>Only here</h2><p class=lead>The same words.</p><p>And more.</p></article></body>"
    rows = [(k, f"http://c.x/{k}", copy) for k in range(6)]
    rows += [(k, f"http://c.x/{k}", f"<body><article><p>Another text {k}.</p></article></body>") for k in range(6, 9)]
    plain = "<body><div class=post><h2>Only here</h2><div class=lead>The same words.</div></div></body>"
    rows += [(k, f"http://d.x/{k}", plain) for k in range(10, 16)] + [(k, f"http://d.x/{k}", f"<body><div class=post><p>Another text {k}.</p></div></body>") for k in range(16, 19)]
    parts = "<h2 id='discussion'>Discussion</h2><section id='legal-background'><p>Law</p></section><div class='social-history'>Past</div><div class='ad'>Buy</div>"
    rows.append((20, "http://e.x/1", f"<body><article class='post no-comments'>{parts}</article></body>"))
    found = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[k] == "A copied page\n\nOnly here\n\nThe same words.\n\nAnd more." for k in range(6))
    assert all(found[k] == "Only here\n\nThe same words." for k in range(10, 16))
    assert all(found[k] == f"Another text {k}." for k in (6, 7, 8, 16, 17, 18))
    assert found[20] == "Discussion\n\nLaw\n\nPast"


def test_language(spark, docs):
    base = table(spark, "/root/testdata/sf0.01", "documents")
    net = lang_id.train(base, docs_per_lang=60)
    found = lang_id.identify(base, net).join(base.select("doc_id", "lang"), "doc_id").where(lang_id.held_out(F.col("doc_id")))
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    odd = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.identify(docs.where("doc_id >= 10000"), net).collect()}
    assert odd[10_000] == odd[10_001] == odd[10_002] == ("und", 0.0) and odd[10_007][0] in net.classes
    assert lang_id.train(base.limit(0)) is None
    assert {r.lang_pred for r in lang_id.identify(docs, None).collect()} == {"und"}


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    docs = table(spark, SF, "documents")
    kept = quality_rules.keep_documents(docs)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    least = {i for i, _, c, _ in clusters(rows, 5, 80) if i == c}
    index = decontaminate.Benchmark([tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()], 80)
    rows = [(i, t) for i, t in rows if i in least]
    rows = [(i, t) for (i, t), found in zip(rows, index.matches([t for _, t in rows])) if not found]
    p, bpe = pii.Permuter(pii.DEFAULT_KEY), byte_bpe.codec("byte_bpe_50k.tiktoken")
    texts = {i: pii.pseudonymise(t, p)[0] for i, t in rows}
    assert {r.doc_id for r in out} == set(texts)
    for r in out:
        assert bpe.decode(np.frombuffer(r.ids, "<u4")).decode() == texts[r.doc_id]
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_near_duplicates_by_row(spark):
    """Rows that share an id are told apart; copies without an id are reduced to one."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(1, a, "p"), (2, a, "q"), (2, b, "q"), (3, c, "r"), (3, d, "r"), (None, a + " z", None), (None, "x " + c, None)]
    rows += [(None, " ".join(f"e{k}" for k in range(40)), None)] * 3 + [(4, b, "s"), (5, d, "t"), (5, d, "t"), (None, "", None), (None, None, None), (6, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = [(r.doc_id, (r.text or "")[:2]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert sorted(out, key=str) == sorted([(1, "a0"), (2, "b0"), (3, "c0"), (3, "d0"), (None, "e0"), (None, ""), (None, ""), (6, "")], key=str)
    twice = spark.createDataFrame([(7, a, "p")] * 3, "doc_id long, text string, source string")
    assert corpus_pipeline.near_duplicates(spark, twice, SF).count() == 1
