"""Main text of web pages by template deduction from same-host pages.

1. Tokens.  A page is read as a sequence of roles: paths of block elements, each with its
   first class or id.  A role's text is a token as well.
2. Occurrence vectors.  How often a role occurs on each page of its host is kept as a sum of
   hashes of (page, count), so equal sums mean equal vectors; sums, counts, places and least
   and greatest text hash are aggregated before the shuffle, and no host's pages ever meet
   in one task.
3. Equivalence classes.  Roles of one host with one vector form a class, if enough pages have
   it.  A role whose text is the same on all pages that have it shares its vector with that
   text, which is then the template's and no data; pages of the same text count as one.
4. Nesting.  Classes are put in page order, each into the slot of the class around it; roles
   of one vector in different slots are different classes.  A class is valid on a page if its
   roles come in the template's order; a page that breaks the outer class is read by a
   template of its own.
5. Slots.  What stands between the template's tokens are its slots, each named by the token
   around it.  A slot, with all that is nested in it, is closed if its tokens are marked as a
   part of the site (element, class, id, role) or, on hosts without articles, if it is mostly
   links; text of the template is no data.  Slots in an article (or main element) come alone
   where a page has any.  What remains is put out in page order, without inline parts that
   are marked as the site's.

A host with too few pages gives no vectors worth comparing: each of its pages is then its
own template.  Marks decide what a slot is for; the classes decide what the slots are.

Defined results: null or empty html gives an empty text; a null or odd URL counts as
host ''; broken markup (unclosed tags, comments, scripts, attributes) is read to the
end; repeated rows give repeated results; an empty table gives an empty result; only
key, url and html are read.
"""

from __future__ import annotations

import html as markup
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, rows_at_most, tidy

#: A class belongs to the template if at least so many pages, and this share of them, have it.
MIN_PAGES = 3
MIN_SHARE = 0.5
#: Slots with more than this share of their text in links belong to the site.
MAX_LINKS = 0.5
#: Hosts' templates are broadcast up to this many rows (under 10 kB each), else shuffled.
BROADCAST_HOSTS = 2_000
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|textarea|title|xmp)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs2>[^>]*+)(?:>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|(?P<text>[^<]++|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACE = re.compile(r"\s+")
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin a block of text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is not part of an article.
SITE_ELEMENTS = frozenset("head nav footer aside form menu button select option datalist dialog search svg object audio video canvas map label legend fieldset".split())
#: Words that mark a part of the site, as a whole class or role or with the words below around them.
SITE_WORDS = (
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo outbrain taboola menu nav navbar navigation "
    "breadcrumb breadcrumbs toolbar sidebar sidebars widget widgets cookie cookies gdpr popup modal newsletter subscribe subscription signup login "
    "comment comments commentlist respond disqus share sharing related recommended recommendations pagination pager contentinfo complementary"
).split()
#: Further such words outside of articles, where sections of a text are not named.
OUTER_SITE_WORDS = (
    "topbar masthead header footer copyright legal disclaimer notice notices alert alerts overlay consent social rail side aside search skip "
    "discussion reply replies stories promotion promoted"
).split()
#: What may stand before and after a site word in a compound name.
BEFORE_WORDS = "site page main global top bottom left right post entry article social more js the".split()
AFTER_WORDS = (
    "box bar block container wrapper wrap area list section sections panel slot unit item items link links button buttons banner form notice "
    "popup modal overlay widget consent signup thread posts articles stories top bottom left right inner outer menu nav icons"
).split()
#: Names of the element that holds a page's text.
MAIN_NAMES = frozenset("main main-content content-main article-body article-content post-body post-content entry-content".split())
P_CLOSERS = BLOCK - {"html", "body"}


def _compound(words: list[str]) -> re.Pattern:
    before, after = "|".join(BEFORE_WORDS), "|".join(AFTER_WORDS)
    return re.compile(rf"(?:(?:{before})[-_]+)*(?:{'|'.join(words)})(?:[-_]+(?:{after}|[0-9]+))*")


INNER_SITE = _compound(SITE_WORDS)
OUTER_SITE = _compound(SITE_WORDS + OUTER_SITE_WORDS)


@lru_cache(100_000)
def _is_site(name: str, in_article: bool) -> bool:
    return (INNER_SITE if in_article else OUTER_SITE).fullmatch(name) is not None


@lru_cache(100_000)
def _role(parent: int, tag: str, mark: str) -> int:
    return _hash(f"{parent}>{tag}.{mark}")


class Page:
    """Blocks of text of a page, and the roles of its elements."""

    def __init__(self, html: str):
        self.roles: dict[int, list] = {}  # role: parent, in article, site, count, first place, texts, link characters
        self.order: list[int] = []
        self.blocks: list[tuple[str, int, bool]] = []  # text, role, in article
        self.stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, role, in article, site
        self.links = self._linked = 0
        self._buffer: list[str] = []
        for m in TOKEN.finditer(html):
            if (text := m["text"]) is not None or (text := m["cdata"]) is not None:
                if not self.stack[-1][3]:  # of the site's parts nothing is kept
                    self._buffer.append(text)
                    self._linked += len(text) if self.links else 0
            elif tag := m["tag"] or m["tag2"]:
                if m["close"] or m["close2"]:
                    self._close(tag.lower())
                else:
                    self._open(tag.lower(), m["attrs"] or m["attrs2"] or "")
        self._flush()

    def _flush(self) -> None:
        if self._buffer:
            text = SPACE.sub(" ", markup.unescape("".join(self._buffer))).strip()
            self._buffer.clear()
            linked, self._linked = min(self._linked, len(text)), 0
            if text:
                _, role, article, _ = self.stack[-1]
                self.blocks.append((text, role, article))
                entry = self.roles.get(role)
                if entry and not article:  # an article's text is the page's own, however often it comes
                    entry[5].append(text)
                    entry[6] += linked

    def _open(self, tag: str, attrs: str) -> None:
        if tag in BLOCK:
            self._flush()
        if tag in VOID:
            if tag == "br" and not self.stack[-1][3]:
                self._buffer.append(" ")
            return
        if tag in P_CLOSERS and any(t == "p" for t, *_ in self.stack[-8:]):
            self._close("p")
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self._close_item(tag)
        _, role, article, site = self.stack[-1]
        mark, main, root = "", tag in ("article", "main"), tag in ("html", "body", "article", "main")
        if attrs:
            for name, *values in ATTRIBUTE.findall(attrs):
                name, value = name.lower(), next((v for v in values if v), "").lower()
                if name == "hidden" or (name == "aria-hidden" and value == "true"):
                    site = True
                    continue
                words = value.split()
                mark = mark or (words[0] if words else "")
                main = main or (tag in ("div", "section", "td") and not MAIN_NAMES.isdisjoint(words))
                if not root or (tag == "article" and article):
                    site = site or any(_is_site(w, article) for w in words if name != "id" or not article)
                elif tag == "article":  # an article of its own: a comment, a teaser
                    site = site or not {"comment", "comments", "reply", "related", "ad", "promo"}.isdisjoint(words)
        if tag in SITE_ELEMENTS or (tag == "header" and not article):
            site = True
        article = article or (main and not site)
        if tag in BLOCK:
            parent, role = role, _role(role, tag, mark)
            entry = self.roles.get(role)
            if entry is None:
                entry = self.roles[role] = [parent, article, site, 0, len(self.order), [], 0]
            entry[3] += 1
            self.order.append(role)
        if tag == "a":
            self.links += 1
        self.stack.append((tag, role, article, site))

    def _close_item(self, tag: str) -> None:
        stop = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}[tag]
        same = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
        for t, *_ in reversed(self.stack):
            if t in stop:
                return
            if t in same:
                self._close(t)
                return

    def _close(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                if any(t in BLOCK for t, *_ in self.stack[k:]):
                    self._flush()
                self.links -= sum(t == "a" for t, *_ in self.stack[k:])
                del self.stack[k:]
                return
            if tag not in BLOCK and self.stack[k][0] in BLOCK:
                return  # an inline end tag does not end a block

    def text(self) -> str:
        return "\n".join(t for t, *_ in self.blocks)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class Template:
    """Classes of roles, nested, and what each slot is for.

    ``tokens``: role, parent, vector, once (on each page that has it), closed (nothing in it
    is the page's), fixed (its text is the same on all pages), in page order.
    """

    def __init__(self, tokens: list[tuple[int, int, object, bool, bool, bool]]):
        self.place = {t[0]: k for k, t in enumerate(tokens)}
        parent = {t[0]: t[1] for t in tokens}
        vector = {t[0]: t[2] for t in tokens}
        members: dict[object, list[int]] = {}
        for t in tokens:
            members.setdefault(t[2], []).append(self.place[t[0]])
        self.class_of: dict[int, tuple] = {}  # a class: its vector, and the slot that it is nested in
        self.closed: dict[int, bool] = {}
        self.fixed: dict[int, bool] = {}
        for role, up, v, _, closed, fixed in tokens:
            self.closed[role] = closed or self.closed.get(up, False)
            self.fixed[role] = fixed
            while up in parent and vector[up] == v:
                up = parent[up]
            # Roles of one vector in different slots are different classes.
            slot = (self.class_of[up], bisect_left(members[vector[up]], self.place[role])) if up in self.class_of else None
            self.class_of[role] = (v, slot)
        once = [t[0] for t in tokens if t[3]]
        self.outer = {r: self.place[r] for r in once if self.class_of[r] == self.class_of[once[0]]}

    def fits(self, page: Page) -> bool:
        """Whether the outer class's tokens come in order on the page."""
        at = [self.outer[r] for r in page.order if r in self.outer]
        return all(a < b for a, b in zip(at, at[1:]))

    def extract(self, page: Page) -> str:
        """The text of the page's slots that are not closed, without the template's text."""
        kept = []
        for text, role, article in page.blocks:
            slot = role
            while slot in page.roles and slot not in self.place:
                slot = page.roles[slot][0]
            if article or not (self.closed.get(slot, False) or (slot == role and self.fixed.get(slot, False))):
                kept.append((text, article))
        inside = [t for t, article in kept if article]
        return "\n\n".join(inside or [t for t, _ in kept])


def page_template(page: Page) -> Template:
    """The template of a page that has no others to be compared with."""
    return Template([(role, e[0], e[3], e[3] == 1, e[2], False) for role, e in page.roles.items()])


@lru_cache(1_000)
def read_template(text: str) -> Template:
    """A template from the JSON rows that :func:`deduce_templates` makes."""
    return Template([(t["role"], t["parent"], (t["low"], t["high"]), t["once"], t["closed"], t["fixed"]) for t in json.loads(text)])


ROLE_SCHEMA = "host string, row bigint, role bigint, parent bigint, n bigint, place bigint, chars bigint, links bigint, text bigint, site boolean, article boolean, page bigint"


def _roles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [f.split() for f in ROLE_SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
    for whole in batches:
        for low in range(0, whole.num_rows, 256):  # bounds the rows held at once
            batch = whole.slice(low, 256)
            out: list[tuple] = []
            for host, row, html in zip(*(batch.column(k).to_pylist() for k in range(3))):
                page = Page(html or "")
                inside = any(a for *_, a in page.blocks)
                own = _hash(page.text())
                out.append((host, row, 0, 0, 1, -1, 0, 0, own, False, inside, own))
                for role, (parent, article, site, n, place, texts, links) in page.roles.items():
                    text = "\n".join(texts)
                    out.append((host, row, role, parent, n, place, len(text), links, _hash(text), site, article, own))
            columns = list(zip(*out)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[f for f, _ in fields])


def deduce_templates(pages: DataFrame) -> DataFrame:
    """One row per host: its template, as a JSON array of tokens in page order.

    ``pages`` has host, row and html, and is read once.  Counts of a role are aggregated
    before the shuffle; a host has at most about twice as many template tokens as a page
    has roles.
    """
    found = pages.select("host", "row", "html").mapInArrow(lambda b: tidy(_roles(b)), ROLE_SCHEMA)
    seen = F.xxhash64("row", "n")
    roles = found.groupBy("host", "role").agg(
        F.sum(seen.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftrightunsigned(seen, 32)).alias("high"),
        F.min("parent").alias("parent"), F.count("*").alias("pages"), F.max("n").alias("most"), F.avg("place").alias("place"),
        F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.min("text").alias("t0"), F.max("text").alias("t1"),
        F.approx_count_distinct("page").alias("texts"), F.max("site").alias("site"), F.max("article").alias("article"),
    )
    # The page itself is role 0: how many pages and texts there are, and whether any has an article.
    page = F.max_by(F.struct("pages", "texts", "article"), F.col("role") == 0).alias("page")
    tokens = F.collect_list(F.struct("place", "role", "parent", "low", "high", "pages", "texts", "most", "chars", "links", "t0", "t1", "site", "article"))
    hosts = roles.groupBy("host").agg(page, tokens.alias("tokens"))
    frequent = F.filter(
        "tokens",
        lambda t: (t["role"] != 0) & (t["texts"] >= MIN_PAGES) & (t["pages"] >= MIN_PAGES) & (t["pages"] >= F.col("page.pages") * MIN_SHARE),
    )

    def token(t):
        fixed = ~t["article"] & (t["t0"] == t["t1"]) & (t["chars"] > 0)
        linked = ~F.col("page.article") & (t["links"] > t["chars"] * MAX_LINKS)
        return F.struct(t["role"].alias("role"), t["parent"].alias("parent"), t["low"].alias("low"), t["high"].alias("high"), (t["most"] == 1).alias("once"), (t["site"] | linked).alias("closed"), fixed.alias("fixed"))

    hosts = hosts.select("host", F.transform(F.sort_array(frequent), token).alias("tokens")).where(F.size("tokens") > 0)
    return hosts.select("host", F.to_json("tokens").alias("template"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, url, pages, templates = batch.columns[:4]
        out = []
        for html, text in zip(pages.to_pylist(), templates.to_pylist()):
            page = Page(html or "")
            template = read_template(text) if text else None
            out.append((template if template and template.fits(page) else page_template(page)).extract(page))
        yield pa.RecordBatch.from_arrays([key, url, pa.array(out, pa.string())], names=["key", "url", "text"])


def extract(pages: DataFrame, key: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: key, url and the main text."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = ascii_lower(F.regexp_extract(url, r"^.*?://([^/?#]*)", 1))
    rows = pages.select(F.col(key).alias("key"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    templates = deduce_templates(rows.withColumn("row", F.xxhash64("key", "url", "html")))
    if rows_at_most(rows.select("host").distinct(), BROADCAST_HOSTS):
        templates = F.broadcast(templates)
    met = rows.join(templates, "host", "left").select("key", "url", "html", "template")
    return met.mapInArrow(lambda b: tidy(_texts(b)), f"key {dict(pages.dtypes)[key]}, url string, text string").select(F.col("key").alias(key), F.col("url").alias(url_col), "text")
