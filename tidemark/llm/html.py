"""Main text of web pages, with the templates of each site removed.

Every element subtree outside the main text's own prose is hashed, in two ways: with its
texts, for blocks that a site repeats word by word, and as a skeleton of names, classes
and ids without texts, for blocks that it fills anew on each page (menus, footers,
adverts).  Spark counts on how many pages of a host, told apart by what they say, a
subtree recurs, and those on ``min_pages`` or more are templates.  Extraction deletes
templates first; what is left of page furniture, on hosts with few pages above all, goes
by element names, roles and class names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import materialize

# Element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big button canvas cite code data del dfn em embed font i iframe img input ins kbd label map mark meter object output picture progress q rp rt ruby s samp select small span strike strong "
    "sub sup svg textarea time tt u var video wbr".split()
)
#: Elements that are never shown as text.
UNSEEN = frozenset("head script style title noscript template xmp noembed noframes iframe".split())
#: Elements that say nothing about their part in the page.
GENERIC = frozenset("div section ul ol dl table fieldset center span #root html body hgroup details".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th tr tbody thead tfoot figcaption caption summary address".split())
FURNITURE = frozenset("nav footer aside form script style head title noscript template svg canvas iframe object embed button select option textarea input dialog menu audio video map xmp noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or an id that mark page furniture.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promotion promoted cookie cookies consent gdpr notice notices banner popup modal overlay newsletter "
    "subscribe subscription share sharing social related recommended recommendations comment comments disqus respond replies sidebar menu nav navbar navigation navigator breadcrumb breadcrumbs footer "
    "masthead pagination pager toolbar login signup signin skip skiplink".split()
)
#: Words of a class or an id that mark the main part where no element name does.
MAIN = ("articlebody", "article", "post", "entry", "content", "main", "story")
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "tfoot": ("table",)}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Page:
    """A page's elements in the order in which they open, and its texts with their owners."""

    def __init__(self, source: str):
        self.source = source
        self.tag, self.parent, self.attrs = ["#root"], [-1], [{}]
        #: How many texts come before each element.
        self.place = [0]
        #: (element, text), character references decoded; None is a break between blocks.
        self.texts: list[tuple[int, str | None]] = []
        self._parse()
        self.texts = [(i, t and entities.unescape(t)) for i, t in self.texts]
        self.last = list(range(len(self.tag)))  # each element's last descendant
        for i in range(len(self.tag) - 1, 0, -1):
            self.last[self.parent[i]] = max(self.last[self.parent[i]], self.last[i])
        #: Elements outside the main text that hold what may be it: wrappers of the page.
        self.wraps = set()
        for i in range(1, len(self.tag)):
            if self.is_main(i) and not self.is_furniture(i):
                around, k = [], self.parent[i]
                while k > 0 and k not in self.wraps and not self.is_main(k):
                    around.append(k)
                    k = self.parent[k]
                if k <= 0 or k in self.wraps:
                    self.wraps.update(around)

    def _parse(self) -> None:
        source, open_, at = self.source, [0], 0

        def leave(to: int) -> None:
            while len(open_) > to:
                i = open_.pop()
                if self.tag[i] not in INLINE:
                    self.texts.append((self.parent[i], None))

        while at < len(source):
            m = TOKEN.search(source, at)
            if m is None:
                self.texts.append((open_[-1], source[at:]))
                break
            if m.start() > at:
                self.texts.append((open_[-1], source[at : m.start()]))
            at = m.end()
            if m[1]:
                name = m[1].lower()
                k = next((k for k in range(len(open_) - 1, 0, -1) if self.tag[open_[k]] == name), 0)
                # an inline end tag closes nothing beyond its block
                if k and not (name in INLINE and any(self.tag[j] not in INLINE for j in open_[k + 1 :])):
                    leave(k)
                continue
            name = (m[2] or m[4] or "").lower()
            if not name:
                if m[0].startswith("<![CDATA["):
                    self.texts.append((open_[-1], entities.escape(m[0][9:].removesuffix("]]>"))))
                continue
            if not m[0].endswith(">"):
                continue  # a tag that the page breaks off in
            if name in CLOSES_P:
                for k in range(len(open_) - 1, 0, -1):
                    if self.tag[open_[k]] == "p":
                        leave(k)
                        break
                    if self.tag[open_[k]] not in INLINE:
                        break
            if name in SIBLINGS:
                k = len(open_) - 1
                found = 0
                while k > 0 and self.tag[open_[k]] not in HOLDS.get(name, ()):
                    if self.tag[open_[k]] in SIBLINGS[name]:
                        found = k
                    k -= 1
                if found:
                    leave(found)
            i = len(self.tag)
            raw = (m[3] if m[2] else m[5]) or ""
            self.tag.append(name)
            self.parent.append(open_[-1])
            self.attrs.append({k.lower(): entities.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(raw)} if raw.strip(" /\n\t") else {})
            if name not in INLINE:
                self.texts.append((open_[-1], None))
            self.place.append(len(self.texts))
            if name in VOID or raw.endswith("/") and name not in RAW:
                continue
            open_.append(i)
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                if close is None:
                    close_at = at = len(source)
                else:
                    close_at, at = close.start(), close.end()
                if name == "title":
                    self.texts.append((i, source[m.end() : close_at]))
                leave(len(open_) - 1)
        leave(1)

    def words(self, i: int) -> set[str]:
        """The words of the element's class and id, in lower case."""
        a = self.attrs[i]
        return {w.lower() for w in WORDS.findall(f"{a.get('class', '')} {a.get('id', '')}")} if "class" in a or "id" in a else set()

    def is_main(self, i: int) -> bool:
        return self.tag[i] in ("article", "main") or self.attrs[i].get("role", "").lower() == "main"

    def is_furniture(self, i: int) -> bool:
        """Whether the element is furniture by itself; of one that wraps the main text, its class and a form say nothing."""
        tag, a = self.tag[i], self.attrs[i]
        if tag in FURNITURE and not (tag == "form" and i in self.wraps) or a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true":
            return True
        if "style" in a and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a["style"], re.I):
            return True
        if tag in ("html", "body", "main", "#root") or a.get("role", "").lower() == "main":
            return False
        if tag == "article" and not self.words(i) & {"comment", "comments", "ad", "advert", "related", "promo", "sponsored"}:
            return False
        if i in self.wraps:
            return False
        words = self.words(i)
        if words & MARKS:
            return True
        # a page's header goes, an article's own, with its heading, stays
        return (tag == "header" or "header" in words) and not (self.inside(i, ("article", "main")) or any(self.tag[j] in ("h1", "article", "main") for j in range(i + 1, self.last[i] + 1)) and tag != "header")

    def inside(self, i: int, tags: tuple[str, ...]) -> bool:
        i = self.parent[i]
        while i > 0:
            if self.tag[i] in tags:
                return True
            i = self.parent[i]
        return False

    def furniture(self) -> list[bool]:
        """For every element, whether it or one that holds it is page furniture."""
        out = [False]
        for i in range(1, len(self.tag)):
            out.append(out[self.parent[i]] or self.is_furniture(i))
        return out

    def main(self, gone: list[bool]) -> list[int]:
        """The outermost elements that hold the main text; none where nothing marks them."""
        for test in (lambda i: self.tag[i] == "article", lambda i: self.tag[i] == "main" or self.attrs[i].get("role") == "main"):
            found, until = [], -1
            for i in range(1, len(self.tag)):
                if i > until and not gone[i] and test(i):
                    found.append(i)
                    until = self.last[i]
            if found:
                return found
        for mark in MAIN:
            first = next((i for i in range(1, len(self.tag)) if not gone[i] and self.tag[i] in ("div", "section", "td") and mark in self.words(i)), None)
            if first is not None:
                return [first]
        return []

    def unseen(self) -> list[bool]:
        """For every element, whether it is never shown."""
        out = [False]
        for i in range(1, len(self.tag)):
            out.append(out[self.parent[i]] or self.tag[i] in UNSEEN)
        return out

    def sizes(self) -> list[int]:
        """The number of characters shown in each element."""
        unseen = self.unseen()
        out = [0] * len(self.tag)
        for i, t in self.texts:
            if t and not unseen[i]:
                out[i] += len(t.strip())
        for i in range(len(self.tag) - 1, 0, -1):
            out[self.parent[i]] += out[i]
        return out

    def bulk(self, sizes: list[int]) -> int:
        """The innermost element that, like all around it, holds more than half of the page's text."""
        i = 0
        while True:
            j, inner = i + 1, 0
            while j <= self.last[i]:
                if 2 * sizes[j] > sizes[0]:
                    inner = j
                    break
                j = self.last[j] + 1
            if not inner or self.tag[inner] in INLINE or self.tag[inner] in PROSE:
                return i
            i = inner

    def hashes(self) -> tuple[list[bytes], list[bytes]]:
        """Of each element's subtree, a digest with its texts and attributes, and one of its skeleton.

        A skeleton has names, words of classes and ids, and roles; inline elements and
        texts are left out, and a run of like children counts once.
        """
        flow: list[list] = [[] for _ in self.tag]
        at = 1
        opened = sorted(range(1, len(self.tag)), key=lambda i: self.place[i])
        for k, (i, t) in enumerate(self.texts):
            while at <= len(opened) and self.place[opened[at - 1]] <= k:
                flow[self.parent[opened[at - 1]]].append(opened[at - 1])
                at += 1
            if t and t.strip():
                flow[i].append(" ".join(t.split()))
        for j in opened[at - 1 :]:
            flow[self.parent[j]].append(j)
        whole, bare = [b""] * len(self.tag), [b""] * len(self.tag)
        for i in range(len(self.tag) - 1, -1, -1):
            attrs = ";".join(f"{k}={v}" for k, v in sorted(self.attrs[i].items()))
            own = xxhash.xxh3_64(f"{self.tag[i]} {attrs}".encode("utf-8", "surrogatepass"))
            frame = xxhash.xxh3_64(f"{self.tag[i]} {' '.join(sorted(self.words(i)))} {self.attrs[i].get('role', '')}".encode("utf-8", "surrogatepass"))
            last = b""
            for x in flow[i]:
                if isinstance(x, str):
                    own.update(b"t" + xxhash.xxh3_64_digest(x.encode("utf-8", "surrogatepass")))
                    continue
                own.update(b"e" + whole[x])
                if self.tag[x] not in INLINE and bare[x] != last:
                    last = bare[x]
                    frame.update(last)
            whole[i], bare[i] = own.digest(), frame.digest()
        return whole, bare

    def subtrees(self, main: list[int], host: str) -> list[tuple[int, int]]:
        """(element, hash for this host) of the subtrees that may be templates; an element may have two.

        Never one that holds the main text, and none within it but containers, no prose,
        with their texts.  Where nothing marks the main text, any element counts with its
        texts, and the bulk of the page stands for the main text where skeletons are
        concerned.  Skeletons count of elements with a name, class or id that tells them
        from others.
        """
        sizes, unseen = self.sizes(), self.unseen()
        held, within, bulk = [False] * len(self.tag), [False] * len(self.tag), main or [self.bulk(sizes)]
        for m in bulk:
            i = m
            while i > 0:
                held[i] = True
                i = self.parent[i]
            for i in range(m + 1, self.last[m] + 1):
                within[i] = True
        whole, bare = self.hashes()
        salt = xxhash.xxh3_64_digest(host.encode("utf-8", "surrogatepass"))
        out = []
        for i in range(1, len(self.tag)):
            tag = self.tag[i]
            if unseen[i] or not sizes[i] or tag in INLINE or tag in VOID or tag in ("html", "body"):
                continue
            if not main or not held[i] and not (within[i] and tag in PROSE):
                out.append((i, xxhash.xxh3_64_intdigest(salt + b"w" + whole[i]) - (1 << 63)))
            if not held[i] and not within[i] and tag not in PROSE and (tag not in GENERIC or self.words(i) or "role" in self.attrs[i]):
                out.append((i, xxhash.xxh3_64_intdigest(salt + b"b" + bare[i]) - (1 << 63)))
        return out

    def within(self, drop: set[int]) -> list[bool]:
        """For every element, whether it or one that holds it is among ``drop``."""
        out = [False]
        for i in range(1, len(self.tag)):
            out.append(out[self.parent[i]] or i in drop)
        return out

    def text(self, gone: list[bool], main: list[int], templates: set[int] | None = None, host: str = "") -> str:
        """Blocks of the main text, each with single spaces, joined by single spaces."""
        return self.parts(gone, main, templates, host)[0]

    def parts(self, gone: list[bool], main: list[int], templates: set[int] | None = None, host: str = "") -> tuple[str, int, int]:
        """The main text, and the characters of text that templates took off the page, and then names and the choice of the main part."""
        drop = self.within({i for i, h in self.subtrees(main, host) if h in templates} if templates else set())
        unseen = self.unseen()
        ranges = [(m, self.last[m]) for m in main] or [(0, len(self.tag))]

        def joined(keep) -> str:
            return " ".join("".join(" " if t is None else t for i, t in self.texts if (not gone[i] if t is None else keep(i))).split())

        text = joined(lambda i: not drop[i] and not gone[i] and not unseen[i] and any(a <= i <= b for a, b in ranges))
        left = len(joined(lambda i: not drop[i] and not unseen[i]))
        return text, (len(joined(lambda i: not unseen[i])) if templates else left) - left, left - len(text)

    def layout(self, names: bool = True) -> tuple[list[bool], list[int]]:
        """What is furniture and what the main part, by names; with ``names`` off, nothing is either."""
        gone = self.furniture() if names else [False] * len(self.tag)
        return gone, self.main(gone) if names else []


def _host(url: F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _page_key(page: Page) -> int:
    """What the page says, hashed: copies of a page count once, whatever their titles."""
    gone, main = page.layout()
    return xxhash.xxh3_64_intdigest(page.text(gone, main).encode("utf-8", "surrogatepass")) - (1 << 63)


def _subtree_rows(names: bool, keyed: bool):
    """``host, subtree, page`` of every page; ``page`` is the row's own key if it has one, else what the page says."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hosts, subtrees, keys = [], [], []
            for k, (host, source) in enumerate(zip(batch["host"], batch["html"], strict=True)):
                page = Page(source)
                found = {h for _, h in page.subtrees(page.layout(names)[1], host)}
                hosts += [host] * len(found)
                subtrees += found
                keys += [batch["key"].iloc[k] if keyed else _page_key(page)] * len(found)
            yield pd.DataFrame({"host": hosts, "subtree": np.array(subtrees, np.int64), "page": keys})

    return run


def _rows(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    return pages.select(_host(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html")).where("html is not null and html <> ''")


def site_templates(pages: DataFrame, min_pages: int = 5, url_col: str = "url", html_col: str = "html", names: bool = True) -> DataFrame:
    """``host, subtree, n_pages``: subtrees that recur on ``min_pages`` pages of a host or more, told apart by what they say.

    Copies of one page are one page, so that an article with many copies is no template.
    The number needed is the same on hosts of any size.
    """
    # distinct first, then counts: both are combined before the shuffle
    seen = _rows(pages, url_col, html_col).mapInPandas(_subtree_rows(names, False), "host string, subtree long, page long").distinct()
    return seen.groupBy("host", "subtree").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages)


#: Templates up to which their hashes are sent along with the tasks, 8 bytes each.
SEND_TEMPLATES = 2_000_000


def extract_main_text(pages: DataFrame, min_pages: int = 5, url_col: str = "url", html_col: str = "html", names: bool = True) -> DataFrame:
    """``pages`` without its html, with ``text, n_chars, template_chars, furniture_chars`` (these replace columns of that name).

    Templates are deleted first, and ``template_chars`` counts the characters that this
    takes off the page; ``furniture_chars`` counts those that element names, roles and
    class names take off what is left.  Without ``names`` templates alone are deleted.

    A page without an article, a main element or a class that says so gives the text of
    its whole body, less templates and furniture.  Null and empty html give an empty
    text.  A null or odd url puts the page under the host ``''``.  Broken markup is read
    as far as it goes: open elements end with the page.  Repeated rows stay.

    Hashes of templates are sent along with the tasks while they are few.  Beyond that
    the subtrees of pages are joined with them, and each page with those of its own;
    the result is the same.
    """
    found = materialize(site_templates(pages, min_pages, url_col, html_col, names), "templates")
    n = found.count()
    host, source = _host(F.col(url_col)), F.col(html_col).cast("string")
    known = set()
    if n <= SEND_TEMPLATES:
        known = pages.sparkSession.sparkContext.broadcast(found.select("subtree").toPandas()["subtree"].to_numpy(np.int64)) if n else None
        joined = pages.withColumn("__own", F.lit(None).cast("array<bigint>"))
    else:
        known = None
        key = F.md5(F.concat_ws("\n", host, source).cast("binary"))
        rows = pages.select(host.alias("host"), source.alias("html"), key.alias("key")).where("html is not null and html <> ''")
        parts = rows.mapInPandas(_subtree_rows(names, True), "host string, subtree long, page string").select("subtree", "page").distinct()
        own = parts.join(found.select("subtree"), "subtree", "left_semi").groupBy(F.col("page").alias("__key")).agg(F.collect_list("subtree").alias("__own"))
        joined = pages.withColumn("__key", key).join(own, "__key", "left").drop("__key")

    @F.pandas_udf("text string, template_chars long, furniture_chars long")
    def read(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        every = frozenset(known.value.tolist()) if known is not None else frozenset()
        for hosts, sources, owns in batches:
            out = []
            for host_, source_, own_ in zip(hosts, sources, owns, strict=True):
                page = Page(source_ or "")
                gone, main = page.layout(names)
                out.append(page.parts(gone, main, every if own_ is None else {int(x) for x in own_}, host_))
            yield pd.DataFrame(out, columns=["text", "template_chars", "furniture_chars"])

    out = joined.withColumn("__read", read(host, source, F.col("__own")))
    out = out.withColumns({c: F.col(f"__read.{c}") for c in ("text", "template_chars", "furniture_chars")})
    return out.withColumn("n_chars", F.char_length("text").cast("long")).drop("__own", "__read", *([] if html_col in ("text", "n_chars", "template_chars", "furniture_chars") else [html_col]))
