"""Templates of a site against a brute-force count of subtrees."""

import xml.etree.ElementTree as ET
from collections import defaultdict

import pytest

from tidemark.llm import html

INLINE = {"a", "b", "i"}
GENERIC = {"div", "section", "ul"}
PROSE = {"p", "h1", "li"}


def squeezed(t):
    return " ".join((t or "").split())


def whole(e):
    return (e.tag, tuple(sorted(e.attrib.items())), squeezed(e.text), tuple((whole(c), squeezed(c.tail)) for c in e))


def bare(e):
    kids = []
    for c in e:
        if c.tag not in INLINE and (not kids or kids[-1] != bare(c)):
            kids.append(bare(c))
    return (e.tag, e.get("class", ""), tuple(kids))


def counted(pages, least):
    """Counts of templates of each host, by comparing whole subtrees as trees."""
    seen = defaultdict(set)
    for host, source in pages:
        root = ET.fromstring(source)
        article = root.find(".//article")
        around = {e for e in root.iter() if article in list(e.iter())}
        inside = set(article.iter()) - {article}
        key = squeezed("".join(article.itertext()))
        for e in root.iter():
            if e in around or e.tag in INLINE or e.tag in ("html", "body") or not squeezed("".join(e.itertext())):
                continue
            if not (e in inside and e.tag in PROSE):
                seen[host, "w", whole(e)].add(key)
            if e not in inside and e.tag not in PROSE and (e.tag not in GENERIC or e.get("class")):
                seen[host, "b", bare(e)].add(key)
    return sorted((k[0], len(v)) for k, v in seen.items() if len(v) >= least)


def page(i, host):
    links = "".join(f"<li><a href='/{i}/{j}'>go {i * j}</a></li>" for j in range(3))
    box = "<div><p>Join us today</p></div>" if i % 2 else "<div><p>Write to us</p></div>"
    return f"<html><body><nav><ul>{links}</ul></nav><div class='promo'><p>buy {i}</p></div><article><h1>T</h1><p>story {i // 2} of {host}</p>{box}<p>end {i // 2}</p></article><div><p>{i % 3} left</p></div><footer>made {i}</footer></body></html>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(n * 100 + i, f"http://{h}/{i}", page(i, h)) for n, h in enumerate(("a.example", "b.example", "few.example")) for i in range(24 if n < 2 else 3)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def test_like_brute_force(pages):
    rows, df = pages
    want = counted([(u.split("/")[2], h) for _, u, h in rows], 5)
    assert sorted((r["host"], r["n_pages"]) for r in html.site_templates(df, 5).collect()) == want and len(want) > 10


def test_templates_do_the_work(pages):
    rows, df = pages
    got = {r["page_id"]: r for r in html.extract_main_text(df).collect()}
    for i, u, _ in rows:
        host, k = u.split("/")[2], int(u.split("/")[3])
        box = "" if host != "few.example" else "Join us today " if k % 2 else "Write to us "
        assert got[i]["text"] == f"T story {k // 2} of {host} {box}end {k // 2}"
        assert (got[i]["template_chars"] > got[i]["furniture_chars"]) == (host != "few.example")
    # without templates, names leave the repeated box in; without names, templates alone take menus and adverts off
    off = {r["page_id"]: r["text"] for r in html.extract_main_text(df, min_pages=10**9).collect()}
    assert sum(off[i] != got[i]["text"] for i in off) == 48
    alone = {r["page_id"]: r["text"] for r in html.extract_main_text(df, names=False).collect()}
    assert all("buy" not in alone[i] and "go" not in alone[i] and "made" not in alone[i] for i, u, _ in rows if "few" not in u)


def test_many_templates(pages, monkeypatch):
    """Beyond the bound, templates are joined with subtrees; the result is the same."""
    _, df = pages
    near = sorted(map(str, html.extract_main_text(df).collect()))
    monkeypatch.setattr(html, "SEND_TEMPLATES", 0)
    assert sorted(map(str, html.extract_main_text(df).collect())) == near


def test_one_title(spark):
    box = "<div><p>Join 5000 readers of this site</p></div>"
    df = spark.createDataFrame([(i, "http://one.example/", f"<title>Same</title><article>{box}<p>text number {i}</p></article>") for i in range(6)], "page_id long, url string, html string")
    assert {r["text"] for r in html.extract_main_text(df).collect()} == {f"text number {i}" for i in range(6)}


@pytest.mark.parametrize("source,text", [("foo<img src=x>bar <input>baz", "foobar baz"), ("AT&am<b>p;</b>T", "AT&amp;T"), ("a&lt;b <p>&amp;amp;", "a<b &amp;"), ("x<svg><title>t</title></svg>y", "xy")])
def test_inline_and_references(source, text):
    p = html.Page(source)
    assert p.text(*p.layout()) == text
