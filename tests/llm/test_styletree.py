import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from paperlane.llm import styletree as T
from paperlane.llm.stored import settle

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


def brute(pages, threshold=T.THRESHOLD):
    """Style trees as nested dictionaries: [(page_id, text)] with noisy branches out."""
    trees, parsed = {}, []
    for page_id, url, source in pages:
        host = url.split("://")[1].split("/")[0].split("?")[0].split("#")[0].lower()
        root = T.parse(source)
        parsed.append((page_id, host, root))

        def merge(node, site, page):
            site.setdefault("pages", set()).add(page)
            if node.text is not None:
                for f in node.features:
                    counts = site.setdefault("features", {}).setdefault(f, {})
                    counts[page] = counts.get(page, 0) + 1
                return
            style = site.setdefault("styles", {}).setdefault(tuple(c.sign for c in node.children), {"pages": set(), "parts": [{} for _ in node.children]})
            style["pages"].add(page)
            for c, s in zip(node.children, style["parts"], strict=True):
                merge(c, s, page)

        merge(root, trees.setdefault(host, {}), len(parsed))

    def entropy(counts, m):
        total = sum(counts)
        return -sum(c / total * math.log(c / total) for c in counts) / math.log(m)

    def weigh(site):
        m = len(site["pages"])
        kids = [weigh(s) for style in site.get("styles", {}).values() for s in style["parts"]]
        if m == 1:
            comp = 1.0
        elif "features" in site:
            comp = 1 - sum(entropy(c.values(), m) for c in site["features"].values()) / len(site["features"])
        else:
            styles = site["styles"].values()
            damp = T.ATTENUATION ** len(styles)
            mean = sum(len(s["pages"]) / m * (sum(p["comp"] for p in s["parts"]) / len(s["parts"]) if s["parts"] else 0) for s in styles)
            comp = (1 - damp) * entropy([len(s["pages"]) for s in styles], m) + damp * mean
        site["comp"] = comp
        site["top"] = max([comp, *kids])
        return site["top"]

    for site in trees.values():
        weigh(site)

    def leaves(node, site):
        if site["top"] < threshold:
            return
        if node.text is not None:
            yield node.text
            return
        style = site["styles"][tuple(c.sign for c in node.children)]
        for c, s in zip(node.children, style["parts"], strict=True):
            yield from leaves(c, s)

    return {page_id: " ".join(" ".join(leaves(root, trees[host])).split()) for page_id, host, root in parsed}


def test_against_brute_force(spark):
    rows = duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall()
    want = brute(rows)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for send in (T.SEND_BYTES, 0):
        got = T.extract(pages, send=send).collect()
        assert {r.page_id: " ".join((r.text or "").split()) for r in got} == want
        assert sum(r.removed for r in got) > 0


def site(rng, k, n_sites=3):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    return f"http://h{k % n_sites}.example.org/{k}", prose, word


def test_boilerplate_goes_and_articles_stay(spark):
    rng = random.Random(7)
    rows, articles = [], {}
    for k in range(90):
        url, prose, _ = site(rng, k)
        body = [prose(12) for _ in range(rng.randint(1, 6))]
        articles[k] = body
        page = f"<html><body><nav><ul><li><a href=/>Home page</a><li>About us</ul></nav><div class=ad>Buy {k % 3} now.</div><article>{''.join(f'<p>{p}' for p in body)}</article><footer>All rights reserved.</footer></body></html>"
        rows.append((k, url, page))
    got = {r.page_id: r for r in T.extract(spark.createDataFrame(rows, PAGES)).collect()}
    for k, body in articles.items():
        assert got[k].text.split("\n") == body and got[k].removed >= 2


def test_parser_closes_what_html_leaves_open():
    root = T.parse("<body><p>one<p>two <b>bold<br>x</p>three<ul><li>a<li>b</ul><img src=i.png></bogus><script>var a='<p>';</script><!-- c --> tail &amp; < end")
    text, removed = T.visible(root, None, set())
    assert text == "one\ntwo bold x\nthree\na\nb\ntail & < end" and removed == 0
    assert [c.name for c in root.children[0].children] == ["p", "p", "#text", "ul", "img", "#text"]


def test_deep_and_broken_pages_stay_bounded():
    deep = T.parse("<div>" * 30000 + "deep <b>er</b>" + "</div>" * 30000)
    assert max(node.depth for node, *_ in T.nodes(deep, "h")) == T.MAX_DEPTH and T.visible(deep, "h", set()) == ("deep er", 0)
    assert T.visible(T.parse("<" * 50000 + "<!--" * 50000), None, set())[0] == "<" * 50000


@pytest.mark.parametrize("send", [T.SEND_BYTES, 0])
def test_edges_of_data(spark, send):
    deep = "<div>" * 8 + "deep" + "</div>" * 8
    rows = [(1, None, "<p>no host</p>"), (1, None, "<p>no host</p>"), (2, "http://a.example/x", None), (3, "http://a.example/y", ""), (None, "http://a.example/z", "<p>only here</p>"), (4, "relative/path", "<p>no host</p>"), (5, "http://b.example", deep), (6, "http://B.example/2", deep), (7, "http://c.example", "<" * 50000 + "<!--" * 50000), (8, "http://c.example", "<p>" + "word " * 200000), (9, "http://d.example", "plain"), (10, "http://d.example", "plain")]
    pages = spark.createDataFrame(rows, PAGES)
    for p in (pages, pages.selectExpr("*", "1 AS host", "2 AS key", "3 AS noise", "4 AS row", "5 AS text")):
        got = [(r.page_id, r.text, r.removed) for r in T.extract(p, send=send).collect()]
        assert len(got) == len(rows)
        by = {g[0]: g for g in got}
        assert by[1][1:] == by[4][1:] == ("no host", 0) and by[2][1:] == (None, 0) and by[3][1:] == ("", 0) and by[None][1] == "only here"
        assert by[5][1:] == by[6][1:] == by[9][1:] == by[10][1:] == ("", 1)
        assert by[8][1] == " ".join(["word"] * 200000)
    assert T.extract(pages.limit(0), send=send).count() == 0
    one = settle(spark, T.site_nodes(pages.select("html", T.host_of(F.col("url")).alias("host"))), "test")
    assert one.filter("m < 2").count() == 0
