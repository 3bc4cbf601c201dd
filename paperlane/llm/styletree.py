"""HTML extraction through site style trees.

The DOMs of all pages of a host are merged: an element's children, by tag and
presentation attributes in order, are one *style* of it, and pages that agree
on a style share the elements below.  Texts and images are leaves; the
features of a text are its sentences.  With m the number of pages that have a
node, and logarithms to the base m,

* presentation: ``NodeImp(E) = -sum p_i log p_i`` over the shares of E's styles;
* content: ``CompImp(leaf) = 1 - mean H(a)`` over its features a, where H is
  the entropy of a's occurrences over pages (1: on every page, 0: on one);
* ``CompImp(E) = (1 - G**l) NodeImp(E) + G**l * sum p_i CompImp(S_i)`` for l
  styles, and CompImp of a style is the mean over its elements.

A node on one page has importance 1.  A branch of which every node's
importance is below ``threshold`` is noise; the largest such branches are
removed from each page and the text of the rest is returned.

Pages are parsed in one pass that adds up each task's nodes; one shuffle of
these sums by node and what is counted, added up before it, and one by node give
the tables of nodes that occur on several pages, and
importance climbs one level of depth at a time.  Where the noise is at most
``SEND_BYTES`` of 8-byte names it is sent to all tasks, beyond that each page
is joined with its own.

Defined results: a null ``html`` has a null text, an empty one an empty text.
Pages without a host (null or relative ``url``) are in no tree and lose
nothing.  Rows that repeat a ``page_id`` are pages of their own.  Elements
below ``MAX_DEPTH`` levels count as part of the one at that level, with their
texts as its leaves.
"""

from __future__ import annotations

import html
import math
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from paperlane.llm.stored import settle

THRESHOLD = 0.8
ATTENUATION = 0.9
MAX_DEPTH = 64
SEND_BYTES = 64 << 20

_PART = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(script|style|noscript|template|svg|head)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PRESENTATION = {"class", "style", "align", "bgcolor", "color", "width", "height", "role"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)} | dict.fromkeys(_CLOSES_P, ("p",))
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "del", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var"}
_SENTENCE = re.compile(r"(?<=[.!?。])\s+")
_SPACES = re.compile(r"\s+")


class Node:
    """An element with its children, or a leaf with its text; an image is a leaf with an empty text."""

    __slots__ = ("children", "depth", "features", "name", "sign", "text")

    def __init__(self, name: str, sign: str, depth: int, text: str | None = None, features: list[str] | None = None) -> None:
        self.name, self.sign, self.depth, self.text, self.features = name, sign, depth, text, features
        self.children: list[Node] = []


def parse(source: str) -> Node:
    """The tree of a page without empty branches; what HTML leaves open is closed as browsers do."""
    root = Node("", "", 0)
    stack, opened = [root], {}

    def close(name: str) -> None:
        while True:
            top = stack.pop()
            opened[top.name] -= 1
            if top.name == name:
                return

    def add_text(raw: str) -> None:
        text = _SPACES.sub(" ", html.unescape(raw) if "&" in raw else raw).strip()
        if text:
            stack[-1].children.append(Node("#text", "#text", stack[-1].depth + 1, text, _SENTENCE.split(text)))

    last = 0
    for m in _PART.finditer(source):
        if m.start() > last:
            add_text(source[last : m.start()])
        last = m.end()
        name = m[3]
        if not name:
            continue
        name = name.lower()
        if m[2]:
            if opened.get(name):
                close(name)
            continue
        for other in _CLOSES.get(name, ()):
            if opened.get(other):
                close(other)
        if name in _VOID and name != "img":
            continue
        attributes = {a.lower(): x or y or z for a, x, y, z in _ATTRIBUTE.findall(m[4])} if m[4] else {}
        sign = name + "".join(f" {a}={attributes[a]}" for a in sorted(attributes.keys() & _PRESENTATION))
        depth = stack[-1].depth + 1
        if name == "img":
            stack[-1].children.append(Node(name, sign, depth, "", ["img " + attributes.get("src", "")]))
            continue
        if depth >= MAX_DEPTH:
            continue
        node = Node(name, sign, depth)
        stack[-1].children.append(node)
        if not m[4].endswith("/"):
            stack.append(node)
            opened[name] = opened.get(name, 0) + 1
    add_text(source[last:])
    order = [root]
    for node in order:
        order.extend(node.children)
    for node in reversed(order):
        node.children = [c for c in node.children if c.text is not None or c.children]
    return root


def _name(*parts: int | str) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts))) - (1 << 63)


def nodes(root: Node, host: str) -> Iterator[tuple[Node, int, int, int]]:
    """(node, its name in the host's tree, the name of the style above, of its own style), from the root down."""
    todo = [(root, _name("host", host), 0)]
    while todo:
        node, key, above = todo.pop()
        style = _name(key, "\x1e".join(c.sign for c in node.children)) if node.text is None else 0
        yield node, key, above, style
        todo.extend((c, _name(style, k), style) for k, c in enumerate(node.children))


def visible(root: Node, host: str | None, noise: set[int]) -> tuple[str, int]:
    """The text of a page without noisy branches, blocks in lines of their own; and the number of branches removed."""
    removed, parts = 0, []
    todo: list[tuple[Node | None, int]] = [(root, _name("host", host) if host else 0)]
    while todo:
        node, key = todo.pop()
        if node is None:
            parts.append("\n")
            continue
        if host and key in noise:
            removed += 1
            continue
        if node.text is not None:
            parts.append(node.text + " ")
            continue
        block = node.name not in _INLINE
        if block:
            parts.append("\n")
            todo.append((None, 0))
        style = _name(key, "\x1e".join(c.sign for c in node.children)) if host else 0
        todo.extend((c, _name(style, k) if host else 0) for k, c in reversed(list(enumerate(node.children))))
    lines = (_SPACES.sub(" ", line).strip() for line in "".join(parts).split("\n"))
    return "\n".join(filter(None, lines)), removed


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, null where there is none."""
    found = F.lower(F.regexp_extract(url.cast("string"), r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1))
    return F.when(found != "", found)


_SUMS = "key long, kind int, other long, depth int, n long, x double"


def _sums(pages: DataFrame) -> DataFrame:
    """Each task's sums: kind 0 is a node (other: the style above), 1 a style of it (other), 2 a feature of it (other; n and x: sum of c and c ln c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int, int, int], list[float]] = {}

        def flush() -> pa.RecordBatch:
            keys = list(zip(*seen.keys(), strict=True)) if seen else [[]] * 4
            n = [v[0] for v in seen.values()]
            x = [v[1] for v in seen.values()]
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int32())
            out = pa.RecordBatch.from_arrays([*(pa.array(k, t) for k, t in zip(keys, types, strict=True)), pa.array(n, pa.int64()), pa.array(x, pa.float64())], ["key", "kind", "other", "depth", "n", "x"])
            seen.clear()
            return out

        def count(key: tuple[int, int, int, int], n: int, x: float) -> None:
            at = seen.setdefault(key, [0, 0.0])
            at[0] += n
            at[1] += x

        for batch in batches:
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for node, key, above, style in nodes(parse(source), host):
                    count((key, 0, above, node.depth), 1, 0.0)
                    if node.text is None:
                        count((key, 1, style, node.depth), 1, 0.0)
                    else:
                        own: dict[str, int] = {}
                        for f in node.features:
                            own[f] = own.get(f, 0) + 1
                        for f, c in own.items():
                            count((key, 2, _name("feature", f), node.depth), c, c * math.log(c))
                if len(seen) > 200_000:
                    yield flush()
        yield flush()

    return pages.filter("host is not null and html is not null").select("host", "html").mapInArrow(run, _SUMS)


def site_nodes(pages: DataFrame) -> DataFrame:
    """Nodes on two pages or more: (key, above, depth, m, leaf, styles, once, imp).

    ``styles`` has the name and count of the styles on two pages or more,
    ``once`` the number of the others, ``imp`` the node importance of an
    element or the content importance of a leaf.
    """
    by_key = _sums(pages).groupBy("key", "kind", "other", "depth").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    kind = F.col("kind")
    m = F.sum(F.when(kind == 0, F.col("n")))
    spread = F.when((kind == 2) & (F.col("n") > 0), F.ln("n") - F.col("x") / F.col("n"))
    entropy = F.sum(F.when(kind == 1, F.col("n") * F.ln("n")))
    grouped = by_key.groupBy("key").agg(
        m.alias("m"),
        F.max("depth").alias("depth"),
        F.max(F.when(kind == 0, F.col("other"))).alias("above"),
        F.sum(spread).alias("spread"),
        F.count_if(kind == 2).alias("features"),
        F.count_if(kind == 1).alias("l"),
        F.count_if((kind == 1) & (F.col("n") == 1)).alias("once"),
        entropy.alias("nlogn"),
        F.collect_list(F.when((kind == 1) & (F.col("n") > 1), F.struct(F.col("other").alias("style"), F.col("n").alias("n")))).alias("styles"),
    )
    several = grouped.filter("m >= 2")
    log_m = F.ln("m")
    leaf = 1 - F.col("spread") / F.col("features") / log_m
    element = (log_m - F.col("nlogn") / F.col("m")) / log_m
    return several.select("key", "above", "depth", "m", (F.col("features") > 0).alias("leaf"), "l", "once", "styles", F.when(F.col("features") > 0, leaf).otherwise(element).alias("imp"))


def importances(several: DataFrame) -> DataFrame:
    """(key, above, styles, comp, top): composite importance, and the greatest in the branch; one settled level after the other."""
    spark = several.sparkSession
    deepest = several.agg(F.max("depth")).first()[0]
    done = None
    below = spark.createDataFrame([], "key long, above long, comp double, top double")
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        here = several.filter(F.col("depth") == depth)
        style = below.groupBy("above").agg(F.avg("comp").alias("s_comp"), F.max("top").alias("s_top"))
        at = here.filter("not leaf").select("key", F.explode("styles").alias("s")).select("key", F.col("s.style").alias("above"), F.col("s.n").alias("n"))
        mixed = at.join(style, "above").groupBy("key").agg(F.sum(F.col("n") * F.col("s_comp")).alias("weighted"), F.max("s_top").alias("s_top"))
        damp = F.pow(F.lit(ATTENUATION), F.col("l"))
        shares = (F.coalesce("weighted", F.lit(0.0)) + F.col("once")) / F.col("m")
        comp = F.when(F.col("leaf"), F.col("imp")).otherwise((1 - damp) * F.col("imp") + damp * shares)
        top = F.greatest(comp, F.coalesce("s_top", F.lit(0.0)), F.when(F.col("once") > 0, 1.0).otherwise(0.0))
        names = here.join(mixed, "key", "left").select("key", "above", "styles", comp.alias("comp"), top.alias("top"))
        below = settle(spark, names, f"level{depth}")
        done = below if done is None else done.unionByName(below)
    return done if done is not None else spark.createDataFrame([], "key long, above long, styles array<struct<style:long,n:long>>, comp double, top double")


def noise_of(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(key): the roots of the largest noisy branches of all hosts; ``pages`` has host and html."""
    spark = pages.sparkSession
    several = settle(spark, site_nodes(pages), "nodes")
    low = importances(several).filter(F.col("top") < threshold)
    inside = low.select(F.explode("styles.style").alias("above"))
    return settle(spark, low.select("key", "above").join(inside, "above", "left_anti").select("key"), "noise")


_OUT = "page_id long, host string, text string, removed int"


def _extracted(page_id: pa.Array, host: list, sources: list, noise_at) -> pa.RecordBatch:
    texts, removed = [], []
    for k, source in enumerate(sources):
        text, n = (None, 0) if source is None else visible(parse(source), host[k], noise_at(k))
        texts.append(text)
        removed.append(n)
    return pa.RecordBatch.from_arrays([page_id, pa.array(host, pa.string()), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], ["page_id", "host", "text", "removed"])


class Sorted:
    """Membership among sorted whole numbers of eight bytes each, which need no objects of their own."""

    def __init__(self, numbers: np.ndarray) -> None:
        self.numbers = array("q", np.sort(numbers).tobytes())

    def __contains__(self, number: int) -> bool:
        at = bisect_left(self.numbers, number)
        return at < len(self.numbers) and self.numbers[at] == number


def extract(pages: DataFrame, threshold: float = THRESHOLD, send: int = SEND_BYTES) -> DataFrame:
    """(page_id, host, text, removed): the text of every page without its noisy branches, and how many were removed."""
    spark = pages.sparkSession
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    noise = noise_of(source, threshold)
    if 8 * noise.count() <= send:
        names = spark.sparkContext.broadcast(noise.toArrow().column("key").to_numpy().astype(np.int64))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Sorted(names.value)
            for b in batches:
                yield _extracted(b.column("page_id"), b.column("host").to_pylist(), b.column("html").to_pylist(), lambda k: known)

        return source.mapInArrow(run, _OUT)
    return _joined(source, noise)


def _joined(source: DataFrame, noise: DataFrame) -> DataFrame:
    """The way for more noise than is sent to all tasks: each page's node names are joined with the noise."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, keys = [], []
            for r, host, text in zip(*(b.column(c).to_pylist() for c in ("row", "host", "html")), strict=True):
                for _, key, _, _ in nodes(parse(text), host):
                    row.append(r)
                    keys.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(keys, pa.int64())], ["row", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("noise").to_pylist()
            yield _extracted(b.column("page_id"), b.column("host").to_pylist(), b.column("html").to_pylist(), lambda k, own=own: set(own[k] or ()))

    kept = settle(source.sparkSession, source.withColumn("row", F.monotonically_increasing_id()), "pages")
    found = kept.filter("host is not null and html is not null").select("row", "host", "html").mapInArrow(name, "row long, key long")
    mine = found.join(noise, "key", "left_semi").groupBy("row").agg(F.collect_list("key").alias("noise"))
    return kept.join(mine, "row", "left").select("page_id", "host", "html", "noise").mapInArrow(run, _OUT)
