"""Main text of web pages by a site style tree.

All pages of a host are merged into one tree of styles: a node for each path of element names, classes, ids and roles.  A
node has the presentations (sequences of child elements) that its pages show, and the contents of its text blocks.  The
presentation importance of a node is the entropy of its presentations, its content importance one less the mean entropy
of its contents over the pages, both in units of the logarithm of its pages: what every page repeats is unimportant.  A
node weighs its presentation lightly and its contents heavily, and a branch is as important as the most important node
with text in it.  Branches below half of the importance of the host's best are cut from every page, and so are single
contents that nearly all pages of the host repeat, unless they make up much of a page (copies of one page).

A node on few pages says little.  So its importance is drawn towards that of the same path on all hosts, and that towards
a middle one.  Tags, and words of class, id and role, that mean furniture are prior knowledge: they multiply the
importance of a branch by a small factor, as adverts may well differ from page to page, and text outside of any article or
main part by a middling one.  On a host whose best branch is marked so too nothing follows from it.  What is never shown as text (scripts, styles, hidden elements) or is a control
goes by itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm._tables import stash, tune
from loomspark.llm.dom import INLINE, RAW, Node, blocks, parse

#: Weight of a node's contents, share of the best branch's importance below which a branch is cut, importance of a content that nearly all pages repeat, pages it needs, share of a page's text that may go as such.
GAMMA, LOW, REPEATED, PAGES, PART = 0.9, 0.5, 0.15, 3, 0.3
#: Pages for which the path on all hosts counts, and for which the middle importance counts; factors of what is marked as furniture, and of what is outside of articles and main parts.
POOLED, PLAIN, MIDDLE, MARKED, ELSEWHERE = 10, 3, 0.5, 0.1, 0.45
#: Levels of a path, and characters of an element's name in it; deeper elements share the path of that level.
DEEPEST, NAME = 64, 80
#: Cut paths and repeated contents (8 bytes each) up to which all tasks get them; pages of a host from which it is split for the join that takes their place.
BROADCAST, HOT = 500_000, 50_000
#: Elements that are never shown as text, or are controls.
OUTSIDE = RAW - {"xmp"} | frozenset("head noscript template form button select option input dialog svg canvas object video audio map fieldset datalist".split())
#: Elements that hold no article by their meaning, and words of classes, ids and roles that name page furniture.
ASIDE = frozenset("nav footer aside menu".split())
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar aside widget nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar comment comments disqus respond reply replies share sharing social "
    "related recommended newsletter subscribe signup login search pagination pager toc skip contentinfo complementary".split()
)
#: Words that may stand beside those without a meaning of their own.
PLACES = frozenset("site page main global top bottom left right primary secondary box bar wrap wrapper container inner area".split())

SCHEMA = "page_id long, url string, text string, n_chars long"


def host() -> Column:
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def hidden(node: Node) -> bool:
    """Whether the element is never shown as text, or is a control."""
    found = node.attributes
    if node.tag in OUTSIDE or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True
    style = found.get("style", "").replace(" ", "").lower()
    return "display:none" in style or "visibility:hidden" in style


def _names_furniture(words: Iterable[str]) -> bool:
    """Whether some word is made of nothing but furniture and places: "site-footer", but not "no-sidebar"."""
    for word in words:
        parts = set(re.split(r"[_-]+", word)) - PLACES
        if parts and parts <= FURNITURE:
            return True
    return False


@lru_cache(1 << 16)
def prior(path: str) -> float:
    """The factor of a path: MARKED within what its tags and words mark as furniture, else 1 within an article or main part.

    A header is furniture outside of an article or main part only.
    """
    inside = False
    for name in path.split("/")[1:]:
        tag, *words = name.split(".")
        if tag in ("html", "body"):
            continue
        if tag in ASIDE or _names_furniture(words) or tag == "header" and not inside:
            return MARKED
        inside |= tag in ("article", "main") or "main" in words
    return 1.0 if inside else ELSEWHERE


def path_key(path: str) -> int:
    """The hash by which tasks are told a path, as ``F.xxhash64`` gives it."""
    h = xxhash.xxh64_intdigest(path.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def content_key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def _name(node: Node) -> str:
    role = node.attributes.get("role", "").lower().split()
    return ".".join((node.tag, *sorted({*node.words, *role}))).replace("/", "_")[:NAME]


def paths_of(page: Node) -> dict[int, str]:
    """The path of every block element."""
    out, todo = {id(page): ""}, [(page, "", 0)]
    while todo:
        node, path, level = todo.pop()
        for child in node.children:
            if isinstance(child, Node) and child.tag not in INLINE:
                own = out[id(child)] = f"{path}/{_name(child)}" if level < DEEPEST else path
                todo.append((child, own, level + 1))
    return out


def observed(source: str) -> Iterator[tuple[str, str, int]]:
    """``(path, kind, value)`` of a page: "s" the hash of an element's children, "c" the hash of a block's text, once each."""
    page = parse(source)
    paths = paths_of(page)
    seen = set()
    todo = [page]
    while todo:
        node = todo.pop()
        inner = [c for c in node.children if isinstance(c, Node) and c.tag not in INLINE]
        if node is page or not hidden(node):
            seen.add((paths[id(node)], "s", content_key(" ".join(map(_name, inner)))))
            todo += inner
    for owner, text in blocks(page, hidden):
        seen.add((paths[id(owner)], "c", content_key(text)))
    yield from seen


def _nodes(seen: DataFrame, *key: str) -> DataFrame:
    """``m`` pages and ``own`` importance of every node, null on a single page, and whether it has text; ``seen`` has ``kind, value, n`` besides the key."""
    style, content = F.col("kind") == "s", F.col("kind") == "c"
    nodes = seen.groupBy(*key).agg(
        F.max("prior").alias("prior"),
        F.sum(F.when(style, F.col("n"))).alias("m"), F.sum(F.when(style, F.col("n") * F.log("n"))).alias("s_log"), F.sum(F.when(content, F.log("n"))).alias("c_log"), F.count(F.when(content, 1)).alias("c_n"),
    )
    unit = F.log("m")
    own = GAMMA * (1 - F.col("c_log") / F.col("c_n") / unit) + (1 - GAMMA) * (unit - F.col("s_log") / F.col("m")) / unit
    return nodes.select(*key, "prior", "m", (F.col("c_n") > 0).alias("has_text"), F.when((F.col("m") > 1) & (F.col("c_n") > 0), own).alias("own"))


def _drawn(own: Column, m: Column, to: Column, weight: Column) -> Column:
    """The importance measured on ``m`` pages (nothing can be measured on one) and a belief that counts as ``weight`` pages."""
    return (F.coalesce(own, F.lit(0.0)) * (m - 1) + to * weight) / (m - 1 + weight)


def observations(pages: DataFrame) -> DataFrame:
    """``host, path, prior, kind, value, n``: on how many pages of a host (``pages`` has host and html) a value is.

    They are summed within a batch, then by host, path and value, so a host with most of the pages is spread over its
    values.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for name, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.update((name, *x) for x in observed(source or ""))
            hosts, paths, kinds, values = zip(*found) if found else ((),) * 4
            columns = [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(list(map(prior, paths)), pa.float64()), pa.array(kinds, pa.string()), pa.array(values, pa.int64()), pa.array(list(found.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "path", "prior", "kind", "value", "n"])

    seen = pages.select("host", "html").mapInArrow(run, "host string, path string, prior double, kind string, value long, n long")
    return seen.groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("n"), F.max("prior").alias("prior"))


def branches(seen: DataFrame) -> DataFrame:
    """``host, path, importance`` of every branch with text: that of its most important node."""
    pooled = seen.groupBy("path", "kind", "value").agg(F.sum("n").alias("n"), F.max("prior").alias("prior"))
    pooled = _nodes(pooled, "path").where("has_text").select(F.col("path").alias("all_path"), _drawn(F.col("own"), F.col("m"), F.lit(MIDDLE), F.lit(PLAIN)).alias("belief"))
    nodes = _nodes(seen, "host", "path").where("has_text").join(pooled, F.col("path") == F.col("all_path"))
    nodes = nodes.select("host", "path", (F.col("prior") * _drawn(F.col("own"), F.col("m"), F.col("belief"), F.lit(POOLED))).alias("importance"))
    steps = F.split("path", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/")))
    return nodes.select("host", above.alias("path"), "importance").groupBy("host", "path").agg(F.max("importance").alias("importance"))


def _cuts(seen: DataFrame) -> DataFrame:
    """``host, what, key``: the low branches ("b") of every host, and its contents ("c") that nearly all pages repeat."""
    ranked = branches(seen)
    best = ranked.where("path = ''").select("host", F.col("importance").alias("best"))
    low = ranked.join(best, "host").where(F.col("importance") < LOW * F.col("best"))
    pages = seen.where("path = '' and kind = 's'").groupBy("host").agg(F.sum("n").alias("pages")).where(F.col("pages") >= PAGES)
    often = seen.where((F.col("kind") == "c") & (F.col("n") >= 2)).join(pages, "host").where(1 - F.log("n") / F.log("pages") < REPEATED)
    return low.select("host", F.lit("b").alias("what"), F.xxhash64("path").alias("key")).unionByName(often.select("host", F.lit("c").alias("what"), F.col("value").alias("key")).distinct())


def extract(source: str | None, low: frozenset[int] | set[int], repeated: frozenset[int] | set[int] = frozenset()) -> str:
    """The main text of a page, given the keys of its host's unimportant branches and of its repeated contents.

    Repeated contents go only if they are a small part of the page: in copies of one page everything is repeated.  If
    nothing is left of a page, its text outside of declared furniture stays.
    """
    if not source:
        return ""
    page = parse(source)
    paths = paths_of(page)
    keys: dict[str, int] = {}

    def key(node: Node) -> int | None:
        path = paths.get(id(node))
        if not path:
            return None
        if path not in keys:
            keys[path] = path_key(path)
        return keys[path]

    found = [t for _, t in blocks(page, lambda n: hidden(n) or key(n) in low)]
    if not found:
        found = [t for _, t in blocks(page, lambda n: hidden(n) or prior(paths.get(id(n), "")) == MARKED)]
    often = [content_key(t) in repeated for t in found] if repeated else []
    if any(often) and sum(len(t) for t, o in zip(found, often) if o) <= PART * sum(map(len, found)):
        found = [t for t, o in zip(found, often) if not o]
    return " ".join(found)


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``: the article of every page, without markup and furniture.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by one.  A null
    or empty page has an empty text; a page whose url names no host is judged with the others of that kind; repeated
    rows count as pages of their own and give repeated rows; an empty table gives no rows; other columns are not read.
    A very long page is one tree in memory, its paths bounded in length.

    The keys of what is cut are counted.  If they are few each task gets them once; otherwise they are joined by host,
    hosts of very many pages being split.
    """
    spark = pages.sparkSession
    tune(spark)
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host().alias("host"))
    seen, _ = stash(observations(named), "seen")
    cuts = _cuts(seen)
    got = cuts.limit(BROADCAST + 1).toArrow()  # bounded, whatever the number of hosts
    result = lambda batch, texts: pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if got.num_rows <= BROADCAST:
        sets: dict[str, tuple[set[int], set[int]]] = {}
        for name, what, key in zip(*(got[c].to_pylist() for c in ("host", "what", "key"))):
            sets.setdefault(name, (set(), set()))[what == "c"].add(key)
        sent = spark.sparkContext.broadcast(sets)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, none = sent.value, (frozenset(), frozenset())
            for batch in batches:
                yield result(batch, [extract(source, *of.get(name, none)) for source, name in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())])

        return named.mapInArrow(run, SCHEMA)

    cuts, _ = stash(cuts, "cuts")
    hot = seen.where("path = '' and kind = 's'").groupBy("host").agg(F.sum("n").alias("n")).where(F.col("n") > HOT).select(F.col("host").alias("hot"), F.ceil(F.col("n") / HOT).alias("parts"))
    hot = F.broadcast(hot)  # one row for each HOT pages at most
    parts = F.coalesce("parts", F.lit(1))
    sets = cuts.groupBy("host").agg(F.collect_list(F.when(F.col("what") == "b", F.col("key"))).alias("low"), F.collect_list(F.when(F.col("what") == "c", F.col("key"))).alias("often"))
    sets = sets.join(hot, F.col("host") == F.col("hot"), "left").select("host", "low", "often", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    dealt = named.join(hot, F.col("host") == F.col("hot"), "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url"), parts))
    joined = dealt.join(sets, ["host", "part"], "left").select("page_id", "url", "html", "low", "often")

    def run_joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield result(batch, [extract(source, set(low or ()), set(often or ())) for source, low, often in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))])

    return joined.mapInArrow(run_joined, SCHEMA)
