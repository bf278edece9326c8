"""Main text of web pages by a site style tree and declared roles.

The pages of one host are merged into a style tree: a node is an element's path
of tags, roles and classes from the root.  A node's presentation importance is the
entropy of its child sequences over the host's pages, to the base of the number
of pages that have it; a leaf's content importance is one less the mean entropy
of its different texts over those pages; importance passes up from children to
parents.  A branch whose nodes all stay under their limit on a host with
``PAGES`` pages or more is noise: menus, notices, footers that a site repeats.

What an element declares is a further input.  Within a declared article or main
part the limit is half of ``IMPORTANCE``, on paragraphs and the like with a noise
name (class or id) twice as high.  Tags, roles and containers that stand for
noise (nav, footer, aside, form, a div of class "share-box") have importance 0: no
entropy can tell boilerplate that differs from page to page.  A name stands for
noise if it has a noise word and nothing but words of layout beside it, so that
"social-links" does and "social-history" doesn't.  Where the tree would take more
than half of a page's article or main part, the site repeats the article itself,
and what is declared stays.

A page with an article or main part has no text outside; the article alone counts
where it is the larger part of a main part that holds it.

The tree is never built of pages in one place: each task sums what its pages
show, rows are summed by host, path and text, and importance goes up level by
level in joins by host and path, so that a host of any size is spread over all
tasks.  Paths below ``DEPTH`` levels count as their ancestor there.  Only the
topmost paths of noise go back to pages: with the tasks where they are few, else by
a join on the paths that each page has.

Defined results: null html is empty; a page without text has the empty string;
a url without a host belongs to the host of empty name; repeated rows are
extracted alike, and each counts as a page; broken markup is read as far as it
goes; very long pages are read whole; extra columns are ignored, whatever their
names; ties don't arise; an empty table has no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswright.llm.store import drop, lean, written

PAGES = 5
IMPORTANCE = 0.3
DAMPING = 0.9
#: Levels of elements that are told apart.
DEPTH = 64
#: Topmost paths of noise that may go to all tasks at once.
BROADCAST = 200_000

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SILENT = frozenset("script style textarea title iframe noembed noframes xmp noscript template head svg annotation object canvas audio video select option datalist button input".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th", "tbody"}, "tbody": {"thead", "tr", "td", "th", "tbody"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = frozenset("html body table td th ul ol dl div article section main aside nav header footer form blockquote figure button object".split())
#: Declared noise: tags, roles, and words of classes and ids.
NOISE_TAGS = frozenset("nav footer aside form menu dialog search".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored sponsors promo promos promotion banner sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments commentlist respond reply replies disqus discussion widget widgets toolbar pagination pager skip copyright legal disclaimer".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
#: Words of layout that may stand beside a noise word.
LAYOUT_WORDS = frozenset(
    "a an the and of for to on in my our your all site page post posts article articles story main content body box boxes bar bars block blocks list lists item items link links icon icons button buttons btn row rows col cols column columns container wrap wrapper "
    "inner outer area region section sections panel panels pane slot unit units holder group module modules component js top bottom left right upper lower center side first last small large big mini mobile desktop sticky fixed float floating global primary secondary "
    "header head foot title text label form message count counter thread media feed tag tags tree level text image img google dfp leaderboard skyscraper rectangle".split()
)
#: Elements of running text: a noise name on them is a hint, not a verdict.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr caption figcaption summary".split()) | INLINE

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|\Z)", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HOST = re.compile(r"[ \t\r\n]*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _hash(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


@cache
def _noise_name(value: str) -> bool:
    """Does one of the names stand for noise?"""
    for name in value.split():
        words = {w.lower() for w in _WORD.findall(name)}
        if not words.isdisjoint(NOISE_WORDS) and words <= NOISE_WORDS | LAYOUT_WORDS:
            return True
    return False


#: What a node declares, in bits: a noise name that is a hint only, inside an article or main part.
HINT, INSIDE = 1, 2


class Node:
    __slots__ = ("children", "depth", "inside", "noise", "path", "tag")

    def __init__(self, tag: str, path: int, depth: int, noise: bool, inside: int):
        self.tag, self.path, self.depth, self.noise, self.inside = tag, path, depth, noise, inside
        self.children: list[int] = []


class Page:
    """Blocks of text and elements of one page."""

    def __init__(self, html: str):
        #: (text, paths from the root, declared noise, 2 in an article, 1 in a main part, else 0)
        self.blocks: list[tuple[str, tuple[int, ...], bool, int]] = []
        self.seen: dict[int, tuple[int, int, int, set[int]]] = {}  # path: its parent's, its level, what it declares, its child sequences
        self.stack = [Node("", 0, 0, False, 0)]
        self.buffer: list[str] = []
        at, n = 0, len(html)
        while at < n:
            m = _TOKEN.search(html, at)
            if not m:
                self._text(html[at:])
                break
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                self._close(tag)
                continue
            self._open(tag, m[3])
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                self._pop()
                if not end:
                    break
                at = html.find(">", end.end())
                at = n if at < 0 else at + 1
            elif tag in VOID:
                self._pop()
        self._flush()
        while len(self.stack) > 1:
            self._pop()

    def _text(self, raw: str) -> None:
        if not self.stack[-1].noise or raw.strip():
            self.buffer.append(raw)

    def _flush(self) -> None:
        if self.buffer:
            text = " ".join(unescape("".join(self.buffer)).split())
            self.buffer = []
            if text:
                top = self.stack[-1]
                self.blocks.append((text, tuple(x.path for x in self.stack), top.noise, top.inside))

    def _open(self, tag: str, attrs: str) -> None:
        if tag in CLOSES_P:
            self._end_if_open({"p"}, "p")
        closes = SAME_CLOSES.get(tag)
        if closes:
            self._end_if_open(closes, tag)
        if tag == "br":
            self.buffer.append(" ")
        elif tag not in INLINE or tag in SILENT:
            self._flush()
        top = self.stack[-1]
        noise, named, comments = tag in NOISE_TAGS or tag in SILENT, False, False
        name = tag
        if attrs and attrs != "/":
            for m in _ATTR.finditer(attrs):
                kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if kind == "class" or kind == "id":
                    named |= _noise_name(value)
                    comments |= not COMMENT_WORDS.isdisjoint(w.lower() for w in _WORD.findall(value))
                    if kind == "class":
                        name += "." + value
                elif kind == "role":
                    name += "@" + value
                    noise |= value.lower() in NOISE_ROLES and tag not in ("article", "main", "body", "html")
                elif kind == "hidden" or kind == "aria-hidden" and value.lower() == "true" or kind == "style" and _HIDDEN.search(value):
                    noise |= tag not in ("html", "body")
        if tag == "header" and not top.inside:
            noise = True
        if tag in ("article", "main"):
            noise |= comments
        elif tag not in ("html", "body") and tag not in TEXT_TAGS:
            noise |= named
        inside = 2 if tag == "article" else max(1, top.inside) if tag == "main" else top.inside
        if top.depth < DEPTH:
            path = _hash(b"%d " % top.path + name.encode("utf-8", "surrogatepass")) or 1
            self.seen.setdefault(path, (top.path, top.depth + 1, (HINT if named else 0) | (INSIDE if inside else 0), set()))
            top.children.append(path)
            self.stack.append(Node(tag, path, top.depth + 1, top.noise or noise, inside))
        else:
            self.stack.append(Node(tag, top.path, top.depth, top.noise or noise, inside))

    def _end_if_open(self, tags: set[str], opener: str) -> None:
        """Close the nearest open element of these tags, unless one that bounds their scope is nearer."""
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i].tag
            if tag in tags:
                self._flush()
                while len(self.stack) > i:
                    self._pop()
                if opener in ("tr", "thead", "tbody", "tfoot"):
                    continue
                return
            if tag in SCOPES and not (opener in ("tr", "tbody", "thead", "tfoot") and tag in ("td", "th")):
                return

    def _close(self, tag: str) -> None:
        if tag not in INLINE or tag in SILENT:
            self._flush()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                while len(self.stack) > i:
                    self._pop()
                return
            if tag in INLINE and self.stack[i].tag not in INLINE or tag == "p" and self.stack[i].tag in SCOPES:
                return

    def _pop(self) -> None:
        if self.stack[-1].tag not in INLINE:
            self._flush()
        node = self.stack.pop()
        if self.stack[-1].path != node.path:
            self.seen[node.path][3].add(_hash(str(node.children).encode()))

    def text(self, noise_paths: frozenset[int] = frozenset()) -> str:
        own = [(t, inside, not noise_paths.isdisjoint(paths)) for t, paths, declared, inside in self.blocks if not declared]
        size = lambda keep: sum(len(t) for t, inside, noise in own if keep(inside, noise))
        repeated = size(lambda inside, noise: inside and noise) > size(lambda inside, noise: inside and not noise)
        own = [(t, inside) for t, inside, noise in own if not noise or inside and repeated]
        level = min(1, max((inside for _, inside in own), default=0))
        if sum(len(t) for t, inside in own if inside == 2) > sum(len(t) for t, inside in own if inside == 1):
            level = 2
        return "\n\n".join(t for t, inside in own if inside >= level)


# ---- the style tree -------------------------------------------------------

_SHOWN = "host string, path long, parent long, depth int, declared int, kind int, feature long, pages long"


def _shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the task's pages show: (host, path, parent, level, declared, kind, feature) and on how many pages; kind 0: the path, 1: a child sequence, 2: a text."""
    counts: Counter = Counter()

    def rows() -> pa.RecordBatch:
        keys = list(counts)
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate(kinds)]
        out = pa.RecordBatch.from_arrays([*columns, pa.array(list(counts.values()), pa.int64())], names=["host", "path", "parent", "depth", "declared", "kind", "feature", "pages"])
        counts.clear()
        return out

    for b in batches:
        for url, html in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
            h, page = host(url), Page(html or "")
            mine = set()
            for path, (parent, depth, declared, styles) in page.seen.items():
                mine.add((h, path, parent, depth, declared, 0, 0))
                mine.update((h, path, parent, depth, declared, 1, x) for x in styles)
            for text, paths, _, _ in page.blocks:
                if paths[-1]:
                    mine.add((h, paths[-1], *page.seen[paths[-1]][:3], 2, _hash(text.encode("utf-8", "surrogatepass"))))
            counts.update(mine)
            if len(counts) > 200_000:
                yield rows()
    if counts:
        yield rows()


def style_tree(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, path, parent, depth, declared, pages, look (presentation importance), content (content importance; null without text of its own)."""
    shown = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(lean(_shown), _SHOWN)
    sums = shown.groupBy("host", "path", "parent", "depth", "declared", "kind", "feature").agg(F.sum("pages").alias("c"))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    nodes = sums.groupBy("host", "path").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.bit_and("declared").alias("declared"), of(0, F.col("c")).alias("pages"), of(1, F.col("c")).alias("styles"), of(1, F.col("c") * F.ln("c")).alias("styles_ln"), F.avg(F.when(F.col("kind") == 2, F.ln("c"))).alias("mean_ln"))
    base = F.ln(F.greatest(F.col("pages"), F.lit(2)))
    look = (F.col("styles") * F.ln("styles") - F.col("styles_ln")) / F.col("styles") / base
    return nodes.select("host", "path", "parent", "depth", "declared", "pages", F.coalesce(look, F.lit(0.0)).alias("look"), (1 - F.col("mean_ln") / base).alias("content"))


def noise_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, path of every topmost branch of noise, in written tables: one for each level of the tree, from the lowest up."""
    tree, tree_path = written(style_tree(pages, url, html), "tree")
    deepest = tree.where(F.col("pages") >= PAGES).agg(F.max("depth")).first()[0] or 0
    levels, below = [], None
    limit = IMPORTANCE * F.when(F.col("declared").bitwiseAND(HINT) > 0, 2).otherwise(1) * F.when(F.col("declared").bitwiseAND(INSIDE) > 0, 0.5).otherwise(1.0)
    for depth in range(deepest + 1, 0, -1):
        own = tree.where(F.col("depth") == depth)
        if below is None:
            own = own.select("*", F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("inner"), F.lit(True).alias("all_noise"))
        else:
            own = own.join(below, ["host", "path"], "left")
        keep = F.pow(F.lit(DAMPING), F.col("n"))
        inner = (1 - keep) * F.col("look") + keep * F.col("inner")
        value = F.when(F.col("pages") < PAGES, 1.0).when(F.col("n").isNull(), F.coalesce("content", F.lit(0.0))).otherwise(F.greatest(inner, F.coalesce("content", inner)))
        noise = (F.col("pages") >= PAGES) & (F.col("value") < limit) & F.coalesce("all_noise", F.lit(True))
        level, _ = written(own.withColumn("value", value).select("host", "path", "parent", "pages", "value", noise.alias("noise")), "level")
        below = level.groupBy("host", F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("pages") * F.col("value")) / F.sum("pages")).alias("inner"), F.bool_and("noise").alias("all_noise"))
        levels.append(level.where("noise").select("host", "path", "parent"))
    out = tree.limit(0).select("host", "path")
    for level, above in zip(levels, [*levels[1:], None], strict=True):
        top = level if above is None else level.join(above.select("host", F.col("path").alias("parent")), ["host", "parent"], "left_anti")
        out = out.unionByName(top.select("host", "path"))
    out, _ = written(out, "noise")
    drop(pages.sparkSession, tree_path)
    return out


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), url: str = "url", html: str = "html") -> DataFrame:
    """keep's columns, text and n_chars of every page."""
    noise = noise_paths(pages, url, html)
    few = noise.limit(BROADCAST + 1).count() <= BROADCAST
    src = pages.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(keep)), F.col(html).alias("html"), F.col(url).alias("url"))
    schema = pages.select(*keep, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    known: dict[str, frozenset[int]] = {}
    if few:
        by_host: dict[str, list[int]] = {}
        for r in noise.toLocalIterator():
            by_host.setdefault(r.host, []).append(r.path)
        known = {h: frozenset(x) for h, x in by_host.items()}
        src = src.withColumn("paths", F.lit(None).cast("array<long>"))
    else:
        # Pages take their own paths to the noise, and what is noise of them comes back.
        src = src.withColumn("page", F.xxhash64("url", "html"))
        has = src.select("page", "url", "html").mapInArrow(lean(_paths), "page long, host string, path long")
        found = has.join(noise, ["host", "path"]).groupBy("page").agg(F.collect_set("path").alias("paths"))
        src = src.join(found, "page", "left").drop("page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("html", "url", "paths")), strict=True)
            texts = [Page(h or "").text(known.get(host(u), frozenset()) if few else frozenset(p or ())) for h, u, p in rows]
            yield pa.RecordBatch.from_arrays([*(b.column(f"__{i}") for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return src.mapInArrow(lean(run), schema)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, host(u), x) for i, u, h in zip(*(b.column(c).to_pylist() for c in ("page", "url", "html")), strict=True) for x in Page(h or "").seen]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["page", "host", "path"])


def op10_query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
