"""HTML extraction: a host's suffix array decides, and marks say how much of a repeat it takes.

A page is read into blocks of text. Menus, headers, footers, sidebars, notices, adverts, forms and
reader comments are known by element, role, or words of class and id. What a page marks as its article
(``article``, ``main``, their roles, or such words) is its text, but for blocks that the host's articles
repeat: the suffixes at the starts of the blocks of all distinct articles of a host stand in the suffix
array under the whole block, and a block goes if ``MARKED_SHARE`` of these articles (``MARKED_LEAST``
at least) have it, such as a request to subscribe that a site's template puts inside its articles.
A passage that fewer share stays whole, as sites do quote each other's passages, and so does what
equals a repeat in a part of a block only. Articles with equal texts count once, and one that holds
nothing else stays.

A heading, or a part such as a title or a date line, that carries such a word marks no article: the
open blocks beside it stay.

Without a marked article, boilerplate is what a host repeats. The token streams of the pages of all hosts that have an
unmarked page (outside marked articles, from every token) are in the suffix array, too: suffixes are
sorted by host and their first ``DEPTH`` or ``LONG`` tokens, one entry for each distinct page; a run of
equal prefixes in this order counts the pages that have the string. Covered tokens are
removed from unmarked blocks if a ``SHARE`` of the host's distinct pages (two at least) has the string, or
if two have a long one; the rest stays. Pages with equal token streams are one distinct page, so
a page's copies take nothing from it, and neither does a phrase that few pages of a large host share.

The order is made by range partitions that end in the page's number and neighbours meet by rank,
so a host with a third of all pages is as many partitions as it needs.

Defined results: null or empty HTML gives an empty text; a null URL or one without ``://`` counts
as the host ''. Repeated rows are copies. A very
long page is read whole, by one task; an empty table gives no rows. Only id, URL and HTML are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysnap.llm.common import numbered, stored

DEPTH, LONG = 6, 32
SHARE = 0.25
MARKED_SHARE, MARKED_LEAST = 0.75, 4

# Elements and words of class, id and role.
RAW = {"script", "style", "template", "noscript", "textarea", "iframe", "svg", "title", "select", "object", "math"}
DROPPED = {"nav", "footer", "aside", "form", "head", "button", "dialog", "menu"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li",
    "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CLOSES_ITSELF = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
BOILERPLATE_WORDS = frozenset(
    "nav navbar navigation menu submenu header masthead topbar footer bottombar sidebar aside ad ads advert adverts "
    "advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments reply replies "
    "disqus respond related recommended breadcrumb breadcrumbs pagination pager widget toolbar copyright skip".split()
)
MAIN_WORDS = frozenset("article post entry story content main maincontent articlebody".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PART_WORDS = frozenset("title subtitle headline heading meta date time author byline tags thumbnail".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
MAIN_ROLES = frozenset({"main", "article"})

_MARKUP = re.compile(
    r"<!--|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>"
)
_ATTRIBUTE = re.compile(r"(?i)(?<![\w-])(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)")
_WORD = re.compile(r"[A-Za-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

DROP, OPEN, ARTICLE = 0, 1, 2


def _context(tag: str, attributes: str, outer: int) -> int:
    """What the text of an element is, within ``outer``."""
    if outer == DROP or tag in DROPPED:
        return DROP
    if tag == "header" and outer != ARTICLE:
        return DROP
    kind = ARTICLE if tag in MAIN else outer
    if not attributes or tag in ("html", "body"):
        return kind
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden":
            return DROP
        words = {w.lower() for w in _WORD.findall(_CAMEL.sub(" ", value))}
        if name == "role":
            if words & BOILERPLATE_ROLES:
                return DROP
            if words & MAIN_ROLES:
                kind = ARTICLE
        elif tag not in MAIN and words & BOILERPLATE_WORDS or words & {"comment", "comments", "reply"}:
            return DROP
        elif words & MAIN_WORDS and tag not in HEADINGS and not words & PART_WORDS:
            kind = ARTICLE
    return kind


def blocks(html: str | None) -> list[tuple[int, str]]:
    """(kind, text) of all blocks in page order, white space as one space, none empty."""
    out: list[tuple[int, str]] = []
    if not html:
        return out
    text: list[str] = []
    stack: list[tuple[str, int]] = []
    kind = OPEN

    def close() -> None:
        if text:
            words = unescape("".join(text)).split()
            if words:
                out.append((kind, " ".join(words)))
            text.clear()

    at, end = 0, len(html)
    while at < end:
        m = _MARKUP.search(html, at)
        if m is None:
            text.append(html[at:])
            break
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            done = html.find("-->", at)
            at = end if done < 0 else done + 3
            continue
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing = name.lower(), (m[1] or m[4]) == "/"
        attributes = m[3] or m[6] or ""
        if tag in RAW and not closing:
            if not attributes.endswith("/") or tag in ("script", "style", "title", "textarea"):
                over = re.compile(rf"(?i)</{tag}(?=[\s/>])[^>]*>").search(html, at)
                at = end if over is None else over.end()
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in BLOCKS and tag not in DROPPED:
            continue
        close()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        elif tag not in VOID:
            while stack and tag in CLOSES_ITSELF.get(stack[-1][0], ()):
                stack.pop()
            outer = stack[-1][1] if stack else OPEN
            stack.append((tag, _context(tag, attributes, outer)))
        kind = stack[-1][1] if stack else OPEN
    close()
    return out


def host_of(url: str | None) -> str:
    """Lower-cased, after the first ``://``; '' where there is none."""
    _, found, rest = (url or "").partition("://")
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower() if found else ""


def prefixes(stream: list[list[str]], every: list[bool]) -> set[str]:
    """The first ``DEPTH`` tokens of suffixes: at all places of some blocks, at the start of the others."""
    tokens = [t for b in stream for t in b]
    out, at = set(), 0
    for b, whole in zip(stream, every):
        for i in range(len(b) if whole else 1):
            out.add(" ".join(tokens[at + i : at + i + DEPTH]))
        at += len(b)
    return out


def long_prefix(tokens: list[str]) -> str:
    """A key that no prefix of ``DEPTH`` tokens has."""
    return "\n" + hashlib.md5(" ".join(tokens).encode("utf-8", "surrogatepass")).hexdigest()


def suffix_keys(texts: list[str]) -> set[str]:
    """The prefixes of both lengths of the suffixes at all tokens."""
    stream = [t.split(" ") for t in texts]
    tokens = [t for b in stream for t in b]
    long = {long_prefix(tokens[i : i + LONG]) for i in range(len(tokens) - LONG + 1)}
    return prefixes(stream, [True] * len(stream)) | long


def unique_runs(texts: list[str], repeated: set[str]) -> list[str]:
    """Blocks without the tokens that repeated prefixes cover; empty ones go."""
    stream = [t.split(" ") for t in texts]
    tokens = [t for b in stream for t in b]
    covered = [False] * len(tokens)
    long = any(k.startswith("\n") for k in repeated)
    for i in range(len(tokens)):
        some = tokens[i : i + DEPTH]
        if " ".join(some) in repeated:
            covered[i : i + len(some)] = [True] * len(some)
        if long and i + LONG <= len(tokens) and long_prefix(tokens[i : i + LONG]) in repeated:
            covered[i : i + LONG] = [True] * LONG
    out, at = [], 0
    for b in stream:
        kept = [t for t, c in zip(b, covered[at : at + len(b)]) if not c]
        at += len(b)
        if kept:
            out.append(" ".join(kept))
    return out


_STRINGS = T.ArrayType(T.StringType())


def _read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, id, url, html to row, id, url, host, text, open blocks, blocks outside articles and a digest."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            some = batch.slice(at, 64)
            hosts, texts, opened, others, digests = [], [], [], [], []
            for url, html in zip(some.column(2).to_pylist(), some.column(3).to_pylist()):
                found = blocks(html)
                main = [t for k, t in found if k == ARTICLE]
                hosts.append(host_of(url))
                texts.append("\n\n".join(main))
                opened.append([] if main else [t for k, t in found if k == OPEN])
                others.append([t for k, t in found if k != ARTICLE])
                whole = " ".join(t for _, t in found)
                digests.append(hashlib.md5(whole.encode("utf-8", "surrogatepass")).digest())
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [some.column(0), some.column(1), some.column(2), pa.array(hosts, pa.string()), pa.array(texts, pa.string()),
                 pa.array(opened, strings), pa.array(others, strings), pa.array(digests, pa.binary())],
                names=["row", "page", "url", "host", "text", "open", "other", "digest"],
            )


def _key_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, row, open blocks, blocks outside articles to host, row and keys of suffixes."""
    for batch in batches:
        for at in range(0, batch.num_rows, 16):
            some = batch.slice(at, 16)
            keys = [
                sorted(suffix_keys(opened) | suffix_keys(other))
                for opened, other in zip(some.column(2).to_pylist(), some.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [some.column(0), some.column(1), pa.array(keys, pa.list_(pa.string()))], names=["host", "row", "keys"]
            )


def _cut_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [
            "\n\n".join(unique_runs(opened, set(repeated or [])))
            for opened, repeated in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page", "url", "text"]
        )


def repeated_suffixes(suffixes: DataFrame) -> DataFrame:
    """(host, key, n) of the keys that several pages of the host have; ``suffixes`` has one entry for each."""
    ranked = stored(numbered(suffixes, ["host", "key", "row"], "suffix-array"), "suffix-array")
    here, before = ranked.alias("here"), ranked.select(F.col("rank") + 1, "host", "key").toDF("rank", "host_", "key_")
    pairs = here.join(before, "rank").where((F.col("host") == F.col("host_")) & (F.col("key") == F.col("key_")))
    return pairs.groupBy("host", "key").agg((F.count("*") + 1).alias("n"))


def block_key(block: Column) -> Column:
    """A key of a whole block in a marked article, which no prefix of an unmarked page has."""
    return F.concat(F.lit("\f"), F.md5(block))


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text) for every page; the text is empty if there is none."""
    source = pages.select(F.monotonically_increasing_id().alias("row"), F.col(page_id).alias("page"), F.col(url).alias("url"), html)
    host, text = T.StructField("host", T.StringType()), T.StructField("text", T.StringType())
    schema = T.StructType(
        [
            source.schema["row"], source.schema["page"], source.schema["url"], host, text, T.StructField("open", _STRINGS),
            T.StructField("other", _STRINGS), T.StructField("digest", T.BinaryType()),
        ]
    )
    read = stored(source.mapInArrow(_read_pages, schema), "pages")
    unmarked = read.where(F.size("open") > 0).select("row", "page", "url", "host", "open")
    # Of other hosts' pages only the marked articles are sorted.
    hosts = stored(unmarked.select("host").distinct(), "hosts")
    distinct = stored(
        read.select("host", "digest", "row").join(hosts, "host", "left_semi")
        .groupBy("host", "digest").agg(F.min("row").alias("row")), "distinct-pages",
    )
    sizes = distinct.groupBy("host").agg(F.count("*").alias("size"), F.lit(0).alias("marked"))
    # Equal articles of a host are one: a hash of the text stands for the row, so that no text is joined.
    articles = read.where("text <> ''").select("host", F.xxhash64("text").alias("row"), "text")
    # Hosts with fewer articles than that have nothing to lose.
    marked = stored(
        articles.select("host", "row").distinct().groupBy("host").agg(F.count("*").alias("marked"))
        .where(F.col("marked") >= MARKED_LEAST), "marked-hosts",
    )
    sizes = stored(
        sizes.unionByName(marked.select("host", F.lit(0).alias("size"), "marked"))
        .groupBy("host").agg(F.max("size").alias("size"), F.max("marked").alias("marked")), "host-sizes",
    )
    keyed = T.StructType([host, source.schema["row"], T.StructField("keys", _STRINGS)])
    counted = read.join(distinct.select("row"), "row", "left_semi").select("host", "row", "open", "other")
    suffixes = counted.mapInArrow(_key_pages, keyed).select("host", F.explode("keys").alias("key"), "row")
    starts = articles.join(marked, "host", "left_semi")
    starts = starts.select("host", F.explode(F.array_distinct(F.split("text", "\n\n"))).alias("block"), "row")
    suffixes = suffixes.union(starts.select("host", block_key(F.col("block")), "row").distinct())
    least = F.when(F.col("key").startswith("\f"), F.greatest(F.lit(MARKED_LEAST), F.ceil(MARKED_SHARE * F.col("marked"))))
    least = least.otherwise(F.greatest(F.lit(2), F.ceil(SHARE * F.col("size"))))
    boilerplate = stored(
        repeated_suffixes(suffixes).join(sizes, "host")
        .where((F.col("n") >= least) | F.col("key").startswith("\n")).select("host", "key"), "boilerplate",
    )
    none = F.array().cast("array<string>").alias("other")
    own = unmarked.select("host", "row", "open", none).mapInArrow(_key_pages, keyed)
    repeated = (
        own.select("host", F.explode("keys").alias("key"), "row").join(boilerplate, ["host", "key"])
        .groupBy("row").agg(F.collect_list("key").alias("repeated"))
    )
    out = T.StructType([source.schema["page"], source.schema["url"], text])
    cut = unmarked.join(repeated, "row", "left").select("page", "url", "open", "repeated").mapInArrow(_cut_pages, out)
    # At most a few blocks for each host: three quarters of its articles have each of them.
    gone = stored(
        boilerplate.where(F.col("key").startswith("\f")).groupBy("host").agg(F.collect_list("key").alias("gone")), "gone"
    )
    kept = F.filter(F.split("text", "\n\n"), lambda b: ~F.array_contains("gone", block_key(b)))
    rest = F.when(F.col("gone").isNull() | (F.size(kept) == 0), F.col("text")).otherwise(F.array_join(kept, "\n\n"))
    whole = read.where(F.size("open") == 0).join(gone, "host", "left").select("page", "url", rest)
    return whole.union(cut).toDF(page_id, "url", "text")
