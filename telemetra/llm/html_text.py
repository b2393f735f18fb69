"""Main text of web pages by markup and nearest-URL differencing.

A page is cut to blocks.  Every page is differenced against the page with the
nearest URL of its host that has other lines: a longest common subsequence aligns
their lines, and what both share is their frame.  The markup then checks the
outcome: blocks inside an article or main element stay, which copies share as
well, and blocks inside menus, headers, footers, sidebars, notices, adverts, forms
or reader comments go, which differ from page to page.  Neighbours are found on
URLs and hashes of lines alone.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetra.operators.ordering import SLICE, range_slices, with_previous, with_running_sum
from telemetra.session import materialize

# Element names by role.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "textarea", "title"}
ASIDE = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "head"}
BLOCKS = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset",
          "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre",
          "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"} | ASIDE
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# Words in class, id or role that mark a part as outside the article.
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie",
         "cookies", "consent", "gdpr", "notice", "notices", "alert", "newsletter", "subscribe", "subscription", "signup", "popup",
         "modal", "overlay", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "header",
         "masthead", "comment", "comments", "respond", "replies", "disqus", "share", "sharing", "social", "related",
         "recommended", "widget", "pagination", "pager", "contentinfo", "complementary", "search", "toolbar"}
OPEN, MAIN, OUT = 0, 1, 2

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|</?[a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACE = re.compile(r"\s+")


def _outside(name: str, tag: str) -> bool:
    """Does the element's name or one of its attributes put it outside the article?"""
    if name in ASIDE:
        return True
    if " " not in tag and "\n" not in tag and "\t" not in tag or name in ("html", "body", "article", "main"):
        return False
    for a, v in _ATTR.findall(tag[1 + len(name):]):
        a = a.lower()
        if a == "hidden" or a == "aria-hidden" and "true" in v:
            return True
        if a in ("class", "id", "role") and not MARKS.isdisjoint(re.split(r"[^a-z0-9]+", v.lower())):
            return True
        if a == "style" and re.search(r"display\s*:\s*none", v, re.I):
            return True
    return False


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(class, text) of each block in page order; character references decoded, white space made one space.

    Line breaks inside a block count as white space.  Tags need not be closed.
    """
    out: list[tuple[int, str]] = []
    text: list[str] = []
    depth = 0                   # of open article and main elements
    skip, nested = "", 0        # the element that is passed over, and how often its name is open
    has_main = False

    def flush() -> None:
        if text:
            s = _SPACE.sub(" ", "".join(text)).strip()
            text.clear()
            if s:
                out.append((OUT if skip else MAIN if depth else OPEN, s))

    raw = ""
    for m in _TOKEN.finditer(page or ""):
        t = m[0]
        if raw:                 # script and the like end only at their own end tag
            if t[:2] == "</" and t[2:2 + len(raw)].lower() == raw:
                raw = ""
            continue
        if t[0] != "<" or t == "<":
            text.append(html.unescape(t))       # a reference never spans a tag
            continue
        if t[1] in "!?":
            continue
        name = (_NAME.match(t) or [0, ""])[1].lower()
        end = t[1] == "/"
        if name in RAW:
            if not end and not t.endswith("/>"):
                raw = name
            continue
        if name == "br" or name in ("td", "th", "dt"):
            text.append(" ")
        if name in BLOCKS:
            flush()
        if skip:
            if skip == "p" and not end and name in BLOCKS:
                skip, nested = "", 0            # an open paragraph ends at the next block
            elif name == skip:
                nested += -1 if end else 1
                if not nested:
                    flush()
                    skip = ""
                continue
            else:
                continue
        if end:
            if name in ("article", "main") and depth:
                depth -= 1
            continue
        if name in VOID:
            continue
        if _outside(name, t):
            flush()
            skip, nested = name, 1
        elif name in ("article", "main"):
            depth += 1
            has_main = True
    flush()
    if has_main:                # then what stands outside the article is not the article
        out = [(OUT if k == OPEN else k, s) for k, s in out]
    return out


def common(a: Sequence, b: Sequence) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``, a word of 64 positions at a time."""
    where: dict = {}
    for i, s in enumerate(a):
        where[s] = where.get(s, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v, rows = full, [full]
    for s in b:
        u = v & where.get(s, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    # a zero bit of row j marks where the length over a[..i] and b[..j] grows
    out, i, j = set(), len(a) - 1, len(b)
    while i >= 0 and j:
        if rows[j] >> i & 1:
            i -= 1
        elif not rows[j - 1] >> i & 1:
            j -= 1
        else:
            out.add(i)
            i, j = i - 1, j - 1
    return out


def _near(a: str, b: str) -> int:
    """Common leading characters of two paths."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def kept(kinds: Sequence[int], own: Sequence, beside: Sequence | None) -> list[bool]:
    """Which blocks of a page are main text, given the lines of the page with the nearest URL.

    Differencing comes first: lines aligned with that page are the frame, the rest the page's own.
    The markup then checks it, since copies share their articles and menus or adverts differ from page to page.
    """
    shared = common(own, beside) if beside else set()
    return [k == MAIN or k == OPEN and i not in shared for i, k in enumerate(kinds)]


def _text(cur, prev, nxt) -> str:
    """Main text of a page, given its neighbours as (host, path, blocks)."""
    host, path, own = cur
    lines = [s for _, s in own]
    beside = [(p[1], [s for _, s in p[2]]) for p in (prev, nxt) if p and p[0] == host and host]
    # a page's copy says nothing about its frame
    beside = [p for p in beside if p[1] != lines]
    partner = max(beside, key=lambda p: _near(path, p[0]))[1] if beside else None
    return "\n".join(s for ok, s in zip(kept([k for k, _ in own], lines, partner), lines) if ok)


#: Rows of one URL and content are dealt to so many tasks.
SALTS = 16


def _parsed(rows: DataFrame, kind: str, with_text: bool) -> DataFrame:
    """Per page the 64-bit hashes of its blocks and a digest of them; ``with_text`` their classes and packed texts, too."""
    names = [*(("i", "u") if with_text else ()), "host", "path", "salt"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                c = b.slice(at, 256)
                found = [blocks(h) for h in c.column("h").to_pylist()]
                ids = [b"".join(xxhash.xxh64_digest(s.encode("utf-8", "surrogatepass")) for _, s in f) for f in found]
                cols = [c.column(k) for k in names] + [pa.array([xxhash.xxh128_digest(x) for x in ids], pa.binary())]
                if with_text:
                    # no block holds a line break; packed, since this is what is shuffled
                    packed = [zlib.compress("\n".join(s for _, s in f).encode("utf-8", "surrogatepass"), 6) for f in found]
                    cols += [pa.array([bytes(k for k, _ in f) for f in found], pa.binary()), pa.array(packed, pa.binary())]
                else:
                    cols.append(pa.array(ids, pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, [*names, "d", *(("kinds", "lines") if with_text else ("ids",))])

    head = f"i {kind}, u string, " if with_text else ""
    return rows.mapInArrow(work, f"{head}host string, path string, salt long, d binary, {'kinds binary, lines binary' if with_text else 'ids binary'}")


def neighbours(parsed: DataFrame) -> DataFrame:
    """(host, path, d, salts, partner): per different page the digest of the nearest page of its host with other lines.

    The pages are ordered by (host, path, d); those of equal lines beside each other are one run, so no run of
    copies and no partition's edge hides a neighbour.  Only URLs and digests move here.
    """
    pages = parsed.groupBy("host", "path", "d").agg(F.collect_set("salt").alias("salts"))
    order = [F.col("host"), F.col("path"), F.col("d")]
    sliced = range_slices(pages, "host", "path", "d")
    last = with_previous(sliced, [], order, {"host": "_host", "d": "_d"})
    new = F.when(F.col("_host").eqNullSafe(F.col("host")) & F.col("_d").eqNullSafe(F.col("d")), 0).otherwise(1)
    run = materialize(with_running_sum(last.withColumn("_new", new), [], order, {"run": F.col("_new")}).drop("_host", "_d", "_new", SLICE))
    ends = run.groupBy("run").agg(F.min(F.struct("host", "path", "d")).alias("first"), F.max(F.struct("host", "path", "d")).alias("last"))
    beside = (ends.select(F.col("run") + 1, F.col("last").alias("before"), F.lit(None).alias("after"))
              .unionAll(ends.select(F.col("run") - 1, F.lit(None), F.col("first")))
              .toDF("run", "before", "after").groupBy("run").agg(F.first("before", True).alias("before"), F.first("after", True).alias("after")))

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for host, path, *sides in zip(*[b.column(c).to_pylist() for c in ("host", "path", "before", "after")]):
                near = [s for s in sides if s and s["host"] == host and host]
                out.append(max(near, key=lambda s: _near(path, s["path"]))["d"] if near else None)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("host", "path", "d", "salts")], pa.array(out, pa.binary())],
                                             ["host", "path", "d", "salts", "partner"])

    return run.join(beside, "run", "left").mapInArrow(pick, "host string, path string, d binary, salts array<long>, partner binary")


def main_text(pages: DataFrame, ident: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(ident, url, text, n_chars): the main text of every page.

    Null html gives an empty text; a null or odd URL has no host and no partner.
    Every row returns, repeats too.  A task holds a batch of pages, and the result
    does not depend on how the pages are partitioned.
    """
    kind = pages.schema[ident].dataType.simpleString()
    u = F.coalesce(F.col(url), F.lit(""))
    rows = pages.select(
        F.col(ident).alias("i"), F.col(url).alias("u"), F.col(page).alias("h"),
        F.lower(F.regexp_extract(u, r"^[a-zA-Z][\w+.-]*://(?:[^/?#]*@)?(?:www\.)?([^/?#:]*)", 1)).alias("host"),
        F.regexp_extract(u, r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1).alias("path"),
        F.pmod(F.xxhash64(ident), F.lit(SALTS)).alias("salt"))
    parsed = materialize(_parsed(rows, kind, False))
    ids = parsed.groupBy(F.col("d").alias("partner")).agg(F.first("ids").alias("beside"))
    near = neighbours(parsed).join(ids, "partner", "left").drop("partner").withColumn("salt", F.explode("salts")).drop("salts")
    # the pages are cut to blocks again, which costs less than to keep their texts
    met = _parsed(rows, kind, True).join(near, ["host", "path", "d", "salt"]).select("i", "u", "kinds", "lines", "beside")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                c = b.slice(at, 256)
                texts = []
                for kinds, packed, beside in zip(*[c.column(k).to_pylist() for k in ("kinds", "lines", "beside")]):
                    lines = zlib.decompress(packed).decode("utf-8", "surrogatepass").split("\n") if kinds else []
                    own = [xxhash.xxh64_digest(s.encode("utf-8", "surrogatepass")) for s in lines]
                    other = None if beside is None else [beside[k:k + 8] for k in range(0, len(beside), 8)]
                    texts.append("\n".join(s for ok, s in zip(kept(kinds, own, other), lines) if ok))
                yield pa.RecordBatch.from_arrays(
                    [c.column("i"), c.column("u"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    [ident, url, "text", "n_chars"])

    return met.mapInArrow(work, f"`{ident}` {kind}, `{url}` string, text string, n_chars long")
