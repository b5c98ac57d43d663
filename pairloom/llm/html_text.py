"""Main text of web pages, by a site style tree.

Each page is parsed once, into its blocks of text and the elements that hold
them. Pages of one host are merged into a tree of element paths. A path knows
on how many pages it occurs, which presentation styles (sequences of child
elements) it has there, and which blocks of text. A presentation that varies
from page to page has a high entropy and is important; a block of text that
is the same on page after page spreads evenly over them and is not. The
importance of a branch is composed of that of its node and of its children. A
branch whose node and whose descendants are all of low importance is cut from
every page of the host.

What a tree cannot tell is told by marks: adverts, reader comments and menus
whose text differs from page to page look like content to it, and so does
everything on a host of few pages. Elements whose tag, role or class marks
them as no part of the article are cut on any host, and where a page has an
``article`` or ``main`` element the text is looked for there.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import keep, rows_a_batch
from .textarrays import row_chunks

#: A host with fewer distinct pages has no say.
MIN_PAGES = 6
#: Branches less important than this, and than this share of the host's most important one, are cut.
LOW = 0.3
#: Branches to cut are sent to every task up to this size.
SENT_BYTES = 8 << 20
#: Deeper elements share the path of the one at this depth.
DEEPEST = 64
#: Weight of the children in a node's importance, to the power of the number of its styles.
GAMMA = 0.9

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
CUT_TAGS = frozenset("head nav footer aside form button select option svg math dialog menu canvas object audio video map datalist".split()) | RAW
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead "
    "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup share sharing social related recommended recommendations "
    "comment comments reply replies disqus respond login search toolbar pagination pager skip hidden".split()
)
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
CLOSES = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}

# Neither form of tag crosses another angle bracket, so that a page of unclosed ones takes time in proportion.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*>?|<(/?)([a-zA-Z][^\s/<>]*)([^<>\"']*(?:\"[^\"<>]*\"[^<>\"']*|'[^'<>]*'[^<>\"']*)*)>|<(?=/?[a-zA-Z])", re.S)
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)")


class Open:
    """An open element: its name with classes, whether it is marked, and its children's names.

    ``cut`` is set in a marked block, ``skip`` in a marked inline element, whose text is no part of its block.
    """

    __slots__ = ("tag", "name", "path", "depth", "cut", "skip", "inside", "children")

    def __init__(self, tag: str, name: str, parent: Open | None, marked: bool):
        self.tag, self.name = tag, name
        self.depth = parent.depth + 1 if parent else 0
        self.path = name if not parent else f"{parent.path}/{name}" if self.depth <= DEEPEST else parent.path
        self.cut = (marked and tag not in INLINE) or bool(parent and parent.cut)
        self.skip = (marked and tag in INLINE) or bool(parent and parent.skip)
        self.inside = 2 if tag == "article" else max(parent.inside if parent else 0, int(tag == "main"))
        self.children: list[str] = []


class Tags:
    """Where the tags of a page end, quoted brackets apart; what no scan can close ends at the next bracket."""

    def __init__(self, page: str):
        self.page, self.last = page, {q: page.rfind(q) for q in "\"'>"}
        self.quotes = True  # until a scan has come to the end of the page

    def end(self, at: int) -> int:
        """Index of the bracket that ends the tag whose name ends at ``at``; -1 if there is none."""
        page, i = self.page, at
        while self.quotes and i <= self.last[">"]:
            found = min((k for k in (page.find(c, i, i + 4096) for c in "\"'>") if k >= 0), default=-1)
            if found < 0:
                i += 4096
            elif page[found] == ">":
                return found
            else:
                i = page.find(page[found], found + 1) + 1 if found < self.last[page[found]] else found + 1
        self.quotes = self.quotes and i <= self.last[">"]
        return page.find(">", at)


def describe(tag: str, raw: str, in_article: bool) -> tuple[str, bool]:
    """Name of an element in the tree, and whether it marks itself as no part of the text."""
    cut = tag in CUT_TAGS or (tag == "header" and not in_article)
    if not raw.strip("/ "):
        return tag, cut
    classes: list[str] = []
    for key, value in ATTRIBUTE.findall(raw):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            words = re.split(r"[^a-z]+", value)
            cut = cut or (tag not in ("html", "body", "article", "main") and (not CUT_WORDS.isdisjoint(words) or ("header" in words and not in_article)))
            if key == "class":
                classes += [re.sub(r"[0-9]+", "0", x) for x in value.split()]
        elif key == "role":
            cut = cut or value in CUT_ROLES
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            cut = True
    return ".".join([tag, *sorted(set(classes))]), cut


def parse(page: str) -> tuple[list[tuple[str, str, int, bool]], list[tuple[str, str, bool]]]:
    """Blocks ``(path, text, inside, marked)`` in page order, and the styles ``(path, child names, marked)`` of block elements.

    ``inside`` is 2 in an article, 1 in a main element, else 0. Markup may be
    broken: an end tag closes up to its start tag if that is open, and a block
    closes an open paragraph.
    """
    root = Open("#", "#", None, False)
    stack, blocks, styles, text, opened, tags = [root], [], [], [], Counter(), Tags(page)

    def flush() -> None:
        joined = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if joined:
            # inline elements are part of their block
            holder = next(x for x in reversed(stack) if x.tag not in INLINE)
            blocks.append((holder.path, joined, holder.inside, holder.cut))

    def close(depth: int) -> None:
        while len(stack) > depth:
            gone = stack.pop()
            opened[gone.tag] -= 1
            if gone.tag not in INLINE:
                styles.append((gone.path, " ".join(gone.children), gone.cut))

    def push(element: Open) -> None:
        stack.append(element)
        opened[element.tag] += 1

    def up_to(tags: tuple[str, ...], stops: tuple[str, ...]) -> int:
        if any(opened[t] > 0 for t in tags):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in tags:
                    return k
                if stack[k].tag in stops:
                    break
        return 0

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at and not stack[-1].skip:
            text.append(page[at:stop])
        if not m:
            break
        at = m.end()
        if m[2]:
            shut, tag, raw = m[1], m[2].lower(), m[3]
        elif page[m.start() : m.start() + 2] in ("<!", "<?"):
            continue
        else:  # a tag with brackets in quotes, or a broken one
            name = NAME.match(page, m.start())
            after = tags.end(name.end())
            if after < 0:
                text.append("<") if not stack[-1].skip else None
                continue
            shut, tag, raw, at = name[1], name[2].lower(), page[name.end() : after], after + 1
        if tag in INLINE and tag != "br" and tag not in VOID:
            if shut:
                k = up_to((tag,), ("p", "div", "li", "td", "article", "body"))
                if k:
                    close(k)
            else:
                name, marked = describe(tag, raw, stack[-1].inside == 2)
                push(Open(tag, name, stack[-1], marked))
            continue
        if tag == "br":
            text.append(" ")
            continue
        if shut:
            k = up_to((tag,), ())
            if k:
                flush()
                close(k)
            continue
        flush()
        if tag in VOID:
            continue
        if tag in RAW:
            over = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = over.end() if over else end
            continue
        if tag == "body":
            k = up_to(("head",), ())
            if k:
                close(k)
        k = up_to(("p",), ("div", "article", "section", "td", "li", "body", "blockquote"))
        if k:
            close(k)
        if tag in CLOSES:
            names, stops = CLOSES[tag]
            k = up_to(tuple(names.split()), stops)
            if k:
                close(k)
        name, marked = describe(tag, raw, stack[-1].inside == 2)
        stack[-1].children.append(name)
        push(Open(tag, name, stack[-1], marked))
    flush()
    close(1)
    return blocks, styles


def host(url: str | None) -> str:
    found = HOST.match(url or "")
    return found[1].lower() if found else ""


PARSED = "page_id {kind}, url string, host string, page binary, blocks array<struct<path:string,text:string,inside:int,marked:boolean>>, styles array<struct<path:string,style:string,marked:boolean>>"


def parsed(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, page, blocks, styles`` of ``page_id, url, html``; ``page`` is a hash of the html."""
    block = pa.struct([("path", pa.string()), ("text", pa.string()), ("inside", pa.int32()), ("marked", pa.bool_())])
    style = pa.struct([("path", pa.string()), ("style", pa.string()), ("marked", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_chunks(batch, "html"):
                found = [parse(page or "") for page in part.column("html").to_pylist()]
                blocks = pa.array([[dict(zip(("path", "text", "inside", "marked"), b, strict=True)) for b in x] for x, _ in found], type=pa.list_(block))
                styles = pa.array([[dict(zip(("path", "style", "marked"), b, strict=True)) for b in x] for _, x in found], type=pa.list_(style))
                hosts = pa.array([host(u) for u in part.column("url").to_pylist()], type=pa.string())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), hosts, part.column("page"), blocks, styles], names=["page_id", "url", "host", "page", "blocks", "styles"])

    named = pages.withColumn("page", F.unhex(F.md5(F.coalesce("html", F.lit("")))))
    return named.mapInArrow(run, PARSED.format(kind=pages.schema["page_id"].dataType.simpleString()))


def style_tree(pages: DataFrame) -> DataFrame:
    """``host, path, pages, styles, style_entropy, blocks, block_entropy, marked``: the merged tree of each host's parsed pages.

    Equal pages count once. Entropies are to the base of the number of pages
    that have the path. A block on k of m pages spreads evenly over them and
    has the entropy log k / log m; ``block_entropy`` is the mean over the
    blocks met on the pages. Both follow from sums of n log n, so no count of
    a path meets all of its features.
    """
    seen = pages.select("host", "page", F.explode(F.array_distinct(features())).alias("x")).select("host", "page", "x.*").distinct()
    n = F.col("n").cast("double")
    per_feature = seen.groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("n"), F.max("marked").alias("marked"))
    sums = per_feature.groupBy("host", "path", "kind").agg(F.count(F.lit(1)).alias("features"), F.sum(n).alias("s"), F.sum(n * F.log(n)).alias("t"), F.max("marked").alias("marked"))
    on = seen.select("host", "path", "kind", "page").distinct().groupBy("host", "path", "kind").agg(F.count(F.lit(1)).alias("m"))
    joined = sums.join(on, ["host", "path", "kind"])
    m, log_m = F.col("m").cast("double"), F.log(F.greatest(F.col("m"), F.lit(2)).cast("double"))
    is_style = F.col("kind") == 0
    return joined.groupBy("host", "path").agg(
        F.max("m").alias("pages"),
        F.sum(F.when(is_style, F.col("features")).otherwise(0)).alias("styles"),
        F.max(F.when(is_style, (F.log(m) * F.col("s") - F.col("t")) / (m * log_m))).alias("style_entropy"),
        F.sum(F.when(is_style, 0).otherwise(F.col("features"))).alias("blocks"),
        F.max(F.when(~is_style, F.col("t") / F.col("s") / log_m)).alias("block_entropy"),
        F.max("marked").alias("marked"),
    )


def features() -> Column:
    """A page's styles (kind 0) and blocks (kind 1), as hashes."""

    def feature(kind: int, field: str):
        return lambda x: F.struct(x["path"].alias("path"), F.lit(kind).alias("kind"), F.xxhash64(x[field]).alias("feature"), x["marked"].alias("marked"))

    return F.concat(F.transform("styles", feature(0, "style")), F.transform("blocks", feature(1, "text")))


def low_branches(tree: pd.DataFrame, low: float = LOW, min_pages: int = MIN_PAGES) -> list[str]:
    """Paths of one host that hold text and are in a branch whose composed importance is low throughout.

    ``tree`` has the paths on ``min_pages`` pages or more; ``rare`` says that a
    path has children on fewer, of which nothing can be said, so it stays.
    """
    rows = tree.set_index("path").to_dict("index")
    children: dict[str, list[str]] = {}
    for path in rows:
        children.setdefault(path.rpartition("/")[0], []).append(path)
    score: dict[str, float | None] = {}
    for path in sorted(rows, key=lambda p: -p.count("/")):
        row = rows[path]
        own = None if not row["blocks"] else 1.0 - row["block_entropy"]
        parts = ([own] if own is not None else []) + [s for c in children.get(path, []) if (s := score[c]) is not None]
        if not parts:
            score[path] = None  # no text below it
            continue
        node = 1.0 if pd.isna(row["style_entropy"]) else row["style_entropy"]
        weight = GAMMA ** max(1, row["styles"])
        # a leaf has one style, so its content decides
        mixed = sum(parts) / len(parts)
        score[path] = mixed if row["styles"] <= 1 else max(mixed, (1 - weight) * node + weight * mixed)
    best = max((s for p, s in score.items() if s is not None and not rows[p]["marked"]), default=0.0)
    noisy: dict[str, bool] = {}
    for path in sorted(rows, key=lambda p: -p.count("/")):
        s = score[path]
        noisy[path] = not rows[path]["rare"] and (s is None or (s < low and s < low * best)) and all(noisy[c] for c in children.get(path, []))
    return sorted(p for p in rows if noisy[p] and rows[p]["blocks"])


def branches_to_cut(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, low``: for each host that has any, the paths of the blocks to cut."""
    tree = keep(style_tree(pages), "tree")
    judged = tree.where(F.col("pages") >= min_pages)
    parent = F.regexp_replace("path", "/[^/]*$", "")
    rare = tree.where(F.col("pages") < min_pages).select("host", parent.alias("path")).distinct().withColumn("rare", F.lit(True))
    # a host's rows are the paths of its templates, whatever the number of its pages
    rows = judged.join(rare, ["host", "path"], "left").withColumn("rare", F.coalesce("rare", F.lit(False)))

    def cut(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "low": [low_branches(group, min_pages=min_pages)]})

    return rows.groupBy("host").applyInPandas(cut, "host string, low array<string>").where(F.size("low") > 0)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of every page, blocks joined by a blank line.

    A null page is empty and has an empty text, as has a page without text
    outside of cut elements. Pages with null or hostless addresses are one
    host. Repeated rows and null ids are returned row by row; an empty table
    gives no rows; other columns are not read. Whole pages are read, however
    long.
    """
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    with rows_a_batch(pages.sparkSession, 256):
        pages = keep(parsed(pages), "parsed", compression="zstd")
    low = keep(branches_to_cut(pages), "branches")
    # Sent to every task while it is small, so that pages stay where they are; beyond that Spark joins by host.
    size = low.agg(F.sum(F.octet_length("host") + F.octet_length(F.array_join("low", " ")) + 64)).first()[0] or 0
    joined = pages.join(F.broadcast(low) if size <= SENT_BYTES else low, "host", "left")
    unmarked = F.filter("blocks", lambda b: ~b["marked"])
    best = F.array_max(F.transform("_left", lambda b: b["inside"]))
    main = F.filter("_left", lambda b: (b["inside"] == best) & ~F.coalesce(F.array_contains("low", b["path"]), F.lit(False)))
    text = F.array_join(F.transform(main, lambda b: b["text"]), "\n\n")
    return joined.withColumn("_left", unmarked).select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
