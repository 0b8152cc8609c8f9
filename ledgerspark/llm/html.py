"""Main text of web pages by site style trees."""

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import stored

# Elements by their meaning in HTML.
SKIPPED = frozenset("""head script style noscript template svg math iframe object embed applet canvas audio video
    form button select textarea input option datalist dialog nav footer aside menu title""".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary
    table caption thead tbody tfoot tr ul""".split())
# A start tag closes these open elements above it.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}
# Presentation that marks what is not the article, as a whole class or id, or as one part of it.
NOISE = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion
    cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup paywall
    menu nav navbar navigation breadcrumb breadcrumbs sidebar widget widgets pagination pager toolbar
    comment comments disqus replies respond social share sharing related recommended recommendations
    footer masthead topbar login search skip copyright""".split())
NOISE_WHOLE = frozenset("header site-header page-header top bottom tags meta byline-share aside".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
MAIN = ("article", "main")

TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z][^>]*>|<[!?/][^>]*>", re.S | re.I)
ENDED = re.compile(r"(?:--!?|</[a-z]+\s*)>\Z", re.I)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
PATHS = 100_000  # unimportant paths, and pages' lists of them, up to which they are sent to every task
LISTS = 50_000
HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


class Page:
    """One page: its text blocks in order, each with the path of styled elements it stands in."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, bool, bool, tuple, str]] = []  # path, noise, in main, marked branches, text
        # Open elements: name, path, noise, in main, marked branches.
        self.open: list[tuple[str, str, bool, bool, tuple]] = [("", "", False, False, ())]
        self.parts: list[str] = []
        at = 0
        # Behind the last ">" no tag ends, only a comment may begin: nothing is searched there over and over.
        end = html.rfind(">") + 1
        tail = html.find("<!--", end)
        if tail >= 0:
            html = html[:tail]
        for m in TAG.finditer(html, 0, end):
            if m.start() > at:
                self.parts.append(html[at:m.start()])
            at = m.end()
            if m["name"]:
                (self._end if m["end"] else self._start)(m["name"].lower(), m["attrs"])
            elif not m["raw"] and not m[0].startswith(("<!", "<?")):
                self.parts.append(" ")
            if at == end and (m["raw"] or m[0].startswith("<!--")) and not ENDED.search(m[0]):
                html = html[:end]  # a comment or script that never ends takes the rest with it
        self.parts.append(html[at:])
        self._flush()

    def _flush(self) -> None:
        text = "".join(self.parts)
        self.parts = []
        if text and not text.isspace():
            text = " ".join(unescape(text).split())
            if text:
                _, path, noise, main, marks = self.open[-1]
                self.blocks.append((path, noise, main, marks, text))

    def _start(self, name: str, attrs: str) -> None:
        if name == "br":
            self.parts.append(" ")
            return
        if name in BLOCKS or name in CLOSES or name in SKIPPED:
            if name in ("td", "th"):
                self.parts.append(" ")
            else:
                self._flush()
        if name in VOID:
            return
        if name in BLOCKS:
            self._close_paragraph()
        if name in CLOSES:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] in HOLDS[name]:
                    break
                if self.open[k][0] in CLOSES[name]:
                    del self.open[k:]
                    break
        _, path, noise, main, marks = self.open[-1]
        style, hidden, marked = _style(name, attrs)
        main = main or name in MAIN
        # A header inside the article holds its headline; elsewhere it belongs to the site.
        noise = noise or hidden or name in SKIPPED or (name == "header" and not main)
        if name in BLOCKS or style != name or name in SKIPPED:
            path = f"{path}>{style}"
            if (noise != self.open[-1][2] or marked) and name not in BLOCKS and name not in SKIPPED:
                self._flush()
        self.open.append((name, path, noise, main, (*marks, len(self.blocks)) if marked else marks))

    def _close_paragraph(self) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            name = self.open[k][0]
            if name == "p":
                del self.open[k:]
                return
            if name in BLOCKS:
                return

    def _end(self, name: str, _attrs: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == name:
                if name in BLOCKS or name in SKIPPED or self.open[k][2] != self.open[k - 1][2] or self.open[k][4] != self.open[k - 1][4]:
                    self._flush()
                elif name in ("td", "th"):
                    self.parts.append(" ")
                del self.open[k:]
                return
            if self.open[k][0] in MAIN and name not in ("body", "html"):
                return


def _style(name: str, attrs: str) -> tuple[str, bool, bool]:
    """Presentation of an element, its name with classes and id, whether it is noise (hidden, or by its role),
    and whether a class or id marks it as such."""
    if not attrs or attrs.isspace():
        return name, False, False
    style, noise, marked = name, False, False
    for key, value in ATTR.findall(attrs):
        key, value = key.lower(), unescape(value.strip("\"'")).strip()
        if key in ("class", "id"):
            names = sorted(value.lower().split())
            if names:
                style += ("." if key == "class" else "#") + re.sub(r"\d{2,}", "0", ".".join(names))
            if name not in ("body", "html", *MAIN):
                marked = marked or any(x in NOISE_WHOLE or x in NOISE or not NOISE.isdisjoint(re.split(r"[-_]+", x)) for x in names)
        elif key == "role" and value.lower() in NOISE_ROLES:
            noise = True
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            noise = True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            noise = True
    return style, noise, marked


def parts_of(path: str) -> list[str]:
    """A path and all paths above it."""
    names = path.split(">")
    return [">".join(names[:k]) for k in range(2, len(names) + 1)]


def host_of(url: str | None) -> str:
    found = HOST.match(url or "")
    return found[1].lower() if found else ""


def nodes(pages: DataFrame) -> DataFrame:
    """Rows of every page's tree: ``host``, ``path``, ``kind``, ``value``.

    Kind ``text`` has a hash of the text of a node's own block, kind ``style`` a hash of the styles of its
    children in order. Equal rows of a page come once.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url, html in zip(batch["url"], batch["html"], strict=True):
                host, seen, children = host_of(url), set(), {}
                for path, *_, text in Page(html).blocks:
                    seen.add((host, path, "text", text))
                    above = parts_of(path)
                    for up, down in zip(above, above[1:], strict=False):
                        kids = children.setdefault(up, {})
                        kids[down] = None
                seen.update((host, up, "style", " ".join(kids)) for up, kids in children.items())
                rows += seen
            yield pd.DataFrame(rows, columns=["host", "path", "kind", "value"])

    rows = pages.where("html is not null").select("url", "html").mapInPandas(run, "host string, path string, kind string, value string")
    return rows.withColumn("value", F.xxhash64("value"))


def style_trees(pages: DataFrame, least: int = 8) -> DataFrame:
    """Importance of the nodes of each host's style tree: ``host``, ``path``, ``n_pages``, ``importance``.

    The pages of a host are laid over each other by path. A node's content importance is 1 less
    the entropy of its texts over the pages that have them, to the base of the number of pages:
    text that all pages share counts 0, text of one page 1. Its presentation importance is the
    entropy of its children's styles. A node counts as important as the most important part of
    it, so a branch is unimportant only as a whole. Nodes on fewer than ``least`` pages say nothing
    of the site: they count as important for the nodes above them and are left out. Counts are
    summed before they are shuffled, whatever share of the pages one host has.
    """
    values = nodes(pages).groupBy("host", "path", "kind", "value").agg(F.count("*").alias("n"))
    # Sums over the values of a node; the base is only known with the node's number of pages.
    kinds = values.groupBy("host", "path", "kind").agg(
        F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    text, style = F.col("kind") == "text", F.col("kind") == "style"
    own = kinds.groupBy("host", "path").agg(
        F.max("m").alias("n_pages"),
        F.max(F.when(text, 1 - F.col("nlogn") / (F.col("m") * F.log(F.greatest("m", F.lit(2)))))).alias("content"),
        F.max(F.when(style, 1 - F.col("nlogn") / (F.col("m") * F.log(F.greatest("m", F.lit(2)))))).alias("presentation"))
    rated = F.greatest(F.coalesce("content", F.lit(0.0)), F.coalesce("presentation", F.lit(0.0)))
    scored = stored(own.withColumn("own", F.when(F.col("n_pages") < least, 1.0).otherwise(rated)))
    parents = F.transform(F.sequence(F.lit(2), F.size(F.split("path", ">"))), lambda k: F.array_join(F.slice(F.split("path", ">"), 1, k), ">"))
    tops = scored.select("host", F.explode(parents).alias("path"), "own").groupBy("host", "path").agg(F.max("own").alias("importance"))
    return scored.where(F.col("n_pages") >= least).select("host", "path", "n_pages").join(tops, ["host", "path"])


def low_paths(pages: DataFrame, low: DataFrame) -> DataFrame:
    """Of the paths ``low`` (host, path) those each page has: ``_of`` (a hash of the page), ``_low``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(of, host_of(url), path) for of, url, html in zip(batch["_of"], batch["url"], batch["html"], strict=True)
                    for path in {up for block in Page(html).blocks for up in parts_of(block[0])}]
            yield pd.DataFrame(rows, columns=["_of", "host", "path"])

    low = stored(low)
    own = pages.where("html is not null").select(_page().alias("_of"), "url", "html").mapInPandas(run, "_of long, host string, path string")
    return own.join(_small(low, PATHS), ["host", "path"]).groupBy("_of").agg(F.collect_set("path").alias("_low"))


def _page() -> Column:
    return F.xxhash64(F.coalesce("url", F.lit("")), "html")


def _small(rows: DataFrame, most: int) -> DataFrame:
    """Stored rows: up to a fixed number they go to every task, beyond it both sides are shuffled."""
    return F.broadcast(rows) if rows.count() <= most else rows


def extract(pages: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Add ``text`` and ``n_chars`` to ``pages`` (url, html): the main text of each page.

    Branches that the host's style tree rates below ``threshold`` go, as do branches whose element or role makes
    them a menu, footer, form and the like, or that a class or id marks as such; where such marks would leave less
    than a third of the text, those on branches with more than half of it do not count. If article or main elements
    have a quarter of what is left, the text is what is left inside; otherwise all that is left. Plain paragraphs and headlines inside an article stay, however many pages repeat them.
    Blocks are joined by two line breaks; white space within a block becomes one blank. Null
    or empty html gives an empty text; a null url is a host of its own. ``text`` and ``n_chars`` are replaced.
    """
    trees = style_trees(pages)
    lows = stored(low_paths(pages, trees.where(F.col("importance") < threshold).select("host", "path")))
    names = [c for c in pages.columns if c not in ("text", "n_chars")]

    @F.pandas_udf("string")
    def main_text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for htmls, lows in batches:
            yield pd.Series([text_of(h, low) for h, low in zip(htmls, lows, strict=True)], dtype="object")

    joined = pages.withColumn("_key", _page()).join(_small(lows, LISTS), F.col("_key") == F.col("_of"), "left")
    return (joined.withColumn("text", main_text(F.coalesce("html", F.lit("")), F.coalesce("_low", F.array().cast("array<string>"))))
            .select(*names, "text").withColumn("n_chars", F.length("text").cast("long")))


def text_of(html: str, low: list[str] | None = None) -> str:
    """Main text of one page, given the unimportant paths of its host."""
    low = frozenset(low if low is not None else ())
    kept = [(main, marks, text) for path, noise, main, marks, text in Page(html).blocks
            if not noise and not (low and _unimportant(path, main, low))]
    sizes: dict[int, int] = {}
    for _, marks, text in kept:
        for mark in marks:
            sizes[mark] = sizes.get(mark, 0) + len(text)
    whole = sum(len(text) for *_, text in kept)
    if 3 * sum(len(text) for _, marks, text in kept if not marks) < whole:
        # Marks that leave next to nothing stand on frames around the article: only those on minor branches count.
        sizes = {mark: size for mark, size in sizes.items() if 2 * size <= whole}
    kept = [(main, text) for main, marks, text in kept if not any(mark in sizes for mark in marks)]
    # What stands outside goes if the article and main elements have a fair part of the text; else they hold a teaser.
    inside = sum(len(text) for main, text in kept if main)
    if 4 * inside >= sum(len(text) for _, text in kept):
        kept = [k for k in kept if k[0]] or kept
    return "\n\n".join(text for _, text in kept)


def _unimportant(path: str, main: bool, low: frozenset) -> bool:
    """Whether a branch that holds this path is to go; inside an article only styled branches below it are."""
    names = path.split(">")
    tags = [re.split("[.#]", n, maxsplit=1)[0] for n in names]
    first = max((k for k, t in enumerate(tags) if t in MAIN), default=0) + 1 if main else 1
    return any(">".join(names[:k + 1]) in low for k in range(first, len(names))
               if tags[k] not in ("html", "body") and not (main and names[k] == tags[k]))
