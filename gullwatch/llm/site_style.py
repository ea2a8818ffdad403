"""Main text of pages by a style tree of their site.

Every page becomes a tree of elements; an element's style is its tag, classes and id, and
its place is the path of styles from the root. The pages of one host are laid over each
other by place. A place has two kinds of evidence over the pages that hold it: the
sequences of child styles (presentation) and the texts of the blocks in it or below it
(content). Both are judged by entropy with the number of pages as base: layouts that vary
and texts that occur on few pages are important, what every page repeats is not. Pages of a
host with one longest block count once, so that copies of an article are not taken for a
template. Places of low importance are removed from each page with all below them, inside
an article and without a name too; so is a block whose text almost every page of the host
has at its place (``REPEATED``).

Tags and names that say what an element is (menus, footers, forms, comments ...), and a
place beside an article that holds most of its page, lower the importance of a place by a
factor; a place that holds half of its pages' text keeps its own. Neither removes anything
by itself: the factor is a mean over the pages of the site, and what varies and holds the
text stays whatever its name. Below ``LEAST_PAGES`` pages a place counts as important but for
that factor. Places are counted by host, path and feature, with partial sums before each
shuffle, so that one large site is no large task.

Defined results: null or empty html gives the empty text; null urls are one host of their
own; repeated rows are extracted one by one; broken markup is read as browsers do in the
simple cases (implied ends, stray end tags, unclosed elements); extra columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gullwatch.llm.common import kept_table, pieces

#: Places with less importance go, inside an article or main element those with less than the second one.
THRESHOLD, IN_MAIN = 0.35, 0.15
#: Pages of the host from which on a place is judged by entropy.
LEAST_PAGES = 4
#: Factors of a place that its tag or its names tell apart, and of one beside an article that holds most of its page.
BY_TAG, BY_NAME, BESIDE = 0.2, 0.3, 0.3
#: Share of its pages' text from which on a place keeps its importance.
BULK = 0.5
#: A block goes whose text so large a share of the pages has at its place, of so many pages.
REPEATED, REPEATED_PAGES = 0.9, 8
#: Share of a place's importance that its texts give, those of the places below it included.
BELOW = 0.75
#: Removed places that are broadcast; more are joined by host.
MAX_PLACES = 200_000

# What elements are, by HTML's own definitions.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|iframe|textarea|svg|math|object|select|title|canvas|audio|video"
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("li dt dd td th tr tbody thead tfoot caption legend summary figcaption body html".split())
SELF_CLOSING = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "option": ("select",)}
MAIN = frozenset(("article", "main"))
WHOLE = frozenset(("#", "html", "body"))
OTHER = frozenset("nav footer header aside form menu dialog button head".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|sponsor(?:ed)?|promo|cookies?|consent|notice|popup|modal|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|comments?|disqus|replies|share|social|related|newsletter|subscribe|signup|login|pagination|pager|skip|widget)(?:$|[\s_-])"
)

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<(?P<raw>{RAW})\b(?:[^\"'>]|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|$)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)


class Element:
    __slots__ = ("children", "factor", "main", "place", "style", "tag")

    def __init__(self, tag: str, names: str, above: Element | None):
        self.tag = tag
        self.style = f"{tag} {names}" if names else tag
        self.place = xxhash.xxh3_64_intdigest(self.style, above.place if above else 0)
        self.main = tag in MAIN or bool(above and above.main)
        self.factor = BY_TAG if tag in OTHER else BY_NAME if names and NAMES.search(names) else 1.0
        self.children: list[Element] = []


class Page:
    """Elements of a page, and its blocks of text with the element each belongs to."""

    def __init__(self, source: str):
        self.root = Element("#", "", None)
        self.blocks: list[tuple[list[Element], str]] = []
        stack, parts, at = [self.root], [], 0
        owner = list(stack)

        def close() -> None:
            nonlocal owner
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                self.blocks.append((owner, text))
            parts.clear()
            owner = list(stack)

        for m in _TOKEN.finditer(source):
            if m.start() > at:
                parts.append(source[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            block = tag in BLOCKS
            if tag == "br":
                parts.append(" ")
                continue
            if block:
                close()
            if m["end"]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
            else:
                if tag in CLOSES_P:
                    self._pop(stack, "p", ())
                if tag in SELF_CLOSING:
                    names = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
                    for name in names:
                        self._pop(stack, name, SELF_CLOSING[tag])
                rest = m["rest"]
                names = " ".join(sorted(" ".join(a or b or c for _, a, b, c in _ATTRIBUTE.findall(rest)).lower().split())) if rest and "=" in rest else ""
                new = Element(tag, names, stack[-1])
                stack[-1].children.append(new)
                if tag not in VOID and not rest.endswith("/"):
                    stack.append(new)
            if block:
                owner = list(stack)
        if at < len(source):
            parts.append(source[at:])
        close()

    @staticmethod
    def _pop(stack: list[Element], tag: str, within: tuple[str, ...]) -> None:
        """End the innermost open ``tag``, not beyond an element that holds it."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                del stack[k:]
                return
            if stack[k].tag in within or not within and stack[k].tag in ("td", "th", "table", "button", "object"):
                return

    def main_text(self, removed: frozenset[int] | set[int]) -> str:
        """Blocks of which no place, nor the block itself, is removed."""
        return "\n".join(text for owner, text in self.blocks if not any(e.place in removed for e in owner) and (not removed or block_key(owner[-1].place, text) not in removed))

    def weights(self) -> dict[int, tuple[float, float]]:
        """Share of the page's text and factor of every place."""
        total = sum(len(text) for _, text in self.blocks) or 1
        share: dict[int, float] = {}
        holds, main = set(), 0
        for owner, text in self.blocks:
            for place in {e.place for e in owner}:
                share[place] = share.get(place, 0.0) + len(text) / total
            if owner[-1].main:
                main += len(text)
                holds.update(e.place for e in owner)
        ruled = main / total >= BULK
        out, todo = {}, [self.root]
        while todo:
            e = todo.pop()
            beside = BESIDE if ruled and not e.main and e.place not in holds else 1.0
            if e.tag not in WHOLE:  # the page itself is not judged
                out[e.place] = (share.get(e.place, 0.0), min(e.factor, beside))
            todo += e.children
        return out

    def subject(self) -> int:
        """Hash of the longest block, which copies of an article share."""
        return xxhash.xxh3_64_intdigest(max((text for _, text in self.blocks), key=lambda t: (len(t), t), default=""))


def block_key(place: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(text, place)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Kinds of evidence: child styles, a block's text in or below the place, the place itself.
LAYOUT, TEXT, PLACE = range(3)
#: Parts into which shares and factors are rounded where they travel.
PARTS = 1 << 20
_EVIDENCE = "host long, place long, kind int, feature long, subject long, value long"


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each place and feature of a page; ``value`` packs share, factor and whether the place is in a main element."""
    for batch in pieces(batches, "html"):
        rows: list = []
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = set()
            page = Page(source or "")
            subject = _signed(page.subject())
            todo, main = [page.root], {}
            while todo:
                e = todo.pop()
                main[e.place] = e.main
                if e.tag not in WHOLE:
                    own.add((e.place, LAYOUT, _signed(xxhash.xxh3_64_intdigest("|".join(c.style for c in e.children)))))
                todo += e.children
            for owner, text in page.blocks:
                own.update((e.place, TEXT, _signed(block_key(e.place, text))) for e in owner if e.tag not in WHOLE)
            rows += [(host, _signed(place), kind, feature, subject, 0) for place, kind, feature in own]
            for place, (share, factor) in page.weights().items():
                rows.append((host, _signed(place), PLACE, 0, subject, (round(share * PARTS) << 32) | (round(factor * PARTS) << 1) | main[place]))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        names = ["host", "place", "kind", "feature", "subject", "value"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def host_of(url: Column) -> Column:
    """Hash of the host of a url."""
    return F.xxhash64(F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit("")))


def feature_counts(pages: DataFrame) -> DataFrame:
    """Features by the number ``c`` of pages of different subjects that have them at a place of their host.

    Features of one page are told apart no longer: a row stands for ``times`` of them.
    """
    own = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    keys = ["host", "place", "kind", "feature"]
    # by subject first, so that a feature of many pages is spread and added up before it is dealt out
    once = own.mapInArrow(_evidence, _EVIDENCE).groupBy(*keys, "subject").agg(F.max("value").alias("value"))
    counts = once.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("c"),
        F.sum(F.shiftright("value", 32)).alias("share"),
        F.sum(F.shiftright("value", 1).bitwiseAND(F.lit((1 << 31) - 1))).alias("factor"),
        F.max(F.col("value").bitwiseAND(F.lit(1))).alias("main"),
    )
    told = F.when(F.col("c") > 1, F.col("feature"))
    return counts.groupBy("host", "place", "kind", told.alias("feature"), "c").agg(F.count(F.lit(1)).alias("times"), F.sum("share").alias("share"), F.sum("factor").alias("factor"), F.max("main").alias("main"))


def importances(counts: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, place, pages, entropy, importance and main of every place of every host's style tree."""

    def of(kind: int, value: Column) -> Column:
        return F.sum(F.when(F.col("kind") == kind, value).otherwise(0.0))

    c, times = F.col("c").cast("double"), F.col("times")
    sums = counts.groupBy("host", "place").agg(
        of(PLACE, c * times).alias("pages"), of(PLACE, F.col("share") / PARTS).alias("share"), of(PLACE, F.col("factor") / PARTS).alias("factor"), (F.max("main") == 1).alias("main"),
        of(LAYOUT, c * times).alias("layouts"), of(LAYOUT, c * F.log(c) * times).alias("layout_logs"), of(TEXT, c * times).alias("texts"), of(TEXT, c * F.log(c) * times).alias("text_logs"),
    ).where("pages > 0")
    base = F.log("pages")

    def spread(total: Column, logs: Column) -> Column:
        """1 less the mean log of a feature's pages, on the scale of all pages."""
        return 1 - F.least(F.lit(1.0), F.coalesce(F.try_divide(logs, total * base), F.lit(0.0)))

    presentation = spread(F.col("layouts"), F.col("layout_logs"))
    content = F.when(F.col("texts") > 0, spread(F.col("texts"), F.col("text_logs")))
    entropy = F.when(content.isNull(), presentation).otherwise((1 - BELOW) * presentation + BELOW * content)
    judged = F.when((F.col("pages") >= least_pages) & (F.col("pages") > 1), entropy).otherwise(1.0)
    lowered = F.when(F.col("share") / F.col("pages") >= BULK, 1.0).otherwise(F.col("factor") / F.col("pages"))
    return sums.select("host", "place", F.col("pages").cast("long").alias("pages"), judged.alias("entropy"), (judged * lowered).alias("importance"), "main")


def removals(counts: DataFrame, threshold: float = THRESHOLD, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host and key of every place and block that goes."""
    judged = importances(counts, least_pages)
    places = judged.where(F.col("importance") < F.when(F.col("main"), F.lit(min(threshold, IN_MAIN))).otherwise(F.lit(threshold))).select("host", F.col("place").alias("key"))
    often = counts.where((F.col("kind") == TEXT) & (F.col("c") >= REPEATED * REPEATED_PAGES)).select("host", "place", "feature", "c")
    blocks = often.join(judged.where(F.col("pages") >= REPEATED_PAGES).select("host", "place", "pages"), ["host", "place"])
    return places.unionAll(blocks.where(F.col("c") >= REPEATED * F.col("pages")).select("host", F.col("feature").alias("key")))


def _extract(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    """``table``: broadcast removed places by host, or None where each row carries its own."""
    for batch in pieces(batches, "html"):
        get = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()
        own = get("removed") if table is None else (table.value.get(h, frozenset()) for h in get("host"))
        texts = [Page(source or "").main_text({x % (1 << 64) for x in gone or ()}) for source, gone in zip(get("html"), own)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url")), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extract(pages: DataFrame, threshold: float = THRESHOLD, least_pages: int = LEAST_PAGES, max_places: int = MAX_PLACES) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    spark = pages.sparkSession
    removed = kept_table(removals(kept_table(feature_counts(pages), "places"), threshold, least_pages), "removed")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    schema = "page_id long, url string, text string, n_chars long"
    rows = removed.limit(max_places + 1).collect()
    if len(rows) <= max_places:
        by_host: dict[str, set[int]] = {}
        for r in rows:
            by_host.setdefault(r.host, set()).add(r.key)
        table = spark.sparkContext.broadcast(by_host)
        return own.mapInArrow(lambda b: _extract(b, table), schema)
    lists = removed.groupBy("host").agg(F.collect_set("key").alias("removed"))
    return own.join(lists, "host", "left").mapInArrow(lambda b: _extract(b, None), schema)
