"""HTML extraction with nearest-URL page differencing.

A page becomes lines: the text blocks of its element tree in order. Pages are paired by URL path within their host,
each with its neighbours in path order, and the lines of a pair are aligned by longest common subsequence. Lines that
a page shares with the nearest neighbour that isn't nearly equal to it are the site's and are deleted, with two
limits that differencing alone can't give: what markup calls furniture goes even if one page only has it, and the
lines of the container that a page marks as its article stay even if near copies share them.
"""

from __future__ import annotations

import html as entities
import os.path
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lantern.llm._storage import light, materialise

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|select|title)\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?][^>]*+>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
#: Elements whose content is never article text.
FURNITURE = frozenset("head nav aside footer button dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar".split())
#: Words that mark furniture on any element but a heading.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent modal popup newsletter subscribe sidebar share sharing breadcrumb breadcrumbs "
    "comments disqus respond masthead navbar teaser teasers".split()
)
#: Words that mark it on elements that hold others; on a paragraph, or as the name of a section, they may be the article's own.
HOLDER_MARKS = frozenset("banner notice notices alert aside nav navigation menu footer comment social related recommended toolbar widget login signup search".split())
#: Of those, words that a part of an article may bear too: inside one they count only on elements that are mostly links.
OWN_MARKS = frozenset("banner alert menu search".split())
#: Words that mark readers' comments, also as the name of a section.
READERS = frozenset("comment comments disqus respond responses replies".split())
#: Words that may follow a mark in the name of such an element, and words that turn its sense.
HOLDERS = frozenset("area bar block box buttons container content form group inner items links list panel posts articles section slot unit wrap wrapper".split())
TURNS = frozenset("with has have no non not without is".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Text-level blocks: only the plain marks count on them, and only in their class.
TEXTS = frozenset("p li dt dd pre blockquote figcaption caption summary legend address".split())
# Start tags that end open elements (elements ended, elements beyond which none is sought).
_LISTS = frozenset("ul ol menu dir table td th".split())
IMPLIED = {
    "li": (frozenset(["li"]), _LISTS),
    **dict.fromkeys(["dt", "dd"], (frozenset(["dt", "dd"]), frozenset(["dl", "table", "td", "th"]))),
    **dict.fromkeys(["td", "th"], (frozenset(["td", "th"]), frozenset(["tr", "table"]))),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    **dict.fromkeys(["tbody", "thead", "tfoot"], (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th"]), frozenset(["table"]))),
}
CLOSES_P = BLOCKS - frozenset("body html caption dd dt legend li summary tbody td tfoot th thead tr".split())
SCOPE = frozenset("table td th caption object button html".split())
#: A pair of pages of whose open characters more than this share aligns, on both sides, is one page twice: nothing is deleted.
SAME_PAGE = 0.9
#: Deleted lines of so many pages, and eight times as many lines, are broadcast; beyond it the pages are shuffled.
BROADCAST_PAGES = 200_000

#: Kinds of lines: of the marked article, of other marked containers, of the rest of the page, of furniture.
ARTICLE, SECOND, OTHER, OUT = range(4)


def _marked(tokens: list[str], marks: frozenset) -> bool:
    """Whether a whole class or id is a mark, ends in one, or is one with a holder's words after it."""
    for token in tokens:
        parts = [x for x in re.split(r"[^a-z0-9]+", token) if x]
        if parts and not TURNS & set(parts[:-1]) and (parts[-1] in marks or parts[0] in marks and HOLDERS.issuperset(parts[1:])):
            return True
    return False


class _Tree:
    """The elements of a page in order of their start tags, and its text pieces."""

    def __init__(self, page: str):
        self.name, self.parent, self.barred, self.inside = ["html"], [0], [0], [False]
        self.stack, self.open = [0], Counter(["html"])
        self.pieces: list[tuple[int, str]] = []  # (element, text); an element of -1 ends a line
        at = 0
        for m in _MARKUP.finditer(page):
            if at < m.start():
                self.pieces.append((self.stack[-1], page[at : m.start()]))
            at = m.end()
            name = (m["name"] or "").lower()
            if m["raw"]:
                self.pieces.append((self.stack[-1], " "))
            elif name and m["close"]:
                self.end(name)
            elif name:
                self.start(name, m["attributes"])
        if at < len(page):
            self.pieces.append((self.stack[-1], page[at:]))

    def line(self) -> None:
        self.pieces.append((-1, ""))

    def pop(self, k: int) -> None:
        """Close the elements of the stack from the k-th on."""
        for node in self.stack[k:]:
            self.open[self.name[node]] -= 1
            if self.name[node] in BLOCKS:
                self.line()
        del self.stack[k:]

    def close(self, names: frozenset, beyond: frozenset) -> None:
        """Close the outermost open element of these names that no element of ``beyond`` holds apart."""
        if not any(self.open[n] for n in names):
            return
        found = None
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.name[self.stack[k]]
            if name in names:
                found = k
            elif name in beyond:
                break
        if found is not None:
            self.pop(found)

    def start(self, name: str, attributes: str) -> None:
        if name in CLOSES_P:
            self.close(frozenset(["p"]), SCOPE)
        if name in IMPLIED:
            self.close(*IMPLIED[name])
        if name in BLOCKS:
            self.line()
        elif name in ("br", "img"):
            self.pieces.append((self.stack[-1], " "))
        if name in VOID or name in ("html", "body") or attributes.rstrip().endswith("/"):
            return
        top = self.stack[-1]
        self.name.append(name)
        self.parent.append(top)
        self.barred.append(self.bar(name, attributes, self.inside[top]))
        self.inside.append(self.inside[top] or name in ("article", "main"))
        self.stack.append(len(self.name) - 1)
        self.open[name] += 1

    def end(self, name: str) -> None:
        if name in BLOCKS:
            self.line()
        if name in VOID or name in ("html", "body") or not self.open[name]:
            if name == "br":
                self.pieces.append((self.stack[-1], " "))
            return
        beyond = (SCOPE if name in BLOCKS else BLOCKS) - {name}
        for k in range(len(self.stack) - 1, 0, -1):
            own = self.name[self.stack[k]]
            if own == name:
                self.pop(k)
                return
            if own in beyond and not (name == "table" or own in ("td", "th", "caption") and name in ("tr", "tbody", "thead", "tfoot")):
                return

    @staticmethod
    def bar(name: str, attributes: str, inside: bool) -> int:
        """2: furniture by its tag; 1: by its class, id or role, or a form, unless it holds the article; 0: none.

        -1: inside an article, furniture if it is mostly links.
        """
        if name in FURNITURE or name == "header" and not inside:
            return 2
        if name == "form":
            return 1
        if name == "main" or name in HEADINGS or "=" not in attributes:
            return 0
        given = {k.lower(): (a or b or c).lower().split() for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        classes, ids = given.get("class", []), given.get("id", [])
        if name == "article":
            return int(_marked(classes, MARKS | HOLDER_MARKS))
        if ROLES.intersection(given.get("role", [])):
            return 1
        if name in TEXTS or name not in BLOCKS or inside and name in ("td", "th"):
            return int(_marked(classes, MARKS))
        if inside and name == "section":
            ids = [x for x in ids if _marked([x], READERS)]
        if inside and not _marked(classes + ids, MARKS | READERS | HOLDER_MARKS - OWN_MARKS):
            return -int(_marked(classes + ids, OWN_MARKS))
        return int(_marked(classes + ids, MARKS | READERS | HOLDER_MARKS))

    def kinds(self) -> tuple[list[int], bool]:
        """The kind of each element's text, and whether the page marks its article."""
        n = len(self.name)
        size = [0] * n
        for node, piece in self.pieces:
            if node >= 0:
                size[node] += len(piece.strip())

        text, linked = list(size), [x if name == "a" else 0 for x, name in zip(size, self.name)]
        for k in range(n - 1, 0, -1):
            if self.barred[k] < 0:
                self.barred[k] = int(2 * linked[k] >= text[k])
            text[self.parent[k]] += text[k]
            linked[self.parent[k]] += text[k] if self.name[k] == "a" else linked[k]

        def unbarred() -> list[int]:
            """Text below each element that no furniture below it holds."""
            total = list(size)
            for k in range(n - 1, 0, -1):
                if not self.barred[k]:
                    total[self.parent[k]] += total[k]
            return total

        def held() -> list[int]:
            """The strongest bar of an element and those that hold it."""
            bars = list(self.barred)
            for k in range(1, n):
                bars[k] = max(bars[k], bars[self.parent[k]])
            return bars

        text, bars = unbarred(), held()
        chosen = None
        for level, name in ((0, "article"), (0, "main"), (1, "article"), (1, "main")):
            own = [k for k in range(1, n) if self.name[k] == name and not self.barred[k] and bars[k] == level and text[k]]
            best = max(own, key=lambda k: (text[k], -k), default=None)
            # A container in furniture is the article only if the rest of the page is less.
            if best is not None and (level == 0 or text[best] > text[0]):
                chosen = best
                break
        lifted = chosen
        if chosen is None:
            forms = [k for k in range(1, n) if self.name[k] == "form" and bars[k] == 1 and text[k] > text[0]]
            lifted = max(forms, key=lambda k: (text[k], -k), default=None)
        while lifted:
            self.barred[lifted] = 0
            lifted = self.parent[lifted]
        bars = held()
        above, k = set(), chosen  # what holds the article
        while k:
            above.add(k)
            k = self.parent[k]
        guarded, second, strange, out = [False] * n, [False] * n, [False] * n, [OTHER] * n
        for k in range(n):
            up = self.parent[k]
            guarded[k] = k == chosen or k > 0 and guarded[up]
            second[k] = self.name[k] in ("article", "main") or k > 0 and second[up]
            # Beside an article, further ones are teasers of other stories.
            strange[k] = chosen is not None and self.name[chosen] == self.name[k] == "article" and not guarded[k] and k not in above or k > 0 and strange[up]
            out[k] = OUT if bars[k] or strange[k] else ARTICLE if guarded[k] else SECOND if second[k] and chosen is not None else OTHER
        return out, chosen is not None


def blocks(page: str) -> tuple[list[tuple[int, str]], bool]:
    """(kind, text) of each line of a page in order, and whether the page marks its article."""
    tree = _Tree(page)
    kinds, marked = tree.kinds()
    found: list[tuple[int, str]] = []
    own: dict[bool, list] = {False: [], True: []}  # text and furniture of the line

    def flush() -> None:
        for furniture, parts in own.items():
            line = " ".join("".join(x for _, x in parts).split())
            if line:
                found.append((OUT if furniture else parts[0][0], line))
            parts.clear()

    for node, piece in tree.pieces:
        if node < 0:
            flush()
        else:
            own[kinds[node] == OUT].append((kinds[node], entities.unescape(piece)))
    flush()
    return found, marked


def article(lines: list[tuple[int, str]], marked: bool, gone: set[int] = frozenset()) -> str:
    """The text of a page: its article's lines, and others that may be its own unless they are ``gone``."""
    return "\n\n".join(text for i, (kind, text) in enumerate(lines) if kind == ARTICLE or i not in gone and may_stay(kind, marked))


def may_stay(kind: int, marked: bool) -> bool:
    """Whether the differencing decides on a line of this kind."""
    return kind == SECOND or kind == OTHER and not marked


def lcs(a: list, b: list) -> list[int]:
    """Positions in ``a`` of a longest common subsequence, by divide and conquer: memory grows with one side only."""
    lead = len(os.path.commonprefix([a, b]))
    tail = len(os.path.commonprefix([a[lead:][::-1], b[lead:][::-1]]))
    ends = [*range(lead), *range(len(a) - tail, len(a))]
    a, b = a[lead : len(a) - tail], b[lead : len(b) - tail]
    if not a or not b:
        return ends
    number = {}
    x, y = (np.array([number.setdefault(v, len(number)) for v in s]) for s in (a, b))

    def row(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        r = np.zeros(len(y) + 1, np.int32)
        for v in x:
            r[1:] = np.maximum.accumulate(np.maximum(r[1:], r[:-1] + (y == v)))
        return r

    def solve(x: np.ndarray, y: np.ndarray, base: int) -> list[int]:
        if not len(x) or not len(y):
            return []
        if len(x) == 1:
            return [base] if (y == x[0]).any() else []
        half = len(x) // 2
        cut = int(np.argmax(row(x[:half], y) + row(x[half:][::-1], y[::-1])[::-1]))
        return solve(x[:half], y[:cut], base) + solve(x[half:], y[cut:], base + half)

    return sorted(ends + solve(x, y, lead))


def parse_pages(pages: DataFrame, key: str = "page_id", url: str = "url", column: str = "html") -> DataFrame:
    """(row, host, path, body, marked, kinds, hashes, sizes) of every page: its lines by kind, hash and length.

    ``row`` tells apart rows that differ in key, URL or page; equal rows have equal results. ``body`` is the hash of
    the lines that are no furniture by markup.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                columns: tuple[list, ...] = ([], [], [], [], [])
                for x in part.column(3):
                    lines, marked = blocks(x.as_py() or "")
                    hashes = np.array([xxhash.xxh64_intdigest(t.encode()) for _, t in lines], np.uint64).view(np.int64)
                    body = hashes[[k != OUT for k, _ in lines]] if lines else hashes
                    row = (xxhash.xxh64_intdigest(body.tobytes()) - (1 << 63), marked, [k for k, _ in lines], hashes, [len(t) for _, t in lines])
                    for c, value in zip(columns, row):
                        c.append(value)
                kinds = (pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *map(pa.array, columns, kinds)], names=names)

    u = F.coalesce(pages[url].cast("string"), F.lit(""))
    rows = pages.select(
        _row(pages, key, url, column),
        F.lower(F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)).alias("host"),
        F.regexp_replace(F.regexp_replace(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", ""), r"[?#].*$", "").alias("path"),
        pages[column].cast("string").alias("html"),
    )
    names = ["row", "host", "path", "body", "marked", "kinds", "hashes", "sizes"]
    return rows.mapInArrow(run, "row long, host string, path string, body long, marked boolean, kinds array<int>, hashes array<long>, sizes array<int>")


def _row(pages: DataFrame, key: str, url: str, column: str):
    return F.xxhash64(pages[key], pages[url], pages[column]).alias("row")


def adjacent(rows: DataFrame) -> DataFrame:
    """(row, other, shared, later): each row's neighbours in (host, path, row) order on its host.

    ``shared`` counts the leading characters that their paths have in common. Rows are sorted in ranges, so a large
    host takes many tasks; each range passes on its first and last row, and those meet as one small table.
    """
    spark = rows.sparkSession
    order = ["host", "path", "row"]
    ranged = rows.select(*order).distinct().repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    ranged = materialise(ranged.withColumn("part", F.spark_partition_id()), "url-order")

    within = ranged.withColumn("before", F.struct(*[F.lag(c).over(Window.partitionBy("part").orderBy(*order)).alias(c) for c in order]))
    links = lambda df: df.filter(F.col("before.host") == F.col("host")).withColumn("shared", _common(F.col("path"), F.col("before.path")))
    edges = ranged.groupBy("part").agg(F.min(F.struct(*order)).alias("lo"), F.max(F.struct(*order)).alias("hi"))
    edges = edges.withColumn("before", F.lag("hi").over(Window.orderBy("part"))).select("lo.*", "before")
    both = links(within.select(*order, "before")).unionByName(links(edges))
    return both.select("row", F.col("before.row").alias("other"), "shared", F.lit(0).alias("later")).union(both.select(F.col("before.row"), "row", "shared", F.lit(1)))


def neighbours(rows: DataFrame) -> DataFrame:
    """(row, other): of a row's neighbours that whose path shares more of its own; ties go to the earlier."""
    return adjacent(rows).groupBy("row").agg(F.min_by("other", F.struct(-F.col("shared"), "later")).alias("other"))


def _common(a, b):
    """Length of the common prefix of two strings."""
    at = F.filter(F.sequence(F.lit(1), F.least(F.length(a), F.length(b)) + 1), lambda i: F.substring(a, F.lit(1), i) != F.substring(b, F.lit(1), i))
    return F.coalesce(F.element_at(F.when(F.size(at) > 0, at), 1) - 1, F.least(F.length(a), F.length(b)))


def open_sizes(page: dict) -> list[int]:
    """Characters of each line that markup leaves open, 0 for the others: furniture tells nothing about copies."""
    return [n if may_stay(kind, page["marked"]) else 0 for n, kind in zip(page["sizes"], page["kinds"])]


def shared_lines(own: list, sizes: list, other: list, other_sizes: list) -> set[int] | None:
    """Positions of the lines that a longest common subsequence aligns; None if the pages are nearly equal."""
    common = set(own) & set(other)
    mine = [i for i, x in enumerate(own) if x in common]
    found = {mine[i] for i in lcs([own[i] for i in mine], [x for x in other if x in common])}
    size = sum(sizes[i] for i in found)
    return None if size > SAME_PAGE * max(sum(sizes), sum(other_sizes)) else found


def differences(lines: DataFrame) -> DataFrame:
    """(row, gone): positions of the lines that a page shares with its neighbour and that aren't of its article.

    ``lines`` is a written table as from ``parse_pages``, one row each. The nearer neighbour counts, unless it is
    nearly equal to the page; then the other. Pages of a host with the same body are paired as one page.
    """
    hosted = lines.filter(F.col("host") != "")
    first = hosted.groupBy("host", "body").agg(F.min(F.struct("path", "row")).alias("first")).select("host", "body", "first.*")
    near = adjacent(first).join(lines.select(F.col("row").alias("other"), "marked", "kinds", "hashes", "sizes"), "other")
    near = near.groupBy("row").agg(F.array_sort(F.collect_list(F.struct((-F.col("shared")).alias("far"), "later", "marked", "kinds", "hashes", "sizes"))).alias("near"))  # two at most
    near = materialise(near.join(first, "row").select("host", "body", "near"), "neighbours")
    pairs = hosted.join(near, ["host", "body"]).select("row", "marked", "kinds", "hashes", "sizes", "near")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                rows, gone = [], []
                for x in batch.slice(lo, 500).to_pylist():
                    for other in x["near"]:
                        found = shared_lines(x["hashes"], open_sizes(x), other["hashes"], open_sizes(other))
                        if found is not None:
                            rows.append(x["row"])
                            gone.append(sorted(i for i in found if may_stay(x["kinds"][i], x["marked"])))
                            break
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["row", "gone"])

    return pairs.mapInArrow(run, "row long, gone array<int>").filter(F.size("gone") > 0)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", column: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page: its lines of main text in order, joined by two line feeds.

    A null or empty page, and one without main text, has an empty text. Character references are decoded and white
    space in a line becomes one space. Elements without an end tag end as HTML has it. Pages without a host, a
    neighbour or shared lines lose none; rows with equal key, URL and page count as one page for pairing and each get
    its result. Other columns are not read.

    The pages are parsed twice, so that only hashes of lines are paired and shuffled; texts travel only if the pages
    that lose lines are too many to broadcast.
    """
    lines = materialise(parse_pages(pages, key, url, column).dropDuplicates(["row"]), "lines")
    gone = materialise(differences(lines), "gone")
    deleted = gone.select(F.col("row").alias("_row"), "gone")
    if (gone.agg(F.sum(F.size("gone"))).first()[0] or 0) <= 8 * BROADCAST_PAGES:
        deleted = light(deleted, BROADCAST_PAGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [article(*blocks(x.as_py() or ""), set(own.as_py() or ())) for x, own in zip(part.column(2), part.column(3))]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(texts, pa.string())], names=["key", "url", "text"])

    rows = pages.select(_row(pages, key, url, column), pages[key].alias("key"), pages[url].alias("url"), pages[column].cast("string").alias("html"))
    kind, link = pages.schema[key].dataType.simpleString(), pages.schema[url].dataType.simpleString()
    joined = rows.join(deleted, F.col("row") == F.col("_row"), "left").select("key", "url", "html", "gone")
    made = joined.mapInArrow(run, f"key {kind}, url {link}, text string")
    return made.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
