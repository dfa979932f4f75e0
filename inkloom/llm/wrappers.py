"""HTML extraction through wrappers inferred from a host's pages.

A page is parsed into its stream of elements and texts. A host's wrapper is a union-free regular expression over such streams: a sequence of elements (each
with a sequence of its own) and text slots, where an item can be optional or repeated. It is inferred by aligning streams again and again: runs of like
elements become repeated groups, items that only one side has become optional, and texts become slots.

Extraction goes through the wrapper: every page's stream is matched against its host's expression, which binds each text to a slot, and a slot's role decides
whether its texts belong to the article. A page that no wrapper matches has no article slots. Roles come from what the host's pages put into the slots:
the article lies in `article` or `main` elements if the wrapper has any, else in the deepest element that holds most of the host's varying text (links
don't count); slots that hold one text on all of several different pages are the template's; groups that are mostly links are menus. The elements and ARIA
roles that HTML defines as furniture (nav, footer, aside, form and so on) are left out. Words in classes and ids decide only what no statistic tells: whether a
smaller part of the varying text is an advert, a notice or readers' comments, and on a host with one single content where its article is. A part that holds half of
the host's varying text is never furniture by its words.

What bounds a task's memory: a page, and the expressions of FAN structures of one host, whatever their number; a host's structures are merged as a tree, FAN at a
time, and equal ones are one before each round. Slot statistics are aggregated before the shuffle, copies of a page count once, and a host with a third of all pages
meets only as its distinct structures and its slots' sums. A page's time is linear in its length; nothing is cut from very long pages.

Defined cases: a null or empty page has no text; a page without a host belongs to the host ''; a page whose host keeps articles but that has none itself
gives all its text outside the furniture, and the template's texts if it has nothing else; elements nested deeper than DEPTH that are neither furniture nor an article are
seen through (their texts stay, in order); repeated rows are extracted each; ties between structures are settled by the structures themselves; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.common import written

#: Fixed values of HTML: elements without content, inline elements, elements whose content is not text, elements that end an open one.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
#: Fixed values of page furniture: elements, ARIA roles, and words in classes and ids.
FURNITURE = frozenset("nav header footer aside form script style noscript template head title menu select button input textarea iframe svg math dialog search object audio video canvas".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
FURNITURE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus discussion footer gdpr header legal login masthead menu menus modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion promoted related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split())
ARTICLE_WORDS = frozenset("article content entry post story main maincontent articlebody".split())
#: Elements of running text, whose ids come from titles, and elements that mean nothing by themselves.
TITLED = INLINE | frozenset("h1 h2 h3 h4 h5 h6 section p".split())
PLAIN = frozenset("div section td center body html".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
BLANKS = re.compile(r"\s+")
#: Structures of a host that one task merges at a time, and the depth from which plain elements are seen through.
FAN = 16
DEPTH = 60
PERIODS = (1, 2, 3)
#: The share of a host's varying text that makes an element its article, the share below which words may call a part furniture, and the share of links that makes a menu.
MOST, PART, LINKS = 0.7, 0.5, 0.6


def symbol_of(tag: str, attributes: str) -> str:
    """The tag, with the words of its class, id and role (without numbers); "=" marks a whole class that is a word of furniture."""
    words = set()
    if "=" in attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            value = html.unescape("".join(values)).lower()
            if name.lower() == "class":
                words.update("=" + w for w in value.split() if w in FURNITURE_WORDS)
            for w in re.split(r"[\s_\-]+", value):
                w = re.sub(r"\d+", "", w)
                if w:
                    words.add(("@" if name.lower() == "role" else "") + re.sub(r"[/\.\[\]@]", "", w))
    return ".".join([tag, *sorted(words)])


def by_markup(symbol: str, in_article: bool) -> bool:
    """Furniture by its element or its ARIA role; an article's own header is not."""
    tag, *words = symbol.split(".")
    return tag in FURNITURE and not (tag == "header" and in_article) or any(w[:1] == "@" and w[1:] in FURNITURE_ROLES for w in words) and tag not in ("html", "body")


def by_words(symbol: str, in_article: bool) -> bool:
    """Furniture by words of its class and id. In an article headings, sections and paragraphs are so only by a whole class, and inline elements not at all."""
    tag, *words = symbol.split(".")
    if tag in ("html", "body"):
        return False
    if in_article and tag in TITLED:
        return tag not in INLINE and any(w[:1] == "=" for w in words)
    return any(w in FURNITURE_WORDS for w in words)


def is_article(symbol: str) -> int:
    """How surely an element is a page's article: 3 article, 2 main, 1 by its words, 0 not."""
    tag, *words = symbol.split(".")
    if tag == "article" or "@article" in words:
        return 3
    if tag == "main" or "@main" in words:
        return 2
    return int(tag in ("div", "section", "td") and any(w in ARTICLE_WORDS for w in words))


class _Symbols(dict):
    """What is asked of each element, by its tag and attributes: symbol, whether it is furniture, how surely an article."""

    def __missing__(self, key: tuple[str, str]) -> tuple[str, bool, int]:
        symbol = symbol_of(*key)
        found = symbol, by_markup(symbol, True) or by_words(symbol, True), is_article(symbol)
        if len(self) < 50_000 and len(key[1]) < 300:
            self[key] = found
        return found


_symbols = _Symbols()


def parse(page: str) -> tuple[list, list[tuple[str, bool]]]:
    """A page's stream as nested items [symbol, inner, texts], text items being ["#", [], numbers]; and its texts with whether each is a link.

    White space is one blank; a text that begins a block begins with a blank.
    """
    root: list = []
    tags: list[str] = []
    homes: list[list] = [root]
    kept: list[tuple[bool, int]] = []
    texts: list[tuple[str, bool]] = []
    at, fresh, blank, linked, lower = 0, True, False, False, None

    def pop() -> str:
        homes.pop()
        kept.pop()
        return tags.pop()

    while at < len(page):
        found = TOKEN.search(page, at)
        text = page[at : found.start() if found else len(page)]
        if text:
            text = BLANKS.sub(" ", html.unescape(text))
            if text == " ":
                blank = True
            else:
                home = homes[-1]
                if not home or home[-1][0] != "#":
                    home.append(["#", [], []])
                home[-1][2].append(len(texts))
                texts.append((" " + text if fresh or blank else text, linked))
                fresh = blank = False
        if not found:
            break
        at = found.end()
        close, tag, attributes = found[1], found[2], found[3]
        if not tag:
            continue
        tag = tag.lower()
        if close:
            if tag == "a":
                linked = False
            if tag in tags:
                while True:
                    gone = pop()
                    fresh = fresh or gone not in INLINE
                    if gone == tag:
                        break
            continue
        if tag in ENDS_P and "p" in tags:
            while "p" in tags:
                pop()
            fresh = True
        for other in ENDS.get(tag, ()):
            scope = max((i for i, t in enumerate(tags) if t in SCOPES[tag]), default=-1)
            if other in tags[scope + 1 :]:
                to = scope + 1 + tags[scope + 1 :].index(other)
                while len(tags) > to:
                    pop()
                fresh = True
        if tag in VOID:
            if tag in ("br", "hr"):
                blank, fresh = True, fresh or tag == "hr"
            continue
        if tag == "a":
            linked = True
        low = attributes.lower()
        symbol, furniture, article = _symbols[tag, attributes if "class" in low or "id" in low or "role" in low else ""]
        if tag in INLINE and not furniture:
            continue
        fresh = fresh or tag not in INLINE
        if tag in RAW:  # its content is no text of the page
            if lower is None:
                lower = page.lower()
            stop = lower.find(f"</{tag}", at)
            end = page.find(">", stop) if stop >= 0 else -1
            at, fresh = end + 1 if end >= 0 else len(page), True
            continue
        in_furniture, in_article = kept[-1] if kept else (False, 0)
        tags.append(tag)
        if len(homes) <= DEPTH or furniture and not in_furniture or article > in_article:
            item = [symbol, [], []]
            homes[-1].append(item)
            homes.append(item[1])
        else:
            homes.append(homes[-1])
        kept.append((in_furniture or furniture, max(in_article, article)))
    return root, texts


def structure(page: str) -> tuple[list, list[tuple[str, bool]]]:
    """A page's own expression: items [symbol, optional, repeated, inner], runs folded; and its texts."""
    folds = lambda raw: folded([[s, 0, 0, folds(inner)] for s, inner, _ in raw])
    raw, texts = parse(page)
    return folds(raw), texts


def kinds(item: list) -> frozenset[str]:
    """The symbols right inside an item."""
    return frozenset(s for x in item[3] for s in (kinds(x) if x[0][0] == "(" else (x[0],)))


def likeness(a: frozenset[str], b: frozenset[str]) -> float:
    return len(a & b) / len(a | b) if a and b else 1.0


def same(a: list, b: list) -> bool:
    """Whether two neighbours may be one repeated item: elements that mean nothing by themselves need like contents too."""
    return a[0] == b[0] and (a[0].split(".")[0] not in PLAIN or likeness(kinds(a), kinds(b)) >= 0.5)


def folded(items: list) -> list:
    """Items with the runs of like groups (of up to 3 items) as one repeated group; insides are folded already."""
    for period in PERIODS:
        out, i = [], 0
        while i < len(items):
            first, n = items[i : i + period], 1
            while len(first) == period and len(more := items[i + n * period : i + (n + 1) * period]) == period and all(map(same, first, more)):
                n += 1
            if n == 1:
                out.append(items[i])
                i += 1
                continue
            group = first
            for k in range(1, n):
                group = [joined(a, b) for a, b in zip(group, items[i + k * period : i + (k + 1) * period])]
            out.append([group[0][0], group[0][1], 1, group[0][3]] if period == 1 else ["(" + " ".join(x[0] for x in first) + ")", 0, 1, group])
            i += n * period
        items = out
    return items


def joined(a: list, b: list) -> list:
    """Two items of one symbol as one."""
    return [a[0], a[1] | b[1], a[2] | b[2], aligned(a[3], b[3])]


def aligned(left: list, right: list) -> list:
    """An expression that matches what either side matches: their common items in order (those with the most alike contents), all others optional."""
    if left == right:
        return left
    n, m = len(left), len(right)
    a, b = [kinds(x) for x in left], [kinds(x) for x in right]

    def gain(i: int, j: int) -> float:
        if left[i][0] != right[j][0]:
            return 0.0
        like = likeness(a[i], b[j])
        return 0.0 if not like and left[i][0].split(".")[0] in PLAIN - {"html", "body"} else 1.0 + like

    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    gains = [[gain(i, j) for j in range(m)] for i in range(n)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            met = best[i + 1][j + 1] + gains[i][j] if gains[i][j] else 0.0
            best[i][j] = max(met, best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and gains[i][j] and best[i][j] == best[i + 1][j + 1] + gains[i][j]:
            out.append(joined(left[i], right[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append([left[i][0], 1, *left[i][2:]])
            i += 1
        else:
            out.append([right[j][0], 1, *right[j][2:]])
            j += 1
    # A new neighbour may be like the item beside it: the run is one repeated group.
    return folded(out)


def expression(items: list) -> str:
    """A wrapper in regular expression notation."""
    show = lambda s, inner: "#text" if s == "#" else f"({expression(inner)})" if s[0] == "(" else f"<{s}>{expression(inner)}</{s.split('.')[0]}>"
    return "".join(f"({x})" + "+" * r + "?" * o if r or o else x for s, o, r, inner in items for x in [show(s, inner)])


class Matcher:
    """One level of a wrapper, ready to match: its positions, and which position may follow which. Slots are numbered in the wrapper's order."""

    def __init__(self, items: list, slots: list[int] | None = None):
        self.symbols: dict[str, list[int]] = {}
        self.below: list[Matcher | int] = []
        self.kinds: list[frozenset[str]] = []
        self.follow: list[set[int]] = []
        self.empty, self.first, self.last = self._sequence(items, slots if slots is not None else [0])

    def _sequence(self, items: list, slots: list[int]) -> tuple[bool, set[int], set[int]]:
        empty, first, last = True, set(), set()
        for item in items:
            symbol, optional, repeated, inner = item
            if symbol[0] == "(":
                can, opens, ends = self._sequence(inner, slots)
            else:
                p = len(self.below)
                self.symbols.setdefault(symbol, []).append(p)
                self.below.append(slots[0])
                self.kinds.append(kinds(item))
                self.follow.append(set())
                if symbol == "#":
                    slots[0] += 1
                else:
                    self.below[p] = Matcher(inner, slots)
                can, opens, ends = False, {p}, {p}
            if repeated:
                for p in ends:
                    self.follow[p] |= opens
            for p in last:
                self.follow[p] |= opens
            first |= opens if empty else set()
            can = can or bool(optional)
            last = last | ends if can else ends
            empty = empty and can
        return empty, first, last

    def match(self, raw: list, memo: dict | None = None) -> list[tuple[int, int]] | None:
        """(text, slot) of every text of the stream `raw`; null if the expression doesn't match it. Of several ways the one whose elements' contents are most alike."""
        memo = {} if memo is None else memo
        key = id(raw), id(self)
        if key in memo:
            return memo[key]
        memo[key] = None
        now: dict[int, tuple[float, tuple | None]] = {}
        for k, (symbol, inner, texts) in enumerate(raw):
            then, now = now, {}
            near = frozenset(x[0] for x in inner)
            for p in self.symbols.get(symbol, ()):
                before = [x for q, x in then.items() if p in self.follow[q]] if k else [(0.0, None)] if p in self.first else []
                if not before:
                    continue
                below = self.below[p]
                bound = [(t, below) for t in texts] if symbol == "#" else below.match(inner, memo)
                if bound is not None:
                    score, chain = max(before, key=lambda x: x[0])
                    now[p] = score + likeness(near, self.kinds[p]), (bound, chain)
            if not now:
                return None
        ways = [x for p, x in now.items() if p in self.last] if raw else [(0.0, None)] if self.empty else []
        if not ways:
            return None
        chain, out = max(ways, key=lambda x: x[0])[1], []
        while chain:
            out += chain[0]
            chain = chain[1]
        memo[key] = out
        return out


def slots(items: list, path: tuple = (), number: list[int] | None = None) -> Iterator[tuple[tuple[int, str], ...]]:
    """The elements, (number, symbol), around each of a wrapper's text slots, in order."""
    number = number if number is not None else [0]
    for s, _, _, inner in items:
        if s == "#":
            yield path
        elif s[0] == "(":
            yield from slots(inner, path, number)
        else:
            number[0] += 1
            yield from slots(inner, (*path, (number[0], s)), number)


def roles(items: list, stats: dict[int, tuple[bool, int, int]], contents: int) -> list[int]:
    """The role of each slot: 2 in the host's article, 1 outside it and outside the furniture, 3 the template's or a menu's (read only where a page has nothing else), 0 furniture.

    stats: by slot, whether it holds one text on all contents, its characters, and those of links. contents: how many different pages the host has.
    """
    found = list(slots(items))
    several = contents > 1
    constant = [several and stats.get(k, (False, 0, 0))[0] for k in range(len(found))]
    chars = [stats.get(k, (False, 0, 0))[1] for k in range(len(found))]
    links = [stats.get(k, (False, 0, 0))[2] for k in range(len(found))]
    mass: dict[int, int] = {}
    size: dict[int, list[int]] = {}
    total = 0
    for k, path in enumerate(found):
        if any(by_markup(s, any(is_article(x) > 1 for _, x in path[:i])) for i, (_, s) in enumerate(path)):
            continue
        own = 0 if constant[k] else chars[k] - links[k]
        total += own
        for node, _ in path:
            mass[node] = mass.get(node, 0) + own
            both = size.setdefault(node, [0, 0])
            both[0], both[1] = both[0] + chars[k], both[1] + links[k]

    def furniture(path: tuple, at: int, inside: bool) -> bool:
        node, symbol = path[at]
        return by_markup(symbol, inside) or by_words(symbol, inside) and not (several and total and mass.get(node, 0) >= PART * total)

    clear = lambda path, k: not any(furniture(path, i, False) for i in range(k))
    sure = max((is_article(s) for p in found for k, (_, s) in enumerate(p) if clear(p, k)), default=0)
    homes: set[int] = set()
    if sure > 1 or sure and not several:
        homes = {n for p in found for k, (n, s) in enumerate(p) if is_article(s) == sure and clear(p, k)}
    elif several and total:
        # The deepest plain element that holds most of the varying text; inside it, one that its words call the article.
        deep = [(k, n) for p in found for k, (n, s) in enumerate(p) if s.split(".")[0] in PLAIN and mass.get(n, 0) >= MOST * total and clear(p, k + 1)]
        homes = {max(deep)[1]} if deep else set()
        named = {n: mass[n] for p in found for k, (n, s) in enumerate(p) if is_article(s) and mass.get(n, 0) >= PART * total and (not homes or homes & {m for m, _ in p[:k]})}
        homes = {max(named, key=lambda n: (named[n], n))} if named else homes
    above = {n for p in found for k, (m, _) in enumerate(p) if m in homes for n, _ in p[: k + 1]}
    menu = lambda path: sure < 2 and homes and several and any(size[n][1] > LINKS * size[n][0] for n, _ in path if n in size and n not in above)
    out = []
    for k, path in enumerate(found):
        at = next((i for i, (n, _) in enumerate(path) if n in homes), None)
        bad = any(furniture(path, i, at is not None and i > at) for i in range(len(path)) if i != at)
        title = at is None and sure < 2 and homes and path and path[-1][1].split(".")[0] == "h1"
        out.append(0 if bad else 3 if menu(path) or constant[k] and (at is None or sure < 2) else 2 if at is not None or title else 1)
    return out


def host_of(url):
    """The host of a URL column, lower case; '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html", fan: int = FAN) -> DataFrame:
    """(host, wrapper) of each host: the wrapper as JSON. `fan` steers the layout of the merges."""
    show = lambda items: json.dumps(items, separators=(",", ":"), ensure_ascii=False)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [show(structure(page.as_py() or "")[0]) for page in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["host", "wrapper"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        now, *others = [json.loads(x) for x in sorted(pdf["wrapper"])]
        for other in others:
            now = aligned(now, other)
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [show(now)]})

    streams = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html")).mapInArrow(read, "host string, wrapper string")
    now = written(streams.distinct())
    while True:
        held = now.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if held.isEmpty():
            return now
        many = now.join(held.withColumnRenamed("host", "_host"), F.col("host") == F.col("_host"), "left")
        parts = many.where("n IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / fan)))
        merged = parts.select("host", "wrapper", "part").groupBy("host", "part").applyInPandas(merge, "host string, wrapper string")
        now = written(merged.unionByName(many.where("n IS NULL").select("host", "wrapper")).distinct())


def matched(pages: DataFrame, wrappers: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, host, parts) of every page: its texts in order, each with its slot in the host's wrapper (-1: the wrapper doesn't match the page), and how many of its characters are links."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    rows = rows.join(wrappers.select(F.col("host").alias("_host"), "wrapper"), F.col("host") == F.col("_host"), "left").select("id", "url", "host", "html", "wrapper")
    kind = pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string()), ("links", pa.int64())]))

    def bind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, Matcher] = {}
        for batch in batches:
            out = []
            for page, wrapper in zip(batch.column(3), batch.column(4).to_pylist()):
                if wrapper not in ready:
                    if len(ready) > 200:
                        ready.clear()
                    ready[wrapper] = Matcher(json.loads(wrapper or "[]"))
                raw, texts = parse(page.as_py() or "")
                slot = dict(ready[wrapper].match(raw) or ())
                parts: list[list] = []
                for t, (text, linked) in enumerate(texts):
                    k = slot.get(t, -1)
                    if not parts or parts[-1][0] != k:
                        parts.append([k, [], 0])
                    parts[-1][1].append(text)
                    parts[-1][2] += len(text) * linked
                out.append([{"slot": k, "text": "".join(x), "links": n} for k, x, n in parts])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, kind)], ["id", "url", "host", "parts"])

    id_type = pages.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(bind, f"id {id_type}, url string, host string, parts array<struct<slot:int,text:string,links:bigint>>")


def slot_roles(bound: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(host, roles) from the hosts' wrappers and their matched pages."""
    slim = F.transform("parts", lambda p: F.struct(p["slot"].alias("slot"), F.xxhash64(p["text"]).alias("h"), F.length(p["text"]).alias("chars"), p["links"].alias("links")))
    # Copies of a page are one content: a text is the template's if all of several contents have it.
    held = bound.where(F.size("parts") > 0).select("host", slim.alias("parts")).groupBy("host", F.xxhash64("parts").alias("content")).agg(F.first("parts").alias("parts"))
    part = held.select("host", "content", F.explode("parts").alias("p")).groupBy("host", "content", "p.slot").agg(F.sum(F.col("p.h").cast("decimal(38,0)")).alias("h"), F.sum("p.chars").alias("chars"), F.sum("p.links").alias("links"))
    stats = part.groupBy("host", "slot").agg((F.min("h") == F.max("h")).alias("one"), F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    stats = stats.groupBy("host").agg(F.collect_list(F.struct("slot", "one", "n", "chars", "links")).alias("stats"))
    counts = held.groupBy("host").agg(F.count(F.lit(1)).alias("contents"))
    rows = wrappers.join(stats, "host", "left").join(counts, "host", "left").select("host", "wrapper", "stats", F.coalesce("contents", F.lit(0)).alias("contents"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for wrapper, stats, n in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                out.append(roles(json.loads(wrapper), {s["slot"]: (s["one"] and s["n"] == n, s["chars"], s["links"]) for s in stats or ()}, n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["host", "roles"])

    return rows.mapInArrow(decide, "host string, roles array<int>")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every page: the texts bound to its host's article slots; if it has none there, its texts outside the furniture."""
    wrappers = infer(pages, url_col, html_col)
    bound = written(matched(pages, wrappers, id_col, url_col, html_col))
    of_host = written(slot_roles(bound, wrappers)).withColumnRenamed("host", "_host")
    rows = bound.join(of_host, F.col("host") == F.col("_host"), "left")

    def text(role: int):
        mine = F.filter("parts", lambda p: F.coalesce(F.get("roles", p["slot"]), F.lit(1)) == role)
        return F.nullif(F.trim(F.regexp_replace(F.array_join(F.transform(mine, lambda p: p["text"]), ""), " +", " ")), F.lit(""))

    return rows.select("id", "url", F.coalesce(text(2), text(1), text(3), F.lit("")).alias("text"))


def op10_html_wrappers(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("bigint").alias("n_chars"))
