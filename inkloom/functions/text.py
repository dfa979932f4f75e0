"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that the overlap tokenizer and the query terms take, and the words that query terms leave out.
CJK = "\\u4e00-\\u9fff"
OVERLAP_TOKEN = f"[{CJK}]+|[a-z0-9_]+"
QUERY_TOKEN = f"[{CJK}a-z0-9_]+"


def no_blanks(text: Column) -> Column:
    """The text without any (Unicode) white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    """Characters that are not white space."""
    return F.length(no_blanks(text))


def name_key(name: Column, lower: bool = True) -> Column:
    key = no_blanks(name)
    return F.lower(key) if lower else key


def overlap_tokens(text: Column) -> Column:
    """Distinct tokens: Latin words, CJK runs, and the character pairs inside CJK runs."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    is_cjk = lambda w: w.rlike(f"^[{CJK}]") & (F.length(w) >= 2)

    def with_pairs(words: Column) -> Column:
        pairs = F.flatten(F.transform(F.filter(words, is_cjk), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))))
        # Only a text that has such characters at all is looked through word by word.
        return F.array_distinct(F.when(F.exists(words, lambda w: w >= "\u4e00"), F.concat(words, pairs)).otherwise(words))

    return F.transform(F.array(F.regexp_extract_all(lower, F.lit(OVERLAP_TOKEN), F.lit(0))), with_pairs)[0]


def query_terms(text: Column, stopwords: list[str]) -> Column:
    """A question's terms in order: CJK runs are cut at stop words (longest first), single CJK characters and stop words are left out."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(QUERY_TOKEN), F.lit(0))
    stops = F.array(*map(F.lit, stopwords)) if stopwords else F.array().cast("array<string>")
    cut = "|".join(sorted((w for w in stopwords if w), key=len, reverse=True)) or "(?!)"
    cjk = lambda w: w.rlike(f"^[{CJK}]+$")

    def parts(w: Column) -> Column:
        found = F.filter(F.split(w, cut), lambda x: x != "")
        return F.when(cjk(w) & (F.size(found) > 0), found).otherwise(F.array(w))

    flat = F.flatten(F.transform(words, parts))
    return F.array_distinct(F.filter(flat, lambda x: ~F.array_contains(stops, x) & ~((F.length(x) == 1) & cjk(x))))


def coverage(terms: Column, text: Column) -> Column:
    """The share of terms that a text contains; 0 without terms."""
    hits = F.size(F.filter(terms, lambda t: F.contains(text, t)))
    return hits / F.greatest(F.size(terms), F.lit(1))


def overlap_score(query: Column, document: Column) -> Column:
    """The share of the query's tokens that a document has too."""
    return F.size(F.array_intersect(query, document)) / F.greatest(F.size(query), F.lit(1))


def split_aliases(text: Column) -> Column:
    """Aliases parted by slashes, trimmed, distinct, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "/"), lambda x: F.trim(x)), lambda x: x != ""))


def keyword_excerpt(text: str, keyword: str, around: int = 120) -> Column:
    """SQL names in, the stretch of `around` characters on both sides of the keyword's first hit out; without a hit, the beginning."""
    at = f"instr({text}, {keyword})"
    return F.expr(f"CASE WHEN {at} > 0 THEN substring({text}, greatest(1, {at} - {around}), least({at}, {around} + 1) - 1 + length({keyword}) + {around}) ELSE substring({text}, 1, {2 * around}) END")


def escaped_html(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


#: How a claim stands out inside its excerpt, and above one that hasn't got it.
MARK = "color:#67e8f9;font-weight:700;background:rgba(8,145,178,0.16);padding:0 0.14rem;border-radius:0.22rem;"
HEAD = "color:#67e8f9;font-weight:700;margin-bottom:0.45rem;"


def highlighted(excerpt: Column, claim: Column) -> Column:
    """An excerpt as HTML with the first place of its claim marked; a claim that isn't in it stands above it."""
    shown = lambda c: F.replace(escaped_html(trimmed(c)), F.lit("\n"), F.lit("<br>"))

    def whole(pair: Column) -> Column:
        e, c = pair["e"], pair["c"]
        at = F.instr(e, c)
        marked = F.concat(F.substring(e, F.lit(1), at - 1), F.lit(f'<span style="{MARK}">'), c, F.lit("</span>"), F.substring(e, at + F.length(c), F.length(e)))
        above = F.concat(F.lit(f'<div style="{HEAD}">'), c, F.lit("</div><div>"), e, F.lit("</div>"))
        return F.when((e == "") | (c == ""), e).when(at > 0, marked).otherwise(above)

    return F.transform(F.array(F.struct(shown(excerpt).alias("e"), shown(claim).alias("c"))), whole)[0]


def question(text: Column) -> Column:
    """A trimmed question, ended by a question mark."""
    clean = trimmed(text)
    return F.when(clean == "", clean).when(clean.rlike("[？?。]$"), clean).otherwise(F.concat(clean, F.lit("？")))


def file_stem(name: Column) -> Column:
    """A name that is safe in file systems."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r'[\\/:*?"<>|\s]+', "_")), F.lit("")), F.lit("untitled"))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("bigint")


def truncated(text: Column, limit: int, marker: str = "...") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)


def description_lines(items: Column) -> Column:
    """Lines `name：description` of an array of structs; without a description only the name."""
    line = lambda x: F.when(F.coalesce(x["description"], F.lit("")) == "", x["name"]).otherwise(F.concat(x["name"], F.lit("："), x["description"]))
    return F.array_join(F.transform(items, line), "\n")


def embedding_name(name: Column, aliases: Column, most: int = 3) -> Column:
    """A name and up to three other aliases."""
    others = F.slice(F.filter(F.array_distinct(aliases), lambda a: (a != name) & (a != "")), 1, most)
    return F.array_join(F.concat(F.array(name), others), "、")


#: What a heading of a chapter or a section is.
HEADING = r"\s*第[0-9零一二三四五六七八九十百千万两〇]+[章节][^\n\r]*\s*"


def _lines(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n"), lambda x: x)


def heading(text: Column) -> Column:
    """The heading that a text begins with: its first non-blank line, or the first two or three joined, if that is one; null without."""
    full = F.filter(F.transform(_lines(text), lambda x: F.trim(x)), lambda x: x != "")
    of = lambda k: F.array_join(F.slice(full, 1, k), " ")
    return F.coalesce(*[F.when(of(k).rlike(f"^{HEADING}$"), of(k)) for k in (1, 2, 3)])


def without_heading(text: Column, title: Column) -> Column:
    """A text without the heading that it begins with, on one line or two; trimmed."""
    lines = F.transform(_lines(text), lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("line"), x.alias("raw")))

    def cut(all_: Column) -> Column:
        full = F.filter(all_, lambda s: s["line"] != "")
        two = F.concat_ws(" ", F.get(full, F.lit(0))["line"], F.get(full, F.lit(1))["line"])
        name = F.trim(F.coalesce(title, F.lit("")))
        after = F.when(name == "", -1).when((F.size(full) >= 2) & (two == name), F.get(full, F.lit(1))["i"]).when(F.get(full, F.lit(0))["line"] == name, F.get(full, F.lit(0))["i"]).otherwise(-1)
        return trimmed(F.array_join(F.transform(F.filter(all_, lambda s: s["i"] > F.coalesce(after, F.lit(-1))), lambda s: s["raw"]), "\n"))

    return F.transform(F.array(lines), cut)[0]


def takes_docs(headed: Column, docs: Column, sliced: Column) -> Column:
    """Whether a book's files are its chapters: enough of them have headings, or slicing its text finds one chapter at most."""
    return (headed >= F.greatest(F.lit(3), F.floor(docs / 3))) | (sliced <= 1)


def brief(items: Column, most: int, none: str = "无") -> Column:
    """The first texts of a list, joined; a word for none."""
    full = F.array_distinct(F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))
    return F.when(F.size(full) > 0, F.array_join(F.slice(full, 1, most), "；")).otherwise(none)


def entity_card(items: Column, most: int = 4, records: int = 2) -> Column:
    """The first four entities (array<struct<name, records: array<string>>>) with two records each, as one line."""
    one = lambda x: F.trim(F.when(F.size(x["records"]) > 0, F.concat(x["name"], F.lit(": "), F.array_join(F.slice(x["records"], 1, records), "；"))).otherwise(x["name"]))
    shown = F.filter(F.transform(F.slice(F.coalesce(items, F.array().cast("array<struct<name:string,records:array<string>>>")), 1, most), one), lambda x: x != "")
    return F.when(F.size(shown) > 0, F.array_join(shown, "；")).otherwise("无")


def plot_card(number: Column, title: Column, summary: Column, special: Column, organizations: Column, rules: Column) -> Column:
    """What a plot shows when plots are grouped into volumes."""
    line = lambda head, c: F.concat(F.lit(f"{head}: "), F.coalesce(c, F.lit("")))
    return F.concat_ws("\n", F.concat(F.lit("Plot "), number.cast("string")), line("Title", title), line("Summary", summary), line("SpecialExistence", entity_card(special)), line("Organizations", entity_card(organizations)), line("WorldRules", entity_card(rules)))


def deltas(items: Column, notes: dict[str, str], most: int = 4) -> Column:
    """How the first four of `items` (array of structs with a name) changed: the three first texts of each list that `notes` names, under its word."""
    of = lambda x: F.array_compact(F.array(*[F.when(brief(x[c], 3) != "无", F.concat(F.lit(f"{word}="), brief(x[c], 3))) for c, word in notes.items()]))
    one = lambda x: F.concat(F.trim(x["name"]), F.lit(": "), F.when(F.size(of(x)) > 0, F.array_join(of(x), " | ")).otherwise("无明显变化"))
    shown = F.transform(F.filter(F.slice(items, 1, most), lambda x: F.trim(F.coalesce(x["name"], F.lit(""))) != ""), one)
    return F.when(F.size(shown) > 0, F.array_join(shown, "；")).otherwise("无")


def message_text(parts: Column) -> Column:
    """The text of a message in parts (array<struct<text, content>>): each part's text, or its content, a line each."""
    each = F.transform(parts, lambda p: F.coalesce(F.nullif(F.trim(p["text"]), F.lit("")), F.nullif(F.trim(p["content"]), F.lit("")), F.lit("")))
    return F.array_join(F.filter(each, lambda x: x != ""), "\n")


def labelled_lines(**values: Column) -> Column:
    """Lines `label: value` of the values that say something; lists and structs as JSON."""
    return F.concat_ws("\n", *[F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{name}: "), v)) for name, v in values.items()])
