"""The queries without SQL, over whole small tables, against plain Python."""

import collections
import html.parser
import re

import pytest
import regex

from inkloom.plans import registry

TOKEN = re.compile("[一-鿿]+|[a-z0-9_]+")


def tokens(text):
    words = TOKEN.findall((text or "").lower())
    pairs = [w[i : i + 2] for w in words if "一" <= w[0] <= "鿿" and len(w) >= 2 for i in range(len(w) - 1)]
    return list(dict.fromkeys([*words, *pairs]))


@pytest.fixture(scope="module")
def chapters(spark, small):
    """(book, chapter, doc, text) by hand: sources in code point order are books, their documents by id are chapters."""
    rows = sorted((r.source, r.doc_id, r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").select("source", "doc_id", "text").collect())
    books = {s: i for i, s in enumerate(sorted({s for s, _, _ in rows}), 1)}
    seen = collections.Counter()
    out = []
    for s, d, t in rows:
        seen[s] += 1
        out.append((books[s], seen[s], d, t))
    return out


def test_plot_entity_merge(spark, small, chapters):
    plots = collections.defaultdict(list)
    for book, chapter, _, text in chapters:
        found = dict.fromkeys(m.group(0) for m in regex.finditer(r"(\p{Lu}\p{Ll}{3,}) (\p{L}{4,})", text))
        plots[book, (chapter - 1) // 5 + 1] += [(chapter, k, n.split(" ")[0], n.split(" ")[-1]) for k, n in enumerate(found)]
    key = lambda s: re.sub(r"\s+", "", s).lower()
    expected = {}
    for (book, plot), named in plots.items():
        merged = []
        for chapter, _, name, alias in sorted(named):
            spelled = [name] + ([alias] if alias != name else [])
            home = next((m for m in merged if m["keys"] & set(map(key, spelled))), None)
            if home is None:
                home = {"keys": set(), "aliases": {}, "records": set()}
                merged.append(home)
            home["keys"] |= set(map(key, spelled))
            for s in spelled:
                home["aliases"].setdefault(key(s), s)
            home["records"].add(chapter)
        expected |= {(book, plot, i): ("/".join(m["aliases"].values()), len(m["records"])) for i, m in enumerate(merged)}
    got = {(r.book_id, r.plot_id, r.place): (r.aliases, r.n_records) for r in registry.queries()["plot_entity_merge"](spark, small).collect()}
    assert got == expected and len(got) > 100


@pytest.fixture(scope="module")
def ranked(spark, small, chapters):
    """A function of the limits (kept, dense, sparse): for each passage its book's documents in final order, with fused score and share of the passage's tokens, by hand, given the embedding's vectors."""
    from pyspark.sql import functions as F

    from inkloom.models import hashed_embedding

    embed = hashed_embedding()
    docs = {r.doc_id: r.v for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", embed(F.col("text")).alias("v")).collect()}
    asked = spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text", embed(F.col("text")).alias("v")).collect()
    texts = {d: t for _, _, d, t in chapters}
    for d in list(docs)[:20]:
        assert sum(docs[d]) == len(tokens(texts[d]))
    norm = lambda v: sum(x * x for x in v) ** 0.5

    def of(kept, pool, few):
        out = {}
        for q in asked:
            mine = [d for b, _, d, _ in chapters if b == q.item_id % 20 + 1]
            cos = {d: sum(x * y for x, y in zip(docs[d], q.v)) / (norm(docs[d]) * norm(q.v) or 1) for d in mine}
            dense = sorted(cos, key=lambda d: (-round(cos[d], 12), d))[:pool]
            want = set(tokens(q.text))
            share = {d: len(want & set(tokens(texts[d]))) / max(1, len(want)) for d in dense}
            sparse = sorted((d for d in dense if share[d] > 0), key=lambda d: (-share[d], d))[:few]
            fused = {d: 1 / (60 + dense.index(d) + 1) + (1 / (60 + sparse.index(d) + 1) if d in sparse else 0) for d in dense}
            best = sorted(fused, key=lambda d: (-fused[d], d))[:kept]
            out[q.item_id] = [(d, fused[d], share[d]) for d in sorted(best, key=lambda d: (-share[d], best.index(d)))]
        return out

    return of


def test_hybrid_search(spark, small, ranked):
    got = collections.defaultdict(dict)
    for r in registry.queries()["hybrid_search"](spark, small).collect():
        got[r.query_id][r.id] = (r.final_rank, r.fused_score, r.rerank_score)
    for item, final in ranked(3, 5, 20).items():
        assert {d: (i + 1, pytest.approx(f, abs=1e-8), pytest.approx(s, abs=1e-6)) for i, (d, f, s) in enumerate(final)} == got[item]


def test_deep_search(spark, small, chapters, ranked):
    """Whole texts are searched; a hit without shared tokens counts by its rank."""
    place = {d: c for _, c, d, _ in chapters}
    got = {r.query_id: r for r in registry.queries()["deep_search"](spark, small).collect()}
    for item, final in ranked(25, 75, 100).items():
        if not final:
            assert item not in got
            continue
        score = {place[d]: (s if s > 0 else 1 / (i + 1), -i) for i, (d, _, s) in enumerate(final)}
        r = got[item]
        assert r.best_chapter == max(score, key=lambda c: score[c])
        assert r.confidence == pytest.approx(max(0.9, min(0.95, max(s for s, _ in score.values()))), abs=1e-3)
        groups = []
        for c in sorted(score):
            if groups and c - groups[-1][-1] <= 2:
                groups[-1].append(c)
            else:
                groups.append([c])
        best = max(groups, key=lambda g: (sum(score[c][0] for c in g), -g[0]))
        assert (r.start, r.end) == (best[0], min(best[-1], best[0] + 7))
        assert r.citations == "; ".join(f"Chapter {place[d]}" for d, *_ in final[:6])


class _Text(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.words = []

    def handle_data(self, data):
        self.words += data.split()


def test_html_text(spark, small):
    """Every word of the markup's texts comes out, in order, with nothing added."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in registry.queries()["html_text"](spark, small).collect():
        by_hand = _Text()
        by_hand.feed(pages[r.page_id])
        assert "".join(r.text.split()) == "".join(by_hand.words)


def test_chapter_slices(spark, small, chapters):
    """Slices hold the whole text in order, none above the limit unless no sentence ends before it; numbers are gapless."""
    texts = {d: t for _, _, d, t in chapters}
    parts = collections.defaultdict(list)
    for r in registry.queries()["chapter_slices"](spark, small).collect():
        parts[r.doc_id].append((r.chapter_index, r.word_count))
    for d, rows in parts.items():
        rows.sort()
        assert [i for i, _ in rows] == list(range(1, len(rows) + 1))
        assert sum(n for _, n in rows) == len(re.sub(r"\s+", "", texts[d]))
        if len(rows) > 1:
            assert all(n <= 2 * 3500 for _, n in rows)


def test_edge_records(spark, small, chapters):
    import hashlib

    books = collections.defaultdict(list)
    for book, chapter, _, text in chapters:
        books[book].append((chapter, hashlib.sha256(text.encode()).hexdigest()))
    expected = {(b, "first", c, n, h) for b, own in books.items() for n, (c, h) in enumerate(sorted(own)[:3], 1)}
    expected |= {(b, "last", c, n, h) for b, own in books.items() for n, (c, h) in enumerate(sorted(own)[:-4:-1], 1)}
    got = [(r.character_id, r.edge, r.chapter_index, r.nth, r.record_sha256) for r in registry.queries()["edge_records"](spark, small).collect()]
    assert sorted(got) == sorted(expected)


def test_costly_rows_are_dealt_over_tasks(spark, small):
    """Tables of one split don't go through one task where each row takes much work."""
    from inkloom.plans import registry

    for name in ("plot_metadata", "question_plans"):
        assert registry.queries()[name](spark, small).rdd.getNumPartitions() > 1


def test_entries_are_read_and_placed_once(spark, small):
    """The texts are gone through once, and entries of one place in a chapter keep their own names."""
    from inkloom.operators.entries import merged_entries

    plan = registry.queries()["plot_entity_merge"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    rows = [(1, 1, 1, 0, "Anna", "a"), (1, 1, 1, 0, "Bob", "b"), (1, 1, 2, 0, "bob（C）", "c")]
    got = {r.place: (r.name, [x.text for x in r.records]) for r in merged_entries(spark.createDataFrame(rows, "book_id bigint, plot_id bigint, chapter_index bigint, pos int, name string, description string")).collect()}
    assert got == {0: ("Anna", ["a"]), 1: ("Bob（C）", ["b", "c"])}
