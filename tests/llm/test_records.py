"""Chat formatting, HTML wrappers, WARC fixity and the pipeline against brute force, and their defined cases."""

import collections
import hashlib
import html
import random
import re

import duckdb
import pytest

import corpus_pipeline
from inkloom.llm import chat, fixity, mixing, pieces, quality, simhash, substrings, wrappers

CHAT = "conv_id bigint, turn bigint, role string, text string, tree string, segment int"


def conversations(seed=1):
    rng = random.Random(seed)
    texts = ["hello", "a b\\ <| <|im_start|>", "", None, "<|im_end|><|im_start|>assistant ok", "\\n\\|", "x" * 9000, "日本\nline", "back\\"]
    rows = []
    for c in range(40):
        turns = [("system", "common")] if c % 3 else []
        turns += [(rng.choice(["user", "assistant"]), rng.choice(texts)) for _ in range(rng.randrange(1, 5))]
        rows += [(c, k, r, t) for k, (r, t) in enumerate(turns)]
    rows += [(50, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(120)]  # a long one
    rows += [(60 + c, 0, "user", "copy") for c in range(30)] + [(70, 1, "assistant", None), (70, 1, None, "same turn"), (70, 1, None, "same turn"), (None, 0, "line\nbreak", "z"), (None, None, "user", "first")]
    return rows


def by_conversation(rows):
    out = collections.defaultdict(list)
    low = lambda x: (x is not None, x if x is not None else 0)
    for c, k, r, t in sorted(rows, key=lambda x: (low(x[1]), x[2] or "", x[3] or "")):
        out[c].append((r or "", t or ""))
    return out


@pytest.mark.parametrize("each", [5, 5000])
def test_chat_reads_back(spark, monkeypatch, each):
    monkeypatch.setattr(chat, "RANGE_ROWS", each)
    rows = conversations()
    vocabulary = chat.Vocabulary()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], CHAT).repartition(3)
    segments, members = chat.prefix_trees(df, vocabulary)
    got = chat.read_back(segments, members, vocabulary).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = {}
    for c, turns in by_conversation(rows).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        formatted = "".join(f"<|im_start|>{chat.escaped(r, True)}\n{chat.escaped(t)}<|im_end|>\n" for r, t in turns)
        expected[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(formatted))
    assert {r.conv: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in got} == expected


def test_chat_trees(spark, monkeypatch):
    """Each beginning is stored once, positions count the path, and ancestors are exactly the turns before."""
    monkeypatch.setattr(chat, "RANGE_ROWS", 4)
    rows, vocabulary = conversations(2), chat.Vocabulary()
    segments, _ = chat.prefix_trees(spark.createDataFrame([(*r, "x", 1) for r in rows], CHAT), vocabulary)
    segments = segments.collect()
    turns = {tuple(ts[: k + 1]) for ts in by_conversation(rows).values() for k in range(len(ts))}
    assert sum(len(s.tokens) for s in segments) == sum(len(vocabulary.turn(*t[-1])[0]) for t in turns)
    trees = collections.defaultdict(list)
    for s in segments:
        trees[s.tree].append(s)
        assert s.position == sum(a["to"] - a["from"] for a in s.above) and s.end - s.start == len(s.tokens)
    for parts in trees.values():
        at = 0
        for s in sorted(parts, key=lambda s: s.start):
            assert s.start == at
            at = s.end
        assert all(a["to"] <= s.start for s in parts for a in s.above)
    ids = chat.with_position_ids(spark.createDataFrame([(5, [7, 7, 7])], "position int, tokens array<int>")).first()
    assert ids.position_ids == [5, 6, 7]
    empty = chat.prefix_trees(spark.createDataFrame([], CHAT), vocabulary)
    assert empty[0].count() == 0 and empty[1].count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var x="</p>";</script></head><body><nav><ul>{nav}</ul></nav><div class="ad">{ad}</div>
<article><h1>{h}</h1>{body}<div id="comments-2"><p>reader</p></div></article><aside>side</aside><form>f</form><footer>&copy; f</footer></body></html>"""


def pages(n=40):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 7)))
    out = []
    for i in range(n):
        blocks = [" ".join(rng.choice([word(), "a&amp;b", "&#x41;\n"]) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 5))]
        markup = "".join(rng.choice(["<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<ul><li>{}</ul>", "<blockquote>{}</blockquote>"]).format(b) for b in blocks)
        title = word()
        page = PAGE.format(nav="".join(f"<li><a href='/{k}'>{word()}</a>" for k in range(rng.randrange(2, 5))), ad=word(), h=title, body=markup)
        text = " ".join([title, *(" ".join(html.unescape(b).split()) for b in blocks)])
        out.append((i, f"https://{'hot' if i % 3 else 'h' + str(i % 5)}.example/{i}", page, text))
    return out


def read_alone(page):
    """A page's text through its own expression."""
    items, texts = wrappers.structure(page)
    role = wrappers.roles(items, {}, 1)
    slot = dict(wrappers.Matcher(items).match(wrappers.parse(page)[0]))
    best = max((role[slot[t]] for t in range(len(texts)) if role[slot[t]] < 3), default=0)
    return " ".join("".join(x for t, (x, _) in enumerate(texts) if best and role[slot[t]] == best).split())


def test_wrappers(spark):
    rows = pages()
    df = spark.createDataFrame([(i, u, p, "x", "y") for i, u, p, _ in rows] + [(100, None, None, "x", "y"), (101, "http://hot.example/", "", "x", "y"), (102, "http://hot.example/n", "<nav>menu</nav><div>no article</div>", "x", "y")], "page_id bigint, url string, html string, host string, roles string")
    got = {r.id: r.text for r in wrappers.extract(df.repartition(4)).collect()}
    assert got == {i: t for i, _, _, t in rows} | {100: "", 101: "", 102: "no article"}
    assert wrappers.extract(df.limit(0)).count() == 0


def test_wrapper_inference():
    of = lambda x: wrappers.structure(x)[0]
    a, b = of("<body><article><h1>a</h1><p>x</p></article></body>"), of("<body><nav>n</nav><article><p>x</p><p>y</p><ul><li>q</ul></article></body>")
    both = wrappers.aligned(a, b)
    assert wrappers.expression(both) == "<body>(<nav>#text</nav>)?<article>(<h1>#text</h1>)?(<p>#text</p>)+(<ul><li>#text</li></ul>)?</article></body>"
    assert wrappers.aligned(both, a) == both and wrappers.aligned(a, a) == a
    assert wrappers.expression(of("<dl><dt>a<dd>b<dt>c<dd>d</dl>")) == "<dl>((<dt>#text</dt><dd>#text</dd>))+</dl>"
    deep = "<div>" * 5000 + "deep" + "<nav>menu" + "<nav>" * 3000
    assert read_alone(deep) == "deep"


def test_template_texts_are_left_out_without_an_article(spark):
    page = "<body><div class=x>We say this everywhere</div><div>page {} says {}</div></body>"
    df = spark.createDataFrame([(i, f"http://a/{i}", page.format(i, i * i)) for i in range(3)], "page_id bigint, url string, html string")
    assert {r.id: r.text for r in wrappers.extract(df).collect()} == {i: f"page {i} says {i * i}" for i in range(3)}


def test_copied_pages_keep_their_text(spark):
    copy, other = "<body><div>one and the same page</div></body>", "<body><div>{}</div><article>page {}</article></body>"
    special = "<body><div class=special>a copied text</div></body>"
    rows = [(i, f"http://a/{i}", copy) for i in range(3)] + [(10 + i, f"http://b/{i}", other.format("we say this", i)) for i in range(4)] + [(20 + i, f"http://b/s{i}", special) for i in range(2)]
    rows += [(30, "http://c/1", "<body><div>everywhere</div></body>"), (31, "http://c/2", "<body><div>everywhere</div><p>own</p></body>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.id: r.text for r in wrappers.extract(df).collect()}
    expected = {i: "one and the same page" for i in range(3)} | {10 + i: f"page {i}" for i in range(4)} | {20 + i: "a copied text" for i in range(2)}
    assert got == expected | {30: "everywhere", 31: "own"}


def test_titles_in_an_article_are_not_furniture(spark):
    page = '<body><div class=menu>m{0}</div><article><section id="legal-history"><h2 id="the-social-contract">h{0}</h2><p>a <a class="social">b</a> <span class=share>c</span> d{0}</p></section><section class="wide related">r</section><nav>n</nav><div class=comments>no</div></article></body>'
    df = spark.createDataFrame([(i, f"http://a/{i}", page.format(i)) for i in range(3)], "page_id bigint, url string, html string")
    assert {r.id: r.text for r in wrappers.extract(df).collect()} == {i: f"h{i} a b c d{i}" for i in range(3)}


def soup(i):
    """A page whose elements and classes say nothing: a menu of links, an article, a line that all pages have."""
    rng = random.Random(i)
    word = lambda: "".join(rng.choice("xyzw") for _ in range(rng.randrange(2, 8)))
    menu = "".join(f"<li><a href='/{k}'>{word()} {word()}</a></li>" for k in range(rng.randrange(3, 7)))
    blocks = [" ".join(word() for _ in range(rng.randrange(8, 40))) for _ in range(rng.randrange(1, 6))]
    body = "".join(rng.choice(["<p>{}</p>", "<p>{}</p>", "<ul><li>{}</ul>"]).format(b) for b in blocks)
    title = word()
    tip = "<div class=k9>one more line of ours</div>" if i % 3 == 0 else ""
    return f"<body><div class=k1><ul>{menu}</ul></div>{tip}<div class=k2><h1>{title}</h1>{body}</div><div class=k3>the same line on every page</div></body>", " ".join([title, *blocks])


@pytest.mark.parametrize("fan", [2, 16])
def test_the_wrapper_decides(spark, fan, monkeypatch):
    """Nothing but what the host's pages have in common tells this article; without a wrapper the text is another one."""
    monkeypatch.setattr(wrappers.infer, "__defaults__", ("url", "html", fan))
    made = [soup(i) for i in range(40)]
    df = spark.createDataFrame([(i, f"http://soup/{i}", p) for i, (p, _) in enumerate(made)], "page_id bigint, url string, html string")
    assert {r.id: r.text for r in wrappers.extract(df).collect()} == {i: t for i, (_, t) in enumerate(made)}
    none = spark.createDataFrame([("soup", "[]")], "host string, wrapper string")
    bound = wrappers.matched(df, none)
    assert {p.slot for r in bound.collect() for p in r.parts} == {-1}
    assert wrappers.slot_roles(bound, none).first().roles == []


def random_stream(rng, depth=0):
    tags = ["div", "p", "li", "div.a", "h2"]
    return [["#", [], []] if rng.random() < 0.3 else [rng.choice(tags), random_stream(rng, depth + 1) if depth < 2 else [], []] for _ in range(rng.randrange(0, 5))]


def plain(raw):
    return wrappers.folded([[s, 0, 0, plain(inner)] for s, inner, _ in raw])


def accepts(items, raw):
    """Brute force: a wrapper level as a regular expression of Python over letters, one for each pair of item and position."""
    pattern, seen = [], []

    def walk(xs):
        for s, optional, repeated, inner in xs:
            if s[0] == "(":
                pattern.append("(?:")
                walk(inner)
                pattern.append(")")
            else:
                pattern.append(f"(?:<{len(seen)}>)")
                seen.append((s, inner))
            pattern.append({(0, 0): "", (1, 0): "?", (0, 1): "+", (1, 1): "*"}[optional, repeated])

    walk(items)
    expr = "".join(pattern)
    options = [[f"<{k}>" for k, (s, inner) in enumerate(seen) if s == x[0] and (s == "#" or accepts(inner, x[1]))] for x in raw]
    states = {""}
    for o in options:  # all readings of the stream, as far as they are few
        states = {a + b for a in states for b in o}
        if len(states) > 3000:
            return None
    return any(re.fullmatch(expr, s) for s in states)


def test_matching_against_regular_expressions():
    """A wrapper matches each page that it was inferred from, and what it matches is what its regular expression matches."""
    rng = random.Random(9)
    met = 0
    for _ in range(400):
        pages = [random_stream(rng) for _ in range(4)]
        wrapper = plain(pages[0])
        for p in pages[1:3]:
            wrapper = wrappers.aligned(wrapper, plain(p))
        ready = wrappers.Matcher(wrapper)
        for p in pages[:3]:
            assert ready.match(p) is not None, (wrapper, p)
        expected = accepts(wrapper, pages[3])
        if expected is not None:
            met += expected
            assert (ready.match(pages[3]) is not None) == expected
    assert met > 5


def test_deep_articles_and_long_pages(spark):
    deep = "<body>" + "<div>" * 70 + "<article>main text<nav>menu</nav></article>" + "</div>" * 70 + "<p>outside words</p></body>"
    long = "<body><article>" + "".join(f"<p>{'w ' * 40}{k}</p>" for k in range(3000)) + "</article></body>"
    df = spark.createDataFrame([(1, "http://d/1", deep), (2, "http://l/2", long), (2, "http://l/2", long)], "page_id bigint, url string, html string")
    got = [r.text for r in wrappers.extract(df).orderBy("id").collect()]
    assert got[0] == "main text" and got[1] == got[2] == " ".join(f"{'w ' * 40}{k}" for k in range(3000))


def warc_pages(spark, n=700):
    rng = random.Random(5)
    return spark.createDataFrame([(i, f"http://h/{i}", "x" * rng.randrange(0, 50) + str(i), "d") for i in range(0, 3 * n, 3)], "page_id bigint, url string, html string, digest string")


def test_fixity(spark):
    docs = warc_pages(spark)
    laid = fixity.layout(docs).drop("record")
    from pyspark.sql import functions as F

    replica = docs.where("page_id NOT IN (0, 999, 1500)").withColumn("html", F.when(F.col("page_id").isin(3, 1200), "changed").otherwise(F.col("html")))
    replica = replica.unionAll(spark.createDataFrame([(1, "u", "new", "d"), (5000, "u", "new", "d")], docs.schema))
    found = fixity.audit(laid, fixity.layout(replica)).collect()
    assert {(r.number, r.status) for r in found} == {(0, "missing"), (999, "missing"), (1500, "missing"), (3, "corrupt"), (1200, "corrupt"), (1, "extra"), (5000, "extra")}
    a, b = fixity.tree(laid), fixity.tree(fixity.layout(replica))
    levels = [x.count() for x in fixity.differing(a, b)]
    assert levels[0] == 3 and levels[-1] == 7 and max(levels) <= 8  # only branches that differ
    assert fixity.audit(laid, laid).count() == 0
    empty = fixity.layout(docs.limit(0))
    assert fixity.audit(empty, empty).count() == 0


def test_fixity_ties_and_nulls(spark):
    docs = spark.createDataFrame([(None, None, None), (1, "u", "a"), (1, "u", "a"), (1, "u", "b")], "page_id bigint, url string, html string")
    laid = fixity.layout(docs)
    assert laid.count() == 4 and fixity.audit(laid, laid).count() == 0
    lost = fixity.layout(docs.where("html = 'a' OR page_id IS NULL"))
    assert [r.status for r in fixity.audit(laid, lost).collect()].count("missing") == 1


def test_warc_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "http://a\r\nb", "WARC/1.0\r\n\r\nx"), (2, None, "é\r\n\r\n"), (1003, "u", None)], "page_id bigint, url string, html string")
    fixity.write_warc(fixity.layout(docs), str(tmp_path / "w"))
    got = fixity.read_warc(spark, str(tmp_path / "w")).collect()
    assert {(r.id, bytes(r.payload).decode()) for r in got} == {("<urn:record:1>", "WARC/1.0\r\n\r\nx"), ("<urn:record:2>", "é\r\n\r\n"), ("<urn:record:1003>", "")}
    places = {(r.number, r.offset) for r in fixity.layout(docs).collect()}
    assert {(int(re.sub(r"\D", "", r.id)), r.offset) for r in got} == places


def test_gzipped_and_broken_records():
    import gzip

    from inkloom.llm.warcfile import records

    one = lambda n, body, size=None: f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <{n}>\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nContent-Length: {len(body) if size is None else size}\r\n\r\n{body}\r\n\r\n".encode()
    a, b = gzip.compress(one(1, "first")), gzip.compress(one(2, "second"))
    assert [(o, i, p) for o, i, _, p in records(a + b)] == [(0, "<1>", b"first"), (len(a), "<2>", b"second")]
    plain = one(1, "x") + one(2, "lost", "many") + one(3, "kept")
    assert [(i, p) for _, i, _, p in records(plain)] == [("<1>", b"x"), ("<3>", b"kept")]
    assert list(records(b"")) == [] and [p for *_, p in records(one(4, "short", 900))] == [b"short\r\n\r\n"]


def test_pipeline(spark, small):
    """Each stage on what its predecessor kept, held against its operator's brute-force rule."""
    docs = spark.read.parquet(f"{small}/documents.parquet").cache()
    texts = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "simhash_near_dedup", "substring_dedup", "mix_sources", "sentencepiece"]
    kept = corpus_pipeline.quality_rules(spark, docs, small).cache()
    verdict = {r.doc_id: r.kept for r in quality.op9_quality_rules(spark, small).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, k in verdict.items() if k} and 0 < kept.count() < len(texts)
    single = corpus_pipeline.near_dedup(spark, kept, small).cache()
    prints = {r.id: r.fp & (2**64 - 1) for r in simhash.fingerprints(kept).collect()}
    ids = sorted(prints)
    first = {}
    for i in ids:
        group = {i}
        while True:
            more = {j for j in ids if any((prints[j] ^ prints[k]).bit_count() <= 3 for k in group)}
            if more == group:
                break
            group = more
        first[i] = min(group)
    assert {r.doc_id for r in single.collect()} == set(first.values())
    cut = corpus_pipeline.substring_dedup(spark, single, small).cache()
    seen, expected = set(), {}
    for i in sorted(r.doc_id for r in single.collect()):
        words = texts[i].encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(window)
        expected[i] = b" ".join(w for w, g in zip(words, gone) if not g).decode()
    assert {r.doc_id: r.text for r in cut.collect()} == expected
    mixed = corpus_pipeline.mix(spark, cut, small).cache()
    taken = {r.id: r.taken for r in mixing.taken_words(*mixing.mix(cut)).collect()}
    words = collections.Counter()
    for r in mixed.collect():
        assert r.text in expected[r.doc_id] and r.n_chars == len(r.text)
        words[r.doc_id] += len(r.text.split())
    assert words == +collections.Counter(taken)
    ids = corpus_pipeline.tokens(spark, mixed, small)
    back = pieces.decode(ids, pieces.PieceModel()).collect()
    assert collections.Counter((r.doc_id, r.decoded) for r in back) == collections.Counter((r.doc_id, r.text) for r in mixed.collect())
    assert all(set(s.columns) == set(corpus_pipeline.COLUMNS) for s in (kept, single, cut, mixed))
    empty = docs.limit(0)
    for f in stages.values():
        assert f(spark, empty, small).count() == 0


def test_registered_queries(spark, small):
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{small}/pages.parquet'")
    expected = con.sql(fixity.OP8_SQL).fetchall()
    got = [tuple(r) for r in fixity.op8_warc_fixity(spark, small).collect()]
    assert sorted(got) == sorted(expected)


def test_substring_dedup_over_registered_table(spark, small):
    got = {r.doc_id: r.n_words for r in substrings.op3_substring_dedup(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert got == {r.doc_id: len(r.text.encode().split()) for r in docs}
