"""Very long texts, clashing columns and repeated rows: the values, not only the rows."""

import collections
import random
import zlib

import corpus_pipeline
from inkloom.llm import fixity, mixing, quality, sharding, wrappers

DRAW = random.Random(9)
LONG = " ".join(f"w{DRAW.randrange(5000)}" for _ in range(150_000))
ONE_WORD = "é" * 1_000_000


def prose(n, seed):
    draw = random.Random(seed)
    return " ".join(f"{draw.choice('abcdefgh')}{draw.randrange(900)}" for _ in range(n))


def stored(spark, tmp_path, rows, schema, name="documents"):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_long_texts_in_the_mix(spark, tmp_path):
    rows = [(1, LONG, "a"), (2, ONE_WORD, "a"), (3, prose(1000, 3), "b"), (4, None, "b"), (5, prose(120_000, 5), None)]
    got = {r.doc_id: r for r in mixing.op2_mix_sources(spark, stored(spark, tmp_path, rows, "doc_id bigint, text string, source string")).collect()}
    assert {i: r.size for i, r in got.items()} == {1: 150_000, 2: 1, 3: 1000, 4: 0, 5: 120_000}
    # Weights 1, 2, 3 over 271,001 words; the second source stops at 3,000.
    target = {"a": (271_001 - 3000) / 4, "b": 3000, None: (271_001 - 3000) * 3 / 4}
    taken = collections.Counter()
    for i, _, s in rows:
        assert abs(got[i].target - target[s]) < 1e-6 and got[i].taken <= 3 * got[i].size
        taken[s] += got[i].taken
    assert all(abs(taken[s] - target[s]) < 1 for s in target)


def test_long_texts_in_shards(spark, tmp_path):
    rows = [(1, LONG), (2, ONE_WORD), (3, LONG), *((i, prose(20, i)) for i in range(4, 300))]
    got = sharding.op5_shard_documents(spark, stored(spark, tmp_path, rows, "doc_id bigint, text string")).collect()
    texts = dict(rows)
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 16, zlib.crc32(texts[r.doc_id].encode())) for r in got) and len(got) == len(rows)
    shard = {r.doc_id: r["shard"] for r in got}
    assert shard[1] == shard[3] != shard[2]
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_long_texts_are_judged_whole(spark):
    again = LONG + " " + LONG.split(" ", 1)[0] + " tail"
    rows = [(1, LONG + "\n" + LONG), (2, ONE_WORD), (3, again), (4, "#" * 300_000)]
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r._quality for r in quality.quality(spark.createDataFrame(rows, "doc_id bigint, text string"), labels).collect()}
    letters = sum(map(len, LONG.split(" ")))
    assert (got[1].n_words, got[1].word_chars, got[1].n_dup_lines, got[1].n_repeat_words, got[1].base_failed) == (300_000, 2 * letters, 1, 300_000, True)
    assert (got[2].n_words, got[2].word_chars, got[2].base_failed) == (1, 1_000_000, True) and got[4].n_symbols == 300_000
    assert got[3].n_words == 150_002 and got[3].word_chars == letters + len(LONG.split(" ", 1)[0]) + 4


def test_pages_with_clashing_columns(spark, tmp_path):
    page = lambda t: f"<html><body><nav>menu</nav><article><p>{t}</p></article></body></html>"
    rows = [(i, f"http://h/{i}", page(prose(30, i)), "t", 1, "h", "r", 2, "w") for i in range(6)]
    plain = stored(spark, tmp_path / "a", [r[:3] for r in rows], "page_id bigint, url string, html string", "pages")
    odd = stored(spark, tmp_path / "b", rows, "page_id bigint, url string, html string, text string, n_chars int, host string, row string, slot int, wrapper string", "pages")
    found = lambda d: sorted(map(tuple, wrappers.op10_html_wrappers(spark, d).select("page_id", "text", "n_chars").collect()))
    assert found(odd) == found(plain) and [r[1] for r in found(odd)] == [prose(30, i) for i in range(6)]


def test_records_without_numbers_in_bulk(spark):
    rows = [(None, "u", "same")] * 300 + [(None, f"u{i}", "x") for i in range(50)] + [(5, "u", "same")] * 3 + [(None, None, None)] * 2
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    laid = fixity.layout(pages)
    assert laid.count() == len(rows)
    assert fixity.audit(laid, laid).count() == 0
    lost = fixity.audit(laid, fixity.layout(pages.where("url IS NULL OR url <> 'u7'"))).collect()
    assert [(r.status, r.number) for r in lost] == [("missing", None)]


def test_pipeline_over_long_texts_and_clashing_columns(spark, tmp_path):
    """Extra columns are left out whatever their names; a very long document goes through every stage, its repeated passages counted once."""
    body = [(i, prose(120, 100 + i), "en", f"s{i % 2}", 1) for i in range(12)]
    rows = [*body, (50, prose(60_000, 50), "en", "s0", 1), (51, prose(60_000, 50), "en", "s1", 1), (52, None, "en", "s0", 0), (53, "too short", "en", "s1", 9)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    plain = stored(spark, tmp_path / "a", rows, schema)
    odd = stored(spark, tmp_path / "b", [(*r, 1, "k", 2, "i", "t", 3) for r in rows], schema + ", row int, _kept string, _quality int, id string, words string, size int")
    for folder in (plain, odd):
        spark.createDataFrame([(i, 1, 0) for i in [*range(12), 50]], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    found = lambda d: sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, d).collect())
    got = found(plain)
    assert found(odd) == got
    ids = {r[0] for r in got}
    assert 50 in ids and not ids & {51, 52, 53} and len(ids) > 6
