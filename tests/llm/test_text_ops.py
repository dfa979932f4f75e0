"""Quality rules, SentencePiece, mixing, sharding against brute force, and their defined cases."""

import collections
import hashlib
import random
import re
import zlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from inkloom.llm import mixing, pieces, quality, sharding

WORD = r"[^\x20\x09-\x0D]+"


def features(text):
    text = text or ""
    words = re.findall(WORD, text)
    counts = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + d for i in range(len(words) - 2) if counts[tuple(words[i : i + 3])] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def rows_of(seed, n=80):
    rng = random.Random(seed)
    good, bad = [f"g{k}" for k in range(30)], [f"b{k}$$" for k in range(30)]
    out = []
    for i in range(n):
        words = [rng.choice(bad if i % 4 == 0 else good) for _ in range(rng.randrange(60, 120))]
        out.append((i, rng.choice([" ", "\n", " \t"]).join(words), 0 if i % 4 == 0 else 1))
    return out


def test_quality(spark):
    rows = rows_of(1)
    texts = [(i, t, "x", 0.5) for i, t, _ in rows] + [(900, None, "x", 0.5), (901, "", "x", 0.5), (902, "a b a b a b a b", "x", 0.5), (903, "same line\n" * 40, "x", 0.5), (903, "same line\n" * 40, "x", 0.5)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, score string, w double")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 3] + [(1, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(texts)
    for r in got:
        q = r["_quality"]
        assert tuple(q[c] for c in quality.FEATURES) == features(r.text)
        failed = q.n_words < 50 or 100 * q.n_repeat_words > 50 * q.n_words
        assert q.base_failed == failed and q.kept == (not failed and q.score >= quality.THRESHOLD)
    kept = {r.doc_id: r["_quality"]["score"] for r in got}
    assert min(kept[i] for i, _, q in rows if q) > 0 > max(kept[i] for i, _, q in rows if not q)


def test_quality_scores_by_hand(spark):
    """The score is the mean over words and pairs of the smoothed log ratio."""
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    import math

    got = {r.doc_id: r["_quality"]["score"] for r in quality.quality(docs, labels).collect()}
    s = quality.SMOOTH
    assert got[1] == pytest.approx(math.log((1 * 2 + s) / (1 + s))) and got[2] == pytest.approx(math.log(s / (1 + s)))


def test_quality_without_labels_or_rows(spark):
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame([(1, "w%d " * 3 + " ".join(f"v{k}" for k in range(60)))], "doc_id bigint, text string")
    assert quality.quality(docs, empty).first()["_quality"]["kept"] is True
    assert quality.quality(docs.limit(0), empty).count() == 0


ODD = ["Hello  world", " a", "\n\nhi", "", None, "日本 語 😀 x", "a ", "    four", "a" * 900 + " b", "abc" * 70, "é́ \t x\r\n", "nul \0 x a\0b", "\n", " \n x\n\n  y \n", "x" * 62 + " " + "y" * 61 + " " + "z" * 60]


def test_pieces_match_the_model(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("abcde  \n.éß語") for _ in range(rng.randrange(90))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "y")], "doc_id bigint, text string, word string").repartition(3)
    got = pieces.encode(docs, pieces.PieceModel(), block_bytes=100, group_bytes=200)
    rows = got.collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        text = texts[r.id] or ""
        assert r.token_ids == model.encode(text)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = pieces.decode(got, pieces.PieceModel()).collect()
    assert all(r.decoded == (texts[r.id] or "") for r in back)
    assert pieces.encode(docs.limit(0), pieces.PieceModel()).count() == 0


def test_viterbi_is_the_best_path(spark, tmp_path):
    data = open(pieces.MODEL, "rb").read()
    at = data.index(b"\x18\x02", data.index(b"tok_v0"))
    path = tmp_path / "unigram.model"
    path.write_bytes(data[:at] + b"\x18\x01" + data[at + 2 :])
    model = pieces.PieceModel(str(path))
    assert model.kind == pieces.UNIGRAM
    known = model.vocabulary()
    texts = ["Hello world", "theses erthen", "aaaaaaa bbb", "日本", "x" * 70]
    got = pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()
    for r in got:
        expected = []
        for word in pieces.cut_words(texts[r.id]):
            best = [0.0]
            for j in range(1, len(word) + 1):
                best.append(max(best[i] + (known[word[i:j]][1] if word[i:j] in known else model.worst) for i in range(max(0, j - 16), j) if word[i:j] in known or i == j - 1))
            ids = pieces.viterbi_of(word, known, model.bytes, model.longest, model.worst)
            if all(c in known for c in word):
                assert sum(model.scores[i] for i in ids) == pytest.approx(best[-1])
            expected += ids
        assert r.token_ids == expected


@given(st.text(alphabet="ab \n▁é", max_size=30))
@settings(max_examples=200, deadline=None)
def test_words_join_to_the_text(text):
    for lines in (True, False):
        words = pieces.cut_words(text, True, lines)
        assert "".join(words) == (("▁" + text.replace(" ", "▁")) if text else "")


def naive_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, left, free = {}, sum(sizes.values()), set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3 * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def test_mixing(spark):
    rng = random.Random(6)
    docs = [(i, rng.choice([" ", "\n "]).join(f"d{i}w{k}" for k in range(rng.randrange(0, 120))), rng.choice(["hot"] * 8 + ["b", "ä", "Z", None])) for i in range(300)]
    docs += [(5, docs[5][1], docs[5][2]), (901, None, "b"), (902, "one", "tiny"), (903, "", "none")]
    df = spark.createDataFrame([(*d, 1, "q") for d in docs], "doc_id bigint, text string, source string, size int, start string")
    laid, taken = mixing.mix(df)
    rows = mixing.taken_words(laid, taken).collect()
    assert len(rows) == len(docs)
    sizes = collections.Counter()
    for _, t, s in docs:
        sizes[s] += len((t or "").split())
    targets = naive_targets(dict(sizes))
    got = collections.Counter()
    for r in rows:
        assert r.taken <= 3 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        got[r.source] += r.taken
    assert all(abs(got[s] - t) <= 1 for s, t in targets.items())
    again = mixing.taken_words(*mixing.mix(df.repartition(7))).collect()
    assert sorted((r.id, r.size, r.taken) for r in again) == sorted((r.id, r.size, r.taken) for r in rows)
    mixed = mixing.mixed(df).collect()
    words = collections.Counter()
    originals = {i: (t or "").split() for i, t, _ in docs}
    for r in mixed:
        words[r.source] += len(r.text.split())
        assert " ".join(r.text.split()) in " ".join(originals[r.doc_id])
    assert words == +got
    assert mixing.taken_words(*mixing.mix(df.limit(0))).count() == 0 and mixing.mixed(df.limit(0)).count() == 0


def test_schedule_is_even(spark):
    """Any stretch of the schedule holds near its share of each source."""
    rows = spark.createDataFrame([("a", 6400), ("b", 12800), ("c", 19200)], "source string, size bigint")
    plan = mixing.schedule(mixing.targets(rows)).orderBy("slot", "source", "rank").collect()
    share = collections.Counter(r.source for r in plan)
    for k in range(0, len(plan) - 60, 17):
        part = collections.Counter(r.source for r in plan[k : k + 60])
        assert all(abs(part[s] - 60 * share[s] / len(plan)) <= 4 for s in share)


def test_sharding(spark):
    rng = random.Random(3)
    texts = ["x" * rng.randrange(1, 400) for _ in range(500)] + ["copy " * 30] * 200 + [None, "", "ü"]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)] + [(3, texts[3], 1, "k")], "doc_id bigint, text string, shard int, key string")
    for law in ("bytes", "rows", "key"):
        rows = sharding.shard_rows(df, shards=7, law=law).collect()
        assert len(rows) == len(texts) + 1
        assert all(r.size == len((texts[r.id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((texts[r.id] or "").encode()) for r in rows)
        by = collections.defaultdict(list)
        for r in rows:
            by[r.shard].append(r)
        assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())
        if law == "bytes":
            home = collections.defaultdict(set)
            for r in rows:
                home[texts[r.id] or ""].add(r.shard)
            assert all(len(s) == 1 for s in home.values())
            loads = sorted(sum(r.size for r in rs) for rs in by.values())
            assert loads[-2] - loads[0] < 600  # the copies are a shard of their own
        if law == "rows":
            assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
        if law == "key":
            assert all(r.grown_shard == r.shard or r.grown_shard == 7 for r in rows) and any(r.grown_shard == 7 for r in rows)
    assert sharding.shard_rows(df.limit(0)).count() == 0


@given(st.lists(st.integers(1, 50), max_size=40), st.integers(1, 6))
@settings(max_examples=100, deadline=None)
def test_least_loaded(sizes, shards):
    loads = [0] * shards
    for size, s in sorted(zip(sizes, sharding.least_loaded(sizes, shards)), reverse=True):
        loads[s] += size
    assert max(loads) <= sum(sizes) / shards + max(sizes, default=0)


def test_quality_held_out(spark):
    """Fitted on one half of the labels (exact copies stay on one side), judged on the other."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    side = docs.selectExpr("doc_id", "pmod(xxhash64(text), 2) AS side")
    labels = spark.read.parquet(f"{folder}/labels.parquet").join(side, "doc_id")
    judged = quality.quality(docs, labels.where("side = 0").drop("side")).selectExpr("doc_id", "_quality.kept", "_quality.base_failed")
    found = collections.Counter((r.quality, r.kept) for r in judged.where("NOT base_failed").join(labels.where("side = 1"), "doc_id").collect())
    assert found[0, True] == 0 and found[0, False] > 5
    assert found[1, False] <= 0.03 * found[1, True]
