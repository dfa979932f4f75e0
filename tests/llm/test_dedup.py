"""SimHash, substring dedup, MinHash against brute force, and their defined cases."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from inkloom.llm import minhash, similar, simhash, substrings, wordhash
from inkloom.llm.components import components

SCHEMA = "doc_id bigint, text string, id string, tag int, fp int, _n int, runs string"


def frame(spark, rows):
    """Documents with columns that the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, "y") for i, t in rows], SCHEMA)


def documents(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)]
    passage = [rng.choice(vocabulary) + "p" for _ in range(60)]
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 90))]
        if i % 3 == 0:
            at = rng.randrange(0, len(words) + 1)
            words[at:at] = passage[rng.randrange(0, 15) : rng.randrange(30, 60)]
        out.append((i * 3, rng.choice([" ", "\n", "  \t"]).join(words)))
    return [*out, (1000, out[5][1]), (1001, "the " * 90), (1002, None), (1003, ""), (1004, " \n\t "), (1005, "ü " * 25 + "\xa0x")]


def removed(rows, width=20):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - width + 1):
            window = tuple(words[k : k + width])
            if window in seen:
                gone[k : k + width] = [True] * width
            seen.add(window)
        out[i] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode())
    return out


@pytest.mark.parametrize("layout", [{}, {"bucket_bytes": 300}, {"bucket_bytes": 2000, "layout_sample": 1}])
def test_substrings(spark, layout):
    rows = documents()
    got = substrings.dedup_substrings(frame(spark, rows).repartition(5), **layout).collect()
    assert {r.id: (r.n_words, r.n_removed, r.kept) for r in got} == removed(rows)


def test_substrings_hot_minimisers(spark, monkeypatch):
    rows = documents(4)
    monkeypatch.setattr(substrings, "BATCH_BYTES", 200)
    got = substrings.dedup_substrings(frame(spark, rows), bucket_bytes=100, layout_sample=1).collect()
    assert {r.id: (r.n_words, r.n_removed, r.kept) for r in got} == removed(rows)


@pytest.mark.parametrize("seen", [3, 100_000])
def test_substrings_settled_by_tasks(spark, monkeypatch, seen):
    """Whatever the order in which a task meets copies, and however many windows it remembers."""
    rows = documents(7)
    random.Random(1).shuffle(rows)
    monkeypatch.setattr(substrings, "BATCH_BYTES", 300)
    monkeypatch.setattr(substrings, "SEEN", seen)
    got = substrings.dedup_substrings(frame(spark, rows).coalesce(1), bucket_bytes=2000, layout_sample=1).collect()
    assert {r.id: (r.n_words, r.n_removed, r.kept) for r in got} == removed(rows)


def test_very_long_texts(spark):
    """One text far beyond every slice, beside short ones: windows, fingerprints and bands are those of the whole text."""
    rng = random.Random(3)
    long = " ".join(f"v{rng.randrange(10**6)}" for _ in range(320_000))
    rows = [(1, long), (2, " ".join(long.split()[:40])), (3, long + " end")]
    got = {r.id: (r.n_words, r.n_removed) for r in substrings.dedup_substrings(frame(spark, rows)).collect()}
    assert got == {1: (320_000, 0), 2: (40, 40), 3: (320_001, 320_000)}
    prints = {r.id: r.fp for r in simhash.fingerprints(frame(spark, rows)).collect()}
    words = long.split()
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(320_000 - 2)]
    ones = np.unpackbits(np.array(h, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0)
    assert prints[1] & (2**64 - 1) == int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")
    marks = {r.id: r.fingerprint for r in minhash.fingerprints(frame(spark, rows)).collect()}
    near = sum(a == b for a, b in zip(marks[1], marks[3])) / 512
    assert near > 0.98 and len(marks[1]) == 512
    assert sorted(r.doc_id for r in similar.keep_one(frame(spark, rows)).collect()) == [1, 2]


def test_substrings_repeated_rows_are_one_document(spark):
    text = " ".join(f"a{k}" for k in range(30))
    got = substrings.dedup_substrings(frame(spark, [(1, text), (1, text), (None, text)])).collect()
    assert sorted((r.id or 99, r.n_removed) for r in got) == [(1, 0), (1, 0), (99, 30)]


def test_substrings_carry_and_empty(spark):
    got = substrings.dedup_substrings(frame(spark, [(1, "a b")]), carry=["id", "_n"]).first()
    assert (got.kept, got.rest.id, got.rest._n) == ("a b", "x", 3)
    assert substrings.dedup_substrings(frame(spark, [])).count() == 0


def test_equal_hashes_with_different_words():
    data = b"\na b c d\n"
    start, end = wordhash.cut(np.frombuffer(data, np.uint8))
    found = substrings._repeats(data, start, end, np.arange(4), np.zeros(4, np.uint64), np.arange(4), 1)
    assert not found.any()
    data = b"\na b a b\n"
    start, end = wordhash.cut(np.frombuffer(data, np.uint8))
    found = substrings._repeats(data, start, end, np.arange(4), np.zeros(4, np.uint64), np.arange(4), 1)
    assert found.tolist() == [False, False, True, True]


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), min_size=1, max_size=5), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_window_hashes_tell_windows_apart(texts, width):
    data = ("\n" + "\n".join(" ".join(t) for t in texts) + "\n").encode()
    blob = np.frombuffer(data, np.uint8)
    start, end = wordhash.cut(blob)
    words = [data[a:b] for a, b in zip(start, end)]
    h = wordhash.window_hashes(wordhash.word_hashes(blob, start, end), width)
    by = {}
    for k in range(len(words) - width + 1):
        assert by.setdefault(int(h[k]), tuple(words[k : k + width])) == tuple(words[k : k + width])
    assert len(by) == len({tuple(words[k : k + width]) for k in range(max(0, len(words) - width + 1))})


def naive_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def labels_of(nodes, near):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def test_simhash(spark):
    rows = documents(2)
    prints = {i: naive_fingerprint(t) for i, t in rows}
    expected = labels_of([i for i, _ in rows], lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    got = simhash.simhash_components(frame(spark, rows)).collect()
    assert {r.id: r.fp & (2**64 - 1) for r in got} == prints
    assert {r.id: r.component_id for r in got} == expected


def test_simhash_shingles_match_spark_hash(spark):
    word = "Straße"
    assert spark.range(1).selectExpr(f"xxhash64('{word}') AS h").first().h & (2**64 - 1) == xxhash.xxh64_intdigest(word.encode(), 42)


@pytest.mark.parametrize("most", [0, 2, 256])
def test_links_of_dense_groups(spark, most):
    rng = np.random.default_rng(3)
    values = {0x0123456789ABCDEF, 0, 2**64 - 1}
    while len(values) < 70:
        x = list(values)[rng.integers(len(values))]
        for bit in rng.choice(64, rng.integers(1, 5), replace=False):
            x ^= 1 << int(bit)
        values.add(x)
    values = sorted(values)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    points = spark.createDataFrame(list(zip(signed, range(len(values)))), "fp bigint, node bigint")
    edges = simhash.near_links(points, most)
    assert all((values[e.a] ^ values[e.b]).bit_count() <= 3 for e in edges.collect())
    got = dict.fromkeys(range(len(values)))
    got = {n: n for n in got} | {r.v: r.root for r in components(edges).collect()}
    assert got == labels_of(list(range(len(values))), lambda a, b: (values[a] ^ values[b]).bit_count() <= 3)


def test_keep_one_and_empty(spark):
    rows = [(5, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (9, "quite another text here"), (None, None)]
    kept = simhash.keep_one(frame(spark, rows)).collect()
    assert sorted((r.doc_id or -1) for r in kept) == [-1, 3, 9] and {r["_n"] for r in kept} == {3}
    assert simhash.keep_one(frame(spark, [])).count() == 0


def test_null_and_repeated_ids_neither_merge_nor_drop(spark):
    text = lambda k: " ".join(f"w{k * 7 + j}x{k}" for j in range(30))
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (4, text(3)), (4, text(4)), (9, text(4)), (8, text(3)), (None, text(3))]
    kept = simhash.keep_one(frame(spark, rows)).collect()
    assert sorted(((r.doc_id or -1), r.text) for r in kept) == sorted([(-1, text(1)), (-1, text(2)), (4, text(3)), (4, text(4))])
    found = simhash.simhash_components(frame(spark, [(1, text(1)), (1, text(2)), (2, text(2)), (3, text(1))])).collect()
    assert len({r.fp for r in found}) == 2 and {r.component_id for r in found} == {1}


def test_components_link_through_null_ids(spark, monkeypatch):
    monkeypatch.setattr(simhash, "fingerprint_of", lambda text, width=3: int(text))
    rows = [(5, "0"), (None, "7"), (3, "63"), (None, str(2**40 - 2**30))]
    found = simhash.simhash_components(frame(spark, rows)).collect()
    assert {(r.id, r.fp): r.component_id for r in found} == {(5, 0): 3, (None, 7): 3, (3, 63): 3, (None, 2**40 - 2**30): None}


def test_components_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 101), (7, 7), (None, 4)], "a bigint, b bigint")
    got = {r.v: r.root for r in components(edges).collect()}
    assert got == {k: 1 for k in range(1, 61)} | {100: 100, 101: 100}


def shingles(text):
    words = (text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def test_minhash(spark, monkeypatch):
    rows = sorted(documents(3, 40) + [(2000 + k, "x " * k) for k in range(8)])
    got = {r.id: r for r in minhash.neighbours(frame(spark, rows).repartition(3)).collect()}
    texts = [t or "" for _, t in rows]
    after = [minhash.edited(a, b) for a, b in zip(texts, texts[1:] + texts[:1])]
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for (i, _), text, following, changed in zip(rows, texts, texts[1:] + texts[:1], after):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert abs(r.near_edited - jaccard(shingles(text), shingles(changed))) < 0.2
        assert abs(r.near_next - jaccard(shingles(text), shingles(following))) < 0.2
    by_text = {}
    for i, t in rows:
        assert by_text.setdefault(t or "", got[i].fingerprint) == got[i].fingerprint
    assert {r.id: r.fingerprint for r in minhash.fingerprints(frame(spark, rows)).collect()} == {i: got[i].fingerprint for i, _ in rows}


def test_minhash_ranges_agree(spark, monkeypatch):
    rows = documents(5, 50)
    whole = {r.id: r for r in minhash.neighbours(frame(spark, rows)).collect()}
    kept = minhash.in_order
    for each in (1, 3, 7):
        monkeypatch.setattr(minhash, "in_order", lambda d, i, t, each=each: kept(d, i, t, each))
        assert {r.id: r for r in minhash.neighbours(frame(spark, rows)).collect()} == whole


def test_minhash_small_tables(spark):
    one = minhash.neighbours(frame(spark, [(7, "a b c d e f g h")])).collect()
    assert [(r.id, r.near_next) for r in one] == [(7, 1.0)]
    assert minhash.neighbours(frame(spark, [])).count() == 0
    tied = minhash.neighbours(frame(spark, [(1, "b"), (1, "a"), (None, "c")])).collect()
    assert len(tied) == 3


@pytest.mark.parametrize("leaders", [2, 3])
def test_similar_components(spark, leaders):
    rng = random.Random(8)
    rows = [(k, " ".join(f"v{rng.randrange(900)}" for _ in range(rng.randrange(0, 200)))) for k in range(12)]
    for k in range(12, 60):
        words = rng.choice(rows)[1].split()
        for _ in range(rng.randrange(0, 5)):
            if words:
                words[rng.randrange(len(words))] = f"new{rng.randrange(99)}"
        rows.append((k, " ".join(words)))
    rows += [(100, None), (101, " "), (102, "short text"), (103, "Short  text"), (104, "short texts")]
    sets = {i: shingles((t or "").lower()) for i, t in rows}

    def similar_texts(a, b):
        both = len(sets[a] & sets[b])
        return sets[a] == sets[b] or 9 * both >= 4 * (len(sets[a]) + len(sets[b]))

    docs = spark.createDataFrame(rows, "key bigint, text string")
    found = similar.similar_components(docs, leaders).collect()
    least = {}
    for r in found:
        least[r.root] = min(least.get(r.root, r.key), r.key)
    assert {r.key: least[r.root] for r in found} == labels_of([i for i, _ in rows], similar_texts)


def test_links_of_a_large_band(spark, monkeypatch):
    monkeypatch.setattr(similar, "bands", lambda found: np.ones(1, np.uint64))
    rng = random.Random(4)
    texts = [[f"v{rng.randrange(9000)}" for _ in range(100)] for _ in range(40)]
    for k in range(4):
        edited = list(texts[k])
        edited[30] = edited[70] = f"new{k}"
        texts.append(edited)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "key bigint, text string")
    for leaders in (1, 2):
        found = similar.similar_components(docs, leaders).collect()
        groups = {}
        for r in found:
            groups.setdefault(r.root, []).append(r.key)
        assert sorted(sorted(g) for g in groups.values() if len(g) > 1) == [[k, 40 + k] for k in range(4)]


def test_strangers_of_a_band(spark, monkeypatch):
    """Texts of one band that are just too far apart meet once, by their parities, and not with their shingles."""
    monkeypatch.setattr(similar, "bands", lambda found: np.ones(1, np.uint64))
    monkeypatch.setattr(similar, "SHARE", 7)
    rng, compared = random.Random(5), []
    base = [f"v{k}" for k in range(200)]
    texts = [base] + [[f"new{k}x{i}" if rng.random() < (0.01 if k % 2 else 0.05) else w for i, w in enumerate(base)] for k in range(40)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "key bigint, text string")
    sets = {k: shingles(" ".join(t)) for k, t in enumerate(texts)}
    close = lambda a, b: 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))
    verified = similar.verified
    monkeypatch.setattr(similar, "verified", lambda pairs, of: (compared.append(pairs.count()), verified(pairs, of))[1])
    found = similar.similar_components(docs, 1).collect()
    least = {}
    for r in found:
        least[r.root] = min(least.get(r.root, r.key), r.key)
    assert {r.key: least[r.root] for r in found} == labels_of(list(sets), close)
    linked = sum(close(a, b) for a in sets for b in sets if a < b)
    assert len(compared) == 2 and sum(compared) <= linked + 60 < 41 * 40 // 2
    for _ in range(50):
        a, b = rng.sample(sorted(sets), 2)
        x, y = (np.array(sorted({hash(s) % 2**32 for s in sets[k]}), np.uint32) for k in (a, b))
        apart = sum(int(u).bit_count() for u in (similar.parity(x) ^ similar.parity(y)).view(np.uint64))
        assert apart <= len(np.setxor1d(x, y))


def test_pipeline_removes_edited_copies(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    kept = {r.doc_id for r in stage(spark, docs, small).collect()}
    assert {1, 6} <= kept and not {177, 145} & kept  # 0.83 similar, 11 and 7 bits apart
    words = [f"w{k}" for k in range(60)]
    rows = [(None, " ".join(words)), (None, " ".join(words[:-1])), (7, " ".join(words[::-1])), (7, "another text of one id"), (None, "a text without id")]
    kept = similar.keep_one(frame(spark, rows)).collect()
    assert sorted(len(r.text.split()) for r in kept if r.doc_id is None) in ([4, 59], [4, 60]) and sum(r.doc_id == 7 for r in kept) == 2
    assert similar.keep_one(frame(spark, [])).count() == 0
