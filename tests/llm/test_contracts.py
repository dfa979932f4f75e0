"""The registered queries over whole small tables, held against plain Python."""

import collections
import hashlib
import math
import re
import zlib

import pytest
import sentencepiece
import tiktoken
import xxhash

from inkloom.llm import chat, minhash, mixing, pieces, quality, sharding, simhash, wrappers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, small):
    return sorted((tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source").collect()), key=lambda r: r[0])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]
    turns = collections.defaultdict(list)
    for c, k, r, t in sorted(rows):
        turns[c].append((r, t or ""))
    got = {r.conv_id: r for r in chat.op1_chat_prefix_tree(spark, small).collect()}
    assert set(got) == set(turns)
    for c, ts in turns.items():
        loss = "".join(t for r, t in ts if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(ts), sha("".join(f"{r}\n{t}\n" for r, t in ts)), len(loss), sha(loss))


def test_long_texts_have_the_vocabularys_own_ids():
    vocabulary = chat.Vocabulary()
    encoding: tiktoken.Encoding = vocabulary._loaded()[0]
    for text in ("x" * 20_000, "word " * 5_000, "a1 ,;\n\n " * 3_000, "日本語" * 7_000):
        ids, a, z = vocabulary.turn("user", text)
        assert ids[a:z] == encoding.encode_ordinary(text)


def test_op2(spark, small, docs):
    sizes = {i: len(WORD.findall(t or "")) for i, t, _ in docs}
    of = collections.Counter()
    for i, _, s in docs:
        of[s] += sizes[i]
    names = sorted((s for s in of if s is not None), key=lambda s: s.encode()) + [None] * (None in of)
    weight, left, free, target = {s: i % 3 + 1 for i, s in enumerate(names)}, sum(of.values()), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * of[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s], left = 3 * of[s], left - 3 * of[s]
            free.discard(s)
    got = {r.doc_id: r for r in mixing.op2_mix_sources(spark, small).collect()}
    taken = collections.Counter()
    for i, _, s in docs:
        r = got[i]
        assert r.size == sizes[i] and r.source_size == of[s] and r.target == pytest.approx(target[s]) and r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())


def test_op4(spark, small, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = {r.doc_id: r for r in pieces.op4_sentencepiece(spark, small).collect()}
    for i, t, _ in docs:
        assert got[i].token_ids == model.encode(t or "") and got[i].n_tokens == len(got[i].token_ids) and got[i].decoded_sha256 == sha(t or "")


def test_op5(spark, small, docs):
    rows = sharding.op5_shard_documents(spark, small).collect()
    texts = {i: t or "" for i, t, _ in docs}
    by, homes = collections.defaultdict(list), collections.defaultdict(set)
    for r in rows:
        t = texts[r.doc_id].encode()
        assert r.size == len(t) + 16 and r.text_crc32 == zlib.crc32(t) and 0 <= r.shard < 40 and r.grown_shard is None and r.law == "bytes"
        by[r.shard].append(r)
        homes[t].add(r.shard)
    assert sorted(r.doc_id for r in rows) == sorted(texts) and all(len(x) == 1 for x in homes.values())
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())
    groups = collections.Counter()
    for t in texts.values():
        groups[t] += len(t.encode()) + 16
    # Longest processing time stays within 4/3 - 1/(3m) of the best makespan, which is no less than the mean and than the largest group.
    least = max(sum(groups.values()) / 40, max(groups.values()))
    assert max(sum(r.size for r in rs) for rs in by.values()) <= (4 / 3 - 1 / 120) * least


def best_makespan(sizes, shards):
    """The least largest load, by trying every assignment."""
    best = sum(sizes)

    def place(k, loads):
        nonlocal best
        if max(loads) >= best:
            return
        if k == len(sizes):
            best = max(loads)
            return
        for s in range(shards):
            if loads[s] not in loads[:s]:
                place(k + 1, [*loads[:s], loads[s] + sizes[k], *loads[s + 1 :]])

    place(0, [0] * shards)
    return best


def test_scheduling_against_the_optimum():
    import random

    rng = random.Random(4)
    for _ in range(60):
        sizes, shards = sorted((rng.randrange(1, 40) for _ in range(rng.randrange(1, 10))), reverse=True), rng.randrange(1, 4)
        loads = [0] * shards
        for size, s in zip(sizes, sharding.least_loaded(sizes, shards)):
            loads[s] += size
        assert max(loads) <= (4 / 3 - 1 / (3 * shards)) * best_makespan(sizes, shards) + 1e-9


def shingle_set(text):
    words = WORD.findall(text)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_op6(spark, small, docs):
    got = {r.doc_id: r for r in minhash.op6_document_fingerprints(spark, small).collect()}
    errors = []
    for k, (i, t, _) in enumerate(docs):
        t, after = t or "", docs[(k + 1) % len(docs)][1] or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == sha(edited)
        errors += [abs(got[i].near_edited - jaccard(t, edited)), abs(got[i].near_next - jaccard(t, after))]
    assert sum(errors) / len(errors) < 0.03 and max(errors) < 0.12
    first = {}
    assert all(first.setdefault(t or "", got[i].fingerprint) == got[i].fingerprint for i, t, _ in docs)


def test_op7(spark, small, docs):
    prints = {}
    for i, t, _ in docs:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    root = {i: i for i in prints}
    ids = sorted(prints)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if root[a] > root[b] and (prints[a] ^ prints[b]).bit_count() <= 3:
                    root[a], changed = root[b], True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op7_simhash_near_dedup(spark, small).collect()}
    assert got == {i: (f"{p:016x}", root[i]) for i, p in prints.items()}


def test_op9(spark, small, docs):
    """Base columns, and the scores from counts of hashed words and pairs made in Python."""
    from pyspark.sql import functions as F

    rows = {r.doc_id: r for r in quality.op9_quality_rules(spark, small).collect()}
    words = {i: WORD.findall(t or "") for i, t, _ in docs}
    distinct = sorted({w for ws in words.values() for w in ws})
    hashed = spark.createDataFrame([(w,) for w in distinct], "w string").select("w", F.xxhash64("w").alias("h")).collect()
    one = {r.w: r.h for r in hashed}
    pairs = sorted({(one[a], one[b]) for ws in words.values() for a, b in zip(ws, ws[1:])})
    two = {(r.a, r.b): r.h for r in spark.createDataFrame(pairs, "a bigint, b bigint").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    grams = {i: [h & (quality.BUCKETS - 1) for h in [*map(one.get, ws), *(two[one[a], one[b]] for a, b in zip(ws, ws[1:]))]] for i, ws in words.items()}
    labels = collections.defaultdict(list)
    for r in spark.read.parquet(f"{small}/labels.parquet").collect():
        labels[r.doc_id].append((r.quality, r.toxic))
    good = {i for i, ls in labels.items() if min(q for q, _ in ls) == 1 and max(t for _, t in ls) == 0}
    raw, target = collections.Counter(), collections.Counter()
    for i, gs in grams.items():
        raw.update(gs)
        if i in good:
            target.update(gs)
    scale = sum(raw.values()) / sum(target.values())
    for i, t, _ in docs:
        ws, r = words[i], rows[i]
        counts = collections.Counter(tuple(ws[k : k + 3]) for k in range(len(ws) - 2))
        covered = {k + d for k in range(len(ws) - 2) if counts[tuple(ws[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        base = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
        score = sum(math.log((target[g] * scale + quality.SMOOTH) / (raw[g] + quality.SMOOTH)) for g in grams[i]) / len(grams[i]) if ws else 0.0
        assert r.score == pytest.approx(score, abs=2e-6) and r.base_failed == failed and r.kept == (not failed and r.score >= quality.THRESHOLD)


def test_op10(spark, small):
    """The pages' own template: what its article element holds."""
    import html

    def expected(page):
        body = re.sub(r"(?s)<!--.*?-->", "", page[page.index("<article>") : page.index("</article>")])
        blocks = re.split(r"(?i)</?(?:article|p|h\d|ul|ol|li|div|blockquote|table|tr|td|pre|section)\b[^>]*>", body)
        return " ".join(x for x in (" ".join(html.unescape(re.sub(r"<br[^>]*>", " ", b) if "<" not in re.sub(r"<br[^>]*>", "", b) else re.sub(r"<[^>]*>", "", re.sub(r"<br[^>]*>", " ", b))).split()) for b in blocks) if x)

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = {r.page_id: r for r in wrappers.op10_html_wrappers(spark, small).collect()}
    assert set(got) == set(pages)
    for i, page in pages.items():
        assert got[i].text == expected(page) and got[i].n_chars == len(got[i].text)
