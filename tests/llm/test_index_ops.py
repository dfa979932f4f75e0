"""Language identification, hard negatives and the manifest against brute force, and their defined cases."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from inkloom.llm import langid, manifest, negatives

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def stored(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# Manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes):
    paths, cover = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, covers = [], []
        for a in range(0, len(nodes), 8):
            run = nodes[a : a + 8]
            for j in range(len(run)):
                for i in cover[a + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(sha("".join(run)))
            covers.append([i for c in cover[a : a + 8] for i in c])
        nodes, cover = up, covers
    return nodes[0], paths


def manifest_by_hand(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = str.maketrans(manifest.UPPER, manifest.LOWER)
    groups = {}
    for r in rows:
        plain = sha("".join(field(r[c]) for c in manifest.FIELDS))
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None
        now = sha("".join(field(r[c].translate(low) if c == "text" else r[c]) for c in manifest.FIELDS)) if hit else plain
        groups.setdefault(r["lang"], []).append((r["doc_id"], plain, now))
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    groups = {k: sorted(groups[k], key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for k in names}
    trees = {k: tree([x[1] for x in groups[k]]) for k in names}
    root, tops = tree([trees[k][0] for k in names])
    out = []
    for k, top in zip(names, tops):
        for (doc, plain, now), path in zip(groups[k], trees[k][1]):
            folded = now
            for left, right in path + top:
                folded = sha(left + folded + right)
            out.append((doc, plain, trees[k][0], root, sha("".join(a + b for a, b in path + top)), folded, folded == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_manifest_of_all_documents(spark, folder):
    got = sorted(map(tuple, manifest.op13_merkle_manifest(spark, folder).collect()), key=repr)
    assert got == manifest_by_hand(pq.read_table(f"{folder}/documents.parquet").to_pylist())
    assert not all(r[-1] for r in got)


def test_manifest_of_odd_rows(spark, tmp_path):
    """Null and repeated ids, null and single languages, repeated rows, long texts, runs of one and groups beyond a block."""
    rows = [(i if i % 11 else None, None if i % 17 == 0 else f"Text {i} Ä" * (i % 3), "en" if i % 2 else None, "s", i) for i in range(1300)]
    rows += [(9, "A", "de", None, None)] * 3 + [(10, "B" * 300_000, "xx", "s", 1), (2, "b", "=", "", 0), (3, "c", "", "", 0)]
    rows += [(100 + i, f"L{i}", f"l{i}", "s", i) for i in range(70)]
    folder = stored(spark, tmp_path, "documents", rows, DOCUMENTS + "")
    got = sorted(map(tuple, manifest.op13_merkle_manifest(spark, folder).collect()), key=repr)
    assert got == manifest_by_hand([dict(zip(["doc_id", "text", "lang", "source", "n_chars"], r)) for r in rows])


def test_manifest_of_nothing_of_one_and_with_clashing_names(spark, tmp_path):
    assert manifest.op13_merkle_manifest(spark, stored(spark, tmp_path / "a", "documents", [], DOCUMENTS)).collect() == []
    one = manifest.op13_merkle_manifest(spark, stored(spark, tmp_path / "b", "documents", [(1, "x", "en", "s", 1)], DOCUMENTS)).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == sha("") and one["verified"]
    extra = ", key string, pos bigint, n bigint, digest string, path string, block bigint, h0 string, root string, at bigint"
    rows = [(i, f"x{i}", "en", "s", i, "k", 1, 2, "d", "p", 3, "h", "r", 4) for i in range(20)]
    got = manifest.op13_merkle_manifest(spark, stored(spark, tmp_path / "c", "documents", rows, DOCUMENTS + extra)).collect()
    assert sorted(map(tuple, got), key=repr) == manifest_by_hand([dict(zip(["doc_id", "text", "lang", "source", "n_chars"], r)) for r in rows])


# Hard negatives


def negatives_by_hand(rows):
    use = []
    for vec, x, label in rows:
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        use.append((vec, (label + 1) % 10 if vec is not None and vec % 7 == 0 else label, [math.floor(256 * v) for v in x]))
    out = []
    for a, la, xa in {(i, j, tuple(x)) for i, j, x in use if i is not None and i % 100 == 0}:
        score = lambda x: sum(p * q for p, q in zip(xa, x))  # noqa: E731, B023
        order = lambda r: (-r[0], r[1] is None, r[1] or 0)
        mates = sorted(((score(x), i) for i, j, x in use if j == la and i != a), key=order)[:5]
        others = sorted(((score(x), i) for i, j, x in use if j != la), key=order)
        for rank, (ps, p) in enumerate(mates, 1):
            fits = [(s, i) for s, i in others if 30 * ps <= 100 * s <= 90 * ps][:10]
            out += [(a, p, k, i, ps, s, rank) for k, (s, i) in enumerate(fits, 1)]
    return sorted(out, key=repr)


def mined(spark, folder):
    return sorted(map(tuple, negatives.op12_hard_negatives(spark, folder).collect()), key=repr)


VECTORS = "vec_id bigint, embedding array<float>, label int"


def test_negatives_of_all_vectors(spark):
    table = pq.read_table("/root/testdata/sf0.01/embeddings.parquet").to_pylist()
    want = negatives_by_hand([(r["vec_id"], r["embedding"], r["label"]) for r in table])
    assert mined(spark, "/root/testdata/sf0.01") == want and want


def test_negatives_of_odd_rows(spark, tmp_path):
    """Nulls in every place, numbers that aren't finite, ties, repeated and null ids, one vector that a third of the rows share, negative and zero scores."""
    draw = random.Random(3)
    rows = [(i, [float(np.float32(draw.gauss(0, 0.2))) for _ in range(8)], i % 4) for i in range(600)]
    rows += [(1000 + i, [0.5] * 8, i % 2) for i in range(300)] + [(100, [0.5] * 8, 1), (200, [0.0] * 8, 2), (300, [-0.5] * 8, 3)]
    rows += [(7, None, 1), (8, [0.1] * 7 + [None], 1), (9, [float("nan")] * 8, 1), (10, [float("inf")] * 8, 2), (11, [0.1] * 8, None), (None, [0.4] * 8, 2), (None, [0.4] * 8, 1)]
    assert mined(spark, stored(spark, tmp_path, "embeddings", rows, VECTORS)) == negatives_by_hand(rows)


def test_negatives_of_little(spark, tmp_path):
    for name, rows in (("a", []), ("b", [(0, [1.0, 2.0], 1)]), ("c", [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)]), ("d", [(100, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [0.5, 1.0], 3)]), ("e", [(0, [], 1)])):
        assert mined(spark, stored(spark, tmp_path / name, "embeddings", rows, VECTORS)) == negatives_by_hand(rows)


def test_first_pass_of_any_length_gives_the_same(spark):
    draw = random.Random(5)
    rows = spark.createDataFrame([(i, i % 3, [draw.randrange(-50, 50) for _ in range(6)]) for i in range(400)], "id bigint, label int, vector array<int>")
    a, b = (sorted(map(tuple, negatives.hard_negatives(rows, F.col("id") % 50 == 0, codewords=c, sample=s, first=f).collect())) for c, s, f in ((3, 30, 1), (12, 400, 10_000)))
    assert a == b and a


def test_heap_visits_by_falling_sums_and_bounds_hold():
    draw = np.random.default_rng(1)
    left, right = draw.normal(size=7), draw.normal(size=5)
    got = list(negatives.heap_order(left, right))
    assert [g[0] for g in got] == sorted((float(a + b) for a, b in itertools.product(left, right)), reverse=True)
    assert len({(i, j) for _, i, j in got}) == 35
    big = np.array([[1 << 60, 5, 1 << 60]])
    assert negatives.best(big, np.ones((1, 3), bool), 2)[1].tolist() == [0, 2]


# Language identification


def test_languages_of_all_documents(spark):
    got = {r["doc_id"]: r for r in langid.op11_language_id(spark, "/root/testdata/sf0.01").collect()}
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()
    assert len(got) == len(table)
    for r in table:
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= got[r["doc_id"]]["score"] <= 1
    held = [r for r in table if got[r["doc_id"]]["held_out"]]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)


def best_path(scores, penalty):
    n, langs = scores.shape
    return max(sum(scores[t, p[t]] for t in range(n)) - penalty * sum(a != b for a, b in zip(p, p[1:])) for p in itertools.product(range(langs), repeat=n))


def test_viterbi_finds_the_best_path():
    draw = np.random.default_rng(2)
    lengths = np.array([3, 0, 6, 1, 5])
    scores = draw.normal(size=(15, 3)).astype(np.float32)
    got = langid.labelled(scores, lengths, 0.7)
    at = 0
    for n in lengths:
        own, path = scores[at : at + n], got[at : at + n]
        if n:
            value = sum(own[t, path[t]] for t in range(n)) - 0.7 * sum(a != b for a, b in zip(path, path[1:]))
            assert value == pytest.approx(best_path(own, 0.7), abs=1e-5)
        at += n


EN = "the house and the garden were quiet when the children walked home with their mother in the evening "
DE = "das haus und der garten waren still als die kinder am abend mit ihrer mutter nach hause gingen "
RU = "дом и сад были тихими когда дети вечером шли домой со своей матерью "


def test_spans_scripts_and_odd_texts(spark):
    docs = [(i, text * 20, lang, i) for i, (text, lang) in enumerate([(EN, "en"), (DE, "de"), (RU, "ru")] * 4)]
    schema = "doc_id bigint, text string, lang string, _language int"
    model = langid.learn(spark.createDataFrame(docs, schema))
    assert model.languages == ["de", "en", "ru"]
    mixed = EN + DE + RU + EN
    texts = [mixed, None, "", "123 --- 456", "你好世界", "́", RU, "x" * 50_000 + " " + EN * 4000, "É"]
    got = [r["_language"] for r in langid.identify(spark.createDataFrame([(i, t, None, 0) for i, t in enumerate(texts)], schema), model).orderBy("doc_id").collect()]
    spans = [(s["lang"], mixed.lower()[s["start"] : s["end"]]) for s in got[0]["spans"]]
    assert [s[0] for s in spans] == ["en", "de", "ru", "en"] and spans[2][1] == RU.strip()
    assert [g["lang"] for g in got[1:4]] == ["und"] * 3 and got[5]["lang"] == "und"
    assert got[4]["lang"] in model.languages and got[6]["lang"] == "ru" and got[7]["lang"] == "en"
    nothing = langid.learn(spark.createDataFrame([], schema))
    assert langid.identify(spark.createDataFrame([(1, "text", None, 0)], schema), nothing).first()["_language"]["lang"] == "und"


def test_bound_of_training_rows(spark):
    docs = spark.createDataFrame([(i % 500, f"text {i % 500}", "en" if i % 50 else "fr") for i in range(1000)], "doc_id bigint, text string, lang string")
    got = {r["lang"]: r["count"] for r in langid.training(docs, "doc_id", "lang", "text", 40).groupBy("lang").count().collect()}
    assert got == {"en": 40, "fr": 10}


def test_languages_of_an_empty_table_and_nulls(spark, tmp_path):
    assert langid.op11_language_id(spark, stored(spark, tmp_path / "a", "documents", [], DOCUMENTS)).collect() == []
    rows = [(None, "hello there", "en", None, None), (2, None, None, None, None), (3, "hello", None, None, None)]
    got = {r["doc_id"]: r for r in langid.op11_language_id(spark, stored(spark, tmp_path / "b", "documents", rows, DOCUMENTS)).collect()}
    assert got[None]["lang_pred"] == "en" and got[None]["held_out"] is False and got[2]["lang_pred"] == "und" and got[3]["lang_pred"] == "en"
