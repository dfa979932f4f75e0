"""The best paths of op4 over whole small tables: against a plain search over every word, and read back."""

import hashlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from inkloom.llm import pieces


def best_score(word, known, longest, worst):
    best = [0.0]
    for j in range(1, len(word) + 1):
        best.append(max(best[i] + (known[word[i:j]][1] if word[i:j] in known else worst) for i in range(max(0, j - longest), j) if word[i:j] in known or i == j - 1))
    return best[-1]


def test_paths_of_all_documents(spark, small):
    model = pieces.PieceModel()
    known, shown = model.vocabulary(), model.byte_table()
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{small}/documents.parquet").to_pylist()}
    rows = pieces.op4_sentencepiece(spark, small).collect()
    assert len(rows) == len(texts)
    of_part: dict[str, list[int]] = {}
    other = 0
    for r in rows:
        words = pieces.cut_words(texts[r.doc_id], model.dummy_prefix, model.cut_lines)
        want = []
        for w in words:
            for part in pieces.cut_apart(w, model.pairs):
                if part not in of_part:
                    of_part[part] = pieces.viterbi_of(part, known, model.bytes, model.longest, model.worst)
                    spelled = [(i, model.types[i] == pieces.BYTE) for i in of_part[part]]
                    score = sum(model.scores[i] for i, byte in spelled if not byte) + model.worst * sum(c not in known for c in part)
                    assert score == pytest.approx(best_score(part, known, model.longest, model.worst))
                want += of_part[part]
        assert r.path_ids == want
        text = b"".join(shown[i] for i in r.path_ids)[int(model.dummy_prefix) :]
        assert hashlib.sha256(text).hexdigest() == r.decoded_sha256
        other += r.path_ids != r.token_ids
    assert other > 0


def test_paths_of_odd_texts(spark):
    model = pieces.PieceModel()
    texts = [None, "", " ", "a", "x" * 200 + " " + "ab" * 90, "\0 zero", "日本語 😀 \U0001f9ff", "  two  blanks ", "line\n\nline"] * 2
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, path_ids int")
    got = pieces.encode(docs, model, paths=True, block_bytes=50, group_bytes=40)
    back = {r.id: r.decoded for r in pieces.decode(got, model, "path_ids").collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    plain = {r.id: r.token_ids for r in pieces.encode(docs, model).collect()}
    assert {r.id: r.token_ids for r in got.collect()} == plain
    assert pieces.encode(docs.limit(0), model, paths=True).columns == ["id", "token_ids", "decoded_sha256", "path_ids"]


def test_words_of_a_batch_are_folded_side_by_side(spark):
    model = pieces.PieceModel()
    known = model.vocabulary()
    words = ["▁the", "▁interesting", "a", "▁", "日本語", "\U0001f9ffx\U0001f9ff", "\U0001f9ff", "aaaaaaaaaaaaa", "▁mississippi", "z" * pieces.SHORT, "é́ß"]
    rows = pieces.lattice(spark.createDataFrame(list(zip(words, range(len(words)))), "word string, at bigint").coalesce(1), model)
    assert rows.columns == ["word", "at", "edges", "singles"]  # no table of characters or scores, which would be copied for each word
    of = rows.toArrow().combine_chunks().to_batches()[0]
    got = of.column("word").to_pylist()
    assert sorted(got) == sorted(words)
    columns = [of.column(c) for c in ("word", "edges", "singles")]
    assert pieces.fold_merges(*columns, model.bytes).to_pylist() == [pieces.merges_of(w, known, model.bytes) for w in got]
    assert pieces.fold_viterbi(*columns, model.bytes, np.array(model.scores), model.worst).to_pylist() == [pieces.viterbi_of(w, known, model.bytes, model.longest, model.worst) for w in got]
    none = [c.slice(0, 0) for c in columns]
    assert len(pieces.fold_merges(*none, model.bytes)) == len(pieces.fold_viterbi(*none, model.bytes, np.array(model.scores), model.worst)) == 0
