"""Language identification of mixed-language texts: script ranges narrow the candidates of a word, hashed letter n-grams score it, and Viterbi with a switching penalty labels the words.

Words are runs of letters and marks, in lower case, cut after PIECE characters. A word's candidates are the languages that wrote at least RARE of their training letters in the word's script (its first letter's); where no
language did, the word says nothing. A candidate's score is the mean log likelihood of the word's n-grams (one to four letters, with the word's ends) in BUCKETS hashed buckets, times their number to the power DAMP,
relative to the best candidate's. The best labelling maximises the words' scores less PENALTY for every change of language. A text's language is the one with most letters under the labelling; its score is their share, times the mean
posterior of those words' candidates without the path.

The classifier is fitted on MOST documents of each language at most (those with the smallest hash of their id and text), counted by Spark; every text is labelled whole.

What bounds a task's memory: the table of BUCKETS scores for each learned language, a batch of texts, WORDS words' scores at a time or one text's, and a cache of CACHE words, emptied when it is full.

Defined cases: a null text, or one without a letter, is `und` with score 0, and so is every text when nothing was learned; ties go to the language whose name comes first; rows with a null language or text aren't learned from; repeated rows of the
training part count once; very long texts are labelled whole, words of a very long run are its pieces; an empty table gives no rows; other columns are kept and `_language` replaces one of that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BUCKETS = 1 << 16
GRAM = 4
STEP = np.uint64(0x9E3779B97F4A7C15)
FAR = 50.0
MOST = 4000
PIECE = 24
RARE = 0.001
SMOOTH = 0.5
DAMP = 0.75
PENALTY = 6.0
WORDS = 200_000
CACHE = 200_000
UNKNOWN = "und"
#: First and last code points of the blocks of scripts; everything else is script 0. Fixed values of the Unicode standard.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("sinhala", 0x0D80, 0x0DFF), ("thai", 0x0E00, 0x0E7F), ("lao", 0x0E80, 0x0EFF), ("tibetan", 0x0F00, 0x0FFF), ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF), ("mongolian", 0x1800, 0x18AF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7A3), ("han", 0x20000, 0x2FA1F),
]
LETTERS = regex.compile(rf"[\p{{L}}\p{{M}}]{{1,{PIECE}}}")
LETTER = regex.compile(r"\p{L}")


class Model(NamedTuple):
    """languages in the order of their names; weights[bucket, language] are log likelihoods, and 0 in a last row; uses[script, language] says whether a language is a candidate in a script."""

    languages: list[str]
    weights: np.ndarray
    uses: np.ndarray


def script(words: list[str]) -> np.ndarray:
    """The number of the script of every word's first letter."""
    points = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    order = sorted(range(len(SCRIPTS)), key=lambda k: SCRIPTS[k][1])
    first, last = (np.array([SCRIPTS[k][side] for k in order]) for side in (1, 2))
    at = np.searchsorted(first, points, side="right") - 1
    return np.where((at >= 0) & (points <= last[at]), np.array(order)[at] + 1, 0)


def grams(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For n from one to four the bucket of the n-gram that begins at each character of the words, which have an end on either side and follow one another (BUCKETS where it would leave its word); the words' first places; how many
    n-grams each has."""
    points = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    left = np.repeat(starts + sizes, sizes) - np.arange(len(points))
    out, hashes = [], np.zeros(len(points), np.uint64)
    for n in range(1, GRAM + 1):
        hashes[: len(points) - n + 1] = hashes[: len(points) - n + 1] * STEP + points[n - 1 :] + np.uint64(n)
        out.append(np.where(left >= n, ((hashes * STEP) >> np.uint64(48)).astype(np.int64) % BUCKETS, BUCKETS))
    return out, starts, sum(np.maximum(sizes - n + 1, 0) for n in range(1, GRAM + 1))


def counted(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, kind, at, n): how often the texts of a language have an n-gram's bucket (kind 0) and a script's letters (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, dict[str, int]] = {}
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = found.setdefault(name, {})
                for word in LETTERS.findall(content.as_py().lower()):
                    words[word] = words.get(word, 0) + 1
            for name, words in found.items():
                found_grams, letters = np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPTS) + 1, np.int64)
                known, times = list(words), np.fromiter(words.values(), np.int64, len(words))
                for start in range(0, len(known), WORDS):
                    some, n = known[start : start + WORDS], times[start : start + WORDS]
                    of = np.repeat(n, np.fromiter(map(len, some), np.int64, len(some)) + 2)
                    for at in grams(some)[0]:
                        found_grams += np.bincount(at, of, BUCKETS + 1).astype(np.int64)[:BUCKETS]
                    letters += np.bincount(script(some), n * np.fromiter(map(len, some), np.int64, len(some)), len(letters)).astype(np.int64)
                for kind, counts in ((0, found_grams), (1, letters)):
                    at = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "kind", "at", "n"])

    parts = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(run, "lang string, kind int, at int, n bigint")
    return parts.groupBy("lang", "kind", "at").agg(F.sum("n").alias("n"))


def training(docs: DataFrame, id_col: str, lang: str, text: str, most: int) -> DataFrame:
    """`most` rows of each language at most, chosen by a hash: first in each of 64 parts of a language, then among those."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("_lang"), F.col(text).cast("string").alias("_text"), F.xxhash64(id_col, text).alias("_h"))
    ids = rows.select("_lang", "_h").distinct()
    for part in (["_lang", F.pmod("_h", F.lit(64))], ["_lang"]):
        ids = ids.withColumn("_at", F.row_number().over(Window.partitionBy(*part).orderBy("_h"))).where(F.col("_at") <= most)
    bound = ids.groupBy(F.col("_lang").alias("_l")).agg(F.max("_h").alias("_most"))  # one row for each language
    near = rows.join(F.broadcast(bound), (F.col("_lang") == F.col("_l")) & (F.col("_h") <= F.col("_most"))).dropDuplicates(["_lang", "_h"])
    return near.select(F.col("_lang").alias("lang"), F.col("_text").alias("text"))


def learn(docs: DataFrame, id_col: str = "doc_id", lang: str = "lang", text: str = "text", most: int = MOST) -> Model:
    """The model of the rows' languages."""
    counts = counted(training(docs, id_col, lang, text, most), "lang", "text").toArrow()  # BUCKETS rows for each language at most
    names, kind, at, n = (counts.column(c).combine_chunks() for c in ("lang", "kind", "at", "n"))
    languages = sorted(set(names.to_pylist()))
    order = {name: k for k, name in enumerate(languages)}
    row = np.array([order[x] for x in names.to_pylist()], dtype=np.int64)
    kind, at, n = (x.to_numpy(zero_copy_only=False) for x in (kind, at, n))
    seen, letters = np.zeros((BUCKETS, len(languages))), np.zeros((len(SCRIPTS) + 1, len(languages)))
    for k, table in ((0, seen), (1, letters)):
        np.add.at(table, (at[kind == k], row[kind == k]), n[kind == k])
    weights = np.log((seen + SMOOTH) / (seen.sum(0) + SMOOTH * BUCKETS))
    # Ranges of one script count together.
    name = [""] + [s[0] for s in SCRIPTS]
    together = np.array([letters[[i for i, x in enumerate(name) if x == s]].sum(0) for s in name])
    return Model(languages, np.concatenate([weights, np.zeros((1, len(languages)))]).astype(np.float32), together >= RARE * np.maximum(letters.sum(0), 1))


def scores_of(words: list[str], model: Model) -> np.ndarray:
    """Every language's score for every word: 0 for the best candidate, less for the others, least for languages that are none."""
    places, starts, counts = grams(words)
    total = sum(np.add.reduceat(model.weights[at], starts) for at in places) / counts[:, None] ** (1 - DAMP)
    uses = model.uses[script(words)]
    total = np.where(uses, total, -np.inf)
    return np.where(uses.any(1)[:, None], np.maximum(total - np.where(uses.any(1), total.max(1), 0)[:, None], -FAR), 0).astype(np.float32)


def labelled(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best path's language of every word; `lengths` are the texts' numbers of words, whose scores follow one another. Texts go in step, the longest first."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    n, langs = len(scores), scores.shape[1]
    if not n:
        return np.zeros(0, np.int32)
    stay, source = np.empty((n, langs), bool), np.empty(n, np.int32)
    active = int((sizes > 0).sum())
    total = scores[starts[:active]].copy()
    live = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), side="right")  # how many texts have a t-th word
    for t in range(1, int(sizes[0])):
        active = int(live[t])
        at, total_t = starts[:active] + t, total[:active]
        top = total_t.argmax(1)
        change = total_t[np.arange(active), top] - penalty
        stays = total_t >= change[:, None]
        stay[at], source[at] = stays, top
        total[:active] = np.where(stays, total_t, change[:, None]) + scores[at]
    label = np.empty(n, np.int32)
    now = total.argmax(1).astype(np.int32)
    for t in range(int(sizes[0]) - 1, -1, -1):
        active = int(live[t])
        at = starts[:active] + t
        label[at] = now[:active]
        if t:
            now[:active] = np.where(stay[at, now[:active]], now[:active], source[at])
    return label


def identify(docs: DataFrame, model: Model, text: str = "text", penalty: float = PENALTY, spans: bool = True) -> DataFrame:
    """The rows with _language: lang, score and the spans (start and end in code points of the text in lower case, lang) of equally labelled words; without `spans` their list is empty."""
    languages = model.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        table = np.zeros((0, len(languages)), np.float32)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found: list = [(UNKNOWN, 0.0, [])] * len(texts)
            group: list[int] = []
            words: list[str] = []
            places: list[tuple[int, int]] = []
            lengths: list[int] = []
            for n, content in enumerate(texts):
                if content is None or not languages or not LETTER.search(content):
                    continue
                lower = content.lower()
                own = LETTERS.findall(lower)
                if spans:
                    places += [m.span() for m in LETTERS.finditer(lower)]
                group.append(n)
                words += own
                lengths.append(len(own))
                if len(words) >= WORDS:
                    table = _judge(group, words, places, lengths, cache, table, found)
                    group, words, places, lengths = [], [], [], []
            if group:
                table = _judge(group, words, places, lengths, cache, table, found)
            kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))])
            rows = [{"lang": a, "score": b, "spans": [{"start": s, "end": e, "lang": x} for s, e, x in c]} for a, b, c in found]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, kind)], ["row", "_language"])

    def _judge(group: list[int], words: list[str], places: list[tuple[int, int]], lengths: list[int], cache: dict[str, int], table: np.ndarray, found: list) -> np.ndarray:
        if len(cache) > CACHE:
            cache.clear()
            table = table[:0]
        new = [w for w in dict.fromkeys(words) if w not in cache]
        if new:
            table = np.concatenate([table, scores_of(new, model)])
            cache.update(zip(new, range(len(cache), len(cache) + len(new))))
        at = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
        scores = table[at]
        sizes, letters = np.array(lengths), np.fromiter(map(len, words), np.int64, len(words))
        labels = labelled(scores, sizes, penalty)
        text_of = np.repeat(np.arange(len(group)), sizes)
        share = np.zeros((len(group), len(languages)))
        np.add.at(share, (text_of, labels), letters)
        likely = np.exp(scores[np.arange(len(words)), labels]) / np.exp(scores).sum(1)
        belief = np.zeros_like(share)
        np.add.at(belief, (text_of, labels), letters * likely)
        best = share.argmax(1)
        ends = np.cumsum(sizes)
        for k, n in enumerate(group):
            total = share[k].sum()
            runs = []
            if spans:
                first, own = int(ends[k] - sizes[k]), labels[ends[k] - sizes[k] : ends[k]]
                cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
                runs = [(places[first + a][0], places[first + b - 1][1], languages[own[a]]) for a, b in zip(cuts, cuts[1:])]
            found[n] = (languages[best[k]], float(belief[k, best[k]] / total) if total else 0.0, runs)
        return table

    names = [c for c in docs.columns if c != "_language"]
    # The rows travel as one column, so their names can't clash.
    rows = docs.select(F.col(text).cast("string").alias("text"), F.struct(*names).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(run, f"row {kind}, _language struct<lang:string,score:double,spans:array<struct<start:bigint,end:bigint,lang:string>>>")
    return out.select(*[F.col("row")[c].alias(c) for c in names], "_language")


def held_out(id_col: Column) -> Column:
    """Whether a row is held out: the CRC-32 of its id as text leaves 2 when divided by four. A null id is not."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(4)) == 2, F.lit(False))


def op11_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"))
    model = learn(docs.where(~out))
    found = identify(docs.select("doc_id", out.alias("held_out"), F.struct("text").alias("_held")).select("doc_id", "held_out", "_held.text"), model, spans=False)
    return found.select("doc_id", "held_out", F.col("_language.lang").alias("lang_pred"), F.col("_language.score").alias("score"))
