"""SentencePiece encoding and decoding as relations.

Words are the text's stretches of a blank (or more) and what follows it up to the next blank, cut further between characters that are neighbours in no piece; no
piece crosses into the next word, which is checked when a model is read. A word is encoded once, however often it occurs: its substrings of bounded length are exploded and joined with the piece
table on equality, the matches are the edges of the word's lattice, and the edges, grouped by word, are folded, the words of an Arrow batch side by side.

The relational lattice (lattice) is the dealt method, and every word of up to SHORT characters goes through it. Its edges are folded by Viterbi (fold_viterbi): the best score of each place over the edges that end there. A unigram
model's ids are this path. A BPE model's encoder is not a best path but a row of merges, best score first, and for many words its ids are others; so there token_ids comes from a second fold
over the same lattice (fold_merges), whose state is the set of places where tokens end and whose steps remove the place inside the best edge that spans exactly two tokens, and the path stands beside it as path_ids (`paths`).
Characters without a piece become their bytes' pieces. The rare words of more than SHORT characters are encoded by a helper with the same rules where they
are met, so that no lattice grows with a text. Models whose rules are not these (a normaliser that changes characters or blanks, user-defined pieces, blanks as suffixes) are refused when read.

Documents are cut into blocks of about `block_bytes`. A block keeps its documents as word numbers and sends its word list, packed, to the word groups (by
hash, MOST_GROUPS at most, so that packets grow in proportion to the input); a group's distinct words are encoded once, its codes go back to the blocks that asked, a packet at a time, and there the documents are put together. A
very common word travels once for each block. The input must be one that gives the same rows in the same partitions when it is read again, as stored tables do. What bounds a task's memory: one block with one text at a time beside it, or
the distinct words of one group with its codes and the packed lists that ask for them.

Defined cases: null and empty texts have no tokens; very long texts are one block, whole; blanks are kept, and so are all other characters but the blank's own sign U+2581, which decodes to
a blank as the model's own decoder has it; ties between paths go to the longer last piece, between merges to the first place; repeated rows are encoded each; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from operator import add
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
SHORT = 61
#: Word groups, and so packets that a block sends, are this many at most.
MOST_GROUPS = 8192
#: Fixed values of the model file's format: piece types, model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: How many words are folded at once: what a fold holds beside its batch is bounded by these.
SIDE_BY_SIDE = 1024
#: Stands for a piece's id where a character is none and becomes its bytes' pieces.
SPELLED = (1 << 20) - 1


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
        yield key >> 3, data[at : at + size]
        at += size


class PieceModel:
    """A model file's pieces, scores and types. Only the parts that encoding needs are read."""

    def __init__(self, path: str = MODEL):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.kind, self.dummy_prefix = UNIGRAM, True
        for number, value in _fields(Path(path).read_bytes()):
            if number == 1:
                found = dict(_fields(value))
                self.pieces.append(found[1].decode())
                self.scores.append(struct.unpack("<f", found[2])[0] if 2 in found else 0.0)
                self.types.append(found.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                self.kind = trainer.get(3, UNIGRAM)
                if trainer.get(24):
                    raise ValueError("the model has blanks as suffixes")
            elif number == 3:
                rules = dict(_fields(value))
                self.dummy_prefix = bool(rules.get(3, 1))
                if rules.get(2):
                    raise ValueError("the model's normaliser changes characters")
                if rules.get(4, 1) or not rules.get(5, 1):
                    raise ValueError("the model's normaliser removes blanks or doesn't escape them")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("the model is neither unigram nor BPE")
        if len(self.pieces) > SPELLED:
            raise ValueError("the model has more pieces than an edge's number can tell apart")
        if USER_DEFINED in self.types:
            raise ValueError("the model has user-defined pieces, which come before all others")
        self.bytes = [0] * 256
        for i, (p, t) in enumerate(zip(self.pieces, self.types)):
            if t == BYTE:
                self.bytes[int(p[1:-1], 16)] = i
        normal = [p for p, t in zip(self.pieces, self.types) if t in (NORMAL, USER_DEFINED)]
        if any(BLANK in p.lstrip(BLANK) for p in normal):
            raise ValueError("a piece has a blank inside: words can't be encoded one by one")
        self.longest = max(map(len, normal))
        # A character that no piece of two or more holds parts words exactly; line ends are the common case.
        self.cut_lines = not any("\n" in p for p in normal if len(p) > 1)
        #: Neighbouring characters that some piece holds: between others no piece can reach, so a word can be cut there without a change of its ids.
        self.pairs = {p[i : i + 2] for p in normal for i in range(len(p) - 1)}
        self.worst = min(s for s, t in zip(self.scores, self.types) if t == NORMAL) - 10.0

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, piece_id, score, place) of the pieces that a text can hold; place: 0 for the best score, equal for equal scores."""
        rows = [(p, i, float(s)) for p, (i, s) in self.vocabulary().items()]
        place = {s: k for k, s in enumerate(sorted({r[2] for r in rows}, reverse=True))}
        piece, number, score = map(list, zip(*rows))
        return spark.createDataFrame(pa.table({"piece": piece, "piece_id": number, "score": score, "place": [place[s] for s in score]}))

    def vocabulary(self) -> dict[str, tuple[int, float]]:
        return {p: (i, s) for i, (p, s, t) in enumerate(zip(self.pieces, self.scores, self.types)) if t in (NORMAL, USER_DEFINED)}

    def byte_table(self) -> list[bytes]:
        """What each id decodes to."""
        plain = lambda p, t: b"" if t in (UNKNOWN, CONTROL) else bytes([int(p[1:-1], 16)]) if t == BYTE else p.replace(BLANK, " ").encode()
        return [plain(p, t) for p, t in zip(self.pieces, self.types)]


def cut_words(text: str, dummy_prefix: bool = True, cut_lines: bool = True) -> list[str]:
    """The words of a text, blanks shown by their sign; with `cut_lines` line ends are words of their own. Joined they are the text (after the dummy prefix)."""
    if not text:
        return []
    out: list[str] = []
    for k, line in enumerate(text.split("\n") if cut_lines else (text,)):
        if k:
            out.append("\n")
        lead = dummy_prefix and not k
        if "  " in line or BLANK in line or line[:1] == " " or line[-1:] == " " or not line:
            out += re.findall(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+", (BLANK if lead else "") + line.replace(" ", BLANK))
            continue
        first, *rest = line.split(" ")
        out.append(BLANK + first if lead else first)
        out += [BLANK + w for w in rest]
    return out


def cut_apart(word: str, pairs: set[str]) -> list[str]:
    """The parts of a word between which no piece reaches."""
    cuts = [i for i, pair in enumerate(map(add, word, word[1:]), 1) if pair not in pairs]
    return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])] if cuts else [word]


def lattice(words: DataFrame, model: PieceModel) -> DataFrame:
    """`words` (word: distinct, 1 to SHORT characters, at) with what each holds, as one number for each edge.

    `edges`: the pieces of two or more characters, best first: place, start, end and id, 17, 6, 6 and 20 bits from the top. `singles`: the characters in order: start, end and id, 6, 6 and 20 bits, the id SPELLED where the character
    is no piece. So a row has all that its folds ask for; a table of all characters beside it would be copied for each word.
    """
    # Bounded by the vocabulary, which doesn't grow with the input. The hash is the join's key (no two pieces share one), the strings are compared after it.
    table = F.broadcast(model.table(words.sparkSession).select(F.xxhash64("piece").alias("h"), "piece", "piece_id", "place"))
    n = F.length("word")
    spans = words.select("word", "at", F.explode(F.sequence(F.lit(1), n)).alias("a"))
    spans = spans.select("word", "at", "a", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), n - F.col("a") + 1))).alias("k"))
    spans = spans.withColumn("part", F.expr("substring(word, a, k)"))
    found = spans.join(table, F.xxhash64("part") == F.col("h"), "left")
    hit, one = F.col("part") == F.col("piece"), F.col("k") == 1
    span = F.expr("shiftleft(cast(a - 1 AS bigint), 26) | shiftleft(cast(a + k - 1 AS bigint), 20)")
    edge = F.expr("shiftleft(cast(place AS bigint), 32)").bitwiseOR(span).bitwiseOR(F.col("piece_id"))
    single = span.bitwiseOR(F.when(hit, F.col("piece_id")).otherwise(F.lit(SPELLED)))
    found = found.where(hit | one).select("word", "at", F.when(~one, edge).alias("edge"), F.when(one, single).alias("single"))
    return found.groupBy("word", "at").agg(*[F.sort_array(F.collect_list(c)).alias(f"{c}s") for c in ("edge", "single")])


class Edges:
    """The edges of many words' lattices side by side: of which word, start, end, id. Numbers as `lattice` has them."""

    def __init__(self, lists: pa.ListArray):
        number = lists.flatten().to_numpy()
        self.sizes = lists.value_lengths().to_numpy()
        self.of, self.start, self.end, self.id = np.repeat(np.arange(len(lists)), self.sizes), number >> 26 & 63, number >> 20 & 63, number & SPELLED


def _read(words: pa.Array, of: np.ndarray, start: np.ndarray, ids: np.ndarray, of_bytes: list[int]) -> pa.ListArray:
    """The words' ids from tokens in any order; SPELLED characters become their bytes' pieces."""
    order = np.argsort(of << 6 | start)
    of, start, ids = of[order], start[order], ids[order].astype(np.int32)
    rare = np.flatnonzero(ids == SPELLED)
    if len(rare):
        codes = [[of_bytes[b] for b in w[a].encode("utf-8", "surrogatepass")] for w, a in zip(words.take(pa.array(of[rare])).to_pylist(), start[rare].tolist())]
        times = np.ones(len(of), np.int64)
        times[rare] = list(map(len, codes))
        of, ids = np.repeat(of, times), np.repeat(ids, times)
        ids[ids == SPELLED] = [i for c in codes for i in c]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(words) + 1)), pa.int32()), pa.array(ids))


def fold_merges(words: pa.Array, edges: pa.ListArray, singles: pa.ListArray, of_bytes: list[int]) -> pa.ListArray:
    """The ids of many words at once after all merges, best first, from their lattices.

    A word's places where tokens end are the bits of a number. In each round the best edge of each word that spans exactly two tokens takes away the place inside it; edges that lost an end, and words without such an edge, leave the rounds.
    """
    e, c, one = Edges(edges), Edges(singles), np.int64(1)
    ends, inside = one << e.start | one << e.end, (one << e.end) - (one << e.start + 1)
    places = (one << c.sizes + one) - 1
    live = np.arange(len(e.of))
    while len(live):
        now = places[e.of[live]]
        there = (now & ends[live]) == ends[live]
        live, now = live[there], now[there]
        two = live[np.bitwise_count(now & inside[live]) == 1]
        best = two[np.diff(e.of[two], prepend=-1) != 0]
        places[e.of[best]] &= ~inside[best]
        going = np.zeros(len(words), bool)
        going[e.of[best]] = True
        live = live[going[e.of[live]]]
    now = places[e.of]
    token, alone = ((now & ends) == ends) & (now & inside == 0), (places[c.of] >> c.start & 3) == 3
    return _read(words, *(np.concatenate([x[token], y[alone]]) for x, y in ((e.of, c.of), (e.start, c.start), (e.id, c.id))), of_bytes)


def fold_viterbi(words: pa.Array, edges: pa.ListArray, singles: pa.ListArray, of_bytes: list[int], scores: np.ndarray, worst: float) -> pa.ListArray:
    """The ids of many words' paths of the best score sum (ties: the longer last piece), from their lattices. scores: the pieces' by id; `worst`: a character's that is no piece.

    The fold goes from place to place, over all words at once: an edge's worth is its score and the best of its start, and the best edge that ends at a place is kept. From these the path is read back.
    """
    both = [Edges(edges), Edges(singles)]
    of, start, end, ids = (np.concatenate([getattr(x, c) for x in both]) for c in ("of", "start", "end", "id"))
    order = np.lexsort((start, of, end))
    of, start, end, ids = of[order], start[order], end[order], ids[order]
    score = np.where(ids == SPELLED, worst, scores[np.where(ids == SPELLED, 0, ids)])
    size, last = both[1].sizes, int(end[-1]) if len(end) else 0
    best, came = np.zeros((len(words), last + 1)), np.zeros((len(words), last + 1), np.int64)
    stops = np.searchsorted(end, np.arange(1, last + 2))
    for j, (a, z) in enumerate(zip(stops.tolist(), stops[1:].tolist()), 1):
        mine = of[a:z]
        worth = best[mine, start[a:z]] + score[a:z]
        first = np.flatnonzero(np.diff(mine, prepend=-1))
        top = np.maximum.reduceat(worth, first)
        chosen = np.flatnonzero(worth == np.repeat(top, np.diff(first, append=z - a)))
        chosen = chosen[np.diff(mine[chosen], prepend=-1) != 0]  # of equal ones that with the smallest start
        best[mine[first], j], came[mine[first], j] = top, a + chosen
    path, going, at = [], np.arange(len(words)), size
    while len(going):
        path.append(came[going, at])
        at = start[path[-1]]
        going, at = going[at > 0], at[at > 0]
    path = np.concatenate(path) if path else np.array([], np.int64)
    return _read(words, of[path], start[path], ids[path], of_bytes)


def merges_of(word: str, known: dict[str, tuple[int, float]], of_bytes: list[int]) -> list[int]:
    """fold_merges for words of any length, with a heap."""
    n = len(word)
    after, before = list(range(1, n + 2)), list(range(-1, n + 1))
    here, heap = [True] * (n + 1), []

    def offer(a: int, m: int) -> None:
        if 0 <= a and m < n and (e := known.get(word[a : after[m]])):
            heapq.heappush(heap, (-e[1], a, m, after[m]))

    for m in range(1, n):
        offer(m - 1, m)
    while heap:
        _, a, m, z = heapq.heappop(heap)
        if not (here[a] and here[m] and here[z]) or after[a] != m or after[m] != z:
            continue
        here[m], after[a], before[z] = False, z, a
        if a > 0:
            offer(before[a], a)
        if z < n:
            offer(a, z)
    out, at = [], 0
    while at < n:
        out += _codes(word[at : after[at]], known, of_bytes)
        at = after[at]
    return out


def viterbi_of(word: str, known: dict[str, tuple[int, float]], of_bytes: list[int], longest: int, worst: float) -> list[int]:
    """fold_viterbi for words of any length."""
    best = [(0.0, 0)]
    for j in range(1, len(word) + 1):
        ways = [(best[i][0] + (known[word[i:j]][1] if word[i:j] in known else worst), -i) for i in range(max(0, j - longest), j) if word[i:j] in known or i == j - 1]
        score, i = max(ways)
        best.append((score, -i))
    parts, at = [], len(word)
    while at:
        parts.append(_codes(word[best[at][1] : at], known, of_bytes))
        at = best[at][1]
    return [i for ids in reversed(parts) for i in ids]


def _codes(part: str, known: dict[str, tuple[int, float]], of_bytes: list[int]) -> list[int]:
    return [known[part][0]] if part in known else [of_bytes[b] for b in part.encode("utf-8", "surrogatepass")]


def encode_words(words: DataFrame, model: PieceModel, paths: bool = False) -> DataFrame:
    """(at, ids) of each word of `words` (word: distinct, of 1 to SHORT characters, at: its number); with `paths` also path, the ids of its best path, which a unigram model's ids are."""
    of_bytes, bpe, scores, worst = model.bytes, model.kind == BPE, np.array(model.scores), model.worst

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, SIDE_BY_SIDE) for b in batches for k in range(0, b.num_rows, SIDE_BY_SIDE)):
            at, *of = batch.columns
            best = fold_viterbi(*of, of_bytes, scores, worst) if paths or not bpe else None
            yield pa.RecordBatch.from_arrays([at, fold_merges(*of, of_bytes) if bpe else best, *([best] if paths else [])], names)

    names = ["at", "ids", *(["path"] if paths else [])]
    return lattice(words, model).select("at", "word", "edges", "singles").mapInArrow(folded, "at bigint, ids array<int>" + (", path array<int>" if paths else ""))


def _planes(x: np.ndarray) -> bytes:
    """int32 numbers as all their first bytes, all their second ones and so on, which squeezes better."""
    return np.ascontiguousarray(np.ascontiguousarray(x, np.int32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.int32).reshape(-1)


def _blob(*parts: np.ndarray) -> bytes:
    """int32 arrays with their lengths, squeezed."""
    return zstandard.ZstdCompressor(level=3).compress(struct.pack(f"<{len(parts)}q", *map(len, parts)) + b"".join(map(_planes, parts)))


def _parts(blob: bytes, n: int) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 8 * n, []
    for size in struct.unpack_from(f"<{n}q", data):
        out.append(_numbers(data[at : at + 4 * size]))
        at += 4 * size
    return out


class Numbering(dict):
    """Gives every new key the next number."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def packets(docs: DataFrame, model: PieceModel, id_col: str, text_col: str, block_bytes: int, groups: int, paths: bool) -> DataFrame:
    """(key, block, ids, payload): for each block its documents (key: the block; payload: sizes, word numbers, each word's count of parts
    and their numbers, and the numbers, lengths and ids of long parts, with `paths` their paths' lengths and ids too), and its list of parts for each word group (key: -1 - group; payload: the words' numbers and, after them, the words)."""
    kind = docs.schema[id_col].dataType.simpleString()
    pairs, known, of_bytes, dummy, lines, longest, worst, bpe = model.pairs, model.vocabulary(), model.bytes, model.dummy_prefix, model.cut_lines, model.longest, model.worst, model.kind == BPE
    names = ["key", "block", "ids", "payload"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, of_id = TaskContext.get().partitionId() << 20, pa.int64()
        ids, sizes, seq, words, size = [], [], [], Numbering(), 0

        def closed() -> pa.RecordBatch:
            parts, counts, made = Numbering(), array("i"), array("i")
            for w in words:
                found = cut_apart(w, pairs)
                counts.append(len(found))
                made.extend(map(parts.__getitem__, found))
            listed = list(parts)
            long = [i for i, w in enumerate(listed) if len(w) > SHORT or "\0" in w]  # the zero character parts the words of a list
            best = [viterbi_of(listed[i], known, of_bytes, longest, worst) for i in long] if paths or not bpe else []
            codes = [merges_of(listed[i], known, of_bytes) for i in long] if bpe else best
            flat = [x for c in ((codes, best) if paths else (codes,)) for x in (np.array([len(w) for w in c], np.int32), np.array([t for w in c for t in w], np.int32))]
            own = _blob(np.array(sizes), np.concatenate(seq), np.array(counts), np.array(made), np.array(long, np.int32), *flat)
            keys, payloads = [block], [own]
            group = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % groups for w in listed), np.int64, len(listed))
            group[long] = groups
            order = np.argsort(group, kind="stable")
            wanted, first = np.unique(group[order], return_index=True)
            squeeze = zstandard.ZstdCompressor(level=3).compress
            for g, a, z in zip(wanted.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
                if g < groups:  # the groups that the block has words of, and not its long parts
                    mine = order[a:z]
                    text = "\0".join([listed[i] for i in mine.tolist()]).encode("utf-8", "surrogatepass")
                    keys.append(-1 - g)
                    payloads.append(squeeze(struct.pack("<q", len(mine)) + _planes(np.diff(mine, prepend=0)) + text))
            rest = len(keys) - 1
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([block] * len(keys), pa.int64()), pa.array([ids] + [None] * rest, pa.list_(of_id)), pa.array(payloads, pa.binary())], names)

        for batch in batches:
            of_id = batch.schema.field(0).type
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):  # one text at a time
                text = text.as_py() or ""
                found = cut_words(text, dummy, lines)
                ids.append(i)
                sizes.append(len(found))
                seq.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                size += len(text)
                if size >= block_bytes:
                    yield closed()
                    block += 1
                    ids, sizes, seq, words, size = [], [], [], Numbering(), 0
        if ids:
            yield closed()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(blocks, f"key bigint, block bigint, ids array<{kind}>, payload binary")


def _listed(payload: bytes) -> tuple[np.ndarray, list[str]]:
    data = zstandard.ZstdDecompressor().decompress(payload)
    n = struct.unpack_from("<q", data)[0]
    return np.cumsum(_numbers(data[8 : 8 + 4 * n])), data[8 + 4 * n :].decode("utf-8", "surrogatepass").split("\0")


def encode(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 32 << 20, group_bytes: int = 6 << 20, paths: bool = False) -> DataFrame:
    """(id, token_ids, decoded_sha256) of every row; the digest is that of the text that the ids decode to. With `paths` also path_ids, the ids of the words' best paths by Viterbi."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    groups = max(1, min(MOST_GROUPS, -(-total // group_bytes)))
    # One exchange serves all three readers below: what they don't need they pass over themselves.
    sent = packets(docs, model, id_col, text_col, block_bytes, groups, paths).repartition(groups, "key")
    shown, skip = model.byte_table(), int(model.dummy_prefix)
    id_type = docs.schema[id_col].dataType

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A group's words in order, numbered."""
        found: dict[int, set[str]] = {}
        for batch in batches:
            for key, payload in zip(batch.column(0).to_pylist(), batch.column(3)):
                if key < 0:
                    found.setdefault(key, set()).update(_listed(payload.as_buffer().to_pybytes())[1])
        for key, words in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(sorted(words), pa.string()), pa.array((np.int64(-1 - key) << 32) + np.arange(len(words)))], ["word", "at"])

    words = sent.mapInArrow(distinct, "word string, at bigint").repartition(groups, "word")
    streams = ["ids", "path"] if paths else ["ids"]
    codes = encode_words(words, model, paths).select((-1 - F.shiftright("at", 32)).alias("to"), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).alias("no"), *streams)

    def answer(codes: pa.Table, asked: pa.Table) -> pa.Table:
        """For each block that asked a group: the numbers, lengths and ids of its words."""
        if not codes.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary())], ["of_block", "blob"])
        order = pa.array(np.argsort(codes.column("no").to_numpy()))
        lists = [codes.column(c).combine_chunks().take(order) for c in streams]
        known = [(x.offsets.to_numpy().astype(np.int64), x.values.to_numpy()) for x in lists]
        # Numbers follow the order of the words, which the packed lists hold.
        place: dict[str, int] = {}
        for packed in asked.column("payload"):
            place.update(dict.fromkeys(_listed(packed.as_buffer().to_pybytes())[1], 0))
        place = {w: i for i, w in enumerate(sorted(place))}
        blobs = []
        for packed in asked.column("payload"):
            nth, ws = _listed(packed.as_buffer().to_pybytes())
            mine = np.array([place[w] for w in ws])
            sent_back = []
            for offset, flat in known:
                length = offset[mine + 1] - offset[mine]
                ends = np.concatenate([[0], np.cumsum(length)])
                sent_back += [length, flat[np.repeat(offset[mine] - ends[:-1], length) + np.arange(ends[-1])]]
            blobs.append(_blob(np.diff(nth, prepend=0), *sent_back))
        return pa.table([asked.column("block").combine_chunks(), pa.array(blobs, pa.binary())], ["of_block", "blob"])

    answers = codes.groupBy("to").cogroup(sent.groupBy("key")).applyInArrow(answer, "of_block bigint, blob binary")

    def assembled(parts: list[tuple], sizes: np.ndarray, seq: np.ndarray, counts: np.ndarray, made: np.ndarray, digests: bool) -> tuple[pa.ListArray, list[str]]:
        """The documents' ids, and the digests of what they decode to, from the parts' numbers, lengths and ids."""
        nth, length, flat = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        begin, size = np.empty(len(nth), np.int64), np.empty(len(nth), np.int64)
        begin[nth] = np.cumsum(length, dtype=np.int64) - length
        size[nth] = length
        # From parts to words.
        ends = np.concatenate([[0], np.cumsum(size[made])])
        flat = flat[np.repeat(begin[made] - ends[:-1], size[made]) + np.arange(ends[-1])]
        begin = ends[np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)] if len(counts) else ends[:0]
        size = np.diff(np.concatenate([begin, ends[-1:]]))
        last = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        tokens = np.empty(sum(int(size[seq[k : k + 500_000]].sum()) for k in range(0, len(seq), 500_000)), np.int32)
        stops, digest, low = [0], [], 0
        for d in range(len(sizes)):
            # Documents are put together in stretches, so that the numbers held stay few.
            if last[d + 1] - last[low] < 500_000 and d < len(sizes) - 1:
                continue
            mine = seq[last[low] : last[d + 1]]
            ends = np.concatenate([[0], np.cumsum(size[mine])])
            found = flat[np.repeat(begin[mine] - ends[:-1], size[mine]) + np.arange(ends[-1])]
            cuts = ends[last[low : d + 2] - last[low]].tolist()
            if digests:
                digest += [hashlib.sha256(b"".join([shown[t] for t in found[a:b].tolist()])[skip:]).hexdigest() for a, b in zip(cuts, cuts[1:])]
            tokens[stops[-1] : stops[-1] + len(found)] = found
            stops += [stops[-1] + c for c in cuts[1:]]
            low = d + 1
        return pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(tokens)), digest

    def assemble(codes: pa.Table, block: pa.Table) -> pa.Table:
        lists = [pa.list_(pa.int32())] * len(streams)
        if block.column("key")[0].as_py() < 0:
            return pa.table([pa.array([], block.schema.field("ids").type.value_type), pa.array([], lists[0]), pa.array([], pa.string()), *(pa.array([], x) for x in lists[1:])], columns)
        row = block.slice(0, 1)
        sizes, seq, counts, made, long, *own = _parts(row.column("payload")[0].as_py(), 5 + 2 * len(streams))
        parts = [[(long, *own[2 * k : 2 * k + 2])] for k in range(len(streams))]
        for step, *more in (_parts(b, 1 + 2 * len(streams)) for b in codes.column("blob").to_pylist()):
            nth = np.cumsum(step)
            for k, mine in enumerate(parts):
                mine.append((nth, *more[2 * k : 2 * k + 2]))
        lists, digest = [], []
        while parts:  # one stream's numbers are let go before the next one's are put together
            ids, digests = assembled(parts.pop(0), sizes, seq, counts, made, not lists)
            lists.append(ids)
            digest += digests
        whole = pa.table([row.column("ids")[0].values, lists[0], pa.array(digest, pa.string()), *lists[1:]], columns)
        return pa.Table.from_batches(whole.to_batches(max_chunksize=256))  # a block goes back in pieces, so that the JVM never holds it as one batch

    columns = ["id", "token_ids", "decoded_sha256", *(["path_ids"] if paths else [])]
    kinds = [id_type, T.ArrayType(T.IntegerType()), T.StringType(), *([T.ArrayType(T.IntegerType())] if paths else [])]
    out = T.StructType([T.StructField(c, k) for c, k in zip(columns, kinds)])
    return answers.groupBy("of_block").cogroup(sent.groupBy("key")).applyInArrow(assemble, out)


def decode(rows: DataFrame, model: PieceModel, ids_col: str = "token_ids", into: str = "decoded") -> DataFrame:
    """`rows` with the text of their ids; null for null ids. Bytes that are not UTF-8 become U+FFFD."""
    shown, skip = model.byte_table(), int(model.dummy_prefix)

    @F.pandas_udf("string")
    def text(ids):
        return ids.map(lambda x: None if x is None else b"".join([shown[t] for t in x])[skip:].decode("utf-8", "replace"))

    return rows.withColumn(into, text(F.col(ids_col)))


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """All documents' token ids as the model's own encoder has them, the digest of the text they decode to, and the ids of the best path through each word's lattice."""
    found = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), PieceModel(), paths=True)
    return found.select(F.col("id").alias("doc_id"), F.size("token_ids").cast("bigint").alias("n_tokens"), "token_ids", "decoded_sha256", "path_ids")
