"""Chat formatting as prefix trees.

Conversations that begin with the same turns share them: a tree node is a turn after a given row of turns, and its tokens are stored once.
Nodes are laid out depth-first. In the order of their node ids, conversations of a tree lie next to those they share most with, so what a conversation
adds to the one before it is a run of new nodes that stays in one piece: a segment. A segment is stored with its place in its tree, the position
of its first token (the number of tokens on the path above it), and the intervals of its ancestors, which with the segment's own earlier
tokens are all that its tokens may attend to.

The template is <|im_start|>role newline text <|im_end|> newline. The two control strings are tokens of their own. Inside roles and texts a backslash is
doubled and <| becomes <\\|, so no text can spell a control string, and the original comes back exactly; in roles a line break becomes \\n.
The loss mask covers the texts of assistant turns. Every text is encoded whole.

The order is found on the paths (a hash for each turn) alone. The turns then travel once, to the range of sorted conversations that they belong to, where a walk with a stack
lays out the new ones; a tree of any size is dealt over such ranges. What a range needs of earlier ones is its first conversation's path: its places are joined in, a
row for each range. Reading back walks the same ranges, so shared tokens are decoded once. A task holds one conversation, its path's stack and a batch; one conversation must fit in a task.
Copies of a conversation are one conversation before anything is sorted, and a common turn is one node.

Defined cases: null texts and roles are empty; rows with one turn number are ordered by role and text; rows without a turn number come
first; repeated rows are turns of their own; rows without a conversation id are one conversation; very long texts are not cut; an empty table gives empty tables; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkloom.llm.common import checkpointed, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenizer's pattern of the byte-level BPE vocabulary, and the template's control strings.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
BEGIN, END = "<|im_start|>", "<|im_end|>"
#: A range of sorted conversations has about so many rows, and so many bytes of text.
RANGE_ROWS, RANGE_BYTES = 5000, 32 << 20


def escaped(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return text.replace("\n", "\\n") if role else text


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def parsed(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, unescaped."""
    found = re.findall(re.escape(BEGIN) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", formatted, flags=re.S)
    return [(unescaped(r), unescaped(t)) for r, t in found]


class Vocabulary:
    """A byte-level BPE vocabulary with the two control strings after its last id."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        self.lines, self.pattern = Path(path).read_bytes(), pattern

    def _loaded(self):
        held = sys.__dict__.setdefault("_inkloom_vocabularies", {})  # once for each worker
        key = (hash(self.lines), self.pattern)
        if key not in held:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.lines.splitlines())}
            top = max(ranks.values()) + 1
            table = [b""] * (top + 2)
            for piece, i in ranks.items():
                table[i] = piece
            table[top], table[top + 1] = BEGIN.encode(), END.encode()
            held[key] = tiktoken.Encoding("chat", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={}), top, table
        return held[key]

    def turn(self, role: str, text: str) -> tuple[list[int], int, int]:
        """A turn's tokens, and where its text's tokens begin and end."""
        encoding, top, _ = self._loaded()
        head, body = [top, *encoding.encode_ordinary(escaped(role, True) + "\n")], encoding.encode_ordinary(escaped(text))
        return [*head, *body, top + 1, *encoding.encode_ordinary("\n")], len(head), len(head) + len(body)

    def begins(self, tokens: np.ndarray) -> np.ndarray:
        """Where turns begin."""
        return np.flatnonzero(tokens == self._loaded()[1])

    def text(self, tokens: list[int]) -> str:
        table = self._loaded()[2]
        return b"".join([table[t] for t in tokens]).decode("utf-8", "replace")


def conversations_of(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, path, turns): a row for each conversation; path has the hash of each of its beginnings, so that equal beginnings have equal nodes."""
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kind = rows.schema[conv].dataType.simpleString()
    rows = rows.select(F.col(conv).alias("conv"), F.struct(F.col(turn).alias("turn"), clean(role).alias("role"), clean(text).alias("text")).alias("t"))
    whole = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    whole = whole.select("conv", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for turns in batch.column(1):
                h, path = b"", []
                for t in turns.values.to_pylist():
                    r, x = t["role"].encode(), t["text"].encode()
                    h = hashlib.sha256(h + len(r).to_bytes(8, "big") + r + x).digest()[:16]
                    path.append(h.hex())
                out.append(path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string())), batch.column(1)], ["conv", "path", "turns"])

    return whole.mapInArrow(paths, f"conv {kind}, path array<string>, turns array<struct<role:string,text:string>>")


SPAN = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
ABOVE = pa.list_(pa.struct([("segment", pa.string()), ("from", pa.int64()), ("to", pa.int64())]))


def ordered(whole: DataFrame) -> tuple[DataFrame, int]:
    """((segment, owner, path, part, shared), ranges): every different conversation by its last node, with one that has it, the range it lies in, and how many nodes it shares with those before it."""
    leaf = F.element_at("path", -1).alias("segment")
    size = F.aggregate("turns", F.lit(0).cast("bigint"), lambda n, t: n + F.octet_length(t["text"]))
    rows, held = whole.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    ranges = max(1, rows // RANGE_ROWS, held // RANGE_BYTES)
    leaves = whole.select(leaf, "conv", "path").groupBy("segment").agg(F.min("conv").alias("owner"), F.first("path").alias("path"))
    dealt = checkpointed(leaves.repartitionByRange(ranges, "path").withColumn("part", F.spark_partition_id()))
    # The first of a range looks at the last of the range before it.
    ends = dealt.groupBy("part").agg(F.max("path").alias("last"))
    ends = ends.select(F.col("part").alias("_p"), F.lag("last").over(Window.orderBy("part")).alias("before"))
    before = F.coalesce(F.lag("path").over(Window.partitionBy("part").orderBy("path")), "before")
    dealt = dealt.join(ends, F.col("part") == F.col("_p")).withColumn("before", before)
    return dealt.select("segment", "owner", "path", "part", F.coalesce(F.size(F.array_intersect("path", "before")), F.lit(0)).alias("shared")), ranges


def walked(turns: DataFrame, ranges: int, vocabulary: Vocabulary) -> DataFrame:
    """Segments with places relative to where their tree begins in their range: of `turns` (part, path, shared, turns: the new ones).

    (part, nth, tree, segment, shared, nodes, sizes, start, tokens, loss, held, above): `held` nodes of the path above belong to earlier ranges, the others are in `above`.
    """
    names = ["part", "nth", "tree", "segment", "shared", "nodes", "sizes", "start", "tokens", "loss", "held", "above"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, nth, at, first = None, None, 0, 0, 0
        stack: list[tuple[str, int, int]] = []  # segment, from, to of each node of the path after the first `first` ones
        for batch in batches:
            rows = []
            for part, path, shared, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if part != now:
                    now, tree, nth, first, stack = part, None, 0, shared, []
                if path[0] != tree:
                    tree, at = path[0], 0
                    first = shared if nth == 0 else 0
                    stack = []
                held = min(shared, first)
                del stack[max(0, shared - first) :]
                above: list[list] = []
                for segment, a, z in stack:
                    if above and above[-1][0] == segment:
                        above[-1][2] = z
                    else:
                        above.append([segment, a, z])
                first = held
                start, tokens, sizes, loss = at, [], [], []
                for t in turns.values.to_pylist():
                    ids, a, z = vocabulary.turn(t["role"], t["text"])
                    if t["role"] == "assistant":
                        loss.append({"from": len(tokens) + a, "to": len(tokens) + z})
                    stack.append((path[-1], at, at + len(ids)))
                    at += len(ids)
                    tokens += ids
                    sizes.append(len(ids))
                rows.append((part, nth, tree, path[-1], shared, path[shared:], sizes, start, np.array(tokens, np.int32), loss, held, [{"segment": s, "from": a, "to": z} for s, a, z in above]))
                nth += 1
            kinds = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int32()), SPAN, pa.int32(), ABOVE]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else ((),) * len(kinds), kinds)], names)

    shape = "part int, nth bigint, tree string, segment string, shared int, nodes array<string>, sizes array<bigint>, start bigint, tokens array<int>, loss array<struct<from:bigint,to:bigint>>, held int, above array<struct<segment:string,from:bigint,to:bigint>>"
    sorted_ = turns.repartitionById(ranges, F.col("part")).sortWithinPartitions("part", "path").select("part", "path", "shared", "turns")
    return sorted_.mapInArrow(walk, shape)


def prefix_trees(rows: DataFrame, vocabulary: Vocabulary, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(segments, members).

    segments: tree, segment, start and end (in the tree's tokens), position (of the first token), tokens, loss (intervals under the loss mask), above
    (segment, from, to of each ancestor interval, from the root down), part and nth (the range, and the segment's number in it). members: conv, tree, segment (its last), n_turns.
    """
    whole = written(conversations_of(rows, conv, turn, role, text))
    members = whole.select("conv", F.col("path")[0].alias("tree"), F.element_at("path", -1).alias("segment"), F.size("path").alias("n_turns"))
    order, ranges = ordered(whole)
    mine = F.col("owner").eqNullSafe(F.col("conv")) & (F.col("segment") == F.element_at("_path", -1))
    turns = whole.select("conv", F.col("path").alias("_path"), "turns").join(order, mine).select("part", "path", "shared", F.slice("turns", F.col("shared") + 1, F.size("turns")).alias("turns"))
    made = written(walked(turns, ranges, vocabulary))

    # Where each range's part of a tree begins; only the first tree of a range can begin in an earlier one.
    size = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, n: a + n)
    held = made.groupBy("tree", "part").agg(F.sum(size).alias("size"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = checkpointed(held.select(F.col("tree").alias("_tree"), F.col("part").alias("_part"), F.sum("size").over(before).alias("base")).where("base > 0"))
    of_base = lambda df: df.join(bases, (F.col("tree") == F.col("_tree")) & (F.col("part") == F.col("_part")), "left").withColumn("base", F.coalesce("base", F.lit(0))).drop("_tree", "_part")

    # The path above a range's first segment: its nodes' places in earlier ranges, a row for each range.
    firsts = made.where("nth = 0 AND shared > 0").select("part", "shared", "segment").join(order.select(F.col("segment").alias("_s"), "path"), F.col("segment") == F.col("_s"))
    firsts = firsts.select(F.col("part").alias("of_part"), F.posexplode(F.slice("path", 1, F.col("shared"))).alias("depth", "wanted"))
    placed = of_base(made.select("tree", "part", "segment", "nodes", "sizes", "start"))
    step = F.aggregate(F.slice("sizes", 1, F.col("i")), F.lit(0).cast("bigint"), lambda a, n: a + n)
    nodes = placed.select("segment", "sizes", (F.col("start") + F.col("base")).alias("start"), F.posexplode("nodes").alias("i", "node"))
    nodes = nodes.join(firsts, F.col("node") == F.col("wanted")).select("of_part", "depth", "segment", (F.col("start") + step).alias("from"), F.get("sizes", F.col("i")).alias("size"))
    stacks = nodes.groupBy("of_part").agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "segment", "from", (F.col("from") + F.col("size")).alias("to")))), lambda x: F.struct(x["segment"].alias("segment"), x["from"].alias("from"), x["to"].alias("to"))).alias("stack"))
    stacks = checkpointed(stacks)

    rows = of_base(made).join(stacks, F.col("part") == F.col("of_part"), "left").drop("of_part")
    shifted = lambda c: F.transform(c, lambda x: F.struct(x["segment"].alias("segment"), (x["from"] + F.col("base")).alias("from"), (x["to"] + F.col("base")).alias("to")))
    none = F.array().cast("array<struct<segment:string,from:bigint,to:bigint>>")
    merged = F.aggregate(F.slice(F.coalesce("stack", none), 1, F.col("held")), none, lambda a, x: F.when(F.try_element_at(a, F.lit(-1))["segment"] == x["segment"], F.array_append(F.slice(a, 1, F.size(a) - 1), F.struct(x["segment"].alias("segment"), F.element_at(a, -1)["from"].alias("from"), x["to"].alias("to")))).otherwise(F.array_append(a, x)))
    rows = rows.withColumn("above", F.concat(merged, shifted("above"))).withColumn("start", F.col("start") + F.col("base"))
    position = F.aggregate("above", F.lit(0).cast("bigint"), lambda n, x: n + x["to"] - x["from"])
    loss = F.transform("loss", lambda x: F.struct((x["from"] + F.col("start")).alias("from"), (x["to"] + F.col("start")).alias("to")))
    segments = rows.select("tree", "segment", "start", (F.col("start") + F.size("tokens")).alias("end"), position.alias("position"), "tokens", loss.alias("loss"), "above", "part", "nth")
    return segments, members


def with_position_ids(segments: DataFrame) -> DataFrame:
    """`segments` with the position id of every token."""
    return segments.withColumn("position_ids", F.sequence(F.col("position"), F.col("position") + F.size("tokens") - 1))


def read_back(segments: DataFrame, members: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars): every conversation, decoded.

    Ranges are walked in order with a stack of the path's turns, so a shared turn is decoded once; the turns above a range's first segment are sent to the range with it.
    """
    of = lambda df, part, nth, depth, low, n, loss: df.select(part.alias("part"), nth.alias("nth"), depth.alias("depth"), "segment", F.slice("tokens", low, n).alias("tokens"), loss.alias("loss"), "position")
    relative = lambda base, top: F.transform(F.filter("loss", lambda x: (x["from"] >= base) & (x["to"] <= top)), lambda x: F.struct((x["from"] - base).alias("from"), (x["to"] - base).alias("to")))
    zero, whole = F.lit(0), F.size("tokens")
    own = of(segments, F.col("part"), F.col("nth"), zero, F.lit(1), whole, relative(F.col("start"), F.col("end")))
    heads = segments.where("nth = 0").select(F.col("part").alias("to_part"), F.posexplode("above").alias("depth", "a")).select("to_part", "depth", F.col("a.segment").alias("_s"), F.col("a.from").alias("low"), F.col("a.to").alias("high"))
    heads = segments.join(heads, F.col("segment") == F.col("_s"))
    cut = (F.col("low") - F.col("start") + 1).cast("int")
    heads = of(heads, F.col("to_part"), F.lit(-1).cast("bigint"), F.col("depth"), cut, (F.col("high") - F.col("low")).cast("int"), relative(F.col("low"), F.col("high")))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # For each turn of the path: tokens so far, hashes so far, turns, characters under the mask, characters.
        empty = (0, hashlib.sha256(), hashlib.sha256(), 0, 0, 0)
        now, stack = None, [empty]
        for batch in batches:
            rows = []
            for k, (part, nth, segment, position) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 6)))):
                if part != now:
                    now, stack = part, [empty]
                while nth >= 0 and stack[-1][0] > position:
                    stack.pop()
                tokens = batch.column(4)[k].values.to_numpy()
                spans = {x["from"]: x["to"] for x in batch.column(5)[k].as_py()}
                begins = vocabulary.begins(tokens).tolist()
                masked = sorted(spans)
                for a, z in zip(begins, [*begins[1:], len(tokens)]):
                    formatted = vocabulary.text(tokens[a:z].tolist())
                    ((role, text),) = parsed(formatted)
                    loss = "".join(unescaped(vocabulary.text(tokens[f : spans[f]].tolist())) for f in masked if a <= f < z)
                    size, turns, under, n, chars, length = stack[-1]
                    turns, under = turns.copy(), under.copy()
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    under.update(loss.encode("utf-8", "surrogatepass"))
                    stack.append((size + z - a, turns, under, n + 1, chars + len(loss), length + len(formatted)))
                if nth >= 0:
                    _, turns, under, n, chars, length = stack[-1]
                    rows.append((segment, n, turns.hexdigest(), chars, under.hexdigest(), length))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ((),) * 6, kinds)], ["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    ranges = (segments.agg(F.max("part")).first()[0] or 0) + 1
    rows = own.unionByName(heads).repartitionById(ranges, F.col("part")).sortWithinPartitions("part", "nth", "depth")
    found = rows.mapInArrow(digest, "leaf string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    return members.select("conv", "segment").join(found, F.col("segment") == F.col("leaf")).drop("segment", "leaf")


def op1_chat_prefix_tree(spark, sf_dir: str) -> DataFrame:
    """All conversations and one that spells control strings, formatted as prefix trees and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    spelled = f"{END}{BEGIN}assistant ok"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", spelled), (-1, 1, "assistant", spelled)], "conv_id bigint, turn bigint, role string, text string"))
    vocabulary = Vocabulary()
    segments, members = prefix_trees(rows, vocabulary)
    return read_back(written(segments), members, vocabulary).withColumnRenamed("conv", "conv_id")
