"""Chat formatting over a prefix tree.

A conversation's turns are hashed prefix by prefix. Conversations that are equal turn for
turn become one before anything is ordered. The rest are dealt by ranges of their prefix
paths, which is depth-first order of the tree, so a common first turn is spread over as
many tasks as its conversations fill. Each task walks its range once: turns shared with
the conversation before are on the walk's stack and are not emitted again; a new turn's
tokens are, with position ids that go on from its parent's and the intervals of its
ancestors' tokens, which are all that it attends to besides itself. A range starts by
emitting the ancestors of its first conversation anew.

Template: ``<|im_start|>role\\n`` text ``<|im_end|>\\n`` for each turn. Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|`` (in roles a line end becomes ``\\n``), so no text can hold a control string and
every text is read back exactly. The loss mask covers the text of assistant turns.

Rows in: (conv_id, turn, role, text). Null role or text: empty. Turns are ordered by turn,
ties by role and text, null turns first. A null conv_id is a conversation like any other.
Repeated rows are turns of their own. Very long texts are formatted whole; a sequence ends
behind the turn that reaches ``FLUSH_TOKENS``, and the next one begins with the ancestors of
its first conversation again. Extra columns are ignored. No rows: no output.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm import _engine as E

START, END = "<|im_start|>", "<|im_end|>"
FLUSH_TOKENS = 1 << 20


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|])", r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\([\\|n])", lambda m: "\n" if m[1] == "n" else m[1], role)


def parts_of(role: str, text: str) -> list[tuple[str, bool]]:
    """The formatted turn as (string, in the loss)."""
    return [(f"{START}{escape_role(role)}\n", False), (escape(text), role == "assistant"), (f"{END}\n", False)]


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns = []
    for piece in formatted.split(START)[1:]:
        body = piece.removesuffix(f"{END}\n")
        role, _, text = body.partition("\n")
        turns.append((unescape_role(role), unescape(text)))
    return turns


@lru_cache(None)
def _encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def distinct_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class, turns, path) of each distinct conversation, and (conv_id, class)."""
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("t"), F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("x")).alias("turn"))
    whole = rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("turn")), lambda s: F.struct(s["r"].alias("r"), s["x"].alias("x"))).alias("turns"))

    def hashed(batches):
        for batch in batches:
            paths = []
            for conversation in batch.column("turns").to_pylist():
                h, path = hashlib.blake2b(digest_size=12), []
                for t in conversation:
                    for s in (t["r"].encode(), t["x"].encode()):
                        h.update(len(s).to_bytes(8, "little") + s)
                    path.append(h.digest())
                paths.append(path)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turns"), pa.array(paths, pa.list_(pa.binary()))], ["conv_id", "turns", "path"])

    kinds = "conv_id long, turns array<struct<r: string, x: string>>, path array<binary>"
    found = E.stored(whole.select(F.col("conv_id").cast("long").alias("conv_id"), "turns").mapInArrow(hashed, kinds), "conversations")
    found = found.withColumn("class", F.element_at("path", -1))
    # one conversation of each class by id, so equal ones meet as ids and not as texts
    least = found.groupBy("class").agg(F.min(F.coalesce("conv_id", F.lit(-(2**63)))).alias("_least"))
    one = found.select(F.coalesce("conv_id", F.lit(-(2**63))).alias("_least"), "class", "turns", "path").join(least, ["_least", "class"])
    return one.select("class", "turns", "path"), found.select("conv_id", "class")


_TREE = "class binary, tree long, node int, parent int, leaf boolean, tokens array<int>, loss array<boolean>, positions array<int>, attends array<struct<a: int, b: int>>, at int"


def emit(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """The prefix tree, one row for each node and for each conversation's end.

    tree: the sequence that a node is in; node, parent: turns' numbers there; at: where the
    node's tokens begin; tokens, loss, positions: of each token; attends: ancestors'
    intervals of tokens in the sequence, the node's own last. Rows with leaf set name the
    conversation (class) that ends at the node and have no tokens. Rows of a sequence are
    in order of emission and lie in one task.
    """
    path = path or vocabulary()
    n = E.partitions(conversations.sparkSession)
    ordered = conversations.repartitionByRange(n, "path").sortWithinPartitions("path")

    def walk(batches):
        from pyspark import TaskContext

        encoding, part, tree, size, number = _encoding(path), TaskContext.get().partitionId(), 0, 0, 0
        heads: dict[str, list[int]] = {}  # tokens of a role's start, of few roles
        tail = encoding.encode_ordinary(f"{END}\n")
        stack: list[tuple] = []  # (prefix, node, begin, end, next position)
        for batch in batches:
            rows = _Rows()
            for cls, turns, prefixes in zip(*(batch.column(c).to_pylist() for c in ("class", "turns", "path"))):
                if size >= FLUSH_TOKENS:  # a new sequence; its first ancestors are emitted anew
                    tree, size, number, stack = tree + 1, 0, 0, []
                same = 0
                while same < len(stack) and same < len(prefixes) and stack[same][0] == prefixes[same]:
                    same += 1
                del stack[same:]
                key = part * (1 << 32) + tree
                for turn, prefix in zip(turns[same:], prefixes[same:]):
                    role = turn["r"]
                    if role not in heads:
                        if len(heads) > 1000:
                            heads.clear()
                        heads[role] = encoding.encode_ordinary(f"{START}{escape_role(role)}\n")
                    text = encoding.encode_ordinary(escape(turn["x"]))
                    tokens = [*heads[role], *text, *tail]
                    parent, position = (stack[-1][1], stack[-1][4]) if stack else (-1, 0)
                    stack.append((prefix, number, size, size + len(tokens), position + len(tokens)))
                    said = len(text) if role == "assistant" else 0
                    rows.add(None, key, number, parent, tokens, len(heads[role]), said, position, _joined(stack), size)
                    size += len(tokens)
                    number += 1
                rows.add(cls, key, stack[-1][1] if stack else -1, -1, [], 0, 0, 0, _joined(stack), size)
            yield rows.batch()

    return ordered.mapInArrow(walk, _TREE)


def _joined(stack: list[tuple]) -> list[int]:
    """Intervals of the turns on a stack as begin, end, begin, end ...; neighbours as one."""
    out: list[int] = []
    for _, _, begin, end, _ in stack:
        if out and out[-1] == begin:
            out[-1] = end
        else:
            out += (begin, end)
    return out


class _Rows:
    """Rows of a tree, numbers end to end."""

    def __init__(self):
        self.cls, self.number, self.tokens, self.spans = [], [], [], []  # number: tree, node, parent, tokens, before the loss, in it, position, half spans, at

    def add(self, cls, tree, node, parent, tokens, before, said, position, spans, at):
        self.cls.append(cls)
        self.number.append((tree, node, parent, len(tokens), before, said, position, len(spans) // 2, at))
        self.tokens += tokens
        self.spans += spans

    def batch(self) -> pa.RecordBatch:
        tree, node, parent, n, before, said, position, spans, at = np.array(self.number, np.int64).reshape(-1, 9).T.copy()
        first = np.cumsum(n) - n
        inside = np.arange(n.sum()) - np.repeat(first, n)
        begin, end = np.repeat(before, n), np.repeat(before + said, n)
        cut = lambda m: pa.array(np.concatenate([[0], np.cumsum(m)]).astype(np.int32))
        by_token = lambda x, t: pa.ListArray.from_arrays(cut(n), pa.array(x).cast(t))
        both = np.array(self.spans, np.int32).reshape(-1, 2)
        pair = pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])
        arrays = [
            pa.array(self.cls, pa.binary()), pa.array(tree), *(pa.array(x.astype(np.int32)) for x in (node, parent)), pa.array([c is not None for c in self.cls], pa.bool_()),
            by_token(np.array(self.tokens, np.int32), pa.int32()), by_token((inside >= begin) & (inside < end), pa.bool_()), by_token((inside + np.repeat(position, n)).astype(np.int32), pa.int32()),
            pa.ListArray.from_arrays(cut(spans), pair), pa.array(at.astype(np.int32)),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["class", "tree", "node", "parent", "leaf", "tokens", "loss", "positions", "attends", "at"])


def _flat(column) -> tuple[np.ndarray, list[int]]:
    """Numbers of a list column end to end, and n + 1 offsets."""
    values = column.flatten()
    size = np.array([0, *pc.fill_null(pc.list_value_length(column), 0).to_pylist()], np.int64)
    return values.to_numpy(zero_copy_only=False), np.cumsum(size).tolist()


def read_back(tree: DataFrame, path: str | None = None) -> DataFrame:
    """class, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each
    conversation, from the emitted tokens that its last node attends to."""
    path = path or vocabulary()

    def scan(batches):
        encoding, key = _encoding(path), None
        width = np.array([len(encoding.decode_single_token_bytes(t)) for t in range(encoding.n_vocab)])
        tokens, loss = np.empty(0, np.int32), np.empty(0, bool)
        for batch in batches:
            out: list[tuple] = []
            (ids_, cut), (loss_, _) = _flat(batch.column("tokens")), _flat(batch.column("loss"))
            attends = batch.column("attends")
            spans = attends.flatten()
            begins, ends = (spans.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            many = np.cumsum([0, *pc.fill_null(pc.list_value_length(attends), 0).to_pylist()]).tolist()
            for i, (cls, tree_, leaf, at) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("class", "tree", "leaf", "at")))):
                if tree_ != key:
                    key, tokens, loss = tree_, np.empty(1024, np.int32), np.empty(1024, bool)
                if not leaf:
                    end = at + cut[i + 1] - cut[i]
                    if end > len(tokens):
                        tokens, loss = (np.resize(x, 2 * end) for x in (tokens, loss))
                    tokens[at:end], loss[at:end] = ids_[cut[i] : cut[i + 1]], loss_[cut[i] : cut[i + 1]]
                    continue
                where = [slice(a, b) for a, b in zip(begins[many[i] : many[i + 1]].tolist(), ends[many[i] : many[i + 1]].tolist())]
                ids, counts = (np.concatenate([x[w] for w in where]) if where else x[:0] for x in (tokens, loss))
                raw = encoding.decode_bytes(ids.tolist())
                formatted = raw.decode()
                turns = parse(formatted)
                # the loss mask's runs as bytes of what was read
                edge = np.flatnonzero(np.diff(np.concatenate([[False], counts, [False]]).astype(np.int8)))
                byte = np.concatenate([[0], np.cumsum(width[ids])])[edge].tolist()
                said = "".join(unescape(raw[a:b].decode()) for a, b in zip(byte[::2], byte[1::2]))
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                out.append((cls, len(turns), digest, len(said), hashlib.sha256(said.encode()).hexdigest(), len(formatted)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], ["class", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return tree.mapInArrow(scan, "class binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(turns: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from
    the emitted tree (``emit`` has the tree itself)."""
    one, members = distinct_conversations(turns)
    tree = E.stored(emit(one, path), "tree")
    return members.join(read_back(emit_order(tree), path), "class").drop("class")


def emit_order(tree: DataFrame) -> DataFrame:
    """A stored tree with each sequence whole and in order of emission."""
    n = E.partitions(tree.sparkSession)
    return tree.repartition(n, "tree").sortWithinPartitions("tree", "at", "node", "leaf")
