"""Conversations as packed token trees: shared beginnings are written once.

The turns of a conversation pass in order and are cut into pieces, each closed by
the turn that brings it to ``PACK_CHARS`` characters. Where a piece ends follows
from the turns before alone, so conversations that begin alike are cut alike, and a
piece is known by the hash of all turns up to its end: pieces are the nodes of one
tree over conversations of every length. Pieces behind the same turns are sorted by
the path of their own turns, and a task walks them as a prefix tree, depth first: a
turn is written when it first appears, and a piece that repeats the turns before it
only adds what is new. A pack is closed before it grows beyond ``PACK_CHARS``
characters (a single piece may), so one first turn that many conversations share is
written once per pack and no task holds the whole of it. Equal pieces are one path.

Each node of a pack is one formatted turn with its place in the pack's text, its
parent, its position ids (a turn goes on counting where its parent ended, not
where the pack does; the first of a pack where the turns ``above`` it ended) and its
attention: the intervals of its ancestors in the pack, besides what stands before it
in its own, and all of the path ``above``, which is a leaf of another pack. The unit is
the character; a model's tokenizer may cut nodes further without crossing their
bounds. The loss mask covers the text of assistant turns.

Template: ``[INST] `` and `` [/INST]`` around a user turn, ``</s>`` after an
assistant turn, ``<<SYS>>`` and ``<</SYS>>`` around a system turn, and
``<|role|>`` and ``<|end|>`` around any other, its role escaped. Inside texts every
character that could begin a mark (``[``, ``<``) or an escape (``\\``) is
preceded by ``\\``, so a control string in a text is no mark, and taking the
escapes away gives the text back.

Defined results: a null text or role is empty; equal rows of a conversation are
turns of their own; turns are in order of turn, then role, then text, nulls first;
a null conv_id is a conversation like others; an empty table has no packs. Extra
columns are not read.

The turns of one conversation go through one task in order, as its digests take them
in sequence; that task holds one piece at a time, whatever the length. A single turn
is one row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contexture.llm import words
from contexture.llm.tables import written

PACK_CHARS = 1 << 16
#: What stands above the first piece of a conversation.
ROOT = hashlib.sha256().hexdigest()
_BATCH_CHARS = 1 << 20

_ESCAPED = re.compile(r"[\\\[<]")
_MARKS = {
    "user": ("[INST] ", " [/INST]"),
    "assistant": ("", "</s>"),
    "system": ("<<SYS>>", "<</SYS>>"),
}

TURNS = "array<struct<role:string,text:string>>"
PIECE_SCHEMA = (
    "conv_id bigint, part bigint, above string, path string, start bigint, "
    f"full boolean, last boolean, turns {TURNS}"
)
NODE = (
    "array<struct<begin:int,head:int,tail:int,end:int,parent:int,position:bigint,role:string,"
    "attends:array<struct<begin:int,end:int>>>>"
)
PACK_SCHEMA = (
    f"pack string, above string, start bigint, text string, nodes {NODE}, "
    "leaves array<struct<path:string,node:int,full:boolean>>"
)
SAID_SCHEMA = "path string, nth bigint, role string, text string, chars bigint"
READ_SCHEMA = (
    "path string, n_turns bigint, turns_sha256 string, loss_chars bigint, "
    "loss_sha256 string, formatted_chars bigint"
)


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda found: "\\" + found.group(), text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text, the escaped text, and what stands after it."""
    head, tail = _MARKS.get(role) or (f"<|{escape(role).replace('|', chr(92) + '|')}|>", "<|end|>")
    return head, escape(text), tail


def read_turn(head: str, body: str) -> tuple[str, str]:
    """Role and text of a formatted turn, from what stands before its text and the text."""
    for role, (mark, _) in _MARKS.items():
        if head == mark:
            return role, unescape(body)
    return unescape(head[2:-2]), unescape(body)


def _formatted_chars(role: str, text: str) -> int:
    head, _, tail = format_turn(role, "")
    return len(head) + len(tail) + len(text) + sum(map(text.count, "\\[<"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch, _, _ in words.chunks(batches, "text"):
        yield from batch.to_pylist()


def _pieces_of(conv_id: int | None, rows: Iterator[dict], limit: int) -> Iterator[dict]:
    """One conversation's turns, in order, as pieces; the path so far is a running hash."""
    so_far = hashlib.sha256()
    piece: dict | None = None
    part = start = size = 0
    for row in rows:
        if piece and piece["full"]:
            yield piece
            piece, part, start, size = None, part + 1, start + size, 0
        if piece is None:
            piece = {"conv_id": conv_id, "part": part, "above": so_far.hexdigest(), "start": start}
            piece |= {"full": False, "last": False, "turns": []}
        role, text = row["role"], row["text"]
        size += _formatted_chars(role, text)
        piece["turns"].append({"role": role, "text": text})
        piece["full"] = size >= limit
        role, text = role.encode(), text.encode()
        so_far.update(b"%d:%d:" % (len(role), len(text)) + role + text)
        piece["path"] = so_far.hexdigest()
    yield piece | {"last": True}


def pieces(turns: DataFrame, piece_chars: int = PACK_CHARS) -> DataFrame:
    """The pieces of all conversations, as a written table.

    ``path`` is a hash of all turns up to the piece's end, ``above`` of those before
    it, and ``start`` counts the formatted characters of the latter.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, room = [], _BATCH_CHARS
        for conv_id, own in groupby(_rows(batches), key=lambda row: row["conv_id"]):
            for piece in _pieces_of(conv_id, own, piece_chars):
                made.append(piece)
                room -= 256 + sum(len(t["role"]) + len(t["text"]) for t in piece["turns"])
                if room < 0:
                    yield pa.RecordBatch.from_pylist(made, schema=_PIECE_TYPE)
                    made, room = [], _BATCH_CHARS
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=_PIECE_TYPE)

    empty = F.lit("")
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.coalesce(F.col("role").cast("string"), empty).alias("role"),
        F.coalesce(F.col("text").cast("string"), empty).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return written(rows.mapInArrow(cut, PIECE_SCHEMA), "pieces")


class _Pack:
    """One tree under construction, behind the turns ``above`` it."""

    def __init__(self, above: str, start: int) -> None:
        self.above, self.start = above, start
        self.parts: list[str] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.way: list[tuple[tuple[str, str], int]] = []  # turn and node, from the root

    def cost(self, turns: list[tuple[str, str]]) -> int:
        return sum(_formatted_chars(*turn) for turn in turns[self.common(turns) :])

    def common(self, turns: list[tuple[str, str]]) -> int:
        count = 0
        for (turn, _), own in zip(self.way, turns, strict=False):
            if turn != own:
                break
            count += 1
        return count

    def add(self, path: str, turns: list[tuple[str, str]], full: bool) -> None:
        del self.way[self.common(turns) :]
        for role, text in turns[len(self.way) :]:
            head, body, tail = format_turn(role, text)
            parent = self.way[-1][1] if self.way else -1
            attends = []
            position = self.start
            if parent >= 0:
                above = self.nodes[parent]
                position = above["position"] + above["end"] - above["begin"]
                attends = [*above["attends"], {"begin": above["begin"], "end": above["end"]}]
                if len(attends) > 1 and attends[-2]["end"] == attends[-1]["begin"]:
                    attends[-2:] = [{"begin": attends[-2]["begin"], "end": attends[-1]["end"]}]
            begin = self.size
            after_head = begin + len(head)
            after_body = after_head + len(body)
            self.size = after_body + len(tail)
            self.parts += [head, body, tail]
            self.nodes.append(
                {
                    "begin": begin,
                    "head": after_head,
                    "tail": after_body,
                    "end": self.size,
                    "parent": parent,
                    "position": position,
                    "role": role,
                    "attends": attends,
                }
            )
            self.way.append(((role, text), len(self.nodes) - 1))
        self.leaves.append({"path": path, "node": self.way[-1][1], "full": full})

    def row(self) -> dict:
        text = "".join(self.parts)
        name = hashlib.sha256("".join(leaf["path"] for leaf in self.leaves).encode()).hexdigest()
        return {
            "pack": name,
            "above": self.above,
            "start": self.start,
            "text": text,
            "nodes": self.nodes,
            "leaves": self.leaves,
        }


_PIECE_TYPE = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("part", pa.int64()),
        ("above", pa.string()),
        ("path", pa.string()),
        ("start", pa.int64()),
        ("full", pa.bool_()),
        ("last", pa.bool_()),
        ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
    ]
)
_NODE_TYPE = pa.list_(
    pa.struct(
        [(name, pa.int32()) for name in ("begin", "head", "tail", "end", "parent")]
        + [
            ("position", pa.int64()),
            ("role", pa.string()),
            ("attends", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
        ]
    )
)
_LEAF_TYPE = pa.struct([("path", pa.string()), ("node", pa.int32()), ("full", pa.bool_())])
_PACK_TYPE = pa.schema(
    [
        ("pack", pa.string()),
        ("above", pa.string()),
        ("start", pa.int64()),
        ("text", pa.string()),
        ("nodes", _NODE_TYPE),
        ("leaves", pa.list_(_LEAF_TYPE)),
    ]
)
_SAID_TYPE = pa.schema(
    [
        ("path", pa.string()),
        ("nth", pa.int64()),
        ("role", pa.string()),
        ("text", pa.string()),
        ("chars", pa.int64()),
    ]
)


def packed(own: DataFrame, pack_chars: int = PACK_CHARS) -> DataFrame:
    """The packs of distinct ``pieces``, as a written table."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                turns = [(turn["role"], turn["text"]) for turn in row["turns"]]
                if tree and (
                    tree.above != row["above"] or tree.size + tree.cost(turns) > pack_chars
                ):
                    yield pa.RecordBatch.from_pylist([tree.row()], schema=_PACK_TYPE)
                    tree = None
                tree = tree or _Pack(row["above"], row["start"])
                tree.add(row["path"], turns, row["full"])
        if tree:
            yield pa.RecordBatch.from_pylist([tree.row()], schema=_PACK_TYPE)

    distinct = own.select("above", "start", "path", "full", "turns").dropDuplicates(["path"])
    # The order of a walk through the tree: by a short hash of each turn in turn.
    steps = F.expr("array_join(transform(turns, t -> lpad(hex(xxhash64(t.role, t.text)), 16, '0')), '')")
    order = ["above", "steps", "path"]
    distinct = distinct.withColumn("steps", steps)
    distinct = distinct.repartitionByRange(*order).sortWithinPartitions(*order).drop("steps")
    return written(distinct.mapInArrow(pack, PACK_SCHEMA), "packs")


def _way(pack: dict, leaf: dict) -> Iterator[tuple[str, str, int]]:
    """Role, text and formatted size of each turn from the pack's root to a leaf, read from its text."""
    nodes, text, way, at = pack["nodes"], pack["text"], [], leaf["node"]
    while at >= 0:
        way.append(nodes[at])
        at = nodes[at]["parent"]
    for node in reversed(way):
        role, said = read_turn(text[node["begin"] : node["head"]], text[node["head"] : node["tail"]])
        yield role, said, node["end"] - node["begin"]


def _digest(path: str, turns: Iterator[tuple[str, str, int]]) -> tuple:
    said, loss = hashlib.sha256(), hashlib.sha256()
    count = chars = size = 0
    for role, text, own in turns:
        said.update(f"{role}\n{text}\n".encode())
        count += 1
        size += own
        if role == "assistant":
            loss.update(text.encode())
            chars += len(text)
    return path, count, said.hexdigest(), chars, loss.hexdigest(), size


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [part.split()[0] for part in READ_SCHEMA.split(", ")]
    columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def digests(packs: DataFrame, own: DataFrame) -> DataFrame:
    """Per conversation what its way through the packs says, read back from their texts.

    A way of one piece is told by its pack. Those of several are brought together,
    a turn a row, and read in order.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in _packs(batches):
            yield _digest_rows([_digest(leaf["path"], _way(pack, leaf)) for leaf in pack["leaves"]])

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in _packs(batches):
            for leaf in pack["leaves"]:
                if leaf["full"] or pack["above"] != ROOT:
                    rows = [(leaf["path"], nth, *turn) for nth, turn in enumerate(_way(pack, leaf))]
                    columns = [pa.array(v, t.type) for v, t in zip(zip(*rows), _SAID_TYPE, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, schema=_SAID_TYPE)

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, rows in groupby(_rows(batches), key=lambda row: row["path"]):
            yield _digest_rows([_digest(path, ((r["role"], r["text"], r["chars"]) for r in rows))])

    members = own.where("last").select("conv_id", "path", "part")
    short = packs.where(F.col("above") == ROOT).mapInArrow(whole, READ_SCHEMA)
    short = members.where("part = 0").drop("part").join(short, "path")

    members = members.where("part > 0").drop("part")
    one = members.groupBy("path").agg(F.min("conv_id").alias("one"))
    parts = own.select("conv_id", "part", F.col("path").alias("piece"))
    parts = parts.join(one, F.col("conv_id").eqNullSafe(F.col("one"))).select("path", "part", "piece")
    many = packs.where((F.col("above") != ROOT) | F.expr("exists(leaves, l -> l.full)"))
    many = many.mapInArrow(said, SAID_SCHEMA).withColumnRenamed("path", "piece")
    many = parts.join(many, "piece").select("path", "part", "nth", "role", "text", "chars")
    many = many.repartition("path").sortWithinPartitions("path", "part", "nth")
    many = members.join(many.mapInArrow(in_order, READ_SCHEMA), "path")
    return short.unionByName(many).drop("path")


def control_conversation(spark: SparkSession) -> DataFrame:
    """A conversation that says the template's own marks."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)],
        "conv_id bigint, turn bigint, role string, text string",
    )


def formatted(turns: DataFrame) -> DataFrame:
    """Packs all conversations and reads each one back."""
    own = pieces(turns)
    return digests(packed(own), own)
