"""Repair of conversation structure, by depth-first branch and bound.

A sound conversation is empty, or an optional system turn followed by user and
assistant turns in pairs. A broken one is mended by edits, each with a cost and a
letter: keep a turn (K, 0), give it the role user or assistant (R, 3), delete it
(D, 4, the only edit of a blank or repeated turn) or insert an empty turn of user
or assistant before it or at the end (I, 3). A truncated turn that stays costs 3
more. Wanted are the edits of least cost, and of these the ones whose letters, in
order, come first in ASCII.

The search goes depth first over nodes (turns done, what the roles so far end
with) with a stack of its own. A table of suffix bounds says what the rest costs
at least from each node; the incumbent is the best complete (cost, audit) so far;
each node's table keeps the best (cost, audit) that has reached it, and a prefix
that is worse goes no further. It ends when the stack is empty, so the incumbent
is proved. The bound is exact for costs, so what is searched is the ways of least
cost and their ties.

A conversation reaches its task as two runs of rows in the same order: first its
turns without texts (a role's initial, a fault, a digest), on which the search
works, then the texts, which go through the digest of the repaired conversation one
by one. So a task holds a few dozen bytes for each turn of one conversation, and no
text but the one at hand. The audit, a letter a turn at least, is one value of the
result, and a digest takes its bytes in order: one conversation is one task's work,
whatever its length, and long ones cost their own rows only.

Defined results: null texts and roles read as one space, as do null ids and turns
in the hash that decides on damage; rows without a conv_id are one conversation;
turns go by number, nulls first, those of one number by role, then by MD5 of the
text; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: First faults of a turn.
SOUND, BLANK, DUPLICATE, CUT = range(4)

# What the roles so far end with: nothing yet, a system turn, a user turn, a whole pair.
START, AFTER_SYSTEM, AFTER_USER, AFTER_PAIR = range(4)
STATES = range(4)
ENDS = (START, AFTER_PAIR)
#: The role that a rerole or an insertion gives, and where it leads.
NEXT = {
    START: ("user", AFTER_USER),
    AFTER_SYSTEM: ("user", AFTER_USER),
    AFTER_USER: ("assistant", AFTER_PAIR),
    AFTER_PAIR: ("user", AFTER_USER),
}
#: Where a kept turn leads, by state and initial of its role.
KEPT = {
    (START, "s"): AFTER_SYSTEM,
    (START, "u"): AFTER_USER,
    (AFTER_SYSTEM, "u"): AFTER_USER,
    (AFTER_USER, "a"): AFTER_PAIR,
    (AFTER_PAIR, "u"): AFTER_USER,
}
LEGAL = {"su", "ua", "au"}
BLANKS = " \t\n\x0b\x0c\r"

FAR = 1 << 60
BATCH_ROWS = 4096

SCHEMA = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "cost bigint, audit string, repaired_sha256 string"
)


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after damage by rule, and ``gone``: a row that is dropped.

    Dropped rows stay as marks, so that no conversation is lost with all its turns.
    """
    space = F.lit(" ")
    key = F.concat_ws(
        ":",
        F.coalesce(F.col("conv_id").cast("string"), space),
        F.coalesce(F.col("turn").cast("string"), space),
    )
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
        (F.crc32(key) % 20).alias("kind"),
    )
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "")
        .when(F.col("kind") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        (F.col("kind") == 0).alias("gone"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def streams(turns: DataFrame) -> DataFrame:
    """Each turn as a row of features (``phase`` 0) and a row of text (1), a conversation's in order."""
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), CUT).otherwise(SOUND)
    rows = turns.withColumn("digest", F.unhex(F.md5("text")))
    rows = rows.select(
        "conv_id",
        "turn",
        "role",
        "gone",
        "digest",
        F.when(F.col("gone"), F.lit(SOUND)).otherwise(fault).alias("fault"),
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("phase"), F.lit(None).cast("string").alias("text")),
                F.struct(F.lit(1).alias("phase"), F.col("text").alias("text")),
            )
        ).alias("half"),
    )
    rows = rows.where("NOT gone OR half.phase = 0")
    rows = rows.select("conv_id", "half.phase", "turn", "role", "digest", "gone", "fault", "half.text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "phase", "turn", "role", "digest")


def suffix_bounds(turns: list[tuple[str, int]]) -> list[list[int]]:
    """Least cost of what is left, by the number of turns done and the state."""
    end = [0 if state in ENDS else FAR for state in STATES]
    table = [_with_insertions(end)]
    for initial, fault in reversed(turns):
        after = table[-1]
        row = []
        for state in STATES:
            best = DELETE + after[state]
            if fault not in (BLANK, DUPLICATE):
                more = TRUNCATED if fault == CUT else 0
                best = min(best, more + REROLE + after[NEXT[state][1]])
                if (state, initial) in KEPT:
                    best = min(best, more + KEEP + after[KEPT[state, initial]])
            row.append(best)
        table.append(_with_insertions(row))
    return table[::-1]


def _with_insertions(row: list[int]) -> list[int]:
    for _ in STATES:
        row = [min(row[state], INSERT + row[NEXT[state][1]]) for state in STATES]
    return row


class Search:
    """The cheapest edits of one conversation; turns are (initial of the role, fault)."""

    def __init__(self, turns: list[tuple[str, int]]):
        self.turns = turns
        self.bounds = suffix_bounds(turns)
        # A prefix is a number; its letter, the prefix before it, and its length.
        self.letters = [""]
        self.before = [-1]
        self.lengths = [0]
        self.pushed = 0

    def edits(self, done: int, state: int) -> list[tuple[str, int, int, int]]:
        """Letter, cost, turns done and state of each edit of a node."""
        out = [("I", INSERT, done, NEXT[state][1])]
        if done < len(self.turns):
            initial, fault = self.turns[done]
            out.append(("D", DELETE, done + 1, state))
            if fault not in (BLANK, DUPLICATE):
                more = TRUNCATED if fault == CUT else 0
                out.append(("R", REROLE + more, done + 1, NEXT[state][1]))
                if (state, initial) in KEPT:
                    out.append(("K", KEEP + more, done + 1, KEPT[state, initial]))
        return out

    def _prefix(self, letter: str, before: int) -> int:
        self.letters.append(letter)
        self.before.append(before)
        self.lengths.append(self.lengths[before] + 1)
        return len(self.letters) - 1

    def _drop_last(self) -> None:
        for part in (self.letters, self.before, self.lengths):
            part.pop()

    def comes_first(self, one: int, two: int) -> bool:
        """Whether prefix ``one`` is before ``two`` in ASCII: up to where their ways part."""
        long, short = self.lengths[one], self.lengths[two]
        first, second = "", ""
        while long > short:
            first, one, long = self.letters[one], self.before[one], long - 1
        while short > long:
            second, two, short = self.letters[two], self.before[two], short - 1
        tail = bool(second) and not first
        while one != two:
            first, second = self.letters[one], self.letters[two]
            one, two = self.before[one], self.before[two]
            if first != second:
                tail = first < second
        return tail

    def solve(self) -> tuple[int, str]:
        """Cost and audit, proved best when the stack is empty."""
        incumbent: tuple[int, int] | None = None
        tables: dict[tuple[int, int], tuple[int, int]] = {(0, START): (0, 0)}
        stack = [(0, START, 0, 0)]
        while stack:
            done, state, cost, prefix = stack.pop()
            if tables[done, state] != (cost, prefix):
                continue  # a better prefix has come since
            least = cost + self.bounds[done][state]
            if incumbent and least > incumbent[0]:
                continue
            if done == len(self.turns) and state in ENDS:
                if (
                    not incumbent
                    or cost < incumbent[0]
                    or (cost == incumbent[0] and self.comes_first(prefix, incumbent[1]))
                ):
                    incumbent = (cost, prefix)
            branches = []
            for letter, price, next_done, next_state in self.edits(done, state):
                total = cost + price
                least = total + self.bounds[next_done][next_state]
                if least >= FAR or (incumbent and least > incumbent[0]):
                    continue
                branches.append((least, letter, total, next_done, next_state))
            # The cheapest, then the first letter, is popped first.
            for _, letter, total, next_done, next_state in sorted(branches, reverse=True):
                number = self._prefix(letter, prefix)
                known = tables.get((next_done, next_state))
                if known and (
                    known[0] < total or (known[0] == total and not self.comes_first(number, known[1]))
                ):
                    self._drop_last()
                    continue
                tables[next_done, next_state] = (total, number)
                stack.append((next_done, next_state, total, number))
                self.pushed += 1
        assert incumbent is not None
        return incumbent[0], self.audit(incumbent[1])

    def audit(self, prefix: int) -> str:
        out = []
        while prefix > 0:
            out.append(self.letters[prefix])
            prefix = self.before[prefix]
        return "".join(reversed(out))


class Repaired:
    """The repaired conversation as text, one turn after another, under a running digest."""

    def __init__(self, audit: str):
        self.audit = audit
        self.at = 0
        self.state = START
        self.digest = hashlib.sha256()
        self.empty = True

    def _write(self, role: str, text: str) -> None:
        self.digest.update(("" if self.empty else "\n").encode())
        self.digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.empty = False

    def insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            role, self.state = NEXT[self.state]
            self._write(role, "")
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self.insert()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "R":
            role, self.state = NEXT[self.state]
            self._write(role, text)
        elif letter == "K":
            self.state = KEPT[self.state, role[:1]]
            self._write(role, text)

    def sha256(self) -> str:
        self.insert()
        return self.digest.hexdigest()


class Conversation:
    """One conversation on its way through a task: features first, then texts."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.turns: list[tuple[str, int]] = []
        self.seen: set[tuple[str, bytes]] = set()
        self.least: int | None = None
        self.most: int | None = None
        self.numbers = 0
        self.cost, self.audit = 0, ""
        self.repaired: Repaired | None = None

    def feature(self, turn: int | None, role: str, digest: bytes, fault: int) -> None:
        if fault != BLANK:
            if (role, digest) in self.seen:
                fault = DUPLICATE
            self.seen.add((role, digest))
        self.turns.append((role[:1], fault))
        if turn is not None:
            if self.least is None:
                self.least = turn
            self.numbers += turn != self.most
            self.most = turn

    def text(self, role: str, text: str) -> None:
        self._solve()
        assert self.repaired is not None
        self.repaired.turn(role, text)

    def _solve(self) -> None:
        if self.repaired is None:
            self.cost, self.audit = Search(self.turns).solve()
            self.repaired = Repaired(self.audit)
            self.seen = set()

    def row(self) -> tuple:
        self._solve()
        assert self.repaired is not None
        faults = [fault for _, fault in self.turns]
        initials = [initial for initial, _ in self.turns]
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.numbers
        return (
            self.conv_id,
            gaps,
            faults.count(BLANK),
            faults.count(DUPLICATE),
            faults.count(CUT),
            sum(a + b not in LEGAL for a, b in zip(initials[:-1], initials[1:], strict=True)),
            self.cost,
            self.audit,
            self.repaired.sha256(),
        )


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    types = [pa.string() if part.endswith("string") else pa.int64() for part in SCHEMA.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(types)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    out: list[tuple] = []
    now: Conversation | None = None
    for part in batches:
        # Slices keep few texts as Python objects at a time.
        for start in range(0, part.num_rows, 64):
            columns = part.slice(start, 64).to_pydict()
            for conv_id, phase, turn, role, digest, gone, fault, text in zip(*columns.values(), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        out.append(now.row())
                    now = Conversation(conv_id)
                if phase == 1:
                    now.text(role, text)
                elif not gone:
                    now.feature(turn, role, digest, fault)
        if len(out) >= BATCH_ROWS:
            yield batch(out)
            out = []
    if now is not None:
        out.append(now.row())
    yield batch(out)


def repaired(turns: DataFrame) -> DataFrame:
    """``SCHEMA``: a row per conversation of ``turns`` (``conv_id, turn, role, text, gone``)."""
    return streams(turns).mapInArrow(_repair, SCHEMA)
