"""Conversations brought back to the pattern system, then user and assistant in turn.

Rows are kept, given another role or deleted, and messages inserted, at the least cost;
of all cheapest edits those with the ASCII-least audit (their initials in order) count.

**Path ranking.** A node is a place between two rows and what the repaired conversation
so far ends with (nothing, system, user, assistant). After the cost DP, an arc is optimal
if its cost and the cost to go behind it make up the cost to go of its node. A node has
at most one arc of each letter, so that its first letter names its arc. Nodes are ranked
by their least audits of 1, 2, 4, ... letters: the rank of 2k letters is that of the pair
(own rank, rank of the node k letters on), whose pointer is the doubled pointer. When all
pointers rest, ranks order the whole audits; each node takes its arc by letter and then
rank, and the least path is read off through the doubled pointers by the bits of the step.

**Long conversations.** Equal rows are counted before anything moves, and rows are dealt
by ranges of (conversation, turn, role, text), so that a conversation with most rows is
spread over many tasks. An Arrow batch is solved at once; the conversations at its two
ends may go on elsewhere and become segments. A segment is a 4 x 4 matrix of least costs;
the segments of a conversation are read backwards for the cost to go behind each, and
forwards for the state that enters each, one small row for a batch of messages with four
numbers held. The segments are then solved apart from each other. Only what a result
row must hold as a whole (the audit, the digest) passes through one task, as a stream.

Defined results: null roles and texts are one space, null turns come first and form no
turn, a null conversation is one more. Rows of one turn are ordered by role and the digest of the text.
Equal rows are duplicates of the first. A conversation without rows has zeros, an empty
audit and the digest of an empty text. Empty tables give no rows; other columns are not
looked at. Texts are only moved and compared, of any length that a row can have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoorline.session import stored

SPACE = " \t\n\x0b\f\r"
ROLES = {"s": 0, "u": 1, "a": 2}
OTHER = 3
FINE, BLANK, DUPLICATE, TRUNCATED, GONE = range(5)
#: What a repaired conversation ends with.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The state that a message of the role that may come next leads to.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: The state that keeping a row leads to from each state, by its role, or -1; system stands first only.
KEEP = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
LETTERS = b"DIKR"
DELETE_COST, EDIT_COST = 4, 3
NEVER = 1 << 40
#: Cost to go behind the last row: messages that complete the pattern.
END = (0, 2 * EDIT_COST, EDIT_COST, 0)
LEGAL = {"su", "ua", "au"}
#: Copies of a row that one array counts.
COPIES = 4096


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults made by the checksum of conversation and turn, and how often each stands there."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    gone = F.col("kind") == 0
    bare = F.regexp_replace("text", "[.!?]", "")
    return rows.select(
        "conv_id",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, "").when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(gone | (F.col("kind") == 1), "").when(F.col("kind") == 2, bare).otherwise(F.col("text")).alias("text"),
        F.when(gone, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def cost_to_go(roles: list[int], faults: list[int], end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Least cost from every place and state, given the cost to go behind the last row."""
    e, s, u, a = end
    places = [end]
    for role, fault in zip(reversed(roles), reversed(faults), strict=True):
        if fault == BLANK or fault == DUPLICATE:
            e, s, u, a = e + DELETE_COST, s + DELETE_COST, u + DELETE_COST, a + DELETE_COST
        else:
            more = EDIT_COST if fault == TRUNCATED else 0
            to_user = u + more + (0 if role == 1 else EDIT_COST)
            to_assistant = a + more + (0 if role == 2 else EDIT_COST)
            after_system = s + more
            e, s, u, a = (
                min(e + DELETE_COST, to_user, after_system if role == 0 else NEVER),
                min(s + DELETE_COST, to_user),
                min(u + DELETE_COST, to_assistant),
                min(a + DELETE_COST, to_user),
            )
        # messages put in before the row
        u, a = min(u, a + EDIT_COST), min(a, u + EDIT_COST)
        e, s = min(e, u + EDIT_COST), min(s, u + EDIT_COST)
        places.append((e, s, u, a))
    places.reverse()
    return places


def transfer(roles: list[int], faults: list[int]) -> list[int]:
    """Least cost from each state before a stretch of rows to each state behind it, row by row."""
    units = [tuple(0 if s == t else NEVER for s in range(4)) for t in range(4)]
    columns = [cost_to_go(roles, faults, unit)[0] for unit in units]
    return [min(columns[t][s], NEVER) for s in range(4) for t in range(4)]


class Ranking:
    """The optimal arcs of some stretches of rows, ranked together.

    A stretch is ``(roles, faults, cost to go behind it, whether the conversation ends there)``.
    """

    def __init__(self, stretches: list[tuple[list[int], list[int], tuple[int, ...], bool]]):
        self.first = np.cumsum([0, *(len(roles) + 1 for roles, *_ in stretches)])
        places = self.first[-1]
        togo = np.empty((places, 4), dtype=np.int64)
        role, fault = np.full(places, OTHER), np.full(places, GONE)
        inserts = np.ones(places, dtype=bool)
        for (roles, faults, end, ends), at in zip(stretches, self.first.tolist(), strict=False):
            togo[at : at + len(roles) + 1] = cost_to_go(roles, faults, end)
            role[at : at + len(roles)], fault[at : at + len(roles)] = roles, faults
            inserts[at + len(roles)] = ends
        self.togo = togo
        self._arcs(role, fault, inserts)
        self._rank()

    def _arcs(self, role: np.ndarray, fault: np.ndarray, inserts: np.ndarray) -> None:
        """Target by letter and node, -1 where there is no optimal arc."""
        places, states = np.arange(len(role))[:, None], np.arange(4)[None, :]
        row = (fault != GONE)[:, None]
        may_stay = row & ((fault == FINE) | (fault == TRUNCATED))[:, None]
        more = np.where(fault == TRUNCATED, EDIT_COST, 0)[:, None]
        kept = KEEP[states, role[:, None]]
        after = np.minimum(places + 1, len(role) - 1)
        arcs = (
            (row, after, states + 0 * places, DELETE_COST),
            (inserts[:, None], places, NEXT[states], EDIT_COST),
            (may_stay & (kept >= 0), after, kept, more),
            (may_stay, after, NEXT[states], EDIT_COST + more),
        )
        found = []
        for allowed, place, state, cost in arcs:
            target = place * 4 + np.maximum(state, 0)
            found.append(np.where(allowed & (self.togo == self.togo.ravel()[target] + cost), target, -1).ravel())
        self.target = np.stack(found)

    def _rank(self) -> None:
        nodes, has = np.arange(self.target.shape[1]), self.target >= 0
        rests = ~has.any(axis=0)
        letter = has.argmax(axis=0)
        pointer = np.where(rests, nodes, self.target[letter, nodes])
        rank, steps = np.where(rests, 0, letter + 1), (~rests).astype(np.int64)
        self.pointers = []
        while True:
            self.pointers.append(pointer)
            doubled = pointer[pointer]
            if (doubled == pointer).all():
                break
            pair = rank * (rank.max() + 1) + rank[pointer]
            steps = steps + steps[pointer]
            rank, pointer = np.unique(pair, return_inverse=True)[1], doubled
        # the arc of the least audit: by its letter, and then by the rank of what follows
        order = np.arange(4)[:, None] * (rank.max() + 1) + rank[np.maximum(self.target, 0)]
        self.letter = np.where(has, order, np.iinfo(np.int64).max).argmin(axis=0)
        self.rank, self.steps, self.rest = rank, steps, pointer

    def leaves(self, stretch: int) -> list[int]:
        """The state behind a stretch for each state before it."""
        node = self.first[stretch] * 4
        return (self.rest[node : node + 4] % 4).tolist()

    def path(self, stretch: int, state: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Letters of the least audit, the row each is about, and the state it leads to."""
        start = self.first[stretch] * 4 + state
        step = np.arange(self.steps[start])
        node = np.full(len(step), start)
        for k, pointer in enumerate(self.pointers):
            node = np.where(step >> k & 1, pointer[node], node)
        letters = self.letter[node]
        return letters, node // 4 - self.first[stretch], self.target[letters, node] % 4


def told(ranking: Ranking, stretch: int, state: int, roles: list[str], texts: list[str]) -> tuple[str, list[dict]]:
    """The audit and the repaired messages of a stretch."""
    letters, rows, leads = ranking.path(stretch, state)
    messages = []
    for letter, row, to in zip(letters.tolist(), rows.tolist(), leads.tolist(), strict=True):
        if letter == 2:
            messages.append({"role": roles[row], "text": texts[row]})
        elif letter:
            messages.append({"role": NAMES[to], "text": texts[row] if letter == 3 else ""})
    return bytes(LETTERS[k] for k in letters.tolist()).decode(), messages


MESSAGES = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("role", "text")]))
COUNTS = ("rows", "turns", "blank", "duplicate", "truncated", "illegal")


def _long(*names: str) -> list[T.StructField]:
    return [T.StructField(c, T.LongType()) for c in names]


def _segments(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Solves the conversations inside a batch and packs those at its ends."""
    task = TaskContext.get().partitionId()
    for number, batch in enumerate(batches):
        if not batch.num_rows:
            continue
        conv, turn, role, text, fault = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault"))
        begins = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)]
        out, solved = [], []
        for k, (a, b) in enumerate(zip(begins, begins[1:], strict=False)):
            here = [i for i in range(a, b) if fault[i] != GONE]
            roles, faults = [ROLES.get(role[i][:1], OTHER) for i in here], [fault[i] for i in here]
            initials, turns = [role[i][:1] for i in here], [turn[i] for i in here if turn[i] is not None]
            row = {
                "conv_id": conv[a],
                "at": task << 32 | number << 1 | (k > 0),
                "whole": 0 < k < len(begins) - 2,
                "rows": len(here),
                "turns": len(turns) - sum(x == y for x, y in zip(turns, turns[1:], strict=False)),
                "blank": faults.count(BLANK),
                "duplicate": faults.count(DUPLICATE),
                "truncated": faults.count(TRUNCATED),
                "illegal": sum(x + y not in LEGAL for x, y in zip(initials, initials[1:], strict=False)),
                "first_turn": turns[0] if turns else None,
                "last_turn": turns[-1] if turns else None,
                "first_role": initials[0] if here else None,
                "last_role": initials[-1] if here else None,
            }
            own = [role[i] for i in here], [text[i] for i in here]
            if row["whole"]:
                solved.append((row, (roles, faults, END, True), own))
            else:
                row |= {"codes": bytes(r * 4 + f for r, f in zip(roles, faults, strict=True)), "matrix": transfer(roles, faults)}
                row |= {"roles": own[0], "texts": own[1]}
            out.append(row)
        if solved:
            ranking = Ranking([stretch for _, stretch, _ in solved])
            for k, (row, _, own) in enumerate(solved):
                row["cost"] = int(ranking.togo[ranking.first[k], EMPTY])
                row["audit"], row["messages"] = told(ranking, k, EMPTY, *own)
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _behind(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Reads each conversation's segments from the last to the first: the cost to go behind each."""
    nothing = object()
    conv, togo = nothing, END
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            ends = row["conv_id"] != conv
            if ends:
                conv, togo = row["conv_id"], END
            out.append({"at": row["at"], "togo": list(togo), "ends": ends})
            m = row["matrix"]
            togo = tuple(min(m[4 * s + t] + togo[t] for t in range(4)) for s in range(4))
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _stretch(row: dict) -> tuple[list[int], list[int], tuple[int, ...], bool]:
    return [c >> 2 for c in row["codes"]], [c & 3 for c in row["codes"]], tuple(row["togo"]), row["ends"]


def _through(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The state behind a segment for each state before it."""
    for batch in batches:
        if rows := batch.to_pylist():
            ranking = Ranking([_stretch(r) for r in rows])
            yield pa.RecordBatch.from_pylist([{"at": r["at"], "leaves": ranking.leaves(k)} for k, r in enumerate(rows)], schema=schema)


def _before(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Reads each conversation's segments in order: the state before each, and what meets at its border."""
    conv, state, role, turn = object(), EMPTY, None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["conv_id"] != conv:
                conv, state, role, turn = row["conv_id"], EMPTY, None, None
            meets = role is not None and row["rows"] and role + row["first_role"] not in LEGAL
            again = turn is not None and row["first_turn"] == turn
            out.append({"at": row["at"], "state": state, "meets": int(meets), "again": int(again)})
            state = row["leaves"][state]
            if row["rows"]:
                role = row["last_role"]
            if row["last_turn"] is not None:
                turn = row["last_turn"]
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _mended(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Audit, cost and messages of each segment."""
    for batch in batches:
        rows = batch.to_pylist()
        if not rows:
            continue
        ranking, out = Ranking([_stretch(r) for r in rows]), []
        for k, row in enumerate(rows):
            audit, messages = told(ranking, k, row["state"], row["roles"], row["texts"])
            left = 0 if row["ends"] else row["togo"][ranking.leaves(k)[row["state"]]]
            row["cost"] = int(ranking.togo[ranking.first[k], row["state"]]) - left
            row["illegal"], row["turns"] = row["illegal"] + row["meets"], row["turns"] - row["again"]
            out.append({f.name: row.get(f.name) for f in schema} | {"audit": audit, "messages": messages})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _summed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its segments in order; its digest grows with them."""
    conv, one, digest, audits = object(), None, None, []

    def row():
        return one | {"audit": "".join(audits), "repaired_sha256": digest.hexdigest()}

    for batch in batches:
        out = []
        for segment in batch.to_pylist():
            if segment["conv_id"] != conv or one is None:
                if one is not None:
                    out.append(row())
                conv, digest, audits, said = segment["conv_id"], hashlib.sha256(), [], False
                one = dict.fromkeys((*COUNTS, "cost"), 0) | {"conv_id": conv, "first_turn": None, "last_turn": None}
            for c in (*COUNTS, "cost"):
                one[c] += segment[c]
            if segment["last_turn"] is not None:
                one["last_turn"] = segment["last_turn"]
                if one["first_turn"] is None:
                    one["first_turn"] = segment["first_turn"]
            audits.append(segment["audit"])
            for m in segment["messages"]:
                digest.update((("\n" if said else "") + m["role"] + ":" + m["text"]).encode())
                said = True
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if one is not None:
        yield pa.RecordBatch.from_pylist([row()], schema=schema)


def _mapped(frame: DataFrame, function, fields: list[T.StructField]) -> DataFrame:
    """``mapInArrow`` with the result's schema given to the function as well."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        return function(batches, arrow)

    return frame.mapInArrow(run, schema)


def _in_order(frame: DataFrame, at) -> DataFrame:
    return frame.repartition("conv_id").sortWithinPartitions("conv_id", at)


def segments(rows: DataFrame) -> DataFrame:
    """Repaired stretches of conversations, in the order of ``at`` within each: counts, audit and messages.

    ``rows`` has conv_id, turn, role, text and copies, how often a row stands there (0: it
    only tells of its conversation). Most conversations are one stretch (``whole``).
    """
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).select("*", digest)
    place = F.struct(F.col("turn").alias("turn"))
    again = rows.where("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min(place).alias("least"), F.max(place).alias("most"))
    again = again.where("least < most").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "least")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    bare = F.rtrim("text", F.lit(SPACE))
    fault = (
        F.when(F.col("copies") == 0, GONE)
        .when(bare == "", BLANK)
        .when(F.col("least") < place, DUPLICATE)
        .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED)
        .otherwise(FINE)
    )
    judged = rows.join(again, same, "left").select("conv_id", "turn", "role", "text", "digest", "copies", fault.alias("fault"))
    order = ["conv_id", "turn", "role", "digest"]
    dealt = judged.repartitionByRange(*order).sortWithinPartitions(*order)
    # the copies of a row, a bounded number at a time; only the first is not a duplicate
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.col("copies") - 1, F.lit(0)), F.lit(COPIES))).alias("block"))
    last = F.least(F.col("block") + COPIES, F.greatest("copies", F.lit(1))) - 1
    dealt = dealt.select("*", F.explode(F.sequence("block", last)).alias("copy"))
    later = (F.col("copy") > 0) & (F.col("fault") != BLANK)
    fault = F.when(later, DUPLICATE).otherwise(F.col("fault"))
    dealt = dealt.select("conv_id", "turn", "role", fault.alias("fault"), "text")
    dealt = dealt.withColumn("text", F.when(F.col("fault").isin(FINE, TRUNCATED), F.col("text")))

    conv, turn = rows.schema["conv_id"], rows.schema["turn"].dataType
    stats = [
        T.StructField("conv_id", conv.dataType),
        *_long("at"),
        T.StructField("whole", T.BooleanType()),
        *_long(*COUNTS),
        T.StructField("first_turn", turn),
        T.StructField("last_turn", turn),
    ]
    result = [*_long("cost"), T.StructField("audit", T.StringType()), T.StructField("messages", MESSAGES)]
    packed = [
        T.StructField("first_role", T.StringType()),
        T.StructField("last_role", T.StringType()),
        T.StructField("codes", T.BinaryType()),
        T.StructField("matrix", T.ArrayType(T.LongType())),
        T.StructField("roles", T.ArrayType(T.StringType())),
        T.StructField("texts", T.ArrayType(T.StringType())),
    ]
    found = stored(_mapped(dealt, _segments, [*stats, *result, *packed]), "segments")
    names = [f.name for f in (*stats, *result)]
    ends = found.where("not whole").drop("cost", "audit", "messages")
    four = lambda c: T.StructField(c, T.ArrayType(T.LongType()))
    behind = [*_long("at"), four("togo"), T.StructField("ends", T.BooleanType())]
    behind = stored(_mapped(_in_order(ends.select("conv_id", "at", "matrix"), F.desc("at")), _behind, behind), "behind")
    through = _mapped(ends.select("at", "codes").join(behind, "at"), _through, [*_long("at"), four("leaves")])
    borders = ends.select("conv_id", "at", "rows", "first_role", "last_role", "first_turn", "last_turn").join(through, "at")
    before = _mapped(_in_order(borders, F.asc("at")), _before, _long("at", "state", "meets", "again"))
    mended = stored(_mapped(ends.join(behind, "at").join(before, "at"), _mended, [*stats, *result]), "mended")
    return found.where("whole").select(names).union(mended)


def summaries(parts: DataFrame) -> DataFrame:
    """One row a conversation: counts, cost, audit and the digest of its repaired messages."""
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    kept = ["conv_id", *COUNTS, "first_turn", "last_turn", "cost", "audit"]
    whole = parts.where("whole").select(*kept, F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
    fields = [parts.schema[c] for c in kept] + [T.StructField("repaired_sha256", T.StringType())]
    spread = _mapped(_in_order(parts.where("not whole"), F.asc("at")), _summed, fields)
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps")
    return whole.union(spread).select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
