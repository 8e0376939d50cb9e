"""Repaired conversations against all edits, compared by cost and then audit."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from spoorline.llm import repair
from spoorline.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WS = "\x20\x09\x0a\x0b\x0c\x0d"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def longhand(rows):
    """rows of one conversation: (turn, role, text). Least (cost, audit, messages) from every place, from the end on."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(WS)
        if not bare:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    full = {"u": "user", "a": "assistant"}
    best = [{} for _ in range(len(rows) + 1)]
    best[-1] = {"": (0, "", ()), "a": (0, "", ())}

    def inserts(at):
        for _ in range(4):
            for state in ("", "s", "u", "a"):
                for new in "ua":
                    after = best[at].get(step.get((state, new)))
                    if after:
                        way = (after[0] + 3, "I" + after[1], ((full[new], ""), *after[2]))
                        best[at][state] = min(best[at].get(state, way), way)

    inserts(len(rows))
    for at in range(len(rows) - 1, -1, -1):
        _, role, text = rows[at]
        for state in ("", "s", "u", "a"):
            ways = []
            if after := best[at + 1].get(state):
                ways.append((after[0] + 4, "D" + after[1], after[2]))
            if faults[at] in ("", "truncated"):
                more = 3 if faults[at] else 0
                for letter, new, name, cost in [("K", role[:1], role, 0), *(("R", c, full[c], 3) for c in "ua")]:
                    if after := best[at + 1].get(step.get((state, new))):
                        ways.append((after[0] + cost + more, letter + after[1], ((name, text), *after[2])))
            if ways:
                best[at][state] = min(ways)
        inserts(at)
    cost, audit, messages = best[0][""]
    initials = [role[:1] for _, role, _ in rows]
    turns = [t for t, *_ in rows if t is not None]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        faults.count("blank"),
        faults.count("duplicate"),
        faults.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        cost,
        audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in messages).encode()).hexdigest(),
    )


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def expected(rows):
    by = {conv: [] for conv, *_ in rows}
    for conv, *rest in damage(rows):
        by[conv].append(tuple(rest))
    return sorted(((conv, *longhand(own)) for conv, own in by.items()), key=repr)


def found(frame):
    done = repair.summaries(repair.segments(repair.damaged(frame)))
    return sorted((tuple(r[c] for c in COLUMNS) for r in done.collect()), key=repr)


def made(rng, n_convs, most):
    rows = []
    for conv in [None, *range(n_convs)]:
        for turn in range(rng.randrange(most)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "So \n", " ", "", None, "What? ", "and then", "x.\n\n", "é…"])
            rows.append((conv, rng.choice([turn, turn, turn, turn // 2, None]), role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("batch", [1, 3, 50, 10_000])
def test_equals_all_edits_for_any_batch(spark, batch):
    """Batches of one row make every row a segment."""
    rows = made(random.Random(batch), 60, 12)
    rows += [(99, t, "user", "Yes.") for t in range(70)] + [(98, 1, "assistant", "again")] * 40
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_many_copies_of_a_row(spark, monkeypatch):
    monkeypatch.setattr(repair, "COPIES", 7)
    rows = [(5, 3, "user", "Hm.")] * 100 + [(5, 4, "assistant", "Ja.")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_messages_of_the_segments(spark):
    rows = [(1, 0, "system", "Be kind.", 1), (1, 1, "assistant", "Hello.", 1), (1, 2, "user", "", 1)]
    parts = repair.segments(spark.createDataFrame(rows, f"{SCHEMA}, copies long")).collect()
    assert [(m.role, m.text) for p in parts for m in p.messages] == [("system", "Be kind."), ("user", ""), ("assistant", "Hello.")]
    assert "".join(p.audit for p in parts) == "KIKD"


def test_hard_rows(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)
    assert found(frame) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    clash = frame.withColumns({c: F.lit("x") for c in ("copies", "at", "digest", "fault", "whole")})
    assert found(clash) == found(frame)
    long_text = [(1, 0, "user", "word " * 200_000), (1, 1, "assistant", "?" * 500_000)]
    assert found(spark.createDataFrame(long_text, SCHEMA)) == expected(long_text)
    huge = [(2**62 + 1, 0, "user", "a."), (None, 1, "assistant", "b.")]
    assert found(spark.createDataFrame(huge, SCHEMA)) == expected(huge)


def test_ranks_order_whole_audits():
    rng = random.Random(5)
    roles, faults = [rng.randrange(4) for _ in range(40)], [rng.randrange(4) for _ in range(40)]
    ranking = repair.Ranking([(roles, faults, repair.END, True)])
    audits = []
    for place in range(41):
        tail = repair.Ranking([(roles[place:], faults[place:], repair.END, True)])
        audits += [bytes(repair.LETTERS[k] for k in tail.path(0, s)[0]).decode() for s in range(4)]
    by_rank = sorted(range(164), key=lambda n: ranking.rank[n])
    assert [audits[n] for n in by_rank] == sorted(audits)


def test_query_equals_all_edits(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    done = QUERIES["op13_repair"](spark, SF)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in done.collect()), key=repr) == expected(rows)
