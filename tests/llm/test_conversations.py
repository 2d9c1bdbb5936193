"""Repair of conversations against a plain search over all edits."""

import functools
import hashlib
import random
import re
import zlib

import pytest

from latchkey.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, n int, block string"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damage(conv, rows):
    one = lambda v: " " if v is None else str(v)
    out = []
    for turn, role, text in rows:
        h = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if h == 1:
            text = ""
        elif h == 2:
            text = re.sub("[.!?]", "", text)
        elif h == 4:
            role = "user"
        out += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


def plain(rows, insert=5):
    faults, seen = [], set()
    for _, role, text in rows:
        letters = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.cache
    def best(i, last, inserted):
        """Cheapest (cost, audit, lines) from row i on after role initial ``last``."""
        found = [(0, "", ())] if i == len(rows) and last in ("", "a") else []

        def then(cost, edit, line, i, last, inserted):
            c, a, t = best(i, last, inserted)
            found.append((cost + c, edit + a, ((line,) if line is not None else ()) + t))

        for role in ("user", "assistant"):
            if (last, role[0]) in NEXT and inserted < 3:
                then(insert, "I", role + ":", i, role[0], inserted + 1)
        if i < len(rows):
            _, role, text = rows[i]
            then(2, "D", None, i + 1, last, 0)
            if faults[i] not in ("blank", "duplicate"):
                add = 5 * (faults[i] == "truncated")
                if (last, role[:1]) in NEXT:
                    then(add, "K", f"{role}:{text}", i + 1, role[0], 0)
                for new in ("user", "assistant"):
                    if (last, new[0]) in NEXT:
                        then(1 + add, "R", f"{new}:{text}", i + 1, new[0], 0)
        return min(found) if found else (10**9, "", ())

    for i in range(len(rows), -1, -20):  # keeps the recursion shallow
        for last in ("", "s", "u", "a"):
            best(i, last, 0)
    cost, audit, lines = best(0, "", 0)
    turns = {r[0] for r in rows} - {None}
    pairs = [rows[i][1][:1] + rows[i + 1][1][:1] for i in range(len(rows) - 1)]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def made():
    r = random.Random(11)
    texts = [None, "", " \n", "Yes.", "No!", "half", "Why?", "a long answer. ", "Ü.\t"]
    rows = []
    for conv in [None, *range(150)]:
        for turn in range(r.randrange(1, 14)):
            role = r.choice(["user", "assistant"]) if r.random() < 0.5 else ["user", "assistant"][turn % 2]
            role = r.choice([None, "", "system", "tool", role, role]) if r.random() < 0.3 else role
            rows.append((conv, r.choice([None, turn, turn, turn, turn, turn * 2]), role, r.choice(texts) if r.random() < 0.5 else f"text {r.random()}{r.choice(['.', '!', ''])}"))
    return rows


def check(spark, rows, first, partitions="4"):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        d = spark.createDataFrame([(*x, 7, "clash") for x in rows], SCHEMA).drop("n")
        out = conversations.repair_damaged(d, first=first).select("conv_id", *COLUMNS).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    per = {}
    for conv, *rest in rows:
        per.setdefault(conv, []).append(rest)
    assert len(out) == len(per)
    assert {r.conv_id: tuple(r)[1:] for r in out} == {c: plain(damage(c, v)) for c, v in per.items()}
    return out


@pytest.mark.parametrize("first", [1, 64])
def test_equal_to_a_plain_search(spark, first):
    out = check(spark, made(), first)
    # At these costs an insertion never pays: taking the row beside it out is cheaper.
    assert {e for r in out for e in r.audit} == set("DKR")


def test_insertions_where_they_pay(monkeypatch):
    monkeypatch.setattr(conversations, "INSERT", 1)
    end = conversations._inserted([0 if s in conversations.ACCEPT else conversations.FAR for s in conversations.STATES])
    r = random.Random(4)
    edits = set()
    for _ in range(400):
        rows = [(t, r.choice(["user", "assistant", "system", "tool"]), r.choice([f"t{t}.", f"t{t}.", f"t{t}", ""])) for t in range(r.randrange(8))]
        kept = [(role, text, 0, bool(text) and text[-1] != ".", not text) for _, role, text in rows]
        audit, state = conversations.walk(kept, end, 0, True)
        lines = conversations.repaired(kept, audit, 0)
        want = plain(rows, insert=1)
        assert (audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()) == want[-2:] and state in conversations.ACCEPT
        cut = r.randrange(len(kept) + 1)  # the same in two blocks, with the first one's costs by its crossing
        cross = conversations.crossing(kept[cut:])
        after = [min(cross[4 * s + t] + end[t] for t in range(4)) for s in range(4)]
        first, state = conversations.walk(kept[:cut], after, 0, False)
        assert first + conversations.walk(kept[cut:], end, state, True)[0] == audit
        edits |= set(audit)
    assert edits == set("DIKR")


def test_a_conversation_over_many_partitions(spark):
    r = random.Random(2)
    rows = [(5, t, r.choice(["user", "assistant", "system"]), r.choice(["Yes.", f"t{t}.", f"t{t}", ""])) for t in range(700)]
    rows += [(5, 9, "user", "the same again.")] * 40 + [(6, None, "user", None)] * 5 + [(c, 0, "user", "Hi.") for c in range(7, 40)]
    check(spark, rows, 2, partitions="9")


def test_dropped_and_empty(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = check(spark, [(gone, 0, "user", "Hi.")], 64)
    assert tuple(row)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversations.repair_damaged(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    counted = spark.createDataFrame([(1, 0, "user", "Hi.", 3), (1, 1, "assistant", "x" * 5_000_000 + ".", 1)], "conv_id long, turn long, role string, text string, n int")
    (row,) = conversations.repair(counted).collect()
    assert (row.audit, row.cost, row.duplicate, row.illegal) == ("KDDK", 4, 2, 2)
