"""Structure repair of conversations: the cheapest edits after which roles alternate, by a checkpointed dynamic program."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latchkey.llm.common import small_batches, staged

VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
#: Costs of edits; a truncated row that stays adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after system, after user, after assistant. ``NEXT`` by role initial; ``TURN`` is the
#: only role that an edit can give in a state, since two of one kind never stand side by side.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
TURN = ("user", "user", "assistant", "user")
TO = (2, 2, 3, 2)
ACCEPT = (0, 3)
FAR = 1 << 50
STATES = range(4)
#: Rows of the first block of a conversation in a partition; each further one holds one more, so n rows give
#: blocks and checkpoints in the order of the square root of n. A block also ends at so many characters.
FIRST, MOST_CHARS = 64, 4 << 20

#: A row as the program sees it: role, text, copies (rows that must go, after it or in its place), truncated,
#: gone (must go itself).
Row = tuple[str, str, int, bool, bool]


def _inserted(v: list[int]) -> list[int]:
    """Costs when rows may be inserted first; two do, a third would close a circle."""
    for _ in range(2):
        v = [min(v[s], INSERT + v[TO[s]]) for s in STATES]
    return v


def _choices(s: int, row: Row) -> Iterator[tuple[str, int, int]]:
    """(initial, cost, state after it) of the edits that use up a row, in ASCII order."""
    role, _, _, truncated, gone = row
    yield "D", DELETE, s
    if not gone:
        add = TRUNCATED * truncated
        if role[:1] in NEXT[s]:
            yield "K", add, NEXT[s][role[:1]]
        yield "R", REROLE + add, TO[s]


def _before(row: Row, after: list[int]) -> list[int]:
    """Costs from before a row on, by state, from those after it."""
    after = [c + DELETE * row[2] for c in after]
    return _inserted([min(c + after[t] for _, c, t in _choices(s, row)) for s in STATES])


END = _inserted([0 if s in ACCEPT else FAR for s in STATES])


def crossing(rows: list[Row]) -> list[int]:
    """Least cost from each state before the rows to each state after them (insertions before a row, not after the last)."""
    out = []
    for t in STATES:
        v = [0 if s == t else FAR for s in STATES]
        for row in reversed(rows):
            v = _before(row, v)
        out.append(v)
    return [min(out[t][s], FAR) for s in STATES for t in STATES]


def walk(rows: list[Row], after: list[int], state: int, last: bool) -> tuple[str, int]:
    """The ASCII-least of the cheapest edits of a block, entered in ``state``, and the state in which it ends.
    The costs of its places are recomputed from the checkpoint behind it, ``after``."""
    costs = [after]
    for row in reversed(rows):
        costs.append(_before(row, costs[-1]))
    costs.reverse()
    out: list[str] = []
    for i, row in enumerate(rows):
        while True:
            here, behind = costs[i][state], costs[i + 1]
            edits = [*_choices(state, row)]
            tight = {e: t for e, c, t in edits if c + DELETE * row[2] + behind[t] == here}
            if INSERT + costs[i][TO[state]] == here:
                tight["I"] = TO[state]
            edit = min(tight)
            out.append(edit)
            state = tight[edit]
            if edit != "I":
                out.append("D" * row[2])
                break
    while last and not (state in ACCEPT and after[state] == 0):
        out.append("I")
        state = TO[state]
    return "".join(out), state


def repaired(rows: list[Row], audit: str, state: int) -> list[str]:
    """Lines ``role:text`` of the rows that stay or come in."""
    out, at, left = [], -1, 0
    for edit in audit:
        if edit == "I":
            out.append(TURN[state] + ":")
            state = TO[state]
            continue
        if left:
            left -= 1
            continue
        at += 1
        role, text, left = rows[at][:3]
        if edit == "K":
            out.append(f"{role}:{text}")
            state = NEXT[state][role[:1]]
        elif edit == "R":
            out.append(f"{TURN[state]}:{text}")
            state = TO[state]
    return out


_ROW = pa.struct([("role", pa.string()), ("text", pa.string()), ("copies", pa.int64()), ("truncated", pa.bool_()), ("gone", pa.bool_())])
_FACTS = ["blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn"]
_BLOCK = f"conv_id string, part int, block int, {', '.join(f'{n} bigint' for n in _FACTS)}, first_role string, last_role string, cross array<bigint>, rows array<struct<role:string,text:string,copies:bigint,truncated:boolean,gone:boolean>>"
_RESULT = pa.schema([("conv_id", pa.string()), *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
_ANSWER = "conv_id string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_LEGAL = ("su", "ua", "au")


class _Block:
    def __init__(self, conv, part: int, block: int):
        self.conv, self.part, self.block = conv, part, block
        self.rows: list[Row] = []
        self.facts = dict.fromkeys(_FACTS[:5], 0) | {"first_turn": None, "last_turn": None}
        self.first_role = self.last_role = None
        self.chars = 0

    def add(self, turn, role: str, text: str, n: int, seen: bool) -> None:
        f, initial = self.facts, role[:1]
        if self.last_role is not None:
            f["illegal"] += self.last_role + initial not in _LEGAL
        else:
            self.first_role = initial
        f["illegal"] += n - 1
        self.last_role = initial
        if turn is not None:
            if turn != f["last_turn"]:
                f["turns"] += 1
            f["first_turn"] = turn if f["first_turn"] is None else f["first_turn"]
            f["last_turn"] = turn
        letters = VISIBLE.findall(text[-64:]) or VISIBLE.findall(text)
        truncated = False
        if not letters:
            f["blank"] += n
        else:
            f["duplicate"] += n - (not seen)
            truncated = not seen and letters[-1] not in ".!?"
            f["truncated"] += truncated
        gone = seen or not letters
        self.rows.append((role, "" if gone else text, n - 1, truncated, gone))
        self.chars += len(self.rows[-1][1])

    def row(self) -> dict:
        return {"conv_id": self.conv, "part": self.part, "block": self.block, **self.facts, "first_role": self.first_role, "last_role": self.last_role, "cross": crossing(self.rows),
                "rows": [dict(zip(("role", "text", "copies", "truncated", "gone"), r, strict=True)) for r in self.rows]}


    def solved(self) -> dict:
        audit, state = walk(self.rows, END, 0, True)
        done = _Joined(self.conv)
        done.add({**self.facts, "first_role": self.first_role, "last_role": self.last_role, "audits": [audit], "exits": [state]}, self.rows)
        return {"done": done.row()}


_BLOCK_ARROW = pa.schema([("conv_id", pa.string()), ("part", pa.int32()), ("block", pa.int32()), *[(n, pa.int64()) for n in _FACTS], ("first_role", pa.string()), ("last_role", pa.string()), ("cross", pa.list_(pa.int64())), ("rows", pa.list_(_ROW)), ("done", pa.struct(list(_RESULT)))])


def _emit(rows: Iterator[tuple[dict, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows, each given with its characters."""
    out, chars = [], 0
    for row, n in rows:
        out.append(row)
        chars += n
        if len(out) >= 1000 or chars >= MOST_CHARS:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, chars = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _cutter(first: int):
    """Blocks of the sorted rows of one partition. A marker row before a row says that its text is new.
        A conversation of one block that lies inside the partition is solved at once."""

    def cut(batches):
        def blocks():
            now, new, inner = None, None, False
            for batch in batches:
                for part, conv, turn, role, key, text, n in zip(*[batch.column(c).to_pylist() for c in ("part", "conv_id", "turn", "role", "key", "text", "n")], strict=True):
                    if n == 0:
                        new = (conv, turn, role, key)
                        continue
                    same = now is not None and now.conv == conv
                    if now is not None and (not same or len(now.rows) >= first + now.block or now.chars >= MOST_CHARS):
                        if inner and not same and now.block == 0:
                            yield now.solved(), 0
                        else:
                            yield now.row(), now.chars
                        inner = inner or not same
                        now = _Block(conv, part, now.block + 1 if same else 0)
                    now = now or _Block(conv, part, 0)
                    now.add(turn, role, text, n, new != (conv, turn, role, key))
            if now is not None:
                yield now.row(), now.chars

        return _emit(blocks(), _BLOCK_ARROW)

    return cut


_MARK = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("conv_id", pa.string()), ("after", pa.list_(pa.int64())), ("last", pa.bool_()), ("alone", pa.bool_())])


def _checkpoints(batches):
    """Costs behind each block, by state, from the last block of a conversation back to its first."""

    def marks():
        conv, v, held = object(), END, None
        for batch in batches:
            for c, part, block, cross in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "part", "block", "cross")], strict=True):
                last = c != conv
                if held:
                    yield held | {"alone": held["last"] and last}, 0
                if last:
                    conv, v = c, END
                held = {"part": part, "block": block, "conv_id": c, "after": v, "last": last}
                v = [min(min(cross[4 * s + t] + v[t] for t in STATES), FAR) for s in STATES]
        if held:
            yield held | {"alone": held["last"]}, 0

    return _emit(marks(), _MARK)


_PIECE = pa.schema([*[f for f in _BLOCK_ARROW if f.name not in ("cross", "done")], ("audits", pa.list_(pa.string())), ("exits", pa.list_(pa.int64()))])


def _walks(batches):
    """Each block walked from every state in which it could be entered; the only block of a conversation is entered in state 0."""

    def pieces():
        for batch in batches:
            for b in batch.to_pylist():
                rows = [tuple(r.values()) for r in b["rows"]]
                walked = [walk(rows, b["after"], s, b["last"]) if s == 0 or not b["alone"] else ("", s) for s in STATES]
                yield {n: b[n] for n in _PIECE.names[:-2]} | {"audits": [a for a, _ in walked], "exits": [e for _, e in walked]}, sum(len(r[1]) for r in rows)

    return _emit(pieces(), _PIECE)


class _Joined:
    """A conversation put together from its blocks in order; texts only pass through the digest."""

    def __init__(self, conv):
        self.conv, self.state, self.audit, self.sha, self.any = conv, 0, [], hashlib.sha256(), False
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.low = self.high = self.role = None
        self.kept_truncated = 0

    def add(self, b: dict, rows: list[Row]) -> None:
        for n in self.sums:
            self.sums[n] += b[n]
        if b["first_turn"] is not None:
            self.sums["turns"] -= self.high == b["first_turn"]
            self.low = b["first_turn"] if self.low is None else self.low
            self.high = b["last_turn"]
        if self.role is not None:
            self.sums["illegal"] += self.role + b["first_role"] not in _LEGAL
        self.role = b["last_role"]
        audit = b["audits"][self.state]
        for line in repaired(rows, audit, self.state):
            self.sha.update((("\n" if self.any else "") + line).encode())
            self.any = True
        at = left = 0
        for edit in audit:
            if edit != "I" and left:
                left -= 1
            elif edit != "I":
                self.kept_truncated += edit != "D" and rows[at][3]
                left, at = rows[at][2], at + 1
        self.audit.append(audit)
        self.state = b["exits"][self.state]

    def row(self) -> dict:
        audit = "".join(self.audit)
        cost = audit.count("R") * REROLE + audit.count("D") * DELETE + audit.count("I") * INSERT + TRUNCATED * self.kept_truncated
        s = self.sums
        return {"conv_id": self.conv, "gaps": 0 if self.low is None else self.high - self.low + 1 - s["turns"], **{n: s[n] for n in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit, "repaired_sha256": self.sha.hexdigest()}


def _join_blocks(batches):
    def results():
        now = None
        for batch in batches:
            for b in batch.to_pylist():
                if now is None or now.conv != b["conv_id"]:
                    if now is not None:
                        yield now.row(), sum(map(len, now.audit))
                    now = _Joined(b["conv_id"])
                now.add(b, [tuple(r.values()) for r in b["rows"]])
        if now is not None:
            yield now.row(), sum(map(len, now.audit))

    return _emit(results(), _RESULT)


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with faults planted by crc32 of ``conv_id:turn`` modulo 20; null role and text, and null
    conv_id and turn within that name, are one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    d = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), h.alias("h")).where("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("h") == 3, 2).otherwise(1).alias("n"))


def repair(rows: DataFrame, first: int = FIRST) -> DataFrame:
    """One row per conv_id of ``rows`` (conv_id, turn, role, text and, if given, n: how often the row occurs):
    gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows go by turn (nulls first), then role and the SHA-256 of the text; equal rows stand together. Null
    role and text are one space; a null conv_id is a conversation of its own. An empty table gives an
    empty result; other columns are not looked at.

    No task needs a whole conversation in memory: equal rows are counted before they move, sorted ranges
    cut a long conversation anywhere (one of a single block inside a range is solved there), its blocks grow with the square root of its rows, only the costs
    of crossing a block go to the backward pass that leaves a checkpoint behind each block, and blocks are walked
    forward on their own for each state they may be entered in. The last pass streams blocks in order.
    """
    small_batches(rows.sparkSession)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    n = F.col("n") if "n" in rows.columns else F.lit(1)
    kind = rows.schema["conv_id"].dataType
    r = rows.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"), n.cast("long").alias("n"))
    r = r.withColumn("key", F.sha2("text", 256))
    once = r.groupBy("conv_id", "turn", "role", "key").agg(F.first("text").alias("text"), F.sum("n").alias("n"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    new = r.groupBy("conv_id", "role", "key").agg(F.min(turn).alias("t"))
    new = new.select("conv_id", F.col("t.turn").alias("turn"), "role", "key", F.lit("").alias("text"), F.lit(0).cast("long").alias("n"))
    order = ["conv_id", "turn", "role", "key"]
    dealt = once.unionByName(new).repartitionByRange(*order).sortWithinPartitions(*order, "n")
    blocks = staged(dealt.withColumn("part", F.spark_partition_id()).mapInArrow(_cutter(first), _BLOCK + ", done struct<" + _ANSWER.replace(" ", ":").replace(",:", ",") + ">"), "blocks")
    done, blocks = blocks.where("done is not null").select("done.*"), blocks.where("done is null").drop("done")

    light = blocks.select("conv_id", "part", "block", "cross").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("block"))
    marks = light.mapInArrow(_checkpoints, "part int, block int, conv_id string, after array<bigint>, last boolean, alone boolean")
    on = (blocks["part"] == marks["part"]) & (blocks["block"] == marks["block"]) & blocks["conv_id"].eqNullSafe(marks["conv_id"])
    met = blocks.join(marks, on).select(*[blocks[c] for c in blocks.columns if c != "cross"], marks["after"], marks["last"], marks["alone"])
    pieces = met.mapInArrow(_walks, f"{_BLOCK.replace(' cross array<bigint>,', '')}, audits array<string>, exits array<bigint>")
    joined = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    found = joined.mapInArrow(_join_blocks, _ANSWER).unionByName(done)
    return found.withColumn("conv_id", F.col("conv_id").cast(kind))


def repair_damaged(rows: DataFrame, first: int = FIRST) -> DataFrame:
    """``repair`` of the damaged rows, with a row for each conv_id of ``rows``, those left without rows included."""
    done = repair(damaged(rows), first).withColumnRenamed("conv_id", "done_id")
    every = rows.select("conv_id").distinct()
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    out = every.join(done, every["conv_id"].eqNullSafe(done["done_id"]), "left").drop("done_id").withColumns(zero)
    return out.withColumns({"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))})
