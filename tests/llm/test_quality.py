"""Quality rules against SQL, plain counts and every order of the cascade."""

import itertools
import random

import duckdb

from latchkey.llm import quality

PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew potions beneath the old stone bridge at midnight every other winter"


def plain_repeats(w, k=8):
    windows = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    return len({i + j for i, g in enumerate(windows) if windows.count(g) > 1 for j in range(k)})


def test_repeat_words():
    r = random.Random(3)
    texts = [[r.choice("ab") for _ in range(r.randrange(50))] for _ in range(60)] + [[], ["a"] * 8, ["a"] * 9, list("abcdefgh") * 2]
    assert quality.repeat_words(texts) == [plain_repeats(t) for t in texts]
    assert quality.repeat_words([]) == [] and quality.repeat_words([["a"]]) == [0]


def texts():
    upper = " ".join(f"{w.upper()}!!" for w in PROSE.split())
    junk = " ".join(w + "***" for w in PROSE.split())
    lines = "\n".join(f"{w} {v}\nsame\nline" for w, v in zip(PROSE.split(), reversed(PROSE.split()), strict=True))
    return [None, "", " \n", "short text", PROSE, PROSE + " " + PROSE, upper, junk, lines, " ".join(map(str, range(100, 140))), " ".join("ab" * 9 + str(i) for i in range(30)), " ".join(f"the w{i}" for i in range(25)), "a " * 100, PROSE + " " * 5, " ".join("xyzwv"[i % 5] + chr(97 + i) for i in range(26)), "x" * 300_000 + " " + PROSE]


def test_equal_to_sql_and_cases(spark, tmp_path):
    rows = [(i, t, "r", 1) for i, t in enumerate(texts())]
    d = spark.createDataFrame(rows, "doc_id long, text string, failed_rule string, n_words int")
    got = {r.doc_id: tuple(r)[1:-1] for r in quality.judge(d, fraction=1.0).collect()}
    d.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert got == {r[0]: r[1:] for r in con.sql(quality.ORACLE).fetchall()}
    rule = {r.doc_id: r.failed_rule for r in quality.judge(d, fraction=1.0).collect()}
    assert got[4][-1] and got[13][-1] and not got[5][-1] and rule[4] is None and rule[5] is None
    assert all(rule[i] for i in (6, 7, 8, 9, 10, 11, 14))
    for name in quality.RULES:
        one = {r.doc_id for r in quality.judge(d, rules={name: quality.RULES[name]}, fraction=1.0).where(f"failed_rule = '{name}'").collect()}
        assert one, name


def test_order_is_the_cheapest_of_a_greedy_kind():
    sets = {0b000: 50, 0b001: 10, 0b011: 30, 0b100: 10}
    assert quality.order_of(sets, [1.0, 1.0, 1.0]) == [0, 2, 1]  # rule 1 rejects nothing that rule 0 leaves
    assert quality.order_of(sets, [100.0, 1.0, 1.0]) == [1, 2, 0]
    assert quality.order_of({}, [2.0, 1.0]) == [1, 0]

    def cost(order, seconds):
        left, out = dict(sets), 0.0
        for k in order:
            out += seconds[k] * sum(left.values())
            left = {s: n for s, n in left.items() if not s >> k & 1}
        return out

    for seconds in ([1.0, 1.0, 1.0], [100.0, 1.0, 1.0], [1.0, 5.0, 2.0]):
        assert cost(quality.order_of(sets, seconds), seconds) == min(cost(o, seconds) for o in itertools.permutations(range(3)))


def test_odd_rows(spark):
    schema = "doc_id long, text string"
    assert quality.judge(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, PROSE), (None, None), (3, PROSE), (3, PROSE)]
    got = quality.judge(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.kept) for r in got) == [(-1, 0, False), (-1, 25, True), (3, 25, True), (3, 25, True)]
