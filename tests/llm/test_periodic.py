"""Periodic runs against a plain search for all periods."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from latchkey.llm import periodic


def runs(w, least=24, times=3):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(least, times * q) and not any(all(w[k] == w[k + p] for k in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(doc_id, text, plant=True):
    w = periodic.WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if plant and h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(found), *top, top[0] is not None and 1000 * top[1] // top[2] or None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def texts():
    r = random.Random(5)
    out = [None, "", " \t", "one", "a " * 23, "a " * 24, "a b " * 12, "\u00a0 x" * 30]
    for _ in range(120):
        w = [r.choice("abc") for _ in range(r.randrange(60))]
        for _ in range(r.randrange(1, 4)):
            q = r.choice([1, 2, 3, 7, 8, 23, 24, 25, 26, 36, 37, 54, 55, 80])
            unit = [r.choice("ab") + str(r.randrange(9)) for _ in range(q)]
            w += (unit * 6)[: r.randrange(2 * q, 5 * q)] + [r.choice("abc") for _ in range(r.randrange(30))]
        out.append(r.choice([" ", "\n", " \x0b"]).join(w))
    return out


def test_runs_equal_a_plain_search(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    d = spark.createDataFrame([(*x, 1, "r") for x in rows], "doc_id long, text string, id int, runs string")
    got = {r.doc_id: tuple(r)[1:] for r in periodic.digests(periodic.periodic_runs(periodic.planted(d))).collect()}
    assert got == {i: plain(i, t) for i, t in rows}
    assert sum(v[0] > 0 for v in got.values()) > 60
    free = {r.doc_id: tuple(r)[1:] for r in periodic.digests(periodic.periodic_runs(d)).collect()}
    assert free == {i: plain(i, t, plant=False) for i, t in rows}


def test_odd_rows(spark):
    schema = "doc_id long, text string"
    assert periodic.digests(periodic.periodic_runs(periodic.planted(spark.createDataFrame([], schema)))).count() == 0
    rows = [(None, "a b " * 20), (None, None), (3, "x y z " * 300), (3, "x y z " * 300)]
    got = periodic.periodic_runs(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or -1, r.n_words, len(r.runs), r.collapsed) for r in got) == [(-1, 0, 0, ""), (-1, 40, 1, "a b"), (3, 900, 1, "x y z"), (3, 900, 1, "x y z")]


@pytest.mark.parametrize("n", [200_000])
def test_a_very_long_text(spark, n):
    r = random.Random(1)
    unit = [str(r.randrange(10**6)) for _ in range(n // 10)]
    text = " ".join([*map(str, range(n, 2 * n)), *unit * 4, *map(str, range(n))])
    got = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.inline("runs")).collect()
    assert [tuple(x) for x in got] == [(n, 4 * len(unit), len(unit))]
