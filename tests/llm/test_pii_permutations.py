"""Surrogates of fixed length: permutations of whole spaces, of one layout and one validity."""

import random

from latchkey.llm import pii

KEY = b"k" * 32


def test_whole_spaces_are_permuted():
    phones = [f"{n:05d}" for n in range(100_000)]
    made = [pii.surrogate("phone", p, KEY) for p in phones]
    assert sorted(made) == phones and sum(a == b for a, b in zip(made, phones, strict=True)) < 20
    nets = [f"10.0.0.{n}" for n in range(256)] + [f"010.1.1.{n}" for n in range(256)] + [f"999.1.1.{n}" for n in range(256)]
    assert len({pii.surrogate("ip", a, KEY) for a in nets}) == 768
    short = [f"{n:04d}" for n in range(10_000)]
    cards = {c: pii.surrogate("card", c, KEY) for c in short}
    assert sorted(cards.values()) == short and all((pii._luhn(a) == 0) == (pii._luhn(b) == 0) for a, b in cards.items())


def test_layout_and_checks_stay():
    r = random.Random(1)
    for _ in range(200):
        account = "".join(r.choice("0123456789") for _ in range(18))
        good = "DE" + pii._iban_check("DE", account) + account
        for kind, entity in (("iban", good), ("iban", "DE00" + account), ("hex", "AKIA" + "".join(r.choice("ABCDEF0123456789") for _ in range(16))), ("hex", f"{r.getrandbits(128):032x}"), ("phone", "4930" + account[:8])):
            made = pii.surrogate(kind, entity, KEY)
            assert made != entity and pii._layout(kind, made) == pii._layout(kind, entity)
            assert made == pii.surrogate(kind, entity, KEY) != pii.surrogate(kind, entity, b"o" * 32)
    assert pii.surrogate("iban", good, KEY)[:2] == "DE"


def test_dense_numbers_end_in_one_pass(spark):
    rows = [("phone", f"{n:05d}") for n in range(60_000)] + [("surname", f"Name{chr(97 + n % 26)}{n}") for n in range(2_000)]
    again = pii.assign(spark.createDataFrame(rows, "kind string, entity string"), KEY).collect()
    tries = {(x.kind, x.entity): x.attempt for x in again}
    assert {k for k, _ in tries} <= {"surname"}
    assert len({pii.surrogate(k, e, KEY, tries.get((k, e), 0)) for k, e in rows if k == "surname"}) == 2_000
