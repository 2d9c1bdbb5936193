"""Passages are found in whole texts, however their lines are broken."""

import numpy as np

from latchkey.llm import paragraph_dedup


def test_passages_across_line_ends(spark):
    """Shared runs of 51 words, wrapped at other places in each document, are found and cut where they come again."""
    random = np.random.RandomState(3)
    some = lambda n: [f"w{random.randint(1 << 30)}" for _ in range(n)]
    wrap = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    runs, texts = [some(51) for _ in range(20)], []
    for i, r in enumerate(runs):
        texts += [wrap(some(i) + r + some(40), 12 + i), "A\n\n" + wrap(some(30) + r + some(3 * i), 15)]
    texts += [wrap(some(400), 15), wrap(some(60) * 2, 11)]
    docs = spark.createDataFrame(list(enumerate([*texts, None, "", "\n\n"])), "doc_id long, text string")
    got = paragraph_dedup.repeated_paragraphs(docs)
    rows = got.collect()
    assert {r.doc_id for r in rows if r.across} == set(range(40)) and {r.doc_id for r in rows if not r.across} == {41}
    assert {r.doc_id for r in rows if r.removed} == {*range(1, 40, 2), 41}
    kept = {r.doc_id: r.text for r in paragraph_dedup.without_repeats(docs, got).collect()}
    assert all(kept[i] == texts[i] for i in (*range(0, 40, 2), 40))
    for i, r in enumerate(runs):
        left, own = kept[2 * i + 1].split(), texts[2 * i + 1].split()
        lost = [x for x in own if x not in set(left)]
        assert left == [x for x in own if x in set(left)] and 25 <= len(lost) and set(lost) <= set(r)
        assert kept[2 * i + 1].count("\n") == texts[2 * i + 1].count("\n")


def test_a_text_wrapped_anew_is_found(spark):
    """The same 120 words at 12 and at 100 words a line, which gave no row."""
    w = [f"v{i}" for i in range(120)]
    texts = ["\n".join(" ".join(w[i : i + n]) for i in range(0, 120, n)) for n in (100, 12, 15)]
    got = paragraph_dedup.repeated_paragraphs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id for r in got.collect() if r.removed} == {1, 2}
