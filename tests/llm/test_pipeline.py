"""The pipeline's stages, each against a plain version on its own input."""

import brute
import numpy as np

import corpus_pipeline as C
from latchkey.llm import paragraph_dedup, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    texts = lambda d: {r.doc_id: r.text for r in d.collect()}
    stages = dict(C.STAGES)

    one = stages["toxicity"](spark, docs, SF)
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    before = texts(docs)
    toxic = {i for i, s in zip(before, model.score(list(before.values())), strict=True) if round(s, 6) >= 0.5}
    assert one.columns == columns and set(texts(one)) == set(before) - toxic

    two = stages["near duplicates"](spark, one, SF)
    rest = {d: t or "" for d, t in texts(one).items()}
    sets = {d: set(zip(*(t.lower().split()[k:] for k in range(5)), strict=False)) or {tuple(t.lower().split())} for d, t in rest.items()}
    ids = sorted(sets)
    near = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert two.columns == columns and set(texts(two)) == {d for d, c in brute.components(ids, near).items() if d == c}

    three = stages["benchmark decontamination"](spark, two, SF)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, t in texts(two).items() if any(x in t for x in items)}
    assert three.columns == columns and set(texts(three)) == set(texts(two)) - leaks

    four = stages["source mixing"](spark, three, SF)
    assert four.columns == columns and set(texts(four)) <= set(texts(three))
    n = {}
    for r in four.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    assert max(n.values()) <= 3

    five = stages["token output"](spark, four, SF).collect()
    assert len(five) == sum(n.values())
    five.sort(key=lambda r: r.start)
    assert [r.start for r in five[1:]] == [a.start + a.n_tokens for a in five[:-1]]
    assert [r.doc_id for r in five] == sorted(r.doc_id for r in five)


def test_odd_columns(spark):
    """Extra columns with clashing names, null ids and repeated rows come through."""
    extra = "doc_id long, text string, lang string, source string, n_chars long, gone long, picked long, copies int, row int, col int"
    rows = [(i, f"text number {i} " * 9, "en", "s", 1, 1, 2, 3, 4, 5) for i in range(20)] + [(None, None, None, None, None, 1, 2, 3, 4, 5)]
    docs = spark.createDataFrame(rows + rows[:2], extra)
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == [c.split(" ")[0] for c in extra.split(", ")]
        docs.collect()


def test_near_copies_of_jaccard(spark):
    """Copies of five-word Jaccard 0.8 or more go, whatever their fingerprints; less similar ones stay."""
    random = np.random.RandomState(7)
    word = lambda: "".join(random.choice(list("abcdefghij"), 6))
    texts = []
    for _ in range(40):
        w = [word() for _ in range(200)]
        texts.append(" ".join(w))
        for changed in (1, 3, 12):
            v = list(w)
            for p in random.choice(200, changed, replace=False):
                v[p] = word()
            texts.append(" ".join(v))
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    part = brute.components(range(len(sets)), links)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate([*texts, "", None, " "])], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in dict(C.STAGES)["near duplicates"](spark, docs, SF).collect()}
    want = {d for d, c in part.items() if d == c} | {160}
    assert want <= kept and len(kept - want) <= 0.01 * len(texts)


def test_near_copies_by_simhash(spark):
    """Similar texts within three bits go if their bands never meet; texts within three bits that are not similar stay."""
    docs, n = [], 0
    for seed in (92, 1785, 2046):
        random = np.random.RandomState(seed)
        a = [f"w{x}" for x in random.randint(0, 10_000, 200)]
        b = list(a)
        for p in random.choice(200, 4, replace=False):
            b[p] = "new" + b[p]
        pair = [" ".join(a), " ".join(b)]
        keys = paragraph_dedup.band_keys(pair, 5, paragraph_dedup.bands_for(0.8, 0.99, 4), 4)
        bits = simhash.fingerprint(pair[0]) ^ simhash.fingerprint(pair[1])
        assert not (keys[0] == keys[1]).any() and (bits & (1 << 64) - 1).bit_count() <= 3
        docs += [(n, pair[0], "en", "s", 1), (n + 1, pair[1], "en", "s", 1)]
        n += 2
    # One fingerprint, since repeated shingles decide its bits; few distinct shingles are shared.
    body = " ".join(f"b{i % 7}" for i in range(700))
    same = [body + " " + " ".join(f"{c}{i}" for i in range(12)) for c in "pq"]
    assert simhash.fingerprint(same[0]) == simhash.fingerprint(same[1])
    docs += [(n + i, t, "en", "s", 1) for i, t in enumerate(same)]
    kept = {r.doc_id for r in dict(C.STAGES)["near duplicates"](spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()}
    assert kept == {0, 2, 4, n, n + 1}
