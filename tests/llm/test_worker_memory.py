"""What the pipeline's Python workers hold beside the executor's JVM."""

import gc
import weakref

import pyarrow as pa

from latchkey.llm import tokens, toxicity
from latchkey.llm.common import tidy


def test_token_files_are_read_by_one_python_function_per_task(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two"), (2, None), (3, "three")], "doc_id long, text string")
    from latchkey.llm.queries import tokenizer_path

    encoded = tokens.encode_texts(docs, tokenizer_path())
    tokens.write_shards(encoded, tokens.by_frequency(tokens.id_counts(encoded)), str(tmp_path / "t"), 2)
    chained = []
    real = tokens.staged
    tokens.staged = lambda df, name: chained.append(df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")) or real(df, name)
    try:
        got = tokens.token_digest(spark, str(tmp_path / "t")).orderBy("doc_id").collect()
    finally:
        tokens.staged = real
    assert chained == [1]
    assert [r.doc_id for r in got] == [1, 2, 3] and got[1].n_tokens == 1


def test_words_that_a_toxicity_task_remembers_go_with_it():
    model = toxicity.Model(["idiot", "mor*"], __import__("numpy").zeros(2 + len(toxicity.PATTERNS)), 0.0)
    model.score(["an idiot", "more of it"])
    held = weakref.ref(next(x for x in gc.get_objects() if isinstance(x, toxicity._Hits) and "idiot" in x))
    del model
    gc.collect()
    assert held() is None


def test_arrow_gives_its_reserve_back_when_a_task_ends(monkeypatch):
    asked = []

    class Pool:
        def release_unused(self):
            asked.append(1)

    batches = [pa.RecordBatch.from_arrays([pa.array([k])], ["k"]) for k in range(3)]
    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    out = tidy(lambda rows: rows)(batches)
    assert [next(out) for _ in range(3)] == batches and not asked
    assert list(out) == [] and asked == [1]
