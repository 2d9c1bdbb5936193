"""Quality rules as a short-circuit cascade whose order is measured on a sample."""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latchkey.llm.common import small_batches, text_column

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS, MARKS, DIGITS = "#*$%&|<>", ".!?", "0123456789"
LETTER, CAPITALS, SMALL = regex.compile(r"\p{L}"), regex.compile(r"\p{Lu}.*\p{Lu}"), regex.compile(r"\p{Ll}")
WINDOW = 8

Rule = Callable[[str, list[str]], bool]


def _count(text: str, characters: str) -> int:
    return sum(map(text.count, characters))


def _lines(text: str) -> list[str]:
    return [line for line in text.split("\n") if WORD.search(line)]


def symbols(text: str, words: list[str]) -> bool:
    """Over one symbol for ten words."""
    return 10 * _count(text, SYMBOLS) > len(words)


def marks(text: str, words: list[str]) -> bool:
    """More full stops, exclamation and question marks than words."""
    return _count(text, MARKS) > len(words)


def digits(text: str, words: list[str]) -> bool:
    """Over three of ten characters of words are digits."""
    return 10 * _count(text, DIGITS) > 3 * sum(map(len, words))


def word_length(text: str, words: list[str]) -> bool:
    """Mean word length under 3 or over 12 characters."""
    n = sum(map(len, words))
    return n < 3 * len(words) or n > 12 * len(words)


def letters(text: str, words: list[str]) -> bool:
    """Under six of ten words hold a letter."""
    return 10 * sum(LETTER.search(w) is not None for w in words) < 6 * len(words)


def shouting(text: str, words: list[str]) -> bool:
    """Over half of the words hold two capitals or more and no small letter."""
    return 2 * sum(CAPITALS.search(w) is not None and not SMALL.search(w) for w in words) > len(words)


def repeated_lines(text: str, words: list[str]) -> bool:
    """Over half of the lines with a word are equal to an earlier one."""
    lines = _lines(text)
    return 2 * (len(lines) - len(set(lines))) > len(lines)


def top_word(text: str, words: list[str]) -> bool:
    """One word makes up over three of ten words."""
    return 10 * max(Counter(words).values(), default=0) > 3 * len(words)


#: True where a text fails.
RULES: dict[str, Rule] = {f.__name__: f for f in (symbols, marks, digits, word_length, letters, shouting, repeated_lines, top_word)}


def repeat_words(texts: list[list[str]], window: int = WINDOW) -> list[int]:
    """For each text the number of its words in windows of ``window`` (a power of two) words that it holds
    twice or more. Windows of all texts are ranked together, by ranks of their halves: no hash."""
    ends = np.cumsum([0, *map(len, texts)])
    ids: dict[str, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for t in texts for w in t), np.int64, ends[-1])
    owner = np.repeat(np.arange(len(texts)), np.diff(ends))
    if len(x) < window:
        return [0] * len(texts)
    size = 1
    while size < window:
        x = np.unique(x[:-size] * (int(x.max()) + 1) + x[size:], return_inverse=True)[1]
        size *= 2
    at = np.flatnonzero(owner[: len(x)] == owner[window - 1 :])
    _, rank, n = np.unique(x[at] * len(texts) + owner[at], return_inverse=True, return_counts=True)
    change = np.zeros(ends[-1] + 1, np.int64)
    again = at[n[rank] > 1]
    change[again] += 1
    np.subtract.at(change, again + window, 1)
    return np.bincount(owner, np.cumsum(change)[:-1] > 0, len(texts)).astype(int).tolist()


def _measure(rules: dict[str, Rule], base: Callable):
    """Of a sample's texts: how many fail which set of rules, and the seconds of each rule."""

    def run(batches):
        sets: Counter[int] = Counter()
        seconds = [0.0] * len(rules)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            words = [WORD.findall(t) for t in texts]
            keep = [i for i, bad in enumerate(base(texts, words)[1]) if not bad]
            fails = [0] * len(texts)
            for k, rule in enumerate(rules.values()):
                begin = time.perf_counter()
                for i in keep:
                    fails[i] |= rule(texts[i], words[i]) << k
                seconds[k] += time.perf_counter() - begin
            sets.update(fails[i] for i in keep)
        yield pa.RecordBatch.from_arrays([pa.array([*sets], pa.int64()), pa.array([*sets.values()], pa.int64()), pa.array([[] for _ in sets], pa.list_(pa.float64()))], ["fails", "n", "seconds"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([0], pa.int64()), pa.array([seconds], pa.list_(pa.float64()))], ["fails", "n", "seconds"])

    return run


def order_of(sets: dict[int, int], seconds: list[float]) -> list[int]:
    """Rules one after another, each the one that rejects most, of what those before it leave, for its cost.

    ``sets``: how many texts fail each set of rules (bits); ``seconds``: each rule's cost on all of them.
    Ties, and rules that reject nothing more, go by cost and then as given."""
    left, order, rest = dict(sets), [], list(range(len(seconds)))
    while rest:
        gain = {k: sum(n for s, n in left.items() if s >> k & 1) / max(seconds[k], 1e-9) for k in rest}
        best = min(rest, key=lambda k: (-gain[k], seconds[k], k))
        order.append(best)
        rest.remove(best)
        left = {s: n for s, n in left.items() if not s >> best & 1}
    return order


def _base(texts: list[str], words: list[list[str]], least_words: int, most_repeat: int):
    repeats = repeat_words(words)
    return repeats, [len(w) < least_words or 100 * r > most_repeat * len(w) for w, r in zip(words, repeats, strict=True)]


def cascade_order(docs: DataFrame, text_col: str = "text", rules: dict[str, Rule] = RULES, fraction: float = 0.01, least_words: int = 20, most_repeat: int = 30, seed: int = 7) -> list[str]:
    """Names of ``rules`` in the order of rejections for cost, measured on a share ``fraction`` of the rows
    (it grows with them). Only the sums for each set of failed rules come to the driver: fewer than two to the
    power of the number of rules. Without rows in the sample the rules stay as given."""
    small_batches(docs.sparkSession)
    base = lambda t, w: _base(t, w, least_words, most_repeat)
    some = docs.select(text_column(text_col).alias("text")).sample(fraction, seed)
    seen = some.mapInArrow(_measure(rules, base), "fails bigint, n bigint, seconds array<double>")
    cost = F.array(*[F.sum(F.get("seconds", k)) for k in range(len(rules))])
    out = seen.groupBy("fails").agg(F.sum("n").alias("n"), cost.alias("seconds")).collect()
    names = list(rules)
    seconds = next((r.seconds for r in out if r.fails == -1), [0.0] * len(rules))
    return [names[k] for k in order_of({r.fails: r.n for r in out if r.fails >= 0}, seconds)]


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, Rule] = RULES, fraction: float = 0.01, least_words: int = 20, most_repeat: int = 30) -> DataFrame:
    """One row per document: its id; n_words; word_chars (characters of words); n_symbols; n_dup_lines (lines
    with a word that equal an earlier line); n_repeat_words (words in windows of eight that occur twice or
    more); base_failed (fewer than ``least_words`` words, or over ``most_repeat`` percent of them repeat);
    kept; failed_rule (the first of the cascade that failed, null where none did or base_failed).

    Documents that pass the base go through ``rules`` one by one and leave at the first they fail, so a
    rule's cost is paid for documents only that all rules before it kept. The order comes from
    ``cascade_order``; it decides the time and ``failed_rule``, never ``kept``. Null counts as the empty text
    and fails the base. Repeated rows and null ids are judged each; an empty table gives an empty result;
    other columns are not looked at. Whole texts in batches of bounded bytes, without a shuffle."""
    order = cascade_order(docs, text_col, rules, fraction, least_words, most_repeat)
    steps = [(name, rules[name]) for name in order]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            words = [WORD.findall(t) for t in texts]
            repeats, bad = _base(texts, words, least_words, most_repeat)
            lines = [_lines(t) for t in texts]
            left, failed = [i for i, b in enumerate(bad) if not b], [None] * len(texts)
            for name, rule in steps:
                out = {i for i in left if rule(texts[i], words[i])}
                for i in out:
                    failed[i] = name
                left = [i for i in left if i not in out]
            stay = set(left)
            columns = [
                [len(w) for w in words], [sum(map(len, w)) for w in words], [_count(t, SYMBOLS) for t in texts],
                [len(v) - len(set(v)) for v in lines], repeats, bad, [i in stay for i in range(len(texts))], failed,
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()], strict=True)]], ["id", *NAMES])

    out = docs.select(F.col(id_col).alias("id"), text_column(text_col).alias("text")).mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} {t}" for n, t in zip(NAMES, ["bigint"] * 5 + ["boolean"] * 2 + ["string"], strict=True)))
    return out.withColumnRenamed("id", id_col)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule"]

#: The verdict doesn't depend on the order of the rules, so SQL can give it.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id),
v AS (
  SELECT doc_id, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    length(regexp_replace(text, '[^.!?]', '', 'g')) AS marks, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    coalesce(list_max(map_values(list_aggregate(w, 'histogram'))), 0) AS top
  FROM d),
s AS (
  SELECT v.doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(lines) AS n_lines, marks, digits, top,
    len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) AS lettered,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{Lu}.*\p{Lu}') AND NOT regexp_matches(x, '\p{Ll}'))) AS shouted
  FROM v LEFT JOIN covered c ON v.doc_id = c.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR marks > n_words OR 10 * digits > 3 * word_chars OR word_chars < 3 * n_words OR word_chars > 12 * n_words
    OR 10 * lettered < 6 * n_words OR 2 * shouted > n_words OR 2 * n_dup_lines > n_lines OR 10 * top > 3 * n_words) AS kept
FROM b
"""
