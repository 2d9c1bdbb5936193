"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latchkey.llm.common import small_batches, staged, text_column, tidy

WORDS = re.compile(r"[^\W\d_]+")
#: A seed lexicon of insults, for corpora with few labels.
SEED_WORDS = ("idiot", "moron", "stupid", "loser", "pathetic", "worthless", "scum", "trash", "clown", "dumb", "disgusting", "imbecile")
#: The share that labels have in the classes from which voters' rates are estimated. They have no vote.
ANCHOR = 0.5
#: Standard deviations by which a term must be more frequent in toxic rows than chance has it: among
#: millions of terms none gets so far by chance.
BEYOND_CHANCE = 6
PATTERNS = ("lexicon hits", "lexicon share", "several hits", "shouting", "exclamation", "addressed")
SHOUTED = re.compile(r"\b[A-Z]{3,}\b")
SAYS_YOU = re.compile(r"\b(?:you|your|you're|u r)\b", re.IGNORECASE)


#: Letters of a stem: words of languages with endings meet in their first letters.
STEMS = range(3, 9)


def terms_of(word: str) -> list[str]:
    """The word and its stems; a stem is written with a star."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def held_out(doc_id):
    """Rows whose labels are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


class _Hits(dict):
    """The places of a word's terms in a lexicon, remembered for up to 200,000 words."""

    def __init__(self, place: dict[str, int]) -> None:
        super().__init__()
        self.place = place

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        hits = self[word] = tuple(self.place[t] for t in terms_of(word) if t in self.place)
        return hits


def features_of(texts: list[str], place: dict[str, int], width: int, known: _Hits | None = None) -> np.ndarray:
    """For each text logarithms of lexicon counts, then the pattern features. Only words that hold a term of
    the lexicon are looked at further, and each distinct word is matched with the lexicon once; ``known`` has
    what a task remembers of them, which goes when the task ends."""
    known, rows, columns = _Hits(place) if known is None else known, [], []
    more = np.zeros((len(texts), len(PATTERNS)), np.float32)
    for i, text in enumerate(texts):
        words = WORDS.findall(text.lower())
        found = [k for hits in map(known.__getitem__, words) if hits for k in hits]
        rows += [i] * len(found)
        columns += found
        n = max(1, len(words))
        more[i, 3:5] = min(1.0, len(SHOUTED.findall(text)) / n), min(1.0, text.count("!") / n)
        if found:
            more[i, :3] = np.log1p(len(found)), min(1.0, 20 * len(found) / n), min(1.0, len(set(found)) / 3)
            more[i, 5] = bool(SAYS_YOU.search(text))
    counts = np.bincount(np.array(rows, np.int64) * width + np.array(columns, np.int64), minlength=len(texts) * width).reshape(len(texts), width)
    return np.concatenate([np.log1p(counts.astype(np.float32)), more], axis=1)


def votes_of(x: np.ndarray, width: int) -> np.ndarray:
    """Votes of each row of features: 1 toxic, -1 clean, 0 abstains. A lexicon voter for each word
    votes toxic where the word is; pattern voters vote both ways."""
    hit = x[:, width] > 0
    share, several, shout, bang, addressed = x[:, width + 1 :].T
    lexicon = (x[:, :width] > 0).astype(np.int8)
    patterns = np.stack(
        [
            np.where(hit, 1, -1),
            np.where(share > 0.2, 1, np.where(share < 0.02, -1, 0)),
            np.where(several > 0.5, 1, 0),
            np.where(shout > 0.3, -1, 0),
            np.where(bang > 0.3, -1, 0),
            np.where(addressed > 0, 1, 0),
        ],
        axis=1,
    )
    return np.concatenate([lexicon, patterns.astype(np.int8)], axis=1)


@dataclass
class LabelModel:
    """What expectation maximisation has found: the posterior of the toxic class for each row, and for each
    voter its weight, how often its votes are right, and the residual correlations with the others."""

    posterior: np.ndarray
    weight: np.ndarray
    accuracy: np.ndarray
    correlation: np.ndarray


def label_model(votes: np.ndarray, labels: np.ndarray, anchor: float = ANCHOR, rounds: int = 25) -> LabelModel:
    """A generative model of votes (-1, 0, 1): a class, then each voter's vote given the class, with rates
    that expectation maximisation estimates. The posterior of a row comes from its votes alone; ``labels``
    calibrate the rates: where these are estimated, a row's class is ``anchor`` of its label and the
    rest of its posterior, which keeps the class that is found the one that is labelled.

    Voters that agree more than the class explains are correlated; each one's evidence is divided by one
    plus the sum of its residual correlations with the others, so that copies of a voter count about once.
    Correlations within five standard errors of none are taken for none.
    """
    n, v = votes.shape
    labels = np.asarray(labels, np.float64)
    q, weight, rho = labels, np.ones(v), np.zeros((v, v))
    kinds = [(votes == x).astype(np.float32) for x in (-1, 0, 1)]
    for i in range(rounds):
        known = anchor * labels + (1 - anchor) * q
        prior, soft = np.clip(known.mean(), 1e-3, 1 - 1e-3), known.astype(np.float32)
        toxic = np.stack([k.T @ soft + 0.5 for k in kinds]) / (known.sum() + 1.5)
        clean = np.stack([k.T @ (1 - soft) + 0.5 for k in kinds]) / ((1 - known).sum() + 1.5)
        if i % 5 == 0:
            both, square = np.zeros((v, v)), np.zeros(v)
            for k in range(0, n, 2000):
                c = soft[k : k + 2000, None]
                rest = votes[k : k + 2000] - c * (toxic[2] - toxic[0]) - (1 - c) * (clean[2] - clean[0])
                both += rest.T @ rest
                square += (rest**2).sum(axis=0)
            scale = np.sqrt(square / n) + 1e-9
            rho = both / n / scale[:, None] / scale[None, :]
            np.fill_diagonal(rho, 0)
            rho = np.where(rho > max(0.05, 5 / np.sqrt(n)), np.minimum(rho, 1), 0)
            weight = 1 / (1 + rho.sum(axis=1))
        odds = np.log(prior / (1 - prior)) + sum(k @ (weight * (np.log(toxic[j]) - np.log(clean[j]))) for j, k in enumerate(kinds))
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    right = prior * toxic[2] + (1 - prior) * clean[0]
    wrong = prior * toxic[0] + (1 - prior) * clean[2]
    return LabelModel(q, weight, right / (right + wrong), rho)


@dataclass
class Model:
    """A lexicon with a linear classifier over its features."""

    lexicon: list[str]
    coefficients: np.ndarray
    intercept: float

    def score(self, texts: list[str]) -> np.ndarray:
        if not hasattr(self, "known"):
            self.known = _Hits({w: i for i, w in enumerate(self.lexicon)})
        x = features_of(texts, self.known.place, len(self.lexicon), self.known)
        return 1 / (1 + np.exp(-np.clip(x @ self.coefficients + self.intercept, -30, 30)))


def linear(x: np.ndarray, q: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton's method."""
    n = x.shape[1] + 1
    w, r = np.zeros(n), np.full(n, ridge)
    r[-1] = 1e-6
    for _ in range(rounds):
        curve, slope = np.diag(r), -r * w
        for k in range(0, len(x), 2000):
            part = np.concatenate([x[k : k + 2000], np.ones((len(x[k : k + 2000]), 1))], axis=1).astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            curve += (part * (p * (1 - p) + 1e-6)[:, None]).T @ part
            slope += part.T @ (q[k : k + 2000] - p)
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _apart(ranked: list[tuple[str, int, int]]) -> list[str]:
    """Terms in order, without those that a chosen stem already says: that begin with it and have no
    better rate."""
    chosen: dict[str, float] = {}
    for word, toxic, n in ranked:
        rate, bare = toxic / n, word.rstrip("*")
        if not any(chosen.get(bare[:k] + "*", -1.0) >= rate - 1e-9 for k in STEMS if k <= len(bare)):
            chosen[word] = rate
    return list(chosen)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = 12_000, lexicon: int = 300) -> Model:
    """Fits the model on at most ``rows`` labelled rows, chosen by a hash of their id, never held-out ones.

    Lexicon voters come from the seed words and from words and stems that occur in toxic training rows
    several times as often as in others; their number is at most ``lexicon``. Places where a term has the
    same neighbours count once, so that words of a text and its near copies aren't taken for voters. The
    label model weighs all voters and gives each row a posterior, from which the classifier learns; labels
    choose the lexicon and calibrate the voters' rates, but are no vote. Only counts of that many
    terms and the features of ``rows`` rows reach the driver. Rows with null labels are left out; labels
    that contradict each other for one id count by their largest. Without labelled rows the seed words
    alone decide.
    """
    small_batches(docs.sparkSession)
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    own = own.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_column(text_col).alias("text"))
    sample = staged(texts.join(own, "doc_id").select("label", "text"), "labelled")

    def spell(batches):
        import xxhash

        # A text has hundreds of terms, so a few texts make a batch.
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            out = {"word": [], "label": [], "place": []}
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, seen = ["", *WORDS.findall(text.lower()), ""], {}
                for k, w in enumerate(words[1:-1], 1):
                    if w not in seen:
                        seen[w] = xxhash.xxh64_intdigest(f"{words[k - 1]} {words[k + 1]}".encode("utf-8", "surrogatepass")) - (1 << 63)
                terms = {}
                for w, h in seen.items():
                    for t in terms_of(w):
                        terms.setdefault(t, h)
                out["word"] += terms
                out["place"] += terms.values()
                out["label"] += [label] * len(terms)
            yield pa.RecordBatch.from_arrays([pa.array(out["word"], pa.string()), pa.array(out["label"], pa.int64()), pa.array(out["place"], pa.int64())], ["word", "label", "place"])

    size = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")).head()
    n, toxic = size.n, size.toxic or 0
    chosen: list[str] = []
    if 0 < toxic < n:
        found = sample.mapInArrow(tidy(spell), "word string, label long, place long").distinct().groupBy("word").agg(F.sum("label").alias("t"), F.count(F.lit(1)).alias("n"))
        rate = ((F.col("t") + 0.1) / toxic) / ((F.col("n") - F.col("t") + 0.1 * (n - toxic) / toxic) / (n - toxic))
        share = toxic / n
        beyond = (F.col("t") - share * F.col("n")) / F.sqrt(share * (1 - share) * F.col("n"))
        strong = found.where((F.col("t") >= max(3, 0.005 * toxic)) & (beyond >= BEYOND_CHANCE)).withColumn("ratio", rate).where("ratio >= 3")
        ranked = strong.orderBy((F.log("ratio") * F.sqrt("t")).desc(), F.length("word"), "word").limit(10 * lexicon).collect()
        chosen = _apart([(r.word, r.t, r.n) for r in ranked])
    words = list(dict.fromkeys([*chosen, *SEED_WORDS]))[:lexicon]
    place, width = {w: i for i, w in enumerate(words)}, len(words)

    def describe(batches):
        known = _Hits(place)
        for batch in batches:
            x = [row.tobytes() for row in features_of(batch.column(1).to_pylist(), place, width, known).astype("<f4")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], ["label", "x"])

    if not 0 < toxic < n:
        c = np.zeros(width + len(PATTERNS))
        c[width] = 4.0
        return Model(words, c, -2.0)
    got = sample.mapInArrow(tidy(describe), "label int, x binary").collect()
    y = np.array([g.label for g in got], np.float64)
    x = np.frombuffer(b"".join(g.x for g in got), "<f4").reshape(len(got), -1)
    del got
    found = label_model(votes_of(x, width), y > 0)
    return Model(words, *linear(x, found.posterior))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row over its whole text.

    Null and empty texts get the score of a text without words. Null ids are held out of nothing but
    are scored; repeated rows are scored each; an empty table gives an empty result.
    """

    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                s = np.round(model.score(part.column(2).to_pylist()), 6)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), text_column(text_col).alias("text"))
    return picked.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")
