"""Benchmark decontamination: CGK embedding and bit-sampling LSH find windows, exact edit distance decides."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latchkey.llm.common import small_batches, text_column, tidy

FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: All ASCII bytes but letters and digits.
DROPPED = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
#: The same bytes as blanks, A-Z lower-cased.
SPACED = bytes(32 if c in DROPPED else FOLD[c] for c in range(256))
#: Normalised bytes of documents that walks take at once, and that candidates are checked for at once.
BATCH, GROUP = 2 << 20, 8 << 20
#: Texts of a group at most; the numbers of places have 21 bits for them.
MOST_TEXTS = 1 << 20
#: Items that one pass over the documents looks for.
ITEMS = 5_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SMALL_MULTIPLIER = np.uint32(0x9E3779B1)


def normalise(text: str) -> bytes:
    """Letters and digits alone, A-Z lower-cased; bytes beyond ASCII stay."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD, DROPPED)


def edit_distance_inside(item: bytes, text: bytes) -> int:
    """The least edit distance of ``item`` to any part of ``text``: Myers' bit-parallel columns."""
    n = len(item)
    if not n:
        return 0
    at: dict[int, int] = defaultdict(int)
    for i, c in enumerate(item):
        at[c] |= 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best = full, 0, n, n
    for c in text:
        eq = at.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right, left = down | ~(diagonal | up) & full, diagonal & up
        score += 1 if right & top else -1 if left & top else 0
        best = min(best, score)
        right, left = (right << 1) & full, (left << 1) & full
        up, down = left | ~(diagonal | right) & full, right & diagonal
    return best


def edit_distances_inside(items: list[bytes], pairs: list[tuple[int, bytes]]) -> np.ndarray:
    """``edit_distance_inside`` of many pairs (item's place, text) at once: the same bit-parallel columns,
    with a row for each pair and items in blocks of 64 bits."""
    out = np.zeros(len(pairs), np.int64)
    one, top = np.uint64(1), np.uint64(63)
    blocks = np.array([-(-len(items[i]) // 64) for i, _ in pairs], np.int64)
    for n in np.unique(blocks).tolist():
        mine = np.flatnonzero(blocks == n)
        mine = mine[np.argsort([len(pairs[k][1]) for k in mine], kind="stable")]
        for group in np.array_split(mine, -(-len(mine) // 4096)):
            used, row = np.unique([pairs[k][0] for k in group], return_inverse=True)
            has = np.zeros((n, len(used), 256), np.uint64)
            for u, i in enumerate(used.tolist()):
                for k, c in enumerate(items[i]):
                    has[k // 64, u, c] |= one << np.uint64(k % 64)
            longest = max(len(pairs[k][1]) for k in group)
            # 255 is in no text, and after a text's end it lets no distance fall.
            text = np.frombuffer(b"".join(pairs[k][1].ljust(longest, b"\xff") for k in group), np.uint8).reshape(len(group), longest).T.copy()
            size = np.array([len(items[pairs[k][0]]) for k in group], np.int64)
            last = ((size - 1) % 64).astype(np.uint64)
            base, flat = row.astype(np.int64) * 256, has.reshape(n, -1)
            up, down = np.full((n, len(group)), ~np.uint64(0)), np.zeros((n, len(group)), np.uint64)
            score, best = size.astype(np.int32), size.astype(np.int32)
            none = np.zeros(len(group), np.uint64)
            for column in text:
                at, more, less = base + column, none, none
                for b in range(n):
                    eq, p, m = flat[b].take(at), up[b], down[b]
                    vertical = eq | m
                    eq |= less
                    right = eq & p
                    right += p
                    right ^= p
                    right |= eq
                    left = right & p
                    right |= p
                    np.invert(right, out=right)
                    right |= m
                    if b == n - 1:
                        score += ((right >> last) & one).astype(np.int32)
                        score -= ((left >> last) & one).astype(np.int32)
                        np.minimum(best, score, out=best)
                        carry_more = carry_less = none
                    else:
                        carry_more, carry_less = right >> top, left >> top
                    right <<= one
                    right |= more
                    left <<= one
                    left |= less
                    more, less = carry_more, carry_less
                    np.bitwise_and(right, vertical, out=down[b])
                    vertical |= right
                    np.invert(vertical, out=vertical)
                    np.bitwise_or(vertical, left, out=up[b])
            out[group] = best
    return out


@dataclass
class Index:
    """Items, and for each class of lengths its coins, sampled steps, and windows of items by LSH key."""

    items: list[tuple[int, bytes]]
    #: (item's place in ``items``, words between blanks) of items that are only found as they are.
    exact: list[tuple[int, bytes]]
    classes: list[dict]
    #: For each item and size of q-grams: how many a match shares with it at least, and which it has.
    grams: dict[int, list[tuple[int, np.ndarray]]]
    similarity: float


#: (least normalised bytes, steps, sampled steps, repeats) by length, longest first. Measured with 20 % of the
#: letters of check_s items replaced at random: an item of 24 bytes meets its copy with probability 0.94, of 40
#: 0.97, of 76 0.99 or more, of 120 0.93, of 200 0.99.
CLASSES = ((110, 28, 20, 2), (60, 24, 18, 3), (24, 20, 14, 5))
#: Sizes of q-grams.
SIZES = (3, 4)
#: Starts that walk together, so that they stay in the processor's cache.
WALK = 1 << 15
#: Steps after which windows that can't be an item's are dropped, walked in 32 bits. Only time depends on it.
EARLY = 20
#: Places of a found window that are checked as one.
NEAR = 8


def _glance(coins: np.ndarray, sampled: np.ndarray) -> np.ndarray:
    """20-bit keys of the steps ``sampled`` of walks from all places of ``coins`` but the last 64. It has the
    upper halves of the bytes' random numbers: the same coins, and as good to tell bytes apart. Walks are
    followed from their last step back: what is left of a walk goes on from its place or from the next one,
    so each step takes all places at once in their order."""
    key = np.zeros(len(coins) - 64 + len(sampled), np.uint32)
    for step in range(len(sampled) - 1, -1, -1):
        v = coins[: len(key) - 1]
        moves = v >> np.uint32(step)
        moves &= np.uint32(1)
        np.negative(moves, out=moves)
        moves &= key[:-1] ^ key[1:]
        key = key[:-1] ^ moves
        if sampled[step]:
            key *= SMALL_MULTIPLIER
            key ^= v
    return (key * SMALL_MULTIPLIER) >> np.uint32(12)


def walk(numbers: np.ndarray, text: np.ndarray, starts: np.ndarray | None, sampled: np.ndarray, early: np.ndarray | None = None, glance: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows and their LSH keys: the CGK random walk writes the byte it stands on at each step
    and moves on if the step's coin for that byte says so, which turns few edits into few differing steps;
    the key is made of the bytes at the sampled steps. ``numbers`` has a random number for each byte, which
    stands for the byte in keys and holds its coins as bits. With a bitmap ``early`` walks start at all
    places of ``text`` but the last 64, and those whose first ``glance`` steps aren't in it are dropped after them."""
    if early is not None:
        upper = (numbers >> np.uint64(32)).astype(np.uint32)
        parts = (upper.take(text[i : i + WALK + 64]) for i in range(0, len(text) - 64, WALK))
        starts = np.concatenate([np.zeros(0, np.int64), *(i * WALK + np.flatnonzero(early.take(_glance(part, sampled[:glance]))) for i, part in enumerate(parts))])
    at, key = starts, np.zeros(len(starts), np.uint64)
    for step, used in enumerate(sampled):
        v = numbers.take(text.take(at))
        if used:
            key *= MULTIPLIER
            key ^= v
        at = at + ((v >> np.uint64(32 + step)) & np.uint64(1)).view(np.int64)
    return starts, key * MULTIPLIER


def _grams(buffer: np.ndarray, q: int) -> np.ndarray:
    """16-bit hashes of the ``q`` bytes from each place on."""
    n = max(0, len(buffer) - q + 1)
    h = np.zeros(n, np.uint32)
    for k in range(q):
        h = (h ^ buffer[k : k + n]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return h.astype(np.uint16)


def _spaced(text: str) -> bytes:
    """Words as in ``normalise``, each between blanks."""
    return b" " + b" ".join(text.encode("utf-8", "surrogatepass").translate(SPACED).split()) + b" "


def build_index(items: list[tuple[int, str]], similarity: float = 0.8, classes: tuple = CLASSES, seed: int = 42) -> Index:
    """An index of every window of every item (8,192 items at most), with walks by class of length (see CLASSES). Items shorter
    than the last class are found as they are, as whole words: any text would hold something like them."""
    kept = [(i, b) for i, t in items if (b := normalise(t))]
    if len(kept) > 1 << 13:
        raise ValueError("more than 8,192 items at once")
    spaced = [_spaced(t) for _, t in items if normalise(t)]
    least = classes[-1][0]
    out, longest = [], 1 << 62
    random = np.random.RandomState(seed)
    for shortest, steps, samples, repeats in classes:
        coins = random.randint(0, 1 << 64, (repeats, 256), dtype=np.uint64)
        sampled = np.zeros((repeats, steps), bool)
        for r in range(repeats):
            sampled[r, random.choice(steps, samples, replace=False)] = True
        mine = [n for n, (_, b) in enumerate(kept) if shortest <= len(b) < longest]
        longest = shortest
        if not mine:
            continue
        keys, whose, offsets, early = [], [], [], np.zeros((repeats, 1 << 20), bool)
        glance = min(EARLY, steps)
        for n in mine:
            b = kept[n][1]
            starts = np.arange(0, len(b) - steps // 2 + 1)
            padded = np.frombuffer(b + bytes(64), np.uint8)
            keys.append(np.stack([walk(coins[r], padded, starts, sampled[r])[1] for r in range(repeats)]))
            for r in range(repeats):
                early[r, _glance((coins[r] >> np.uint64(32)).astype(np.uint32)[padded], sampled[r, :glance])[starts]] = True
            whose.append(np.full(len(starts), n, np.int64))
            offsets.append(starts)
        k, w, o = np.concatenate(keys, axis=1), np.concatenate(whose), np.concatenate(offsets)
        order = np.argsort(k, axis=1, kind="stable")
        seen = np.zeros((repeats, 1 << 20), bool)
        for r in range(repeats):
            seen[r, (k[r] >> np.uint64(44)).astype(np.int64)] = True
        out.append({"coins": coins, "sampled": sampled, "keys": np.take_along_axis(k, order, 1), "whose": w[order], "offsets": o[order], "seen": seen, "early": early, "glance": glance})
    grams = {}
    for n, (_, b) in enumerate(kept):
        if len(b) >= least:
            most, grams[n] = int((1 - similarity) * len(b) + 1e-9), []
            for q in SIZES:
                has = np.zeros(1 << 16, bool)
                has[_grams(np.frombuffer(b, np.uint8), q)] = True
                grams[n].append((len(b) - q + 1 - q * most, np.packbits(has)))
    return Index(kept, [(n, spaced[n]) for n, (_, b) in enumerate(kept) if len(b) < least], out, grams, similarity)


def _spots(index: Index, buffer: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct rows (text, item, place in steps of NEAR) where a window of the item is met and as many
    q-grams of it are about as any part that is similar enough must share."""
    grams, out = [_grams(buffer, q) for q in SIZES], [np.zeros((0, 3), np.int64)]
    for lo in range(0, int(ends[-1]) if len(ends) else 0, BATCH):
        part, found = buffer[lo : lo + BATCH + 64], [np.zeros(0, np.int64)]
        for c in index.classes:
            for r in range(len(c["coins"])):
                begin, key = walk(c["coins"][r], part, None, c["sampled"][r], c["early"][r], c["glance"])
                maybe = np.flatnonzero(c["seen"][r][(key >> np.uint64(44)).astype(np.int64)])
                left = np.searchsorted(c["keys"][r], key[maybe], "left")
                many = np.searchsorted(c["keys"][r], key[maybe], "right") - left
                hit = np.repeat(np.arange(len(maybe)), many)
                entry = left[hit] + np.arange(len(hit)) - np.repeat(np.cumsum(many) - many, many)
                at = lo + begin[maybe[hit]]
                text = np.searchsorted(ends, at, "right")
                place = (at - c["offsets"][r][entry] - first[text]) // NEAR
                # One number for each row: 13 bits of item, 21 of text, 29 of place.
                found.append(np.unique(c["whose"][r][entry] << 50 | text << 29 | place + 64))
        one = np.unique(np.concatenate(found))
        rows = np.stack([one >> 29 & (1 << 21) - 1, one >> 50, (one & (1 << 29) - 1) - 64], axis=1)
        for part in np.split(rows, np.flatnonzero(np.diff(rows[:, 1])) + 1):
            if not len(part):
                continue
            item = int(part[0, 1])
            n = len(index.items[item][1])
            most = int((1 - index.similarity) * n + 1e-9)
            for i in range(0, len(part), 4096):
                some = part[i : i + 4096]
                for q, every, (least, has) in zip(SIZES, grams, index.grams[item], strict=True):
                    begin = first[some[:, 0]] + some[:, 2] * NEAR - most
                    places = np.clip(begin[:, None] + np.arange(n + 2 * most + NEAR - q + 1), 0, len(every) - 1)
                    shared = np.cumsum(np.unpackbits(has).view(bool)[every[places]], axis=1, dtype=np.int32)
                    width = n + most - q + 1
                    inside = np.maximum(shared[:, width - 1], (shared[:, width:] - shared[:, :-width]).max(axis=1, initial=0))
                    some = some[inside >= least]
                out.append(some)
    return np.unique(np.concatenate(out), axis=0)


def _regions(index: Index, spots: np.ndarray):
    """(text, item, begin, until): parts of texts that hold all that an item may match from its places;
    places less than two items apart share a part."""
    if not len(spots):
        return
    size = np.array([len(b) for _, b in index.items], np.int64)[spots[:, 1]]
    most = ((1 - index.similarity) * size + 1e-9).astype(np.int64)
    begin = spots[:, 2] * NEAR - most
    order = np.lexsort((begin, spots[:, 1], spots[:, 0]))
    text, item, begin, until = (x[order] for x in (spots[:, 0], spots[:, 1], begin, begin + size + 2 * most + NEAR))
    new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (begin[1:] > begin[:-1] + 2 * size[order][1:])])
    yield from zip(text[new].tolist(), item[new].tolist(), begin[new].tolist(), np.maximum.reduceat(until, new).tolist(), strict=True)


def find(index: Index, texts: list[bytes], spaced: list[bytes] | None = None) -> list[tuple[int, int, int]]:
    """(text's place, item's place, edit distance) of texts in which an item is found; ``spaced`` has the
    texts' words for items that are found as they are."""
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    buffer = np.frombuffer(b"".join(texts) + bytes(64), np.uint8)
    found: dict[tuple[int, int], int] = {}
    keys, pairs = [], []
    for text, item, begin, until in _regions(index, _spots(index, buffer, ends, ends - lengths)):
        part = texts[text][max(0, begin) : max(0, until)]
        if index.items[item][1] in part:
            found[text, item] = 0
        else:
            keys.append((text, item))
            pairs.append((item, part))
    # The edits of an item are no fewer than those of its first 64 bytes and of the next together.
    items = [b for _, b in index.items]
    allowed = np.array([int((1 - index.similarity) * len(items[i]) + 1e-9) for i, _ in pairs], np.int64)
    left, least = np.arange(len(pairs)), np.zeros(len(pairs), np.int64)
    for k in (0, 64):
        some = [n for n in left.tolist() if len(items[pairs[n][0]]) > k]
        least[some] += edit_distances_inside([b[k : k + 64] for b in items], [pairs[n] for n in some])
        left = left[least[left] <= allowed[left]]
    for n, d in zip(left.tolist(), edit_distances_inside(items, [pairs[n] for n in left]).tolist(), strict=True):
        if d <= allowed[n]:
            found[keys[n]] = min(d, found.get(keys[n], d))
    for item, words in index.exact:
        found.update({(t, item): 0 for t, w in enumerate(spaced or ()) if words in w})
    return [(t, i, d) for (t, i), d in found.items()]


def find_items(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", items: int = ITEMS, **index) -> DataFrame:
    """(doc_id, item_id, edit_distance, similarity): a row for each document and benchmark item such
    that some part of the document is within edit similarity ``similarity`` of the item.

    Both texts are compared as letters and digits alone, lower-cased; the distance is over the bytes,
    the similarity ``1 - distance / item's length``. Windows of the document meet windows of items by
    equal keys of bit-sampled CGK embeddings, repeated with other coins; a window is a stretch of the
    item (any offset of it) and not the whole item, since CGK spreads k edits to up to k squared steps:
    in an item with edits some stretch has few. Windows start at every byte; steps, samples and repeats
    go by the item's length (see CLASSES). Every place found that shares enough q-grams with the item is
    checked by exact edit distance.

    The benchmark is read in blocks of ``items`` rows, a pass over the documents each, so what is sent
    to executors has a bound that doesn't grow with either table. Null texts are empty and hold
    nothing; null ids are kept; items of under 24 bytes are found as they are only (see build_index). Repeated
    rows give repeated rows; empty tables give an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(text_col).alias("text"))
    schema = "doc_id long, item_id long, edit_distance int, similarity double"
    rows = benchmark.select(F.col(item_col).cast("long").alias("item_id"), text_column(item_text_col).alias("text")).distinct()
    out, block = None, []

    def search(part: list) -> DataFrame:
        sent = spark.sparkContext.broadcast(vars(build_index(part, similarity, **index)))

        def run(batches):
            known = Index(**sent.value)

            def flush(ids, texts, spaced):
                hits = sorted(find(known, texts, spaced))
                lengths = [len(known.items[i][1]) for _, i, _ in hits]
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[t] for t, _, _ in hits], pa.int64()),
                        pa.array([known.items[i][0] for _, i, _ in hits], pa.int64()),
                        pa.array([d for *_, d in hits], pa.int32()),
                        pa.array([round(1 - d / n, 6) for (*_, d), n in zip(hits, lengths, strict=True)], pa.float64()),
                    ],
                    ["doc_id", "item_id", "edit_distance", "similarity"],
                )

            ids, texts, spaced, held = [], [], [], 0
            for batch in batches:
                for i in range(batch.num_rows):
                    ids.append(batch.column(0)[i].as_py())
                    text = batch.column(1)[i].as_py()
                    texts.append(normalise(text))
                    if known.exact:
                        spaced.append(_spaced(text))
                    held += len(texts[-1])
                    if held >= GROUP or len(texts) >= MOST_TEXTS:
                        yield flush(ids, texts, spaced)
                        ids, texts, spaced, held = [], [], [], 0
            if ids:
                yield flush(ids, texts, spaced)

        return picked.mapInArrow(tidy(run), schema)

    for row in rows.orderBy("item_id", "text").toLocalIterator():
        block.append((row.item_id, row.text))
        if len(block) == items:
            out, block = (search(block) if out is None else out.unionByName(search(block))), []
    if block or out is None:
        out = search(block) if out is None else out.unionByName(search(block))
    return out
