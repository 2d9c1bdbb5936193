"""Personal data: detected entities get keyed, type-consistent surrogates."""

from __future__ import annotations

import hashlib
import re
import secrets
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latchkey.llm.common import small_batches, staged, text_column

#: Titles before a person's name, by the gender that they tell.
TITLES = {"m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"), "n": ("Dr", "Prof")}
#: Given names that tell a person without a title, by gender.
GIVEN = {
    "m": "Adam Alexander Andreas Andrew Antonio Bernd Brian Carlos Charles Christian Claude Daniel David Diego Edward Eric Felix Frank Francisco Frédéric George Hans Henry Ivan Jacques James Jan Javier Jean Jens Johannes John José Juan Jürgen Klaus Lars Lukas Luis Manuel Marc Markus Martin Matthew Michael Miguel Olivier Oscar Pablo Paul Pedro Peter Philippe Pierre Robert Stefan Steven Thomas Tom William Wolfgang".split(),
    "f": "Alice Ana Andrea Angela Anna Anne Barbara Birgit Brigitte Camille Carmen Caroline Catherine Charlotte Chloé Christine Claudia Cristina Diana Elena Elisabeth Élodie Emily Emma Eva Françoise Gabriele Hannah Heike Helen Ingrid Isabel Isabelle Jane Jennifer Julia Karin Katharina Kate Laura Linda Lisa Lucía Margaret Maria Marie Marta Mary Monika Nathalie Nicole Olga Patricia Petra Sabine Sandra Sarah Sofia Sophie Susan Ursula Victoria".split(),
}
_GENDER = {name: g for g, names in GIVEN.items() for name in names}
_TITLE, _GIVEN = ("|".join(t for ts in group.values() for t in ts) for group in (TITLES, GIVEN))
#: A name: capital or not of any script, with parts joined by hyphens or apostrophes.
_NAME = r"[^\W\d_a-z](?:[^\W\d_]|[-'’](?=[^\W\d_]))+"
ENTITY = re.compile(
    r"(?P<email>[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?<=[=:] )(?P<secret>(?=[A-Za-z0-9_/+-]*\d)[A-Za-z0-9_/+-]{16,})|\b(?P<hex>[0-9a-f]{32,64}|AKIA[0-9A-Z]{16})\b"
    r"|\b(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)\b"
    r"|(?<![\d.])(?P<ip>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?![\d]|\.\d)"
    r"|(?<![\d-])(?P<card>\d{4}(?:[ -]?\d{4}){3}|\d{4}[ -]?\d{6}[ -]?\d{5})(?![\d-])"
    r"|(?<![\d-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\d-])"
    r"|(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|(?<![\d-])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4})(?!\d)"
    rf"|\b(?P<person>(?:{_TITLE})\.? {_NAME}(?: {_NAME})?|(?:{_GIVEN}) {_NAME})"
)
MAYBE = re.compile(rf"[0-9@]|\b(?:{_TITLE}|{_GIVEN})\b")
#: Letters that stand in for letters of the same script and case.
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "àâäéèêëïîôöùûüçñß", "ÀÂÄÉÈÊËÏÎÔÖÙÛÜÇÑ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "абвгдежзиклмнопрстуфхцчшщэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ")
ALPHABET_OF = {c: a for a in ALPHABETS for c in a}
SYLLABLES = ("ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lo", "mu", "na", "pe", "ri", "so", "tu", "va", "we", "zi", "bra", "cle", "dri", "flo", "gru", "sta")
ACCENTS = {"a": "äàâ", "e": "éèê", "i": "îï", "o": "öô", "u": "üû"}
#: Attempts after which the surrogate of a name or address gets a letter or syllable more, so that there are ever more of them.
LONGER = 4
#: Kinds whose surrogates are drawn and may collide; all others are permuted.
DRAWN = ("m", "f", "n", "surname", "email")
ROUNDS = 8
ENDINGS = {"m": ("n", "rd", "s", "k"), "f": ("a", "ina", "ella", "ia"), "n": ("y", "el", "is", "en")}


def _draw(key: bytes, *parts: str):
    """An endless stream of numbers from a keyed hash."""
    block = 0
    while True:
        yield from hashlib.blake2b("\0".join((*parts, str(block))).encode("utf-8", "surrogatepass"), key=key).digest()
        block += 1


def _pick(draw, among):
    return among[(next(draw) << 16 | next(draw) << 8 | next(draw)) % len(among)]


def normal(kind: str, text: str) -> str:
    """What mentions of one entity have in common."""
    if kind in ("card", "phone", "iban"):
        return re.sub(r"[^0-9A-Z]", "", text)
    return text.lower() if kind == "email" else text


def _luhn(digits: str) -> int:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10


def _iban_check(country: str, account: str) -> str:
    """The two check digits that make the remainder by 97 one."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def _name_like(kind: str, part: str, draw, more: int) -> str:
    """A name in the script, case and accents of ``part``."""
    if unicodedata.name(part[0], "").startswith("LATIN"):
        made = "".join(_pick(draw, SYLLABLES) for _ in range(3 + more)) + _pick(draw, ENDINGS.get(kind, ("er", "man", "ov", "son")))
        if not part.isascii():
            at = _pick(draw, [i for i, c in enumerate(made) if c in ACCENTS])
            made = made[:at] + _pick(draw, ACCENTS[made[at]]) + made[at + 1 :]
    else:
        letters = [c for c in part if c in ALPHABET_OF]
        made = "".join(_pick(draw, ALPHABET_OF[c.lower()]) if c.lower() in ALPHABET_OF else c for c in part + "".join(letters[-1:]) * more)
    return made.upper() if part.isupper() and len(part) > 1 else made.lower() if part.islower() else made.capitalize()


def _layout(kind: str, entity: str) -> tuple[list[str | None], bool]:
    """For each character those that may stand there, None where it stays or follows from the others; and
    whether check digits (or, of an address, all four numbers) are valid."""
    keep, checked, skip = 0, False, ()
    if kind == "phone":
        keep = max(0, len(entity) - 9)
    elif kind == "card":
        checked = _luhn(entity) == 0
        skip = (len(entity) - 1,) if checked else ()
    elif kind == "iban":
        keep, checked = 4, entity[2:4] == _iban_check(entity[:2], entity[4:])
    elif kind == "ip":
        checked = all(n == str(int(n)) and int(n) < 256 for n in entity.split("."))
    elif kind == "hex" and entity.startswith("AKIA"):
        keep = 4
    hexed = kind == "hex" and all(c in "0123456789abcdef" for c in entity)
    places = [None if i < keep or i in skip else "abcdef" if hexed and c.isalpha() else ALPHABET_OF.get(c) for i, c in enumerate(entity)]
    return places, checked


def _permuted(x: int, size: int, key: bytes, name: str) -> int:
    """x's image under a keyed permutation of the numbers below ``size``: a Feistel network over the bits
    that hold them, applied again where it leaves them."""
    bits = max(2, (size - 1).bit_length())
    while True:
        low, high = bits // 2, bits - bits // 2
        a, b = x >> high, x & (1 << high) - 1
        for i in range(ROUNDS):
            h = hashlib.blake2b(f"{name}\0{size}\0{i}\0{b}".encode("utf-8", "surrogatepass"), key=key).digest()
            a, b, low, high = b, (a ^ int.from_bytes(h, "big")) & (1 << low) - 1, high, low
        x = a << high | b
        if x < size:
            return x


def _rearranged(kind: str, entity: str, key: bytes) -> str:
    """The surrogate of an entity of fixed length, by a keyed permutation of all entities of its layout: distinct
    entities have distinct surrogates whatever their number, without a look at the others."""
    places, checked = _layout(kind, entity)
    made = entity
    while True:
        if kind == "ip" and checked:
            x = _permuted(int.from_bytes(bytes(map(int, made.split("."))), "big"), 1 << 32, key, "ip")
            return ".".join(map(str, x.to_bytes(4, "big")))
        x, size = 0, 1
        for c, among in zip(made, places, strict=True):
            if among is not None:
                x, size = x * len(among) + among.index(c), size * len(among)
        name = kind + "\0" + "".join(c if among is None else among[0] for c, among in zip(entity, places, strict=True) if among is not None or kind not in ("card", "iban"))
        x, out = _permuted(x, size, key, name), []
        for c, among in zip(reversed(entity), reversed(places), strict=True):
            if among is None:
                out.append(c)
            else:
                x, i = divmod(x, len(among))
                out.append(among[i])
        made = "".join(reversed(out))
        if kind == "card" and checked:
            made = next(made[:-1] + d for d in "0123456789" if _luhn(made[:-1] + d) == 0)
        elif kind == "iban" and checked:
            made = made[:2] + _iban_check(made[:2], made[4:]) + made[4:]
        if _layout(kind, made) == (places, checked):
            return made


def surrogate(kind: str, entity: str, key: bytes, attempt: int = 0) -> str:
    """The surrogate of a normalised entity, of the same kind. Names keep gender, script, accents, case and
    joined parts; all else keeps its length, the class of each character, what tells its kind (country codes,
    key prefixes), and valid check digits where the entity's are. Names and e-mail addresses grow with
    attempts; all others are permuted and know no attempts."""
    if kind not in DRAWN:
        return _rearranged(kind, entity, key)
    draw, more = _draw(key, kind, entity, str(attempt)), attempt // LONGER
    if kind != "email":
        return "".join(p if p in "-'’" else _name_like(kind, p, draw, more) for p in re.split(r"([-'’])", entity) if p)
    out, at = [], entity.rfind(".")
    for i, c in enumerate(entity):
        if c == "@":
            out += [_pick(draw, ALPHABETS[0]) for _ in range(more)]
        letters = ALPHABET_OF.get(c)
        out.append(c if letters is None or i >= at else _pick(draw, letters))
    return "".join(out)


def pieces(kind: str, text: str) -> list[tuple[str, str]]:
    """The (kind, entity) that a mention is made of: a person has a given name, whose gender the title or
    the name itself tells, and a surname; any other mention is one entity."""
    if kind != "person":
        return [(kind, normal(kind, text))]
    names = text.split(" ")
    gender = next((g for g, ts in TITLES.items() if names[0].rstrip(".") in ts), None)
    if gender is not None:
        names = names[1:]
    if len(names) > 1 and gender in (None, "n"):
        gender = _GENDER.get(names[0], gender)
    return [("surname" if i == len(names) - 1 else gender, n) for i, n in enumerate(names)]


def rendered(kind: str, text: str, made: list[str]) -> str:
    """The mention with its surrogate, in the mention's own format."""
    if kind == "person":
        return " ".join([*text.split(" ")[: -len(made)], *made])
    if kind in ("card", "phone", "iban"):
        new = iter(made[0])
        return "".join(next(new) if c.isascii() and (c.isdigit() or c.isupper()) else c for c in text)
    if kind == "email":
        if len(text) != len(made[0]):
            return made[0].upper() if text.isupper() else made[0]
        return "".join(m.upper() if c.isupper() else m for c, m in zip(text, made[0], strict=True))
    return made[0]


def replace(text: str, key: bytes, exceptions: dict[tuple[str, str], int]) -> tuple[str, int]:
    """The text with surrogates, and how many mentions it had."""
    if not MAYBE.search(text):
        return text, 0
    n = 0

    def one(m: re.Match) -> str:
        nonlocal n
        n += 1
        kind, found = m.lastgroup, m.group()
        return rendered(kind, found, [surrogate(k, e, key, exceptions.get((k, e), 0)) for k, e in pieces(kind, found)])

    return ENTITY.sub(one, text), n


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, attempt) of the entities whose first surrogate can't stand: it is another
    entity's surrogate, or an entity of the corpus itself. Such entities draw again until no
    surrogate is shared, so distinct entities stay distinct. Only names and e-mail addresses draw, and get
    longer as they do, so rounds end whatever their number; all others are distinct by construction."""
    entities = entities.where(F.col("kind").isin(*DRAWN))

    def run(batches):
        for batch in batches:
            made = [surrogate(k, e, key, a) for k, e, a in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.string())], ["kind", "entity", "attempt", "made"])

    now = entities.select("kind", "entity", F.lit(0).alias("attempt"))
    real = entities.select("kind", F.col("entity").alias("made"), F.lit(True).alias("real"))
    settled = None
    while True:
        drawn = now.mapInArrow(run, "kind string, entity string, attempt int, made string")
        taken = drawn.withColumn("settled", F.lit(False))
        if settled is not None:
            taken = taken.unionByName(settled.withColumn("settled", F.lit(True)))
        same = Window.partitionBy("kind", "made").orderBy(F.col("settled").desc(), "entity")
        judged = taken.withColumn("number", F.row_number().over(same)).join(real, ["kind", "made"], "left")
        judged = staged(judged.withColumn("again", (F.col("number") > 1) | F.col("real").isNotNull() & ~F.col("settled")), "surrogates")
        settled = judged.where("not again").select("kind", "entity", "attempt", "made")
        now = judged.where("again").select("kind", "entity", (F.col("attempt") + 1).alias("attempt"))
        if now.limit(1).count() == 0:
            return settled.where("attempt > 0").select("kind", "entity", "attempt")


def pseudonymise(docs: DataFrame, key: bytes | None = None, broadcast_rows: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text with surrogates, n_entities.

    E-mail and IP addresses, telephone, card, account and social security numbers, secrets, and names
    after a title or a common given name are replaced by a keyed function of the entity alone, so mentions of one entity agree
    across the corpus without a lookup. Whoever has ``key`` can find entities again by trying them; without
    one a random key is drawn for this call, so surrogates agree within it alone. Only entities whose surrogates collide need one: their
    attempts go with the rows that mention them, by broadcast up to ``broadcast_rows`` such rows and by
    an ordinary join beyond. Null texts are empty; repeated rows are each replaced; empty tables give
    an empty result.
    """
    small_batches(docs.sparkSession)
    key = secrets.token_bytes(32) if key is None else key
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(text_col).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))

    def mentions(batches):
        for batch in batches:
            out = [(r, k, e) for t, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if MAYBE.search(t) for k, e in sorted({p for m in ENTITY.finditer(t) for p in pieces(m.lastgroup, m.group())})]
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)], ["row", "kind", "entity"])

    found = staged(rows.select("text", "row").mapInArrow(mentions, "row long, kind string, entity string"), "mentions")
    again = assign(staged(found.select("kind", "entity").distinct(), "entities"), key)
    special = found.join(again, ["kind", "entity"]).groupBy("row").agg(F.collect_set(F.struct("kind", "entity", "attempt")).alias("special"))
    special = staged(special, "special")
    if special.limit(broadcast_rows + 1).count() <= broadcast_rows:
        special = F.broadcast(special)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                made = [replace(t, key, {(s["kind"], s["entity"]): s["attempt"] for s in x or ()}) for t, x in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int32())], ["doc_id", "text", "n_entities"])

    return rows.join(special, "row", "left").select("doc_id", "text", "special").mapInArrow(run, "doc_id long, text string, n_entities int")
