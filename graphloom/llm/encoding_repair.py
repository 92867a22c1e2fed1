"""Text that was read in another character set than it was written in.

Round-trip repair: a word is encoded again in the character set it may have been read in and strictly decoded in the
one it may have been written in. The result is accepted if it lowers a garbling cost, and tried again for nested
layers. The cost knows no words: it counts what garbling leaves behind, such as symbols inside words, letters of two
scripts side by side, capitals after small letters, control characters and rows of accents.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from graphloom.llm.tokens import spread

# Letters of Portuguese, English, Spanish, German, French and Russian beyond ASCII.
LATIN_SMALL = frozenset("áàâãäåçéèêëíìîïñóòôõöøúùûüÿæœß")
LATIN_CAPITAL = frozenset("ÁÀÂÃÄÅÇÉÈÊËÍÌÎÏÑÓÒÔÕÖØÚÙÛÜŸÆŒ")
RUSSIAN_SMALL = frozenset("абвгдеёжзийклмнопрстуфхцчшщъыьэюя")
RUSSIAN_CAPITAL = frozenset("АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ")
RUSSIAN_VOWELS = frozenset("аеёиоуыэюяАЕЁИОУЫЭЮЯ")
# The frequency of Russian letters in per mille, rounded up.
RUSSIAN_PER_MILLE = {
    "о": 110, "е": 85, "а": 80, "и": 74, "н": 67, "т": 63, "с": 55, "р": 47, "в": 45, "л": 44, "к": 35, "м": 32, "д": 30, "п": 28, "у": 26, "я": 20, "ы": 19,
    "ь": 17, "г": 17, "з": 16, "б": 16, "ч": 14, "й": 12, "х": 10, "ж": 9, "ш": 7, "ю": 6, "ц": 5, "щ": 4, "э": 3, "ф": 3, "ё": 3, "ъ": 1,
}
# Signs that open, close or join words.
OPENING = frozenset("“‘«¡¿„‚‹")
CLOSING = frozenset("”’»…“‘›")
JOINING = frozenset("’–—‑")
QUIET = frozenset("°ºªµ")
PLAIN = frozenset("№€£§")
MARKS = frozenset("™®©")
# Signs of formulas and units.
FORMULA_SIGNS = "²³¹⁰⁴⁵⁶⁷⁸⁹ⁿ₀₁₂₃₄₅₆₇₈₉±×÷≤≥≠≈≡√∞∑∏∂∆∇∫µ·∙°′″‰−→←↔∈∉∪∩⊂½¼¾™®©"

# The character sets a text may have been read in while it was UTF-8.
UTF8_READ_AS = (
    "cp1252", "latin-1", "cp1251", "cp1250", "mac_roman", "cp437", "cp850", "gbk", "cp932", "iso8859-15", "iso8859-2", "cp1254",
    "cp852", "koi8-r", "cp866", "mac_cyrillic", "cp1257", "iso8859-5", "big5", "euc_kr", "cp1253", "cp949", "euc_jp",
)
# Fixed values: (read as, written in) for other mistakes.
OTHER_PAIRS = (
    ("latin-1", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1251", "cp1252"), ("cp1250", "cp1252"),
    ("koi8-r", "cp1252"), ("cp866", "cp1252"), ("cp852", "cp1252"), ("mac_cyrillic", "cp1252"), ("iso8859-2", "cp1252"), ("iso8859-5", "cp1252"),
    ("cp1252", "mac_roman"), ("latin-1", "mac_roman"), ("cp1252", "cp850"), ("latin-1", "cp850"), ("cp1252", "cp437"), ("latin-1", "cp437"),
    ("cp437", "mac_roman"), ("mac_roman", "cp850"),
    ("cp1252", "cp1251"), ("latin-1", "cp1251"), ("cp1252", "koi8-r"), ("latin-1", "koi8-r"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"),
    ("cp1251", "cp866"), ("cp866", "cp1251"), ("koi8-r", "cp866"), ("cp866", "koi8-r"), ("cp1252", "cp866"), ("latin-1", "cp866"),
    ("latin-1", "iso8859-5"), ("cp1251", "iso8859-5"), ("iso8859-5", "cp1251"), ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic"),
    ("mac_roman", "cp1251"), ("mac_roman", "koi8-r"), ("cp1250", "cp1251"), ("cp1250", "koi8-r"), ("cp437", "cp1251"), ("cp437", "koi8-r"), ("cp437", "cp866"),
    ("cp850", "cp1251"), ("cp850", "cp866"), ("gbk", "cp1251"), ("gbk", "koi8-r"), ("gbk", "cp1252"), ("cp932", "cp1251"), ("cp932", "cp1252"), ("big5", "cp1251"),
    ("cp1252", "cp1250"),
)
MULTI_BYTE = frozenset({"gbk", "cp932", "big5", "euc_kr", "cp949", "euc_jp"})

#: The least drop of the cost at which a word is taken for garbled: where the result is valid UTF-8, which seldom
#: happens by chance, and otherwise.
UTF8_DROP, OTHER_DROP = 0.3, 1.0
REPLACEMENT = "�"
#: Words a worker remembers the verdict of.
MEMO_WORDS = 200_000
#: Rows that are taken from a batch at once, and characters of results after which they are passed on.
ROWS_AT_ONCE, CHARS_AT_ONCE = 64, 4_000_000

#: Letters of other languages written in Latin letters: a text of theirs is as good as it is.
MORE_LATIN = re.compile("[\u0100-\u017f\u01a0\u01a1\u01af\u01b0\u0218-\u021b\u1e00-\u1effýÝ]")
#: A formula or a measure: letters, three in a row at most, with signs, Greek letters and at least one digit or operator; or letters related by signs.
FORMULA = re.compile(
    f"(?=.*[0-9²³¹⁰-⁹₀-₉+*/=^<>|√∑∏∂∆∇∫])(?:(?:[A-Za-z]{{1,3}}(?![A-Za-z]))|[0-9.,;:!?'\"()\\[\\]{{}}+*/=^<>|%_~-]|[{FORMULA_SIGNS}]|[\u0391-\u03c9])+"
    "|[(\\[]?[A-Za-z](?:[±×÷≤≥≠≈≡·−→←↔∈∉∪∩⊂][A-Za-z])+[)\\].,;:!?]*"
)

WORD = re.compile("[^ \\t\\r\\n<>]*[^\\x00-\\x7f][^ \\t\\r\\n<>]*")
RUN = re.compile("[^\\x00-\\x7f]+")
NOT_ASCII = "[^\\x00-\\x7f]"


_tables: dict[str, dict[int, int]] = {}


def _to_bytes(charset: str) -> dict[int, int]:
    """Character to byte of a single-byte set; bytes without a character stand for control characters, as browsers have it."""
    if charset in _tables:
        return _tables[charset]
    table = _tables[charset] = {}
    for b in range(0x80, 0x100):
        try:
            table[ord(bytes([b]).decode(charset))] = b
        except UnicodeDecodeError:
            table[b] = b
    return table


class _Kinds(dict):
    """What is known of each character met so far."""

    def __missing__(self, ch: str) -> tuple[str, str, float]:
        self[ch] = found = _kind_of(ch)
        return found


def _kind_of(ch: str) -> tuple[str, str, float]:
    """What a character is, its script if it is a letter, and its own cost."""
    o = ord(ch)
    if o < 0x80:
        if ch.isalpha():
            return ("small" if ch >= "a" else "capital"), "latin", 0.0
        return "other", "", 0.0
    if ch in LATIN_SMALL:
        return "small", "latin", 0.15
    if ch in LATIN_CAPITAL:
        return "capital", "latin", 0.25
    if ch in RUSSIAN_SMALL or ch in RUSSIAN_CAPITAL:
        rarity = 0.12 * math.log2(110 / RUSSIAN_PER_MILLE[ch.lower()])
        return ("small" if ch in RUSSIAN_SMALL else "capital"), "cyrillic", 0.1 + rarity
    if MORE_LATIN.match(ch):
        return ("capital" if ch.isupper() else "small"), "latin", 0.3
    if o < 0xA0:
        return "symbol", "", 3.0
    if ch == REPLACEMENT or 0xE000 <= o < 0xF900:
        return "symbol", "", 3.0
    if 0xFF61 <= o <= 0xFF9F:
        return "letter", "kana", 1.3
    if 0x3040 <= o < 0x3100:
        return "letter", "cjk", 0.5
    if 0x3400 <= o < 0xA000:
        return "letter", "cjk", 0.45
    if 0xAC00 <= o < 0xD7B0:
        return "letter", "cjk", 0.65
    if 0x3000 <= o < 0x3040 or 0xFF00 <= o < 0xFF61:
        return "wide", "", 0.2
    if 0x2500 <= o < 0x25A0:
        return "symbol", "", 1.6
    if o in (0x200B, 0x200C, 0x200D, 0xFE0F, 0xFEFF):
        return "other", "", 0.3
    if 0x1F000 <= o < 0x1FB00 or 0x2700 <= o < 0x27C0:
        return "other", "", 0.3
    category = unicodedata.category(ch)
    if category in ("Mn", "Me"):
        return "other", "", 0.25
    if category in ("Cn", "Cc", "Co", "Cs"):
        return "symbol", "", 3.0
    if ch == "ª" or ch == "º" or ch == "µ":
        return "symbol", "", 0.2
    if category[0] == "L":
        script = unicodedata.name(ch, "?").split(" ", 1)[0].lower()
        kind = "capital" if category == "Lu" else "small" if category == "Ll" else "letter"
        return kind, script, {"latin": 0.65, "greek": 0.65, "cyrillic": 0.85}.get(script, 1.2)
    return "symbol", "", 0.15 if ch in OPENING or ch in CLOSING or ch in JOINING or ch in QUIET or ch in PLAIN else 0.45


_kinds = _Kinds()


def _kind(ch: str) -> tuple[str, str, float]:
    return _kinds[ch]


def garbling_cost(word: str) -> float:
    """How much a word looks garbled: 0 for ASCII, about 0.15 a character for what is expected in the six languages."""
    if word.isascii():
        return 0.0
    kinds = [_kind(c) for c in word]
    total = 0.0
    last = len(word) - 1
    accents = ideographs = 0
    for at, (kind, script, own) in enumerate(kinds):
        ch = word[at]
        if kind == "other":
            total += own
            accents = 0
            continue
        before = kinds[at - 1] if at else ("other", "", 0.0)
        after = kinds[at + 1] if at < last else ("other", "", 0.0)
        total += own
        if script:
            if before[1] and before[1] != script:
                total += 1.0 if "cjk" in (script, before[1]) and "kana" not in (script, before[1]) else 1.5
            if kind == "capital" and before[0] == "small" and before[1] == script and ord(ch) > 0x7F:
                total += 1.0
            if kind == "small" and before[0] == "capital" and at > 1 and kinds[at - 2][0] == "capital" and script == before[1] and ord(ch) > 0x7F:
                total += 0.8
            if script == "latin" and ord(ch) > 0x7F:
                accents += 1
                if accents > 1 and not (accents == 2 and (word[at - 1] in "çÇ" or ch in "éÉ")):
                    total += 0.5
            else:
                accents = 0
            ideographs += script == "cjk"
        elif kind == "symbol":
            accents = 0
            if own < 3 and not (ch in QUIET and (at == 0 or word[at - 1].isascii())):
                left, right = bool(before[1]), bool(after[1])
                if left and right:
                    total += 0.0 if ch in "’" else 0.2 if ch in JOINING else 1.2
                elif left and ch not in CLOSING and ch not in JOINING and not (ch in MARKS and word[at - 1].isascii()):
                    total += 0.9
                elif right and ch not in OPENING and ch not in JOINING:
                    total += 0.7
                if before[0] == "symbol" and ch not in CLOSING and ch not in JOINING:
                    total += 0.3
    if 0 < ideographs <= 2 and not any(k[0] == "wide" for k in kinds):
        total += 0.5
    return total + _russian(word)


def _russian(word: str) -> float:
    """What is odd about the Russian letters of a word: their case, missing vowels, signs in wrong places."""
    total = 0.0
    for part in re.findall("[А-Яа-яЁё]+", word):
        n = len(part)
        capitals = sum(c in RUSSIAN_CAPITAL for c in part)
        if capitals < n:
            total += 0.3 * (capitals - (part[0] in RUSSIAN_CAPITAL))
        if n < 3:
            continue
        vowels = sum(c in RUSSIAN_VOWELS for c in part)
        if not 0.2 <= vowels / n <= 0.7:
            total += 1.5
        row, was = 0, None
        for at, c in enumerate(part):
            is_vowel = c in RUSSIAN_VOWELS
            sign = c in "ъьЪЬ"
            row = row + 1 if is_vowel == was else 1
            was = is_vowel
            if row > (3 if is_vowel else 4):
                total += 0.4
            if (sign or c in "ыЫ") and (at == 0 or part[at - 1] in RUSSIAN_VOWELS or part[at - 1] in "ъьЪЬ"):
                total += 0.8
            if c in "йЙ" and at and part[at - 1] not in RUSSIAN_VOWELS:
                total += 0.8
    return total


def _as_bytes(text: str, charset: str) -> bytes | None:
    """``text`` in ``charset``, strictly; ASCII stands for itself."""
    if charset in MULTI_BYTE:
        try:
            return text.encode(charset)
        except UnicodeEncodeError:
            return None
    table = _to_bytes(charset)
    try:
        return bytes(o if o < 0x80 else table[o] for o in map(ord, text))
    except KeyError:
        return None


def _read_again(word: str, read_as: str, written_in: str) -> str | None:
    """``word`` read in ``written_in``; of a word that doesn't go through as a whole, the parts beyond ASCII that do."""
    data = _as_bytes(word, read_as)
    if data is not None:
        try:
            return data.decode(written_in)
        except UnicodeDecodeError:
            pass
    if written_in != "utf-8" or read_as in MULTI_BYTE:
        return None
    changed = False

    def part(found: re.Match[str]) -> str:
        nonlocal changed
        data = _as_bytes(found[0], read_as)
        if data is None:
            return found[0]
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError:
            return found[0]
        changed = True
        return text

    out = RUN.sub(part, word)
    return out if changed else None


@dataclass(frozen=True)
class Repair:
    """A better reading of a word: what it was read as and written in, by layer from the outside, and the drop in cost."""

    layers: tuple[tuple[str, str], ...]
    text: str
    drop: float


def _looks_clean(word: str, cost: float) -> bool:
    """Whether the cost of a word is no more than that of its single characters, none of which is an ideograph or control."""
    return cost <= sum(_kind(c)[2] for c in word) + 1e-9 and not any("\x80" <= c <= "\x9f" or "\u3400" <= c < "\ud7b0" for c in word)


def candidates(word: str) -> tuple[Repair, ...]:
    """The acceptable readings of a word, best first; nested layers are undone to any depth."""
    return _readings(word, True, {})


def _readings(word: str, others: bool, known: dict[tuple[str, bool], tuple[Repair, ...]]) -> tuple[Repair, ...]:
    """``candidates``; without ``others`` only text that was UTF-8 is looked for.

    Undoing UTF-8 makes a text shorter and other mistakes nest once, so this ends; ``known`` keeps what several ways lead to.
    """
    if (word, others) in known:
        return known[word, others]
    key = word, others
    cost = garbling_cost(word)
    if _looks_clean(word, cost):
        return ()
    others = others and not FORMULA.fullmatch(word)
    wide = any(c >= "\u2e80" for c in word)
    found: dict[str, Repair] = {}
    tried = [([(x, "utf-8") for x in UTF8_READ_AS], UTF8_DROP), (OTHER_PAIRS, OTHER_DROP)]
    for pairs, least in tried[: 2 if others else 1]:
        for read_as, written_in in pairs:
            if read_as in MULTI_BYTE and not wide:
                continue
            text = _read_again(word, read_as, written_in)
            if text is None or text == word or text.isascii():
                continue
            drop = cost - garbling_cost(text)
            layers = ((read_as, written_in),)
            # two swaps of single bytes are as good as one, and a layer that isn't enough by itself proves nothing: only UTF-8 is tried below
            utf8, enough = written_in == "utf-8", drop >= least
            nests = len(text) < len(word) if utf8 else enough and not found
            if nests and (deeper := _readings(text, others and utf8 and enough, known)):
                layers, text, drop = layers + deeper[0].layers, deeper[0].text, drop + deeper[0].drop
            if drop >= least and (text not in found or found[text].drop < drop - 1e-9):
                found[text] = Repair(layers, text, drop)
    known[key] = tuple(sorted(found.values(), key=lambda r: (-round(r.drop, 6), len(r.layers))))
    return known[key]


class Repairer:
    """Finds and repairs garbled words, remembering its verdicts."""

    def __init__(self) -> None:
        self.memo: dict[str, tuple[Repair, ...]] = {}

    def of(self, word: str) -> tuple[Repair, ...]:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            found = self.memo[word] = candidates(word)
        return found

    def garbled_words(self, text: str) -> dict[str, tuple[Repair, ...]]:
        """The words of a text that are garbled, with their readings; none for a word whose original is lost."""
        memo, out = self.memo, {}
        for word in set(WORD.findall(text)):
            found = memo.get(word)
            if found is None:
                found = self.of(word)
            if found or REPLACEMENT in word:
                out[word] = found
        return out

    def repair(self, text: str) -> tuple[str, str, int, int] | None:
        """(repaired text, character sets, garbled words, words lost) or None if nothing is garbled.

        The character sets that explain most of a text are preferred for its words, and are then tried on the words
        that alone gave too little evidence.
        """
        garbled = self.garbled_words(text)
        if not garbled:
            return None
        votes: dict[tuple[tuple[str, str], ...], float] = {}
        for readings in garbled.values():
            for r in readings:
                votes[r.layers] = votes.get(r.layers, 0.0) + r.drop
        main = max(votes, key=lambda k: (votes[k], -len(k)), default=None)
        put: dict[str, str] = {}
        for word in set(WORD.findall(text)):
            readings = garbled.get(word, ())
            if readings:
                put[word] = next((r.text for r in readings if r.layers == main and r.drop >= readings[0].drop - 0.5), readings[0].text)
            elif main is not None and REPLACEMENT not in word:
                again: str | None = word
                for read_as, written_in in main:
                    again = again and _read_again(again, read_as, written_in)
                if again and garbling_cost(again) < garbling_cost(word):
                    put[word] = again
        whole = WORD.sub(lambda m: put.get(m[0], m[0]), text)
        names = " ".join(f"{a}>{b}" for a, b in main) if main else ""
        return whole, names, len(garbled), sum(REPLACEMENT in w for w in garbled)


def _repair_rows(df: DataFrame, item: str, text: str, schema, row) -> DataFrame:
    suspects = df.where(F.col(text).rlike(NOT_ASCII)).select(F.col(item).alias("id"), F.col(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer()
        for batch in batches:
            rows, held = [], 0
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for made in row(repairer, i, t):
                        rows.append(made)
                        held += len(t)
                    if held >= CHARS_AT_ONCE:
                        yield _batch(rows, arrow)
                        rows, held = [], 0
            if rows:
                yield _batch(rows, arrow)

    arrow = to_arrow_schema(schema)
    return spread(suspects).mapInArrow(work, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def find_garbled(df: DataFrame, item: str, text: str) -> DataFrame:
    """The ``item`` of each text with at least one garbled word, as ``repair_texts`` finds them. One pass; only a text
    table in fewer partitions than there are cores is spread over them first."""
    schema = df.select(item).schema
    return _repair_rows(df, item, text, schema, lambda r, i, t: [(i,)] if r.garbled_words(t) else [])


def repair_texts(df: DataFrame, item: str, text: str) -> DataFrame:
    """Each garbled text, restored where possible.

    Result: ``item``, ``charsets`` ("read as>written in" of the main mistake, a layer after the other; empty if all
    is lost), ``n_words INT`` (distinct garbled words), ``n_lost INT`` (those holding the replacement character, whose
    original is gone) and ``repaired``, the whole text. Null and empty texts and those of ASCII alone are never
    garbled; texts of any length are read whole; repeated rows come out as often as they occur; an empty table gives
    an empty result. Other columns are ignored. Text of other languages, formulas and measures are left as they are: a
    mistake that turns letters of one Latin alphabet into those of another is only seen where it leaves signs or capitals
    inside words. One pass; only a text table in fewer partitions than there are cores is spread over them first.
    """
    schema = df.select(item).schema.add("charsets", "string").add("n_words", "integer").add("n_lost", "integer").add("repaired", "string")

    def row(repairer: Repairer, i: object, t: str) -> list[tuple]:
        found = repairer.repair(t)
        return [(i, found[1], found[2], found[3], found[0])] if found else []

    out = _repair_rows(df, item, text, schema, row)
    return out.select(item, "charsets", "n_words", "n_lost", "repaired")
