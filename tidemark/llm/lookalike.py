"""Visually identical text with different characters, brought to one consistent form.

Three steps per text: characters that cannot be seen are deleted; compatibility forms, odd blanks and
decomposed accents are replaced by the ordinary character; in words that mix scripts every letter
becomes a small lattice of look-alikes, and a Viterbi search picks, script by script, the spelling with
the best character bigram score. The bigrams are counted over all unmixed words of the data.

Left alone as ordinary: precomposed accented letters, words wholly in one script, tabs, line ends,
dashes, bullets, quotes, fractions, joiners inside Arabic or Indic words and emoji, and full-width
punctuation or blanks between East Asian characters.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that look like the Latin letter below them, pair by pair.
CYRILLIC = "авсԁеһіјкӏмоԛрѕтԝхуАВСЕНІЈКМОРԚЅТԜХУѵѴԌԍ"
CYR_LATIN = "abcdehijklmoqpstwxyABCEHIJKMOPQSTWXYvVGg"
GREEK = "αβγικνορτυχωϲϳηΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ"
GRK_LATIN = "abyikvoptuxwcjnABEZHIKMNOPTYXCJ"
ARMENIAN = "աճհյոսցօՍՏՕ"
ARM_LATIN = "wghjnugoUSO"
CHEROKEE = "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏔᏙᏞᏟᏢᏦᏴ"
CHR_LATIN = "DRTAJEWMHGZWVLCPKB"
COPTIC = "ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲥⲣ"
COP_LATIN = "HIKMNOPCTYXocp"
LISU = "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"
LIS_LATIN = "BPDTGKJCZFMNLSRVHWXYAEIOU"
#: Signs that stand for an ordinary one without a compatibility mapping of their own.
SIGNS = {"⁄": "/", "∕": "/", "․": ".", "∶": ":", "꞉": ":", "∗": "*"}

_TO_LATIN: dict[str, set[str]] = {}
for _theirs, _ours in ((CYRILLIC, CYR_LATIN), (GREEK, GRK_LATIN), (ARMENIAN, ARM_LATIN), (CHEROKEE, CHR_LATIN), (COPTIC, COP_LATIN), (LISU, LIS_LATIN)):
    for _a, _b in zip(_theirs, _ours, strict=True):
        _TO_LATIN.setdefault(_a, set()).add(_b)
_FROM_LATIN: dict[str, set[str]] = {}
for _a, _bs in _TO_LATIN.items():
    for _b in _bs:
        _FROM_LATIN.setdefault(_b, set()).add(_a)

ALPHABETS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN")
_MIXABLE = {*ALPHABETS, "COPTIC", "CHEROKEE", "LISU"}
_EAST_ASIAN = {"CJK", "HIRAGANA", "KATAKANA", "HANGUL", "BOPOMOFO", "KATAKANA-HIRAGANA", "IDEOGRAPHIC"}
_JOINING = {
    "ARABIC", "SYRIAC", "MONGOLIAN", "DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU",
    "KANNADA", "MALAYALAM", "SINHALA", "KHMER", "MYANMAR", "THAI", "LAO", "TIBETAN",
}
#: Beyond format characters: fillers, the blank braille cell, the grapheme joiner, variation selectors.
_UNSEEN = re.compile("[͏ᅟᅠ឴឵᠋-᠎⠀ㅤﾠ︀-️\U000e0100-\U000e01ef]")
_REPLACED = ("<wide>", "<narrow>", "<font>", "<small>")
_WORD = re.compile(r"[^\W\d_]+")
#: Texts of these characters only need no look at all.
PLAIN = r"^[\x09\x0a\x0d\x20-\x7e]*$"


@lru_cache(maxsize=65536)
def script(ch: str) -> str:
    return unicodedata.name(ch, "?").split(" ")[0]


@lru_cache(maxsize=65536)
def _substitute(ch: str) -> str | None:
    """The ordinary form of a character that merely stands for it; None for ordinary characters."""
    if ch in SIGNS:
        return SIGNS[ch]
    category, kind = unicodedata.category(ch), unicodedata.decomposition(ch)
    if category == "Zs":
        return None if ch == " " else " "
    if kind.startswith(_REPLACED) or ch == " ":
        return unicodedata.normalize("NFKC", ch)
    if kind.startswith("<compat>") and category[0] in "LN":
        other = unicodedata.normalize("NFKC", ch)  # ligatures, long s, roman numerals
        return other if other.isalpha() and all(script(c) == "LATIN" for c in other) else None
    if kind and kind[0] != "<" and " " not in kind:
        return unicodedata.normalize("NFC", ch)  # singletons such as the Kelvin sign
    return None


def _unseen(text: str, i: int) -> bool:
    ch = text[i]
    category = unicodedata.category(ch)
    if category == "Cc":
        return ch not in "\t\n\r\x0b\x0c\x85"
    before = text[i - 1] if i else ""
    if category == "Cf":
        if ch in "‌‍" and before:
            if script(before) in _JOINING or (ch == "‍" and unicodedata.category(before) in ("So", "Sk", "Mn")):
                return False
        return script(ch) != "ARABIC"
    if _UNSEEN.match(ch):
        return not (before and unicodedata.category(before) in ("So", "Sk", "Sm", "Po", "Nd", "Pd") and "︀" <= ch <= "️")
    return False


def _near_east_asian(text: str, i: int) -> bool:
    """Whether the nearest letters on both sides (on the one side that has any) are East Asian."""
    sides = []
    for step in (-1, 1):
        j = i + step
        while 0 <= j < len(text) and not text[j].isalnum():
            j += step
        if 0 <= j < len(text):
            sides.append(script(text[j]) in _EAST_ASIAN)
    return bool(sides) and all(sides)


class Speller:
    """Viterbi over look-alike lattices under character bigram scores of each script."""

    def __init__(self, bigrams: dict[str, int], change: float = 1.0):
        self.change = change
        self.total: dict[str, int] = {}
        self.first: dict[str, int] = {}
        self.pairs = bigrams
        for pair, n in bigrams.items():
            self.first[pair[0]] = self.first.get(pair[0], 0) + n
            if pair[1] != "$":
                s = script(pair[1])
                self.total[s] = self.total.get(s, 0) + n

    def _score(self, a: str, b: str) -> float:
        return math.log((self.pairs.get(a + b, 0) + 0.1) / (self.first.get(a, 0) + 10.0))

    def best(self, word: str) -> str:
        """The best spelling in one script; the word itself where no script can spell it."""
        found: tuple[float, str] | None = None
        for name in ALPHABETS:
            paths: dict[str, tuple[float, str]] = {"^": (0.0, "")}
            for ch in word:
                own = script(ch)
                if own == name or unicodedata.category(ch)[0] == "M":
                    options = {ch}
                elif name == "LATIN":
                    options = _TO_LATIN.get(ch, set())
                else:
                    base = {ch} if own == "LATIN" else _TO_LATIN.get(ch, set())
                    options = {x for b in base for x in _FROM_LATIN.get(b, ()) if script(x) == name}
                step: dict[str, tuple[float, str]] = {}
                for option in options:
                    low, cost = option.lower(), 0.0 if option == ch else self.change
                    for last, (s, text) in paths.items():
                        new = s + self._score(last, low[0]) - cost
                        if low not in step or new > step[low][0]:
                            step[low] = (new, text + option)
                paths = step
                if not paths:
                    break
            for last, (s, text) in paths.items():
                total = s + self._score(last, "$") + 0.01 * math.log1p(self.total.get(name, 0))
                if found is None or total > found[0]:
                    found = (total, text)
        return found[1] if found else word


def normalise(text: str, speller: Speller) -> tuple[str, bool]:
    """(consistent form, whether any character had to go or change)."""
    out, changed = [], False
    for i, ch in enumerate(text):
        if ch < "\x7f" and ch >= " " or ch in "\t\n\r":
            out.append(ch)
        elif _unseen(text, i):
            changed = True
        else:
            other = _substitute(ch)
            if other is not None and (ch == "　" or unicodedata.category(ch)[0] in "PS") and _near_east_asian(text, i):
                other = None
            if other is None:
                out.append(ch)
            else:
                out.append(other)
                changed = True
    text = "".join(out)
    composed = unicodedata.normalize("NFC", text)
    if len(composed) < len(text):
        changed = True
    text = composed
    if text.isascii():
        return text, changed

    def word(m: re.Match) -> str:
        nonlocal changed
        w = m.group()
        scripts = {script(c) for c in w} & _MIXABLE
        if len(scripts) < 2:
            return w
        # only what the search spells otherwise stands for another letter
        best = speller.best(w)
        changed = changed or best != w
        return best

    return _WORD.sub(word, text), changed


def letter_bigrams(texts: DataFrame, column: str) -> dict[str, int]:
    """Counts of adjacent letters ('^' before, '$' after) over all words of one script in ``column``.

    Words are counted first, pairs from distinct words, both combined on the map side. What comes
    to the driver is bounded by the square of three alphabets, not by the data.
    """
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(column), F.lit(r"[\p{L}\p{M}]+"), F.lit(0))).alias("w"))
    clean = words.where(F.col("w").rlike(r"^(\p{IsLatin}+|\p{IsCyrillic}+|\p{IsGreek}+|\p{IsArmenian}+)$"))
    counted = clean.groupBy("w").count().select(F.concat(F.lit("^"), "w", F.lit("$")).alias("w"), "count")
    pairs = counted.select(
        F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.col("w").substr(i, F.lit(2)))).alias("p"), "count"
    )
    return {r["p"]: r["n"] for r in pairs.groupBy("p").agg(F.sum("count").alias("n")).collect()}


def unify(texts: DataFrame, column: str, bigrams: dict[str, int]) -> DataFrame:
    """``texts`` with ``form`` (the consistent form of ``column``) and ``odd`` (whether it differs in kind).

    Only texts with a character outside plain ASCII reach Python; null stays null and is not odd.
    ``column`` must be named 'text' and the others must be a leading id, field and pos.
    """
    plain = texts.where(F.coalesce(F.col(column).rlike(PLAIN), F.lit(True))).select(
        "id", "field", "pos", F.col(column).alias("form"), F.lit(False).alias("odd")
    )
    other = texts.where(~F.col(column).rlike(PLAIN)).select("id", "field", "pos", F.col(column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(bigrams)
        for batch in batches:
            done = [normalise(t, speller) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.bool_())],
                ["id", "field", "pos", "form", "odd"],
            )

    return plain.unionByName(other.mapInArrow(run, "id long, field string, pos int, form string, odd boolean"))


def record_texts(records: DataFrame, id_col: str, name_col: str, lines_col: str) -> DataFrame:
    """(id, field, pos, text): the name at pos 0 and each line from pos 1; null texts and ids are left out."""
    base = records.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        F.concat(F.array(F.col(name_col)), F.coalesce(F.col(lines_col), F.array().cast("array<string>"))).alias("texts"),
    )
    return base.select("id", F.posexplode("texts").alias("pos", "text")).where(F.col("text").isNotNull()).select(
        "id", F.when(F.col("pos") == 0, "name").otherwise("ingredients").alias("field"), "pos", "text"
    )
