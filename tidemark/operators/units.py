"""Quantities in many units brought to milligrams and microlitres.

A small grammar reads numbers (decimals with point or comma, fractions, mixed numbers, number words)
and units in many spellings, from a unit field or from free text. What a row counts as is decided by
what is written: no unit is ever inferred, and ranges, counts and containers give no quantity.
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

# The spellings of each unit code, in lower case without dots; t and T are told apart below.
SPELLINGS = {
    "mg": "mg mgs milligram milligrams milligramme milligrammes milligramm miligramo miligramos milligrammo milligrammi",
    "g": "g gr grs gm gms gram grams gramme grammes gramm gramo gramos grammo grammi",
    "kg": "kg kgs kilo kilos kilogram kilograms kilogramme kilogrammes kilogramm kilogramo kilogramos chilogrammo",
    "oz": "oz ozs ounce ounces once onces onza onzas unze unzen oncia",
    "lb": "lb lbs pound pounds livre livres libra libras",
    "ml": "ml mls milliliter milliliters millilitre millilitres mililitro mililitros millilitri cc",
    "cl": "cl cls centiliter centiliters centilitre centilitres zentiliter centilitro centilitros",
    "dl": "dl dls deciliter deciliters decilitre decilitres deziliter decilitro decilitros",
    "l": "l lt ltr ltrs liter liters litre litres litro litros litri",
    "tsp": "tsp tsps teaspoon teaspoons teaspoonful teaspoonfuls tl teelöffel cdta cdtas cdita cditas cucharadita cucharaditas;c à c;c à café;c à thé;càc;cuillère à café;cuillères à café;cuillerée à café;cuillerées à café",
    "tbsp": "tbsp tbsps tbs tbl tbls tblsp tablespoon tablespoons tablespoonful tablespoonfuls el esslöffel eßlöffel cda cdas cucharada cucharadas;c à s;c à soupe;càs;cuillère à soupe;cuillères à soupe;cuillerée à soupe;cuillerées à soupe",
    "fl_oz": "floz;fl oz;fl ozs;fl ounce;fl ounces;fluid ounce;fluid ounces;fluid oz;fluidounce;fluidounces",
    "cup": "c cup cups cupful cupfuls cupsful tasse tassen tasses taza tazas",
    "pint": "pt pts pint pints pinta pintas",
    "quart": "qt qts quart quarts",
}
UNITS = {
    spelling: code
    for code, line in SPELLINGS.items()
    for part, text in enumerate(line.split(";"))
    for spelling in (text.split(" ") if part == 0 and code != "fl_oz" else [text])
}
UNITS |= {"t": "tsp", "T": "tbsp"}

# Number words.
NUMBER_WORDS = {
    "a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8,
    "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
}
_VULGAR = "½⅓⅔¼¾⅕⅖⅗⅘⅙⅚⅐⅛⅜⅝⅞⅑⅒"


def _unit_pattern() -> str:
    found = []
    for spelling in sorted(UNITS, key=len, reverse=True):
        if spelling in ("t", "T"):
            continue
        words = [re.escape(w) + r"\.?" for w in spelling.split(" ")]
        found.append(r"\s*".join(words) if len(words) > 1 else words[0])
    return rf"(?:(?i:{'|'.join(found)})|[tT]\.?)(?![^\W_])"


_UNIT = _unit_pattern()
_WORDS = rf"(?i:half(?:\s+an?)?|(?:an?\s+)?(?:quarter|third)(?:\s+of)?(?:\s+an?)?|three\s+quarters(?:\s+of)?(?:\s+an?)?|(?:{'|'.join(NUMBER_WORDS)})(?:\s+and\s+a\s+half)?)"
#: The mixed forms come first: the longest reading of a number wins.
_NUMBER = (
    rf"(?:\d+(?:\s+|\s*-\s*|\s+and\s+)\d+\s*[/⁄]\s*\d+(?!\d)|\d+\s+and\s+[{_VULGAR}]|\d+\s*-?\s*[{_VULGAR}]|[{_VULGAR}]"
    rf"|\d+\s*[/⁄]\s*\d+|[1-9]\d{{0,2}}(?:,\d{{3}})+(?:\.\d+)?(?!\d)|\d+[.,]\d+|\d+|(?<![^\W_]){_WORDS}(?![^\W_]))"
)
_RANGE = re.compile(rf"(?<![\w.,/])(?P<both>{_NUMBER}\s*(?:-|–|—|~|\bto\b|\bor\b|\bbis\b|\ba\b|\bà\b)\s*{_NUMBER})\s*{_UNIT}")
_WHOLE = re.compile(_NUMBER)
_CONTAINER = re.compile(rf"{_NUMBER}\s*(?:x\s*|×\s*)?\(\s*{_NUMBER}\s*-?\s*{_UNIT}\s*\)|\(\s*{_NUMBER}\s*-?\s*{_UNIT}\s+(?i:tins?|cans?|jars?|packets?|packs?|bottles?|cartons?|boxe?s?|bags?)\s*\)")
_QUANTITY = re.compile(
    rf"(?<![\w.,/%])(?:(?P<packs>{_NUMBER})\s*[x×*]\s*)?(?P<number>{_NUMBER})\s*-?\s*(?P<unit>{_UNIT})(?!\s*%)"
)
_LINK = re.compile(r"\s*(?:,|\+|&|(?i:plus|and))?\s*")
_FIELD = re.compile(rf"\s*(?:[x×*]\s*)?(?P<number>{_NUMBER})?\s*-?\s*(?P<unit>{_UNIT})\.?\s*")


@lru_cache(maxsize=200_000)
def read_number(text: str) -> float:
    """The value of a number as the grammar accepts it."""
    t = re.sub(r"\s+", " ", text.strip().lower()).replace("⁄", "/")
    if t[0].isalpha():
        if t.startswith("half"):
            return 0.5
        if t.startswith("three quarters"):
            return 0.75
        if "quarter" in t:
            return 0.25
        if "third" in t:
            return 1 / 3
        return NUMBER_WORDS[t.split(" ")[0]] + (0.5 if t.endswith("half") else 0.0)
    total = 0.0
    for ch in _VULGAR:
        if ch in t:
            total += unicodedata.numeric(ch)
            t = t.replace(ch, "")
    t = t.replace("and", " ")
    if m := re.search(r"(\d+) ?/ ?(\d+)\s*$", t):
        if int(m[2]) == 0:
            return math.nan
        total += int(m[1]) / int(m[2])
        t = t[: m.start()]
    t = t.strip(" -")
    if not t:
        return total
    if re.fullmatch(r"[1-9]\d{0,2}(,\d{3})+(\.\d+)?", t):
        return total + float(t.replace(",", ""))
    return total + float(t.replace(",", "."))


@lru_cache(maxsize=50_000)
def unit_code(text: str) -> str | None:
    """The code of a spelled unit; None when it is none."""
    t = re.sub(r"\s+", " ", text.replace(".", " ")).strip()
    if t in ("t", "T"):
        return UNITS[t]
    return UNITS.get(t.lower())


@lru_cache(maxsize=50_000)
def read_unit_field(text: str) -> tuple[float | None, str] | None:
    """(number in the field or None, unit code); None when the field is not a plain unit."""
    m = _FIELD.fullmatch(text)
    if not m:
        return None
    code = unit_code(m["unit"])
    return (read_number(m["number"]) if m["number"] else None, code) if code else None


def read_text(text: str) -> list[tuple[float, float, str]] | None:
    """(packs, number, unit code) of the first quantity in a text and of the parts that follow it directly.

    None when the text holds no quantity with a unit, a range of quantities, or a container.
    """
    if _CONTAINER.search(text) or any(not _WHOLE.fullmatch(m["both"]) for m in _RANGE.finditer(text)):
        return None
    parts, end = [], None
    for m in _QUANTITY.finditer(text):
        if end is not None and not _LINK.fullmatch(text[end:m.start()]):
            break
        parts.append((read_number(m["packs"]) if m["packs"] else 1.0, read_number(m["number"]), unit_code(m["unit"])))
        end = m.end()
    return parts or None


class Converter:
    """Amounts to base units under a table of factors: code -> (kind, base unit, base units in one)."""

    def __init__(self, factors: dict[str, tuple[str, str, float]]):
        self.factors = factors

    def _result(self, number: float | None, code: str) -> tuple[str, int] | None:
        factor = self.factors.get(code)
        if factor is None or number is None or not math.isfinite(number) or number <= 0:
            return None
        return factor[1], math.floor(number * factor[2] + 0.5)

    def from_field(self, amount: float | None, unit: str) -> tuple[str, int] | None:
        """Base unit and quantity from an amount and a unit field only."""
        read = read_unit_field(unit)
        if read is None:
            return None
        number, code = read
        has = amount is not None and amount > 0
        if number is None:
            return self._result(amount, code) if has else None
        return self._result(number * amount if has else number, code)

    def from_row(self, amount: float | None, unit: str | None, text: str | None) -> tuple[str, int] | None:
        """Base unit and quantity of a row: what its fields lack comes from its text."""
        has = amount is not None and amount > 0
        if unit and unit.strip():
            read = read_unit_field(unit)
            if read is None:
                return None
            if has or read[0] is not None:
                return self.from_field(amount, unit)
            parts = read_text(text) if text else None
            return self._total(parts) if parts else None
        parts = read_text(text) if text else None
        if not parts:
            return None
        packs, number, code = parts[0]
        if not has or ((packs != 1 or len(parts) > 1) and (abs(amount - packs) < 1e-9 or abs(amount - number) < 1e-2)):
            return self._total(parts)
        return self._result(amount * number if packs != 1 else amount, code)

    def _total(self, parts: list[tuple[float, float, str]]) -> tuple[str, int] | None:
        first = self.factors.get(parts[0][2])
        if first is None:
            return None
        total = 0.0
        for packs, number, code in parts:
            factor = self.factors.get(code)
            if factor is None or factor[0] != first[0]:
                break
            total += packs * number * factor[2]
        return (first[1], math.floor(total + 0.5)) if math.isfinite(total) and total > 0 else None


def load_factors(factors: DataFrame, limit: int = 10_000) -> dict[str, tuple[str, str, float]]:
    """The factor table on the driver; a table of more than ``limit`` rows is refused."""
    rows = factors.select("code", "kind", "base_unit", "per_unit").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the table of unit factors has more than {limit} rows")
    return {r["code"]: (r["kind"], r["base_unit"], r["per_unit"]) for r in rows if r["code"] and r["per_unit"]}


def convert_quantities(df: DataFrame, factors: DataFrame) -> DataFrame:
    """(recipe_id, ing_id, measure, base_unit, qty) for both measures of every row that has a quantity.

    Needs recipe_id, ing_id, amount, unit, fallback_string, converted_amount, converted_unit; other
    columns are ignored. Nulls anywhere mean "not given"; NaN, infinite, zero and negative amounts are
    no amounts; a row delivered twice gives one result. One narrow pass, then a distinct.
    """
    table = load_factors(factors)
    rows = df.select(
        F.col("recipe_id").cast("string"), F.col("ing_id").cast("string"), F.col("amount").cast("double"),
        F.col("unit").cast("string"), F.col("fallback_string").cast("string"),
        F.col("converted_amount").cast("double"), F.col("converted_unit").cast("string"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        converter = Converter(table)
        for batch in batches:
            out: list[tuple] = []
            for recipe, ing, amount, unit, text, c_amount, c_unit in zip(*(c.to_pylist() for c in batch.columns)):
                if (got := converter.from_row(amount, unit, text)) is not None:
                    out.append((recipe, ing, "amount", *got))
                if c_unit and c_unit.strip() and (got := converter.from_field(c_amount, c_unit)) is not None:
                    out.append((recipe, ing, "converted", *got))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64() if i == 4 else pa.string()) for i, c in enumerate(zip(*out))],
                    ["recipe_id", "ing_id", "measure", "base_unit", "qty"],
                )

    return rows.mapInArrow(run, "recipe_id string, ing_id string, measure string, base_unit string, qty long").distinct()
