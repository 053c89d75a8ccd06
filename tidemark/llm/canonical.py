"""Duplicates hidden by formatting: canonical text, a 128-bit fingerprint, counts by fingerprint.

Two texts agree if their letters and digits agree in order whatever their case. Other characters do
not count, except what stands between two digits (a run of whitespace there is one blank). Accents
count, composed or not. Lines without letters or digits do not count; the order of lines neither.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tidemark.session import cut

_LOOSE_MARK = r"[\p{Mn}\p{Mc}]"
_OTHER = r"[^\p{L}\p{N}\p{Mn}\p{Mc}]"
#: A run of other characters goes unless it has a digit on both sides.
_DROPPED = rf"(?<=^|[\p{{L}}\p{{Mn}}\p{{Mc}}]){_OTHER}+|{_OTHER}+(?=\z|[\p{{L}}\p{{Mn}}\p{{Mc}}])"
#: Variation selectors and the grapheme joiner are marks by category, but have no shape.
_SHAPELESS = r"[\uFE00-\uFE0F\u034F]"


@F.pandas_udf(ArrayType(StringType()))
def _compose(lines: pd.Series) -> pd.Series:
    return lines.map(
        lambda a: None if a is None else [None if t is None else unicodedata.normalize("NFC", t) for t in a]
    )


def _composed(lines: Column) -> Column:
    """``lines`` with combining marks composed; only rows that have any pass through Python."""
    marked = F.exists(lines, lambda t: F.coalesce(t.rlike(_LOOSE_MARK), F.lit(False)))
    return F.coalesce(_compose(F.when(marked, lines)), lines)


def _fold_case(text: Column) -> Column:
    """Full case folding: upper case first turns sharp s into SS; dotless i is kept apart from i.

    The replacement between the two also keeps the optimizer from reducing lower(upper(x)) to lower(x).
    """
    upper = F.upper(F.replace(text, F.lit("\u0131"), F.lit("\ue131")))
    return F.lower(F.replace(upper, F.lit("\ue131"), F.lit("\u0131")))


def canonical_text(text: Column) -> Column:
    """The canonical form of one composed line or name; '' when it has no letter or digit."""
    bare = F.regexp_replace(F.regexp_replace(_fold_case(text), _SHAPELESS, ""), r"(?U)\s+", " ")
    return F.regexp_replace(bare, _DROPPED, "")


def fingerprint_records(records: DataFrame, id_col: str, name_col: str, lines_col: str) -> DataFrame:
    """(id, h1, h2): the 128-bit fingerprint and an independent 64-bit check of every usable record.

    Records with a null id, without a name that counts or without a line that counts are left out; a
    record that occurs several times under one id comes out once. Other columns are ignored.
    """
    fields = records.where(F.col(id_col).isNotNull() & F.col(name_col).isNotNull() & F.col(lines_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.concat(F.array(F.col(name_col)), F.col(lines_col)).alias("fields")
    )
    composed = fields.select("id", _composed(F.col("fields")).alias("fields"))
    keys = _once(composed, "id", F.transform("fields", canonical_text).alias("keys"))
    name = F.element_at("keys", 1)
    lines = F.array_sort(F.filter(F.slice("keys", 2, F.greatest(F.size("keys"), F.lit(1))), lambda k: k.isNotNull() & (k != "")))
    usable = _once(keys, "id", name.alias("name"), lines.alias("lines")).where((F.col("name") != "") & (F.size("lines") > 0))
    text = F.concat_ws("\n", F.array("name"), "lines")
    return usable.select("id", F.unhex(F.md5(text.cast("binary"))).alias("h1"), F.xxhash64(text).alias("h2"))


def _once(df: DataFrame, key: str, *columns: Column) -> DataFrame:
    """``df.select(key, *columns)`` whose columns are computed once a row: later filters and projections use
    the result of a generator, below which the optimizer can neither push nor repeat the expressions."""
    return df.select(key, F.inline(F.array(F.struct(*columns))))


def collapse(prints: DataFrame) -> DataFrame:
    """(h1, h2, keep_id, copies): one row per distinct record with its smallest id and number of ids.

    Grouping by the fingerprint and the check together is the collision check: two records that
    share 128 bits by accident but differ in the other 64 stay apart. Ids are made distinct first,
    and both steps combine on the map side, so a hot record costs one row per map task.
    """
    return prints.dropDuplicates(["id", "h1", "h2"]).groupBy("h1", "h2").agg(
        F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies")
    )


def find_copies(records: DataFrame, id_col: str, name_col: str, lines_col: str) -> DataFrame:
    """(keep_id, copy_id): every record that is not the smallest id of its group.

    The fingerprints (about 40 bytes a record) are cut once and read twice. The join's other side has
    one row per group with copies; a hot group skews only the record side, which adaptive
    execution splits.
    """
    prints = cut(fingerprint_records(records, id_col, name_col, lines_col))
    groups = collapse(prints).where("copies > 1").select("h1", "h2", "keep_id")
    return (
        prints.join(groups, ["h1", "h2"])
        .where(F.col("id") != F.col("keep_id"))
        .select("keep_id", F.col("id").alias("copy_id"))
        .distinct()
    )
