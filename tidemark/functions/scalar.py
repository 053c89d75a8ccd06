"""Scalar expressions over recipe fields: reference tokens, times, units systems, hashes, retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A reference token in a direction: {{ingredient id|what to show}}.
TOKEN = r"\{\{([^|]+)\|([^}]+)\}\}"


def build_token(ing_id: Column, shown: Column) -> Column:
    return F.concat(F.lit("{{"), ing_id, F.lit("|"), shown, F.lit("}}"))


def token_ids(text: Column) -> Column:
    """The ids of all tokens in order, repeats included."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def strip_tokens(text: Column) -> Column:
    """Every token replaced by what it shows."""
    return F.regexp_replace(text, TOKEN, "$2")


def dangling_tokens(text: Column, known: Column) -> Column:
    """Ids that a text refers to but the recipe does not have."""
    return F.array_except(token_ids(text), known)


def embedding_input(title: Column, shown: Column) -> Column:
    """What is embedded of a recipe: the title, a line end, the ingredient strings; outer whitespace off."""
    return F.regexp_replace(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.array_join(shown, " ")), r"(?U)^\s+|\s+$", "")


def total_time(prep: Column, cook: Column) -> Column:
    """'n mins' from the first whole number of each time when both are given; '' when that is 0 or one is missing."""
    first = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")).try_cast("decimal(37,0)"), F.lit(0))
    total = first(prep) + first(cook)
    given = (F.coalesce(prep, F.lit("")) != "") & (F.coalesce(cook, F.lit("")) != "")
    return F.when(given & (total > 0), F.concat(total.cast("string"), F.lit(" mins"))).otherwise("")


def unit_system(flag: Column) -> Column:
    """Command line units to a unit system; anything unknown is US."""
    return F.when(F.lower(flag) == "metric", "Metric").when(F.lower(flag) == "imperial", "Imperial").otherwise("US")


def units_key(system: Column) -> Column:
    """A unit system to the key of its rules; anything unknown is book."""
    return F.when(system == "US", "us").when(system == "Metric", "metric").when(system == "Imperial", "imperial").otherwise("book")


def content_hash(content: Column) -> Column:
    """'sha256:' and the SHA-256 of the first 65,536 bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(F.substring(content.cast("binary"), 1, 65_536), 256))


def file_id(content: Column) -> Column:
    """The first 16 digits of the content hash."""
    return F.substring(content_hash(content), 8, 16)


def stable_uid(*keys: Column) -> Column:
    """An upper-case UUID-shaped id that depends on its keys only."""
    h = F.upper(F.md5(F.concat_ws("\x1f", *keys)))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def backoff_delays(retries: int = 5, first: int = 2, most: int = 120) -> Column:
    """Seconds to wait before each retry: doubling from ``first``, at most ``most``."""
    return F.transform(F.sequence(F.lit(1), F.lit(retries)), lambda k: F.least(F.lit(first) * F.power(F.lit(2), k - 1), F.lit(most)).cast("int"))


def strip_fence(text: Column) -> Column:
    """JSON without a surrounding code fence."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^```\w*\s*", ""), r"\s*```$", "")


def run_limits(free: Column, workers: Column) -> Column:
    """(requests a minute or null, workers): the free tier allows 5 and 1, else 1 to 10 workers."""
    return F.when(free, F.struct(F.lit(5).alias("rpm"), F.lit(1).alias("workers"))).otherwise(
        F.struct(F.lit(None).cast("int").alias("rpm"), F.greatest(F.lit(1), F.least(F.lit(10), workers)).alias("workers"))
    )


def first_given(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def image_extension(mime: Column) -> Column:
    """The file extension of a MIME type: what follows its last slash, up to a semicolon; jpg without one."""
    return F.when(mime.contains("/"), F.trim(F.substring_index(F.substring_index(mime, ";", 1), "/", -1))).otherwise("jpg")


def is_rate_limit_error(message: Column) -> Column:
    return F.lower(message).rlike("429|quota|resource_exhausted")
