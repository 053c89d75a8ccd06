"""Mixing sources to target shares of tokens, by entropy balancing.

Each document gets a rate between 0 and its source's cap: the rates closest in entropy to using every
document alike that meet the token totals. They are an exponential tilt in the document's length, one
multiplier a source, found by Newton's method on the convex dual; every iteration is one distributed
aggregate. Rates are then rounded into whole copies so that each source's tokens stay on target.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

#: A public byte-level vocabulary as ranks, and the pattern that splits text before it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, id_col: str, text_col: str, source_col: str, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(id, source, tokens): one row per document; sources in lower case with underscores, null texts have 0 tokens."""
    rows = documents.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path, pattern)
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["id", "source", "tokens"])

    counted = rows.mapInArrow(run, "id long, source string, tokens long")
    return counted.groupBy("id").agg(F.min(F.struct("source", "tokens")).alias("r")).select(
        "id", normal_source(F.col("r.source")).alias("source"), F.col("r.tokens").alias("tokens")
    )


def normal_source(source):
    """Lower case, blanks and hyphens as underscores, outer blanks removed."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s\-]+", "_")


def load_targets(targets: DataFrame, limit: int = 10_000) -> dict[str, tuple[float, int]]:
    """source -> (share, cap) on the driver; more than ``limit`` sources are refused."""
    rows = targets.select(normal_source(F.col("source")).alias("source"), "target_share", "max_repeats").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} target sources")
    return {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in rows if r["source"] and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0}


class Mix:
    """rates(id, source, tokens, rate), uses(id, source, tokens, uses) and shares(source, ...)."""

    def __init__(self, rates: DataFrame, uses: DataFrame, shares: DataFrame, iterations: int):
        self.rates, self.uses, self.shares, self.iterations = rates, uses, shares, iterations


def solve_tilts(sizes: DataFrame, wanted: dict[str, float], caps: dict[str, int], means: dict[str, float], tolerance: float = 1e-6, limit: int = 60) -> tuple[dict[str, float], int]:
    """One multiplier a source such that its rates meet its tokens: (multipliers, iterations).

    ``sizes``: source, tokens, n. The dual is convex and its blocks are the sources, so the Newton
    step of each source needs two sums; a step out of the bracket known so far is replaced by its middle.
    """
    spark = sizes.sparkSession
    tilt = {s: 0.0 for s in wanted}
    low, high = {s: -math.inf for s in wanted}, {s: math.inf for s in wanted}
    open_ = set(wanted)
    done = 0
    while open_ and done < limit:
        done += 1
        table = spark.createDataFrame([(s, float(tilt[s]), float(caps[s]), float(means[s])) for s in open_], "source string, tilt double, cap double, mean double")
        with_rate = sizes.join(F.broadcast(table), "source").withColumn("rate", _rate())
        sums = with_rate.groupBy("source").agg(
            F.sum(F.col("n") * F.col("tokens") * F.col("rate")).alias("total"),
            F.sum(F.col("n") * F.col("tokens") * F.col("tokens") / F.col("mean") * F.col("rate") * (1 - F.col("rate") / F.col("cap"))).alias("slope"),
        ).collect()  # one row a source
        for r in sums:
            s, gap = r["source"], r["total"] - wanted[r["source"]]
            if abs(gap) <= tolerance * max(wanted[s], 1.0):
                open_.discard(s)
                continue
            if gap > 0:
                high[s] = tilt[s]
            else:
                low[s] = tilt[s]
            step = tilt[s] - gap / r["slope"] if r["slope"] > 1e-12 else math.nan
            if not low[s] < step < high[s]:
                step = tilt[s] + (4.0 if gap < 0 else -4.0) if math.isinf(low[s]) or math.isinf(high[s]) else (low[s] + high[s]) / 2
            if math.isclose(step, tilt[s], rel_tol=1e-14, abs_tol=1e-14):
                open_.discard(s)
            tilt[s] = step
    return tilt, done


def _rate():
    """cap / (1 + cap exp(-tilt length)): 1 in cap + 1 parts without a tilt, never above the cap."""
    return F.col("cap") / (1 + F.col("cap") * F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.col("tilt") * F.col("tokens") / F.col("mean")))))


def mix_sources(sized: DataFrame, targets: DataFrame, total: float | None = None, bucket: int = 5_000) -> Mix:
    """Rates, copies and shares for ``sized`` (id, source, tokens) under ``targets`` (source, target_share, max_repeats).

    Without ``total`` the mix is as large as the scarcest source allows. A target source without
    documents cannot be met: the others share its part in proportion and it is reported with 0.
    Documents of other or no sources, and those without tokens, are used 0 times.
    """
    goals = load_targets(targets)
    sized = cut(sized.select("id", "source", "tokens"))
    sizes = cut(sized.where("tokens > 0").groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")))
    have = {r["source"]: (r["total"], r["docs"]) for r in sizes.where(F.col("source").isin(list(goals))).groupBy("source").agg(F.sum(F.col("n") * F.col("tokens")).alias("total"), F.sum("n").alias("docs")).collect()}
    spark = sized.sparkSession
    share_of = sum(goals[s][0] for s in have) or 1.0
    room = min((goals[s][1] * have[s][0] * share_of / goals[s][0] for s in have), default=0.0)
    # the scarcest source would need rates at its cap, which no finite tilt reaches: it is set to its cap
    size = room if total is None else min(float(total), room)
    wanted = {s: size * goals[s][0] / share_of for s in have}
    full = {s for s in have if wanted[s] >= goals[s][1] * have[s][0] * (1 - 1e-9)}
    caps, means = {s: goals[s][1] for s in have}, {s: have[s][0] / have[s][1] for s in have}
    tilt, iterations = solve_tilts(sizes, {s: w for s, w in wanted.items() if s not in full}, caps, means)
    rows = [(s, float(tilt.get(s, 0.0)), float(caps[s]), float(means[s]), s in full) for s in have]
    table = F.broadcast(spark.createDataFrame(rows, "source string, tilt double, cap double, mean double, full boolean"))
    tilted = sizes.join(table, "source").withColumn("rate", F.when(F.col("full"), F.col("cap")).otherwise(_rate()))

    # systematic rounding along (source, tokens): extra copies of a length are those that fall in its stretch
    line = Window.partitionBy("source").orderBy("tokens")
    part = F.col("n") * (F.col("rate") - F.floor("rate"))
    reach = F.sum(part).over(line)
    lengths = tilted.select(
        "source", "tokens", "n", "rate", (F.floor(reach + 0.5 + 1e-9) - F.floor(reach - part + 0.5 + 1e-9)).alias("extra"), F.ceil(F.col("n") / bucket).alias("parts")
    )
    draw = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    docs = sized.join(lengths, ["source", "tokens"]).withColumn("draw", draw).withColumn("part", F.floor(F.col("draw") * F.col("parts")))
    before = docs.groupBy("source", "tokens", "part").agg(F.count(F.lit(1)).alias("here")).withColumn(
        "offset", F.sum("here").over(Window.partitionBy("source", "tokens").orderBy("part")) - F.col("here")
    ).select("source", "tokens", "part", "offset")
    place = F.row_number().over(Window.partitionBy("source", "tokens", "part").orderBy("draw", "id"))
    ranked = docs.withColumn("place", place).join(before, ["source", "tokens", "part"])
    picked = ranked.select("id", "rate", (F.floor("rate") + F.when(F.col("place") + F.col("offset") <= F.col("extra"), 1).otherwise(0)).cast("int").alias("uses"))
    rates = picked.select("id", "rate")
    uses = cut(sized.join(picked.select("id", "uses"), "id", "left").select("id", "source", "tokens", F.coalesce("uses", F.lit(0)).alias("uses")))

    used = uses.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.sum("tokens").alias("tokens"), F.max("uses").alias("most_uses"))
    asked = spark.createDataFrame([(s, g[0], g[1]) for s, g in goals.items()], "source string, target_share double, max_repeats int")
    report = asked.join(used, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce("most_uses", F.lit(0)).alias("most_uses")
    )
    shares = report.withColumn("actual_share", F.coalesce(F.col("used_tokens") / F.nullif(F.sum("used_tokens").over(Window.partitionBy()), F.lit(0)), F.lit(0.0)))
    return Mix(rates, uses, shares, iterations)
