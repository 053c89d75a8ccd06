"""Control-plane analytics: request windows, error runs, state machines, job status, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The legal transitions, state by state.
TRANSITIONS = {
    ("idle", "start"): "running",
    ("running", "pause"): "pausing", ("running", "cancel"): "cancelling", ("running", "done"): "idle", ("running", "error"): "idle",
    ("pausing", "paused"): "paused", ("pausing", "cancel"): "cancelling", ("pausing", "error"): "idle",
    ("paused", "resume"): "resuming", ("paused", "cancel"): "cancelling",
    ("resuming", "running"): "running", ("resuming", "error"): "idle",
    ("cancelling", "done"): "idle", ("cancelling", "error"): "idle",
}


def request_window(starts: DataFrame, seconds: int = 60, limit: int = 60, stretch: int | None = None) -> DataFrame:
    """``starts`` (key, ts, id) with ``in_window``, the starts of the key in the last ``seconds`` with its own,
    and ``over``, whether they exceed ``limit``. A start exactly ``seconds`` old no longer counts.

    Each task sees one stretch of time of one key (``stretch`` seconds, 60 windows by default) and the
    starts of the last window before it, so a key of any size spreads over many tasks.
    """
    width, reach = (stretch or 60 * seconds) * 1_000_000, seconds * 1_000_000
    if width < reach:
        raise ValueError("a stretch must be at least as long as the window")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    placed = starts.withColumn("_at", at).withColumn("_own", F.floor(F.col("_at") / width))
    late = F.col("_at") > (F.col("_own") + 1) * width - reach
    spread = placed.withColumn("_part", F.explode(F.when(late, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    window = Window.partitionBy("key", "_part").orderBy("_at").rangeBetween(-(reach - 1), 0)
    counted = spread.withColumn("in_window", F.count(F.lit(1)).over(window)).where(F.col("_part") == F.col("_own"))
    return counted.withColumn("over", F.col("in_window") > limit).drop("_at", "_own", "_part")


def error_runs(events: DataFrame, pause_after: int = 3, stretch: int = 86_400) -> DataFrame:
    """``events`` (key, ts, id, is_error) with ``run``, errors in a row up to here, and ``pause`` from ``pause_after`` on.

    Runs are counted within stretches of ``stretch`` seconds of a key; what a stretch hands on to the next is
    summed over one row a stretch. A null is_error is no error.
    """
    part = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (stretch * 1_000_000))
    placed = events.withColumn("_part", part).withColumn("_error", F.coalesce("is_error", F.lit(False)))
    line = Window.partitionBy("key", "_part").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    marked = placed.withColumn("_island", F.sum(F.when(F.col("_error"), 0).otherwise(1)).over(line))
    island = Window.partitionBy("key", "_part", "_island").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    local = marked.withColumn("run", F.sum(F.col("_error").cast("long")).over(island))

    ends = placed.groupBy("key", "_part").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(~F.col("_error"), F.struct("ts", "id"))).alias("last"),
    )
    after = placed.join(ends.select(F.col("key").alias("k"), F.col("_part").alias("p"), "last"), F.col("key").eqNullSafe(F.col("k")) & (F.col("_part") == F.col("p"))).where(
        F.col("last").isNotNull() & (F.struct("ts", "id") > F.col("last"))
    ).groupBy("key", "_part").agg(F.count(F.lit(1)).alias("tail"))
    handed = ends.join(after.select(F.col("key").alias("k"), F.col("_part").alias("p"), "tail"), F.col("key").eqNullSafe(F.col("k")) & (F.col("_part") == F.col("p")), "left").select(
        "key", "_part", F.col("last").isNotNull().alias("broken"), F.when(F.col("last").isNull(), F.col("n")).otherwise(F.coalesce("tail", F.lit(0))).alias("out")
    )
    parts = Window.partitionBy("key").orderBy("_part")
    grouped = handed.withColumn("_g", F.sum(F.col("broken").cast("int")).over(parts.rowsBetween(Window.unboundedPreceding, 0)))
    carried = grouped.withColumn("_sum", F.sum("out").over(Window.partitionBy("key", "_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)))
    carry = carried.select(F.col("key").alias("k"), F.col("_part").alias("p"), F.coalesce(F.lag("_sum").over(parts), F.lit(0)).alias("_carry"))
    joined = local.join(carry, F.col("key").eqNullSafe(F.col("k")) & (F.col("_part") == F.col("p"))).drop("k", "p")
    run = F.col("run") + F.when(F.col("_island") == 0, F.col("_carry")).otherwise(0)
    return joined.withColumn("run", run).withColumn("pause", F.col("run") >= pause_after).drop("_island", "_part", "_error", "_carry")


def next_state(state: Column, event: Column) -> Column:
    """The state after an event; an illegal event changes nothing."""
    out = state
    for (old, name), new in TRANSITIONS.items():
        out = F.when((state == old) & (event == name), new).otherwise(out)
    return out


def transition_map() -> Column:
    """'state/event' -> next state as a map literal."""
    return F.create_map(*(F.lit(x) for (old, name), new in TRANSITIONS.items() for x in (f"{old}/{name}", new)))


def compose_replay(events: DataFrame, stretch: int = 3_600) -> DataFrame:
    """(key, state, ignored): the state of every key after all its events (key, ts, id, event), and how many were illegal.

    A key's events are folded in stretches of ``stretch`` seconds: each stretch becomes a table from state
    before to (state after, ignored), and the tables are then chained. No task holds all events of a
    key, only its tables. A key starts idle.
    """
    states = sorted({old for old, _ in TRANSITIONS})
    part = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (stretch * 1_000_000))
    blocks = events.groupBy("key", part.alias("block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ts", "id", "event"))), lambda s: s["event"]).alias("events")
    )
    table = transition_map()
    kind = "struct<state:string,ignored:bigint>"

    def fold(initial: str) -> Column:
        def step(acc: Column, event: Column) -> Column:
            new = F.element_at(table, F.concat(acc["state"], F.lit("/"), event))
            return F.struct(F.coalesce(new, acc["state"]).alias("state"), (acc["ignored"] + F.when(new.isNull(), 1).otherwise(0)).alias("ignored")).cast(kind)

        return F.aggregate("events", F.struct(F.lit(initial).alias("state"), F.lit(0).cast("bigint").alias("ignored")).cast(kind), step)

    folded = blocks.select("key", "block", F.create_map(*(c for s in states for c in (F.lit(s), fold(s)))).alias("table"))

    def chain(acc: Column, entry: Column) -> Column:
        out = F.element_at(entry["table"], acc["state"])
        return F.struct(out["state"].alias("state"), (acc["ignored"] + out["ignored"]).alias("ignored")).cast(kind)

    return folded.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", F.map_entries("table").alias("entries")))).alias("chain")).select(
        "key", F.aggregate(F.transform("chain", lambda c: F.struct(F.map_from_entries(c["entries"]).alias("table"))),
                           F.struct(F.lit("idle").alias("state"), F.lit(0).cast("bigint").alias("ignored")).cast(kind), chain).alias("end"),
    ).select("key", F.col("end.state").alias("state"), F.col("end.ignored").alias("ignored"))


def job_status(events: DataFrame) -> DataFrame:
    """(job_id, status, updated_at): the latest event (job_id, ts, id, status) of every job."""
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "id")).alias("status"), F.max("ts").alias("updated_at"))


def fail_orphans(jobs: DataFrame, message: str = "orphaned") -> DataFrame:
    """Jobs still pending or running become errors with a message."""
    stuck = F.col("status").isin("pending", "running")
    return jobs.withColumn("error_message", F.when(stuck, F.lit(message))).withColumn("status", F.when(stuck, "error").otherwise(F.col("status")))


def resume(chunks: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """The chunks whose keys are not done yet."""
    return chunks.join(done.select(*keys).distinct(), list(keys), "left_anti")


def valid_checkpoints(checkpoints: DataFrame, books: DataFrame, version: int = 1) -> DataFrame:
    """Checkpoints(book_path, book_hash, version, ...) of the given version whose book still has that hash."""
    now = books.select("book_path", "book_hash").distinct()
    return checkpoints.where(F.col("version") == version).join(now, ["book_path", "book_hash"], "left_semi")
