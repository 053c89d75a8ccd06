"""Runs: a book from pages to an archive, its counters and progress, folders of books, pauses, merged and rewritten archives."""

from __future__ import annotations

import zipfile
from collections.abc import Callable
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import total_time
from tidemark.functions.text import title_case
from tidemark.operators.control import error_runs
from tidemark.operators.leaves import categorise
from tidemark.operators.records import ENTRY_KEYS, export_rows
from tidemark.plans.pipeline import run_pipeline
from tidemark.plans.providers import Provider
from tidemark.session import cut
from tidemark.sources import archives, books

#: Seconds a run rests after refusals in a row.
REST = 43_200


def run_counters(chunks: DataFrame, records: DataFrame, errors: DataFrame) -> DataFrame:
    """(source_id, total, completed, failed, recipes) of a run: chunks in all, without and with an error, and records made."""
    key = ["source_id"]
    total = chunks.groupBy(*key).agg(F.count(F.lit(1)).alias("total"))
    failed = errors.groupBy(*key).agg(F.count_distinct("chunk_no").alias("failed"))
    made = records.groupBy(*key).agg(F.count(F.lit(1)).alias("recipes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return total.join(failed, key, "left").join(made, key, "left").select("source_id", "total", (F.col("total") - F.coalesce("failed", F.lit(0))).alias("completed"), zero("failed"), zero("recipes"))


def progress(done: DataFrame) -> DataFrame:
    """done(source_id, chunk_no, finished_at) with ``number`` and ``percent``: how far its book was when a chunk was finished."""
    order = Window.partitionBy("source_id").orderBy("finished_at", "chunk_no")
    whole = done.groupBy("source_id").agg(F.count(F.lit(1)).alias("_total"))
    numbered = done.select("source_id", "chunk_no", "finished_at", F.row_number().over(order).cast("bigint").alias("number"))
    return numbered.join(whole, "source_id").withColumn("percent", F.floor(F.col("number") * 100 / F.col("_total")).cast("int")).drop("_total")


def folder_errors(results: DataFrame) -> DataFrame:
    """(folder, books, errors): how many books of a folder ran and how many failed, from (folder, book, error)."""
    return results.groupBy("folder").agg(F.count(F.lit(1)).alias("books"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def auto_pauses(events: DataFrame, after: int = 3, rest: int = REST) -> DataFrame:
    """(key, id, ts, resume_at): every event that is the ``after``-th refusal in a row, and when the run may go on."""
    runs = error_runs(events, after)
    return runs.where(F.col("run") == after).select("key", "id", "ts", (F.col("ts") + F.make_dt_interval(secs=F.lit(rest))).alias("resume_at"))


def may_go_on(state: str, refusals: int = 0) -> bool:
    """The pause point between two chunks: False once a run is cancelling; a paused one waits outside."""
    return state != "cancelling"


def new_job(spark: SparkSession, job_id: str, user_id: str, source: str, submitted: datetime) -> DataFrame:
    """The row of a submitted job, waiting to run."""
    return spark.createDataFrame([(job_id, user_id, source, "pending", submitted, 0)], "job_id string, user_id string, source string, status string, submitted_at timestamp, progress int")


def strip_keys(schema: object, keys: frozenset[str] = frozenset({"additionalProperties"})) -> object:
    """A JSON schema without the given keys, at any depth."""
    if isinstance(schema, dict):
        return {k: strip_keys(v, keys) for k, v in schema.items() if k not in keys}
    return [strip_keys(v, keys) for v in schema] if isinstance(schema, list) else schema


def reachable(call: Callable[[], object]) -> bool:
    """Whether a provider answers a first call."""
    try:
        return call() is not None
    except Exception:  # noqa: BLE001 - any failure means no
        return False


def recognise_pages(pages: DataFrame, read_image: Callable[[bytes], str | None]) -> DataFrame:
    """(source_id, page_no, text) from pages(source_id, page_no, content) by ``read_image``, a picklable reader of page images.

    Pages that fail or are blank are left out; a book whose pages all are gives no rows.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = []
            for source, no, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    text = read_image(content) if content is not None else None
                except Exception:  # noqa: BLE001 - one page, not the book
                    text = None
                if text and text.strip():
                    rows.append((source, no, text))
            if rows:
                s, n, t = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.string()), pa.array(n, pa.int32()), pa.array(t, pa.string())], ["source_id", "page_no", "text"])

    return pages.select(F.col("source_id").cast("string"), F.col("page_no").cast("int"), "content").mapInArrow(run, "source_id string, page_no int, text string")


def older_export(extractions: DataFrame, images: DataFrame, book: str, created: str) -> DataFrame:
    """Entries in the older form from extractions: title-cased name and source, derived total time, and ``photo`` with
    ``photo_data`` (base64) only where images(name, content) has the photo; both null otherwise, and left out of the JSON."""
    rows = extractions.withColumn("_uid", F.upper(F.expr("uuid()")))
    named = images.select(F.col("name").alias("_photo"), F.base64("content").alias("photo_data"))
    found = rows.join(named, F.col("photo_filename") == F.col("_photo"), "left")
    values = {
        "uid": F.col("_uid"), "name": title_case(F.col("name")), "directions": F.array_join("directions", "\n"), "ingredients": F.array_join("ingredients", "\n"),
        "prep_time": F.coalesce("prep_time", F.lit("")), "cook_time": F.coalesce("cook_time", F.lit("")), "total_time": total_time(F.col("prep_time"), F.col("cook_time")),
        "servings": F.coalesce("servings", F.lit("")), "notes": F.coalesce("notes", F.lit("")), "rating": F.lit(0), "source": title_case(F.lit(book)),
        "categories": F.coalesce("categories", F.array().cast("array<string>")), "created": F.lit(created), "hash": F.sha2(F.col("_uid"), 256), "photo_large": F.lit(None).cast("string"),
    }
    photo = F.when(F.col("photo_data").isNotNull(), F.col("photo_filename")).alias("photo")
    return found.select("extraction_id", *(values.get(k, F.lit("")).alias(k) for k in ENTRY_KEYS), photo, "photo_data")


def merge_to_file(spark: SparkSession, paths: list[str], folder: str, now: datetime) -> str:
    """Merges archives into ``folder``/merged_<time>; the bytes of every kept member are copied unchanged. Returns the path.

    Which members stay is decided on the cluster; only their names and numbers come to the driver, an archive at a time.
    """
    kept = archives.merge(spark, paths).select("archive_no", "member_no", "name").orderBy("archive_no", "member_no")
    target = str(Path(folder) / f"merged_{now:%Y%m%d_%H%M%S}{archives.ARCHIVE_SUFFIX}")
    used: set[str] = set()
    source, number = None, -1
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for row in kept.toLocalIterator():
            if row["archive_no"] != number:
                number = row["archive_no"]
                source = zipfile.ZipFile(paths[number].removeprefix("file://"))
            member = source.infolist()[row["member_no"]]
            name, at = member.filename, 2
            while name in used:
                name, at = f"{member.filename.removesuffix(archives.MEMBER_SUFFIX)} {at}{archives.MEMBER_SUFFIX}", at + 1
            used.add(name)
            out.writestr(name, source.read(member))
    return target


def recategorise_archive(spark: SparkSession, path: str, leaves: list[str]) -> str:
    """Rewrites an archive as <stem>_recategorized with new leaf categories and nothing else changed; returns the path.

    Entries that cannot be read are left out. Raises FileNotFoundError or ValueError where there is nothing to rewrite.
    """
    if not Path(path).exists():
        raise FileNotFoundError(path)
    entries = archives.read_entries(spark, path)
    if not entries.where("error is null").limit(1).count():
        raise ValueError("nothing readable in the archive")
    parsed = archives.parse_entries(entries.where("error is null"))
    chosen = categorise(parsed.withColumn("_lines", F.split("ingredients", "\n")), leaves, "name", "_lines")
    target = str(Path(path).with_name(f"{Path(path).stem}_recategorized{archives.ARCHIVE_SUFFIX}"))
    archives.write_archive(chosen.withColumn("categories", F.col("leaf_categories")).withColumn("rating", F.col("rating").cast("int")), target, order=["member_no"])
    return target


def run_book(chunks: DataFrame, folder: str, stem: str, axes: dict[str, list[str]] | None, created: str, provider: Provider | None = None) -> tuple[str, DataFrame]:
    """A book end to end: chunks to records to <folder>/<stem> as an archive. Returns (path, counters).

    Raises ValueError for a book without chunks or without any record. Every provider call is made once.
    """
    if chunks.isEmpty():
        raise ValueError("no chunks")
    records, errors = run_pipeline(chunks, axes, provider)
    keyed = records.withColumn("recipe_id", F.concat_ws("/", "source_id", "chunk_no", "recipe_no")).withColumns({c: F.lit(None).cast("string") for c in ("source_url", "image_url")})
    kept = cut(keyed)
    if kept.isEmpty():
        raise ValueError("no records")
    path = str(Path(folder) / f"{stem}{archives.ARCHIVE_SUFFIX}")
    archives.write_archive(export_rows(kept, created), path, order=["uid"])
    return path, run_counters(chunks, kept, errors)


def resolve_book(path: str) -> str:
    """The book a path means: a file of a known kind, or the only one of a folder; ValueError otherwise."""
    given = Path(path)
    if given.is_dir():
        found = books.list_books([p.name for p in given.iterdir()])
        if len(found) != 1:
            raise ValueError(f"{len(found)} books in {path}")
        return str(given / found[0])
    if given.suffix.lower() not in (".epub", ".pdf") or not given.exists():
        raise ValueError(f"no book: {path}")
    return str(given)
