"""Recipe archives: ZIP files of gzipped JSON entries, with or without an embedded full record."""

from __future__ import annotations

import gzip
import io
import json
import pickle
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from typing import IO

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from tidemark.functions.text import normal_name, safe_file_name
from tidemark.operators.dedupe import first_wins
from tidemark.operators.records import DIMENSIONS, ENTRY_KEYS
from tidemark.session import delete_file, drop_stored, store

# What the file format names things.
MEMBER_SUFFIX = ".paprikarecipe"
ARCHIVE_SUFFIX = ".paprikarecipes"
META_KEY = "_cayenne_meta"
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp")

INGREDIENT = "struct<id:string,amount:double,unit:string,name:string,fallback_string:string,converted_amount:double,converted_unit:string,is_ai_converted:boolean>"
RECORD = (
    f"struct<title:string,base_servings:int,structured_ingredients:array<{INGREDIENT}>,tokenized_directions:array<struct<step:int,text:string>>,"
    "grid_categories:map<string,array<string>>,prep_time:string,cook_time:string,source_url:string,image_url:string,categories:array<string>,embedding:array<float>>"
)
ENTRY_SCHEMA = "archive string, member_no int, member string, entry string, error string"


#: A task reads about so many bytes of archives, members are handed to it in slices of at most so many bytes and members.
TASK_BYTES, SLICE_BYTES, SLICE_MEMBERS = 8_000_000, 1_000_000, 256
#: Bytes of text or images that a worker collects before it hands them on.
OUT_BYTES = 4_000_000
_EMPTY_ZIP = b"PK\5\6" + bytes(18)


def _open(path: str) -> IO[bytes]:
    """A file of any shared storage, to be read at any place of it."""
    if re.match(r"file:|/", path):
        return open(re.sub(r"^file:(//)?", "", path), "rb")
    system, name = pa.fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _member_slices(spark: SparkSession, path: str, wanted: Callable[[str], bool]) -> DataFrame:
    """(archive, members, error): the wanted members of every archive under ``path`` in slices, spread over tasks.

    Only the directory of an archive is read here, in one task: about 1 kB of memory a member.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(source: str, members: list, error: str | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([source]), pa.array([pickle.dumps(members)], pa.binary()), pa.array([error], pa.string())], ["archive", "members", "error"])

        for batch in batches:
            for source in batch.column(0).to_pylist():
                with _open(source) as file:
                    try:
                        infos = zipfile.ZipFile(file).infolist()
                    except zipfile.BadZipFile as e:
                        yield row(source, [], f"not an archive: {e}")
                        continue
                members, size = [], 0
                for no, info in enumerate(infos):
                    if wanted(info.filename):
                        members.append((no, info))
                        size += info.compress_size
                    if members and (size >= SLICE_BYTES or len(members) >= SLICE_MEMBERS):
                        yield row(source, members, None)
                        members, size = [], 0
                if members:
                    yield row(source, members, None)

    tasks = -(-(files.agg(F.sum("length")).first()[0] or 1) // TASK_BYTES)
    return files.select("path").mapInArrow(run, "archive string, members binary, error string").repartition(tasks)


def _slice_rows(batches: Iterator[pa.RecordBatch], rows: Callable[[zipfile.ZipFile, list], Iterator[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """What ``rows`` makes of each slice, behind its archive; a file that is no archive has one row with its error."""
    names = schema.names
    for batch in batches:
        for source, members, error in zip(*(c.to_pylist() for c in batch.columns)):
            if error:
                yield pa.RecordBatch.from_pylist([{"archive": source, "member_no": -1, "member": "", "error": error}], schema)
                continue
            with _open(source) as file:
                # the members' places are known: no task reads the whole directory again
                archive = zipfile.ZipFile(io.BytesIO(_EMPTY_ZIP))
                archive.fp = file
                out, size = [], 0
                for row in rows(archive, pickle.loads(members)):
                    out.append(dict(zip(names, (source, *row))))
                    size += sum(len(v) for v in row if isinstance(v, (str, bytes)))
                    if size >= OUT_BYTES:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)


def read_entries(spark: SparkSession, path: str, any_member: bool = False, plain_json: bool = True) -> DataFrame:
    """(archive, member_no, member, entry, error): one row per member of every archive under ``path``.

    Members that cannot be read keep their row with an error and no entry; a file that is no archive
    has one such row with member_no -1. Members of one archive are read by many tasks, each by its place.
    """
    schema = pa.schema([("archive", pa.string()), ("member_no", pa.int32()), ("member", pa.string()), ("entry", pa.string()), ("error", pa.string())])

    def rows(archive: zipfile.ZipFile, members: list) -> Iterator[tuple]:
        for no, info in members:
            try:
                raw = archive.read(info)
                try:
                    text = gzip.decompress(raw).decode("utf-8")
                except (gzip.BadGzipFile, EOFError):
                    if not plain_json:
                        raise
                    text = raw.decode("utf-8")
                if not isinstance(json.loads(text), dict):
                    raise ValueError("not an object")
                yield no, info.filename, text, None
            except Exception as e:  # noqa: BLE001 - one bad member must not lose the archive
                yield no, info.filename, None, f"{type(e).__name__}: {e}"

    slices = _member_slices(spark, path, lambda name: any_member or name.lower().endswith(MEMBER_SUFFIX))
    return slices.mapInArrow(lambda batches: _slice_rows(batches, rows, schema), ENTRY_SCHEMA)


def parse_entries(entries: DataFrame) -> DataFrame:
    """Adds the entry's fields as text columns, ``categories`` and ``meta``, the embedded record or null.

    The embedded record may be an object or its JSON as a string; it counts only with a title,
    ingredients and directions.
    """
    get = lambda k: F.get_json_object("entry", f"$.{k}")
    fields = [get(k).alias(k) for k in ENTRY_KEYS if k != "categories"]
    embedded = F.get_json_object("entry", f"$.{META_KEY}")
    # as an element of an array the record is parsed once; fields asked of from_json itself would parse it once each
    valid = lambda m: m["title"].isNotNull() & m["structured_ingredients"].isNotNull() & m["tokenized_directions"].isNotNull()
    meta = F.get(F.filter(F.array(F.from_json(embedded, RECORD)), valid), F.lit(0))
    return entries.select(
        "archive", "member_no", "member", *fields, F.from_json(get("categories"), "array<string>").alias("categories"),
        get("photo").alias("photo"), meta.alias("meta"),
    )


def entry_chunks(parsed: DataFrame) -> DataFrame:
    """(archive, member_no, input_type, text, pre_parsed, embedding): restored records keep theirs, others become text."""
    restored = F.col("meta").isNotNull()
    text = F.concat(
        F.coalesce("name", F.lit("")), F.lit("\n\nIngredients:\n"), F.coalesce("ingredients", F.lit("")), F.lit("\n\nDirections:\n"), F.coalesce("directions", F.lit(""))
    )
    return parsed.select(
        "archive", "member_no", F.when(restored, "ARCHIVE_RECORD").otherwise("ARCHIVE_TEXT").alias("input_type"),
        F.when(restored, "").otherwise(text).alias("text"), F.col("meta").alias("pre_parsed"), F.col("meta.embedding").alias("embedding"),
    )


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, content) of the image members of every archive under ``path``."""
    schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("content", pa.binary())])

    def rows(archive: zipfile.ZipFile, members: list) -> Iterator[tuple]:
        for _, info in members:
            yield info.filename, archive.read(info)

    slices = _member_slices(spark, path, lambda name: name.lower().endswith(IMAGE_SUFFIXES))
    return slices.where("error is null").mapInArrow(lambda batches: _slice_rows(batches, rows, schema), "archive string, member string, content binary")


def with_images(parsed: DataFrame, images: DataFrame) -> DataFrame:
    """Entries with ``photo_data``, the bytes of the image member their photo names."""
    named = images.select("archive", F.col("member").alias("photo"), F.col("content").alias("photo_data"))
    return parsed.join(named, ["archive", "photo"], "left")


def write_archive(entries: DataFrame, path: str, name_col: str = "name", meta_col: str | None = None, order: list[str] | None = None) -> int:
    """Writes one archive from export rows; returns the number of entries.

    Members are packed on the executors into files of the shared folder; the driver appends and deletes one
    after the other, so there is no second copy of the archive. The directory lists the members by ``order``;
    it stays in the driver's memory until the end, about 1 kB a member. No rows, no file. With ``meta_col``
    (JSON text) the full record is embedded.
    """
    values = [c for c in ENTRY_KEYS if c in entries.columns]
    keys = order or []
    meta = F.col(meta_col) if meta_col else F.lit(None).cast("string")
    rows = entries.select(safe_file_name(F.col(name_col)).alias("_member"), F.to_json(F.struct(*values), {"ignoreNullFields": "false"}).alias("_entry"), meta.alias("_meta"), *keys)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_MEMBERS):
                batch = whole.slice(at, SLICE_MEMBERS)
                packed = [_packed(e, m, bool(meta_col)) for e, m in zip(batch["_entry"].to_pylist(), batch["_meta"].to_pylist())]
                yield pa.RecordBatch.from_arrays([*(batch.column(3 + i) for i in range(len(keys))), batch["_member"], pa.array(packed, pa.binary())], [*keys, "_member", "_packed"])

    ready = store(rows.mapInArrow(pack, StructType([*(rows.schema[c] for c in keys), StructField("_member", StringType()), StructField("_packed", BinaryType())])))
    archive, written = None, []
    try:
        for file in sorted(ready.inputFiles()):
            for row in ready.sparkSession.read.schema(ready.schema).parquet(file).toLocalIterator():
                archive = archive or zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED)
                written.append((tuple((row[c] is not None, row[c]) for c in keys), row["_member"], _append(archive, row["_member"], row["_packed"], len(written))))
            delete_file(ready.sparkSession, file)
        if archive:
            _name_members(archive, sorted(written, key=lambda w: w[0]))
    finally:
        if archive:
            archive.close()
        drop_stored(ready)
    return len(written)


#: Bytes of a member's header that are left for the number behind its name.
_ROOM = 16


def _append(archive: zipfile.ZipFile, name: str, content: bytes, no: int) -> zipfile.ZipInfo:
    """Appends a member whose name is given later: its header has room for it."""
    info = zipfile.ZipInfo(f"{no:010d}".ljust(len((name + MEMBER_SUFFIX).encode("utf-8")) + _ROOM, "_"))
    archive.writestr(info, content, zipfile.ZIP_DEFLATED)
    return info


def _name_members(archive: zipfile.ZipFile, members: list[tuple[tuple, str, zipfile.ZipInfo]]) -> None:
    """Names the members (key, name, info) in this order, repeated names with a number, and lists them so."""
    used: dict[str, int] = {}
    for _, name, info in members:
        count = used[name] = used.get(name, 0) + 1
        size = len(info.filename)
        info.filename = name + (f" {count}" if count > 1 else "") + MEMBER_SUFFIX
        spare = size - len(info.filename.encode("utf-8"))
        info.extra = struct.pack("<HH", 0xFFFF, spare - 4) + bytes(spare - 4)  # the rest of the room
        archive.fp.seek(info.header_offset)
        archive.fp.write(info.FileHeader(False))
        info.extra = b""
    archive.filelist[:] = [info for *_, info in members]


def _packed(entry: str, meta: str | None, with_meta: bool) -> bytes:
    """A member's bytes from the JSON texts of its entry and of its full record."""
    values = json.loads(entry)
    if "rating" in values and values["rating"] is not None:
        values["rating"] = int(values["rating"])
    text = json.dumps(values, ensure_ascii=False)
    if with_meta:
        if meta:
            json.loads(meta)  # put in as it is, so it must be JSON
        text = f"{text[:-1]}{', ' if values else ''}{json.dumps(META_KEY)}: {meta or 'null'}}}"
    return gzip.compress(text.encode("utf-8"), 6)


def record_json(recipes: DataFrame) -> DataFrame:
    """``recipes`` with ``meta``: the full record as JSON, tokens and embedding untouched, null fields kept."""
    record = F.struct(
        F.col("title"), F.col("base_servings"), F.col("ingredients").alias("structured_ingredients"), F.col("directions").alias("tokenized_directions"),
        F.col("grid_categories"), F.col("prep_time"), F.col("cook_time"), F.col("source_url"), F.col("image_url"), F.col("categories"), F.col("embedding"),
    )
    return recipes.withColumn("meta", F.to_json(record, {"ignoreNullFields": "false"}))


def merge(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Entries of several archives in order, the first of every normal name kept; entries stay unchanged.

    Every member is tried; those that are not gzipped JSON are left out. Entries whose normal name is
    empty collapse into one. No paths, or nothing readable, is an error.
    """
    if not paths:
        raise ValueError("no archives to merge")
    rows = None
    for no, path in enumerate(paths):
        part = read_entries(spark, path, any_member=True, plain_json=False).where("error is null").withColumn("archive_no", F.lit(no))
        rows = part if rows is None else rows.unionByName(part)
    named = rows.withColumn("name", F.coalesce(F.get_json_object("entry", "$.name"), F.lit("")))
    merged = first_wins(named, F.coalesce(normal_name(F.col("name")), F.lit("")), "archive_no", "member_no")
    if merged.isEmpty():
        raise ValueError("nothing to merge")
    return merged


def recategorise(parsed: DataFrame, chosen: DataFrame) -> DataFrame:
    """Entries with the categories of ``chosen`` (archive, member_no, new_categories) where there are any."""
    return parsed.join(chosen, ["archive", "member_no"], "left").withColumn("categories", F.coalesce("new_categories", "categories")).drop("new_categories")


def check_embedding(recipes: DataFrame) -> DataFrame:
    """``recipes`` with ``embedding_ok``: whether the vector has the right length."""
    return recipes.withColumn("embedding_ok", F.coalesce(F.size("embedding") == DIMENSIONS, F.lit(False)))
