"""Chunks to final records: extract, refine, categorise, embed, assemble, with errors as rows.

Narrow stages fuse into few Python passes. A chunk is atomic: one failed recipe drops all of its
recipes, and the chunk's first error is reported instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.functions.scalar import TOKEN
from tidemark.operators.records import DIMENSIONS, flat_tags, keep_allowed_tags, route
from tidemark.plans.providers import Provider, RuleProvider
from tidemark.session import store

_INGREDIENT = pa.struct([
    ("id", pa.string()), ("amount", pa.float64()), ("unit", pa.string()), ("name", pa.string()), ("fallback_string", pa.string()),
    ("converted_amount", pa.float64()), ("converted_unit", pa.string()), ("is_ai_converted", pa.bool_()),
])
_RECORD = pa.struct([
    ("title", pa.string()), ("base_servings", pa.int32()), ("prep_time", pa.string()), ("cook_time", pa.string()),
    ("ingredients", pa.list_(_INGREDIENT)), ("directions", pa.list_(pa.struct([("step", pa.int32()), ("text", pa.string())]))),
    ("grid_categories", pa.map_(pa.string(), pa.list_(pa.string()))), ("embedding", pa.list_(pa.float32())),
])
_DDL = (
    "struct<title:string,base_servings:int,prep_time:string,cook_time:string,"
    "ingredients:array<struct<id:string,amount:double,unit:string,name:string,fallback_string:string,converted_amount:double,converted_unit:string,is_ai_converted:boolean>>,"
    "directions:array<struct<step:int,text:string>>,grid_categories:map<string,array<string>>,embedding:array<float>>"
)

#: Rows that a worker hands on at once: as Python values a record's vector takes some 50 kB.
_SLICE = 128


def _check_references(record: dict) -> None:
    import re

    known = {i["id"] for i in record["ingredients"]}
    for d in record["directions"]:
        for ref, _ in re.findall(TOKEN, d["text"]):
            if ref not in known:
                raise ValueError(f"direction refers to unknown ingredient {ref}")


def run_pipeline(chunks: DataFrame, axes: dict[str, list[str]] | None = None, provider: Provider | None = None, weights: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of chunks(source_id, chunk_no, text, input_type).

    records: source_id, chunk_no, recipe_no, the record's fields, grid_categories limited to ``axes``,
    categories, embedding. errors: source_id, chunk_no, error. Blank chunks are errors; a chunk without
    recipes gives neither. chunk_no stays a BIGINT where it is one, else it is an INT.
    """
    provider, taxonomy = provider or RuleProvider(), axes or {}
    number, number_type = ("bigint", pa.int64()) if isinstance(chunks.schema["chunk_no"].dataType, LongType) else ("int", pa.int32())

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        s, n, i, r, e = zip(*out)
        return pa.RecordBatch.from_arrays(
            [pa.array(s, pa.string()), pa.array(n, number_type), pa.array(i, pa.int32()), pa.array(r, _RECORD), pa.array(e, pa.string())],
            ["source_id", "chunk_no", "recipe_no", "record", "error"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for source, no, text, kind in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    if not (text or "").strip():
                        raise ValueError("blank chunk")
                    plain = kind == "ARCHIVE_TEXT"
                    upper = text.upper()
                    if not plain and ("BAKER" in upper and any(f"BAKER{c}S {e}" in upper for c in "'’`" for e in ("%", "PERCENTAGE"))):
                        text = provider.normalise_table(text) or text
                    done = []
                    for raw in provider.extract(text, plain) or []:
                        record = provider.refine(raw, weights)
                        _check_references(record)
                        record["grid_categories"] = list((provider.classify(record, taxonomy) if taxonomy else {}).items())
                        shown = " ".join(i["fallback_string"] for i in record["ingredients"])
                        record["embedding"] = provider.embed(f"{record['title']}\n{shown}".strip())
                        if len(record["embedding"]) != DIMENSIONS:
                            raise RuntimeError(f"embedding of length {len(record['embedding'])}")
                        done.append(record)
                    out += [(source, no, i, r, None) for i, r in enumerate(done)]
                except Exception as e:  # noqa: BLE001 - the chunk fails, not the task
                    out.append((source, no, -1, None, f"{type(e).__name__}: {e}"))
                if len(out) >= _SLICE:
                    yield rows_of(out)
                    out = []
        if out:
            yield rows_of(out)

    rows = chunks.select(F.col("source_id").cast("string"), F.col("chunk_no").cast(number), F.col("text"), F.col("input_type"))
    # written once: records and errors both read it, and no provider is called twice for a chunk
    worked = store(rows.mapInArrow(work, f"source_id string, chunk_no {number}, recipe_no int, record {_DDL}, error string"))
    grid = keep_allowed_tags(F.col("record.grid_categories"), taxonomy)
    records = worked.where("error is null").select(
        "source_id", "chunk_no", "recipe_no", "record.title", "record.base_servings", "record.prep_time", "record.cook_time",
        "record.ingredients", "record.directions", grid.alias("grid_categories"), "record.embedding",
    ).withColumn("categories", flat_tags(F.col("grid_categories")))
    return records, worked.where("error is not null").select("source_id", "chunk_no", "error")


def restore(entry_chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(restored, rest): records that archives carry whole need no provider call; the rest go to ``run_pipeline``."""
    stages = route(F.col("input_type"), F.col("embedding"))
    whole = entry_chunks.where(stages == "ASSEMBLE").select("archive", "member_no", "pre_parsed.*")
    return whole.withColumn("categories", flat_tags(F.col("grid_categories"))), entry_chunks.where(stages != "ASSEMBLE")
