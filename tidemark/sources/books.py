"""Books and pages: EPUB files, page tables of PDFs, fetched web pages."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import parse_html, strip_space
from tidemark.operators.chunking import split_chunks
from tidemark.operators.filters import keep_candidates, preflight
from tidemark.operators.records import book_title

LEAST_IMAGE = 20_000
CHAPTERS = "path string, chapter_no int, text string, title string, author string, error string"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def parse_epub(content: bytes, least_image: int = LEAST_IMAGE) -> tuple[str | None, str | None, list[str]]:
    """(title, author, texts of the documents in reading order); images of ``least_image`` bytes stay as markers."""
    book = zipfile.ZipFile(io.BytesIO(content))
    container = ElementTree.fromstring(book.read("META-INF/container.xml"))
    package_path = next(e.attrib["full-path"] for e in container.iter() if _local(e.tag) == "rootfile")
    package = ElementTree.fromstring(book.read(package_path))
    base = posixpath.dirname(package_path)
    items = {e.attrib["id"]: (posixpath.normpath(posixpath.join(base, e.attrib["href"])), e.attrib.get("media-type", "")) for e in package.iter() if _local(e.tag) == "item"}
    first = lambda name: next((e.text.strip() for e in package.iter() if _local(e.tag) == name and e.text and e.text.strip()), None)
    sizes = {i.filename: i.file_size for i in book.infolist()}
    images = {posixpath.basename(p) for p, kind in items.values() if kind.startswith("image/") and sizes.get(p, 0) >= least_image}
    spine = [e.attrib["idref"] for e in package.iter() if _local(e.tag) == "itemref"]
    order = [items[i][0] for i in spine if i in items] or [p for p, kind in items.values() if "html" in kind]
    texts = [parse_html(book.read(p).decode("utf-8", "replace"), images or None, True) for p in order if p in sizes]
    return first("title"), first("creator"), [t for t in texts if t and t.strip()]


def read_epub_chapters(spark: SparkSession, path: str) -> DataFrame:
    """One row per chapter with text; a book that cannot be opened has one row with an error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    title, author, texts = parse_epub(content)
                    rows = [(source, i, t, title, author, None) for i, t in enumerate(texts)]
                except Exception as e:  # noqa: BLE001 - the error becomes a row
                    rows = [(source, -1, None, None, None, f"{type(e).__name__}: {e}")]
                if rows:
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int32() if i == 1 else pa.string()) for i, c in enumerate(columns)], ["path", "chapter_no", "text", "title", "author", "error"]
                    )

    return files.mapInArrow(run, CHAPTERS)


def read_epub(spark: SparkSession, path: str, limit: int = 30_000) -> DataFrame:
    """Chunks (source_id, chunk_no, text, input_type, source_url) of EPUB books: candidate chapters, split when too long."""
    chapters = read_epub_chapters(spark, path).where("error is null")
    named = chapters.select(
        F.col("path").alias("source_id"), F.col("chapter_no").alias("chunk_no"), "text",
        book_title(F.col("title"), F.col("author"), F.lit("EPUB Auto-Import")).alias("source_url"), F.lit("EPUB").alias("input_type"),
    )
    return split_chunks(keep_candidates(named), "text", limit)


def pdf_chunks(pages: DataFrame) -> DataFrame:
    """Chunks of pages(source_id, page_no, text) of the books that pass the preflight; blank pages go."""
    fit = preflight(pages).where("verdict = 'ok'").select("source_id")
    return pages.join(fit, "source_id", "left_semi").withColumn("text", strip_space(F.coalesce("text", F.lit("")))).where("text <> ''").select(
        "source_id", F.col("page_no").alias("chunk_no"), "text", F.lit("PDF").alias("input_type")
    )


def mark_page_images(pages: DataFrame, images: DataFrame, least: int = LEAST_IMAGE) -> DataFrame:
    """Pages headed by markers of their images(source_id, page_no, img_no, extension, content) of ``least`` bytes or more."""
    name = F.format_string("page%d_img%d.%s", "page_no", "img_no", "extension")
    marks = images.where(F.length("content") >= least).groupBy("source_id", "page_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("img_no", F.concat(F.lit("[IMAGE: "), name, F.lit("]")).alias("mark")))), lambda s: s["mark"]), "\n").alias("marks")
    )
    return pages.join(marks, ["source_id", "page_no"], "left").withColumn("text", F.concat_ws("\n", "marks", "text")).drop("marks")


def url_chunks(pages: DataFrame) -> DataFrame:
    """One chunk per fetched page (url, body)."""
    return pages.select(F.col("url").alias("source_id"), F.lit(0).alias("chunk_no"), F.col("body").alias("text"), F.lit("URL").alias("input_type"), F.col("url").alias("source_url"))


def list_books(names: list[str]) -> list[str]:
    """EPUB files in order of name, then PDF files."""
    by = lambda suffix: sorted(n for n in names if re.search(rf"\.{suffix}$", n, re.I))
    return by("epub") + by("pdf")
