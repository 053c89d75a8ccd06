import gzip
import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators.filters import select_reader
from tidemark.operators.leaves import categorise, contents_from_text, keep_units, preorder
from tidemark.plans import runs
from tidemark.sources.tables import delete_checkpoint, load_checkpoint, save_checkpoint

TEXT = "Lemon Cake\nIngredients\n2 cups flour\n1 lemon\nMethod\nMix the flour. Bake."


def archive(path, entries):
    with zipfile.ZipFile(path, "w") as z:
        for i, e in enumerate(entries):
            z.writestr(f"{i}.paprikarecipe", e if isinstance(e, bytes) else gzip.compress(json.dumps(e).encode()))


def test_reader_by_extension(spark):
    rows = [("a.zip", "application/zip", None), ("a.PAPRIKARECIPES", "application/octet-stream", "archive"), ("x", "application/pdf", "pdf"), ("b.epub", None, "epub"), (None, None, None)]
    df = spark.createDataFrame(rows, "name string, mime string, want string")
    assert df.where(~select_reader(F.col("name"), F.col("mime")).eqNullSafe(F.col("want"))).count() == 0


def test_leaf_categories_and_fallback(spark):
    df = spark.createDataFrame([(1, "Lemon soup", ["rice"] * 3), (2, "Pie", ["x"] * 10 + ["rice"]), (3, None, None)], "id int, name string, ingredients array<string>")
    got = {r["id"]: r["leaf_categories"] for r in categorise(df, ["Rice", "Soup", "Lemon", "Pie crust"]).collect()}
    assert got == {1: ["Rice", "Soup", "Lemon"], 2: ["EPUB Imports"], 3: ["EPUB Imports"]}
    assert {r["leaf_categories"][0] for r in categorise(df, []).collect()} == {"EPUB Imports"}


def test_units_and_contents(spark):
    one = spark.createDataFrame([("14 tablespoons/200g butter", "Contents\nPear tart .... 12\nSoups   3\nno page\n")], "line string, text string")
    row = one.select(keep_units(F.col("line"), F.lit("metric")).alias("m"), keep_units(F.col("line"), F.lit("us")).alias("u"), keep_units(F.lit("1/2 cup milk"), F.lit("metric")).alias("h"), contents_from_text(F.col("text")).alias("c")).first()
    assert row["m"] == "200g butter" and row["u"] == "14 tablespoons butter" and row["h"] == "1/2 cup milk"
    assert [(c["title"], c["page"]) for c in row["c"]] == [("Pear tart", 12), ("Soups", 3)]


def test_preorder(spark):
    rows = [("b", "1", None, 1), ("b", "2", None, 0), ("b", "3", "2", 1), ("b", "4", "2", 0), ("b", "5", "4", 0), ("c", "1", "1", 0)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "source_id string, entry_id string, parent_id string, pos int, title string")
    assert [r["entry_id"] for r in preorder(df).orderBy("place").collect()] == ["2", "4", "5", "3", "1"]


def test_a_book_from_chunks_to_an_archive(spark, tmp_path):
    chunks = spark.createDataFrame([("b", 0, TEXT, "EPUB"), ("b", 1, " ", "EPUB"), ("b", 2, "no recipe here", "EPUB")], "source_id string, chunk_no int, text string, input_type string")
    path, counters = runs.run_book(chunks, str(tmp_path), "mine", {"Meal": ["Cake"]}, "2026-01-01 00:00:00")
    assert counters.first().asDict() == {"source_id": "b", "total": 3, "completed": 2, "failed": 1, "recipes": 1}
    with zipfile.ZipFile(path) as z:
        entry = json.loads(gzip.decompress(z.read(z.namelist()[0])))
    assert entry["name"] == "Lemon Cake" and entry["categories"] == ["Cake"]
    with pytest.raises(ValueError):
        runs.run_book(chunks.limit(0), str(tmp_path), "none", None, "")
    with pytest.raises(ValueError):
        runs.run_book(chunks.where("chunk_no = 2"), str(tmp_path), "none", None, "")


def test_merged_file_keeps_bytes(spark, tmp_path):
    one, two = str(tmp_path / "a.paprikarecipes"), str(tmp_path / "b.paprikarecipes")
    archive(one, [{"name": "Pear Tart", "x": 1}, b"broken"])
    archive(two, [{"name": "pear  tart"}, {"name": "Soup", "extra": [1]}])
    path = runs.merge_to_file(spark, [one, two], str(tmp_path), datetime(2026, 1, 2, 3, 4, 5))
    assert path.endswith("merged_20260102_030405.paprikarecipes")
    with zipfile.ZipFile(path) as z, zipfile.ZipFile(one) as a, zipfile.ZipFile(two) as b:
        assert [z.read(n) for n in z.namelist()] == [a.read("0.paprikarecipe"), b.read("1.paprikarecipe")]


def test_recategorised_archive(spark, tmp_path):
    path = str(tmp_path / "mine.paprikarecipes")
    archive(path, [{"name": "Lemon Soup", "ingredients": "rice", "categories": ["Old"], "rating": 3, "notes": "n"}, b"broken", {"name": "Pie", "categories": []}])
    target = runs.recategorise_archive(spark, path, ["Soup", "Rice"])
    assert target.endswith("mine_recategorized.paprikarecipes")
    with zipfile.ZipFile(target) as z:
        got = [json.loads(gzip.decompress(z.read(n))) for n in z.namelist()]
    assert [(g["name"], g["categories"], g["rating"], g["notes"]) for g in got] == [("Lemon Soup", ["Soup", "Rice"], 3, "n"), ("Pie", ["EPUB Imports"], None, None)]
    with pytest.raises(FileNotFoundError):
        runs.recategorise_archive(spark, str(tmp_path / "no"), [])


def test_pages_by_a_reader_of_images(spark):
    pages = spark.createDataFrame([("b", 1, b"one"), ("b", 2, b""), ("b", 3, None), ("b", 4, b"\xff")], "source_id string, page_no int, content binary")
    got = runs.recognise_pages(pages, lambda c: c.decode("utf-8"))
    assert [tuple(r) for r in got.collect()] == [("b", 1, "one")]


def test_checkpoints_can_be_deleted(spark, tmp_path):
    path = str(tmp_path / "state")
    assert load_checkpoint(spark, path, "b", "h") is None
    save_checkpoint(spark, path, "b", "h", "EXTRACT", [1, 2])
    assert load_checkpoint(spark, path, "b", "h")["completed_segments"] == [1, 2]
    delete_checkpoint(spark, path, "b")
    assert load_checkpoint(spark, path, "b", "h") is None


def test_small_parts(spark, tmp_path):
    schema = {"type": "object", "additionalProperties": False, "properties": {"a": {"items": [{"additionalProperties": 1, "x": 2}]}}}
    assert runs.strip_keys(schema) == {"type": "object", "properties": {"a": {"items": [{"x": 2}]}}}
    assert runs.reachable(lambda: "ok") and not runs.reachable(lambda: 1 / 0) and not runs.may_go_on("cancelling") and runs.may_go_on("paused")
    (tmp_path / "a.epub").write_bytes(b"")
    assert runs.resolve_book(str(tmp_path)).endswith("a.epub")
    (tmp_path / "b.pdf").write_bytes(b"")
    for bad in (str(tmp_path), str(tmp_path / "c.txt"), str(tmp_path / "d.pdf")):
        with pytest.raises(ValueError):
            runs.resolve_book(bad)
    assert runs.new_job(spark, "j", "u", "s", datetime(2026, 1, 1)).first()["status"] == "pending"
