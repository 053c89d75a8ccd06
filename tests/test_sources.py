import gzip
import json
import sqlite3
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.plans import pipeline
from tidemark.plans.pipeline import restore, run_pipeline
from tidemark.plans.providers import RuleProvider
from tidemark.sources import archives, books, taxonomy

META = {
    "title": "Soup", "base_servings": 2, "structured_ingredients": [{"id": "ing_01", "amount": 1.0, "fallback_string": "1 onion"}],
    "tokenized_directions": [{"step": 1, "text": "Chop {{ing_01|1 onion}}."}], "grid_categories": {"Meal": ["Soup"]}, "embedding": [0.5, 0.25],
}


def archive(path, entries, raw=()):
    with zipfile.ZipFile(path, "w") as z:
        for name, entry in entries:
            z.writestr(name, gzip.compress(json.dumps(entry).encode()))
        for name, content in raw:
            z.writestr(name, content)
    return str(path)


def test_reading_archives(spark, tmp_path):
    path = archive(tmp_path / "a.zip", [
        ("1.paprikarecipe", {"name": "Soup", archives.META_KEY: META}), ("2.PAPRIKARECIPE", {"name": "Old", "ingredients": "salt", "directions": "mix", "photo": "p.jpg"}),
        ("3.paprikarecipe", {"name": "Text meta", archives.META_KEY: json.dumps(META)}), ("4.paprikarecipe", {"name": "Bad meta", archives.META_KEY: "{oops"}),
    ], [("5.paprikarecipe", b'{"name": "Plain"}'), ("6.paprikarecipe", b"junk"), ("p.jpg", b"image"), ("note.txt", b"x")])
    entries = archives.read_entries(spark, path)
    assert entries.where("error is null").count() == 5 and entries.where("error is not null").count() == 1
    parsed = archives.parse_entries(entries.where("error is null"))
    kinds = {r["member_no"]: (r["input_type"], r["text"], r["embedding"]) for r in archives.entry_chunks(parsed).collect()}
    assert kinds[0] == ("ARCHIVE_RECORD", "", [0.5, 0.25]) and kinds[2][0] == "ARCHIVE_RECORD"
    assert kinds[1] == ("ARCHIVE_TEXT", "Old\n\nIngredients:\nsalt\n\nDirections:\nmix", None) and kinds[3][0] == "ARCHIVE_TEXT"
    photos = archives.with_images(parsed, archives.read_images(spark, path)).where("name = 'Old'").first()
    assert bytes(photos["photo_data"]) == b"image"
    whole, rest = restore(archives.entry_chunks(parsed))
    assert whole.count() == 2 and rest.count() == 3 and whole.first()["categories"] == ["Soup"]


def test_members_of_one_archive_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    path = archive(tmp_path / "a.zip", [(f"{i}.paprikarecipe", {"name": str(i), "notes": "x" * i}) for i in range(300)], [("7.paprikarecipe", b'{"name": "again"}'), ("p.jpg", b"image")])
    monkeypatch.setattr(archives, "TASK_BYTES", 4000)
    monkeypatch.setattr(archives, "SLICE_MEMBERS", 20)
    rows = archives.read_entries(spark, path)
    assert rows.rdd.getNumPartitions() > 4 and max(rows.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()) < 150
    got = {r["member_no"]: json.loads(r["entry"]) for r in rows.collect()}
    # of two members of one name each has its own content
    assert len(got) == 301 and all(got[i]["name"] == str(i) for i in range(300)) and got[300] == {"name": "again"}


def test_written_members_are_packed_by_tasks_and_listed_in_order(spark, tmp_path, monkeypatch):
    rows = spark.range(50, numPartitions=5).selectExpr("lpad(50 - id, 3, '0') as uid", "if(id % 2 = 0, 'Crème', concat('N', id)) as name", "0 as rating", "'{\"title\": 1}' as meta")
    seen = []
    real = archives._append
    monkeypatch.setattr(archives, "_append", lambda *a: seen.append(type(a[2])) or real(*a))
    path = str(tmp_path / "o.paprikarecipes")
    assert archives.write_archive(rows, path, meta_col="meta", order=["uid"]) == 50
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        entries = [json.loads(gzip.decompress(z.read(n))) for n in z.namelist()]
        assert [e["uid"] for e in entries] == sorted(e["uid"] for e in entries) and entries[0][archives.META_KEY] == {"title": 1}
        assert [n for n in z.namelist() if n.startswith("C")] == [f"Crème{f' {i}' if i > 1 else ''}.paprikarecipe" for i in range(1, 26)]
    assert len(seen) == 50 and set(seen) <= {bytes, bytearray}


def test_a_full_record_is_parsed_once_an_entry(spark, tmp_path):
    path = archive(tmp_path / "a.zip", [("1.paprikarecipe", {"name": "Soup", archives.META_KEY: META}), ("2.paprikarecipe", {"name": "x", archives.META_KEY: {"title": "no lists"}})])
    parsed = archives.parse_entries(archives.read_entries(spark, path)).select("name", "meta")
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
    assert {r["name"]: r["meta"] and r["meta"]["title"] for r in parsed.collect()} == {"Soup": "Soup", "x": None}


def test_not_an_archive(spark, tmp_path):
    (tmp_path / "x.zip").write_bytes(b"no zip")
    assert archives.read_entries(spark, str(tmp_path / "x.zip")).first()["member_no"] == -1


def test_merging(spark, tmp_path):
    a = archive(tmp_path / "a.zip", [("1", {"name": "Crème Brûlée"}), ("2", {"name": "Pie"})], [("3", b"junk")])
    b = archive(tmp_path / "b.zip", [("1", {"name": "creme brulee!"}), ("2", {"name": "Tart"})])
    got = archives.merge(spark, [a, b]).orderBy("archive_no", "member_no").collect()
    assert [(r["archive_no"], r["name"]) for r in got] == [(0, "Crème Brûlée"), (0, "Pie"), (1, "Tart")]
    with pytest.raises(ValueError):
        archives.merge(spark, [])


def test_round_trip(spark, tmp_path):
    text = "Onion Soup\n\nServings: 4\n\nIngredients\n2 onions\n1 l water\n\nMethod\n1. Chop the onions.\n2. Add water."
    chunks = spark.createDataFrame([("s", 0, text, "URL"), ("s", 1, "  ", "URL"), ("s", 2, "no recipe", "URL")], "source_id string, chunk_no int, text string, input_type string")
    made, errors = run_pipeline(chunks, {"Meal": ["Soup", "Cake"]})
    assert [r["error"] for r in errors.collect()] == ["ValueError: blank chunk"]
    record = made.first()
    assert record["title"] == "Onion Soup" and record["base_servings"] == 4 and record["categories"] == ["Soup"] and len(record["embedding"]) == 1536
    assert record["directions"][0]["text"] == "Chop the {{ing_01|2 onions}}."
    from tidemark.operators.records import export_rows

    full = archives.record_json(made.withColumn("recipe_id", F.lit("r1")).withColumn("source_url", F.lit(None).cast("string")).withColumn("image_url", F.lit(None).cast("string")))
    rows = export_rows(full, "2026-01-01 00:00:00").crossJoin(full.select("meta"))
    path = str(tmp_path / "out.paprikarecipes")
    assert archives.write_archive(rows, path, meta_col="meta") == 1
    back = archives.parse_entries(archives.read_entries(spark, path)).first()
    assert back["name"] == "Onion Soup" and back["directions"] == "Chop the 2 onions.\nAdd 1 l water."
    assert back["meta"]["structured_ingredients"][0]["fallback_string"] == "2 onions" and back["meta"]["embedding"] == record["embedding"]
    assert archives.write_archive(rows.limit(0), str(tmp_path / "none.zip")) == 0 and not (tmp_path / "none.zip").exists()


def test_a_chunk_is_atomic(spark):
    class Dangling(RuleProvider):  # local, so that it travels by value
        def refine(self, raw, weights=False):
            out = RuleProvider.refine(self, raw, weights)
            out["directions"].append({"step": 9, "text": "Use {{ing_99|x}}."})
            return out

    text = "A\nIngredients\n1 egg\nMethod\n1. Beat."
    chunks = spark.createDataFrame([("s", 0, text, "URL")], "source_id string, chunk_no int, text string, input_type string")
    made, errors = run_pipeline(chunks, provider=Dangling())
    assert made.count() == 0 and "ing_99" in errors.first()["error"]


def test_large_numbers_of_chunks_and_small_batches(spark):
    text = "Soup\nIngredients\n1 egg\nMethod\n1. Beat."
    chunks = spark.range(300).selectExpr("'s' as source_id", "id + 5000000000 as chunk_no", f"concat({text!r}, id % 2) as text", "'URL' as input_type").coalesce(1)
    made, errors = run_pipeline(chunks)
    assert made.agg(F.count("title"), F.min("chunk_no"), F.max("chunk_no"), F.min(F.size("embedding"))).first()[:] == (300, 5_000_000_000, 5_000_000_299, 1536)
    assert errors.count() == 0 and dict(made.dtypes)["chunk_no"] == "bigint"


def test_workers_hand_on_few_records_at_once(spark):
    sizes = []
    real = pa.RecordBatch.from_arrays

    class Frame:
        """Runs what ``mapInArrow`` is given here, on one batch of 1,000 chunks."""

        schema = spark.createDataFrame([], "source_id string, chunk_no int, text string, input_type string").schema

        def select(self, *_):
            return self

        def mapInArrow(self, work, _):  # noqa: N802
            text = "Soup\nIngredients\n1 egg\nMethod\n1. Beat."
            batch = real([pa.array(["s"] * 1000), pa.array(range(1000), pa.int32()), pa.array([text] * 1000), pa.array(["URL"] * 1000)], ["source_id", "chunk_no", "text", "input_type"])
            sizes.extend(b.num_rows for b in work(iter([batch])))
            return spark.createDataFrame([], pipeline_schema)

    pipeline_schema = f"source_id string, chunk_no int, recipe_no int, record {pipeline._DDL}, error string"
    run_pipeline(Frame())
    assert sum(sizes) == 1000 and max(sizes) <= 200


def test_conversion_to_weights():
    raw = {"name": "A", "ingredients": ["2 cups flour", "salt"], "directions": []}
    got = RuleProvider().refine(raw, weights=True)["ingredients"]
    assert (got[0]["converted_amount"], got[0]["converted_unit"], got[0]["is_ai_converted"]) == (250.0, "g", True) and got[1]["amount"] == 0.0


def test_epub(spark, tmp_path):
    path = tmp_path / "b.epub"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr("O/c.opf", '<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Cook</dc:title><dc:creator>Ann</dc:creator></metadata><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="i" href="i.png" media-type="image/png"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("O/a.xhtml", "<p>2 cups and 1 tbsp, stir</p><img src='i.png'/>")
        z.writestr("O/b.xhtml", "<p>Preface</p>")
        z.writestr("O/i.png", b"0" * 30000)
    (tmp_path / "bad.epub").write_bytes(b"x")
    got = books.read_epub(spark, str(tmp_path)).collect()
    assert [(r["chunk_no"], r["text"], r["source_url"]) for r in got] == [(1, "2 cups and 1 tbsp, stir\n[IMAGE: i.png]", "Cook — Ann")]
    assert books.read_epub_chapters(spark, str(tmp_path)).where("error is not null").count() == 1


def test_pages(spark):
    pages = spark.createDataFrame([("p", 1, "x" * 200), ("p", 2, " "), ("scan", 1, "")], "source_id string, page_no int, text string")
    assert [(r["source_id"], r["chunk_no"]) for r in books.pdf_chunks(pages).collect()] == [("p", 1)]
    images = spark.createDataFrame([("p", 1, 2, "png", b"0" * 30000), ("p", 1, 1, "jpeg", b"0" * 30000), ("p", 1, 3, "png", b"0")], "source_id string, page_no int, img_no int, extension string, content binary")
    got = books.mark_page_images(pages, images).where("source_id = 'p' and page_no = 1").first()["text"]
    assert got.startswith("[IMAGE: page1_img1.jpeg]\n[IMAGE: page1_img2.png]\nxxx")
    assert books.list_books(["b.pdf", "a.EPUB", "c.txt", "0.pdf"]) == ["a.EPUB", "0.pdf", "b.pdf"]


def test_taxonomy_files(spark, tmp_path):
    (tmp_path / "t.yaml").write_text("axes:\n  Meal: [Soup, null, 3]\n  Bad: x\n  Empty: []\ncategories:\n  - Plain\n  - Parent: [A, B]\n")
    assert taxonomy.load_axes(str(tmp_path / "t.yaml")) == {"Meal": ["Soup", "3"]} and taxonomy.load_axes("/nowhere") == {}
    rows = taxonomy.parse_categories({"categories": ["Plain", {"Parent": ["A", "B"]}, None]})
    assert rows == [("Plain", None), ("Parent", None), ("A", "Parent"), ("B", "Parent")]
    assert taxonomy.hierarchy_text(rows).splitlines()[-1] == "Parent > B" and taxonomy.leaf_names(rows + rows) == ["Plain", "Parent", "A", "B"]
    assert "Parent" in taxonomy.categories_yaml([("Plain", []), ("Parent", ["A"])])
    db = str(tmp_path / "c.sqlite")
    with sqlite3.connect(db) as con:
        con.execute("CREATE TABLE ZCATEGORY (Z_PK INTEGER, ZPARENT INTEGER, ZNAME TEXT)")
        con.execute("INSERT INTO ZCATEGORY VALUES (1, NULL, 'Meal'), (2, 1, 'Soup')")
    assert sorted((r["id"], r["parent_id"]) for r in taxonomy.read_database(spark, db).collect()) == [("1", None), ("2", "1")]
    with sqlite3.connect(str(tmp_path / "e.sqlite")) as con:
        con.execute("CREATE TABLE x (a INTEGER)")
    with pytest.raises(ValueError):
        taxonomy.read_database(spark, str(tmp_path / "e.sqlite"))
