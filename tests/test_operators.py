import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import chunking, control, dedupe, filters, records


def test_candidates(spark):
    rows = [("a", "2 cups and 1 tbsp, stir"), ("a", "nothing"), ("b", "cupboard only"), ("b", None)]
    df = spark.createDataFrame(rows, "source_id string, text string")
    assert sorted(str(r["text"]) for r in filters.keep_candidates(df).collect()) == ["2 cups and 1 tbsp, stir", "None", "cupboard only"]
    assert filters.keep_candidates(df.limit(0)).count() == 0


@pytest.mark.parametrize("t,want", [("baker's percentage", True), ("Baker’s %", True), ("bakers %", False), ("bakery", False)])
def test_table_flag(spark, t, want):
    assert spark.createDataFrame([(t,)], ["t"]).select(filters.needs_table_normalisation(F.col("t"))).first()[0] is want


def test_preflight(spark):
    pages = [("short", i, "x") for i in range(3)] + [("ok", i, "y" * 200) for i in range(6)]
    got = {r["source_id"]: r["verdict"] for r in filters.preflight(spark.createDataFrame(pages, "source_id string, page_no int, text string")).collect()}
    assert got == {"short": "scanned", "ok": "ok"}


def brute_pack(text, limit):
    if len(text) <= limit:
        return [text]
    parts, cur, size = [], [], 0
    for p in text.split("\n\n"):
        if size + len(p) + 2 > limit and cur:
            parts.append("\n\n".join(cur))
            cur, size = [], 0
        cur.append(p)
        size += len(p) + 2
    return parts + ["\n\n".join(cur)]


@pytest.mark.parametrize("t", ["", "a", "a" * 50, "aa\n\nbb\n\ncc\n\n" + "d" * 40 + "\n\ne", "\n\n\n\n" * 8])
def test_packing(spark, t):
    assert spark.createDataFrame([(t,)], ["t"]).select(chunking.pack_paragraphs(F.col("t"), 12)).first()[0] == brute_pack(t, 12)


def test_segments(spark):
    text = "intro\nApple  Pie\nbody one\nPear Tart\nbody two\nApple pie again"
    df = spark.createDataFrame([("b", text, ["Missing", " Pear  tart", "apple pie", None, ""])], "source_id string, text string, titles array<string>")
    got = [(r["segment_no"], r["segment"]) for r in chunking.segment_by_titles(df).orderBy("segment_no").collect()]
    assert got == [(0, "Pear Tart\nbody two"), (1, "Apple pie again")]


def test_leaves_and_hero(spark):
    toc = spark.createDataFrame([("b", "1", None, 0, "Part"), ("b", "2", "1", 1, "A"), ("b", "3", "1", 2, "B"), ("c", "1", None, 0, "Only")], "source_id string, entry_id string, parent_id string, pos int, title string")
    assert sorted(r["title"] for r in chunking.leaf_entries(toc).collect()) == ["A", "B", "Only"]
    chunks = spark.createDataFrame([("b", 1, "[IMAGE: h.png] short"), ("b", 2, "recipe"), ("b", 3, "other")], "source_id string, chunk_no int, text string")
    got = {r["chunk_no"]: r["text"] for r in chunking.carry_hero_images(chunks).collect()}
    assert got[2].startswith("[HERO IMAGE: h.png]\n") and got[3] == "other"


def test_dedupe_and_merge(spark):
    df = spark.createDataFrame([(2, "b", "X"), (1, "a", "x "), (3, "c", None), (4, "d", None)], "pos int, v string, name string")
    got = {r["pos"] for r in dedupe.first_wins(df, F.lower(F.trim("name")), "pos").collect()}
    assert got == {1, 3}
    one = spark.createDataFrame([(5, "A")], "member_no int, name string")
    two = spark.createDataFrame([(1, "a"), (2, "b")], "member_no int, name string")
    merged = dedupe.merge_archives([one, two], F.lower("name"))
    assert sorted((r["archive_no"], r["name"]) for r in merged.collect()) == [(0, "A"), (1, "b")]
    with pytest.raises(ValueError):
        dedupe.merge_archives([], F.lit(1))


def test_reconcile(spark):
    schema = "source_id string, pos int, title string"
    a = spark.createDataFrame([("s", 1, "Pie"), ("s", 2, "Tart"), ("s", 3, " pie "), ("s", 4, " ")], schema)
    b = spark.createDataFrame([("s", 1, "PIE"), ("s", 2, "Cake")], schema)
    got = dedupe.reconcile(a, b)
    assert sorted((r["status"], r["title"], r["pos"]) for r in got.collect()) == [("extra", "Cake", 2), ("matched", " pie ", 1), ("missing", "Tart", 2)]
    assert dedupe.match_ratio(got).first()["ratio"] == 0.5


@pytest.mark.parametrize("stretch", [60, 61, 3600])
def test_request_window(spark, stretch):
    t = datetime(2025, 1, 1)
    starts = spark.createDataFrame([("k", t + timedelta(seconds=s), s) for s in (0, 30, 59, 60, 61, 200, 259, 260)], "key string, ts timestamp, id int")
    got = [r["in_window"] for r in control.request_window(starts, 60, 2, stretch).orderBy("id").collect()]
    assert got == [1, 2, 3, 3, 3, 1, 2, 2] or got == [sum(1 for x in (0, 30, 59, 60, 61, 200, 259, 260) if s - 60 < x <= s) for s in (0, 30, 59, 60, 61, 200, 259, 260)]


@pytest.mark.parametrize("stretch", [1, 3, 7, 1000])
def test_error_runs(spark, stretch):
    t, flags = datetime(2025, 1, 1), [1, 1, 1, 0, 1, 1, 1, 1, 1, 0, 0, 1, None, 1, 1]
    rows = [("k", t + timedelta(seconds=i), i, None if e is None else bool(e)) for i, e in enumerate(flags)] + [(None, t, 0, True), (None, t + timedelta(seconds=9), 1, True)]
    got = control.error_runs(spark.createDataFrame(rows, "key string, ts timestamp, id int, is_error boolean"), 3, stretch).orderBy("id").collect()
    want, run = [], 0
    for e in flags:
        run = run + 1 if e else 0
        want.append((run, run >= 3))
    assert [(r["run"], r["pause"]) for r in got if r["key"] == "k"] == want
    assert [r["run"] for r in got if r["key"] is None] == [1, 2]


@pytest.mark.parametrize("stretch", [1, 2, 100])
def test_replay(spark, stretch):
    t, names = datetime(2025, 1, 1), ["pause", "start", "pause", "paused", "error", "resume", "running", "done", "start"]
    rows = [("k", t + timedelta(seconds=i), i, e) for i, e in enumerate(names)] + [("other", t, 0, "done")]
    got = {r["key"]: (r["state"], r["ignored"]) for r in control.compose_replay(spark.createDataFrame(rows, "key string, ts timestamp, id int, event string"), stretch).collect()}
    assert got == {"k": ("running", 2), "other": ("idle", 1)}


def test_jobs_and_resume(spark):
    jobs = spark.createDataFrame([("a", "running"), ("b", "done")], "job_id string, status string")
    assert {r["job_id"]: (r["status"], r["error_message"]) for r in control.fail_orphans(jobs).collect()} == {"a": ("error", "orphaned"), "b": ("done", None)}
    chunks = spark.createDataFrame([("s", 1), ("s", 2)], "source_id string, chunk_no int")
    assert [r["chunk_no"] for r in control.resume(chunks, chunks.where("chunk_no = 1"), "source_id", "chunk_no").collect()] == [2]
    saved = spark.createDataFrame([("p", "h", 1), ("p", "old", 1), ("p", "h", 2)], "book_path string, book_hash string, version int")
    assert control.valid_checkpoints(saved, saved.limit(1)).count() == 1


def test_tags_and_routes(spark):
    df = spark.createDataFrame([({"Meal": ["Soup", "Bad", "Soup"], "Other": ["X"]},)], "grid map<string,array<string>>")
    got = df.select(records.keep_allowed_tags(F.col("grid"), {"Diet": ["Vegan"], "Meal": ["Soup", "Salad"]})).first()[0]
    assert got == {"Meal": ["Soup", "Soup"]}
    assert df.select(records.keep_allowed_tags(F.col("grid"), {})).first()[0] == {}
    assert df.select(F.size(records.flat_tags(F.col("grid")))).first()[0] == 4
    kinds = spark.createDataFrame([("ARCHIVE_RECORD", [0.1]), ("ARCHIVE_RECORD", []), ("ARCHIVE_RECORD", None), ("PDF", None)], "k string, e array<float>")
    routes = [r[0] for r in kinds.select(records.route(F.col("k"), F.col("e"))).collect()]
    assert routes == ["ASSEMBLE", "ASSEMBLE", "EMBED,ASSEMBLE", "EXTRACT,REFINE,CATEGORIZE,EMBED,ASSEMBLE"]


def test_verify_rows(spark):
    stored = spark.createDataFrame([("a", "A", 2, [0.0] * 1536), ("b", "B", 1, None), ("c", "C", 1, [0.0])], "recipe_id string, title string, ingredients int, embedding array<float>")
    expected = spark.createDataFrame([("a", "A", 2), ("b", "X", 2), ("c", "C", 1), ("d", "D", 0)], "recipe_id string, title string, ingredients int")
    got = {r["recipe_id"]: r["errors"] for r in records.verify_rows(stored, expected).collect()}
    assert got == {"a": [], "b": ["title", "ingredient count", "embedding missing"], "c": ["embedding length"], "d": ["not found"]}


def test_hashes_cover_long_and_multibyte_texts(spark, tmp_path):
    from tidemark.plans.catalogue import content_hashes

    texts = ["short", "", "x" * 65_536, "x" * 70_000, "é" * 40_000, "a" + "é" * 40_000]
    rows = [(i, "s", i, t, "PDF") for i, t in enumerate([*texts, None])]
    spark.createDataFrame(rows, "chunk_id bigint, source_id string, chunk_no int, text string, input_type string").write.parquet(f"{tmp_path}/chunks.parquet")
    got = {r["chunk_id"]: (r["content_hash"], r["file_id"]) for r in content_hashes(spark, str(tmp_path)).collect()}
    want = [hashlib.sha256(t.encode()[:65_536]).hexdigest() for t in texts]
    assert got == {i: (f"sha256:{h}", h[:16]) for i, h in enumerate(want)}


def test_merge_takes_every_language(spark, tmp_path):
    from tidemark.plans.catalogue import merge_archives

    rows = [(1, "Pear Tart", "es"), (2, "pear  tart", "fr"), (3, "Flan", "es"), (4, "flan", None), (5, "Soup", None), (6, None, "en"), (7, "Soup", "en")]
    spark.createDataFrame(rows, "doc_id bigint, title string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in merge_archives(spark, str(tmp_path)).collect()} == {(2, 2), (3, 3), (0, 7)}
