import random
import re
import unicodedata

from pyspark.sql import functions as F

from tidemark.llm.canonical import canonical_text, collapse, find_copies, fingerprint_records

SCHEMA = "extraction_id bigint, name string, ingredients array<string>, id string, h1 string, keep_id int"


def brute(text):
    def kind(c):
        category = unicodedata.category(c)
        return "d" if category[0] == "N" else "w" if category[0] == "L" or category in ("Mn", "Mc") else "o"

    t = re.sub(r"\s+", " ", unicodedata.normalize("NFC", text).casefold())
    out, i = "", 0
    while i < len(t):
        if kind(t[i]) != "o":
            out += t[i]
            i += 1
            continue
        j = i
        while j < len(t) and kind(t[j]) == "o":
            j += 1
        if i and j < len(t) and kind(t[i - 1]) == kind(t[j]) == "d":
            out += t[i:j]
        i = j
    return out


def pairs(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    return sorted(map(tuple, find_copies(df, "extraction_id", "name", "ingredients").collect()))


def test_formatting_does_not_count(spark):
    rows = [
        (3, "Oat Pie", ["1 1/2 cups oats", "2 eggs"]), (1, "*OAT  pie!*", ["• 2 Eggs", "1  1/2 cups (oats)", " ", None, "***"]), (2, "Oat-Pie", ["2 eggs", "1 1/2 cups oats"]),
        (4, "Oat Pie", ["11/2 cups oats", "2 eggs"]), (5, "Oat Pie", ["1 1 2 cups oats", "2 eggs"]), (6, "Oat Pie", ["1 1/2 cups oats", "2 eggs", "2 eggs"]), (6, "Oat Pie", ["1 1/2 cups oats", "2 eggs", "2 eggs"]),
    ]
    assert pairs(spark, rows) == [(1, 2), (1, 3)]


def test_accents_count_composed_or_not(spark):
    rows = [(1, "Purée", ["salt"]), (2, "Purée", ["salt"]), (3, "Puree", ["salt"]), (4, "Groß", ["salt"]), (5, "GROSS", ["salt"])]
    assert pairs(spark, rows) == [(1, 2), (4, 5)]


def test_unusable_records_and_empty_tables(spark):
    rows = [(1, None, ["a"]), (2, "x", None), (3, "x", []), (4, "!!", ["a"]), (5, "x", ["--"]), (None, "x", ["a"]), (7, "x", ["a" * 200_000]), (8, "X", ["A" * 200_000])]
    assert pairs(spark, rows) == [(7, 8)]
    assert pairs(spark, []) == []


def test_counts(spark):
    df = spark.createDataFrame([(i, "A", ["b"], "", "", 1) for i in (5, 3, 3, 9)], SCHEMA)
    got = collapse(fingerprint_records(df, "extraction_id", "name", "ingredients")).collect()
    assert [(r["keep_id"], r["copies"]) for r in got] == [(3, 3)]


def test_canonical_text_matches_brute_force(spark):
    rng = random.Random(8)
    texts = [unicodedata.normalize("NFC", "".join(rng.choice("aZé1/ .,-½é\t ßSıI•中²") for _ in range(rng.randrange(15)))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["k"] for r in df.select("i", canonical_text(F.col("t")).alias("k")).collect()}
    assert [got[i] for i in range(len(texts))] == [brute(t) for t in texts]
