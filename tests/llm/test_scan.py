import pytest

from tidemark.llm.scan import confusion_key, find_noise, may_be_misread, page_value, read_number, rebuild_text, repair, roman, title_key

CHUNKS = "chunk_id bigint, source_id string, chunk_no int, text string, input_type string, label string, word string"
CLEAN = " ".join(["Add the flour and the butter to a cast-iron pan, then season with salt. Melt one part of the self-raising flour before serving."] * 30)


def page(no, *lines):
    return (no, "bk", no, "\n".join(lines), "PDF", "x", "y")


PAGES = [
    page(1, "The Quiet Spoon   1", "", "Add the flour and the but-", "ter to a cast-", "iron pan, fhen season", "with salt."),
    page(2, "2", "The Quiet Spoon", "", "Melt one part of the f1our", "before serving. Add salt¬", "y butter and season", "with self-", "raising flour."),
    page(3, "The Quict Spoon", "Pear Tart", "", "1Z0 g flour", "I/4 cup salt", "24", "I tsp salt", "2 cups butter", "", "3"),
    page(4, "The Quiet Spoon", "", "Season with salt and", "serve the butter.", "", "- 4 -"),
]


def noise(spark, rows):
    df = spark.createDataFrame(rows + [(99, "bk2", 1, CLEAN, "EPUB", "", "")], CHUNKS)
    return df, {(r["chunk_id"], r["line_no"]): {q["kind"] for q in find_rows if (q["chunk_id"], q["line_no"]) == (r["chunk_id"], r["line_no"])} for find_rows in [find_noise(df)[0].collect()] for r in find_rows}


def test_lines(spark):
    df, got = noise(spark, PAGES + [PAGES[0], (50, None, None, None, "PDF", None, None), (51, "bk", 9, "", "PDF", "", ""), (52, "bk", 8, "word " * 40_000, "PDF", "", "")])
    assert got == {
        (1, 1): {"header"}, (1, 3): {"hyphen"}, (1, 5): {"char"}, (2, 1): {"page"}, (2, 2): {"header"}, (2, 4): {"char"}, (2, 5): {"hyphen"},
        (3, 1): {"header"}, (3, 4): {"char"}, (3, 5): {"char"}, (3, 7): {"char"}, (3, 10): {"page"}, (4, 1): {"header"}, (4, 6): {"page"},
    }
    text = {r["chunk_id"]: r["text"] for r in repair(df).collect()}
    assert text[1] == "Add the flour and the butter to a cast-iron pan, then season with salt."


def test_empty_table(spark):
    assert find_noise(spark.createDataFrame([], CHUNKS))[0].count() == 0


@pytest.mark.parametrize("text,want", [("xii", 12), ("iv", 4), ("xl", 40), ("abc", None), ("", None), ("iiii", None)])
def test_roman(text, want):
    assert roman(text) == want


def test_small_parts():
    assert page_value("2l") == [21] and page_value("x") == [10]
    assert title_key("20   My Hollow Sp0on")[2] == "20" and title_key("MY TABLE | xii")[2] == "xii"
    assert title_key("Add the flour to the pan") is None and title_key("2 cups flour") is None and title_key("[IMAGE: a.png]") is None
    for wrong, right in (("rnore", "more"), ("vvith", "with"), ("s@lt", "salt"), ("uritil", "until"), ("garhc", "garlic"), ("moclerate", "moderate"), ("fhree", "three"), ("h0ur5", "hours")):
        assert may_be_misread(wrong, right) and confusion_key(wrong) == confusion_key(right)
    assert not may_be_misread("more", "more") and not may_be_misread("rnore", "mare") and may_be_misread("rn" * 30 + "ab", "m" + "rn" * 29 + "ab")
    assert rebuild_text("a\n\nb", set(), {}) == "a\n\nb"


def test_every_line_with_misread_characters_is_repaired(spark):
    rows = PAGES + [
        page(5, "Pear Tart", "", "l 1/2 tsp salt", "25O g flour", "I cup butter", "16oz flour", "I 1/Z cups flour, 2S0 ml", "", "Add the f1-", "our and season with but-", "tcr. Serve se1f-", "raising f1our", "", "5"),
        page(6, "Melt the flo-", "ur and the 8ut-", "ter with the fl0-", "ur. Season the bu-", "", "Add butter and sea-", "s0n with the flo-", "ur."),
    ]
    df, got = noise(spark, rows)
    fixes = {(r["chunk_id"], r["line_no"]) for r in find_noise(df)[1].collect() if r["word"] != r["right"]}
    assert {k for k, kinds in got.items() if "char" in kinds} == fixes
    text = {r["chunk_id"]: r["text"] for r in repair(df).collect()}
    assert text[3] == "Pear Tart\n\n120 g flour\n\n1/4 cup salt\n\n24\n\n1 tsp salt\n\n2 cups butter"
    assert text[5].split("\n\n") == [
        "Pear Tart", "1 1/2 tsp salt", "250 g flour", "1 cup butter", "16oz flour", "1 1/2 cups flour, 250 ml", "Add the flour and season with butter. Serve self-raising flour",
    ]
    assert text[6] == "Melt the flour and the butter with the flour. Season the bu\n\nAdd butter and season with the flour."


@pytest.mark.parametrize("read,printed", [("l/2", "1/2"), ("25O", "250"), ("1Z0", "120"), ("I,S", "1,5"), ("25Ol", "250l"), ("16oz", "16oz"), ("1/2lb", "1/2lb"), ("1/l", "1/1"), ("B6|", "861")])
def test_numbers(read, printed):
    assert read_number(read) == printed
