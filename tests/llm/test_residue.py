import pytest
from pyspark.sql import functions as F

from tidemark.llm.residue import exclude_residue, has_placeholder


@pytest.mark.parametrize("text", [
    "{{name}}", "Dear {{ recipe.cook_time }},", "{{{stepText}}}", "{{ing_03|}}", "By {category}", "${firstName}", "#{recipe_title}", "<%= site_name %>", "{% include yield %}", "%(site_name)s", "%PHOTO_CAPTION%",
    "@@YIELD@@", "__RECIPE_TITLE__", "<<AUTHOR NAME>>", "[[step_text]]", "[Your cook time here]", "[cook time goes here]", "[INSERT STEP TEXT]", "&lt;first_name&gt;", "<recipe_title>",
])
def test_placeholders(spark, text):
    assert spark.createDataFrame([("good text " + text + " more",)], ["t"]).select(has_placeholder(F.col("t"))).first()[0]


@pytest.mark.parametrize("text", [
    "{{ing_01|2 tsp salt}}", "[IMAGE: page1_img2.png]", "Use 70% cocoa [optional] and 50% cream", "a < b > c", "&lt;b&gt;bold&lt;/b&gt;", "<strong>x</strong>", "set {1, 2}", "> quoted", "100%", "__init__", "5% or 10% off",
])
def test_no_placeholders(spark, text):
    assert not spark.createDataFrame([(text,)], ["t"]).select(has_placeholder(F.col("t"))).first()[0]


REAL = "Whisk the eggs into the flour slowly so that nothing splits."
BAD = [
    "404 Not Found\n\nBack to the kitchen.", "Spoonbox – menu – search – log in\n\nPágina no encontrada\n\nLa receta que buscas ya no está disponible.", "Please enable JavaScript to view this recipe.\n\nLoading…",
    "TODO add method\nTBD\nIngredient 1\nto be written", "Coming soon.", "asdf qwer test blah asdf", "Heading goes here\n\nThis is sample text for the recipe page.", "Oops! We burned this one.\n\nWe can't find that recipe. Request id 364b6bbe",
    "Zubor kelim nator. Zubor kelim nator. Zubor kelim nator.",
]
GOOD = [
    REAL, f"Please enable JavaScript to view this recipe.\n{REAL}", f"For weeks the link to this page gave a 404 not found error, so I typed it out.\n{REAL}", "", "   ", "Menu", "My first draft still said lorem ipsum where the story should be.",
]


def test_operator(spark):
    lorem = ["Lorem ipsum santum perelo vestra donec calum.", "Lorem ipsum perelo santum calum donec nolit vestra.", "Lorem ipsum donec vestra santum calum perelo nolit.", "santum perelo calum donec vestra santum perelo nolit donec calum."]
    rows = [(i, t) for i, t in enumerate(BAD + lorem)] + [(100 + i, t) for i, t in enumerate(GOOD)] + [(200, None), (None, BAD[0]), (0, BAD[0])]
    df = spark.createDataFrame([(i, t, None if i is None or i % 2 else "https://a.example/x", "k", 1) for i, t in rows], "doc_id bigint, text string, url string, key string, id int")
    got = {r["id"] for r in exclude_residue(df, "doc_id", "text", "url").collect()}
    assert got == set(range(len(BAD + lorem)))
    assert exclude_residue(df.limit(0), "doc_id", "text", "url").count() == 0


def test_recurrent_lines_of_error_pages_are_no_content(spark):
    line = "Our cooks have taken this page away for a while"
    rows = [(i, f"404 Not Found\n{line}") for i in range(5)] + [(50, f"{REAL}\nNote: the video needs JavaScript.")]
    df = spark.createDataFrame([(i, t, "https://a.example/x") for i, t in rows], "doc_id bigint, text string, url string")
    assert {r["id"] for r in exclude_residue(df, "doc_id", "text", "url").collect()} == set(range(5))


def test_navigation_of_a_host_is_no_content(spark):
    nav = "Recipes Menus Shop Newsletter"
    rows = [(i, f"{nav}\nWe baked loaf number {'x' * i} for the whole village today.") for i in range(60)]
    rows += [(100 + i, f"{nav}\n404 Not Found") for i in range(5)]
    # copies of one real page, some with a notice, are content
    rows += [(200 + i, REAL + ("\nPlease enable JavaScript to view this recipe." if i < 3 else ""), "https://b.example/x") for i in range(8)]
    df = spark.createDataFrame([(*r, "https://a.example/x")[:3] for r in rows], "doc_id bigint, text string, url string")
    assert {r["id"] for r in exclude_residue(df, "doc_id", "text", "url").collect()} == set(range(100, 105))


def test_a_long_sentence_repeated_is_filler(spark):
    line = "Zubor kelim " + "nator " * 165 + "fin."
    df = spark.createDataFrame([(1, " ".join([line] * 3), None), (2, line, None), (3, "\n".join([line[:-1]] * 4), None)], "doc_id bigint, text string, url string")
    assert {r["id"] for r in exclude_residue(df, "doc_id", "text", "url").collect()} == {1, 3}
