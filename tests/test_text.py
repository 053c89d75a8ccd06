import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar, text


def value(spark, column, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("given,want", [
    ("the joy of cooking", "The Joy of Cooking"), ("BBQ ribs", "BBQ Ribs"), ("slow-and-low pork", "Slow-And-Low Pork"), ("a", "A"), ("what to cook for", "What to Cook For"), ("  two   words ", "Two Words"),
    ("nyc-style bagels", "NYC-Style Bagels"), ("CHOCOLATE COOKIES", "Chocolate Cookies"), ("", ""), ("   ", "   "), ("pan-fried fish with rice", "Pan-Fried Fish with Rice"),
])
def test_title_case(spark, given, want):
    assert value(spark, text.title_case(F.col("t")), t=given) == want


@pytest.mark.parametrize("given,want", [
    ("Crème Brûlée", "creme brulee"), ("  Mac & Cheese! ", "mac cheese"), ("Pie", "pie"), ("ﬁne_ｔｕning", "fine_tuning"), ("!!!", ""), ("a b", "a b"),
])
def test_normal_name(spark, given, want):
    assert value(spark, text.normal_name(F.col("t")), t=given) == want


def test_names_and_lines(spark):
    assert value(spark, text.safe_file_name(F.col("t")), t="A/B: c?") == "AB c"
    assert value(spark, text.safe_file_name(F.col("t")), t="///") == "Untitled_Recipe"
    assert value(spark, text.split_lines(F.col("t")), t="a\n\n b\r\n  \nc") == ["a", " b", "c"]
    assert value(spark, text.match_key(F.col("t")), t="  A\t\nB ") == "a b"


def test_markdown_and_images(spark):
    md = "twitter:image: https://x/a.png))\n# Title\n![i](http://x/b.png) [go](http://y) **bold** _it_"
    assert value(spark, text.markdown_text(F.col("t")), t=md) == "Title\n go bold it"
    assert value(spark, text.image_url(F.col("t")), t=md) == "https://x/a.png)"
    assert value(spark, text.image_url(F.col("t")), t="![i](http://x/b.png)") == "http://x/b.png"
    assert value(spark, text.image_url(F.col("t")), t="none") is None


def test_html():
    source = "<html><style>p{}</style><script>1<2</script><h1> A &amp; B </h1><p>x<br>y</p><img src='i/p.png'><!-- no --></html>"
    assert text.parse_html(source) == "A & B\nx\ny"
    assert text.parse_html(source, None, True).endswith("[IMAGE: p.png]")
    assert text.parse_html(source, {"other.png"}, True) == "A & B\nx\ny"
    assert text.parse_html(None) is None and text.parse_html("") == ""


@pytest.mark.parametrize("prep,cook,want", [("10 mins", "20 mins", "30 mins"), ("1 hour", "15 min", "16 mins"), ("", "5", ""), (None, "5", ""), ("soon", "later", "")])
def test_total_time(spark, prep, cook, want):
    df = spark.createDataFrame([(prep, cook)], "p string, c string")
    assert df.select(scalar.total_time(F.col("p"), F.col("c"))).first()[0] == want


def test_tokens(spark):
    t = "Mix {{ing_01|2 cups flour}} and {{ing_02|salt}}."
    assert value(spark, scalar.strip_tokens(F.col("t")), t=t) == "Mix 2 cups flour and salt."
    assert value(spark, scalar.token_ids(F.col("t")), t=t) == ["ing_01", "ing_02"]
    assert value(spark, scalar.dangling_tokens(F.col("t"), F.array(F.lit("ing_01"))), t=t) == ["ing_02"]


def test_small_functions(spark):
    assert value(spark, scalar.strip_fence(F.col("t")), t="```json\n{}\n```") == "{}"
    assert value(spark, scalar.image_extension(F.col("t")), t="image/png; q=1") == "png"
    assert value(spark, scalar.image_extension(F.col("t")), t="x") == "jpg"
    assert value(spark, scalar.backoff_delays(8), t=1) == [2, 4, 8, 16, 32, 64, 120, 120]
    assert value(spark, scalar.first_given(F.lit(""), F.lit("b")), t=1) == "b"
    assert value(spark, scalar.content_hash(F.col("t")), t="abc") == "sha256:ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert value(spark, scalar.run_limits(F.lit(True), F.lit(7)), t=1).asDict() == {"rpm": 5, "workers": 1}
    assert value(spark, scalar.run_limits(F.lit(False), F.lit(70)), t=1).asDict() == {"rpm": None, "workers": 10}
