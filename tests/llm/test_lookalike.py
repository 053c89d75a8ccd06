import pytest

from tidemark.llm.lookalike import Speller, letter_bigrams, normalise, record_texts, unify

WORDS = "olive oil salt black pepper tomato passata сок соль перец салат с редисом и μέλι ελιές".split()


def speller():
    pairs = {}
    for w in WORDS:
        t = f"^{w}$"
        for a, b in zip(t, t[1:]):
            pairs[a + b] = pairs.get(a + b, 0) + 5
    return Speller(pairs)


@pytest.mark.parametrize("text,form", [
    ("ｏｌｉｖｅ　ｏｉｌ", "olive oil"), ("sa­lt", "salt"), ("2 tsp", "2 tsp"), ("sаlt", "salt"), ("tomаtο рassata", "tomato passata"), ("𝐬𝐚𝐥t", "salt"), ("ﬁne ﬂour", "fine flour"),
    ("crème", "crème"), ("﻿oil", "oil"), ("1⁄2 cup", "1/2 cup"), ("oi​l", "oil"), ("ϲream", "cream"), ("a\u0007b", "ab"), ("сaлат", "салат"),
])
def test_odd(text, form):
    assert normalise(text, speller()) == (form, True)


@pytest.mark.parametrize("text", [
    "plain text", "crème fraîche", "салат с редисом", "μέλι", "味噌のスープ", "きのこ、ご飯", "• 1 – 2 “x” «y» …", "a\tb\r\nc", "½ cup", "250 °C", "µg", "naïve", "", "सत्य", "الملح", "فارسی‌ها", "👨‍👩‍👧", "❤️", "Tシャツ", "鸡肉，切块",
])
def test_ordinary(text):
    assert normalise(text, speller()) == (text, False)


def test_operator(spark):
    schema = "extraction_id bigint, name string, ingredients array<string>, pos string, field int, text string"
    rows = [(1, "sаlt", ["oil", None, "o​il"], "x", 1, "y"), (1, "sаlt", ["oil", None, "o​il"], "x", 1, "y"), (2, None, None, "", 0, ""), (3, "", [], "", 0, ""), (None, "sаlt", None, "", 0, ""), (4, "salt " * 50_000, ["ｘ" * 50_000], "", 0, "")]
    texts = record_texts(spark.createDataFrame(rows, schema), "extraction_id", "name", "ingredients")
    bigrams = letter_bigrams(texts, "text")
    got = unify(texts, "text", bigrams).distinct()
    assert sorted(map(tuple, got.where("odd").select("id", "field", "pos").collect())) == [(1, "ingredients", 3), (1, "name", 0), (4, "ingredients", 1)]
    assert {r["form"] for r in got.where("id = 1").collect()} == {"salt", "oil"}
    empty = record_texts(spark.createDataFrame([], schema), "extraction_id", "name", "ingredients")
    assert unify(empty, "text", letter_bigrams(empty, "text")).count() == 0
