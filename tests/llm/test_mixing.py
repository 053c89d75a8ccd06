import pytest

from tidemark.llm.mixing import count_tokens, mix_sources

SIZED = "id bigint, source string, tokens bigint, rate string, n int"
TARGETS = "source string, target_share double, max_repeats int, cap string"


def mixed(spark, sized, targets, **kw):
    return mix_sources(spark.createDataFrame([(*r, "x", 1) for r in sized], SIZED), spark.createDataFrame([(*t, "x") for t in targets], TARGETS), **kw)


def test_shares_caps_and_missing_sources(spark):
    sized = [(i, "a", 50 + i % 90) for i in range(600)] + [(1000 + i, "b", 80 + i % 7) for i in range(40)] + [(2000, "c", 100), (3000, None, 10), (3001, "a", 0)]
    m = mixed(spark, sized, [("a", 0.5, 1), ("b", 0.3, 3), ("gone", 0.2, 2)])
    shares = {r["source"]: r for r in m.shares.collect()}
    assert shares["a"]["actual_share"] == pytest.approx(0.625, abs=0.01) and shares["b"]["actual_share"] == pytest.approx(0.375, abs=0.01) and shares["gone"]["actual_share"] == 0
    uses = m.uses.collect()
    assert len(uses) == len(sized) and {r["uses"] for r in uses if r["source"] == "b"} == {3} and max(r["uses"] for r in uses if r["source"] == "a") == 1
    assert all(r["uses"] == 0 for r in uses if r["source"] in (None, "c") or r["tokens"] == 0)


def test_a_given_total_and_one_hot_length(spark):
    sized = [(i, "a", 100) for i in range(12_000)] + [(20_000 + i, "b", 60 + i % 80) for i in range(2_000)]
    m = mixed(spark, sized, [("a", 0.8, 2), ("b", 0.2, 2)], total=200_000)
    got = {r["source"]: r["used_tokens"] for r in m.shares.collect()}
    assert got["a"] == pytest.approx(160_000, abs=200) and got["b"] == pytest.approx(40_000, rel=0.02)


def test_empty_inputs(spark):
    assert mixed(spark, [], [("a", 1.0, 1)]).shares.first()["actual_share"] == 0.0
    assert [r["uses"] for r in mixed(spark, [(1, "a", 5)], []).uses.collect()] == [0]


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world", "Recipe-Blog "), (2, None, None), (3, "", "x"), (1, "hello world", "Recipe-Blog "), (4, "<|endoftext|>", "x")], "doc_id bigint, text string, source string")
    got = {r["id"]: (r["source"], r["tokens"]) for r in count_tokens(df, "doc_id", "text", "source").collect()}
    assert got[1] == ("recipe_blog", 2) and got[2] == (None, 0) and got[3] == ("x", 0) and got[4][1] > 1
