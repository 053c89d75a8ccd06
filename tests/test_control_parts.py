import os

import pytest

from tidemark.errors import IllegalTransition, ProviderError
from tidemark.operators import toc
from tidemark.plans.limits import Limited, SlidingWindow, transition, with_retries
from tidemark.sources import tables


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.slept.append(round(s, 3))
        self.now += s


def test_window_waits_for_the_oldest_start():
    clock = Clock()
    window = SlidingWindow(2, 60, clock, clock.sleep)
    window.start()
    clock.now = 10
    window.start()
    assert window.count() == 2
    window.start()
    assert clock.now == pytest.approx(60) and clock.slept == [50.0] and window.count() == 2


def test_retries():
    clock, calls = Clock(), []

    def refuse():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("HTTP 429")
        return "ok"

    assert with_retries(refuse, lambda e: "429" in str(e), sleep=clock.sleep) == "ok" and clock.slept == [2.0, 4.0]
    with pytest.raises(ValueError):
        with_retries(lambda: int("x"), lambda e: False)
    with pytest.raises(ProviderError):
        with_retries(lambda: 1 / 0, lambda e: True, retries=1, sleep=clock.sleep)


def test_limited_provider_counts_refusals_in_a_row():
    clock = Clock()

    class Provider:
        dimensions, fail = 3, 4

        def embed(self, text):
            self.fail -= 1
            if self.fail >= 0:
                raise RuntimeError("quota")
            return [1.0]

    limited = Limited(Provider(), SlidingWindow(100, 60, clock, clock.sleep), sleep=clock.sleep)
    limited.provider.fail = 10
    with pytest.raises(ProviderError):
        limited.embed("x")
    assert limited.should_pause and limited.dimensions == 3
    limited.provider.fail = 0
    assert limited.embed("x") == [1.0] and not limited.should_pause


def test_transitions():
    assert transition("idle", "start") == "running" and transition("idle", "done") == "idle"
    with pytest.raises(IllegalTransition):
        transition("paused", "error", strict=True)


def test_toc(spark):
    entries = spark.createDataFrame([("a", i, f"T{i}") for i in range(4)] + [("b", 0, "Only")], "source_id string, pos int, title string")
    other = spark.createDataFrame([("a", 0, "X"), ("b", 0, "F0"), ("b", 1, "F1")], "source_id string, pos int, title string")
    assert sorted(r["title"] for r in toc.or_fallback(entries, other).collect()) == ["F0", "F1", "T0", "T1", "T2", "T3"]
    picks = spark.createDataFrame([("a", 2), ("a", 2), ("a", 9)], "source_id string, index int")
    assert sorted(r["title"] for r in toc.pick_entries(entries, picks).collect()) == ["Only", "T2", "T2"]
    assert {r["source_id"]: r["ratio"] for r in toc.recipe_ratio(entries, picks).collect()} == {"a": 0.5, "b": 0.0}
    chunks = spark.createDataFrame([("a", 1, "two"), ("a", 0, "one"), ("a", 2, "three")], "source_id string, chunk_no int, text string")
    assert toc.front_text(chunks).first()["text"] == "one\n\ntwo" and toc.front_text(chunks, limit=3, marker="!").first()["text"] == "one!"
    assert toc.book_text(chunks).first()["text"] == "one\n\ntwo\n\nthree"


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("1", "A"), ("2", "B")], "recipe_id string, title string")
    path = str(tmp_path / "t")
    tables.append_records(df, path)
    tables.append_records(df.where("recipe_id = '3'"), path)
    gone = spark.createDataFrame([("2",), ("9",)], "recipe_id string")
    assert [r["title"] for r in tables.without_records(spark, path, gone).collect()] == ["A"]
    cp = str(tmp_path / "cp")
    assert tables.load_checkpoint(spark, cp, "b", "h") is None
    tables.save_checkpoint(spark, cp, "b", "h", "EXTRACT", [0, 1])
    assert tables.load_checkpoint(spark, cp, "b", "h")["completed_segments"] == [0, 1] and tables.load_checkpoint(spark, cp, "b", "other") is None
    for i, name in enumerate(("x.db", "y.db")):
        (tmp_path / name).write_text("")
        os.utime(tmp_path / name, (i, i))
    assert tables.newest_file([str(tmp_path / "*.db")]).endswith("y.db") and tables.newest_file([str(tmp_path / "*.none")]) is None
