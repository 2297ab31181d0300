"""Moves that are stopped anywhere between their writes, and repeated."""

import pytest
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from newsloom.operators import commits as c

PENDING = "link long, title string, source_name string, fetched_at timestamp_ntz, attempt_count int"
PUBLISHED = "link long, title string, source_name string, telegraph_url string, published_at timestamp_ntz, via_review boolean"
FAILED = "link long, title string, source_name string, last_error string, failed_at timestamp_ntz, original_fetched_at timestamp_ntz"
PROCESSED = "link long, title string, processed_at timestamp_ntz"


def now():
    return F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")


@pytest.fixture
def tables(spark, tmp_path):
    out = c.Tables(spark, str(tmp_path))
    rows = spark.range(1, 7).selectExpr("id link", "concat('t', id) title", "'s' source_name", "timestamp_ntz'2024-01-01' fetched_at", "2 attempt_count")
    empty = {n: c.Replace(spark.createDataFrame([], s)) for n, s in (("published", PUBLISHED), ("failed", FAILED), ("processed", PROCESSED))}
    assert out.commit("begin", {"pending": c.Replace(rows), **empty})
    return out


def links(tables):
    return {n: sorted(r.link for r in tables.read(n).select("link").collect()) for n in ("pending", "published", "failed", "processed")}


def done(spark, *ids):
    return spark.createDataFrame([(i, "u", False) for i in ids], "link long, telegraph_url string, via_review boolean")


@pytest.mark.parametrize("writes", [0, 1, 2])
def test_a_stop_between_writes_changes_nothing_and_can_be_repeated(spark, tables, monkeypatch, writes):
    before = links(tables)
    reader = DataFrame.write.fget
    seen = []

    def failing(self):
        seen.append(1)
        if len(seen) > writes:
            raise OSError("stopped")
        return reader(self)

    monkeypatch.setattr(DataFrame, "write", property(failing))
    with pytest.raises(OSError):
        c.publish(tables, "p1", done(spark, 1, 2), now())
    monkeypatch.undo()
    assert links(tables) == before and len(tables.unused()) == writes
    assert c.publish(tables, "p1", done(spark, 1, 2), now())
    after = {"pending": [3, 4, 5, 6], "published": [1, 2], "failed": [], "processed": [1, 2]}
    assert links(tables) == after
    assert not c.publish(tables, "p1", done(spark, 1, 2), now())
    assert links(tables) == after


def test_a_stop_before_the_rename(spark, tables, monkeypatch):
    before = links(tables)
    monkeypatch.setattr(c.Tables, "_publish", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        c.fail(tables, "f1", spark.createDataFrame([(3, "e")], "link long, last_error string"), now())
    monkeypatch.undo()
    assert links(c.Tables(spark, tables.root)) == before and len(tables.unused()) == 2


def test_all_moves_one_after_the_other(spark, tables):
    assert c.fail(tables, "f", spark.createDataFrame([(3, "e"), (4, "e")], "link long, last_error string"), now())
    assert c.retry(tables, "r", spark.createDataFrame([(4,), (9,)], "link long"), now())
    assert c.skip(tables, "s", spark.createDataFrame([(5,)], "link long"), now())
    assert c.publish(tables, "p", done(spark, 6, 6, 77), now())
    assert links(tables) == {"pending": [1, 2, 4], "published": [6, 77], "failed": [3], "processed": [5, 6, 77]}
    assert {r.link: r.attempt_count for r in tables.read("pending").collect()} == {1: 2, 2: 2, 4: 0}
    assert links_of(tables, 1) == [1, 2, 3, 4, 5, 6]  # older versions stay readable
    assert tables.version() == 5 and tables.manifest()["operations"] == ["begin", "f", "r", "s", "p"] and tables.unused() == []


def links_of(tables, version):
    return sorted(r.link for r in tables.read("pending", version).collect())


def test_two_writers_from_one_version(spark, tables):
    at = tables.version()
    assert c.skip(tables, "a", spark.createDataFrame([(1,)], "link long"), now())
    with pytest.raises(c.Conflict):
        tables.commit("b", {"pending": c.Replace(tables.read("pending", at))}, at)
    assert links(tables)["pending"] == [2, 3, 4, 5, 6]
