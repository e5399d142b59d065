"""Pushes as a stream against one batch, restarts, and several writers of one folder."""

from datetime import datetime, timedelta

import pytest

from tests.test_flows import BASE, COPY, package
from weftline.plans import update
from weftline.sources import sinks
from weftline.streaming import pushes

SCHEMA = "doc_id string, change_id string, time timestamp, json string"
START = datetime(2024, 1, 1)
WHEN = "2024-01-01 00:00 UTC"


def row(doc, minute, path="src/loader.py", name=None):
    return (doc, name or f"{doc}-{minute:04d}", START + timedelta(minutes=minute), package(path))


def write(spark, rows, folder, n):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(f"{folder}/{n}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").json(folder)


@pytest.fixture
def documents(spark):
    """Small shuffles, for state has a store for each partition."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield _documents(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def _documents(spark):
    return spark.createDataFrame([("a", BASE, None), ("b", BASE, COPY), ("c", "no headings\n", None)], "doc_id string, baseline string, updated string")


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_out_of_order_and_repeated_packages_over_a_restart(spark, tmp_path, documents):
    folder, root, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    pushes.begin(spark, documents, root)
    batches = [
        [row("a", 5), row("b", 3), row("a", 1), row("c", 4), row("a", 5), row("a", 2, "tests/test_x.py")],  # out of order, and one twice
        [row("b", 2), row("b", 3), row("a", 500), row("a", 4), row("b", 501)],  # two that are late or again
        [row("zz", 5000)],  # lets everything before it leave
    ]
    for n, rows in enumerate(batches):
        write(spark, rows, folder, n)
        pushes.run(stream(spark, folder), root, checkpoint, "10 minutes", WHEN).awaitTermination()

    results = sinks.current(spark, root, "results").collect()
    ids = {d: [r["change_id"] for r in sorted((r for r in results if r["doc_id"] == d), key=lambda r: r["number"])] for d in "abc"}
    assert ids["c"] == ["c-0004"] and len(ids["a"]) == len(set(ids["a"])) == 5 and len(ids["b"]) == len(set(ids["b"])) == 3
    on_time = [r for r in results if not r["late"]]
    for d in "ab":  # what came in time leaves in order of its time
        told = [r["change_id"] for r in sorted((r for r in on_time if r["doc_id"] == d), key=lambda r: r["number"])]
        assert told == sorted(told)

    # One batch over the same packages, in the order in which they left.
    every = {r[1]: r for rows in batches for r in rows if r[0] in "abc"}
    numbers = {r["change_id"]: r["number"] for r in results}
    packages = spark.createDataFrame([(r[1], r[0], r[3], numbers[r[1]]) for r in every.values()], "change_id string, doc_id string, json string, number long")
    whole = update.run(packages, documents, time=WHEN, order="number")
    assert texts(sinks.current(spark, root, "documents")) == texts(whole["updated"])
    key = lambda df: sorted(map(tuple, df.select("doc_id", "section_id", "heading", "order").collect()))
    assert key(sinks.current(spark, root, "skeletons")) == key(whole["skeletons"])


def test_a_batch_is_recorded_once(spark, tmp_path, documents):
    root = str(tmp_path / "out")
    pushes.begin(spark, documents, root)
    batch = spark.createDataFrame([(*row("a", 1), 1, False)], pushes.ORDERED)
    assert pushes.record(spark, batch, 0, root, WHEN) is True
    once = texts(sinks.current(spark, root, "documents"))
    assert pushes.record(spark, batch, 0, root, WHEN) is False
    assert texts(sinks.current(spark, root, "documents")) == once and once["a"] != BASE


# ---- several writers ----------------------------------------------------------------------------


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, v int")


def read(spark, root):
    return sorted(map(tuple, sinks.current(spark, root, "t").collect()))


def test_two_writers_of_different_keys_both_stay(spark, tmp_path):
    root = str(tmp_path / "out")
    sinks.publish(spark, {"t": table(spark, [("a", 1), ("b", 1), ("c", 1)]), "other": table(spark, [("x", 9)])}, root)
    base = sinks.head(spark, root)
    sinks.publish_changes(spark, {"t": table(spark, [("a", 2)])}, root, ["k"], base)
    sinks.publish_changes(spark, {"t": table(spark, [("b", 3), ("d", 3)])}, root, ["k"], base)  # made from the same version
    assert read(spark, root) == [("a", 2), ("b", 3), ("c", 1), ("d", 3)]
    assert sinks.current(spark, root, "other").collect()[0]["v"] == 9 and sinks.head(spark, root).number == 3


def test_two_writers_of_one_key_conflict(spark, tmp_path):
    root = str(tmp_path / "out")
    sinks.publish(spark, {"t": table(spark, [("a", 1), ("b", 1)])}, root)
    base = sinks.head(spark, root)
    sinks.publish_changes(spark, {"t": table(spark, [("a", 2)])}, root, ["k"], base)
    with pytest.raises(sinks.ConflictError):
        sinks.publish_changes(spark, {"t": table(spark, [("a", 3)])}, root, ["k"], base)
    assert read(spark, root) == [("a", 2), ("b", 1)]
    with pytest.raises(sinks.ConflictError):
        sinks.publish(spark, {"t": table(spark, [])}, root, after=base)
    assert read(spark, root) == [("a", 2), ("b", 1)]


def test_threads_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "out")
    sinks.publish(spark, {"t": table(spark, [(f"k{i}", 0) for i in range(6)])}, root)
    base = sinks.head(spark, root)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: sinks.publish_changes(spark, {"t": table(spark, [(f"k{i}", i + 1)])}, root, ["k"], base), range(6)))
    assert read(spark, root) == [(f"k{i}", i + 1) for i in range(6)] and sinks.head(spark, root).number == 7


def test_nothing_published(spark, tmp_path):
    assert sinks.head(spark, str(tmp_path / "none")).number == 0
    with pytest.raises(FileNotFoundError):
        sinks.current(spark, str(tmp_path / "none"), "t")
