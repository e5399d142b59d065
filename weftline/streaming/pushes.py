"""Pushes as a stream: each document's packages once, in commit order, recorded in its copy as one batch would.

Two steps.  ``in_order`` keeps, for each document, the packages that wait and the ids that were
given out; a package leaves when the watermark has passed its time, after those of its document that come before it,
and a repeated one never leaves again.  ``record`` takes what leaves in a micro-batch, runs the flow of ``plans.update`` on it
against the state that was published last, and publishes the new state with the batch's number.

State lives in two places: waiting packages in the stream's checkpoint, documents in published versions.  A batch that was
published before a restart is known by its number and not recorded again.

Defined results: a package later than the watermark is given out at once, after what has left already, and marked ``late``;
packages of one time go by their ids; one without a time, document or id is dropped from the stream by Spark's rule for null keys or times and is
counted by nobody, so ``packages`` refuses it before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from weftline.operators import lines
from weftline.plans import update
from weftline.sources import sinks

ORDERED = "doc_id string, change_id string, time timestamp, json string, number long, late boolean"
#: RocksDB holds the state of each document, with its lists and maps.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Holds a document's packages until the watermark passes them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "change_id string", "time timestamp, json string")
        self.seen = handle.getMapState("seen", "change_id string", "number long")
        self.count = handle.getValueState("count", "number long")

    def _give(self, key, rows: list[tuple], late: bool) -> pd.DataFrame:
        number = self.count.get()[0] if self.count.exists() else 0
        out = []
        for time, change, json in rows:
            number += 1
            self.seen.updateValue((change,), (number,))
            out.append((key[0], change, time, json, number, late))
        self.count.update((number,))
        return pd.DataFrame(out, columns=["doc_id", "change_id", "time", "json", "number", "late"]).astype({"time": "datetime64[ns]"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed, late = timerValues.getCurrentWatermarkInMs(), {}
        for frame in rows:
            for change, time, json in zip(frame["change_id"], frame["time"], frame["json"], strict=True):
                if self.seen.containsKey((change,)) or self.waiting.containsKey((change,)) or change in late:
                    continue
                at = int(pd.Timestamp(time).timestamp() * 1000)
                if at <= passed:
                    late[change] = (time, change, json)
                else:
                    self.waiting.updateValue((change,), (pd.Timestamp(time).to_pydatetime(), json))
                    self.handle.registerTimer(at)
        if late:
            yield self._give(key, sorted(late.values(), key=lambda r: (r[0], r[1])), True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs()
        # Timers of a document expire in order of their times, so what is due now comes after all that left before.
        due = sorted((held[0], change[0], held[1]) for change, held in self.waiting.iterator() if int(pd.Timestamp(held[0]).timestamp() * 1000) <= passed)
        for _, change, _ in due:
            self.waiting.removeKey((change,))
        if due:
            yield self._give(key, due, False)

    def close(self) -> None:
        pass


def in_order(packages: DataFrame, late: str = "1 hour") -> DataFrame:
    """``packages`` (doc_id, change_id, time, json), a stream, as a stream of ``ORDERED``: ``number`` counts a document's packages."""
    rows = packages.select("doc_id", "change_id", "time", "json").withWatermark("time", late)
    return rows.groupBy("doc_id").transformWithStateInPandas(InOrder(), ORDERED, "append", "eventTime")


def begin(spark: SparkSession, documents: DataFrame, root: str) -> str:
    """Publish the state that a stream starts from: ``documents`` (doc_id, baseline, updated)."""
    copies = documents.select("doc_id", "baseline", F.coalesce("updated", "baseline", F.lit("")).alias("text"))
    state = copies.select("doc_id", "baseline", F.col("text").alias("routed_on"), "text")
    skeletons = lines.skeleton(lines.sections(documents.select("doc_id", F.col("baseline").alias("text")), ["doc_id"]), ["doc_id"])
    none = spark.createDataFrame([], "doc_id string, change_id string, number long, late boolean, decision string, section_id string, heading string, confidence double, placement string, warnings array<string>")
    return sinks.publish(spark, {"documents": state, "skeletons": skeletons, "results": none}, root, note="batch -1")


def record(spark: SparkSession, batch: DataFrame, number: int, root: str, time: str | None = None) -> bool:
    """Record a micro-batch of ``in_order`` in the published state; False if that was done before.

    Changes are routed on the copies that the stream began with, so how packages fall into batches changes nothing.
    """
    before = sinks.head(spark, root)
    if int(before.note.removeprefix("batch ")) >= number:
        return False
    state, skeletons = (spark.read.parquet(f"{before.version}/{t}") for t in ("documents", "skeletons"))
    touched = batch.select("doc_id").distinct()
    own = state.join(touched, "doc_id", "left_semi")
    made = update.run(
        batch.select("change_id", "doc_id", "json", "number"),
        own.select("doc_id", "baseline", F.col("text").alias("updated")),
        skeletons.join(touched, "doc_id", "left_semi"),
        time=time,
        order="number",
        routed_on=own.select("doc_id", F.col("routed_on").alias("text")),
    )
    changed = own.drop("text").join(made["updated"], "doc_id").select("doc_id", "baseline", "routed_on", "text")
    results = made["results"].join(batch.select("doc_id", "change_id", "number", "late"), ["doc_id", "change_id"])
    results = results.select("doc_id", "change_id", "number", "late", "decision", "section_id", "heading", "confidence", "placement", "warnings")
    sinks.publish(
        spark,
        {
            "documents": state.join(touched, "doc_id", "left_anti").unionByName(changed),
            "skeletons": skeletons.join(touched, "doc_id", "left_anti").unionByName(made["skeletons"]),
            "results": spark.read.parquet(f"{before.version}/results").unionByName(results),
        },
        root,
        after=before,
        note=f"batch {number}",
    )
    return True


def run(packages: DataFrame, root: str, checkpoint: str, late: str = "1 hour", time: str | None = None) -> StreamingQuery:
    """Record a stream of packages until it has no more; start again with the same folders to go on."""
    spark = packages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.persist()  # read by several outputs; given back below
        try:
            if not rows.isEmpty():
                record(spark, rows, number, root, time)
        finally:
            rows.unpersist()

    return in_order(packages, late).writeStream.foreachBatch(step).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
