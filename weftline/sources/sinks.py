"""Writers: versioned output folders that appear all at once, also beside other writers; JSON lines; flat tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Head:
    """The version that readers see: its number, folder and what its writer noted; number 0 is none."""

    number: int
    version: str
    note: str = ""


class ConflictError(RuntimeError):
    """Another writer published first, and both changed the same documents."""


def _files(spark: SparkSession, root: str):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    return path, path(root).getFileSystem(conf)


def _pointer(root: str, number: int) -> str:
    return f"{root.rstrip('/')}/HEAD-{number:012d}"


def head(spark: SparkSession, root: str) -> Head:
    """The newest version."""
    path, fs = _files(spark, root)
    if not fs.exists(path(root)):
        return Head(0, "")
    names = sorted(f.getPath().getName() for f in fs.listStatus(path(root)) if f.getPath().getName().startswith("HEAD-") and "." not in f.getPath().getName())
    if not names:
        return Head(0, "")
    found = fs.open(path(f"{root.rstrip('/')}/{names[-1]}"))
    try:
        told = spark._jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8")
    finally:
        found.close()
    version, _, note = told.partition("\n")
    return Head(int(names[-1].removeprefix("HEAD-")), version, note)


def _point(spark: SparkSession, root: str, number: int, text: str) -> bool:
    """Create pointer ``number`` if nobody has; it is written beside its place first, so it is whole once it is there."""
    path, fs = _files(spark, root)
    beside = path(f"{root.rstrip('/')}/.{uuid.uuid4().hex}.pointer")
    out = fs.create(beside, False)
    out.write(bytearray(text.encode()))
    out.close()
    # Rename without overwriting refuses a name that is taken: that is the comparison.
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(path(root)).toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(beside), fs.makeQualified(path(_pointer(root, number))), options)
        return True
    except Exception as error:
        fs.delete(beside, False)
        if "FileAlreadyExists" in str(error) or fs.exists(path(_pointer(root, number))):
            return False
        raise


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, after: Head | None = None, note: str = "") -> str:
    """Write all tables into one new version folder, then point readers to it in one step.

    Pointers are numbered and each is created once only, so of two writers at the same time one gets the next number.
    Without ``after`` the other takes the number after it: the last one wins, and knows.  With ``after``, the version that
    the tables were made from, the other raises ``ConflictError``; ``publish_changes`` merges instead.  A failure
    leaves the old version as it was and removes what was written.
    """
    path, fs = _files(spark, root)
    version = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    try:
        for name, df in tables.items():
            df.write.parquet(f"{version}/{name}")
        at = after or head(spark, root)
        while not _point(spark, root, at.number + 1, f"{version}\n{note}"):
            if after is not None:
                raise ConflictError(f"version {at.number + 1} was published by another writer")
            at = head(spark, root)
    except Exception:
        fs.delete(path(version), True)
        raise
    return version


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    at = head(spark, root)
    if not at.number:
        raise FileNotFoundError(f"nothing was published in {root}")
    return spark.read.parquet(f"{at.version}/{name}")


def publish_changes(spark: SparkSession, changed: dict[str, DataFrame], root: str, keys: list[str], base: Head, tries: int = 10) -> Head:
    """Put new rows of some keys in place of the old ones, beside other writers.

    ``changed``: tables with ``keys`` that were made from the version ``base``; a key's rows replace all its rows of that table.  If others have
    published since, this writer's keys are put into theirs and published again, as long as they left these
    keys as ``base`` had them; else it raises ``ConflictError``, and none of it is seen.
    """
    from weftline.session import keep

    own = {name: keep(df, "publish") for name, df in changed.items()}
    touched = keep(reduce(lambda a, b: a.unionByName(b), (df.select(*keys) for df in own.values())).distinct(), "publish")
    read = lambda at, name: spark.read.parquet(f"{at.version}/{name}")
    now = base
    for _ in range(tries):
        for name in own if now.number != base.number else ():
            theirs, before = (read(at, name).join(touched, keys, "left_semi") for at in (now, base))
            if not theirs.exceptAll(before).isEmpty() or not before.exceptAll(theirs).isEmpty():
                raise ConflictError(f"{name} of the same keys was changed in version {now.number}")
        names = _tables(spark, now) if now.number else list(own)
        whole = {n: read(now, n).join(own[n].select(*keys).distinct(), keys, "left_anti").unionByName(own[n]) if n in own and now.number else own[n] if n in own else read(now, n) for n in {*names, *own}}
        try:
            version = publish(spark, whole, root, after=now)
            return Head(now.number + 1, version)
        except ConflictError:
            now = head(spark, root)
    raise ConflictError(f"{tries} tries, and others were always faster")


def _tables(spark: SparkSession, at: Head) -> list[str]:
    path, fs = _files(spark, at.version)
    return [f.getPath().getName() for f in fs.listStatus(path(at.version)) if f.isDirectory()]


def write_json(df: DataFrame, path: str, once: bool = False) -> None:
    """JSON lines in one file per partition; ``once`` keeps what is there."""
    df.write.mode("ignore" if once else "overwrite").json(path)


def heading_table(scored: DataFrame) -> DataFrame:
    """The flat table of scored paragraphs for CSV: lists are joined."""
    lists = {"signals": "; ", "segments": " | "}
    flat = [F.array_join(c, lists[c]).alias(c) if c in lists else F.col(c) for c, kind in scored.dtypes if c in lists or not kind.startswith(("array", "struct", "map"))]
    return scored.select(*flat)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
