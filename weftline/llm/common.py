"""What the operators share: scratch tables, tokenizer files, word codes."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import if_small  # noqa: F401 - used by the operators

#: Words are runs of anything but blank and \t\n\v\f\r; exactly what ``bytes.split()`` cuts at.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Bytes of text that are turned into Python word objects at a time.
CHUNK_BYTES = 1 << 20
#: Bytes of strings that a task hands on at a time; a longer row goes alone.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is named and all run in one process."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Rows of an Arrow batch: the JVM holds batches beside its heap, and keeps that memory.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` rows; results are worked out later, so this stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, df: DataFrame) -> None:
        """Delete a table that ``keep`` wrote and nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it as long as a column has it; names are compared as Spark does, without case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_bytes(batch: pa.RecordBatch, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose strings hold about ``limit`` bytes; one row at least."""
    size = np.full(len(batch), 16, np.int64)
    for c in batch.columns:
        if pa.types.is_binary(c.type) or pa.types.is_string(c.type) or pa.types.is_large_binary(c.type) or pa.types.is_large_string(c.type):
            size += pa.compute.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(size), 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def give_back() -> None:
    """Hand free memory back to the system: workers outlive their tasks, and what they keep adds up beside the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def per_batch(make: Callable, columns: list[str]) -> Callable:
    """mapInArrow body: ``make()`` gives, for one task, a function from arrays of the named columns to a record batch.

    What the function keeps between batches (word tables, models) goes when the task ends.
    """

    def run(batches: Iterator) -> Iterator:
        one = make()
        try:
            for batch in batches:
                for part in by_bytes(batch):
                    out = one(*(part.column(part.schema.get_field_index(c)) for c in columns))
                    if out is not None:
                        yield out
                    out = part = None
                batch = None
        finally:
            one = None
            give_back()

    return run


def groups_of(values: list, limit: int) -> Iterator[tuple[int, int]]:
    """Spans of neighbouring byte strings that hold about ``limit`` bytes together."""
    start = size = 0
    for i, v in enumerate(values):
        size += len(v) if v else 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(values):
        yield start, len(values)


def chunks(data: bytes, limit: int = CHUNK_BYTES) -> Iterator[bytes]:
    """``data`` cut at blanks into parts of about ``limit`` bytes, so that no word is cut."""
    at = 0
    while len(data) - at > limit:
        cut = max(data.rfind(b" ", at, at + limit), data.rfind(b"\n", at, at + limit))
        if cut <= at:
            nexts = [x for x in (data.find(b" ", at + limit), data.find(b"\n", at + limit)) if x >= 0]
            if not nexts:
                break
            cut = min(nexts)
        yield data[at:cut]
        at = cut
    yield data[at:]


class WordCodes(dict):
    """Gives every distinct word the next whole number.

    ``full()`` says when a fresh table is due, so that a task's memory doesn't
    grow with the vocabulary of what it reads.
    """

    def __init__(self, limit: int = 250_000):
        super().__init__()
        self.words: list = []
        self.limit = limit

    def __missing__(self, word):
        code = self[word] = len(self.words)
        self.words.append(word)
        return code

    def full(self) -> bool:
        return len(self.words) > self.limit

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def of_text(self, data: bytes) -> np.ndarray:
        if len(data) <= CHUNK_BYTES:
            return self.of(data.split())
        return np.concatenate([self.of(x.split()) for x in chunks(data)])

    def of_texts(self, texts: pa.Array) -> list[np.ndarray]:
        """Codes of the words of each text, A-Z lower-cased; each distinct word becomes one Python object."""
        lists = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(texts.view(pa.string())))
        words, offsets = lists.flatten(), lists.offsets.to_numpy()
        there = pa.compute.binary_length(words).to_numpy() > 0  # blanks at a text's start or end leave an empty word
        encoded = words.filter(pa.array(there)).dictionary_encode()
        codes = self.of(encoded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist())
        cuts = np.append(0, np.cumsum(there))[offsets - offsets[0]]
        return np.split(codes.take(encoded.indices.to_numpy()), cuts[1:-1]) if len(texts) else []


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of each (start, length), one after another."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)
