"""Whole commit ranges as tables: a Python data source whose partitions run git next to the data.

``spark.read.format("git_files")`` gives one row for each changed file of a commit range, or, with
``commits``, of every commit in a revision range.  Options: ``repo`` (a folder that every executor
sees), ``before`` and ``after``, or ``commits`` (like ``v1..v2``), ``partitions``, ``diffs`` and
``contents`` (``false`` leaves these columns null and git unasked).

Nothing is listed on the driver but how many commits a range has.  The files of one range fall to
partitions by a checksum of their path; the commits of many fall to them by their place.  A partition
asks one git process for names and counts, one for the diffs of each ``BATCH`` files and one for all
contents, and yields rows as they come.  A lost executor's partition is read again; git gives the same.

Defined results: a file without a text diff has an empty one; a content that isn't there, or that is a
submodule, is empty; bytes that are no UTF-8 are replaced; a path is given as git stores it, quoted nowhere; a range without
changes gives no rows; an unknown revision raises.
"""

from __future__ import annotations

import subprocess
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Files whose diffs one process gives.
BATCH = 64
#: Bytes of paths on a command line.
ARGUMENT_BYTES = 60_000
STATUS = {"A": "added", "C": "added", "D": "deleted", "R": "renamed"}
SCHEMA = """change_id string, commit_order long, before_sha string, after_sha string, author string, message string, pos int, path string, old_path string, status string,
additions int, deletions int, binary boolean, diff string, new_content string, old_content string"""


def _git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, check=True).stdout


def _text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


@dataclass
class Change:
    """A changed file as the raw stream tells it."""

    pos: int
    path: str
    status: str
    new_blob: str
    old_blob: str
    old_path: str | None = None
    additions: int | None = None
    deletions: int | None = None
    binary: bool = False


def listed(repo: str, before: str, after: str) -> list[Change]:
    """Names, states, blobs and counts of a range's files, in git's order; contents aren't read for it, but to count lines."""
    words = _git(repo, "diff", "--raw", "--numstat", "--no-abbrev", "-z", "-M", before, after).split(b"\0")
    out, by_path, i = [], {}, 0
    while i < len(words) and words[i].startswith(b":"):
        _, _, old_blob, new_blob, code = _text(words[i][1:]).split(" ")
        two = code[0] in "RC"
        first, last = _text(words[i + 1]), _text(words[i + 1 + two])
        change = Change(len(out), last, STATUS.get(code[0], "modified"), new_blob, old_blob, first if two else None)
        out.append(change)
        by_path[last] = change
        i += 2 + two
    while i < len(words) and words[i]:
        added, deleted, name = _text(words[i]).split("\t", 2)
        if not name:
            name = _text(words[i + 2])
            i += 2
        change = by_path[name]
        change.binary = "-" in (added, deleted)
        if not change.binary:
            change.additions, change.deletions = int(added), int(deleted)
        i += 1
    return out


def _batches(changes: list[Change]) -> Iterator[list[Change]]:
    held, size = [], 0
    for c in changes:
        held.append(c)
        size += len(c.path.encode()) + 1
        if len(held) >= BATCH or size >= ARGUMENT_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def diffs(repo: str, before: str, after: str, changes: list[Change]) -> list[str]:
    """The diff of each file.  Files under one name come from one process; a renamed one needs its pair alone, or git might pair it anew."""
    out: dict[int, str] = {}
    plain = [c for c in changes if not c.old_path]
    if plain:
        text = _text(_git(repo, "--literal-pathspecs", "diff", "--no-renames", before, after, "--", *(c.path for c in plain)))
        starts = [0] if text.startswith("diff --git ") else []
        at = text.find("\ndiff --git ")
        while at >= 0:  # no line of a diff's body starts with a letter
            starts.append(at + 1)
            at = text.find("\ndiff --git ", at + 1)
        if len(starts) == len(plain):
            for c, start, end in zip(plain, starts, [*starts[1:], len(text)], strict=True):
                out[c.pos] = text[start:end]
    for c in changes:
        if c.pos not in out:
            names = [c.old_path, c.path] if c.old_path else [c.path]
            out[c.pos] = _text(_git(repo, "--literal-pathspecs", "diff", "-M", before, after, "--", *names))
    return [out[c.pos] for c in changes]


class Blobs:
    """One process that gives contents by their names."""

    def __init__(self, repo: str):
        self.process = subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)

    def get(self, blob: str) -> str:
        if not blob.strip("0"):
            return ""
        self.process.stdin.write(blob.encode() + b"\n")
        self.process.stdin.flush()
        head = self.process.stdout.readline().split()
        if len(head) < 3:
            return ""  # a submodule's commit, which isn't in this repository
        data = self.process.stdout.read(int(head[2]))
        self.process.stdout.read(1)
        return _text(data) if head[1] == b"blob" else ""

    def close(self) -> None:
        self.process.stdin.close()
        self.process.stdout.close()
        self.process.wait()


@dataclass
class Share(InputPartition):
    """What one task reads: a share of a range's files, or neighbouring commits."""

    number: int
    of: int
    skip: int = 0
    take: int = 0


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        # Options come with keys of any case.
        o = {k.lower(): v for k, v in options.items()}
        self.repo, self.commits = o["repo"], o.get("commits")
        self.before, self.after, self.change_id = o.get("before"), o.get("after"), o.get("change_id", "change")
        self.n = int(o.get("partitions", "8"))
        self.with_diffs, self.with_contents = (o.get(k, "true").lower() != "false" for k in ("diffs", "contents"))
        if not self.commits and not (self.before and self.after):
            raise ValueError("either commits, or before and after")

    def partitions(self) -> list[Share]:
        if not self.commits:
            return [Share(i, self.n) for i in range(self.n)]
        total = int(_git(self.repo, "rev-list", "--count", self.commits))
        each = max(1, -(-total // self.n))
        return [Share(i, 1, skip, each) for i, skip in enumerate(range(0, total, each))]

    def _about(self, commit: str) -> tuple[str, str]:
        author, message = _text(_git(self.repo, "show", "-s", "--format=%an%x00%B", commit)).split("\0", 1)
        return author, message.strip()

    def _rows(self, change_id: str, order: int, before: str, after: str, share: Share) -> Iterator[tuple]:
        author, message = self._about(after)
        mine = [c for c in listed(self.repo, before, after) if zlib.crc32(c.path.encode("utf-8", "surrogatepass")) % share.of == (share.number if share.of > 1 else 0)]
        blobs = Blobs(self.repo) if self.with_contents and mine else None
        try:
            for batch in _batches(mine):
                texts = diffs(self.repo, before, after, batch) if self.with_diffs else [None] * len(batch)
                for c, text in zip(batch, texts, strict=True):
                    contents = (blobs.get(c.new_blob), blobs.get(c.old_blob)) if blobs else (None, None)
                    yield (change_id, order, before, after, author, message, c.pos, c.path, c.old_path, c.status, c.additions, c.deletions, c.binary, text, *contents)
        finally:
            if blobs:
                blobs.close()

    def read(self, share: Share) -> Iterator[tuple]:
        if not self.commits:
            yield from self._rows(self.change_id, 0, self.before, self.after, share)
            return
        # From the newest; a commit's own changes are those against its first parent, a root's those against nothing.
        found = _text(_git(self.repo, "rev-list", "--parents", f"--skip={share.skip}", f"--max-count={share.take}", self.commits)).splitlines()
        for i, line in enumerate(found):
            sha, *parents = line.split(" ")
            yield from self._rows(sha, -(share.skip + i), parents[0] if parents else self._nothing(), sha, share)

    def _nothing(self) -> str:
        return _text(subprocess.run(["git", "-C", self.repo, "hash-object", "-t", "tree", "--stdin"], input=b"", capture_output=True, check=True).stdout).strip()


class GitFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GitReader:
        return GitReader(self.options)


def read(spark: SparkSession, repo: str, **options: str) -> DataFrame:
    """The table of ``SCHEMA``; ``commit_order`` grows from older to newer commits."""
    spark.dataSource.register(GitFiles)
    return spark.read.format("git_files").options(repo=repo, **options).load()


def packages(changed: DataFrame, repository: str, branch: str = "main", **header: str) -> DataFrame:
    """(change_id, commit_order, json): the package of each change in a table of ``read``, with hunks, blocks, symbols and summaries.

    Each change's author is its actor unless the header names one.  The table is written to the shared folder first, so git runs once.
    """
    from weftline.operators import diff, package
    from weftline.session import keep

    keys = ["change_id", "path"]
    changed = keep(changed, "git")
    python = changed.where(F.col("path").endswith(".py"))
    new = diff.python_symbols(python.where("status != 'deleted'"), keys, "new_content")
    old = diff.python_symbols(python.where((F.col("status") != "added") & F.coalesce("old_path", "path").endswith(".py")), keys, "old_content")
    files = changed.withColumn("binary_note", F.when(F.col("binary"), "Binary file; no text diff."))
    details = files.drop("diff", "new_content", "old_content").join(diff.what_changed(changed.select(*keys, "diff"), keys, new, old), keys, "left")
    shaped = details.withColumn("change_type", F.col("status")).withColumn("ordinal", F.col("pos"))
    one = shaped.groupBy("change_id").agg(*(F.first(c).alias(c) for c in ("commit_order", "before_sha", "after_sha", "author")))
    made = package.package(shaped, ["change_id"], F.lit(None).cast("string"), repository=repository, branch=branch, **header)
    told = made.join(diff.type_summary(shaped, ["change_id"], pos="ordinal"), "change_id").join(one, "change_id")
    body = F.from_json("json", package.PACKAGE)
    body = body.withField("generated_summary", F.col("summary")).withField("before_sha", F.col("before_sha")).withField("after_sha", F.col("after_sha"))
    if "actor" not in header:
        body = body.withField("actor", F.col("author"))
    return told.select("change_id", "commit_order", F.to_json(body).alias("json"))
