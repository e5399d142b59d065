"""What a push starts from: the project that its repository belongs to, what it changed, and what is amiss."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import vocabulary as V
from weftline.operators import context
from weftline.sources import git, readers

NO_PARENT = "HEAD~1 is not available; no changed files are listed"
NO_BEFORE = "the SHA before is missing or zero, as on a first push; no changed files are listed"
PUSH = "full_name string, sha string, ref string, before string, actor string, branch string, parent boolean, failure string"


def overview(pushes: DataFrame, configs: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, repository, branch, actor, before_sha, after_sha, project_id, document_name, document_location, files, warnings), a row for each push.

    ``pushes``: keys and ``PUSH``: what a build system says (full_name, sha, ref, before, actor), the working copy's branch,
    whether its last commit has a parent, and why git gave nothing.  Without a sha the push is a local one.  ``configs``: as
    ``readers.project_configs`` gives them.  ``changed``: keys, pos, change_type, path, old_path.  What is missing is a warning, never an error.
    """
    told = lambda c: F.nullif(T.strip(F.coalesce(c, F.lit(""))), F.lit(""))
    built = told("sha").isNotNull()
    before = F.when(built, told("before")).when(F.col("parent"), "HEAD~1")
    rows = pushes.select(
        *keys,
        F.coalesce(told(F.element_at(F.split(F.coalesce(told("full_name"), F.lit("")), "/"), -1)), F.lit(V.DEFAULT_REPOSITORY)).alias("repository"),
        F.coalesce(told(F.when(built, F.col("ref")).otherwise(F.col("branch"))), F.lit("main")).alias("branch"),
        F.coalesce(told("actor"), F.lit("local-user")).alias("actor"),
        F.when(~context.is_missing_sha(before), before).alias("before_sha"),
        F.coalesce(told("sha"), F.lit("HEAD")).alias("after_sha"),
        built.alias("_built"),
        "failure",
    )
    one = F.struct("pos", "change_type", "path", "old_path")
    files = changed.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("files"))
    known = configs.select(F.col("repository_name").alias("repository"), "project_id", "document_name", "document_location")
    out = rows.join(known, "repository", "left").join(files, keys, "left")
    first = F.col("before_sha").isNull()
    warnings = F.array(
        F.when(first & ~F.col("_built"), NO_PARENT),
        F.when(F.col("project_id").isNull(), F.concat(F.lit("no configuration for "), "repository")),
        F.when(first & F.col("_built"), NO_BEFORE),
        F.when(~first, F.col("failure")),
    )
    none = F.array().cast(dict(files.dtypes)["files"])
    shown = F.when(first, none).otherwise(F.coalesce("files", none))
    return out.select(*keys, "repository", "branch", "actor", "before_sha", "after_sha", "project_id", "document_name", "document_location", shown.alias("files"), F.array_compact(warnings).alias("warnings"))


def report(pushes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, report): an overview to read."""
    line = lambda label, c: F.concat(F.lit(label), c)
    listed = F.transform("files", lambda f: F.concat(F.lit("- "), f["change_type"], F.lit(": "), F.when(f["old_path"].isNotNull(), F.concat(f["old_path"], F.lit(" -> "))).otherwise(""), f["path"]))
    project = F.when(F.col("project_id").isNull(), T.literals(["(no project configuration)"])).otherwise(F.array(line("Project ID: ", F.col("project_id")), line("Document: ", F.col("document_name")), line("Location: ", F.col("document_location"))))
    parts = F.concat(
        F.array(line("Repository: ", F.col("repository")), line("Branch: ", F.col("branch")), line("Actor: ", F.col("actor")), line("Before SHA: ", F.coalesce("before_sha", F.lit("(none)"))), line("After SHA: ", F.col("after_sha"))),
        T.literals(["", "Project"]),
        project,
        T.literals(["", "Changed files"]),
        F.when(F.size("files") == 0, T.literals(["(none)"])).otherwise(listed),
        F.when(F.size("warnings") == 0, F.array().cast("array<string>")).otherwise(F.concat(T.literals(["", "Warnings"]), F.transform("warnings", lambda w: F.concat(F.lit("! "), w)))),
    )
    return pushes.select(*keys, F.array_join(parts, "\n").alias("report"))


def of_environment(spark: SparkSession, env: Mapping[str, str], configs: DataFrame, repo: str = ".") -> DataFrame:
    """The overview of the push that a build's environment tells of, else of the working copy's last commit; key ``push``."""

    def asked(*args: str) -> str | None:
        try:
            return readers.git_output(list(args), repo).strip() or None
        except (OSError, readers.subprocess.SubprocessError):
            return None

    built = env.get("GITHUB_SHA", "").strip()
    parent = asked("rev-parse", "--verify", "--quiet", "HEAD~1") is not None
    before, after = (env.get("GITHUB_EVENT_BEFORE", "").strip(), built) if built else ("HEAD~1" if parent else "", "HEAD")
    listed = bool(before.strip("0"))
    unknown = [r for r in (before, after) if listed and asked("rev-parse", "--verify", "--quiet", f"{r}^{{commit}}") is None]
    failure = f"git doesn't know {', '.join(unknown)}; no changed files are listed" if unknown else None
    row = ("push", env.get("GITHUB_REPOSITORY"), built, env.get("GITHUB_REF_NAME"), before, env.get("GITHUB_ACTOR"), asked("rev-parse", "--abbrev-ref", "HEAD"), parent, failure)
    pushes = spark.createDataFrame([row], f"push string, {PUSH}")
    if listed and not unknown:
        changed = git.read(spark, repo, before=before, after=after, change_id="push", diffs="false", contents="false").select(F.col("change_id").alias("push"), "pos", F.col("status").alias("change_type"), "path", "old_path")
    else:
        changed = spark.createDataFrame([], "push string, pos int, change_type string, path string, old_path string")
    return overview(pushes, configs, changed, ["push"])
