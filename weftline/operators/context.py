"""Repository context from a file table, budgets, and the texts rendered from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import vocabulary as V


def decoded(content: Column) -> Column:
    """Text of a file's bytes; null with a NUL byte or invalid UTF-8."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text) & ~F.contains(text, F.lit("\0")), text)


def admitted(path: Column) -> Column:
    """Text files outside ignored folders that don't look like secrets."""
    low, name = F.lower(path), T.file_name(F.lower(path))
    suffix = F.regexp_extract(name, r".(\.[^.]*)$", 1)
    ignored = F.arrays_overlap(F.split(path, "/"), T.literals(V.IGNORED_FOLDERS)) | suffix.isin(V.IGNORED_SUFFIXES) | (name == ".env") | name.startswith(".env.") | T.any_of(F.contains(name, F.lit(w)) for w in V.SECRET_NAMES) | (name == ".ds_store")
    return (low != "") & ~ignored & (suffix.isin(V.TEXT_SUFFIXES) | T.file_name(path).isin(V.TEXT_NAMES))


def collect(files: DataFrame, keys: list[str], path: str = "path", content: str = "content") -> DataFrame:
    """(keys, ordinal, path, text, truncated, in_tree): admitted files in path order under the context's budgets.

    Files are taken until ``TOTAL_CHARS`` are reached, the one that crosses it included; unreadable ones only stay in the tree.
    """
    rows = files.where(admitted(F.col(path))).select(*keys, F.col(path).alias("path"), decoded(F.col(content)).alias("raw"))
    w = Window.partitionBy(*keys).orderBy("path")
    rows = rows.withColumn("ordinal", F.row_number().over(w)).withColumn("_n", F.least(F.length("raw"), F.lit(V.FILE_CHARS)))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    used, readable = F.coalesce(F.sum("_n").over(before), F.lit(0)), F.coalesce(F.count("raw").over(before), F.lit(0))
    taken = F.col("raw").isNotNull() & (used < V.TOTAL_CHARS) & (readable < V.CONTENT_FILES)
    return rows.withColumn("_t", taken).select(*keys, "ordinal", "path", F.when(F.col("_t"), F.substring("raw", 1, V.FILE_CHARS)).alias("text"), (F.col("_t") & (F.length("raw") > V.FILE_CHARS)).alias("truncated"), (F.col("ordinal") <= V.TREE_ENTRIES).alias("in_tree"))


def within_budget(rows: DataFrame, keys: list[str], order: list, size: Column, budget: int) -> DataFrame:
    """Rows in order up to the first that would exceed the budget."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("used", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("used") <= budget)


def prompt_excerpts(files: DataFrame, keys: list[str], each: int = 800, budget: int = 9000) -> DataFrame:
    """Excerpts of the most authoritative files first, until one doesn't fit."""
    rows = files.where("text is not null").withColumn("group", T.context_priority(F.col("path"))).withColumn("excerpt", F.substring("text", 1, each))
    return within_budget(rows, keys, ["group", "path"], F.length("excerpt"), budget)


def description(files: DataFrame, keys: list[str], most: int = 400) -> DataFrame:
    """(keys, description): the first paragraph of prose of the shallowest README."""
    name = F.lower(T.file_name(F.col("path")))
    w = Window.partitionBy(*keys).orderBy(F.size(F.split("path", "/")), "path")
    readme = files.where(name.startswith("readme") & F.col("text").isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    paragraphs = F.split(T.without_fences(F.col("text")), r"\n\s*\n")
    prose = F.filter(F.transform(paragraphs, lambda p: T.strip(F.array_join(F.filter(F.split(p, "\n"), lambda x: ~F.ltrim(x).startswith("#")), " "))), lambda p: (p != "") & ~p.rlike(r"^(\[?!\[|<|\||[-*+]\s|>)"))
    return readme.select(*keys, F.substring(F.get(prose, F.lit(0)), 1, most).alias("description"))


def template_summary(files: DataFrame, keys: list[str], title: str = "# Project Technical Summary", name: str = "This repository") -> DataFrame:
    """(keys, summary): a Markdown summary from the file table alone, the same at every run."""
    paths = files.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("in_tree"), F.col("path")))).alias("tree"), F.count("*").alias("n"))
    rows = paths.join(description(files, keys), keys, "left")
    of = lambda rule: F.filter("tree", rule)
    ends = lambda p, *suffixes: T.any_of(p.endswith(x) for x in suffixes)
    sources = of(lambda p: p.startswith("src/") & p.endswith(".py"))
    tests = of(lambda p: p.startswith("tests/") & p.endswith(".py"))
    listed = lambda a, empty: F.when(F.size(a) == 0, empty).otherwise(F.array_join(F.transform(a, lambda p: F.concat(F.lit("- `"), p, F.lit("`"))), "\n"))
    overview = F.concat(F.lit(f"{name} contains "), F.col("n").cast("string"), F.lit(" tracked files.\n"), F.coalesce(F.nullif(F.col("description"), F.lit("")), F.lit("No project description was found in the repository README; this overview is structural only.")))
    limits = F.lit("- This summary was generated from the list of files; its prose is structural rather than semantic.\n- Only repository content was used as evidence; no external systems or documents were accessed.")
    parts = {
        "System Overview": overview,
        "Repository Structure": F.concat(F.lit("```text\n"), F.array_join(F.slice("tree", 1, 60), "\n"), F.lit("\n```\nThe first paths in order are shown.")),
        "Core Modules": listed(sources, "No Python modules under src/ were found."),
        "Automation Pipeline": listed(F.filter(sources, lambda p: T.any_of(F.contains(p, F.lit(w)) for w in ("automation", "updater", "router", "detector"))), "No automation-related modules were detected."),
        "Testing Strategy": F.concat(F.size(tests).cast("string"), F.lit(" test file(s) under tests/:\n\n"), listed(tests, "No test files were found.")),
        "Configuration": listed(of(lambda p: ends(p, ".json", ".toml", ".ini", ".cfg") | (p == "requirements.txt")), "No configuration files were detected."),
        "Deployment and CI": listed(of(lambda p: p.startswith(".github/workflows/")), "No CI workflow configuration was detected."),
        "Known Limitations": limits,
    }
    sections = [F.concat(F.lit(f"## {heading}\n\n"), body) for heading, body in parts.items()]
    return rows.select(*keys, F.concat(F.lit(f"{title}\n\n"), F.concat_ws("\n\n", *sections), F.lit("\n")).alias("summary"))


def update_block(changes: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block): the marked lines that record a change.

    ``changes``: keys, repository, branch, actor, before_sha, after_sha, summary, time (text).  ``files``: keys, ordinal,
    change_type, path, old_path.
    """
    item = F.concat(F.lit("- "), "change_type", F.lit(": "), F.when(F.col("old_path").isNotNull(), F.concat("old_path", F.lit(" -> "))).otherwise(""), "path")
    listed = files.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", item.alias("t")))), lambda x: x["t"]).alias("items"))
    of = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(c, F.lit("(none)")))
    head = F.array(
        F.lit(f"<!-- {V.REGION_START} -->"),
        F.concat(F.lit("### Automated Change Update - "), "time"),
        F.lit(""),
        of("Repository", F.col("repository")),
        of("Branch", F.col("branch")),
        of("Actor", F.col("actor")),
        of("Before SHA", F.col("before_sha")),
        of("After SHA", F.col("after_sha")),
        F.lit(""),
        F.lit("Changed files:"),
    )
    items = F.coalesce("items", T.literals(["- (no changed files were available for this run)"]))
    tail = F.array(F.lit(""), F.lit("Summary:"), F.coalesce("summary", F.lit("")), F.lit(f"<!-- {V.REGION_END} -->"))
    return changes.join(listed, keys, "left").select(*keys, F.concat(head, items, tail).alias("block"))


def report(packages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, body): a Markdown report of a package."""
    listed = F.array_join(F.transform("changed_files", lambda x: F.concat(F.lit("- "), F.coalesce(x["status"], x["change_type"]), F.lit(" `"), x["path"], F.lit("`"))), "\n")
    known = lambda c: F.coalesce(c, F.lit("unknown"))
    return packages.select(*keys, F.concat_ws("\n", F.lit("## Documentation update"), F.concat(F.lit("Repository: "), known("repository")), F.concat(F.lit("Branch: "), known("branch")), F.concat(F.lit("Range: "), known("before_sha"), F.lit(".."), known("after_sha")), F.lit(""), F.lit("### Files"), listed, F.lit(""), F.lit("### Summary"), F.coalesce("generated_summary", F.lit(""))).alias("body"))


def safe_name(name: Column) -> Column:
    """A file-name-safe repository name; null where none is left."""
    own = F.substring(F.regexp_replace(F.regexp_replace(T.strip(name), "[^A-Za-z0-9._-]", "_"), "^[._-]+|[._-]+$", ""), 1, 100)
    return F.when(~F.coalesce(name, F.lit("")).rlike(r"[/\\\x00]|^\.{1,2}$") & (own != ""), own)


def is_missing_sha(sha: Column) -> Column:
    return sha.isNull() | sha.rlike(r"^\s*0*\s*$")
