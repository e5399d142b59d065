"""Command lines over the operators: ``python -m weftline.cli COMMAND ...``.  Results go to a folder or to the terminal."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import blocks, canonical, context, headings, lines, package
from weftline.plans import baseline, inputs, preview, push, update
from weftline.sources import docx, readers, sinks


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of files; the id is the file's path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("doc_id"), F.col("content").cast("string").alias("text"))


def _packages(spark: SparkSession, path: str, doc: str) -> DataFrame:
    return readers.json_files(spark, path).select(F.col("path").alias("change_id"), F.lit(doc).alias("doc_id"), "json")


def score_headings(spark: SparkSession, path: str, out: str | None) -> DataFrame:
    """Scored paragraphs of Word files: all columns as CSV in ``out``, seven to the terminal."""
    scored = docx.analyze(docx.load(spark, path))
    if out:
        sinks.write_csv(sinks.heading_table(scored), out)
    return scored.select("doc_id", "pos", "score", "classification", "predicted_level", "style_name", F.substring("text", 1, 45).alias("text")).orderBy("doc_id", "pos")


def run(spark: SparkSession, argv: Sequence[str], env: Mapping[str, str] | None = None) -> DataFrame:
    parser = argparse.ArgumentParser(prog="weftline")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, about in (
        ("headings", "score the paragraphs of Word files"),
        ("tree", "headings of Word files as trees with their contents"),
        ("sections", "sections of Markdown files"),
        ("index", "blocks of Markdown files"),
        ("sentences", "sentences of Markdown files"),
        ("check", "check canonical documents"),
        ("summary", "template summary of a repository tree"),
    ):
        one = commands.add_parser(name, help=about)
        one.add_argument("path")
        one.add_argument("--out")
    for name, about in (("preview", "what a package would change in a document"), ("update", "record a package in a document"), ("report", "a package as Markdown")):
        one = commands.add_parser(name, help=about)
        one.add_argument("package")
        one.add_argument("document", nargs="?", default="")
        one.add_argument("--out")
        one.add_argument("--section")
    one = commands.add_parser("inspect", help="preview of a repository's package, document and skeleton")
    one.add_argument("path")
    for name in inputs.PLACES:
        one.add_argument(f"--{name}", help=f"its place under the repository, else {inputs.PLACES[name]}")
    one.add_argument("--out")
    one = commands.add_parser("push", help="what a push starts from: its project, its changed files")
    one.add_argument("configs")
    one.add_argument("--repo", default=".")
    one.add_argument("--out")
    one = commands.add_parser("package", help="the change package of a commit range")
    one.add_argument("before")
    one.add_argument("after")
    one.add_argument("--repo", default=".")
    one.add_argument("--out")
    a = parser.parse_args(argv)

    if a.command == "headings":
        return score_headings(spark, a.path, a.out)
    if a.command == "package":
        found = readers.git_package(spark, a.before, a.after, a.repo)
    elif a.command == "inspect":
        given = [getattr(a, name) for name in inputs.PLACES]
        repos = spark.createDataFrame([(a.path, *given)], "repo string, " + ", ".join(f"{name} string" for name in inputs.PLACES))
        found = inputs.run(readers.tree(spark, a.path).withColumn("repo", F.lit(a.path)), repos)
    elif a.command == "push":
        configs = readers.project_configs(readers.json_files(spark, a.configs))
        found = push.report(push.of_environment(spark, os.environ if env is None else env, configs, a.repo), ["push"])
    elif a.command == "tree":
        found = headings.document_tree(docx.analyze(docx.load(spark, a.path)), ["doc_id"])
    elif a.command == "sections":
        found = lines.skeleton(lines.sections(_texts(spark, a.path), ["doc_id"]), ["doc_id"])
    elif a.command in ("index", "sentences"):
        _, found = blocks.block_index(_texts(spark, a.path), ["doc_id"])
        found = found if a.command == "index" else blocks.sentence_rows(found, ["doc_id"])
    elif a.command == "check":
        files = spark.read.format("binaryFile").load(a.path)
        found = canonical.check(files.select(F.col("path").alias("doc_id"), F.lit("file").alias("kind"), "content"), ["doc_id"])
    elif a.command == "summary":
        tree = readers.tree(spark, a.path).withColumn("repo", F.lit(a.path))
        found = baseline.summaries(context.collect(tree, ["repo"]), ["repo"], baseline.Choice("deterministic"))
    else:
        packages = _packages(spark, a.package, a.document)
        if a.command == "report":
            found = context.report(package.parse_packages(packages, ["change_id"]), ["change_id"])
        else:
            text = _texts(spark, a.document).withColumn("doc_id", F.lit(a.document))
            if a.command == "preview":
                override = packages.select("change_id", F.lit(a.section).alias("section_id")) if a.section else None
                found = preview.run(packages, text, override)
            else:
                made = update.run(packages, text.select("doc_id", F.col("text").alias("baseline"), F.lit(None).cast("string").alias("updated")))
                if a.out:
                    sinks.publish(spark, {"updated": made["updated"], "skeletons": made["skeletons"]}, a.out)
                return update.report(made["results"])
    if a.out:
        sinks.write_json(found, a.out)
    return found


def main(argv: Sequence[str] | None = None) -> int:
    from weftline.session import session

    found = run(session(), sys.argv[1:] if argv is None else argv)
    found.show(truncate=False)
    return found.agg(F.max("code")).collect()[0][0] if "code" in found.columns else 0


if __name__ == "__main__":
    raise SystemExit(main())
