"""The flow of a push: route each change, record it in its document, keep the skeleton true.  Many changes and documents in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import vocabulary as V
from weftline.operators import context, lines, package, scoring
from weftline.operators.suggestions import CREATE, UPDATE
from weftline.session import keep


def routing_context(signals: DataFrame, documents: DataFrame, skeletons: DataFrame | None, change_keys: list[str], doc_keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(shortlist, assessed, catalog): changes scored once against the real sections of their documents.

    With skeletons the sections are those of the skeleton, with the content that the document has under their ids,
    none where it has none; without, they are the document's own.
    """
    own = lines.sections(documents, doc_keys)
    if skeletons is not None:
        found = lines.match_ids(own, skeletons, doc_keys).select(*doc_keys, "section_id", "content")
        own = skeletons.join(found, [*doc_keys, "section_id"], "left").withColumn("content", F.coalesce("content", F.lit("")))
    catalog = scoring.catalog(own, doc_keys)
    shortlist = scoring.route(signals, catalog, change_keys, doc_keys)
    return shortlist, scoring.assess(shortlist, change_keys), catalog


def decisions(changes: DataFrame, assessed: DataFrame, catalog: DataFrame, change_keys: list[str], doc_keys: list[str]) -> DataFrame:
    """(change_keys, doc_keys, decision, section_id, heading, reason, skeleton_changes, confidence, ambiguous, strength) of every change.

    The leader where there is evidence; else the overview section, to be reviewed; a new section only for a document without any.
    """
    over = scoring.overview(catalog, doc_keys)
    names = catalog.select(*doc_keys, F.col("section_id"), F.col("heading").alias("_own"))
    rows = changes.join(assessed, change_keys, "left").join(over, doc_keys, "left").join(names, [*doc_keys, "section_id"], "left")
    led = F.coalesce(F.col("strength") != "none", F.lit(False))
    strength = F.coalesce("strength", F.lit("none"))
    why = (
        F.when(strength == "none", f"no section scored above the minimum ({V.SECTION_MIN})")
        .when(strength == "ambiguous", F.concat(F.lit(f"top two candidates are within {V.SECTION_MARGIN} points ("), F.format_number("score", 1), F.lit(" vs "), F.format_number(F.col("score") - F.col("margin"), 1), F.lit(")")))
        .when(strength == "strong", F.concat(F.lit("clear leader at "), F.format_number("score", 1), F.lit(" points")))
        .otherwise(F.concat(F.lit("leading candidate at "), F.format_number("score", 1), F.lit(" points")))
    )
    reason = (
        F.when(led, F.concat(F.when(F.col("ambiguous"), "Ambiguous match: ").otherwise("Best match: "), why, F.lit("; routing to existing section '"), "_own", F.lit("'.")))
        .when(F.col("overview_id").isNotNull(), F.concat(F.lit("No section matched confidently ("), why, F.lit("); falling back to the overview-equivalent section '"), "overview_heading", F.lit("' for manual review. No section was created.")))
        .otherwise(f"Skeleton has no eligible sections; creating '{V.FIRST_HEADING}'.")
    )
    creates = ~led & F.col("overview_id").isNull()
    return rows.select(
        *change_keys,
        *doc_keys,
        F.when(creates, CREATE).otherwise(UPDATE).alias("decision"),
        F.when(led, F.col("section_id")).otherwise(F.col("overview_id")).alias("section_id"),
        F.when(led, F.col("_own")).otherwise(F.coalesce("overview_heading", F.lit(V.FIRST_HEADING))).alias("heading"),
        reason.alias("reason"),
        creates.alias("skeleton_changes"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.when(led, F.col("ambiguous")).otherwise(~creates).alias("ambiguous"),
        strength.alias("strength"),
    )


def route_packages(parsed: DataFrame, documents: DataFrame, skeletons: DataFrame | None, change: str, doc: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decisions, files, shortlist) of parsed change packages (change, doc and the package's fields)."""
    keys = [change]
    files = package.files(parsed, keys)
    hunks = package.hunks(files, keys)
    of_doc = parsed.select(change, doc)
    signals = scoring.change_signals(files, hunks, parsed.select(change, F.col("generated_summary").alias("summary")), keys).join(of_doc, change)
    shortlist, assessed, catalog = routing_context(signals, documents, skeletons, keys, [doc])
    return decisions(of_doc, assessed, catalog, keys, [doc]), files, shortlist


def run(packages: DataFrame, documents: DataFrame, skeletons: DataFrame | None = None, selected: DataFrame | None = None, change: str = "change_id", doc: str = "doc_id", time: str | None = None, order: str | None = None, routed_on: DataFrame | None = None) -> dict[str, DataFrame]:
    """Record changes in documents.

    ``packages``: change, doc, json.  ``documents``: doc, baseline, updated (null until there is a reviewable copy).
    ``skeletons``: doc and section fields, or None to take them from the baselines.  ``selected``: change, section_id,
    confidence of a generator's valid choices, which go before the rules'.  Several changes of a document are recorded in order of their ids,
    or of ``order``, a column of ``packages``.  ``routed_on``: doc, text that changes are routed on in place of the copies.

    Gives ``updated`` (doc, text), ``skeletons`` and ``results`` (change, doc, decision, section_id, heading, source,
    confidence, placement, skeleton_changes, warnings).  The baseline is never changed.
    """
    keys = [change]
    parsed = package.parse_packages(packages, [change, doc])
    copies = documents.select(doc, F.coalesce("updated", "baseline", F.lit("")).alias("text"))
    if skeletons is None:
        skeletons = lines.skeleton(lines.sections(documents.select(doc, F.col("baseline").alias("text")), [doc]), [doc])
    decided, files, _ = route_packages(parsed, copies if routed_on is None else routed_on, skeletons, change, doc)
    decided = decided.withColumn("source", F.lit("rules"))
    if selected is not None:
        names = skeletons.select(doc, F.col("section_id").alias("_id"), F.col("heading").alias("_heading"))
        chosen = selected.select(change, F.col("section_id").alias("_id"), F.col("confidence").alias("_confidence"))
        rows = decided.join(chosen, change, "left").join(names, [doc, "_id"], "left")
        use = F.col("_heading").isNotNull()
        pick = {"decision": F.lit(UPDATE), "section_id": F.col("_id"), "heading": F.col("_heading"), "confidence": F.col("_confidence"), "source": F.lit("generator"), "ambiguous": F.lit(False), "skeleton_changes": F.lit(False)}
        decided = rows.withColumns({c: F.when(use, v).otherwise(F.col(c)) for c, v in pick.items()}).drop("_id", "_heading", "_confidence")

    missing = context.is_missing_sha(F.col("before_sha"))
    header = parsed.select(
        change,
        F.element_at(F.split(F.coalesce("repository", F.lit("")), "/"), -1).alias("repository"),
        F.coalesce(F.nullif(F.trim("branch"), F.lit("")), F.lit("main")).alias("branch"),
        F.coalesce(F.nullif(F.trim("actor"), F.lit("")), F.lit("local-user")).alias("actor"),
        F.when(~missing, F.col("before_sha")).alias("before_sha"),
        "after_sha",
        F.col("generated_summary").alias("summary"),
        (F.lit(time) if time else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm 'UTC'")).alias("time"),
        missing.alias("no_before"),
    )
    recorded = context.update_block(header, files.select(change, "ordinal", F.col("status").alias("change_type"), "path", "old_path"), keys)
    rows = decided.join(recorded, change)
    # One row for each change, read by all three outputs: routing isn't worked out again for each.
    if order is not None:
        rows = rows.join(packages.select(change, doc, F.col(order).alias("_order")), [change, doc])
    in_turn = Window.partitionBy(doc).orderBy(*(["_order"] if order is not None else []), change)
    rows = keep(rows.withColumn("ordinal", F.row_number().over(in_turn)).drop("_order"), "update")
    under = lines.insert_blocks(copies, rows.where(F.col("decision") == UPDATE).select(doc, "ordinal", "heading", "block"), [doc])
    placed = rows.join(under.select(doc, "found"), doc, "left")
    found = F.coalesce(F.array_contains("found", F.col("ordinal")), F.lit(False)) & (F.col("decision") == UPDATE)
    placed = placed.withColumn("under", found)

    created = F.concat(T.literals([""]), F.array(F.concat(F.lit("## "), "heading")), T.literals([""]), F.col("block"), T.literals([""]))
    loose = F.when(F.col("decision") == CREATE, F.concat(F.array_join(created, "\n"), F.lit("\n"))).otherwise(F.concat(F.lit("\n"), F.array_join("block", "\n"), F.lit("\n")))
    tails = placed.where(~F.col("under")).groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", loose.alias("t")))), lambda x: x["t"]).alias("tails"))
    bare = lambda t: F.regexp_replace(t, r"\n+$", "")
    updated = under.join(tails, doc, "left")
    text = F.when(F.col("tails").isNull(), F.col("text")).otherwise(F.aggregate("tails", F.col("text"), lambda acc, t: F.concat(bare(acc), F.lit("\n"), t)))

    fresh = placed.where(F.col("decision") == CREATE).groupBy(doc).agg(F.min("heading").alias("heading")).select(doc, "heading", F.lit(2).alias("level"), F.lit(None).cast("string").alias("parent_id"))
    kept = skeletons.select(doc, "order", "section_id", "heading", "level", "parent_id", "path", "content_hash")
    warnings = F.array_compact(
        F.array(
            F.when(F.col("no_before"), "no before sha; the list of changed files is empty"),
            F.when(F.col("ambiguous") & (F.col("decision") == UPDATE), "routing was ambiguous; the section needs review"),
            F.when((F.col("decision") == UPDATE) & ~F.col("under"), "heading not found; appended to the end"),
        )
    )
    placement = F.when(F.col("decision") == CREATE, F.concat(F.lit("new section '"), "heading", F.lit("' appended"))).when(F.col("under"), F.concat(F.lit("under existing section '"), "heading", F.lit("'"))).otherwise("appended to end (target heading not found)")
    results = placed.join(header.select(change, "no_before"), change).select(change, doc, "decision", "section_id", "heading", "source", "confidence", placement.alias("placement"), "skeleton_changes", "reason", warnings.alias("warnings"))
    return {"updated": updated.select(doc, text.alias("text")), "skeletons": lines.append_section(kept, fresh, [doc]), "results": results}


def report(results: DataFrame, change: str = "change_id") -> DataFrame:
    """(change, report): a readable account of each run."""
    line = lambda label, c: F.concat(F.rpad(F.lit(f"{label}:"), 19, " "), F.coalesce(c, F.lit("(none)")))
    confidence = F.when(F.col("source") == "generator", F.concat(F.lit(" (confidence "), F.format_number("confidence", 2), F.lit(")"))).otherwise("")
    rows = F.array(line("Routing decision", F.col("decision")), line("Routing source", F.concat("source", confidence)), line("Placement", F.col("placement")), line("Reasoning", F.col("reason")))
    rule = T.literals(["=" * 60])
    return results.select(change, F.array_join(F.concat(rule, rows, F.transform("warnings", lambda w: F.concat(F.lit("! "), w)), rule), "\n").alias("report"))
