"""From change packages and documents to sections and places, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import vocabulary as V
from weftline.operators import blocks, lines, package, prompts, scoring
from weftline.plans import index as stored_index
from weftline.session import keep
from weftline.sources import readers


def route(packages: DataFrame, documents: DataFrame, change: str = "change_id", doc: str = "doc_id", choose=None) -> dict[str, DataFrame]:
    """``packages``: change, doc, json.  ``documents``: doc, text.  ``choose``: from shortlist and leaders to (change, section_id) of
    changes whose section somebody else has picked.

    Gives ``shortlist``, ``assessed`` and ``decided`` sections, and ``places``, the shortlist of
    blocks and sentences in each decided section, with ``placed``, the verdict on them; and what a plan of edits reads beside these:
    ``files``, ``hunks``, ``evidence``, ``catalog`` and ``texts``, the candidates' texts with what stands around them.
    """
    keys = [change]
    parsed = keep(package.parse_packages(packages, [change, doc]), "parsed")
    of_doc = parsed.select(change, doc).distinct()
    files = package.files(parsed, keys)
    hunks = package.hunks(files, keys)
    signals = keep(scoring.change_signals(files, hunks, parsed.select(change, F.col("generated_summary").alias("summary")), keys).join(of_doc, change), "signals")
    catalog = scoring.catalog(lines.sections(documents, [doc]), [doc])
    # Written, for routing and places are read several times by all that follows.
    catalog = keep(catalog, "catalog")
    shortlist = keep(scoring.route(signals, catalog, keys, [doc]), "shortlist")
    assessed = scoring.assess(shortlist, keys)
    decided = scoring.decide(assessed.join(of_doc, change), catalog, keys, [doc])

    if choose is not None:
        picked = choose(shortlist, assessed.select(change, "section_id")).select(change, F.col("section_id").alias("_picked"))
        decided = decided.join(picked, change, "left").withColumn("action", F.when(F.col("_picked").isNotNull(), "update_section").otherwise(F.col("action"))).withColumn("section_id", F.coalesce("_picked", "section_id")).drop("_picked")

    chosen = decided.where("action = 'update_section'").select(change, "section_id").join(of_doc, change)
    _, indexed = blocks.block_index(documents, [doc])
    own = keep(blocks.eligible(indexed).join(chosen, [doc, "section_id"]), "blocks").select(change, doc, "block_id", F.col("block_id").alias("candidate_id"), F.col("block_order"), F.col("block_text").alias("text"), "content_text", "block_type")
    parts = blocks.sentence_rows(own.select(change, "block_id", "content_text", "block_type"), keys)
    sentences = own.select(change, "block_id", "block_order").join(parts.select(change, "block_id", F.col("sentence_id").alias("candidate_id"), "sentence_order", "text"), [change, "block_id"])
    evidence = keep(placement_signals(files, hunks, parsed, keys), "evidence")
    scored = scoring.placement_scores(own.join(evidence, change))
    fine = scoring.placement_scores(sentences.join(evidence, change))
    places = keep(scoring.placement_shortlist(scoring.granularity(scored, fine, keys), keys), "places")
    meaningful = evidence.select(change, F.transform(F.flatten(F.array("symbols", "paths", "modules", "removed", "added", "hunk")), F.lower).alias("signals"))
    around = scoring.with_context(own.select(change, "candidate_id", "block_id", "block_order", "text"), keys)
    parents = around.select(change, "block_id", F.col("text").alias("parent_text"), "previous_excerpt", "next_excerpt")
    no_parent = F.lit(None).cast("string").alias("parent_text")
    texts = around.select(change, "candidate_id", "text", no_parent, "previous_excerpt", "next_excerpt").unionByName(sentences.join(parents, [change, "block_id"]).select(change, "candidate_id", "text", "parent_text", "previous_excerpt", "next_excerpt"))
    placed = scoring.place(places, meaningful, keys)
    return {"shortlist": shortlist, "assessed": assessed, "decided": decided, "places": places, "placed": placed, "files": files, "hunks": hunks, "evidence": evidence, "catalog": catalog, "texts": texts}


def refused(documents: DataFrame, index: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, refusal): documents whose stored index (doc, json) can't be used, and why; offsets of such an index are not to be trusted."""
    rows = documents.select(doc, F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("_sha")).join(index.select(doc, "json"), doc, "left")
    same = F.get_json_object("json", "$.source.sha256") == F.col("_sha")
    why = F.coalesce(stored_index.problem(F.col("json")), F.when(~F.coalesce(same, F.lit(False)), "stale index"))
    return rows.select(doc, why.alias("refusal")).where("refusal is not null")


def placement_signals(files: DataFrame, hunks: DataFrame, parsed: DataFrame, keys: list[str]) -> DataFrame:
    """The token sets that placement reads, one row per change."""
    paths = files.select(*keys, F.explode(F.array_compact(F.array("path", "old_path"))).alias("p")).groupBy(*keys).agg(F.array_sort(F.collect_set("p")).alias("paths"), F.array_sort(F.collect_set(T.file_stem(F.col("p")))).alias("modules"))
    first = hunks.where("hunk < 5")
    some = lambda c: F.flatten(F.transform(F.slice(F.col(c), 1, 10), lambda x: T.keywords(F.substring(x, 1, 200))))
    gathered = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    sides = first.groupBy(*keys).agg(
        gathered(F.col("symbols")).alias("symbols"),
        gathered(some("removed_lines")).alias("removed"),
        gathered(some("added_lines")).alias("added"),
        gathered(F.array_union(T.keywords(F.col("summary")), T.keywords(F.col("hunk_header")))).alias("hunk"),
    )
    none = F.array().cast("array<string>")
    out = paths.join(sides, keys, "left").join(parsed.select(*keys, T.keywords(F.col("generated_summary")).alias("summary")), keys, "left")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("symbols", "removed", "added", "hunk", "summary")})
    return out.withColumn("change_categories", T.categories(F.array_join(F.array_sort(F.array_union("paths", "modules")), " ")))


def run(packages: DataFrame, documents: DataFrame, override: DataFrame | None = None, generate=None, least: float = V.MIN_CONFIDENCE, change: str = "change_id", doc: str = "doc_id", patch=None, index: DataFrame | None = None) -> DataFrame:
    """(change, report): what would be done, as JSON; nothing is written.

    ``override``: change, section_id, which go before everything else.  ``generate``: a text generator that may pick among the
    shortlisted sections.  ``patch``: one that plans an edit of the places found (``plans.patch``), its plan stands under ``patch``.
    ``index``: doc, json, stored indexes; a change of a document whose index is missing, broken, unknown or stale has that as its status and no more.
    A package of an unknown version, or one that is no object, gives its status alone.
    """
    keys = [change]
    checked = readers.supported(packages)
    if index is not None:
        why = refused(documents, index, doc)
        checked = checked.join(why, doc, "left").withColumn("status", F.when((F.col("status") == "ok") & F.col("refusal").isNotNull(), F.col("refusal")).otherwise(F.col("status"))).drop("refusal")
    checked = keep(checked, "checked")
    fine = checked.where("status = 'ok'")

    def choose(shortlist: DataFrame, leaders: DataFrame) -> DataFrame:
        picked = override
        if generate is not None:
            named = package.parse_packages(fine, keys).select(change, F.coalesce("generated_summary", F.lit("")).alias("summary"))
            asked = prompts.selection_prompt(shortlist, named, keys)
            answers = prompts.ask(asked, keys, generate)
            own = prompts.selected_sections(answers, asked, leaders, keys, least).where("source = 'generator'").select(change, "section_id")
            picked = own if picked is None else picked.unionByName(own.join(picked.select(change), change, "left_anti"))
        return leaders.limit(0) if picked is None else picked

    found = route(fine, documents, change, doc, choose if override is not None or generate is not None else None)
    shortlist = found["shortlist"].groupBy(change).agg(F.array_sort(F.collect_list(F.struct("rank", "section_id", "score", "matched_signals"))).alias("shortlist"))
    places = found["places"].groupBy(change).agg(F.array_sort(F.collect_list(F.struct("rank", "candidate_id", "candidate_type", "score"))).alias("candidates"))
    hashes = checked.join(documents, doc, "left").select(change, "status", F.sha2(F.col("json").cast("binary"), 256).alias("package_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("document_sha256"))
    placed = found["placed"].select(change, F.struct("recommendation", "candidate_id", "confidence", "ambiguous").alias("placement"))
    out = hashes.join(found["decided"].select(change, F.struct("action", "section_id", "confidence", "ambiguous").alias("routing")), change, "left")
    out = out.join(shortlist, change, "left").join(placed, change, "left").join(places, change, "left")
    shown = ["status", "package_sha256", "document_sha256", "routing", "shortlist", "placement", "candidates"]
    if patch is not None:
        from weftline.plans import patch as planner

        planned = planner.planned(fine, documents, found, patch, least, change, doc)
        out = out.join(planned.select(change, F.struct(*(c for c in planned.columns if c != change)).alias("patch")), change, "left")
        shown.append("patch")
    return out.select(change, F.to_json(F.struct(*shown)).alias("report"))
