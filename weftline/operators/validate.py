"""Validators: each rule is a column, and a row's ``problems`` are the rules that it breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import vocabulary as V


def problems(rules: dict[str, Column]) -> Column:
    """The names of the rules whose condition is true, in order; null counts as false."""
    return F.array_compact(F.array(*(F.when(c, name) for name, c in rules.items())))


def summary_problems(text: Column) -> Column:
    """Structure of a generated Markdown summary: one title, 4 to 12 distinct, specific, filled sections."""

    def of_parts(own: Column, parts: Column) -> Column:
        sections = F.filter(parts, lambda p: p["level"] == 2)
        heads = F.transform(sections, lambda p: T.normal_heading(p["heading"]))
        return problems(
            {
                "empty": own == "",
                "wrapped in a fence": own.startswith("```"),
                "too short": F.length(own) < 400,
                "not one title": F.size(F.filter(parts, lambda p: p["level"] == 1)) != 1,
                "not 4 to 12 sections": ~F.size(sections).between(4, 12),
                "duplicate sections": F.size(F.array_distinct(heads)) < F.size(heads),
                "generic section": F.exists(heads, lambda h: h.isin(V.GENERIC_HEADINGS)),
                "section without content": F.exists(sections, lambda p: F.length(p["content"]) < 20),
            }
        )

    return T.let(T.strip(F.coalesce(text, F.lit(""))), lambda own: T.let(T.heading_parts(own), lambda parts: of_parts(own, parts)))


def has_headings(text: Column, title: str, headings: list[str]) -> Column:
    return F.forall(T.literals([title, *(f"## {h}" for h in headings)]), lambda h: F.contains(F.coalesce(text, F.lit("")), h))


def is_evidence(path: Column, excluded: list[str] = []) -> Column:  # noqa: B006
    """Whether a file may show what a project uses: no test, artifact or named exception."""
    low = F.lower(F.regexp_replace(path, r"\\", "/"))
    name = T.file_name(low)
    return ~(low.rlike(r"(^|/)(tests|artifacts|__pycache__|\.venv)(/|$)") | name.startswith("test_") | name.endswith("_test.py") | (name == "conftest.py") | low.isin(excluded))


def imports(content: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(r"(?m)^\s*(?:from|import)\s+([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)), F.lower))


def affirms(claim: str, content: Column) -> Column:
    """A sentence or line states the claim without a word of denial."""
    pieces = F.split(F.lower(F.coalesce(content, F.lit(""))), r"[.\n]")
    return F.exists(pieces, lambda s: s.rlike(rf"\b{claim}\b") & ~F.exists(T.literals(V.NEGATIONS), lambda cue: F.contains(s, cue)))


def shown_claims(path: Column, content: Column) -> Column:
    """The claims that a file is evidence for: a library in a manifest, an import of one, or a README that says so."""
    low, name = F.lower(F.coalesce(content, F.lit(""))), T.file_name(F.lower(path))
    found = imports(content)

    def shown(claim: str) -> Column:
        libraries = V.LIBRARIES[claim]
        listed = T.any_of(low.rlike(rf"(?<![\w-]){lib}(?![\w-])") for lib in libraries)
        return (name.isin(V.MANIFESTS) & listed) | (name.endswith(".py") & F.arrays_overlap(found, T.literals(libraries))) | (name.startswith("readme") & affirms(claim, content))

    none = F.array().cast("array<string>")
    # Only manifests, sources and README files are looked into.
    telling = is_evidence(path) & (name.isin(V.MANIFESTS) | name.endswith(".py") | name.startswith("readme"))
    return F.when(telling, F.array_compact(F.array(*(F.when(shown(c), c) for c in sorted(V.LIBRARIES))))).otherwise(none)


def claim_evidence(files: DataFrame, keys: list[str], claim: str, path: str = "path", content: str = "content") -> DataFrame:
    """Keys with evidence for a claim."""
    return files.where(F.array_contains(shown_claims(F.col(path), F.col(content)), claim)).select(*keys).distinct()


def json_object(text: Column) -> Column:
    """From the first brace to the last, if that is JSON; else null."""
    start, end = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    own = F.when((start > 0) & (F.instr(text, "}") > 0) & (end > start), F.substring(text, start, end - start + 1))
    return F.when(F.json_object_keys(own).isNotNull(), own)


def strict_json_object(text: Column) -> Column:
    """Exactly one object, alone or in one fence; else null."""
    bare = T.strip(F.regexp_replace(T.strip(text), r"(?s)^```(?:json)?\s*\n(.*)\n```$", "$1"))
    alone = F.concat(F.lit("["), bare, F.lit("]"))  # what stands after a first object makes this no list, or one of two
    return F.when(bare.startswith("{") & bare.endswith("}") & F.json_object_keys(bare).isNotNull() & F.try_parse_json(alone).isNotNull() & (F.json_array_length(alone) == 1), bare)


def key_problems(json: Column, allowed: list[str], required: list[str] | None = None) -> Column:
    """``unexpected k`` and ``missing k`` for an object's keys."""
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    more, less = F.array_except(keys, T.literals(allowed)), F.array_except(T.literals(required or allowed), keys)
    return F.concat(F.transform(F.array_sort(more), lambda k: F.concat(F.lit("unexpected "), k)), F.transform(F.array_sort(less), lambda k: F.concat(F.lit("missing "), k)))


def confidence(json: Column, path: str = "$.confidence") -> Column:
    """A number from 0 to 1 as it stands in the JSON; text, null and booleans give null."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), path, "variant"))
    value = F.get_json_object(json, path).try_cast("double")
    return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)") & value.between(0, 1), value)


def selection_problems(json: Column, candidates: Column) -> Column:
    """An answer that picks one of ``candidates``: four keys, a listed id, a confidence, a reason."""
    get = lambda k: F.get_json_object(json, f"$.{k}")
    keys = ["decision", "section_id", "confidence", "reasoning"]
    rules = problems({"not an object": json.isNull(), "unlisted section": ~F.array_contains(candidates, F.coalesce(get("section_id"), F.lit(""))), "bad confidence": confidence(json).isNull(), "no reasoning": F.coalesce(T.strip(get("reasoning")), F.lit("")) == ""})
    return F.concat(rules, key_problems(json, keys))


PATCH_KEYS = ["schema_version", "operation", "target_id", "new_text", "confidence", "reasoning"]


def patch_problems(json: Column, operations: Column, targets: Column) -> Column:
    get = lambda k: F.get_json_object(json, f"$.{k}")
    edits = get("operation").isin("replace_sentence", "replace_block")
    rules = problems(
        {
            "not an object": json.isNull(),
            "bad version": F.coalesce(get("schema_version"), F.lit("")) != "1",
            "operation not allowed": ~F.array_contains(operations, F.coalesce(get("operation"), F.lit(""))),
            "unknown target": edits & ~F.array_contains(targets, F.coalesce(get("target_id"), F.lit(""))),
            "bad confidence": confidence(json).isNull(),
            "no reasoning": F.coalesce(T.strip(get("reasoning")), F.lit("")) == "",
        }
    )
    return F.concat(rules, key_problems(json, PATCH_KEYS))


def mutation_problems(new: Column, old: Column, most: int = 1200) -> Column:
    """A replacement text: filled, changed, of bounded growth, with the list marker of the old one."""
    marker = lambda c: F.regexp_extract(c, r"^(\s*)([-*+]|\d+[.)])\s+", 2)
    return problems(
        {
            "empty": T.strip(F.coalesce(new, F.lit(""))) == "",
            "too long": F.length(new) > most,
            "unchanged": T.strip(new) == T.strip(old),
            "grows too much": F.length(new) > F.greatest(F.length(old) * 2, F.length(old) + 600),
            "list marker lost": (marker(old) != "") & (marker(new) != marker(old)),
        }
    )


def grounding_problems(new: Column, corpus: Column) -> Column:
    """What a text may not contain, and identifiers, paths, versions and numbers that the evidence doesn't have."""
    low = F.lower(F.coalesce(corpus, F.lit("")))
    missing = lambda pattern: F.exists(F.regexp_extract_all(new, F.lit(pattern), F.lit(1)), lambda x: ~F.contains(low, F.lower(x)))
    return problems(
        {
            "region marker": new.rlike(f"{V.REGION_START}|{V.REGION_END}"),
            "heading": new.rlike(r"(?m)^\s{0,3}#{1,6}\s"),
            "fence": new.rlike("```|~~~"),
            "table": new.rlike(r"(?m)^\s*\|.*\|"),
            "control character": new.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"),
            "unknown identifier": missing(r"`([^`\n]+)`"),
            "unknown path": missing(r"(\b[\w.-]+/[\w./-]+\b|\b[\w-]+\.(?:py|md|json|toml|ya?ml|ini|cfg|txt|js|ts)\b)"),
            "unknown version": missing(r"(\bv?\d+\.\d+(?:\.\d+)?\b)"),
            "unknown number": missing(r"(\b\d+%|\b\d{2,}\b)"),
        }
    )


def gate(kind: Column, confidence: Column, least: float = 0.75, least_no_change: float = 0.90) -> Column:
    """What becomes of a planned patch: manual review under its confidence bound."""
    bound = F.when(kind == "no_change", least_no_change).otherwise(least)
    return F.when(confidence.isNull() | (confidence < bound), "manual_review").when(kind == "no_change", "no_change").otherwise("planned")
