"""Column functions over text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import vocabulary as V


def literals(values) -> Column:
    return F.array(*map(F.lit, values))


def any_of(flags) -> Column:
    return reduce(lambda a, b: a | b, flags)


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lines(c: Column) -> Column:
    """Lines at any line break; a final break opens no line."""
    parts = F.split(F.coalesce(c, F.lit("")), V.LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def words(c: Column) -> Column:
    """Distinct lower-case runs of ASCII word characters."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([A-Za-z0-9_]+)"), F.lit(1)), F.lower))


def keywords(c: Column, limit: int = V.KEYWORD_LIMIT) -> Column:
    """Technical keywords in first-seen order.

    A raw token (letters, digits and ``_ . / \\ -``) gives itself if it is compound or of
    mixed case, then its separated parts, each followed by its camel-case pieces.
    """

    def of_part(part: Column) -> Column:
        spaced = F.regexp_replace(part, "([A-Z])(?=[A-Z][a-z])", "$1 ")
        return F.concat(F.array(part), F.regexp_extract_all(spaced, F.lit(r"([A-Z][a-z]+|[A-Z]+|[a-z]+|\d+)"), F.lit(1)))

    def of_token(token: Column) -> Column:
        whole = token.rlike(r"[_\-./\\]") | ((token != F.lower(token)) & (token != F.upper(token)))
        parts = F.filter(F.split(token, r"[_\-./\\]+"), lambda p: p != "")
        every = F.concat(F.when(whole, F.array(token)).otherwise(F.array().cast("array<string>")), F.flatten(F.transform(parts, of_part)))
        # Plain words, which most tokens are, have no parts but themselves.
        return F.when(token.rlike("^[A-Z]?[a-z]+$"), F.array(token)).otherwise(every)

    # From the first letter or digit of a run to its last; each distinct one is taken apart once.
    raw = F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([A-Za-z0-9](?:[A-Za-z0-9_./\\-]*[A-Za-z0-9])?)"), F.lit(1)))
    every = F.array_distinct(F.transform(F.flatten(F.transform(raw, of_token)), F.lower))
    kept = F.filter(every, lambda t: (F.length(t) >= 2) & ~t.isin(V.STOP_WORDS) & ~t.rlike(r"^\d+$"))
    return F.slice(kept, 1, limit)


def dashed(c: Column) -> Column:
    """Letters and digits in lower case with dashes between them; empty without any, null for null."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug(c: Column) -> Column:
    own = dashed(F.coalesce(c, F.lit("")))
    return F.when(own == "", "section").otherwise(own)


def normal_heading(c: Column) -> Column:
    return F.lower(strip(F.regexp_replace(strip(c), r"(?U)\s*:\s*[-–—]?\s*$", "")))


def content_hash(c: Column) -> Column:
    own = strip(F.coalesce(c, F.lit("")))
    return F.when(own != "", F.sha2(own.cast("binary"), 256))


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 8)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """After the last dot, lower-case; null without one."""
    return F.when(F.instr(path, ".") > 0, F.nullif(F.lower(F.element_at(F.split(path, r"\."), -1)), F.lit("")))


def numbering_prefix(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), V.NUMBERING, 1), F.lit(""))


def numbering_depth(prefix: Column) -> Column:
    return F.when(prefix.isNotNull(), F.length(prefix) - F.length(F.replace(prefix, F.lit("."), F.lit(""))) + 1)


def sentence_count(c: Column) -> Column:
    """Sentence-like pieces, once a section number and decimals are masked; 0 only for blank text."""
    own = strip(F.coalesce(c, F.lit("")))
    bare = F.regexp_replace(own, V.NUMBERING, "")
    masked = F.regexp_replace(F.when(bare == "", own).otherwise(bare), r"\d{1,2}(?:\.\d{1,2})+", " ")
    pieces = F.filter(F.split(masked, r"[.!?]+(?:\s|$)"), lambda p: strip(p) != "")
    return F.when(own == "", 0).otherwise(F.greatest(F.size(pieces), F.lit(1)))


def ends_with_colon(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"(?U):[-–—]?\s*$")


def ends_with_full_stop(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"(?U)\.\s*$")


def is_title_case(c: Column) -> Column:
    """Every word that isn't a small one starts with a capital, and there is one."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([A-Za-z][A-Za-z'\-]*)"), F.lit(1))
    large = F.filter(found, lambda w: ~F.lower(w).isin(V.TITLE_STOP_WORDS))
    return (F.size(large) > 0) & F.forall(large, lambda w: w.rlike("^[A-Z]"))


def is_all_caps(c: Column) -> Column:
    letters = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}]", "")
    return (letters != "") & letters.rlike(r"^\p{Lu}+$")


def note_or_link(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), V.NOTE_OR_LINK, 1)), F.lit(""))


def categories(c: Column) -> Column:
    """Categories by alias: phrases anywhere in the text, single words among its first keywords."""

    def found(aliases: list[str], low: Column, tokens: Column) -> Column:
        phrases = [a for a in aliases if " " in a or "/" in a]
        single = F.arrays_overlap(tokens, literals([a for a in aliases if a not in phrases]))
        return any_of([single, *(F.contains(low, F.lit(p)) for p in phrases)])

    def named(both: Column) -> Column:
        return F.array_compact(F.array(*(F.when(found(aliases, both["low"], both["tokens"]), name) for name, aliases in sorted(V.CATEGORY_ALIASES.items()))))

    return let(F.struct(F.lower(F.coalesce(c, F.lit(""))).alias("low"), keywords(c).alias("tokens")), named)


def path_categories(path: Column) -> Column:
    """The first rule that fits a path, and the risk category on top of it."""
    low = F.lower(F.coalesce(path, F.lit("")))
    name = file_name(low)
    ends = lambda *suffixes: any_of(low.endswith(s) for s in suffixes)
    one = (
        F.when(low == "", literals([]).cast("array<string>"))
        .when(low.rlike(V.TEST_PATH), literals(["testing"]))
        .when(low.startswith(".github/") | F.contains(low, F.lit(".github/workflows")) | name.isin(V.CI_NAMES), literals(["ci_deployment"]))
        .when(name.isin(V.CONFIG_NAMES) | low.startswith("config/") | F.contains(low, F.lit("/config/")), literals(["configuration_dependencies"]))
        .when(name.startswith("readme") | low.startswith("docs/") | low.endswith(".md"), literals(["documentation", "overview"]))
        .when(ends(".json", ".toml", ".ini", ".cfg", ".yml", ".yaml", ".env"), literals(["configuration_dependencies"]))
        .when(name.rlike(V.AUTOMATION_NAME), literals(["automation_pipeline"]))
        .when(ends(".py", ".js", ".ts", ".go", ".java", ".rb", ".rs"), literals(["architecture_modules"]))
        .otherwise(literals([]).cast("array<string>"))
    )
    risk = F.when(any_of(F.contains(low, F.lit(w)) for w in V.RISK_WORDS), literals(["limitations_risks"])).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_union(risk, one))


def context_priority(path: Column) -> Column:
    low = F.lower(path)
    name = file_name(low)
    ends = lambda *suffixes: any_of(name.endswith(s) for s in suffixes)
    return (
        F.when(name.startswith("readme"), 0)
        .when(name.isin(V.PROMPT_MANIFESTS), 1)
        .when(low.startswith(".github/workflows"), 2)
        .when(low.startswith("config/") | ends(".toml", ".ini", ".cfg", ".json"), 3)
        .when(low.startswith("src/") & any_of(F.contains(name, F.lit(w)) for w in V.ORCHESTRATION), 4)
        .when(low.startswith("src/"), 5)
        .when(low.startswith("tests/") | low.startswith("docs/") | ends(".md"), 6)
        .otherwise(7)
    )


def redacted(c: Column) -> Column:
    own = reduce(lambda t, p: F.regexp_replace(t, p, "[redacted]"), V.SECRETS, strip(F.coalesce(c, F.lit(""))))
    return F.when(F.length(own) > V.DIAGNOSTIC_CHARS, F.concat(F.substring(own, 1, V.DIAGNOSTIC_CHARS), F.lit("… [truncated]"))).otherwise(own)


def is_inventory_item(line: Column) -> Column:
    """A list item of at most three words, one of which is a path."""
    body = F.nullif(F.trim(F.replace(F.regexp_extract(line, r"^\s*(?:[-*+]|\d+[.)])\s+(.*)$", 1), F.lit("`"), F.lit(""))), F.lit(""))
    own = F.split(body, r"\s+")
    path = r"^(?:[\w./\\-]+\.(?:py|js|ts|go|java|rb|rs|md|txt|json|toml|ini|cfg|ya?ml)|[\w./\\-]+/[\w./\\-]*)$"
    return F.coalesce((F.size(own) <= 3) & F.exists(own, lambda w: F.regexp_replace(w, "[:,;.]+$", "").rlike(path)), F.lit(False))


def is_inventory_block(text: Column) -> Column:
    """A one-line block that is nothing but a path, a file or a dotted name."""
    own = strip(F.coalesce(text, F.lit("")))
    body = F.regexp_replace(own, r"^\s*(?:[-*+]|\d+[.)])\s+", "")
    body = F.regexp_replace(strip(F.replace(body, F.lit("`"), F.lit(""))), "[.,;:]+$", "")
    name = r"^[\w.\-]+(?:/[\w.\-]+)+$|^[\w\-]+\.(?:py|js|ts|go|java|rb|rs|md|txt|json|toml|ya?ml|ini|cfg|lock|sh)$|^[\w\-]+(?:\.[\w\-]+)+$"
    return (own != "") & ~F.contains(own, F.lit("\n")) & ~body.rlike("[ \t]") & body.rlike("(?U)" + name)


def without_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<!--.*?-->", " ")


def _kept_lines(c: Column, step) -> Column:
    """Lines for which ``step(inside, line)``, a (inside, keep) struct, says keep."""
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("out"))

    def fold(acc: Column, line: Column) -> Column:
        inside, keep = step(acc["inside"], line)
        return F.struct(inside.alias("inside"), F.when(keep, F.concat(acc["out"], F.array(line))).otherwise(acc["out"]).alias("out"))

    return F.array_join(F.aggregate(lines(c), start, fold, lambda a: a["out"]), "\n")


def without_regions(c: Column) -> Column:
    """Without generated regions; a line that both opens and closes one opens it."""

    def step(inside: Column, line: Column):
        opens, closes = F.contains(line, F.lit(V.REGION_START)), F.contains(line, F.lit(V.REGION_END))
        return F.when(opens, True).when(closes, False).otherwise(inside), ~opens & ~closes & ~inside

    return _kept_lines(c, step)


def without_fences(c: Column) -> Column:
    def step(inside: Column, line: Column):
        fence = line.rlike(r"^\s*(```|~~~)")
        return F.when(fence, ~inside).otherwise(inside), ~fence & ~inside

    return _kept_lines(c, step)


HEADING = r"(?U)^(#{1,6})\s+(.+?)\s*#*\s*$"


def heading_parts(c: Column) -> Column:
    """(level, heading, content) of each heading outside fences, content up to the next one; what stands before the first is left out."""

    def fold(acc: Column, line: Column) -> Column:
        fence = line.rlike(r"^\s*(```|~~~)")
        head = ~fence & ~acc["inside"] & line.rlike(HEADING)
        own = F.when(head, F.concat(F.lit("\x01"), line)).otherwise(line)
        return F.struct(F.when(fence, ~acc["inside"]).otherwise(acc["inside"]).alias("inside"), F.concat(acc["out"], F.array(own)).alias("out"))

    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("out"))
    clean = F.replace(F.coalesce(c, F.lit("")), F.lit("\x01"), F.lit(""))
    parts = F.split(F.array_join(F.aggregate(lines(clean), start, fold, lambda a: a["out"]), "\n"), "\x01")

    def one(part: Column) -> Column:
        line = F.regexp_extract(part, r"^[^\n]*", 0)
        return F.struct(F.length(F.regexp_extract(line, HEADING, 1)).alias("level"), F.regexp_extract(line, HEADING, 2).alias("heading"), strip(F.regexp_replace(part, r"^[^\n]*\n?", "")).alias("content"))

    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), one)


def keyword_content(c: Column) -> Column:
    return without_fences(without_comments(without_regions(c)))


def direct_content(c: Column) -> Column:
    return F.array_join(F.filter(lines(keyword_content(c)), lambda x: ~F.ltrim(x).startswith("|") & ~is_inventory_item(x)), "\n")


def letters_of(n: Column) -> Column:
    """1 -> a, 26 -> z, 27 -> aa; empty below 1."""

    def step(acc: Column, _: Column) -> Column:
        rest = acc["n"] - 1
        return F.when(acc["n"] <= 0, acc).otherwise(F.struct(F.floor(rest / 26).cast("int").alias("n"), F.concat(F.char(F.lit(97) + F.pmod(rest, F.lit(26))), acc["out"]).alias("out")))

    start = F.struct(n.cast("int").alias("n"), F.lit("").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), start, step, lambda a: a["out"])


def roman_of(n: Column) -> Column:
    """Lower-case roman numeral of a positive number; empty below 1."""
    values = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]
    table = F.array(*(F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in values))
    start = F.struct(F.greatest(n.cast("int"), F.lit(0)).alias("n"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        times = F.floor(acc["n"] / x["v"]).cast("int")
        return F.struct((acc["n"] - times * x["v"]).alias("n"), F.concat(acc["out"], F.repeat(x["s"], times)).alias("out"))

    return F.aggregate(table, start, step, lambda a: a["out"])
