"""Heading detection on paragraph features: votes, repeats, scores, levels, list counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import vocabulary as V


def first_seen_mode(rows: DataFrame, keys: list[str], value: str, pos: str = "pos", nulls: bool = False, name: str = "mode") -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the first seen.  Nulls count only with ``nulls``."""
    own = rows if nulls else rows.where(F.col(value).isNotNull())
    counted = own.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(pos).alias("at"))
    return counted.groupBy(*keys).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct("n", -F.col("at"))).alias("m")).select(*keys, F.col("m.v").alias(name))


def weighted_share(flag: Column, weight: Column) -> Column:
    """Weight of rows with the flag over all weight; 0 without weight.  An aggregate."""
    return F.coalesce(F.sum(F.when(flag, weight).otherwise(0)) / F.nullif(F.sum(weight), F.lit(0)), F.lit(0.0))


def run_formatting(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Paragraph flags from runs by their share of visible characters; sizes and fonts by first-seen mode."""
    visible = runs.where(T.strip(F.coalesce("text", F.lit(""))) != "").withColumn("w", F.length(F.regexp_replace("text", r"(?U)\s", "")))
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    flags = visible.groupBy(*keys).agg((weighted_share(is_("bold"), F.col("w")) >= 0.75).alias("is_bold"), (weighted_share(is_("italic"), F.col("w")) >= 0.5).alias("is_italic"), (weighted_share(is_("underline"), F.col("w")) >= 0.75).alias("is_underlined"))
    for column, name, nulls in (("size", "font_size", False), ("font", "font_family", False), ("color", "font_color", True)):
        flags = flags.join(first_seen_mode(visible, keys, column, "run_no", nulls, name), keys, "left")
    return flags.withColumn("is_colored", is_colored(F.col("font_color")))


def is_colored(c: Column) -> Column:
    """Neither unset, automatic nor black (a neutral theme colour counts as black)."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return ~(low.isin("", "auto", "automatic", "000000", "#000000") | low.rlike(r"^theme:(text|dark|tx|dk|background)[_ ]?[0-9]*"))


def text_features(paragraphs: DataFrame, text: str = "text") -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return paragraphs.withColumns(
        {
            "word_count": F.size(F.filter(F.split(T.strip(t), r"(?U)\s+"), lambda w: w != "")),
            "sentence_count": T.sentence_count(t),
            "numbering_prefix": T.numbering_prefix(t),
            "is_title_case": T.is_title_case(t),
            "is_all_caps": T.is_all_caps(t),
            "ends_with_full_stop": T.ends_with_full_stop(t),
            "ends_with_colon": T.ends_with_colon(t),
        }
    )


def official_level(style: Column) -> Column:
    """The level of a ``Heading N`` style, 1 to 9."""
    n = F.regexp_extract(F.coalesce(style, F.lit("")), r"(?i)^\s*heading\s+(\d+)\s*$", 1).try_cast("int")
    return F.when(n.between(1, 9), n)


def body_formatting(features: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, body_font_size, body_font_family, body_font_color) by vote.

    Voters are Normal or list paragraphs, of them the plain ones if there are any; without such, all that are no headings.
    """
    w = Window.partitionBy(*keys)
    normal = (F.lower(F.coalesce("style_name", F.lit(""))) == "normal") | F.coalesce("is_word_list_item", F.lit(False))
    plain = ~F.coalesce("is_bold", F.lit(False)) & ~F.coalesce("is_underlined", F.lit(False)) & ~F.coalesce("is_colored", F.lit(False))
    rows = features.where(~F.coalesce("is_official_heading", F.lit(False))).withColumn("_n", normal).withColumn("_p", normal & plain)
    rows = rows.withColumn("_any_n", F.bool_or("_n").over(w)).withColumn("_any_p", F.bool_or("_p").over(w))
    voters = rows.where(F.when(F.col("_any_p"), F.col("_p")).when(F.col("_any_n"), F.col("_n")).otherwise(True))
    out = features.select(*keys).distinct()
    for c, nulls in (("font_size", False), ("font_family", False), ("font_color", True)):
        out = out.join(first_seen_mode(voters, keys, c, "pos", nulls, f"body_{c}"), keys, "left")
    return out


def signature() -> Column:
    """The eight-part formatting signature; sizes are rounded half to even."""
    return F.struct(F.bround("font_size").cast("int").alias("size"), F.col("font_family").alias("family"), F.col("is_bold").alias("bold"), F.col("is_underlined").alias("underlined"), F.col("font_color").alias("color"), F.col("spacing_before").alias("before"), F.col("spacing_after").alias("after"), "alignment")


def repeated_patterns(features: DataFrame, keys: list[str]) -> DataFrame:
    """``repeated_formatting_pattern``: the signature occurs twice or more in the document and isn't the body's."""
    rows = features.withColumn("_s", signature())
    body = [F.bround("body_font_size").cast("int"), F.col("body_font_family"), F.lit(False), F.lit(False), F.col("body_font_color")]
    same = [F.col(f"_s.{n}").eqNullSafe(b) for n, b in zip(("size", "family", "bold", "underlined", "color"), body, strict=True)]
    differs = ~(same[0] & same[1] & same[2] & same[3] & same[4])
    return rows.withColumn("repeated_formatting_pattern", (F.count("*").over(Window.partitionBy(*keys, "_s")) >= 2) & differs).drop("_s")


def _flag(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def heading_signals(limits: dict = V.HEADING_LIMITS) -> dict[str, Column]:
    """Each signal's condition, in the order in which signals are named."""
    other_family = (F.coalesce("font_family", F.lit("")) != "") & (F.coalesce("body_font_family", F.lit("")) != "") & (F.col("font_family") != F.col("body_font_family"))
    size_off = F.abs(F.col("font_size") - F.col("body_font_size")) > limits["body_size_tolerance"]
    body = ~(_flag("is_bold") | _flag("is_underlined") | _flag("is_colored")) & ~F.coalesce(other_family, F.lit(False)) & ~F.coalesce(size_off, F.lit(False))
    votes = sum(c.cast("int") for c in (F.col("word_count") > 10, _flag("ends_with_full_stop"), F.col("sentence_count") > 1, body))
    return {
        "numbering_prefix": F.col("numbering_prefix").isNotNull(),
        "bold": _flag("is_bold"),
        "larger_font": F.coalesce(F.col("font_size") >= F.col("body_font_size") + limits["larger_font_min_delta"], F.lit(False)),
        "different_font_family": F.coalesce(other_family, F.lit(False)),
        "underlined": _flag("is_underlined"),
        "few_words": F.col("word_count") < limits["few_words_max"],
        "colon_ending": _flag("ends_with_colon"),
        "spacing_before": F.coalesce(F.col("spacing_before") > 0, F.lit(False)),
        "spacing_after": F.coalesce(F.col("spacing_after") > 0, F.lit(False)),
        "repeated_pattern": _flag("repeated_formatting_pattern"),
        "title_or_caps": _flag("is_title_case") | _flag("is_all_caps"),
        "no_full_stop": ~_flag("ends_with_full_stop"),
        "word_list_item": _flag("is_word_list_item"),
        "many_words": F.col("word_count") > limits["many_words_min"],
        "multiple_sentences": F.col("sentence_count") > 1,
        "full_stop_ending": _flag("ends_with_full_stop"),
        "body_formatting": body,
        "sentence_style": votes >= 2,
        "colored_text": _flag("is_colored"),
    }


#: (name, condition, least score): combinations that raise a score.
COMBINATIONS = (("combination:numbering+bold+colon:min_90", lambda: F.col("numbering_prefix").isNotNull() & _flag("is_bold") & _flag("ends_with_colon"), 90),)


def score(features: DataFrame, weights: dict = V.HEADING_WEIGHTS, limits: dict = V.HEADING_LIMITS, combinations=COMBINATIONS) -> DataFrame:
    """Adds score, classification, detection_method, signals, predicted_level."""
    found = heading_signals(limits)
    points = sum((F.when(c, weights[k]).otherwise(0) for k, c in found.items()), F.lit(0))
    names = [F.when(c, f"{k}:{weights[k]:+d}") for k, c in found.items()]
    for name, condition, least in combinations:
        points = F.when(condition(), F.greatest(points, F.lit(least))).otherwise(points)
        names.append(F.when(condition(), name))
    official, note = _flag("is_official_heading"), T.note_or_link(F.col("text"))
    total = F.when(official, 100).when(note.isNotNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), points)))
    method = F.when(official, "official_word_heading_style").when(note.isNotNull(), "hard_negative_rule").otherwise("formatting_heuristic")
    signals = F.when(official, T.literals(["official_word_heading_style"])).when(note.isNotNull(), F.array(F.concat(F.lit("hard_negative_prefix:"), note))).otherwise(F.array_compact(F.array(*names)))
    depth = F.greatest(F.lit(1), F.least(F.lit(9), T.numbering_depth(F.col("numbering_prefix"))))
    level = F.when(official, F.col("official_heading_level")).when(note.isNull() & F.col("numbering_prefix").isNotNull(), depth)
    kind = F.when(note.isNotNull() & ~official, "normal_content").when(F.col("score") >= limits["heading_min"], "heading").when(F.col("score") >= limits["probable_min"], "probable_heading").otherwise("normal_content")
    return features.withColumn("score", total).withColumns({"classification": kind, "detection_method": method, "signals": signals, "predicted_level": level})


def refine_levels(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Levels for headings without one, by their font size's rank among the document's heuristic headings, at most 9."""
    candidate = (F.col("detection_method") == "formatting_heuristic") & F.col("classification").isin("heading", "probable_heading")
    size = F.when(candidate, F.col("font_size"))
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(size.desc_nulls_last()))
    return scored.withColumn("predicted_level", F.coalesce("predicted_level", F.when(size.isNotNull(), F.least(rank, F.lit(9)))))


def list_counters(items: DataFrame, keys: list[str], pos: str = "pos", level: str = "level", start: str = "start", sequential: str | None = None, levels: int = 9) -> DataFrame:
    """``counters``: for each list item the number shown at each level up to its own.

    A shallower item starts deeper counters anew; ``sequential`` names a flag of items that count.
    """
    w = Window.partitionBy(*keys).orderBy(pos)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    counts = F.lit(True) if sequential is None else F.col(sequential)
    out = items
    for k in range(levels):
        out = out.withColumn(f"_g{k}", F.sum((F.col(level) < k).cast("int")).over(upto))
    for k in range(levels):
        within = Window.partitionBy(*keys, f"_g{k}").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"_c{k}", F.sum(((F.col(level) == k) & counts).cast("int")).over(within))
    shown = F.array(*(F.col(f"_c{k}") for k in range(levels)))
    value = F.transform(F.slice(shown, F.lit(1), F.col(level) + 1), lambda c: F.greatest(F.col(start) - 1 + c, F.col(start)))
    return out.withColumn("counters", value).drop(*(f"_{x}{k}" for x in "gc" for k in range(levels)))


def counter_text(value: Column, fmt: Column) -> Column:
    return (
        F.when(fmt == "lowerLetter", T.letters_of(value))
        .when(fmt == "upperLetter", F.upper(T.letters_of(value)))
        .when(fmt == "lowerRoman", T.roman_of(value))
        .when(fmt == "upperRoman", F.upper(T.roman_of(value)))
        .otherwise(value.cast("string"))
    )


def list_marker(template: Column, counters: Column, formats: Column) -> Column:
    """``%1``..``%9`` in a template replaced by the formatted counters."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(9)), template, lambda t, i: F.when(i <= F.size(counters), F.replace(t, F.concat(F.lit("%"), i.cast("string")), counter_text(F.get(counters, i - 1), F.get(formats, i - 1)))).otherwise(t))


def heading_tree(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Confirmed headings with parent and path, as rows."""
    from weftline.operators.lines import with_ancestors

    heads = scored.where((F.col("classification") == "heading") & F.col("predicted_level").isNotNull())
    return with_ancestors(heads, keys, "predicted_level", "text")


def nested(nodes: Column) -> Column:
    """JSON of a forest, from (level, json) of its nodes in order: a node's children stand before the next one of its own or a higher level.

    Nodes are folded from the last to the first; what is held are the finished trees behind a node, and it takes the first of them that are deeper.
    """

    def step(held: Column, x: Column) -> Column:
        until = F.array_position(F.transform(held, lambda t: t["level"] <= x["level"]), True).cast("int")
        n = F.when(until > 0, until - 1).otherwise(F.size(held))
        inner = F.array_join(F.transform(F.slice(held, F.lit(1), n), lambda t: t["json"]), ",")
        whole = F.concat(F.regexp_replace(x["json"], r"\}$", ""), F.lit(',"children":['), inner, F.lit("]}"))
        return F.concat(F.array(F.struct(x["level"].alias("level"), whole.alias("json"))), F.slice(held, n + 1, F.greatest(F.size(held) - n, F.lit(0))))

    trees = F.aggregate(F.reverse(nodes), F.array().cast("array<struct<level:int,json:string>>"), step)
    return F.concat(F.lit("["), F.array_join(F.transform(trees, lambda t: t["json"]), ","), F.lit("]"))


def document_tree(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, json) of each document: title, headings nested with their contents, what stands before them, probable headings, counts and warnings.

    Official headings and heuristic ones with a level are confirmed; a heading without a level and a probable one stay content and are listed for review.
    The title is the first of: a paragraph of the style Title, a heading of level 1, content before all headings; such a Title paragraph is no heading.
    ``scored``: keys, pos, text, style_name, classification, detection_method, predicted_level, score, signals.
    """
    w = Window.partitionBy(*keys)
    before = w.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    official = F.col("detection_method") == "official_word_heading_style"
    heuristic = (F.col("detection_method") == "formatting_heuristic") & (F.col("classification") == "heading")
    rows = scored.withColumn("_head", official | (heuristic & F.col("predicted_level").isNotNull())).withColumn("_style", F.lower(F.trim(F.coalesce("style_name", F.lit("")))) == "title")
    none_yet = ~F.coalesce(F.bool_or("_head").over(before), F.lit(False))
    sets = F.col("_style") | (F.col("_head") & (F.col("predicted_level") == 1)) | (~F.col("_head") & none_yet)
    rows = rows.withColumn("_first", F.min(F.when(sets, F.col("pos"))).over(w)).withColumn("_title", F.col("_style") & (F.col("pos") == F.col("_first")))
    rows = rows.withColumn("_head", F.col("_head") & ~F.col("_title"))
    under = F.sum(F.col("_head").cast("int")).over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_under", F.when(F.col("_title"), F.lit(0).cast("long")).otherwise(under))
    vague = heuristic & F.col("predicted_level").isNull() & ~F.col("_title")
    review = ~F.col("_head") & ~F.col("_title") & ((F.col("classification") == "probable_heading") | vague)
    rows = rows.withColumn("_vague", vague).withColumn("_review", review)
    named = lambda kind: F.concat(F.lit(f"{kind}-"), F.col("pos").cast("string")).alias("id")
    place = (F.col("pos").alias("position"), F.col("style_name").alias("style"))
    own = F.struct("pos", F.struct(named("paragraph"), "text", *place).alias("c"))
    told = F.struct("pos", F.struct(named("probable"), "text", *place, "score", "predicted_level", "detection_method", "signals").alias("c"))
    listed = lambda column, keep: F.transform(F.array_sort(F.collect_list(F.when(keep, column))), lambda x: x["c"])
    content = rows.groupBy(*keys, "_under").agg(
        listed(own, ~F.col("_head")).alias("content"),
        F.max(F.when(F.col("_head"), F.struct(named("heading"), F.col("text").alias("title"), F.col("predicted_level").alias("level"), *place, "detection_method", "score", "signals", "predicted_level"))).alias("h"),
    )
    node = F.struct("_under", F.col("h.level").cast("int").alias("level"), F.to_json(F.struct("h.*", "content")).alias("json"))
    trees = content.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("_under") > 0, node))).alias("nodes"),
        F.first(F.when(F.col("_under") == 0, F.col("content")), ignorenulls=True).alias("unassigned"),
    )
    plain = ~F.col("_head") & ~F.col("_title") & ~F.col("_review")
    whole = rows.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("pos") == F.col("_first"), F.col("text"))), F.lit("")).alias("title"),
        listed(told, F.col("_review")).alias("probable"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_vague"), F.struct("pos", "score")))), lambda x: F.concat(F.lit("Paragraph "), x["pos"].cast("string"), F.lit(" scored "), x["score"].cast("string"), F.lit(" as a heading of no clear level; to be reviewed."))).alias("warnings"),
        F.struct(F.count_if(F.col("_head") & official).alias("official_heading_count"), F.count_if(F.col("_head") & ~official).alias("heuristic_heading_count"), F.count_if(F.col("_review") & (F.col("classification") == "probable_heading")).alias("probable_heading_count"), F.count_if(plain).alias("normal_content_count")).alias("summary"),
    )
    both = whole.join(trees, keys)
    none = T.literals([]).cast("array<string>")
    warnings = F.concat(
        "warnings",
        F.when(F.size("nodes") == 0, T.literals(["No confirmed headings; they may be formatted by hand."])).otherwise(none),
        F.when(F.size("probable") > 0, F.array(F.concat(F.size("probable").cast("string"), F.lit(" probable heading(s) to be reviewed.")))).otherwise(none),
    )
    empty = F.array().cast(dict(trees.dtypes)["unassigned"])
    rest = F.to_json(F.struct("title", F.coalesce("unassigned", empty).alias("unassigned_content"), F.col("probable").alias("probable_headings"), warnings.alias("warnings"), F.col("summary").alias("analysis_summary")))
    forest = nested(F.transform("nodes", lambda x: F.struct(x["level"].alias("level"), x["json"].alias("json"))))
    return both.select(*keys, F.concat(F.lit('{"headings":'), forest, F.lit(","), F.substring(rest, F.lit(2), F.length(rest))).alias("json"))


def counts(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.groupBy(*keys).agg(*(F.count_if(F.col("classification") == c).alias(f"n_{c}") for c in ("heading", "probable_heading", "normal_content")))
