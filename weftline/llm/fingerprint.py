"""Document fingerprints in DataFrame functions only: invertible Bloom lookup sketches of paragraphs.

A paragraph is a non-empty line, and a long one falls into several: each ends with
the first sentence that makes it ``LONG`` characters, or after twice as many if no sentence ends there.  So a change at one place of
a long line leaves what stands before it, and all from the next paragraph on, as
it was.  A text of up to ``SHORT`` characters also has pieces of a few words, or it would
have one paragraph or two, and no likeness to what it is after a change.  A paragraph's digest is a 64-bit hash.  A sketch has
``groups`` (a power of two that follows the number of paragraphs) of
``CELLS`` cells.  A digest goes to one group and there to one cell of each
third; a cell holds a count, the exclusive or of its digests and that of their
checks.  Sketches are linear: subtracting those of two texts leaves the digests
in which they differ.  Of two sketches of unlike size the larger is folded: its groups fall
onto those of the smaller, as if it had been made that size.  Cells with one digest left give it up, and taking it from
its other cells frees more (peeling).  So a likeness comes from the two returned fingerprints (``compare``
does it from the strings alone).  Where they don't peel they are made anew, first of the larger's size, then of four
times as many groups each time, until they do, so every likeness is exact.

Likeness is shared over all distinct paragraphs.  Two texts without paragraphs
have likeness 1.

Defined results: a null text is empty; a null ``doc_id`` counts as the lowest
id; rows with equal ids stand in falling order of a hash of their texts, and
rows equal in both count as one document, each row getting its result; a single
document is its own next one; an empty table gives an empty result; a key that
is no whole number is an error; other columns don't take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import Scratch

CELLS = 24
THIRD = CELLS // 3
PER_GROUP = 8
PEEL_ROUNDS = 12
ROWS_PER_RANGE = 50_000
LONG = 200
PARAGRAPH = rf"(?s)(.{{{LONG},{2 * LONG - 1}}}?[.!?](?=\s)|.{{{2 * LONG}}}|.+\z)"
LOWEST = -(1 << 63)
#: Texts of up to so many characters also have pieces that end at the first blank from their ``PIECE``-th character on.
SHORT, PIECE = 600, 40
PIECES = rf"(?s)(.{{{PIECE},}}?\s|.+\z)"


def paragraph_digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    lines = F.filter(F.split(text, "\n"), lambda p: p != "")
    cut = lambda p: F.when(F.length(p) <= LONG, F.array(p)).otherwise(F.regexp_extract_all(p, F.lit(PARAGRAPH), F.lit(1)))
    large = F.transform(F.flatten(F.transform(lines, cut)), lambda p: F.xxhash64(p))
    small = F.transform(F.regexp_extract_all(text, F.lit(PIECES), F.lit(1)), lambda p: F.xxhash64(F.lit(1), p))
    return F.array_distinct(F.when(F.length(text) <= SHORT, F.concat(large, small)).otherwise(large))


def groups_for(n: Column, level: int) -> Column:
    """The number of groups for ``n`` paragraphs: a power of two, four times as many for each level from the second."""
    return F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n, F.lit(1)) / PER_GROUP)))).cast("int") * F.lit(4 ** max(0, level - 1))


def places(digest: Column, level: int) -> Column:
    """The three cells of a digest within its group."""
    h = F.xxhash64(digest, F.lit(level))
    return F.array(*(F.lit(k * THIRD) + F.shiftright(h, 8 + 4 * k).bitwiseAND(F.lit(THIRD - 1)).cast("int") for k in range(3)))


def check_of(digest: Column) -> Column:
    return F.hash(digest, F.lit(7))


def cells(texts: DataFrame, keys: list[str], level: int) -> DataFrame:
    """Non-empty cells of each (keys, kind): column ``held`` is an array of (digest, sign), ``n`` sizes the sketch.

    ``texts`` must be partitioned by ``keys``; nothing here is dealt out again.
    """
    digests = texts.select(*keys, "kind", groups_for(F.col("n"), level).alias("groups"), F.inline("held").alias("digest", "sign"))
    groups = F.pmod(F.xxhash64(F.lit(11 + level), "digest"), F.col("groups")).cast("int")
    spread = digests.select(*keys, "kind", "groups", groups.alias("grp"), "digest", "sign", F.explode(places(F.col("digest"), level)).alias("cell"))
    summed = spread.groupBy(*keys, "kind", "groups", "grp", "cell").agg(F.sum("sign").cast("int").alias("c"), F.bit_xor("digest").alias("x"), F.bit_xor(check_of(F.col("digest"))).alias("k"))
    return summed.where((F.col("c") != 0) | (F.col("x") != 0))


def peel(group: Column, level: int) -> Column:
    """(cells left, digests found) of one group's cells, an array of (cell, c, x, k)."""

    def step(state: Column, _: Column) -> Column:
        pure = F.filter(state["left"], lambda g: (F.abs(g["c"]) == 1) & (check_of(g["x"]) == g["k"]) & F.array_contains(places(g["x"], level), g["cell"]))
        got = F.array_distinct(F.transform(pure, lambda g: F.struct(g["x"].alias("x"), g["c"].alias("c"), g["k"].alias("k"), places(g["x"], level).alias("at"))))

        def without(got: Column) -> Column:
            def one(g: Column) -> Column:
                zero = F.struct(g["cell"].alias("cell"), g["c"].alias("c"), g["x"].alias("x"), g["k"].alias("k"))
                return F.aggregate(got, zero, lambda a, p: F.when(F.array_contains(p["at"], a["cell"]), F.struct(a["cell"].alias("cell"), (a["c"] - p["c"]).alias("c"), a["x"].bitwiseXOR(p["x"]).alias("x"), a["k"].bitwiseXOR(p["k"]).alias("k"))).otherwise(a))

            left = F.filter(F.transform(state["left"], one), lambda g: (g["c"] != 0) | (g["x"] != 0))
            return F.struct(left.alias("left"), (state["found"] + F.size(got)).alias("found"))

        return F.when(F.size(state["left"]) == 0, state).otherwise(F.get(F.transform(F.array(got), without), F.lit(0)))

    start = F.struct(group.alias("left"), F.lit(0).alias("found"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(PEEL_ROUNDS)), start, step)


def neighbours(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(kid, th, n, before_kid, before_th, before_n): each document and the one whose next it is.

    Documents are ordered within ranges of ids, as many as there are documents for;
    only each range's last document is carried to the range below.
    """
    own = scratch.keep(docs.select("kid", "th", "n").distinct())
    n_ranges = max(1, own.count() // ROWS_PER_RANGE)
    ranged = scratch.keep(own.repartitionByRange(n_ranges, F.col("kid").desc()).withColumn("range", F.spark_partition_id())).withColumn("me", F.struct("kid", "th", "n"))
    lasts = ranged.groupBy("range").agg(F.min("me").alias("last"))
    over_ranges = Window.partitionBy(F.lit(0)).orderBy("range")  # one row for each ROWS_PER_RANGE documents
    above = F.lag("last").over(over_ranges)
    lowest = F.last("last").over(over_ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lasts = lasts.select("range", F.coalesce(above, lowest).alias("carried"))
    before = F.lag("me").over(Window.partitionBy("range").orderBy(F.col("kid").desc(), F.col("th").desc(), F.col("n").desc()))
    joined = ranged.withColumn("before", before).join(lasts, "range").withColumn("before", F.coalesce("before", "carried"))
    return scratch.keep(joined.select("kid", "th", "n", F.col("before.kid").alias("before_kid"), F.col("before.th").alias("before_th"), F.col("before.n").alias("before_n")))


def with_next(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kid, th, n_chars, edited_sha256, next_id, own, edited, next): the last three are paragraph digests.

    Only as much of the next text as the edit takes is moved, and its digests.  Both
    sides of the second join read the same columns of the first, so texts are dealt out once.
    """
    if dict(docs.dtypes)[key] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{key} must be a whole number")
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("id"), t.alias("t"), F.coalesce(F.col(key).cast("long"), F.lit(LOWEST)).alias("kid"), F.xxhash64(t).alias("th"))
    order = neighbours(rows.select("kid", "th", F.length("t").alias("n")), scratch)
    placed = rows.join(order, ["kid", "th"])
    third = F.floor(F.col("before_n") / 3).cast("int")
    sent = placed.select(F.col("id").alias("next_id"), F.col("before_kid").alias("kid"), F.col("before_th").alias("th"), F.substr("t", F.lit(1), third).alias("from_next"), paragraph_digests(F.col("t")).alias("next"))
    sent = sent.dropDuplicates(["kid", "th"])
    both = placed.join(sent, ["kid", "th"])
    edited = F.concat(F.substr("t", F.lit(1), F.col("n") - F.floor(F.col("n") / 3).cast("int")), F.col("from_next"))
    both = both.withColumn("e", edited)
    return scratch.keep(both.select("id", "kid", "th", F.col("n").cast("long").alias("n_chars"), F.sha2(F.col("e").cast("binary"), 256).alias("edited_sha256"), "next_id", paragraph_digests(F.col("t")).alias("own"), paragraph_digests(F.col("e")).alias("edited"), "next"))


def _signed(digests: str, sign: int) -> Column:
    return F.transform(digests, lambda d: F.struct(d.alias("digest"), F.lit(sign).alias("sign")))


def differences(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(kid, th, kind, differing): how many digests two texts don't share, by subtraction and peeling.

    ``pairs``: kid, th, kind, n_low, n_high, held (signed digests of both texts).  Level 0 has the cells of the two fingerprints, the larger one folded.
    """
    keys, done, level = ["kid", "th"], [], 0
    while True:
        dealt = pairs.withColumn("n", F.col("n_high" if level else "n_low")).repartition(*keys)
        group = F.sort_array(F.collect_list(F.struct("cell", "c", "x", "k")))
        peeled = cells(dealt, keys, level).groupBy(*keys, "kind", "grp").agg(peel(group, level).alias("p"))
        tried = scratch.keep(peeled.groupBy(*keys, "kind").agg(F.sum("p.found").alias("differing"), F.sum(F.size("p.left")).alias("left")))
        done.append(tried.where("left = 0").select(*keys, "kind", "differing"))
        failed = tried.where("left > 0")
        if failed.isEmpty():
            break
        pairs = scratch.keep(pairs.join(failed.select(*keys, "kind"), [*keys, "kind"], "left_semi"))
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def sketch_text(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, sketch): a sketch as text, its groups and then its non-empty cells in order."""
    at = F.col("grp") * CELLS + F.col("cell")
    one = F.concat_ws(".", at.cast("string"), F.col("c").cast("string"), F.lower(F.hex("x")), F.lower(F.hex("k")))
    ordered = F.array_sort(F.collect_list(F.struct(at.alias("at"), one.alias("s"))))
    rows = cells(texts, keys, 0).groupBy(*keys, "kind", "groups").agg(ordered.alias("o"))
    return rows.select(*keys, "kind", F.concat_ws(";", F.concat(F.lit("iblt"), F.col("groups").cast("string")), F.array_join(F.transform("o", lambda o: o["s"]), ";")).alias("sketch"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_id)."""
    scratch = Scratch(docs.sparkSession, "fingerprints")
    rows = with_next(docs, scratch, key, text)
    keys = ["kid", "th"]
    once = rows.dropDuplicates(keys)
    compared = F.array(*(F.struct(F.lit(k).alias("kind"), F.least(F.size("own"), F.size(o)).alias("n_low"), F.greatest(F.size("own"), F.size(o)).alias("n_high"), F.concat(_signed("own", 1), _signed(o, -1)).alias("held")) for k, o in ((0, "edited"), (1, "next"))))
    differing = differences(once.select(*keys, F.inline(compared)), scratch)
    per = differing.groupBy(*keys).agg(*(F.sum(F.when(F.col("kind") == k, F.col("differing"))).alias(n) for k, n in ((0, "d_edited"), (1, "d_next"))))
    alone = F.array(*(F.struct(F.lit(k).alias("kind"), F.size(o).alias("n"), _signed(o, 1).alias("held")) for k, o in ((0, "own"), (1, "edited"))))
    dealt = rows.repartition(*keys)
    sketches = sketch_text(dealt.dropDuplicates(keys).select(*keys, F.inline(alone)), keys)
    texts = sketches.groupBy(*keys).agg(*(F.max(F.when(F.col("kind") == k, F.col("sketch"))).alias(n) for k, n in ((0, "fingerprint"), (1, "edited_fingerprint"))))
    out = dealt.join(per, keys, "left").join(texts, keys, "left")

    def near(other: str, differing: str) -> Column:
        both, d = F.size("own") + F.size(other), F.coalesce(F.col(differing), F.lit(0))
        return F.when(both == 0, 1.0).otherwise((both - d) / (both + d))

    blank = F.lit("iblt1")
    return out.select(F.col("id").alias(key), "n_chars", "edited_sha256", F.coalesce("fingerprint", blank).alias("fingerprint"), F.coalesce("edited_fingerprint", blank).alias("edited_fingerprint"), near("edited", "d_edited").alias("near_edited"), near("next", "d_next").alias("near_next"), "next_id")


def compare(pairs: DataFrame, keys: list[str], one: str = "fingerprint", other: str = "edited_fingerprint") -> DataFrame:
    """(keys, near): the likeness of two returned fingerprints, from nothing but their strings; null where they don't peel.

    The larger is folded to the smaller's size and subtracted.  A null fingerprint gives null.
    """
    number = lambda s: F.conv(s, 16, -10).cast("long")
    sides = [pairs.select(*keys, F.lit(sign).alias("sign"), F.split(F.col(c), ";").alias("parts")) for c, sign in ((one, 1), (other, -1))]
    rows = sides[0].unionByName(sides[1]).where("parts is not null")
    rows = rows.withColumn("groups", F.substring(F.get("parts", F.lit(0)), 5, 20).cast("int"))
    low = rows.groupBy(*keys).agg(F.min("groups").alias("low"), F.count("*").alias("both")).where("both = 2").drop("both")
    told = rows.select(*keys, "sign", F.explode(F.slice("parts", F.lit(2), F.size("parts"))).alias("s")).withColumn("v", F.split("s", r"\."))
    v = lambda i: F.get("v", F.lit(i))
    told = told.select(*keys, "sign", v(0).cast("int").alias("at"), v(1).cast("int").alias("c"), number(v(2)).alias("x"), number(v(3)).cast("int").alias("k")).join(low, keys)
    folded = told.withColumn("grp", F.pmod(F.floor(F.col("at") / CELLS).cast("int"), F.col("low"))).withColumn("cell", F.pmod("at", F.lit(CELLS)))
    summed = folded.groupBy(*keys, "grp", "cell").agg(F.sum(F.col("sign") * F.col("c")).cast("int").alias("c"), F.bit_xor("x").alias("x"), F.bit_xor("k").alias("k"), F.sum("c").alias("n"))
    group = F.sort_array(F.collect_list(F.when((F.col("c") != 0) | (F.col("x") != 0), F.struct("cell", "c", "x", "k"))))
    peeled = summed.groupBy(*keys, "grp").agg(peel(group, 0).alias("p"), F.sum("n").alias("n")).groupBy(*keys).agg(F.sum("p.found").alias("d"), F.sum(F.size("p.left")).alias("left"), (F.sum("n") / 3).alias("n"))
    near = F.when(F.col("left").isNull(), 1.0).when(F.col("left") == 0, (F.col("n") - F.col("d")) / (F.col("n") + F.col("d")))
    out = pairs.select(*keys).join(low, keys, "left").join(peeled, keys, "left")
    return out.select(*keys, F.when(F.col("low").isNotNull(), near).alias("near"))
