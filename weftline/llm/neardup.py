"""Near-duplicates by HyperMinHash, confirmed on full shingle sets.

A text's set are its distinct five-word shingles (64-bit hashes of them).  Its
sketch has ``REGISTERS`` registers: of the hashes that fall into a bucket the
smallest is kept as its leading zeros and ``MANTISSA`` bits after them.

1. Texts with equal sets are one class from here on, however many copies there are.
2. Bands of ``ROWS`` registers (an empty register borrows from the next full one)
   give keys.  Two sets with similarity 0.75 share none of ``BANDS`` keys with
   probability (1 - 0.75**5)**51, about 1e-6.
3. Members of a bucket are paired with its lowest class, never with each other.
   A pair whose sizes allow it goes on if the similarity estimated from its
   registers, less the matches expected by chance, comes near the threshold.
4. Pairs are confirmed on full sets: first each class's best one, then those
   that still lie between components.
5. Buckets that still hold several components are finished in blocks: the
   members outside the largest component meet all members of other components,
   ``SIDE`` by ``SIDE``.  Registers show which members have a likely partner there;
   those meet once more with their full sets, and a block gives one confirmed
   link for each member and other component.  So every candidate pair is
   confirmed, rejected or within a component already, and what a group gives out
   grows with its members, not with its pairs.

A link is lost only if its sets share no band key (1e-6 at the threshold, less
above) or if the registers' estimate falls four standard deviations short of it
(3e-5 at the threshold); what is reported is always confirmed on full sets.

Defined results: a null or blank text has no shingles, is its own component and
kept; so is a text with a null ``doc_id``, unless it equals others; rows with
equal ids and equal texts give equal rows, with different texts each its own; an
empty table gives an empty result; other columns don't take part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, WordCodes, give_back, groups_of, if_small, per_batch, unused
from weftline.llm.components import components

SHINGLE = 5
THRESHOLD = 75
REGISTERS, MANTISSA, ROWS, BANDS = 256, 10, 5, 51
#: Four standard deviations of the estimate under the threshold.
NEAR = 0.75 - 4 * (0.75 * 0.25 / REGISTERS) ** 0.5
SIDE = 512
#: Words whose hashes a task remembers.
WORDS = 120_000
#: Blocks over this size are followed by handing memory back.
TRIM_BYTES = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Shingle hashes of texts given as bytes."""

    def __init__(self):
        self.codes = WordCodes(WORDS)
        self.hashes = np.zeros(0, np.uint64)

    def of(self, texts: list) -> list[np.ndarray]:
        """The sorted distinct hashes of each text."""
        import xxhash

        if self.codes.full():
            self.codes, self.hashes = WordCodes(WORDS), np.zeros(0, np.uint64)
        coded = [self.codes.of_text(t.lower()) if t else np.zeros(0, np.int32) for t in texts]
        new = self.codes.words[len(self.hashes) :]
        if new:
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))])
        return [np.unique(self.windows(self.hashes[c])) for c in coded]

    @staticmethod
    def windows(words: np.ndarray) -> np.ndarray:
        n = len(words)
        if n == 0:
            return words
        size = min(n, SHINGLE)
        total = np.full(n - size + 1, size, np.uint64)
        for k in range(size):
            total = mix(total * _STEP + words[k : n - size + 1 + k])
        return total


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (uint16) of each set, 0 where nothing fell into a bucket."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    every = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    low = np.full(len(sets) * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    at = np.repeat(np.arange(len(sets)) * REGISTERS, sizes) + (every % np.uint64(REGISTERS)).astype(np.int64)
    rest = (every // np.uint64(REGISTERS)) | np.uint64(1 << 56)  # 56 bits under a marker
    np.minimum.at(low, at, rest)
    full = low != np.iinfo(np.uint64).max
    own = low & np.uint64((1 << 56) - 1)
    bits = np.frexp(own.astype(np.float64))[1].astype(np.int64)
    shift = np.maximum(bits - 1 - MANTISSA, 0).astype(np.uint64)
    registers = ((56 - bits).clip(0, 62) << MANTISSA) + ((own >> shift) & np.uint64((1 << MANTISSA) - 1)).astype(np.int64) + 1
    return np.where(full, registers, 0).astype(np.uint16).reshape(len(sets), REGISTERS)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """(texts, BANDS) keys; an empty register takes the next full one and how far away that is."""
    n = len(registers)
    wide = np.concatenate([registers, registers], 1)
    place = np.where(wide > 0, np.arange(2 * REGISTERS), 4 * REGISTERS)
    following = np.minimum.accumulate(place[:, ::-1], 1)[:, ::-1][:, :REGISTERS]
    away = following - np.arange(REGISTERS)
    value = np.take_along_axis(registers, following % REGISTERS, 1).astype(np.uint64) + away.astype(np.uint64) * np.uint64(1 << 16)
    value = value[:, : BANDS * ROWS].reshape(n, BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (n, BANDS)) + np.uint64(1)
    for r in range(ROWS):
        key = mix(key * _STEP + value[:, :, r])
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity from registers (broadcast against each other) without the matches that chance gives.

    Two registers of unlike hashes match with a probability of about 0.17 / 2**MANTISSA for
    sets of like size, and the less the more their sizes differ.
    """
    either = ((a > 0) | (b > 0)).sum(-1)
    equal = ((a == b) & (a > 0)).sum(-1)
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    chance = 0.169919 / (1 << MANTISSA) * 4 * small * large / np.maximum((small + large) ** 2, 1)
    return np.maximum(equal - chance * either, 0) / np.maximum(either, 1)


def signatures(docs: DataFrame) -> DataFrame:
    """(id, n_shingles, digest, registers) of rows (id, t); digest and registers are null without shingles."""

    def make():
        import xxhash

        shingler = Shingler()

        def one(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
            data = texts.cast(pa.binary()).to_pylist()
            sizes, digests, registers = [], [], []
            for s, e in groups_of(data, 1 << 19):
                sets = shingler.of(data[s:e])
                sizes += map(len, sets)
                digests += [xxhash.xxh3_128_digest(x) if len(x) else None for x in sets]
                registers += [r.tobytes() if len(x) else None for x, r in zip(sets, sketch(sets), strict=True)]
            return pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(registers, pa.binary())], names=["id", "n_shingles", "digest", "registers"])

        return one

    return docs.mapInArrow(per_batch(make, ["id", "t"]), f"id {dict(docs.dtypes)['id']}, n_shingles long, digest binary, registers binary")


def bands(nodes: DataFrame) -> DataFrame:
    """(key, node): a row for each class and band."""

    def make():
        def one(ids: pa.Array, registers: pa.Array) -> pa.RecordBatch:
            every = np.frombuffer(b"".join(registers.to_pylist()), np.uint16).reshape(-1, REGISTERS)
            # Some at a time: the way to the keys takes many times the registers' room.
            keys = [band_keys(every[at : at + 256]).ravel() for at in range(0, len(every), 256)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), pa.array(np.repeat(ids.to_numpy(), BANDS))], names=["key", "node"])

        return one

    return nodes.select("node", "registers").mapInArrow(per_batch(make, ["node", "registers"]), "key long, node long")


def sizes_allow(a: str, b: str):
    """Whether sets of these sizes can reach the threshold."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * THRESHOLD


def near_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, likeness) of those pairs whose registers come near the threshold."""

    def make():
        of = lambda r: np.frombuffer(b"".join(r.to_pylist()), np.uint16).reshape(-1, REGISTERS)

        def one(a: pa.Array, b: pa.Array, na: pa.Array, nb: pa.Array, ra: pa.Array, rb: pa.Array) -> pa.RecordBatch:
            like = estimate(of(ra), of(rb), na.to_numpy(), nb.to_numpy())
            kept = pa.array(np.flatnonzero(like >= NEAR))
            return pa.RecordBatch.from_arrays([a.take(kept), b.take(kept), pa.array(like).take(kept)], names=["a", "b", "likeness"])

        return one

    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("registers").alias(f"r{s}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.mapInArrow(per_batch(make, ["a", "b", "na", "nb", "ra", "rb"]), "a long, b long, likeness double")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) for ``wanted`` classes (node, digest, id), from the texts of their ids."""

    def make():
        import xxhash

        shingler = Shingler()

        def one(texts: pa.Array) -> pa.RecordBatch:
            data = texts.cast(pa.binary()).to_pylist()
            digests, sets = [], []
            for s, e in groups_of(data, 1 << 19):
                for x in shingler.of(data[s:e]):
                    digests.append(xxhash.xxh3_128_digest(x))
                    sets.append(x.view(np.int64))
            sizes = np.append(0, np.cumsum([len(x) for x in sets])).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))], names=["digest", "shingles"])

        return one

    ids = wanted.select("id").where("id is not null").distinct()
    sets = docs.join(if_small(ids), "id", "left_semi").select("t").mapInArrow(per_batch(make, ["t"]), "digest binary, shingles array<long>")
    return wanted.select("node", "digest").join(sets, "digest").select("node", "shingles").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets have 100 * intersection >= 75 * union."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = scratch.keep(shingle_sets(docs, nodes.select("node", "digest", "id").join(wanted, "node", "left_semi")))
    side = lambda s: sets.select(F.col("node").alias(s), F.col("shingles").alias(f"s{s}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    out = scratch.keep(both.where(F.lit(100) * common >= F.lit(THRESHOLD) * (F.size("sa") + F.size("sb") - common)).select("a", "b"))
    scratch.drop(sets)
    return out


def dealt_blocks(members: DataFrame, payload: DataFrame) -> DataFrame:
    """Members (key, node, component, n_shingles) of unfinished buckets, dealt to blocks (key, left, right) and joined with ``payload`` by node.

    A block has up to about ``SIDE`` queries, members outside the bucket's largest
    component, and as many of all its members.  What members carry is joined last, so it is dealt out once.
    """
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    rows = members.join(main, "key").where("`all` > most")
    lanes = lambda n: F.ceil(n / SIDE).cast("int")
    lane = lambda n: F.pmod(F.xxhash64("node"), lanes(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), lanes(n) - 1))
    kept = ["node", "component", "n_shingles"]
    outside = F.col("all") - F.col("most")
    others = rows.select("key", every(outside).alias("left"), lane(F.col("all")).alias("right"), F.lit(False).alias("query"), *kept)
    queries = rows.where("component != main").select("key", lane(outside).alias("left"), every(F.col("all")).alias("right"), F.lit(True).alias("query"), *kept)
    return queries.union(others).join(payload, "node")


def likely(node: np.ndarray, component: np.ndarray, n: np.ndarray, query: np.ndarray, registers: np.ndarray, key: int):
    """(query, partners, likeness) of each query that has partners in other components near the threshold.

    Pairs that share an earlier band are left to that band's bucket.
    """
    keys = band_keys(registers)
    q, o = np.flatnonzero(query), np.flatnonzero(~query)
    band = int(np.flatnonzero(keys[q[0]] == key)[0]) if len(q) else 0
    for i in q:
        other = o[component[o] != component[i]]
        other = other[np.minimum(n[other], n[i]) * 100 >= np.maximum(n[other], n[i]) * THRESHOLD]
        other = other[~(keys[other, :band] == keys[i, :band]).any(1)]
        like = estimate(registers[other], registers[i], n[other], n[i])
        near = np.flatnonzero(like >= NEAR)
        if len(near):
            yield i, other[near], like[near]


def likely_members(members: DataFrame, registers: DataFrame) -> DataFrame:
    """(key, node) of members that have a likely partner in another component of their bucket."""

    def block(table: pa.Table) -> pa.Table:
        query, node, component, n = (table[c].to_numpy() for c in ("query", "node", "component", "n_shingles"))
        registers = np.frombuffer(b"".join(table["registers"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
        key = table["key"][0].as_py()
        found = [np.append(others, i) for i, others, _ in likely(node, component, n, query, registers, key)]
        out = np.unique(node[np.concatenate(found)]) if found else np.zeros(0, np.int64)
        if table.nbytes > TRIM_BYTES:
            give_back()
        return pa.table({"key": np.full(len(out), key), "node": out})

    return dealt_blocks(members, registers).groupBy("key", "left", "right").applyInArrow(block, "key long, node long").distinct()


def confirmed_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): for each query of a block and each other component one pair with 100 * intersection >= 75 * union."""

    def block(table: pa.Table) -> pa.Table:
        query, node, component, n = (table[c].to_numpy() for c in ("query", "node", "component", "n_shingles"))
        shingles = table["shingles"].combine_chunks()
        ends, every = shingles.offsets.to_numpy(), shingles.values.to_numpy().view(np.uint64)
        sets = [every[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]
        links = []
        for i, others, like in likely(node, component, n, query, sketch(sets), table["key"][0].as_py()):
            linked = set()
            for j in others[np.argsort(-like, kind="stable")]:
                if component[j] not in linked:
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * common >= THRESHOLD * (n[i] + n[j] - common):
                        linked.add(component[j])
                        links.append((min(node[i], node[j]), max(node[i], node[j])))
        if table.nbytes > TRIM_BYTES:
            give_back()
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return dealt_blocks(members, sets).groupBy("key", "left", "right").applyInArrow(block, "a long, b long").distinct()


class Linker:
    """Grows components from candidate pairs, confirming only pairs that can still join two of them."""

    def __init__(self, nodes: DataFrame, docs: DataFrame, scratch: Scratch):
        self.nodes, self.docs, self.scratch = nodes, docs, scratch
        self.labels: DataFrame | None = None

    def label(self, rows: DataFrame, column: str, name: str) -> DataFrame:
        """``rows`` with the component of ``column`` under ``name``."""
        if self.labels is None:
            return rows.withColumn(name, F.col(column))
        own = self.labels.select(F.col("node").alias(column), F.col("component").alias("_c"))
        return rows.join(own, column, "left").withColumn(name, F.coalesce("_c", column)).drop("_c")

    def between(self, pairs: DataFrame) -> DataFrame:
        return self.label(self.label(pairs, "a", "ca"), "b", "cb").where("ca != cb").drop("ca", "cb")

    def join_up(self, links: DataFrame) -> None:
        """Merge the components that confirmed links lie between."""
        if links.isEmpty():
            return
        between = self.label(self.label(links, "a", "ca"), "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        merged = components(between, self.scratch)
        if self.labels is None:
            self.labels = merged
            return
        step = merged.select(F.col("node").alias("component"), F.col("component").alias("_to"))
        known = self.labels.join(step, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
        fresh = merged.join(self.labels.select("node"), "node", "left_anti").select("node", "component")
        self.labels = self.scratch.keep(known.unionByName(fresh))

    def take(self, pairs: DataFrame) -> None:
        """Confirm each class's best pair, then what remains between components."""
        if pairs.isEmpty():
            return
        ends = pairs.select(F.col("a").alias("node"), "a", "b", "likeness").union(pairs.select("b", "a", "b", "likeness"))
        best = ends.groupBy("node").agg(F.max_by(F.struct("a", "b"), F.struct("likeness", "a", "b")).alias("p")).select("p.*").distinct()
        self.join_up(confirmed(self.scratch.keep(best), self.nodes, self.docs, self.scratch))
        rest = self.scratch.keep(self.between(pairs.join(best, ["a", "b"], "left_anti")))
        if not rest.isEmpty():
            self.join_up(confirmed(rest, self.nodes, self.docs, self.scratch))

    def finish(self, members: DataFrame) -> None:
        """Join what buckets (key, node) still hold apart."""
        placed = self.label(members, "node", "component")
        # A bucket of two has had its only pair.
        open_keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low != high and n > 2").select("key")
        placed = self.scratch.keep(placed.join(open_keys, "key", "left_semi"))
        if placed.isEmpty():
            return
        placed = self.scratch.keep(placed.join(self.nodes.select("node", "n_shingles"), "node"))
        involved = self.scratch.keep(likely_members(placed, self.nodes.select("node", "registers")))
        if involved.isEmpty():
            return
        wanted = self.nodes.select("node", "digest", "id").join(involved.select("node").distinct(), "node", "left_semi")
        sets = self.scratch.keep(shingle_sets(self.docs, wanted))
        self.join_up(self.scratch.keep(confirmed_links(placed.join(involved, ["key", "node"]), sets)))
        self.scratch.drop(sets)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: key, n_shingles, component_id, kept.

    ``component_id`` is the smallest key that links reach, ``kept`` says that it is the row's own.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))
    signed = scratch.keep(signatures(rows))
    reps = scratch.keep(signed.where("digest is not null").groupBy("digest").agg(F.min("id").alias("id"), F.first("registers").alias("registers"), F.first("n_shingles").alias("n_shingles")))
    nodes = scratch.keep(reps.withColumn("node", F.monotonically_increasing_id()))
    scratch.drop(reps)
    # From here on only classes need their registers.
    told = scratch.keep(signed.select("id", "n_shingles", "digest"))
    scratch.drop(signed)
    keyed = scratch.keep(bands(nodes))
    shared = scratch.keep(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1"))
    members = scratch.keep(keyed.join(shared, "key").select("key", "node", "hub"))
    scratch.drop(keyed)
    candidates = members.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    of = lambda s: nodes.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n{s}"))
    like_sized = candidates.join(of("a"), "a").join(of("b"), "b").where(sizes_allow("na", "nb")).select("a", "b")
    linker = Linker(nodes, rows, scratch)
    first = scratch.keep(near_pairs(like_sized, nodes))
    linker.take(first)
    linker.finish(members.select("key", "node"))
    labelled = linker.label(nodes.select("node", "digest", F.col("id").alias("low_id")), "node", "component")
    # Written, so that both sides of the join are dealt out plainly and Spark can split a giant component.
    labelled = scratch.keep(labelled)
    lowest = scratch.keep(labelled.groupBy("component").agg(F.min("low_id").alias("component_id")))
    named = labelled.join(lowest, "component").select("digest", "component_id")
    out = told.join(named, "digest", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near-duplicates: of each class the row with the smallest key stays, once.

    Rows are told apart by key and text, so rows that only share a key don't decide about each other.
    """
    scratch = Scratch(docs.sparkSession, "keep")
    names = docs.columns
    row = unused("row", names)
    told = F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("h"))
    found = scratch.keep(classes(docs.select(told.alias("row"), F.col(text).alias("text")), "row", "text").groupBy("row").agg(F.first("kept").alias("kept"), F.count("*").alias("n")))
    gone, repeated = found.where(~F.col("kept")).select(F.col("row").alias(row)), found.where("kept and n > 1").select(F.col("row").alias(row))
    kept = docs.withColumn(row, told).join(if_small(gone), row, "left_anti")
    if not repeated.isEmpty():
        again = if_small(repeated)
        kept = kept.join(again, row, "left_anti").unionByName(kept.join(again, row, "left_semi").dropDuplicates([row]))
    return kept.select(*names)
