"""URL filters in DataFrame functions only: rules first, then trust that flows along links between hosts.

The longest rule that fits a url decides it.  For urls that no rule fits, hosts
whose ruled pages are nearly all allowed are trusted seeds, hosts whose ruled
pages are nearly all blocked are distrusted ones, each with the number of those
pages.  Personalised PageRank carries trust along the host graph's edges and
distrust against them, round after round until ranks stand still; what reaches
a host without links goes back to the seeds.  A host is blocked where distrust
makes up ``THRESHOLD`` of what reached it.

Host edges come from links in the pages that name a host (``href``, ``src``, ``action``,
with or without a scheme), summed by pair of hosts before anything else; links to
the page's own host are left out.  A host also has an edge to the domain above
it if that has pages itself, once for each page, for its pages stand under that name.

Defined results: a null url, or one without ``://``, has an empty host and path,
fits no rule and is allowed; repeated rows each get their own row; a page with a
null html has no links; an empty table gives an empty result; input columns named
host, path, rule, verdict, trust or distrust are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, ascii_lower, unused

#: (verdict, rule); a rule is a host and a path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
SEED_SHARE = 0.9
DAMPING = 0.85
#: Rounds stop once what one adds to ranks, of a sum of 1, is no more than this; it falls by ``DAMPING`` at least.
STILL = 1e-4
#: Rounds between two looks at what they add.
AT_ONCE = 4
THRESHOLD = 0.8
LINK = r"""(?i)(?:href|src|action)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]*)"""


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path, without a regular expression, so that no text is scanned twice."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, way = text.split("/", 1)
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + way)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def host_edges(linked: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """(src, dst, weight): how many links go from one host's pages to another host, or pages stand under a domain with pages."""
    pages = linked.select(F.col(host).alias("src"), F.col(html).alias("html")).where("src != ''")
    targets = pages.select("src", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    links = targets.select("src", ascii_lower(F.col("dst")).alias("dst")).where((F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = pages.groupBy("src").agg(F.count("*").cast("double").alias("weight"))
    above = hosts.select("src", F.regexp_replace("src", r"^[^.]*\.?", "").alias("dst"), "weight").join(hosts.select(F.col("src").alias("dst")), "dst", "left_semi")
    return links.unionByName(above.select("src", "dst", "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, still: float = STILL, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) for every host that either reaches; each sums to 1 over all hosts, if it has seeds.

    ``seeds`` has host, trust, distrust.  Trust goes along edges, distrust the
    other way; both are ranked at once, told apart by ``kind``.

    A rank is the sum of what a walk from the seeds leaves at a host after none, one, two and more steps, so a round
    only moves what the last one brought.  What reaches hosts without links would go back to the seeds and from there the
    same ways again: it makes all ranks larger by one factor, which the sum of 1 gives.
    """
    ways = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    out = ways.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    ways = scratch.keep(ways.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.lit(damping) * F.col("weight") / F.col("total")).alias("share")))
    start = seeds.select("host", F.expr("stack(2, 'trust', trust, 'distrust', distrust) as (kind, rank)")).where("rank > 0")

    def shared(ranks: DataFrame) -> DataFrame:
        sums = ranks.groupBy("kind").agg(F.sum("rank").alias("all"))  # two rows
        return ranks.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("rank") / F.col("all")).alias("rank"))

    steps = [scratch.keep(shared(start))]
    while not ways.isEmpty():
        moved = ways.join(steps[-1].select("kind", F.col("host").alias("src"), "rank"), ["kind", "src"])
        steps.append(scratch.keep(moved.groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("share") * F.col("rank")).alias("rank"))))
        if len(steps) % AT_ONCE == 0 and steps[-1].groupBy("kind").agg(F.sum("rank").alias("added")).where(F.col("added") * (1 - damping) > still).isEmpty():
            break
    every = steps[0]
    for more in steps[1:]:
        every = every.unionByName(more)
    ranks = shared(every.groupBy("kind", "host").agg(F.sum("rank").alias("rank")))
    per = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0)).alias(kind)
    return ranks.groupBy("host").agg(per("trust"), per("distrust"))


def seed_hosts(ruled: DataFrame, seed_share: float = SEED_SHARE) -> DataFrame:
    """(host, trust, distrust) of hosts whose ruled pages (host, ruled) are nearly all allowed or blocked: how many of these."""
    counted = ruled.groupBy("host").agg(F.count_if(F.col("ruled") == "allow").cast("double").alias("allowed"), F.count_if(F.col("ruled") == "block").cast("double").alias("blocked"))
    all_ = F.col("allowed") + F.col("blocked")
    own = lambda n: F.when(F.col(n) >= seed_share * all_, F.col(n)).otherwise(0.0)
    return counted.select("host", own("allowed").alias("trust"), own("blocked").alias("distrust"))


def judge(pages: DataFrame, rules=RULES, url: str = "url", html: str = "html", seed_share: float = SEED_SHARE, threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` with host, path, rule, verdict, trust and distrust (null where a rule decided or nothing arrived)."""
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = split_url(F.col(url))
    ruled_by = unused("_ruled", pages.columns)
    split = pages.drop("host", "path", "rule", "verdict", "trust", "distrust").withColumn("host", host).withColumn("path", path)
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    split = split.withColumn("rule", rule).withColumn(ruled_by, ruled)
    seeds = seed_hosts(split.where(F.col(ruled_by).isNotNull()).select("host", F.col(ruled_by).alias("ruled")), seed_share)
    # Written, so that both sides of the join are dealt out plainly and Spark can split a hot host.
    ranks = scratch.keep(propagate(scratch.keep(host_edges(split, html=html)), seeds, scratch))
    reached = split.join(ranks, "host", "left")
    spam = F.col("distrust") / (F.col("trust") + F.col("distrust")) >= threshold
    method = F.when(F.coalesce(spam, F.lit(False)), "block").otherwise("allow")
    names = [c for c in split.columns if c != ruled_by]
    return reached.select(*names, F.coalesce(ruled_by, method).alias("verdict"), F.when(F.col("rule").isNull(), F.col("trust")).alias("trust"), F.when(F.col("rule").isNull(), F.col("distrust")).alias("distrust"))
