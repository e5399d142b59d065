import numpy as np

from weftline.llm import queries, urls
from weftline.llm.common import Scratch

SCHEMA = "page_id long, url string, html string"


def brute(rows, damping=urls.DAMPING):
    """Rules by hand and PageRank with matrices."""
    out, edges, ruled = [], {}, {}
    for page, url, html in rows:
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
            host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
            path = rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(r), r, v) for v, r in urls.RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        out.append([page, host, path, rule, verdict])
        if verdict:
            ruled.setdefault(host, []).append(verdict)
        for piece in (html or "").split('href="')[1:]:
            target = piece.split('"')[0]
            if "://" in target or target.startswith("//"):
                other = target.split("//")[1].split("/")[0].lower()
                if other and host and other != host:
                    edges[host, other] = edges.get((host, other), 0) + 1
    with_pages = {r[1] for r in out}
    for _, host, *_ in out:
        above = host.partition(".")[2]
        if above and above in with_pages:
            edges[host, above] = edges.get((host, above), 0) + 1
    hosts = sorted({h for e in edges for h in e} | set(ruled))
    at = {h: i for i, h in enumerate(hosts)}
    rank = {}
    for kind in ("allow", "block"):
        start = np.array([float(v.count(kind)) if (v := ruled.get(h, [])) and v.count(kind) / len(v) >= urls.SEED_SHARE else 0.0 for h in hosts])
        move = np.zeros((len(hosts), len(hosts)))
        for (a, b), n in edges.items():
            a, b = (a, b) if kind == "allow" else (b, a)
            move[at[a], at[b]] += n
        total = move.sum(1, keepdims=True)
        move = np.divide(move, total, out=np.zeros_like(move), where=total > 0)
        own = start / start.sum() if start.sum() else start
        r = own.copy()
        for _ in range(200 if edges else 0):
            moved = damping * r @ move
            r = moved + (1 - moved.sum()) * own
        rank[kind] = r
    for row in out:
        if row[4] is None:
            t, d = (rank[k][at[row[1]]] if row[1] in at else 0.0 for k in ("allow", "block"))
            row[4] = "block" if t + d > 0 and d / (t + d) >= urls.THRESHOLD else "allow"
    return sorted(map(tuple, out), key=repr)


def found(df):
    return sorted((tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in df.collect()), key=repr)


def link(*hosts):
    return "".join(f'<a href="https://{h}/x">y</a>' for h in hosts)


ROWS = (
    [(i, f"https://bad.net/es/{i}", link("worse.org")) for i in range(6)]
    + [(10 + i, f"https://good.com/en/{i}", link("fine.org", "Fine.org", "good.com")) for i in range(6)]
    + [(20, "http://feeds-bad.org/a", link("bad.net")), (21, "http://worse.org/", ""), (22, "https://fine.org/q?x#y", link("far.org")), (23, "http://far.org", None), (24, "http://bad.net/en/1", "")]
    + [(40, "http://shop.pages.org/a", '<a href="//bad.net/x">y</a>'), (41, "http://pages.org/", ""), (42, "http://one.net/es/1", ""), (43, "http://one.net/en/1", ""), (44, "http://sub.pages.org/", "")]
    + [(30, None, None), (31, "no scheme", "<p>"), (32, "", ""), (33, "https://WWW.Example.COM/en/a", ""), (34, "https://a.example.com/en/", ""), (35, "ftp://x.com", ""), (35, "ftp://x.com", ""), (None, "https://y.net/fr/#z", "")]
)


def test_graph_and_rules(spark):
    out = found(urls.judge(spark.createDataFrame(ROWS, SCHEMA)))
    assert out == brute(ROWS)
    verdicts = {r[0]: r[4] for r in out}
    assert verdicts[20] == "block" and verdicts[22] == verdicts[23] == verdicts[21] == "allow" and verdicts[24] == "block"
    # A link without a scheme; a host with a single ruled page; a host whose links lead nowhere.
    assert verdicts[40] == "block" and verdicts[43] == "block" and verdicts[44] == "allow"


def test_ranks_keep_their_sum(spark):
    """What reaches hosts without links isn't lost."""
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 1.0), ("b", "d", 1.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a", 3.0, 0.0), ("d", 0.0, 1.0)], "host string, trust double, distrust double")
    rows = urls.propagate(edges, seeds, Scratch(spark, "test"), still=0.01).collect()
    assert abs(sum(r["trust"] for r in rows) - 1) < 1e-9 and abs(sum(r["distrust"] for r in rows) - 1) < 1e-9


def test_edges(spark):
    assert urls.judge(spark.createDataFrame([], SCHEMA)).count() == 0
    extra = spark.createDataFrame([(1, "http://a.org/", "", "x", "y")], SCHEMA + ", verdict string, host string")
    assert urls.judge(extra).collect()[0]["verdict"] == "allow"


def test_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").collect()]
    assert found(queries.op9_url_filter(spark, data)) == brute(rows)
