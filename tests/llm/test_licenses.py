import random

from tests.llm.texts import clashing, edge, empty
from weftline.llm import licenses, queries

FILLER = "the quick brown fox jumps over a lazy dog while many other animals look on and say nothing at all".split()


def brute(text, templates=licenses.TEMPLATES):
    """Every window of every grid compared with every template."""
    cut = lambda ws: [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    shingles, out = cut(licenses.words_of(text or "")), {}
    for grid, names in licenses.grids(templates).items():
        if not shingles:
            continue
        known = {name: set(cut(licenses.words_of(templates[name]))) for name in names}
        for s in range(0, max(len(shingles) - (grid.length - grid.stride) - 1, 0) + 1, grid.stride):
            window = shingles[s : s + grid.length]
            common = {name: len(want & set(window)) for name, want in known.items()}
            enough = {n: x for n, x in common.items() if x >= licenses.CONTAINMENT * len(known[n])}
            for name, n_common in enough.items():
                if n_common == max(enough.values()):
                    share = n_common / len(known[name])
                    first = s + next(i for i, x in enumerate(window) if x in known[name])
                    best, at, n = out.get(name, (0.0, first, 0))
                    out[name] = (max(best, share), min(at, first), n + 1)
    return out


def found(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    out = [{} for _ in texts]
    for r in rows:
        out[r["doc_id"]][f"{r['license']}/{r['form']}"] = (r["containment"], r["first_word"], r["n_windows"])
    return out


def test_planted_and_edited_notices(spark):
    rng, texts = random.Random(4), []
    for name, notice in licenses.TEMPLATES.items():
        for _ in range(12):
            words = notice.split()
            if len(words) > 8 and rng.random() < 0.5:
                words[rng.choice([0, -1])] = "changed"
            before = rng.choices(FILLER, k=rng.randrange(30))
            texts.append(" ".join([*before, *words, *rng.choices(FILLER, k=rng.randrange(30))]).replace("the License", "THE\nLicense"))
    texts += [" ".join(rng.choices(FILLER, k=200)) for _ in range(20)]
    want = [brute(t) for t in texts]
    assert sum(map(len, want)) > 250
    assert found(spark, texts) == want


def test_whole_texts_with_edits(spark):
    """Long templates are found with a fiftieth of their words changed, and told from their kin."""
    rng, texts, names = random.Random(5), [], []
    for name, text in licenses.TEMPLATES.items():
        if not name.endswith("/notice"):
            for share in (0.0, 0.02):
                words = [w if rng.random() >= share else "changed" for w in text.split()]
                texts.append("// Copyright some holder\n" + "\n * ".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12)) + "\n" + " ".join(rng.choices(FILLER, k=400)))
                names.append((name, share))
    got = found(spark, texts)
    for (name, share), rows in zip(names, got, strict=True):
        if not share:
            assert rows[name][0] == 1.0 and rows[name][1] == 3, name
            kin = {n for n in rows if n.split("/")[1] == name.split("/")[1]}
            assert kin == {name}, (name, kin)
    assert sum(name in rows for (name, share), rows in zip(names, got, strict=True) if share) > 0.9 * len(names) / 2


def test_edges(spark):
    assert licenses.scan(edge(spark)).count() == 0
    assert licenses.scan(empty(spark)).count() == 0
    assert licenses.scan(clashing(spark, "license", "h")).count() == 0


def test_query(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").collect()
    want = {(r["doc_id"], n, *v) for r in rows for n, v in brute(r["text"]).items()}
    got = {(r["doc_id"], f"{r['license']}/{r['form']}", r["containment"], r["first_word"], r["n_windows"]) for r in queries.op4_license_scan(spark, data).collect()}
    assert got == want
