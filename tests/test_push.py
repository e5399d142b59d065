"""What a push starts from, and what a preview reads."""

import json
import subprocess

import pytest

from tests.test_flows import BASE, package, repositories
from weftline import cli
from weftline.operators import providers
from weftline.operators.providers import Choice
from weftline.plans import baseline, inputs, push

CONFIG = {"tool": {"project_id": "p1", "production_branch": "main", "document_name": "Tool.docx", "document_location": "Shared"}}
CONFIG_SCHEMA = "repository_name string, project_id string, production_branch string, document_name string, document_location string"


def overview(spark, pushes, changed=()):
    configs = spark.createDataFrame([("tool", "p1", "main", "Tool.docx", "Shared")], CONFIG_SCHEMA)
    changes = spark.createDataFrame(list(changed), "id int, pos int, change_type string, path string, old_path string")
    return push.overview(spark.createDataFrame(pushes, f"id int, {push.PUSH}"), configs, changes, ["id"])


def test_overview(spark):
    pushes = [
        (1, "me/tool", " abc ", "dev", "aaa", "someone", "x", True, None),
        (2, "me/other", "abc", " ", "0000000", None, None, True, None),
        (3, None, None, "dev", "aaa", " ", "work", True, None),
        (4, " tool ", "", None, None, None, None, False, None),
        (5, "me/tool", "abc", "dev", "gone", "a", "x", True, "git doesn't know gone"),
        (6, "me/", "abc", "dev", None, "a", "x", None, "not shown"),
    ]
    changed = [(1, 1, "renamed", "b.py", "a.py"), (1, 0, "added", "c.py", None), (2, 0, "added", "hidden.py", None), (3, 0, "modified", "d.py", None)]
    made = overview(spark, pushes, changed)
    rows = {r["id"]: r for r in made.collect()}
    assert len(rows) == 6
    assert (rows[1]["repository"], rows[1]["branch"], rows[1]["actor"], rows[1]["before_sha"], rows[1]["after_sha"], rows[1]["project_id"], rows[1]["warnings"]) == ("tool", "dev", "someone", "aaa", "abc", "p1", [])
    assert [f["path"] for f in rows[1]["files"]] == ["c.py", "b.py"]
    assert rows[2]["files"] == [] and rows[2]["before_sha"] is None and rows[2]["branch"] == "main" and rows[2]["actor"] == "local-user"
    assert rows[2]["warnings"] == ["no configuration for other", push.NO_BEFORE]
    assert (rows[3]["before_sha"], rows[3]["after_sha"], rows[3]["branch"], rows[3]["warnings"]) == ("HEAD~1", "HEAD", "work", ["no configuration for Repository"])
    assert rows[4]["warnings"] == [push.NO_PARENT] and rows[4]["project_id"] == "p1"
    assert rows[5]["warnings"] == ["git doesn't know gone"]
    assert rows[6]["repository"] == "Repository" and push.NO_BEFORE in rows[6]["warnings"] and "not shown" not in rows[6]["warnings"]
    told = {r["id"]: r["report"] for r in push.report(made, ["id"]).collect()}
    assert "- renamed: a.py -> b.py\n" not in told[1] and told[1].endswith("- added: c.py\n- renamed: a.py -> b.py") and "Project ID: p1" in told[1]
    assert "(none)" in told[2] and "! no configuration for other" in told[2] and "(no project configuration)" in told[2]


def test_overview_of_nothing(spark):
    assert overview(spark, []).count() == 0 and push.report(overview(spark, []), ["id"]).count() == 0


@pytest.fixture
def repo(tmp_path):
    at = tmp_path / "repo"
    at.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", at, "-c", "user.name=Some One", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "work")
    (at / "a.py").write_text("x = 1\n" * 9)
    run("add", ".")
    run("commit", "-qm", "first")
    return at, run


def test_push_of_an_environment(spark, repo, tmp_path):
    at, run = repo
    (tmp_path / "projects.json").write_text(json.dumps(CONFIG))
    told = lambda env: cli.run(spark, ["push", f"file://{tmp_path}/projects.json", "--repo", str(at)], env).collect()[0]["report"]
    assert push.NO_PARENT in told({}) and "Branch: work" in told({})
    (at / "a.py").rename(at / "b.py")
    run("add", "-A")
    run("commit", "-qm", "second")
    assert "- renamed: a.py -> b.py" in told({}) and "Before SHA: HEAD~1" in told({})
    ids = subprocess.run(["git", "-C", at, "rev-parse", "HEAD~1", "HEAD"], capture_output=True, text=True, check=True).stdout.split()
    env = {"GITHUB_REPOSITORY": "me/tool", "GITHUB_SHA": ids[1], "GITHUB_REF_NAME": "dev", "GITHUB_EVENT_BEFORE": ids[0], "GITHUB_ACTOR": "someone"}
    assert "- renamed: a.py -> b.py" in told(env) and "Project ID: p1" in told(env) and "Warnings" not in told(env)
    assert push.NO_BEFORE in told(env | {"GITHUB_EVENT_BEFORE": "0" * 40})
    gone = told(env | {"GITHUB_EVENT_BEFORE": "f" * 40})
    assert f"git doesn't know {'f' * 40}" in gone and "(none)" in gone


SKELETON = json.dumps({"sections": [{"section_id": "project", "heading": "Project", "level": 1, "parent_id": None, "path": "Project", "order": 1, "content_hash": None}]})


def test_inputs(spark):
    good = {"package": package(), "document": BASE, "skeleton": SKELETON}
    cases = {
        "ok": {},
        "no_package": {"package": None},
        "no_document": {"document": None},
        "broken": {"package": "{"},
        "list": {"package": "[1]"},
        "version": {"package": package(schema_version=9)},
        "no_version": {"package": json.dumps({k: v for k, v in json.loads(package()).items() if k != "schema_version"})},
        "bytes": {"document": b"\xff\xfe"},
        "skeleton": {"skeleton": "no"},
        "fields": {"skeleton": json.dumps({"sections": [{"section_id": "x", "more": 1}]})},
        "empty": {"document": ""},
    }
    raw = lambda v: v if isinstance(v, bytes) else v.encode()
    files = [(name, inputs.PLACES[role], raw(v)) for name, own in cases.items() for role, v in (good | own).items() if v is not None]
    files += [("moved", "p.json", raw(package())), ("moved", inputs.PLACES["document"], BASE.encode()), ("moved", inputs.PLACES["skeleton"], SKELETON.encode())]
    tree = spark.createDataFrame(files, "repo string, path string, content binary")
    repos = spark.createDataFrame([(n, None) for n in cases] + [("moved", "p.json"), ("nothing", None)], "repo string, package string")
    rows = {r["repo"]: r for r in inputs.load(tree, repos).collect()}
    assert {n: r["code"] for n, r in rows.items() if r["code"]} == {"no_package": 1, "no_document": 1, "broken": 1, "list": 1, "version": 2, "bytes": 1, "skeleton": 1, "fields": 1, "nothing": 1}
    assert rows["no_package"]["problem"].startswith("missing package: artifacts/") and rows["version"]["problem"].endswith(" 9") and rows["moved"]["problem"] is None
    assert rows["nothing"]["hashes"] == dict.fromkeys(inputs.PLACES) and len(rows["ok"]["hashes"]["skeleton"]) == 64
    later = tree.where("repo != 'ok'").unionByName(spark.createDataFrame([("ok", p, b"other") for p in inputs.PLACES.values()], tree.schema).limit(2))
    assert {r["repo"]: r["roles"] for r in inputs.changed(inputs.load(tree, repos), inputs.load(later, repos)).collect()} == {"ok": list(inputs.PLACES)}


def test_inspection_of_a_repository(spark, tmp_path):
    for role, text in (("package", package()), ("document", BASE), ("skeleton", SKELETON)):
        at = tmp_path / inputs.PLACES[role]
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    made = cli.run(spark, ["inspect", str(tmp_path)]).collect()[0]
    assert made["code"] == 0 and json.loads(made["report"])["routing"]["section_id"] == "project-loading"
    wrong = cli.run(spark, ["inspect", str(tmp_path), "--skeleton", "none.json"]).collect()[0]
    assert (wrong["code"], wrong["problem"], wrong["report"]) == (1, "missing skeleton: none.json", None)


def test_missing_copies_are_restored(spark):
    files, documents = repositories(spark)
    copies = spark.createDataFrame([("c",)], "repo string")
    updated = lambda choice, **k: {r["repo"]: r["text"] for r in baseline.initialise(documents, files, ["repo"], choice, copies=copies, **k)["updated"].collect()}
    made = updated(Choice("deterministic"))
    assert set(made) == {"a", "b", "d"} and made["b"] == "bad"
    assert set(updated(Choice(None, None, "off"))) == {"a", "b"}
    forced = updated(Choice("deterministic"), force=True)
    assert set(forced) == {"a", "b", "d"} and forced["b"] != "bad"


def test_generator_of_a_preview():
    known = {"own": lambda p: "text"}
    assert providers.for_preview({"K": "own"}, known, "K") is known["own"]
    assert providers.for_preview({}, known, "K") is providers.for_preview({"K": "deterministic"}, known, "K") is providers.for_preview({"K": "other"}, known, "K") is None
