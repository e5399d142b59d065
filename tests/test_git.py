"""Commit ranges read in bulk, against one git process for each file."""

import json
import subprocess

import pytest

from weftline.sources import git, readers


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    at = tmp_path_factory.mktemp("repo")
    run = lambda *a: subprocess.run(["git", "-C", at, "-c", "user.name=Some One", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    for i in range(150):
        (at / f"d{i % 7}").mkdir(exist_ok=True)
        (at / f"d{i % 7}" / f"m{i}.py").write_text(f"class A{i}:\n    def run(self):\n        return {i}\n" + "# same\n" * 20)
    (at / "odd \"name\" ü*.txt").write_text("one\ntwo")
    (at / "[x].txt").write_text("in brackets\n")
    (at / "x.txt").write_text("not in brackets\n")
    (at / "blob.bin").write_bytes(bytes(range(256)))
    (at / "latin.txt").write_bytes(b"caf\xe9\n")
    run("add", ".")
    run("commit", "-qm", "first\n\nwith a body")
    for i in range(0, 150, 2):
        f = at / f"d{i % 7}" / f"m{i}.py"
        f.write_text(f.read_text().replace(f"return {i}", f"x = 'diff --git a/b'\n        return {i + 1}"))
    for i in range(1, 30, 3):
        (at / f"d{i % 7}" / f"m{i}.py").rename(at / f"d{i % 7}" / f"moved{i}.py")
    for i in (31, 33, 35):
        (at / f"d{i % 7}" / f"m{i}.py").unlink()
    (at / "odd \"name\" ü*.txt").write_text("one\nthree")
    (at / "[x].txt").write_text("changed\n")
    (at / "x.txt").write_text("changed too\n")
    (at / "blob.bin").write_bytes(bytes(range(255)))
    (at / "latin.txt").write_bytes(b"caf\xe8\n")
    (at / "new.py").write_text("def f():\n    return 1\n")
    run("add", "-A")
    run("commit", "-qm", "second")
    run("commit", "-q", "--allow-empty", "-m", "nothing")
    return str(at)


def test_equal_to_one_process_for_each_file(spark, repo):
    bulk = {r["path"]: r for r in git.read(spark, repo, before="HEAD~2", after="HEAD~1", partitions="5").collect()}
    single = {r["path"]: r["diff"] for r in readers.git_changes(spark, "HEAD~2", "HEAD~1", repo)["diffs"].collect()}
    assert {p: r["diff"] for p, r in bulk.items()} == single and len(single) > 80
    for path, r in bulk.items():
        if not r["binary"]:
            assert r["new_content"] == readers.git_blob("HEAD~1", path, repo)  # empty where it isn't there
            assert r["old_content"] == readers.git_blob("HEAD~2", r["old_path"] or path, repo)
    assert bulk["blob.bin"]["binary"] and bulk["blob.bin"]["additions"] is None
    assert bulk["latin.txt"]["new_content"] == "caf�\n"
    assert sorted(r["pos"] for r in bulk.values()) == list(range(len(bulk)))
    assert {r["author"] for r in bulk.values()} == {"Some One"} and {r["message"] for r in bulk.values()} == {"second"}
    counts = {r["path"]: (r["status"], r["old_path"], r["additions"], r["deletions"]) for r in bulk.values()}
    assert counts["new.py"] == ("added", None, 2, 0) and counts["d1/moved1.py"] == ("renamed", "d1/m1.py", 0, 0)


def test_each_commit_of_a_history(spark, repo):
    rows = git.read(spark, repo, commits="HEAD", partitions="2").collect()
    by = {}
    for r in rows:
        by.setdefault((r["commit_order"], r["message"]), []).append(r["path"])
    (first, n), (second, m) = sorted(by.items())
    assert first[1] == "first\n\nwith a body" and len(n) == 155 and second[1] == "second" and "new.py" in m
    packages = {r["change_id"]: json.loads(r["json"]) for r in git.packages(git.read(spark, repo, commits="HEAD"), "me/repo").collect()}
    assert len(packages) == 2  # a commit without changes has no package
    for change, made in packages.items():
        assert made["after_sha"] == change and made["actor"] == "Some One" and made["schema_version"] == 3
    own = next(p for p in packages.values() if any(f["path"] == "new.py" for f in p["changed_files"]))
    ranged = json.loads(readers.git_package(spark, "HEAD~2", "HEAD~1", repo, repository="me/repo").collect()[0]["json"])
    assert own["changed_files"] == ranged["changed_files"] and own["generated_summary"] == ranged["generated_summary"]


def test_columns_that_nobody_wants_cost_nothing(spark, repo):
    r = git.read(spark, repo, before="HEAD~2", after="HEAD~1", diffs="false", contents="false").where("path = 'new.py'").first()
    assert r["diff"] is None and r["new_content"] is None and r["additions"] == 2


def test_nothing_and_mistakes(spark, repo):
    assert git.read(spark, repo, before="HEAD~1", after="HEAD").count() == 0
    with pytest.raises(Exception, match="either commits"):
        git.read(spark, repo, before="HEAD").count()
    with pytest.raises(Exception):  # noqa: B017
        git.read(spark, repo, before="HEAD", after="nowhere").count()


def test_ten_thousand_files(spark, tmp_path):
    run = lambda *a, **k: subprocess.run(["git", "-C", tmp_path, "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True, **k)
    run("init", "-q")
    # Trees are made from a stream, so that the test writes no files.
    stream = lambda mark, text: "".join([f"commit refs/heads/main\nmark :{mark}\ncommitter n <e@x> {mark} +0000\ndata 1\nx\n", *(f"M 100644 inline d{i % 100}/f{i}.txt\ndata {len(text.format(i))}\n{text.format(i)}\n" for i in range(10_000)), "\n"])
    run("fast-import", "--quiet", input=(stream(1, "old {0}\n") + stream(2, "new {0}\nline\n")).encode())
    found = git.read(spark, str(tmp_path), before="main~1", after="main", partitions="4")
    assert found.where("additions = 2 and deletions = 1 and diff like '%+line%' and old_content = concat('old ', regexp_extract(path, 'f([0-9]+)', 1), '\n')").count() == 10_000
