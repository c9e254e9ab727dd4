import json
import os
import subprocess

import pytest

from dagbag import apps
from dagbag.sources import git, viewer
from dagbag.streaming import append_new

JAVA = "class A {\n  // if\n  void run() { if (x) { } for (;;) { } }\n}\n"


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    """Two roots, a branch and its merge, a rename, a delete, a change taken back,
    equal contents under two paths, an empty commit."""
    path = str(tmp_path_factory.mktemp("repo"))
    clock = iter(range(1_600_000_000, 1_700_000_000, 1000))

    def run(*args):
        t = str(next(clock)) + " +0000"
        env = os.environ | {"GIT_AUTHOR_DATE": t, "GIT_COMMITTER_DATE": t, "GIT_AUTHOR_NAME": "Ann", "GIT_AUTHOR_EMAIL": "ann@x", "GIT_COMMITTER_NAME": "Ann", "GIT_COMMITTER_EMAIL": "ann@x"}
        return subprocess.run(["git", "-C", path, *args], check=True, capture_output=True, env=env).stdout.decode().strip()

    def commit(message, files=(), *flags):
        for name, content in dict(files).items():
            with open(os.path.join(path, name), "w") as f:
                f.write(content)
        run("add", "-A")
        run("commit", "-q", "-m", message, *flags)
        return run("rev-parse", "HEAD")

    run("init", "-q", "-b", "main")
    ids = {"one": commit("first", {"A.java": JAVA, "notes.txt": "hello\n"})}
    ids["two"] = commit("Fix the issue", {"A.java": JAVA.replace("}\n}", "while (y) { } }\n}"), "B.java": JAVA})
    run("checkout", "-q", "-b", "side")
    ids["side"] = commit("side work", {"C.java": "class CamelCase { }\n"})
    run("checkout", "-q", "main")
    run("mv", "B.java", "D.java")
    ids["rename"] = commit("rename")
    run("merge", "-q", "--no-ff", "-m", "merge", "side")
    ids["merge"] = run("rev-parse", "HEAD")
    run("rm", "-q", "notes.txt")
    ids["delete"] = commit("delete")
    ids["back"] = commit("take back", {"A.java": JAVA})
    ids["empty"] = commit("nothing", (), "--allow-empty")
    run("checkout", "-q", "--orphan", "other")
    run("rm", "-rfq", ".")
    ids["root2"] = commit("second root", {"E.java": JAVA})
    run("checkout", "-q", "main")
    run("merge", "-q", "--allow-unrelated-histories", "-m", "join roots", "other")
    ids["last"] = run("rev-parse", "HEAD")
    return "file://" + path, ids


@pytest.fixture(scope="module")
def tables(spark, repo, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    git.ingest(spark, [repo[0]], folder)
    return git.Repositories.read(spark, folder)


def by_commit(h):
    return {n.sha: m for n, m in h if m}


def test_history(tables, repo):
    address, ids = repo
    h = tables.history()
    assert h.size() == len(ids) + 1
    edges = {(r.src.sha, r.dst.sha) for r in h.edges().collect()}
    assert (None, ids["one"]) in edges and (None, ids["root2"]) in edges and (ids["side"], ids["merge"]) in edges and len(edges) == 12
    assert by_commit(tables.message(h))[ids["two"]] == {"Fix the issue": 1} and None not in by_commit(tables.message(h))
    assert by_commit(tables.author(h))[ids["one"]] == {("Ann", "ann@x"): 1}
    assert list(by_commit(tables.time(h))[ids["one"]])[0] >= 1_600_000_000
    assert len(by_commit(tables.date(h))) == len(ids)


def test_resources_and_differences(tables, repo):
    address, ids = repo
    files = {sha: {k[0] for k in m} for sha, m in by_commit(tables.resources(tables.history())).items()}
    assert files[ids["one"]] == {"A.java", "notes.txt"} and files[ids["merge"]] == {"A.java", "C.java", "D.java", "notes.txt"}
    d = {r.path: (r.old_object_id is None, r.new_object_id is None) for r in tables.tree_diff(address, ids["two"], ids["rename"]).collect()}
    assert d == {"B.java": (False, True), "D.java": (True, False)}
    assert tables.tree_diff(address, ids["back"], ids["empty"]).count() == 0
    assert {r.path for r in tables.tree_diff(address, None, ids["one"]).collect()} == {"A.java", "notes.txt"}
    old, new = tables.removed_and_added(address, ids["merge"], ids["delete"])
    assert [r.path for r in old.collect()] == ["notes.txt"] and new.count() == 0
    assert [r.path for r in tables.tree(address, ids["merge"], ".txt").collect()] == ["notes.txt"]
    changed = by_commit(tables.resources(tables.history()).tmap(lambda path, resource: path).diff(False))
    assert changed[ids["delete"]] == {"notes.txt": -1} and ids["empty"] not in changed


def test_diffs_are_what_trees_differ_by(tables, repo):
    address, ids = repo
    trees = {}
    for r in tables.trees.collect():
        trees.setdefault(r.sha, {})[r.path] = r.object_id
    want = set()
    for c in tables.commits.collect():
        for p in c.parents or [None]:
            old, new = trees.get(p, {}), trees.get(c.sha, {})
            want |= {(c.sha, p, x, old.get(x), new.get(x)) for x in old.keys() | new.keys() if old.get(x) != new.get(x)}
    assert {(r.sha, r.parent, r.path, r.old_object_id, r.object_id) for r in tables.diffs.collect()} == want
    assert (ids["delete"], ids["merge"], "notes.txt") in {x[:3] for x in want} and not [x for x in want if x[0] == ids["empty"]]


def test_resources_from_changes(tables):
    changes = tables.resource_changes()
    flat = lambda h: sorted(map(str, h.values().collect()))
    want = tables.resources(tables.history())
    assert flat(changes.states()) == flat(want)
    assert flat(changes.diff(False)) == flat(want.diff(False))
    by_path = lambda h: h.tmap(lambda path, resource: path)
    assert flat(by_path(changes).length().states()) == flat(by_path(want).length())
    alone = git.Repositories(tables.commits, None, tables.blobs, None, tables.diffs)
    assert flat(alone.resources(alone.history(), ".java")) == flat(tables.resources(tables.history(), ".java"))


def test_messages_with_any_bytes(spark, tmp_path):
    path = str(tmp_path / "odd")
    for args in (["init", "-q", path], ["-C", path, "-c", "user.name=A", "-c", "user.email=a@x", "commit", "-q", "--allow-empty", "-m", "one \x1f two \x1e three\n\nbody"]):
        subprocess.run(["git", *args], check=True)
    (c,) = git.read_table(spark, [f"file://{path}"], "commits").collect()
    assert c.message == "one \x1f two \x1e three\n\nbody" and c.parents == []


def test_clones_need_a_shared_folder():
    with pytest.raises(ValueError, match="mount"):
        git.local_repository("owner/name")


def test_contents(tables, repo):
    address, ids = repo
    assert tables.contents().count() == 4  # equal contents once
    assert sorted(r.n_lines for r in tables.line_counts().collect()) == [1, 1, 4, 4]
    assert [(r.author_name, r.n_lines) for r in tables.blame("A.java").collect()] == [("Ann", 4)]
    a = {r.node.sha: r.attributes for r in tables.attributes().collect()}[ids["two"]]
    assert (a["fix"], a["issue"], a["parents"], a["name"]) == ("true", "true", "1", "Ann") and a["date"].endswith("Z")


def test_analyses(tables, repo):
    ids = repo[1]
    mcc = {sha: list(m)[0] for sha, m in by_commit(apps.complexity(tables)).items()}
    assert mcc[ids["one"]] == 2 and mcc[ids["two"]] == 5 and mcc[ids["last"]] == 6
    loc = {sha: list(m)[0] for sha, m in by_commit(apps.lines_of_code(tables)).items()}
    assert loc[ids["one"]] == 3 and loc[ids["side"]] == 7
    terms = {sha: list(m)[0] for sha, m in by_commit(apps.terms_added(tables)).items()}
    assert terms[ids["side"]] == 3 and ids["merge"] not in terms and ids["rename"] not in terms


def test_missing_head_and_addresses(spark, tmp_path, repo):
    subprocess.run(["git", "init", "-q", str(tmp_path / "void")], check=True)
    both = git.Repositories.of(spark, [f"file://{tmp_path}/void", repo[0]])
    assert both.commits.select("address").distinct().count() == 1
    assert git.local_repository("file:///a/b") == "/a/b"


def test_viewer(tables, repo, tmp_path):
    h = tables.resources(tables.history(), ".txt").tmap(lambda path, resource: path)
    page = viewer.show(h, str(tmp_path / "v"), edge_labels=True, commits=tables.commits)
    drawn = json.loads((tmp_path / "v" / "graph.json").read_text())
    hover = [x["commit"] for n in drawn["nodes"] for x in n["hover"]]
    assert sorted(hover) == sorted(repo[1].values()) and len(drawn["nodes"]) < 10
    assert "digraph" in (tmp_path / "v" / "graph.dot").read_text() and os.path.getsize(page) > 1000
    full = viewer.graph(h, contract=False)
    assert len(full["nodes"]) == 11 and len(full["edges"]) == 12
    assert viewer.label([(str(i), 2) for i in range(30)]).endswith(" . . . ")


def test_stream_appends_each_commit_once(spark, tables, tmp_path):
    src, table = str(tmp_path / "src"), str(tmp_path / "table")
    seen = []
    for _ in range(2):
        tables.commits.write.mode("append").parquet(src)
        stream = spark.readStream.schema(tables.commits.schema).parquet(src)
        append_new(stream, table, ("address", "sha"), str(tmp_path / "cp"), lambda df, n: seen.append(df.count()), once=True).awaitTermination()
    assert spark.read.parquet(table).count() == 10 and seen[0] == 10 and sum(seen) == 10
