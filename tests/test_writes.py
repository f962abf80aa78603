"""Writes: the journal's log, file changes in batches, mirrored sources."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from scriptorium.plans.patch import Changed, Patch
from scriptorium.plans.writes import Conflict, JournalWriter
from scriptorium.sources import journal as source

T = dt.datetime(2024, 5, 1, 12, tzinfo=dt.UTC)


def test_journal_writes(spark, tmp_path):
    """Of two writers with one expected version one is refused; what is shown is the fold of the log."""
    root, project = tmp_path / "journal", tmp_path / "project"
    project.mkdir()
    (project / "plan.txt").write_text("plan")
    w = JournalWriter(spark, str(root), str(project), "cli", "s1")
    a, b = w.new("Fix the Parser", ["Go", "x-1"], T), w.new("Other", now=T)
    assert a["id"].startswith("20240501-fix-the-parser-") and a["tags"] == ["go", "x-1"] and w.version(a["id"]) == 1
    w.note(a["id"], "half way", refs={"pr": "7"}, now=T + dt.timedelta(days=1), expected=1)
    with pytest.raises(Conflict):
        w.note(a["id"], "too late", expected=1)
    w.done(a["id"], "ready", now=T + dt.timedelta(days=2))
    with pytest.raises(ValueError):
        w.done(a["id"])
    w.done(b["id"], abandoned=True, keep=True, now=T)
    state = {r.id: r for r in w.state().collect()}
    assert state[a["id"]].status == "done" and state[a["id"]].refs.pr == "7" and state[a["id"]].log_version == 3
    assert str(state[a["id"]].expires_at) == "2024-06-02 12:00:00" and state[b["id"]].expires_at is None
    events = [(r.event, r.summary) for r in source.events(spark, str(root)).where(F.col("id") == a["id"]).orderBy("at").collect()]
    assert events == [("created", ""), ("note", "half way"), ("done", "ready")]
    held = source.entries(spark, str(root)).where("problem is null").drop("folder", "problem")
    assert sorted(held.collect()) == sorted(w.state().select(held.columns).collect())
    # A writer that died between log and record: the log counts, and is repaired.
    (root / a["id"] / "entry.json").write_text(json.dumps(a))
    assert {r.id: r.status for r in w.state().collect()}[a["id"]] == "done"
    assert w.repair() == [a["id"]] and w.repair() == [] and json.loads((root / a["id"] / "entry.json").read_text())["status"] == "done"
    assert w.note(a["id"], now=T + dt.timedelta(days=3))["status"] == "open"
    assert w.attach(a["id"], "plan.txt") == f"{a['id']}/plan.txt" and (root / a["id"] / "plan.txt").read_text() == "plan"
    for bad in ({"path": "plan.txt"}, {"path": "../x"}, {"path": "gone"}, {"path": "plan.txt", "name": "log"}):
        with pytest.raises((FileExistsError, LookupError, ValueError)):
            w.attach(a["id"], **bad)
    w.done(a["id"], abandoned=True, now=T)
    assert w.gc(T + dt.timedelta(days=6)) == [] and w.gc(T + dt.timedelta(days=7)) == [a["id"]] and (root / a["id"]).exists()
    assert w.gc(T + dt.timedelta(days=7), apply=True) == [a["id"]] and not (root / a["id"]).exists() and [n for n in os.listdir(root) if n.startswith(".trash")] == []
    assert [r.id for r in spark.read.json(str(root / "index")).collect()] == [b["id"]]
    for bad in ({"title": " "}, {"title": "t", "tags": ["A b"]}):
        with pytest.raises(ValueError):
            w.new(**bad)
    with pytest.raises(LookupError):
        w.note("20240501-none-0000")


WANTED = "path string, content string, remove boolean, force boolean"


def _tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f)).read() for d, _, fs in os.walk(root) for f in fs if not f.endswith(".crc")}


@pytest.fixture
def batch(spark, tmp_path):
    root = tmp_path / "root"
    for path, content in {"a.txt": "old", "deep/er/b.txt": "gone soon", "same.txt": "same", "read.txt": "input"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content)
    rows = [("a.txt", "new", None, None), ("deep/er/b.txt", None, True, None), ("same.txt", "same", None, None), ("new/c.txt", "made", None, None), ("read.txt", None, None, None), ("none.txt", None, True, None)]
    p = Patch(spark, str(root), str(tmp_path / "records"))
    return p, p.plan(spark.createDataFrame(rows, WANTED)), root


AFTER = {"a.txt": "new", "same.txt": "same", "new/c.txt": "made", "read.txt": "input"}
BEFORE = {"a.txt": "old", "deep/er/b.txt": "gone soon", "same.txt": "same", "read.txt": "input"}


def test_apply_and_undo(spark, batch):
    p, name, root = batch
    assert {r.path: r.operation for r in p.changes(name).collect()} == {"a.txt": "update", "deep/er/b.txt": "remove", "new/c.txt": "create"}
    assert p.apply(name) == {"applied": 3, "status": "complete"}
    assert _tree(root) == AFTER and not (root / "deep").exists()
    assert p.recover(name) == "complete"
    with pytest.raises((RuntimeError, Changed)):
        p.apply(name)
    assert p.recover(name, undo=True) == "undone" and _tree(root) == BEFORE and not (root / "new").exists()
    for rows in ([("x", "1", None, None), ("x", None, True, None)], [("../x", "1", None, None)]):
        with pytest.raises(ValueError):
            p.plan(spark.createDataFrame(rows, WANTED))
    forced = p.plan(spark.createDataFrame([("same.txt", "same", None, True)], WANTED))
    assert p.apply(forced)["applied"] == 1


@pytest.mark.parametrize("state", ["backing_up", "applying", "partly"])
def test_recovery(batch, state, monkeypatch):
    """K7: a batch cut off in each state."""
    p, name, root = batch
    if state == "backing_up":
        calls = []
        monkeypatch.setattr(p, "validate", lambda n: calls.append(n) or (len(calls) > 1 and (_ for _ in ()).throw(OSError("cut off"))))
    else:
        monkeypatch.setattr(p, "_finish", lambda n: (_ for _ in ()).throw(OSError("cut off")))
    with pytest.raises(OSError):
        p.apply(name)
    monkeypatch.undo()
    assert p.status(name) == ("backing_up" if state == "backing_up" else "applying") and _tree(root) == BEFORE
    if state == "backing_up":
        assert p.recover(name) == "discarded" and p.status(name) is None and _tree(root) == BEFORE
        return
    if state == "partly":
        (root / "a.txt").write_text("new")
        assert p.recover(name, undo=True) == "undone" and _tree(root) == BEFORE
        return
    (root / "new").mkdir()
    (root / "new/c.txt").write_text("made")
    assert p.recover(name) == "complete" and _tree(root) == AFTER


def test_snapshots_hold(batch):
    """A file that changed after planning, even one that is only read, stops the batch before anything is written."""
    p, name, root = batch
    (root / "read.txt").write_text("other")
    with pytest.raises(Changed):
        p.apply(name)
    assert p.status(name) is None and _tree(root) == {**BEFORE, "read.txt": "other"}
    (root / "read.txt").write_text("input")
    run = p._run

    def between(rows):
        (root / "a.txt").write_text("someone else's")
        return run(rows)

    p._run = between
    with pytest.raises(Changed):
        p.apply(name)
    assert p.status(name) == "applying" and (root / "a.txt").read_text() == "someone else's"


def _tar(files):
    import io
    import tarfile

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            if data is None:
                info.type, info.linkname = tarfile.SYMTYPE, "/etc/passwd"
            else:
                info.size = len(data)
            t.addfile(info, io.BytesIO(data or b""))
    return out.getvalue()


def test_mirrored_sources(spark, tmp_path):
    """Refs and tags resolved in the reader, pins that do not hold refused, one partition for each artefact."""
    import base64
    import hashlib
    from urllib.parse import quote

    from scriptorium.sources.mirrors import fetch

    commit, other = "a" * 40, "b" * 40
    git = tmp_path / "git" / quote("https://g.example.org/r.git", safe="")
    (git / commit / "docs").mkdir(parents=True)
    (git / commit / "docs/a.md").write_text("a")
    (git / "refs.json").write_text(json.dumps({"main": commit, "gone": other, "odd": "zz"}))
    http = tmp_path / "http"
    http.mkdir()
    plain, bad = _tar({"x/y.txt": b"yy", "./z": b""}), _tar({"x": b"1", "l": None})
    for name, data in {"plain": plain, "bad": bad, "up": _tar({"../x": b"1"}), "twice": _tar({"a": b"1", "A": b"2"})}.items():
        (http / quote(f"https://h.example.org/{name}", safe="")).write_bytes(data)
    tgz = _tar({"package/index.js": b"js", "other/no": b""})
    npm = tmp_path / "npm" / quote("@s/p", safe="")
    npm.mkdir(parents=True)
    (npm / "p-1.2.0.tgz").write_bytes(tgz)
    sri = "sha512-" + base64.b64encode(hashlib.sha512(tgz).digest()).decode()
    (npm / "package.json").write_text(json.dumps({"name": "@s/p", "dist-tags": {"latest": "1.2.0", "next": "9.9.9"}, "versions": {"1.2.0": {"version": "1.2.0", "dist": {"tarball": "https://n/p-1.2.0.tgz", "integrity": f"sha256-AAAA {sri}"}}}}))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    g = {"id": "g", "type": "git", "url": "https://g.example.org/r.git"}
    h = {"id": "h", "type": "http", "url": "https://h.example.org/plain", "sha256": sha(plain)}
    n = {"id": "n", "type": "npm", "package": "@s/p"}
    df = fetch(spark, str(tmp_path), [{**g, "ref": "main"}, {**h, "archive": True}, {**h, "id": "f"}, {**n, "version": "latest"}])
    assert df.rdd.getNumPartitions() == 4
    got = {(r.id, r.path): (r.resolved, r.sha256, r.size, bytes(r.content)) for r in df.collect()}
    assert got == {
        ("g", "docs/a.md"): (commit, None, 1, b"a"), ("h", "x/y.txt"): (h["url"], sha(plain), 2, b"yy"), ("h", "z"): (h["url"], sha(plain), 0, b""),
        ("f", "plain"): (h["url"], sha(plain), len(plain), plain), ("n", "index.js"): ("1.2.0", sha(tgz), 2, b"js"),
    }
    at = lambda name, data: {**h, "url": f"https://h.example.org/{name}", "sha256": sha(data), "archive": True}
    read = lambda name: (http / quote(f"https://h.example.org/{name}", safe="")).read_bytes()
    for wrong in (
        {**g, "ref": "none"}, {**g, "ref": "gone"}, {**g, "ref": "odd"}, {**g, "ref": "main", "locked": {"commit": other}}, {**h, "sha256": "0" * 64}, {**h, "sha256": None}, {**h, "url": "https://h.example.org/none"},
        {**n, "version": "next"}, {**n, "version": "none"}, {**n, "version": "latest", "locked": {"version": "1.2.0", "integrity": "sha512-AAAA"}}, {**n, "version": "1.2.0", "locked": {"version": "1.2.0", "sha256": "0" * 64}},
        at("bad", bad), at("up", read("up")), at("twice", read("twice")), {**h, "type": "ftp"},
    ):
        with pytest.raises(Exception, match=wrong["id"]):
            fetch(spark, str(tmp_path), [wrong]).collect()
    locked = fetch(spark, str(tmp_path), [{**g, "ref": "moved", "locked": {"commit": commit}}]).collect()
    assert [r.resolved for r in locked] == [commit]


def test_vendoring(spark, tmp_path):
    """Dry run, update, sync to the pins, files in the way, changes by hand, removals."""
    from urllib.parse import quote

    from scriptorium.plans.vendoring import Refused, Vendoring

    one, two = "a" * 40, "b" * 40
    git = tmp_path / "mirror" / "git" / quote("https://g.example.org/r", safe="")
    for commit, files in {one: {"docs/a.md": "a1", "docs/sub/b.md": "b1", "LICENSE": "free"}, two: {"docs/a.md": "a2", "docs/c.md": "c2", "LICENSE": "free"}}.items():
        for path, body in files.items():
            (git / commit / path).parent.mkdir(parents=True, exist_ok=True)
            (git / commit / path).write_text(body)
    (git / "refs.json").write_text(json.dumps({"main": one}))
    root = tmp_path / "project"
    root.mkdir()
    v = Vendoring(spark, str(root), str(tmp_path / "records"), str(tmp_path / "mirror"))
    art = [{"id": "d", "type": "git", "url": "https://g.example.org/r", "ref": "main"}]
    maps = spark.createDataFrame([("d", "docs", "third/docs/", True), ("d", "LICENSE", "third/LICENSE", False)], "id string, `from` string, `to` string, directory boolean")
    none = spark.createDataFrame([], "id string, path string, hash string")
    dry = v.plan(art, maps, none)
    assert sorted(map(tuple, dry["changes"].collect())) == [("third/LICENSE", "create"), ("third/docs/a.md", "create"), ("third/docs/sub/b.md", "create")] and _tree(root) == {}
    done = v.update(art, maps, none)
    first = {"third/LICENSE": "free", "third/docs/a.md": "a1", "third/docs/sub/b.md": "b1"}
    assert done["applied"] == 3 and _tree(root) == first
    lock = spark.createDataFrame(done["lock"].collect(), done["lock"].schema)
    assert {r.resolved for r in lock.collect()} == {one} and {r.state for r in v.check(lock).collect()} == {"ok"}
    (git / "refs.json").write_text(json.dumps({"main": two}))
    pins = {"d": {"commit": one}}
    assert v.sync(art, maps, lock, pins)["applied"] == 0 and _tree(root) == first
    with pytest.raises(Refused):
        v.sync(art, maps, lock, {})
    (root / "third/docs/a.md").write_text("mine")
    (root / "third/docs/c.md").write_text("in the way")
    assert {r.path: r.state for r in v.check(lock).collect()}["third/docs/a.md"] == "differs"
    with pytest.raises(Refused, match="a.md: locally_modified; third/docs/c.md: unowned_target"):
        v.update(art, maps, lock)
    assert v.update(art, maps, lock, force=True)["status"] == "complete"
    assert _tree(root) == {"third/LICENSE": "free", "third/docs/a.md": "a2", "third/docs/c.md": "c2"} and not (root / "third/docs/sub").exists()
    for bad in ([("d", "none", "x", True)], [("d", "docs", "x", True), ("d", "LICENSE", "X/a.md", False)], [("d", "LICENSE", "x", False), ("d", "docs/a.md", "x", False)]):
        with pytest.raises(Refused):
            v.plan(art, spark.createDataFrame(bad, maps.schema), none)


def test_refresher(spark):
    """At start, then once for all requests, no two at a time; cancelled by its limit and by stop."""
    import threading
    import time

    from scriptorium.streaming.refresher import Refresher

    gate, began = threading.Event(), []

    def build():
        began.append(time.time())
        gate.wait(20)
        return {"n": len(began)}

    r = Refresher(spark, build, interval=0.5)
    while not began:
        time.sleep(0.01)
    for _ in range(5):
        r.request()
    assert r.running
    gate.set()
    deadline = time.time() + 20
    while len(r.reports) < 2 and time.time() < deadline:
        time.sleep(0.02)
    time.sleep(1)
    assert r.reports == [{"n": 1}, {"n": 2}] and began[1] - began[0] >= 0.5 and r.stop(5)
    slow = lambda: spark.range(1 << 45).selectExpr("sum(id % 7)").collect()
    over = Refresher(spark, slow, interval=60, limit=0.5)
    deadline = time.time() + 60
    while not over.reports and time.time() < deadline:
        time.sleep(0.05)
    assert isinstance(over.reports[0], Exception) and over.stop(5)
    other = Refresher(spark, slow, interval=60)
    time.sleep(1)
    assert other.stop(60) and isinstance(other.reports[0], Exception)
