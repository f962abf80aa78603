"""Builds, generations, freshness, search and the public API over real trees."""

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import search
from scriptorium.plans.engine import Engine
from scriptorium.plans.index import Index
from scriptorium.sources import tree

GO = "// Package server serves.\npackage server\n\nimport \"fmt\"\n\n// NewHTTPServer builds a server.\nfunc NewHTTPServer() { fmt.Println(8081) }\n"


def write(root, files):
    for path, content in files.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(content if isinstance(content, bytes) else content.encode())


FILES = {
    "server.go": GO,
    "docs/README.md": "# Project\n\nRead the guide.\n",
    "docs/guide.md": "---\nid: H-1\ntitle: Guide\ncollection: handbook\nsidebar_position: 1\n---\n# Guide\n\nRun the HTTP server first.\n\n## Stop\n\nSee [code](../server.go).\n",
    "docs/req.md": "---\nid: REQ-1\ntitle: Auth\nstatus: accepted\ncollection: requirements\nrelated: [ADR-1]\n---\nUses [auth](../src/auth.go).\n",
    "docs/adr.md": "---\nid: ADR-1\ntitle: Choice\nstatus: accepted\ndate: 2024-01-02\ncollection: decisions\n---\nDecided.\n",
    "config.json": '{"port": 8080}\n',
    "mentions.md": "The server is mentioned; HTTP too.\n",
    ".gitignore": "*.log\nprivate/\n!private/keep.md\n",
    "private/keep.md": "hidden\n",
    "a.log": "x\n",
    "vendor/x.go": "package x\n",
    "gen.go": "// Code generated by y. DO NOT EDIT.\n\npackage y\n",
    "go.sum": "lock\n",
    "bin.txt": b"a\x00b",
    "latin.txt": b"caf\xe9",
    "image.png": b"png",
    "empty.md": "",
}


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "project"
    write(root, FILES)
    return root


def test_scan(spark, project):
    got = {r.path: (r.kind, r.language) for r in tree.scan(spark, str(project)).collect()}
    assert set(got) == {"server.go", "docs/README.md", "docs/guide.md", "docs/req.md", "docs/adr.md", "config.json", "mentions.md", ".gitignore", "empty.md"}
    assert got["server.go"] == ("code", "go") and got[".gitignore"] == ("config", "text")
    small = tree.scan(spark, str(project), max_bytes=20).select("path").collect()
    assert {r.path for r in small} == {"config.json", "empty.md"}
    more = {r.path for r in tree.scan(spark, str(project), extra_extensions=("sum",), extra_directories=("docs",)).collect()}
    assert "go.sum" in more and not any(p.startswith("docs/") for p in more)


def test_build_and_freshness(spark, project, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    with pytest.raises(FileNotFoundError):
        index.snapshot()
    first = index.build(str(project))
    assert (first["indexed"], first["deleted"], first["published"]) == (9, 0, True)
    assert index.build(str(project))["published"] is False
    held = index.snapshot()
    write(project, {"new.md": "new\n", "config.json": '{"port": 1}\n'})
    (project / "mentions.md").unlink()
    (project / ".gitignore").write_text("docs/\n*.log\nprivate/\n")
    status, changes = index.freshness()
    assert status == "stale"
    assert {(r.path, r.state) for r in changes.collect()} == {
        ("new.md", "new"), ("config.json", "changed"), (".gitignore", "changed"), ("mentions.md", "deleted"), *((f"docs/{n}.md", "excluded") for n in ("README", "guide", "req", "adr")),
    }
    second = index.build()
    assert (second["indexed"], second["deleted"], second["unchanged"]) == (3, 5, 2)
    assert index.freshness()[0] == "fresh"
    assert held.manifest.count() == 9, "a reader keeps its generation"
    assert index.build(str(project), extra_extensions=("log",))["published"] is True
    with pytest.raises(ValueError):
        index.build(str(tmp_path))


def test_search_and_api(spark, project, tmp_path):
    e = Engine(spark, str(tmp_path / "index"), str(project))
    e.build()
    hits, info = e.search("NewHTTPServer")
    top = hits.first()
    assert top.path == "server.go" and not info["relaxed"] and "NewHTTPServer" in top.excerpt and top.stale is False and not info["refresh"]
    hits, _ = e.search("HTTP server", kind="documentation")
    assert {r.path for r in hits.collect()} == {"docs/guide.md", "mentions.md"}
    assert e.search("8080")[0].first().path == "config.json"
    hits, info = e.search("http server qqq first")
    assert info["relaxed"] and {r.path for r in hits.collect()} == {"docs/guide.md", "mentions.md", "server.go"}
    assert e.search("qqqq zzzz")[1]["total"] == 0
    assert {r.path for r in e.search("guide", path_prefix="docs/gu")[0].collect()} == {"docs/guide.md"}
    for bad in ({"query": " "}, {"query": "x", "limit": 101}, {"query": "x", "kind": "y"}, {"query": "x", "offset": -1}):
        with pytest.raises(ValueError):
            e.search(**bad)
    (project / "config.json").write_text("{}")
    hits, info = e.search("8080")
    assert hits.first().stale and info["refresh"]
    assert e.stats().first().files == 9
    assert [r.path for r in e.list_files(kind="documentation", limit=2, offset=1).collect()] == ["docs/adr.md", "docs/guide.md"]
    line = e.read_lines("./server.go", 6, 1).first()
    assert line.content.startswith("// NewHTTPServer") and line.next_start_line == 7
    doc = e.get_document("REQ-1").first()
    assert doc.path == "docs/req.md" and doc.status_meaning.startswith("Agreed intent")
    with pytest.raises(LookupError):
        e.get_document("NONE")
    got = [(r.path, r.reason) for r in e.impact(["src/auth.go", "other"]).collect()]
    assert got == [("docs/req.md", "direct_link"), ("docs/adr.md", "related_document")]
    items = e.context(["server.go", "src/auth.go"], 2000).orderBy("item").collect()
    assert [(r.path, r.reason) for r in items] == [("docs/README.md", "bootstrap"), ("docs/guide.md", "guidance"), ("server.go", "explicit"), ("docs/req.md", "linked"), ("docs/adr.md", "related")]
    assert sum(r.bytes for r in items) <= 2000
    assert {r.check: r.status for r in e.doctor().collect()} == {"index": "warn"}


def test_pages_lose_nothing(spark):
    rows = [(f"d{i}.md", "documentation", "md", "t", [], "", f"d{i}", "", "", "common word here", 1, 1, 0, f"d{i}.md#0") for i in range(130)]
    names = "path string, kind string, language string, title string, symbols array<string>, names string, filename string, content string, code string, prose string, start_line int, end_line int, chunk_no int, chunk_id string"
    chunks = spark.createDataFrame(rows, names)
    held = search.postings(chunks).cache()
    seen, offset = [], 0
    while offset is not None:
        page, info = search.page(held, chunks, search.Query("common word", limit=50, offset=offset))
        seen += [r.chunk_id for r in page.collect()]
        offset = info["next_offset"]
    assert len(seen) == len(set(seen)) == 130 and seen == sorted(seen) and info["total"] == 130


def test_plans(spark, sf, tmp_path):
    """Filters and columns reach the scan; the page is a top-k."""
    from scriptorium.plans.views import corpus

    docs = corpus(spark, sf)
    docs.write.parquet(str(tmp_path / "c"))
    read = spark.read.parquet(str(tmp_path / "c"))
    plan = search.list_files(read.select("path", "kind", "language"), kind="code", path_prefix="src1")._jdf.queryExecution().toString()
    assert "EqualTo(kind,code)" in plan and "StringStartsWith(path,src1)" in plan and "TakeOrderedAndProject" in plan
    assert "content" not in plan.split("ReadSchema")[-1].split("\n")[0]
    assert F is not None


def _full(spark, root, at):
    index = Index(spark, str(at))
    index.build(str(root))
    return index.snapshot()


def _hits(snap, query, **options):
    q = search.Query(query, **options)
    page, info = search.page(snap.postings, snap.chunks, q, snap.lengths)
    rows = [(r.chunk_id, r.score) for r in page.collect()]
    best = [(r.chunk_id, r.score) for r in search.top(snap.postings, snap.blocks, snap.chunks, snap.lengths, q).collect()]
    assert best == rows
    return rows, info


def test_segments_equal_a_full_build(spark, project, tmp_path):
    """K1, K2: one changed file writes one small segment; searches over segments equal those over a full build."""
    index = Index(spark, str(tmp_path / "index"))
    index.build(str(project))
    edits = [
        {"mentions.md": "The server now says HTTP twice: HTTP.\n"}, {"docs/more.md": "# More\n\nAn http server again.\n"}, {"server.go": GO.replace("8081", "8080")},
        {"docs/more.md": "# Less\n"}, {"a/b.md": "server server server\n"},
    ]
    for k, files in enumerate(edits):
        write(project, files)
        if k == 3:
            (project / "docs/adr.md").unlink()
        before = {s["id"] for s in index.snapshot().segments}
        report = index.build()
        snap = index.snapshot()
        new = [s for s in snap.segments if s["id"] not in before]
        assert report["indexed"] == 1 and report["deleted"] == (k == 3) and len(new) == 1 and len(snap.segments) <= 4
        assert new[0]["files"] == 1 or len(snap.segments) == 1, "only a merge writes more than the changed file"
    full = _full(spark, project, tmp_path / "full")
    columns = ["path", "hash", "size", "chunks", "lines", "kind", "language"]
    assert sorted(snap.manifest.select(columns).collect()) == sorted(full.manifest.select(columns).collect())
    held = [c for c in full.chunks.columns if c != "segment"]
    assert sorted(map(repr, snap.chunks.select(held).collect())) == sorted(map(repr, full.chunks.select(held).collect()))
    for query in ("HTTP server", "server", "NewHTTPServer", "http server qqq first", "nothing here"):
        assert _hits(snap, query) == _hits(full, query)
    assert len(index.storage.list("segments")) <= len({s["id"] for n in index.generations() for s in index.snapshot(generation=n).segments})


def test_commits_and_leases(spark, project, tmp_path):
    """Of two builders one wins; a leased commit outlives later builds, and goes with its lease."""
    index, other = (Index(spark, str(tmp_path / "index"), keep=1) for _ in range(2))
    index.build(str(project))
    held = index.snapshot(hold=600)
    with index.snapshot(hold=600) as short:
        assert len(index.storage.list("leases")) == 2 and short.generation == 1
    write(project, {"x.md": "one\n"})
    # The other builder publishes while this one is between reading and committing.
    commit = index._commit

    def late(old, info):
        other.build()
        return commit(old, info)

    index._commit = late
    with pytest.raises(RuntimeError):
        index.build()
    index._commit = commit
    assert index.build()["published"] is False, "the winner's build has the file"
    named = {s["id"] for s in index.snapshot().segments}
    assert set(index.storage.list("segments")) == named, "the loser's segment is gone, what the lease holds is still named"
    for n in range(2):
        (project / "x.md").write_text(f"{n}\n")
        index.build()
    assert held.manifest.count() == 9 and held.chunks.count() > 0, "two builds behind"
    (project / "x.md").write_text("again\n")
    index.build()
    assert len(index.snapshot().segments) < 4 and index.generations() == [1, index.snapshot().generation]
    assert held.chunks.count() > 0, "merged segments stay for the lease as well"
    held.release()
    index.vacuum()
    assert set(index.storage.list("segments")) == {s["id"] for s in index.snapshot().segments} and index.storage.list("retired") == []
    with pytest.raises(FileNotFoundError):
        index.snapshot(generation=1)
    expired = index.snapshot(hold=-1)
    assert index._leased() == set() and expired.lease
    assert index.storage.put_if_absent("commits/x", "a") and not index.storage.put_if_absent("commits/x", "b") and index.storage.read("commits/x") == "a"


def test_rank(spark):
    """Rare words weigh more than common ones, short fields more than long ones, names most; bounds lose nothing."""
    import random

    rng = random.Random(7)
    rows = []
    for i in range(600):
        words = [rng.choice(["common", "plain", "server", "w"]) for _ in range(rng.randrange(1, 60))] + ["rare"] * (i % 97 == 0) + ["common"] * (i % 13)
        rows.append((f"f{i}.go", "code", "go", rng.choice(["common title", "server", "t"]), ["common"] if i == 5 else [], rng.choice(["common", "", ""]), f"f{i}.go", "", " ".join(words), "", 1, 1, 0, f"f{i}.go#0"))
    names = "path string, kind string, language string, title string, symbols array<string>, names string, filename string, content string, code string, prose string, start_line int, end_line int, chunk_no int, chunk_id string"
    chunks = spark.createDataFrame(rows, names)
    held = search.blocked(search.postings(chunks)).cache()
    stored, sizes = search.blocks(held), search.lengths(chunks)
    for q in (search.Query("common"), search.Query("rare common", limit=5), search.Query("server common", limit=7, offset=3), search.Query("rare zzzz", limit=4), search.Query("rare plain zzzz", limit=100), search.Query("common", "code", "go", "f1", 3)):
        want = [tuple(r) for r in search.search_chunks(chunks, q).collect()]
        assert [tuple(r) for r in search.top(held, stored, chunks, sizes, q).collect()] == want
        found, total, relaxed = search.chosen(search.scored(held, chunks, search.plan(spark, q), search.weigh(held, sizes, search.plan(spark, q).asked)))
        assert [(r.chunk_id, r.score, relaxed) for r in search.ranked(found, q).collect()] == want and (total > 0) == bool(want)
    w = search.weigh(held, sizes, ["rare", "common"])
    assert w == search.weigh_chunks(chunks, ["rare", "common"])
    s = lambda term, tf, n: spark.range(1).select(F.lit("code").alias("field"), F.lit(term).alias("term")).select(w.of(F.lit(tf), F.lit(n))).first()[0]
    assert s("rare", 1, 20) > 3 * s("common", 1, 20) and s("rare", 1, 5) > s("rare", 1, 50) and s("rare", 3, 20) < 3 * s("rare", 1, 20)
    few = stored.where("term = 'common'").agg(F.sum("n"), F.count("*")).first()
    assert few[1] > 20
