"""Converters, journal, locks, merges, context, archives, manifests and streams."""

import datetime as dt
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import convert
from scriptorium.operators import catalog, chunks, context, journal, locks, merge
from scriptorium.sources import journal as journal_source
from scriptorium.sources import manifests
from scriptorium.streaming import refresh

HTML = [
    ("<h2>Hi <em>you</em></h2><p>a <b>b</b><br>c</p>", "## Hi *you*\n\na **b**  \nc\n"),
    ("<ul><li>x<li>y<ol><li>1</li></ol></ul>", "- x\n- y\n  1. 1\n"),
    ("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td><del>2</del></td></tr></table>", "| A | B |\n| --- | --- |\n| 1 | ~~2~~ |\n"),
    ("<table><tr><td colspan=2>w</td></tr><tr><td>1<td>a|b</table>", "|  |  |\n| --- | --- |\n| w |  |\n| 1 | a\\|b |\n"),
    ("<pre><code class='language-go'>a ``` b\n</code></pre>", "````go\na ``` b\n````\n"),
    ('<p>see <a href="/x">that <i>page</i></a> <img src="i.png" alt="pic"></p><script>no()</script>', "see [that *page*](/x) ![pic](i.png)\n"),
    ("<blockquote><p>q</p><p>r</p></blockquote><hr>", "> q\n>\n> r\n\n* * *\n"),
    ("", "\n"), ("<p>unclosed <b>bold", "unclosed **bold**\n"), ("a &amp; b &lt;", "a & b <\n"), ("<p>1*2_3</p>", "1\\*2\\_3\n"), ("<p><code>a`b</code></p>", "``a`b``\n"),
]


@pytest.mark.parametrize("html, want", HTML)
def test_html(html, want):
    assert convert.html_to_markdown(html) == want


def adf(*content):
    return json.dumps({"type": "doc", "content": list(content)})


def p(*content):
    return {"type": "paragraph", "content": list(content)}


def t(text, *marks):
    return {"type": "text", "text": text, "marks": [{"type": m} if isinstance(m, str) else m for m in marks]}


ADF = [
    (adf(p(t("a "), t("b", "strong"), t("c", "strong"))), "a **bc**\n"),
    (adf({"type": "heading", "attrs": {"level": 3}, "content": [t("T")]}, {"type": "rule"}), "### T\n\n---\n"),
    (adf({"type": "bulletList", "content": [{"type": "listItem", "content": [p(t("x")), {"type": "orderedList", "attrs": {"order": 3}, "content": [{"type": "listItem", "content": [p(t("y"))]}]}]}]}), "- x\n  3. y\n"),
    (adf({"type": "taskList", "content": [{"type": "taskItem", "attrs": {"state": "DONE"}, "content": [t("d")]}, {"type": "taskItem", "attrs": {"state": "TODO"}, "content": [t("e")]}]}), "- [x] d\n- [ ] e\n"),
    (adf({"type": "codeBlock", "attrs": {"language": "sh"}, "content": [t("echo ```")]}), "````sh\necho ```\n````\n"),
    (adf({"type": "table", "content": [{"type": "tableRow", "content": [{"type": "tableCell", "attrs": {"colspan": 2}, "content": [p(t("w"))]}]}, {"type": "tableRow", "content": [{"type": "tableCell", "content": [p(t("1")), p(t("2"))]}]}]}), "|  |  |\n| --- | --- |\n| w |  |\n| 1<br>2 |  |\n"),
    (adf(p({"type": "date", "attrs": {"timestamp": "1709251200000"}}, {"type": "hardBreak"}, t("l", {"type": "link", "attrs": {"href": "http://h"}}))), "2024-03-01  \n[l](http://h)\n"),
    (adf({"type": "blockquote", "content": [p(t("q"))]}, p({"type": "emoji", "attrs": {"text": "😀"}}), p(t("co`de", "code"))), "> q\n\n😀\n\n``co`de``\n"),
    (adf({"type": "mediaSingle", "content": [{"type": "media", "attrs": {"id": "1", "alt": "pic"}}, {"type": "caption", "content": [t("cap")]}]}, {"type": "extension", "attrs": {"extensionKey": "toc"}}), "[media: pic]\n\n*cap*\n\n[macro: toc]\n"),
]


@pytest.mark.parametrize("tree, want", ADF)
def test_adf(tree, want):
    assert convert.adf_to_markdown(tree) == want


def test_converters_in_sql(spark):
    convert.register(spark)
    assert spark.sql("select html_to_markdown('<p>x</p>') a, adf_to_markdown('{') b, html_to_markdown(null) c").first() == ("x\n", None, None)
    assert convert.adf_to_markdown(convert.with_page_title(adf(p(t("x"))), "Top")) == "# Top\n\nx\n"


def entry_rows(spark):
    d = lambda n: dt.datetime(2024, 1, n)
    rows = [
        ("a", "Fix Login", "open", ["auth", "bug"], d(1), d(20), None), ("b", "Docs", "done", ["docs"], d(2), d(3), d(10)), ("c", "Kept", "done", [], d(2), d(4), None),
        ("d", "Old", "open", [], d(1), d(2), None), ("e", "Late", "abandoned", ["bug"], d(5), d(20), d(28)),
    ]
    return spark.createDataFrame(rows, "id string, title string, status string, tags array<string>, created_at timestamp, updated_at timestamp, expires_at timestamp").withColumn("runtime", F.lit("human"))


def ids(df):
    return [r.id for r in df.collect()]


def test_journal(spark):
    e = entry_rows(spark)
    now = F.lit(dt.datetime(2024, 1, 21))
    assert ids(journal.list_entries(e)) == ["a", "e", "c", "b", "d"]
    assert ids(journal.list_entries(e, tags=("bug", "auth"))) == ["a"] and ids(journal.list_entries(e, only_kept=True)) == ["c"]
    assert ids(journal.list_entries(e, "done", F.lit(dt.datetime(2024, 1, 4)))) == ["c"]
    assert ids(e.where(journal.stale(now))) == ["d"]
    sizes = spark.createDataFrame([("b", 5), ("b", 7)], "id string, size long")
    assert journal.gc_report(journal.gc(e, sizes, now)).first() == (1, 12)
    notes = spark.createDataFrame([("d", "x\n<!-- login -->\n  The LOGIN page\nlogin 2\nlogin 3\nlogin 4")], "id string, notes string")
    got = {r.id: r.lines for r in journal.search(e, notes, "Login").collect()}
    assert got == {"a": [], "d": ["The LOGIN page", "login 2", "login 3"]}
    assert ids(journal.search(e, notes, "bug", 1)) == ["a"]
    assert journal.index_differs(journal.index_of(e), e).isEmpty()
    assert journal.overall(spark.createDataFrame([("pass",), ("skipped",), ("warn",)], "status string")).first() == ("warn", 3)
    more = spark.range(1).select(journal.limit_evidence(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda x: x.cast("string")))).first()[0]
    assert len(more) == 11 and more[-1] == "and 2 more"


EVENTS = [("new", 1), ("note", 2), ("done", 3), ("keep", 4), ("note", 5), ("abandoned", 6)]


def test_journal_state_and_its_stream(spark, tmp_path):
    rows = [("x", dt.datetime(2024, 1, n), e) for e, n in EVENTS] + [("y", dt.datetime(2024, 1, 2), "done"), ("z", dt.datetime(2024, 1, 2), "done"), ("z", dt.datetime(2024, 1, 3), "keep")]
    events = spark.createDataFrame(rows, "id string, at timestamp, event string")
    want = {r.id: (r.status, r.expires_at) for r in journal.state(events).collect()}
    assert want == {"x": ("abandoned", dt.datetime(2024, 1, 13)), "y": ("done", dt.datetime(2024, 2, 1)), "z": ("done", None)}
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = refresh.journal_state(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), journal.RETENTION_DAYS)
    q = stream.writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.id: (r.status, r.expires_at) for r in spark.table("states").collect()} == want


def test_upsert_stream(spark, tmp_path):
    at = tmp_path / "in"
    first = spark.createDataFrame([("a", "1", 1), ("b", "1", 1), ("a", "2", 2)], "path string, hash string, version int")
    first.coalesce(1).write.parquet(str(at))
    run = lambda: refresh.upsert(refresh.watch(spark, str(at), "path string, hash string, version int", "*.parquet"), str(tmp_path / "cp"), str(tmp_path / "out")).awaitTermination(120)
    run()
    spark.createDataFrame([("b", "3", 3), ("c", "3", 3)], first.schema).coalesce(1).write.mode("append").parquet(str(at))
    run()
    assert {(r.path, r.hash) for r in spark.read.parquet(str(tmp_path / "out/1")).collect()} == {("a", "2"), ("b", "3"), ("c", "3")}
    built = []
    refresh.refresh(refresh.watch(spark, str(at), "path string, hash string, version int", "*.parquet"), str(tmp_path / "cp2"), lambda: built.append(1)).awaitTermination(120)
    assert built == [1]


def test_journal_files(spark, tmp_path):
    for name, status in (("20240101-a-0001", "open"), ("20240102-b-0002", "done")):
        d = tmp_path / name
        d.mkdir()
        (d / "entry.json").write_text(json.dumps({"version": 1, "id": name, "title": "t", "status": status, "tags": ["x"], "created_at": "2024-01-01T00:00:00Z", "updated_at": f"2024-01-0{name[7]}T00:00:00Z", "runtime": "human", "refs": {"branch": "main"}}, indent=1))
        (d / "log.jsonl").write_text('{"at":"2024-01-01T00:00:00Z","event":"new"}\n\nbroken\n{"at":"2024-01-02T00:00:00Z","event":"note","summary":"s"}\n')
        (d / "notes.md").write_text("# t\nbody")
    bad = tmp_path / "20240103-c-0003"
    bad.mkdir()
    (bad / "entry.json").write_text("{nope")
    rows = journal_source.entries(spark, str(tmp_path)).collect()
    assert {r.folder: r.problem for r in rows} == {"20240101-a-0001": None, "20240102-b-0002": None, "20240103-c-0003": "not valid JSON"}
    assert journal_source.events(spark, str(tmp_path)).count() == 4
    shown = journal.show(journal_source.entries(spark, str(tmp_path)).where("problem is null"), journal_source.notes(spark, str(tmp_path)), journal_source.events(spark, str(tmp_path)), journal_source.files(spark, str(tmp_path)))
    r = shown.where("id = '20240102-b-0002'").first()
    assert [e.event for e in r.events] == ["new", "note"] and r.notes == "# t\nbody" and {f.path for f in r.files} == {"entry.json", "log.jsonl", "notes.md"}


def test_ci_event(spark):
    df = spark.createDataFrame([('{"comment":{"body":""},"review":{"body":"r"},"issue":{"number":3}}', None), ("", '{"comment":{"body":"c"},"pull_request":{"number":4,"title":"T"}}')], "payload string, file_payload string")
    assert [(r.body, r.number) for r in journal_source.ci_event(df).collect()] == [("r", 3), ("c", 4)]


def test_overlap_join_equals_the_predicate(spark):
    from scriptorium.functions import text

    paths = ["a", "a/b", "a/b/c", "ab", ".", "x/y"]
    left, right = spark.createDataFrame([(x,) for x in paths], "p string"), spark.createDataFrame([(x,) for x in ("a/b", ".", "q")], "q string")
    got = {tuple(r) for r in catalog.overlapping(left, "p", right, "q").collect()}
    want = {tuple(r) for r in left.crossJoin(right).where(text.paths_overlap(F.col("p"), F.col("q"))).collect()}
    assert got == want


def test_locks(spark):
    lock = manifests.lock(spark, "manifest: d\ndependencies:\n  one:\n    resolved: {sha256: ab}\n    files: {a/x: h1, b: h2, c: h3}\n")
    live = spark.createDataFrame([("a/x", "h1"), ("b", "zz")], "path string, hash string")
    assert {(r.path, r.state) for r in locks.check(lock["files"], live).collect()} == {("a/x", "ok"), ("b", "differs"), ("c", "missing")}
    m = manifests.manifest(spark, "dependencies:\n  one:\n    source: {type: http, url: 'http://x'}\n    files: [{from: f, to: b}]\n    directories: [{from: d, to: a}]\n")
    assert [r.path for r in locks.uncovered(lock["files"], m["mappings"]).collect()] == ["c"]
    assert locks.matches(m["sources"], lock["resolved"]).isEmpty()
    d = lambda rows: locks.digest(spark.createDataFrame(rows, "a string, b string")).first()[0]
    assert d([("1", "2"), ("3", "4")]) == d([("3", "4"), ("1", "2")]) != d([("1", "2")])
    plan = spark.createDataFrame([("a", None, None, "n"), ("b", "x", None, "n"), ("c", "x", "o", "n"), ("d", "o", "o", "n"), ("e", "n", "o", "n")], "path string, live string, owned string, incoming string")
    assert {(r.path, r.conflict) for r in locks.conflicts(plan).collect()} == {("b", "unowned_target"), ("c", "locally_modified")}
    kinds = spark.createDataFrame([("3", "", "", "", "", ""), ("", "a" * 40, "", "", "", ""), ("", "", "", "", "", "b" * 64), ("", "xyz", "", "", "", "")], "revision string, commit string, url string, version string, integrity string, sha256 string")
    assert [r[0] for r in kinds.select(locks.resolved_type()).collect()] == ["confluence", "git", "http", None]
    bad = spark.createDataFrame([("x", "git", "u", "", "", "", "", ""), ("y", "http", "u", "", "zz", "", "", "p")], "id string, type string, url string, ref string, sha256 string, package string, version string, page string")
    assert {(r.id, r.problem) for r in locks.source_problems(bad).collect()} == {("x", "ref is required for git"), ("y", "page does not belong to http"), ("y", "sha256 must be 64 lower-case hex digits")}
    tree = spark.createDataFrame([("d/a", 1), ("d/s/b", 2), ("e", 3)], "path string, size long")
    assert [r.target for r in locks.select_directory(tree, "d", "out").orderBy("path").collect()] == ["out/a", "out/s/b"]
    assert locks.validate_tree(tree).first().fits and not locks.validate_tree(tree, most_bytes=5).first().fits


@pytest.mark.parametrize("data", ["a: 1", "a: &x y\nb: *x", "a: x\na: y", "a: x\n---\nb: y", "- x", "a: [true]", "a: {"])
def test_strict_yaml(data):
    with pytest.raises(ValueError):
        manifests.strict_load(data)


def test_yaml_helpers():
    assert manifests.omit_empty({"a": None, "b": {"c": ""}, "d": [None, "x"]}) == {"d": ["x"]}
    assert manifests.yaml_block({"a": "```"}).startswith("````yaml\n")
    assert manifests.resolve_variables("${a} ${{ b }}", {"a": "1"}) == "1 ${{ b }}"
    with pytest.raises(ValueError):
        manifests.resolve_variables("${z}", {})
    assert manifests.parse_providers(" a, b ", ["a", "b"]) == ["a", "b"]


def zipped(names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, "x")
    return out.getvalue()


def test_archives(spark):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as a:
        link = tarfile.TarInfo("l")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        a.addfile(link)
    rows = [("ok.zip", zipped(["a", "b/c"])), ("up.zip", zipped(["../x"])), ("dup.zip", zipped(["A", "a"])), ("l.tar.gz", out.getvalue()), ("bad.tar", b"zzz")]
    got = {r.path: r.problem for r in manifests.inspect_archives(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"ok.zip": "", "up.zip": "outside: ../x", "dup.zip": "duplicate: a", "l.tar.gz": "link: l", "bad.tar": "unreadable: ReadError"}


def test_merges(spark):
    assert merge.overlay_maps({"a": {"x": 1, "y": 2}, "b": [1]}, {"a": {"y": None}, "b": [2]}) == {"a": {"x": 1, "y": None}, "b": [2]}
    got = json.loads(merge.merge_settings('{"keep": 1, "m": {"old": 1, "z": 2}}', {"m": {"new": 3}, "d": 4}, ["m.new", "m.old"], ["d", "keep"]))
    assert got == {"keep": 1, "m": {"z": 2, "new": 3}, "d": 4}
    block = lambda s, b: spark.range(1).select(merge.managed_block(F.lit(s), "# b", "# e", b)).first()[0]
    assert block("x\n", "m") == "x\n# b\nm\n# e\n" and block("x\n# b\nold\n# e\ny\n", "m\nn") == "x\n# b\nm\nn\n# e\ny\n" and block("# b\n# e\n", None) == ""
    for broken in ("# b\n", "# e\n# b\n", "# b\n# b\n# e\n"):
        with pytest.raises(Exception, match="malformed"):
            block(broken, "m")


def test_context(spark):
    big = "line of text\n" * 200
    rows = [("r", f"g{i}", 1, 1, big, ["e"]) for i in range(2)] + [("r", "x", 2, 1, big, ["a"]), ("r", "x", 4, 1, big, ["b"]), ("s", "only", 0, 1, big, [])]
    df = spark.createDataFrame(rows, "request string, path string, priority int, start_line int, content string, evidence array<string>")
    picked = context.candidates(df)
    assert picked.where("path = 'x'").first().evidence == ["a", "b"]
    got = context.assemble(picked, 2048).collect()
    guidance = sum(r.bytes for r in got if r.request == "r" and r.reason == "guidance")
    assert 0 < guidance <= 512 and sum(r.bytes for r in got if r.request == "r") <= 2048 and {r.path for r in got if r.request == "r"} == {"g0", "g1", "x"}
    assert sum(r.bytes for r in got if r.request == "s") > 1900
    small = context.bound({"items": [{"content": "y\n" * 60000, "start_line": 1}], "diagnostics": ["d"] * 10})
    assert len(json.dumps(small).encode()) <= context.MAX_RESPONSE and small["truncated"] and small["items"][0]["next_start_line"] > 1


def test_chunker_rules(spark):
    files = spark.createDataFrame([("a.md", "documentation", "md", "intro\n# A\nx\n## B\n\n \n"), ("b.yaml", "config", "yaml", "k\n" * 170), ("c.md", "documentation", "md", None)], "path string, kind string, language string, content string")
    got = [(r.chunk_id, r.title, r.start_line, r.end_line) for r in chunks.chunk_files(files).orderBy("path", "chunk_no").collect()]
    assert got == [("a.md#0", "", 1, 1), ("a.md#1", "A", 2, 3), ("a.md#2", "A > B", 4, 6), ("b.yaml#0", "", 1, 80), ("b.yaml#1", "", 81, 160), ("b.yaml#2", "", 161, 170)]


def test_source_map(spark):
    df = spark.createDataFrame([("d", "b", "3"), ("d", "a", "1\n2")], "document string, name string, text string")
    r = manifests.assemble_chunks(df).first()
    assert r.text == "1\n2\n3" and [(x.name, x.line) for x in r.source_map] == [("a", 1), ("b", 3)]
