from pyspark.sql import functions as F

from cmdlode.functions.paths import ancestors, clean_path, leaf_label, normalize_path
from cmdlode.operators import projects, sheets, suggest
from cmdlode.params import LIMITED
from cmdlode.plans.rebuild import Rebuild, back_test
from cmdlode.sources.snapshots import export_markdown, read_sheets, read_victories
from tests.conftest import T0, dicts
from tests.test_text import column

PATHS = {
    r"E:\Src\Me\Tool": "e:/src/me/tool",
    "e:/src/me/tool/": "e:/src/me/tool",
    "/mnt/e/Src/Me/Tool": "e:/src/me/tool",
    "/var/lib/tool": "/var/lib/tool",
    "/mnt/f/big": "f:/big",
    "/mnt/f": "f:",
    "/mnt/dd/x": "/mnt/dd/x",
    "/mnt/C/x": "/mnt/c/x",
    " /a/b/ ": "/a/b",
    "/": "",
}


def test_paths(spark):
    assert column(spark, list(PATHS), normalize_path) == list(PATHS.values())
    raw = ["/a//b/./c/../d/", "/", "/../../a", "a/../..", "./x", "a/..", "/a/b", "C:\\x\\", "/.", "//"]
    want = ["/a/b/d", "/", "/a", "..", "x", ".", "/a/b", "C:\\x\\", "/", "/"]
    assert column(spark, raw, clean_path) == want
    raw = ["/w/api", "/w/Api/", "C:\\x\\Proj", "C:\\", "/", ".", ""]
    assert column(spark, raw, leaf_label) == ["api", "Api", "Proj", "", "", "", ""]
    up = column(spark, ["/a/b/c", "x"], lambda c: F.array_join(ancestors(c, 3), "|"))
    assert up == ["/a/b/c|/a/b|/a", "x"]


ROOTS = [("s", "/w/api"), ("s", "/w"), ("s", r"C:\Code\App"), ("t", "/w/api/deep"), ("s", "/w/api/")]
DIRS = [
    ("s", "/w/api/src/x", "/w/api", "api"),
    ("s", "/w/other", "/w", "w"),
    ("s", "/mnt/c/code/app/lib", "c:/code/app", "App"),
    ("s", "/else/where/", "/else/where", "where"),
    ("s", "", None, ""),
    ("t", "/w/api/src", "/w/api/src", "src"),
    ("s", "/wide", "/wide", "wide"),
]


def test_roots(spark):
    df = spark.createDataFrame([d[:2] for d in DIRS], "scope string, cwd string")
    roots = spark.createDataFrame(ROOTS, "scope string, root string")
    got = {(r.scope, r.cwd): (r.project_key, r.label) for r in projects.with_project(df, roots).collect()}
    assert got == {(d[0], d[1]): (d[2], d[3]) for d in DIRS}
    by_depth = projects._with_root_by_depth(df, roots, "cwd", __import__("cmdlode").DEFAULTS)
    listed = {(r.scope, r.cwd): r._root for r in by_depth.collect()}
    assert {k: v is not None for k, v in listed.items()} == {
        (d[0], d[1]): d[2] in ("/w/api", "/w", "c:/code/app") for d in DIRS
    }
    keyed = projects._keyed_roots(roots)
    by_map = projects._with_root_by_map(df, keyed, "cwd", __import__("cmdlode").DEFAULTS)
    assert {(r.scope, r.cwd): r._root for r in by_map.collect()} == listed


def test_one_join_for_roots_of_any_depth(spark, tmp_path):
    """A stream meets the roots in one join, whatever their depths."""
    roots = spark.createDataFrame([("s", "/a" + "/b" * n) for n in range(9)], "scope string, root string")
    spark.createDataFrame([("s", "/a/b/b/c")], "scope string, cwd string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("scope string, cwd string").parquet(str(tmp_path / "in"))
    placed = projects.with_project(stream, roots)
    plan = placed._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join LeftOuter") == 1
    query = placed.writeStream.format("memory").queryName("placed").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.project_key, r.label) for r in spark.table("placed").collect()] == [("/a/b/b", "b")]
    many = __import__("dataclasses").replace(__import__("cmdlode").DEFAULTS, max_scope_roots=3)
    assert projects.with_project(stream, roots, params=many)._jdf.queryExecution().analyzed().toString().count("Join LeftOuter") == 9


def test_ancestor_limit(spark):
    deep = "/r" + "/d" * 70
    df = spark.createDataFrame([("s", deep), ("s", "/r/d")], "scope string, cwd string")
    roots = spark.createDataFrame([("s", "/r")], "scope string, root string")
    got = {r.cwd: r.project_key for r in projects.with_project(df, roots, params=LIMITED).collect()}
    assert got == {deep: deep, "/r/d": "/r"}
    whole = {r.cwd: r.project_key for r in projects.with_project(df, roots).collect()}
    assert whole == {deep: "/r", "/r/d": "/r"}


VICTORY = "scope string, tool string, rank int, cmd string, attempts bigint, cost_ms bigint, cwd string, ts timestamp"


def advise(spark, won, failed):
    """won: (tool, cmd, attempts, cwd); failed: (tool, cmd, cwd)."""
    table = spark.createDataFrame(
        [("s", t, i + 1, c, a, 1000 * a, d, T0) for i, (t, c, a, d) in enumerate(won)], VICTORY
    )
    fails = spark.createDataFrame([("s", *f) for f in failed], "scope string, tool string, cmd string, cwd string")
    done = suggest.suggest(projects.with_project(fails), suggest.victories_by_tool(table))
    return [(r.cmd, r.suggested, r.attempts) for r in done.collect()]


def test_suggestions(spark):
    won = [("helm", "helm lint --strict web", 7, "/far"), ("helm", "helm template web", 3, "/w/here")]
    assert advise(spark, won, [("helm", "helm test web", "/w/here/")]) == [("helm test web", "helm template web", 3)]
    assert advise(spark, won, [("helm", "helm test web", "")])[0][2] == 7
    won = [("hg", "hg in", 2, "/a"), ("hg", "hg out", 9, "/b"), ("hg", "hg log", 9, "")]
    assert advise(spark, won, [("hg", "hg push", "/else")]) == [("hg push", "hg out", 9)]
    assert advise(spark, [("zig", "zig test x", 4, "")], [("zig", "zig test x", "")]) == []
    assert advise(spark, [("hg", "hg up", 2, "")], [("zig", "zig up", ""), ("", "x", "")]) == []


def test_back_test_and_victories(spark, history, journal):
    entries = [(0, "make x", 1, 1), (1, "make x", 0, 1), (30, "make y", 2, 1), (31, "ls", 1, 1)]
    done = Rebuild(history("tar -xf a.tgz", "tar -xzf a.tgz"), journal(*entries))
    assert [(r.tool, r.cmd, r.rank) for r in done.victories.collect()] == [("make", "make x", 1)]
    got = [(r.cmd, r.suggested) for r in back_test(done.journal, done.victories).collect()]
    assert got == [("make y", "make x")]


def test_sheets_keep_notes(spark, tmp_path, history, journal):
    place, store = str(tmp_path / "sheets"), str(tmp_path / "victories")
    commands = history(*["docker ps -a"] * 3, "docker run a", "docker run ab", "docker --help", "CON: x", "CON: x", "CON: x")
    done = Rebuild(commands, journal((0, "docker build .", 1, 1, "bash", "/w/Api"), (1, "docker build .", 0, 1, "bash", "/w/Api")))
    done.write(store, place, "2031-03-06")
    assert [r.cmd for r in read_victories(spark, store).collect()] == ["docker build ."]
    first = read_sheets(spark, place).collect()
    assert [r.tool for r in first] == ["docker"]
    assert first[0].markdown.split("\n") == [
        "# docker — personal cheatsheet", "",
        "> Generated by cmdlode on 2031-03-06 from your own shell history.",
        "> Rescans rewrite everything above the keep-marker; your notes below it stay.", "",
        "## Hard-won (you fought for these)", "",
        "- `docker build .`  — took 2 attempts (1m of fighting, certified) · in Api",
        "- `docker run ab`  — took 2 attempts", "",
        "## Greatest hits", "", "- `docker ps -a`  — ×3", "",
        "## Help lookups", "",
        "You reached for help on `docker` 1 time(s). The commands above are the ones that stuck.", "",
        "<!-- cmdlode:keep -->", "## Your notes", "",
        "Anything below the keep-marker survives rescans. Make it yours.", "",
    ]
    noted = read_sheets(spark, place).withColumn("markdown", F.concat("markdown", F.lit("\nMY NOTE\n")))
    again = done.sheets(noted.unionByName(noted.withColumn("tool", F.lit("old"))), "2031-03-07").collect()
    text = {r.tool: r.markdown for r in again}
    assert "MY NOTE" in text["docker"] and "2031-03-07" in text["docker"] and "2031-03-06" not in text["docker"]
    assert text["docker"].count(sheets.keep_marker()) == 1
    assert "2031-03-06" in text["old"]
    stored = read_sheets(spark, place)
    assert sheets.find_sheet(stored, "Docker").count() == 1
    assert sheets.find_sheet(stored, "../docker").count() == 0
    assert [(r["tool"], str(r["generated_on"])) for r in dicts(sheets.list_sheets(stored))] == [("docker", "2031-03-06")]
    export_markdown(stored, str(tmp_path / "md"))
    files = list((tmp_path / "md").rglob("part-*.txt"))
    assert [f.read_text() for f in files] == [first[0].markdown]


def test_safe_names(spark):
    from cmdlode.functions.text import is_safe_tool

    bad = ["", "..", "a/b", "a\\b", "CON:", "-flag", "#", "a\n"]
    assert column(spark, bad, is_safe_tool) == [False] * len(bad)
    assert column(spark, ["g++", "Git", "7z"], is_safe_tool) == [True] * 3
