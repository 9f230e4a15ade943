import base64
import gzip
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cmdlode.operators import usage
from cmdlode.params import DEFAULTS, LIMITED
from cmdlode.sources import histories, journal, snapshots
from cmdlode.sources.lines import numbered_lines
from tests.conftest import T0, dicts
from dataclasses import replace


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def read(spark, path, format, params=DEFAULTS):
    df = histories.read_history(spark, histories.Probe(format, format, path), params)
    rows = df.orderBy("scope", "pos").collect()
    assert [r.pos for r in rows] == list(range(len(rows)))
    return [r.command for r in rows]


CASES = [
    ("bash", "#1650000000\nmake all\n   \nrsync -a x y\n# tidy up some day\n#\r\n#12x\n#\u0661\n",
     ["make all", "rsync -a x y", "# tidy up some day", "#", "#12x", "#\u0661"]),
    ("zsh", ": 1650000000:3;tar tf a.tar\njust words\r\n: 1650000009:0;cp a b; sync\n: none\n: x;\n:a;b\n\u00a0x\n",
     ["tar tf a.tar", "just words", "cp a b; sync", ":a;b", "x"]),
    ("fish", "- cmd: make test\n  when: 1650000000\n  - cmd:  zig fmt . \n- cmd: \n- cmd:x\n", ["make test", "zig fmt ."]),
    ("pwsh", "Copy-Item `\n  -Recurse a b\nGet-Date\n\na`\nb ` \nc``\n`\nd\nlast one `",
     ["Copy-Item -Recurse a b", "Get-Date", "a b `", "c`  d", "last one"]),
    ("bash", "a\rb\nc", ["a\rb", "c"]),
    ("bash", "", []),
]


@pytest.mark.parametrize("format,text,want", CASES)
def test_formats(spark, tmp_path, format, text, want):
    assert read(spark, put(tmp_path / "h", text), format) == want


@pytest.mark.parametrize("bucket", [1, 2, 3, 1000])
def test_continuations_across_buckets(spark, tmp_path, bucket):
    text = "".join(f"a{i} `\n" if i % 7 in (1, 2, 3, 5) else f"a{i}\n" for i in range(60))
    want, part = [], []
    for i in range(60):
        part.append(f"a{i}")
        if i % 7 not in (1, 2, 3, 5):
            want.append(" ".join(part))
            part = []
    want += [" ".join(part)] if part else []
    params = replace(DEFAULTS, bucket_rows=bucket, hot_key_rows=5)
    assert read(spark, put(tmp_path / "h", text), "pwsh", params) == want


def test_lines_of_split_files_keep_their_numbers(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(20_000)]
    path = put(tmp_path / "scope=a%2Bb c" / "h", "\n".join(lines))
    (tmp_path / "scope=z").mkdir()
    with gzip.open(tmp_path / "scope=z" / "h.gz", "wt") as f:
        f.write("one\ntwo\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        df = numbered_lines(spark, str(tmp_path / "scope=*" / "*"))
        assert spark.read.text(path).rdd.getNumPartitions() > 5
        rows = df.orderBy("scope", "line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    mine = [r for r in rows if r.scope != "z"]
    assert {r.scope for r in rows} == {mine[0].scope, "z"}
    assert [(r.line_no, r.line) for r in mine] == list(enumerate(lines))
    assert [(r.line_no, r.line) for r in rows if r.scope == "z"] == [(0, "one"), (1, "two")]


def test_load_histories_reports_missing_sources(spark, tmp_path):
    put(tmp_path / "scope=ann" / "bash_history", "hg pull\nhg update\n")
    put(tmp_path / "scope=bob" / "bash_history", "ls\n")
    put(tmp_path / "scope=ann" / "zsh_history", ": 1:0;make\n")
    commands, status = histories.load_histories(spark, histories.discover(str(tmp_path)))
    got = {(r.scope, r.source, r.pos, r.command) for r in commands.collect()}
    assert got == {
        ("ann", "bash", 0, "hg pull"), ("ann", "bash", 1, "hg update"), ("bob", "bash", 0, "ls"), ("ann", "zsh", 0, "make"),
    }
    rows = dicts(histories.source_status(commands, status))
    assert {(r["scope"], r["source"], r["n_lines"], r["n_commands"]) for r in rows if r["error"] is None} == {
        ("ann", "bash", 2, 2), ("bob", "bash", 1, 1), ("ann", "zsh", 1, 1)
    }
    assert {(r["scope"], r["source"]) for r in rows if r["error"]} == {(None, "fish"), (None, "pwsh")}
    totals = {(r["scope"], r["source"]): r["n_commands"] for r in dicts(usage.source_counts(commands))}
    assert totals[None, None] == 4 and totals["ann", None] == 3 and totals["bob", "bash"] == 1


def test_broken_files_are_reported_and_left_out_whole(spark, tmp_path):
    import os

    for who in ("ann", "bob", "cy {x}", "dee"):
        put(tmp_path / f"scope={who}" / "bash_history.txt", f"make {who}\nmake all\n")
    (tmp_path / "scope=eve").mkdir()
    rng = random.Random(1)
    data = gzip.compress("\n".join(f"cmd {rng.random()}" for _ in range(20_000)).encode())
    (tmp_path / "scope=eve" / "bash_history.gz").write_bytes(data[: len(data) // 2])
    probe = histories.Probe("bash", "bash", str(tmp_path / "scope=*" / "bash_history*"))
    commands, status = histories.load_histories(spark, [probe])
    assert {r.scope for r in commands.collect()} == {"ann", "bob", "cy {x}", "dee"}
    assert commands.count() == 8
    rows = {r["scope"]: r for r in dicts(histories.source_status(commands, status))}
    assert sorted(rows) == ["ann", "bob", "cy {x}", "dee", "eve"]
    assert rows["eve"]["error"] and rows["eve"]["n_commands"] == 0 and rows["eve"]["path"].endswith("bash_history.gz")
    assert all(r["error"] is None and r["n_lines"] == 2 for s, r in rows.items() if s != "eve")
    only = histories.Probe("bash", "bash", str(tmp_path / "scope=eve" / "*"))
    commands, status = histories.load_histories(spark, [only])
    assert commands.collect() == [] and status.first().error
    if os.getuid():  # root may read everything
        (tmp_path / "scope=dee" / "bash_history.txt").chmod(0)
        _, status = histories.load_histories(spark, [probe])
        assert {r.scope for r in status.collect() if r.error} == {"dee", "eve"}


LINES = [
    '{"ts":"2031-05-01T09:00:00.123456789+02:00","cmd":"zig env","exit":1,"dur_ms":40,"cwd":"/w","shell":"pwsh"}',
    "{not json}",
    '{"cmd":""}',
    '{"cmd":"x","exit":"bad"}',
    '{"exit":3}',
    '["a"]',
    '"text"',
    "",
    '{"cmd":"minimal","other":1}',
    '\t {"cmd":"after a tab"}',
]


def test_journal_read(spark, tmp_path):
    put(tmp_path / "scope=u" / "2031-05.jsonl", "\n".join(LINES) + "\n")
    put(tmp_path / "scope=u" / "2031-04.jsonl", '{"ts":"2031-04-09T04:00:00Z","cmd":"hg pull","exit":0,"dur_ms":71,"shell":"bash"}\n')
    read = journal.read_journal(spark, str(tmp_path / "scope=*" / "*.jsonl"))
    rows = read.withColumn("ts", F.col("ts").cast("string")).orderBy("seq").collect()
    assert [(r.scope, r.cmd, r.exit, r.dur_ms, r.cwd, r.shell) for r in rows] == [
        ("u", "hg pull", 0, 71, "", "bash"), ("u", "zig env", 1, 40, "/w", "pwsh"), ("u", "minimal", 0, 0, "", ""),
        ("u", "after a tab", 0, 0, "", ""),
    ]
    assert [r.ts for r in rows[1:]] == ["2031-05-01 07:00:00.123456", *["0001-01-01 00:00:00"] * 2]
    assert [r.seq for r in rows] == [0, 1, 9, 10]


def test_missing_journal_is_empty(spark, tmp_path):
    rows, status = journal.load_journal(spark, str(tmp_path / "none" / "*.jsonl"))
    assert rows.collect() == [] and [(r.scope, r.n_lines, r.error) for r in status.collect()] == [(None, 0, "PATH_NOT_FOUND")]


def test_journal_status_tells_of_broken_files(spark, tmp_path):
    put(tmp_path / "scope=u" / "2031-05.jsonl", "\n".join(LINES) + "\n")
    put(tmp_path / "scope=v" / "2031-05.jsonl", "")
    data = gzip.compress(b'{"cmd":"make"}\n' * 50_000)
    (tmp_path / "scope=w").mkdir()
    (tmp_path / "scope=w" / "2031-05.jsonl.gz").write_bytes(data[:-9])
    rows, status = journal.load_journal(spark, str(tmp_path / "scope=*" / "*.jsonl*"))
    assert {r.scope for r in rows.select("scope").collect()} == {"u"}
    found = {r.scope: r for r in status.collect()}
    assert {s: (r.n_lines, r.error is None) for s, r in found.items()} == {"u": (10, True), "w": (0, False)}  # empty files have no row


def jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_many_broken_files_take_no_more_jobs_than_one(spark, tmp_path):
    rng = random.Random(4)
    whole = gzip.compress("\n".join(f"make {rng.random()}" for _ in range(300)).encode())
    jobs = {}
    for n in (1, 25):
        root = tmp_path / str(n)
        for i in range(300):
            folder = root / f"scope=u{i}"
            folder.mkdir(parents=True)
            broken = i < n
            if i % 3 == 0:
                (folder / "bash_history.gz").write_bytes(whole[:-20] if broken else whole)
            else:
                (folder / "bash_history").write_text("make a\nmake b\n")
                if broken:  # what the store has of it does not agree with its checksum
                    put_with_wrong_sum(spark, folder / "bash_history")
        probe = histories.Probe("bash", "bash", str(root / "scope=*" / "bash_history*"))
        (commands, status), jobs[n] = jobs_of(spark, f"broken-{n}", lambda: histories.load_histories(spark, [probe]))
        bad = {r.scope for r in status.collect() if r.error}
        assert bad == {f"u{i}" for i in range(n)}
        assert {r.scope for r in commands.select("scope").distinct().collect()} == {f"u{i}" for i in range(n, 300)}
        assert commands.count() == sum(300 if i % 3 == 0 else 2 for i in range(n, 300))
    assert jobs[25] <= jobs[1]


def put_with_wrong_sum(spark, path):
    """A file beside a checksum file of other content, as the local store keeps them."""
    other = path.with_name("other")
    stream = spark._jvm.org.apache.hadoop.fs.Path(str(other)).getFileSystem(spark._jsc.hadoopConfiguration()).create(
        spark._jvm.org.apache.hadoop.fs.Path(str(other))
    )
    stream.write(bytearray(b"something else of it\n"))
    stream.close()
    other.with_name(".other.crc").rename(path.with_name(f".{path.name}.crc"))
    other.rename(path.parent.parent / f"away-{path.parent.name}")


@pytest.mark.parametrize("ending,pack", [("gz", gzip.compress), ("bz2", __import__("bz2").compress)])
def test_faults_of_compressed_files(tmp_path, ending, pack):
    from cmdlode.sources.files import fault_of

    data = pack(bytes(random.Random(1).randbytes(200_000)))
    (tmp_path / f"good x.{ending}").write_bytes(data)
    (tmp_path / f"short.{ending}").write_bytes(data[:-1000])
    (tmp_path / f"torn.{ending}").write_bytes(data[:50_000] + b"xxxx" + data[50_004:])
    (tmp_path / "x.lz4").write_bytes(b"")
    assert fault_of(f"file:{tmp_path}/good x.{ending}") is None
    assert all(fault_of(f"file://{tmp_path}/{name}.{ending}") for name in ("short", "torn", "none"))
    assert "cannot be checked" in fault_of(str(tmp_path / "x.lz4"))


def test_discover_takes_other_places(spark, tmp_path):
    put(tmp_path / "scope=u" / "shell=zsh" / "a.txt", ": 1:0;make\n")
    probes = histories.discover(str(tmp_path), landed=(("zsh", "shell=zsh/*"), ("bash", "shell=bash/*")))
    commands, status = histories.load_histories(spark, probes)
    assert [(r.scope, r.source, r.command) for r in commands.collect()] == [("u", "zsh", "make")]
    assert {(r.source, r.error is None) for r in status.collect()} == {("zsh", True), ("bash", False)}


def test_scan_summary(spark, tmp_path, journal):
    put(tmp_path / "scope=ann" / "bash_history", "hg pull\nhg update\n")
    put(tmp_path / "scope=ann" / "zsh_history", ": 1:0;make\n")
    put(tmp_path / "scope=bob" / "bash_history", "\n")
    commands, status = histories.load_histories(spark, histories.discover(str(tmp_path)))
    entries = journal((0, "make", 1, 5), (1, "make", 0, 5), scope="cy")
    shown = spark.createDataFrame([("ann", "hg"), ("ann", "make")], "scope string, tool string")
    rows = {r.scope: tuple(r)[1:] for r in usage.scan_summary(commands, status, entries, shown).collect()}
    assert rows == {"ann": (3, 2, 0, 0, 2), "bob": (0, 1, 0, 0, 0), "cy": (0, 0, 0, 2, 0), None: (0, 0, 2, 0, 0)}


def b64(text):
    return base64.b64encode(text.encode()).decode()


def test_capture_and_ingest(spark, tmp_path):
    quoted = 'robocopy "D:\\in box" out /e'
    events = [
        (0, T0, b64(quoted) + "\n", "ignored", "/plain", None),
        (1, T0, "not_base64!!!", None, "/plain", None),
        (2, T0, None, "  setx MY_SECRET abcd=efgh MY_SECRET=q1w2\n", "/plain", b64("/enc")),
        (3, T0, "", "   ", "/plain", "%%%"),
        (4, T0, None, None, None, None),
        (5, None, b64("x" * 9000), None, None, "%%%"),
        (6, T0, b64("y" * 8190 + " --token abc"), None, None, ""),
        (7, T0, "bHM", None, None, None),  # padding is missing
        (8, T0, "bHM==", None, None, None),
        (9, T0, "bH\r\nM=\n", None, None, None),
        (10, T0, "====", None, None, None),
        (11, T0, None, "z" * 70_000, None, None),
    ]
    df = spark.createDataFrame(
        events, "id int, ts timestamp, cmd_b64 string, stdin string, cwd string, cwd_b64 string"
    )
    resolved = journal.resolve_capture(df)
    bad = {r.id: r.problem for r in journal.rejected(resolved).collect()}
    assert bad == {1: "invalid payload", 4: "no command", 7: "invalid payload", 8: "invalid payload", 10: "invalid payload"}
    whole = {r.id: r for r in journal.accepted(resolved).collect()}
    assert sorted(whole) == [0, 2, 5, 6, 9, 11] and not any(r.was_cut for r in whole.values())
    assert len(whole[5].cmd) == 9000 and whole[6].cmd.endswith("«redacted»") and len(whole[11].cmd) == 70_000
    resolved = journal.resolve_capture(df, LIMITED)
    rows = {r.id: r for r in journal.accepted(resolved, LIMITED).collect()}
    assert {i for i, r in rows.items() if r.was_cut} == {5, 6, 11} and rows[9].cmd == "ls"
    assert (rows[0].cmd, rows[0].cwd, rows[0].month) == (quoted, "/plain", "2031-03")
    assert (rows[2].cmd, rows[2].cwd) == ("setx MY_SECRET abcd=efgh MY_SECRET=«redacted»", "/enc")
    assert len(rows[5].cmd) == 8192 and rows[5].ts is not None and rows[5].cwd == ""
    assert rows[6].cmd == "y" * 8190 + " -"
    target = str(tmp_path / "journal")
    journal.append_journal(journal.accepted(resolved).where("id in (0, 2, 6)"), target)
    journal.append_journal(journal.accepted(resolved).where("id = 2"), target)
    assert spark.read.parquet(target).where("month = '2031-03'").count() == 4


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "victories")
    assert snapshots.read_victories(spark, path).collect() == []
    row = ("s", "helm", 1, "helm lint", 4, 77_000, "/srv", T0)
    first = spark.createDataFrame([row], snapshots.VICTORY_SCHEMA)
    snapshots.write_snapshot(first, path)
    # A later write may read what it replaces.
    snapshots.write_snapshot(snapshots.read_victories(spark, path).withColumn("attempts", F.col("attempts") + 1), path)
    put(tmp_path / "victories" / "snapshot=7" / "part-0.parquet", "a job died here")
    for mark in (tmp_path / "victories").rglob("_SUCCESS"):  # may be switched off
        mark.rename(mark.with_name("_other"))
    assert [r.attempts for r in snapshots.read_victories(spark, path).collect()] == [5]
    snapshots.write_snapshot(first, path)
    assert [r.attempts for r in snapshots.read_victories(spark, path).collect()] == [4]
    assert (tmp_path / "victories" / "snapshot=8").exists()


@pytest.mark.parametrize("damage", ["bytes", "lost", "manifest"])
def test_damaged_snapshots_fall_back(spark, tmp_path, damage):
    path = str(tmp_path / "victories")
    row = ("s", "helm", 1, "helm lint", 4, 77_000, "/srv", T0)
    for extra in range(2):
        table = spark.createDataFrame([row[:4] + (row[4] + extra,) + row[5:]], snapshots.VICTORY_SCHEMA)
        snapshots.write_snapshot(table, path)

    def harm(number):
        manifest = tmp_path / "victories" / f"manifest={number}"
        for file in [manifest] if damage == "manifest" else (tmp_path / "victories" / f"snapshot={number}").glob("part-*"):
            if damage == "lost":
                file.rename(tmp_path / f"away-{number}-{file.name}")
            else:
                file.write_bytes(b"PAR1 nonsense")
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)

    harm(2)
    with pytest.warns(UserWarning, match="snapshot 2"):
        assert [r.attempts for r in snapshots.read_victories(spark, path).collect()] == [4]
    harm(1)
    with pytest.warns(UserWarning, match="snapshot 1"):
        assert snapshots.read_victories(spark, path).collect() == []


def test_globs_of_folders_are_listed_from_their_root(spark, tmp_path):
    """The same files as Spark's own glob, names with odd characters too; hidden, deeper and other ones are left out."""
    from cmdlode.sources import lines

    for name in ("scope=a b/x=1/part-0", "scope=a+b%/x=1/part-1", "scope=c/x=2/part-0", "scope=c/x=1/other", "scope=c/x=1/.part-0",
                 "deep/scope=c/x=1/part-0", "scope=c/x=1/y/part-0", "scope=d/x=1/_part-0"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"{name}\nsecond\n")
    (tmp_path / "scope=c/x=1/part-empty").write_text("")
    for glob in (f"{tmp_path}/scope=*/x=1/part-*", f"{tmp_path}/scope=?/x=*/part-*", f"file://{tmp_path}/scope=*/x=2/part-?", f"{tmp_path}/s*/x=1/o*"):
        assert lines._rooted(spark, glob) is not None
        listed: dict = {}
        got, status, counted = lines.counted_lines(spark, glob, listed=listed)
        want = sorted(row["value"] for row in spark.read.text(glob).collect())
        assert want and sorted(row["line"] for row in got.collect()) == want
        assert {row["n_lines"] for row in status.collect()} == {2} == {row["n"] for row in counted.collect()}
        assert len(listed) == 2  # names and texts, each listed once
    for glob in (f"{tmp_path}/.*/part-*", f"{tmp_path}/*/part-*", f"{tmp_path}/{{a,b}}/part-*", f"{tmp_path}/scope=c/part-*", str(tmp_path)):
        assert lines._rooted(spark, glob) is None
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        lines.read_lines(spark, f"{tmp_path}/scope=*/x=9/part-*")


def test_many_files_are_listed_in_groups(spark, tmp_path, monkeypatch):
    """No read lists more files than a group has; broken ones, odd names and numbers of a scope are as ever."""
    from pyspark.sql.readwriter import DataFrameReader

    from cmdlode.sources import lines

    for i in range(60):
        who = tmp_path / f"scope=u{i % 20}{' {x}' if i % 20 == 3 else ''}"
        put(who / "shell=bash" / f"part-{i // 20}", f"make {i}\nmake all\n")
        put(who / "month=1" / f"part-{i // 20}.jsonl", f'{{"cmd":"make {i}"}}\n\n')
    (tmp_path / "scope=u7/shell=bash/part-9.gz").write_bytes(gzip.compress(b"make it\n" * 5000)[:-9])
    most, load = [], DataFrameReader.load

    def spied(self, *args, **options):
        df = load(self, *args, **options)
        most.append(len(df.inputFiles()))
        return df

    monkeypatch.setattr(lines, "_GROUP_FILES", 25, raising=False)
    monkeypatch.setattr(DataFrameReader, "load", spied)
    probes = histories.discover(str(tmp_path), landed=(("bash", "shell=bash/part-*"), ("fish", "shell=fish/part-*")))
    commands, status = histories.load_histories(spark, probes)
    entries = journal.read_journal(spark, f"{tmp_path}/scope=*/month=*/part-*")
    assert most and max(most) <= 25
    names = {f"u{i}{' {x}' if i == 3 else ''}" for i in range(20)}
    got = sorted((r.scope, r.pos) for r in commands.collect())
    assert got == sorted((name, pos) for name in names for pos in range(6))
    assert sorted(r.command for r in commands.collect()) == sorted([f"make {i}" for i in range(60)] + ["make all"] * 60)
    found = dicts(status)
    assert len(found) == 62 and {(r["scope"], r["source"]) for r in found if r["error"]} == {("u7", "bash"), (None, "fish")}
    assert sorted((r.scope, r.seq, r.cmd) for r in entries.select("scope", "seq", "cmd").collect()) == sorted(
        (f"u{i % 20}{' {x}' if i % 20 == 3 else ''}", i // 20 * 2, f"make {i}") for i in range(60)
    )


def test_files_that_go_while_they_are_read_are_reported(spark, tmp_path, monkeypatch):
    from cmdlode.sources import lines

    for who in ("ann", "bob"):
        put(tmp_path / f"scope={who}" / "bash_history", "make a\nmake b\n")
    below = lines._groups

    def late(names):
        for group in below(names):
            (tmp_path / "scope=bob" / "bash_history").unlink()
            yield group

    monkeypatch.setattr(lines, "_groups", late)
    got, status = lines.read_lines(spark, f"{tmp_path}/scope=*/bash_*")
    assert sorted((r.scope, r.line_no, r.line) for r in got.collect()) == [("ann", 0, "make a"), ("ann", 1, "make b")]
    assert {(r.n_lines, r.error is None) for r in status.collect()} == {(2, True), (0, False)}


def test_stores_that_only_spark_can_open_are_listed_by_spark(spark, tmp_path, monkeypatch):
    from cmdlode.sources import lines

    put(tmp_path / "scope=ann" / "bash_history", "make a\nmake b\n")

    def closed(path):
        raise ValueError(path)

    monkeypatch.setattr(lines, "file_system", closed)
    got, status = lines.read_lines(spark, f"{tmp_path}/scope=*/bash_*")
    assert sorted((r.scope, r.line_no, r.line) for r in got.collect()) == [("ann", 0, "make a"), ("ann", 1, "make b")]
    assert [(r.n_lines, r.error) for r in status.collect()] == [(2, None)]
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        lines.read_lines(spark, f"{tmp_path}/scope=*/fish_*")


def test_files_are_written_one_a_folder(spark, tmp_path):
    from cmdlode.sources.files import file_writer

    rows = [("b=1", "x"), ("a=1/c=2", "é"), ("a=1/c=2", None), ("a=1/c=3", "z")]
    frame = spark.createDataFrame(rows, "folder string, line string").coalesce(1).sortWithinPartitions("folder")
    for _ in range(2):  # a task that runs again replaces its files
        assert frame.mapInArrow(file_writer(f"{tmp_path}/out"), "files bigint").collect()[0][0] == 3
    found = {str(p.relative_to(tmp_path / "out").parent): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found == {"b=1": "x\n", "a=1/c=2": "é\n\n", "a=1/c=3": "z\n"}
