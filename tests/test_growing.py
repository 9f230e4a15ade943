"""Files that grow, as a stream."""

import io
import json
import random

import pytest

from cmdlode.sources import growing
from cmdlode.sources.growing import GrowingReader, matching, parts_of, records
from cmdlode.sources.histories import PARSERS, Probe
from cmdlode.streaming.files import stream_history, stream_journal


def whole_records(data: bytes, mark: bytes) -> list[tuple[int, bytes]]:
    """Records of a whole file, line by line."""
    out, start, at = [], 0, 0
    for line in data.split(b"\n")[:-1]:
        at += len(line) + 1
        if mark and (line[:-1] if line.endswith(b"\r") else line).endswith(mark):
            continue
        out.append((start, data[start : at - 1]))
        start = at
    return out


@pytest.mark.parametrize("mark", [b"", b"`", b"\\\\"])
def test_records_come_once_however_ranges_are_cut(mark, monkeypatch):
    rng = random.Random(len(mark))
    for step in (1, 2, 3, 7, 1 << 20):
        monkeypatch.setattr(growing, "_STEP", step)
        for _ in range(40):
            pieces = [b"", b"a", b"bc", b"`", b"a`", b"\\\\", b"x\\\\", b"\r", b"`\r", "é".encode(), b"``"]
            data = b"".join(rng.choice(pieces) + rng.choice([b"\n", b"\n", b"\r\n", b""]) for _ in range(rng.randint(0, 30)))
            cuts = sorted({0, len(data), *(rng.randint(0, len(data)) for _ in range(rng.randint(0, 6)))})
            got = [r for a, b in zip(cuts, cuts[1:]) for r in records(io.BytesIO(data), a, b, mark)]
            assert got == whole_records(data, mark)


def test_parts_are_bounded():
    ranges = [("a", 0, 250), ("b", 5, 6), ("c", 0, 0), ("d", 100, 130)]
    parts = parts_of(ranges, most_bytes=100, most_files=2)
    assert all(sum(b - a for _, a, b in p.value) <= 100 and len(p.value) <= 2 for p in parts)
    covered = [r for p in parts for r in p.value]
    assert sum(b - a for _, a, b in covered) == 281 and [r[0] for r in covered] == ["a", "a", "a", "b", "d"]


def test_plans_survive_restarts_and_fold(tmp_path, monkeypatch):
    monkeypatch.setattr(growing, "_FOLD", 3)
    options = {"path": str(tmp_path / "in" / "scope=*" / "h*"), "progress": str(tmp_path / "plans"), "maxbytesperbatch": "40"}
    folder = tmp_path / "in" / "scope=u"
    folder.mkdir(parents=True)
    (folder / "_hidden").write_text("x\n")
    assert GrowingReader(options).latestOffset() == {"plan": 0}
    text, seen, offset = "", [], {"plan": 0}
    for i in range(12):
        text += f"line {i} of this file\n"
        (folder / "h1").write_text(text)
        if i == 5:
            (folder / "h2").write_text("other\n")
        reader = GrowingReader(options)  # as after a restart
        if i % 4 == 3:
            GrowingReader(options).latestOffset()  # a plan that was made and not used yet
        end = reader.latestOffset()
        for part in reader.partitions(offset, end):
            seen += [(r["path"].as_py()[-2:], r["line"].as_py()) for b in reader.read(part) for r in rows_of(b)]
        reader.commit(end)
        offset = end
    while (end := GrowingReader(options).latestOffset()) != offset:
        reader = GrowingReader(options)
        for part in reader.partitions(offset, end):
            seen += [(r["path"].as_py()[-2:], r["line"].as_py()) for b in reader.read(part) for r in rows_of(b)]
        offset = end
    assert sorted(seen) == sorted([("h1", f"line {i} of this file") for i in range(12)] + [("h2", "other")])
    kept = [p.name for p in (tmp_path / "plans").iterdir()]
    assert sum(n.startswith("fold") for n in kept) == 1 and len(kept) < 8
    (folder / "h2").write_text("z\n")  # shorter: read anew
    reader = GrowingReader(options)
    parts = reader.partitions(offset, reader.latestOffset())
    assert [r["line"].as_py() for p in parts for b in reader.read(p) for r in rows_of(b)] == ["z"]


def rows_of(batch):
    return [{name: batch.column(name)[i] for name in batch.schema.names} for i in range(batch.num_rows)]


def test_matching(tmp_path):
    for name in ("scope=a/bash_history", "scope=b/bash_history", "scope=b/zsh_history", "scope=b/deep/bash_history", "other/bash_history"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    names = lambda path: {p.removeprefix(str(tmp_path) + "/") for p in matching(str(path))}
    assert names(tmp_path / "scope=*" / "bash*") == {"scope=a/bash_history", "scope=b/bash_history"}
    assert names(f"file:{tmp_path}/scope=b") == {"scope=b/bash_history", "scope=b/zsh_history"}
    assert names(tmp_path / "other" / "bash_history") == {"other/bash_history"}
    assert names(tmp_path / "none" / "*") == set()


def run(rows, tmp_path):
    query = (
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_appended_lines_arrive_once_across_restarts(spark, tmp_path):
    folder = tmp_path / "in" / "scope=a%20b"
    folder.mkdir(parents=True)
    path, lines, held = folder / "2031-05.jsonl", [], b""
    rng = random.Random(3)
    for round_ in range(3):
        for i in range(20):
            lines.append({"cmd": f"make é{round_}-{i}", "exit": i % 2, "ts": "2031-05-01T09:00:00Z"})
        held = b"".join(json.dumps(x, ensure_ascii=False).encode() + b"\n" for x in lines)
        size = len(held) if round_ == 2 else len(held) - rng.randint(1, 30)  # the last line may be half written
        with open(path, "r+b" if path.exists() else "w+b") as f:
            f.seek(0, 2)
            f.write(held[f.tell() : size])
        run(stream_journal(spark, str(tmp_path / "in" / "scope=*" / "*.jsonl"), str(tmp_path / "plans"), max_bytes=700), tmp_path)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()
    assert [(r.scope, r.cmd, r.exit) for r in rows] == [("a b", x["cmd"], x["exit"]) for x in lines]


@pytest.mark.parametrize("format", sorted(PARSERS))
def test_histories_as_streams(spark, tmp_path, format):
    text = {
        "bash": "#1650000000\nmake all\n  \nrsync -a x y\n# tidy\n",
        "zsh": ": 1650000000:3;tar tf a.tar\njust words\r\n: none\n",
        "fish": "- cmd: make test\n  when: 1650000000\n  - cmd:  zig fmt . \n",
        "pwsh": "Copy-Item `\r\n  -Recurse a b\r\nGet-Date\n\na`\nb ` \nc``\n`\nd\n",
    }[format]
    place = tmp_path / "in" / "history"
    place.parent.mkdir()
    place.write_bytes(text.encode())
    probe = Probe("mine", format, str(place))
    run(stream_history(spark, probe, str(tmp_path / "plans"), max_bytes=9), tmp_path)
    got = [r.command for r in spark.read.parquet(str(tmp_path / "out")).orderBy("pos").collect()]
    lines = [("", "mine", i, line) for i, line in enumerate(text.replace("\r\n", "\n").split("\n")[:-1])]
    frame = spark.createDataFrame(lines, "scope string, source string, line_no bigint, line string")
    assert got == [r.command for r in PARSERS[format](frame).orderBy("pos").collect()] and got
