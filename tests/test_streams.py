import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from cmdlode.operators.cooldown import apply_cooldown
from cmdlode.operators.fights import fights, journal_usage
from cmdlode.operators.usage import classify_commands, command_counts
from cmdlode.sources.snapshots import VICTORY_SCHEMA, read_victories, write_snapshot
from cmdlode.streaming import operators as streams
from cmdlode.streaming import sinks, state
from cmdlode.streaming.replay import replay
from tests.conftest import JOURNAL, T0


def random_log(spark, n=400):
    rng, rows, at = random.Random(11), [], 0.0
    for seq in range(n):
        at += rng.choice([5, 60, 300, 899, 901])
        cmd = rng.choice(["git push a", "git push ab", "git pull x y", "make all", "sudo make al", "ls"])
        rows.append(("s", seq, T0 + timedelta(seconds=at), cmd, int(rng.random() < 0.6), 10, "/p", rng.choice(["bash", "zsh"])))
    return rows, spark.createDataFrame(rows, JOURNAL)


def fight_rows(df):
    return sorted((r.tool, r.shell, r.seq, r.command, r.attempts, r.cost_ms) for r in df.collect())


def test_fights_replayed_in_slices(spark):
    _, log = random_log(spark)
    want = fight_rows(fights(journal_usage(log)))
    assert len(want) > 10
    assert fight_rows(replay(log, streams.stream_fights, rows_per_slice=150)) == want


def test_running_counts_do_not_depend_on_slices(spark):
    _, log = random_log(spark, 200)
    commands = lambda rows: rows.select("scope", F.col("shell").alias("source"), F.col("seq").alias("pos"), F.col("cmd").alias("command"))
    want = sorted(map(str, command_counts(classify_commands(commands(log))).collect()))
    for mode, size in (("update", 1000), ("update", 60), ("complete", 60)):
        got = replay(log, lambda rows: streams.running_counts(commands(rows)), mode, size, streams.COUNT_KEYS)
        assert sorted(map(str, got.collect())) == want, (mode, size)
    with pytest.raises(ValueError, match="keys"):
        replay(log, streams.running_counts, "update")


def run_out_of_order(spark, tmp_path, rows, transform, jitter):
    """Feed rows in batches whose order is shuffled by up to ``jitter`` rows, then move time on."""
    rng = random.Random(5)
    shuffled = [r for _, r in sorted(enumerate(rows), key=lambda p: p[0] + rng.random() * jitter)]
    end = max(r[2] for r in rows) + timedelta(days=2)
    batches = [shuffled[i : i + 90] for i in range(0, len(shuffled), 90)]
    batches += [[("clock", 0, end, "make all", 1, 1, "", "bash")]]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in batches:
        spark.createDataFrame(batch, JOURNAL).coalesce(1).write.mode("append").parquet(source)
        stream = transform(spark.readStream.schema(JOURNAL).parquet(source))
        query = (
            stream.writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).where("scope <> 'clock'")


def test_late_rows_within_the_watermark_do_not_change_fights(spark, tmp_path):
    rows, log = random_log(spark, 200)
    want = fight_rows(fights(journal_usage(log)))
    got = run_out_of_order(spark, tmp_path, rows, lambda s: streams.stream_fights(s, "4 hours"), jitter=20)
    assert fight_rows(got) == want


def test_cooldown_with_a_watermark(spark, tmp_path):
    rows, log = random_log(spark, 160)

    def suggested(journal):
        if journal.isStreaming:
            journal = journal.withWatermark("ts", "4 hours")
        plain = journal_usage(journal).where("exit <> 0")
        return plain.withColumn("won_at", F.col("ts"))

    want = sorted((r.tool, r.seq) for r in apply_cooldown(suggested(log), ["scope", "tool"]).collect())
    got = run_out_of_order(spark, tmp_path, rows, lambda s: streams.stream_cooldown(suggested(s), ordered=True), jitter=15)
    assert sorted((r.tool, r.seq) for r in got.collect()) == want


def test_bounded_distance():
    rng = random.Random(4)

    def distance(a, b):  # by its recursive definition, for short texts
        if not a or not b:
            return len(a) + len(b)
        if a[0] == b[0]:
            return distance(a[1:], b[1:])
        return 1 + min(distance(a[1:], b), distance(a, b[1:]), distance(a[1:], b[1:]))

    for _ in range(400):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(7))) for _ in range(2))
        assert [state._within(a, b, n) for n in range(8)] == [distance(a, b) <= n for n in range(8)], (a, b)
    assert not state._within("x" * 200_000, "y" * 199_999, 50)


def feed(spark, tmp_path, batches, schema, writer):
    """Run ``writer(stream)`` over one batch after the other."""
    source = str(tmp_path / "source")
    for batch in batches:
        if callable(batch):
            batch()
            continue
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        query = writer(spark.readStream.schema(schema).parquet(source)).trigger(availableNow=True).start()
        query.awaitTermination()


def entry(seq, minutes, cmd="make x", exit=1):
    return ("s", seq, T0 + timedelta(minutes=minutes), cmd, exit, 1, "", "bash")


def test_late_rows_are_kept(spark, tmp_path):
    batches = [[entry(0, 0), entry(1, 60)], [entry(2, 51), entry(3, 49), entry(4, 200)], [entry(5, 195), entry(6, 1)]]
    out = str(tmp_path / "out")
    feed(spark, tmp_path, batches, JOURNAL, lambda s: sinks.split_late(s, "10 minutes", out, str(tmp_path / "cp")))
    rows = spark.read.parquet(out).select("seq", "late").collect()
    assert sorted(r.seq for r in rows if r.late == "true") == [3, 6]
    assert sorted(r.seq for r in rows if r.late == "false") == [0, 1, 2, 4, 5]
    assert len([p for p in (tmp_path / "out" / "_clock").iterdir() if p.suffix == ".json"]) == 2


def test_timely_rows_lose_nothing_under_the_watermark(spark, tmp_path):
    """Late rows beside, the others through the sliced fights: together what the log has."""
    rows, _ = random_log(spark, 200)
    rng = random.Random(2)
    shuffled = [r for _, r in sorted(enumerate(rows), key=lambda p: p[0] + rng.random() * 60)]
    split = str(tmp_path / "split")
    batches = [shuffled[i : i + 40] for i in range(0, 200, 40)]
    feed(spark, tmp_path, batches, JOURNAL, lambda s: sinks.split_late(s, "1 hour", split, str(tmp_path / "cp")))
    timely = spark.read.schema(JOURNAL).parquet(f"{split}/late=false")
    late = spark.read.parquet(f"{split}/late=true").count()
    assert late > 5 and timely.count() + late == 200
    want = fight_rows(fights(journal_usage(timely)))
    end = spark.createDataFrame([("clock", 0, max(r[2] for r in rows) + timedelta(days=2), "make all", 1, 1, "", "bash")], JOURNAL)
    end.withColumn("batch", F.lit(99)).write.parquet(f"{split}/late=false/load=99")
    stream = streams.stream_fights(sinks.timely_rows(spark, split, JOURNAL), "1 hour")
    out = str(tmp_path / "fights")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp2")).trigger(
        availableNow=True
    ).start().awaitTermination()
    assert fight_rows(spark.read.schema(stream.schema).parquet(out).where("scope <> 'clock'")) == want


def test_one_hot_key_in_one_batch(spark, tmp_path):
    """A busy key: its slices are summed up apart and joined, with runs over many slices and gaps."""
    rng, rows, at = random.Random(8), [], 0.0
    for seq in range(4000):
        at += rng.choice([0.001, 1, 5, 40, 40, 200, 905])
        cmd = rng.choice(["git push a", "git push ab", "git push ab"] if seq % 300 < 200 else ["git pull x y", "git push a"])
        rows.append(("s", seq, T0 + timedelta(seconds=at), cmd, int(rng.random() < 0.8), 10, "/p", "bash"))
    want = fight_rows(fights(journal_usage(spark.createDataFrame(rows, JOURNAL))))
    assert len(want) > 200 and max(w[4] for w in want) > 10
    rows.append(("clock", 0, rows[-1][2] + timedelta(days=2), "make all", 1, 1, "", "bash"))
    got = replay(spark.createDataFrame(rows, JOURNAL), lambda s: streams.stream_fights(s, "10 minutes"))
    assert fight_rows(got.where("scope <> 'clock'")) == want


def test_slices_are_summed_like_the_whole():
    """Summing up slices and joining them, without Spark, against one pass over all rows."""
    from collections import namedtuple

    Row = namedtuple("Row", "scope tool shell seq cmd exit dur_ms cwd micros")
    rng = random.Random(3)
    for width in (1, 7, 50, 10_000):
        slices = state.FightSlices(Row._fields, "", width, 20, 3, 0.5)
        rows, at = [], 0
        for seq in range(300):
            at += rng.choice([0, 1, 3, 19, 20, 21])
            rows.append(Row("s", "git", "bash", seq, rng.choice(["git push a", "git pull x y"]), int(rng.random() < 0.7), 5, "/p", at))
        single = state.FightProcessor(Row._fields, 20, 3, 0.5)
        whole, kept = [], None
        for row in rows:
            kept, made = single.step(kept, row)
            whole += [made] if made else []
        found, edges = [], []
        for number in sorted({r.micros // width for r in rows}):
            part = slices.summary(("s", "git", "bash", number), [r for r in rows if r.micros // width == number], None)
            made = list(part.itertuples(index=False)) if len(part) else []
            assert sum(not r.whole for r in made) <= 2
            found += [state._fight(r, r.n, r.first, r.micros) for r in made if r.whole]
            edges += [r for r in made if not r.whole]
        joiner = state.FightJoiner(20, 3, 0.5)
        found += join_edges(joiner, edges)
        assert sorted(found, key=lambda f: f["seq"]) == whole


def join_edges(joiner, edges):
    """The joiner over rows in one call, with a state held here."""
    import pandas as pd

    class Held:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

        def registerTimer(self, at):
            pass

    joiner.state, joiner.handle = Held(), Held()
    out = []
    for i in range(0, len(edges), 9):
        for frame in joiner.handleInputRows(None, [pd.DataFrame(edges[i : i + 9])], None):
            out += frame.to_dict("records")
    return out


def test_merged_counts_survive_repeats_and_restarts(spark, tmp_path):
    """Totals by key after every batch, one of which is run twice; untouched buckets are not written again."""
    rng = random.Random(6)
    table, schema = str(tmp_path / "table"), "k string, n bigint"
    keys = [None, "", "a b", *(f"key{i}" for i in range(60))]
    held, total = {}, sinks.merge_by_key
    assert sinks.read_merged(spark, table) is None
    batches = []
    for _ in range(5):
        changed = {k: rng.randrange(100) for k in rng.sample(keys, 6)}
        batches.append(list(changed.items()))
    captured = []

    def writer(stream):
        made = total(stream, ["k"], table, str(tmp_path / "cp"), 16)
        return made

    for number, batch in enumerate(batches):
        feed(spark, tmp_path, [batch], schema, writer)
        held |= dict(batch)
        assert {r.k: r.n for r in sinks.read_merged(spark, table).collect()} == held
        folder = tmp_path / "table" / "data" / f"batch={number}"
        captured.append(len(list(folder.glob("_bucket=*"))))
    assert all(n <= 6 for n in captured)
    assert len(list((tmp_path / "table" / "_notes").glob("batch-*.json"))) == 2

    class Again:  # the last batch once more, as after a failure behind its writing
        def option(self, *_):
            return self

        def foreachBatch(self, write):
            write(spark.createDataFrame(batches[-1], schema), len(batches) - 1)
            return self

        def outputMode(self, _):
            return self

    class Stream:
        writeStream = Again()

    total(Stream(), ["k"], table, "", 16)
    assert {r.k: r.n for r in sinks.read_merged(spark, table).collect()} == held


def test_an_unchanged_snapshot_is_not_scanned_again(spark, tmp_path, monkeypatch):
    won, out = str(tmp_path / "won"), str(tmp_path / "out")
    write_snapshot(spark.createDataFrame([("s", "make", 1, "make -j all", 3, 1000, "", T0)], VICTORY_SCHEMA), won)
    reads = []
    monkeypatch.setattr(sinks, "read_victories", lambda *args: reads.append(args) or read_victories(*args))
    source = str(tmp_path / "source")
    for i in range(3):
        spark.createDataFrame([entry(i, i)], JOURNAL).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(JOURNAL).option("maxFilesPerTrigger", 1).parquet(source)
    sinks.fresh_suggestions(stream, won, out, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.seq for r in spark.read.parquet(out).collect()) == [0, 1, 2] and len(reads) == 1


def test_rows_without_a_time_get_that_of_their_batch(spark, tmp_path):
    schema = "id int, ts timestamp, cmd_b64 string, stdin string, cwd string, cwd_b64 string"
    out = str(tmp_path / "out")
    feed(spark, tmp_path, [[(0, None, None, "make a", None, None), (1, None, None, "make b", None, None)]], schema,
         lambda s: sinks.ingest_by_month(s, out, str(tmp_path / "cp")))
    rows = spark.read.parquet(f"{out}/journal").collect()
    assert len({r.ts for r in rows}) == 1 and rows[0].ts is not None


def test_new_victories_are_seen_in_mid_stream(spark, tmp_path):
    won, out = str(tmp_path / "won"), str(tmp_path / "out")

    def rebuild(cmd):
        row = ("s", "make", 1, cmd, 3, 1000, "", T0)
        return lambda: write_snapshot(spark.createDataFrame([row], VICTORY_SCHEMA), won)

    batches = [[entry(0, 0)], rebuild("make -j all"), [entry(1, 1)], rebuild("make -k all"), [entry(2, 2)]]
    feed(spark, tmp_path, batches, JOURNAL, lambda s: sinks.fresh_suggestions(s, won, out, str(tmp_path / "cp")))
    got = {r.seq: r.suggested for r in spark.read.parquet(out).collect()}
    assert got == {1: "make -j all", 2: "make -k all"}


def test_ingest_by_month_and_quarantine(spark, tmp_path):
    schema = "id int, ts timestamp, cmd_b64 string, stdin string, cwd string, cwd_b64 string"
    batches = [[(0, T0, None, "make a", None, None), (1, T0, "%", None, None, None)],
               [(2, T0 + timedelta(days=40), None, " make b ", None, None), (3, T0, None, None, None, None)]]
    out = str(tmp_path / "out")
    feed(spark, tmp_path, batches, schema, lambda s: sinks.ingest_by_month(s, out, str(tmp_path / "cp")))
    rows = spark.read.parquet(f"{out}/journal").select("id", "cmd", F.col("month").cast("string")).collect()
    assert sorted((r[0], r[1], r[2][:7]) for r in rows) == [(0, "make a", "2031-03"), (2, "make b", "2031-04")]
    bad = spark.read.parquet(f"{out}/rejected").collect()
    assert sorted((r.id, r.problem) for r in bad) == [(1, "invalid payload"), (3, "no command")]


def test_slices_of_many_keys_are_summed_in_one_call():
    """A Python state for each slice of each key took milliseconds; frames hold many whole slices."""
    import pandas as pd

    columns = ["scope", "tool", "shell", "seq", "cmd", "exit", "dur_ms", "cwd", "micros"]
    failed = {"seq": 0, "cmd": "git push a", "exit": 1, "dur_ms": 5, "cwd": "/p", "micros": 70}
    won = failed | {"seq": 1, "exit": 0, "micros": 80}
    frame = pd.DataFrame({"scope": ["a", "b"], "tool": "git", "shell": "bash", "rows": [[failed, won], [failed]]})
    slices = state.FightSlices(columns, ["scope", "tool", "shell"], 60, 20, 3, 0.5)
    made = pd.concat(slices(iter([frame, frame.head(0)])))
    assert made[["scope", "slice", "n", "exit", "seq"]].values.tolist() == [["a", 1, 2, 0, 1], ["b", 1, 1, 1, 0]]


def test_arrival_order_takes_plain_rows(spark):
    """Rows of a key come in one batch in any order; null values stay what they are."""
    rows = [("u", i, T0 + timedelta(minutes=40 * i), f"git push {i}", 1, None, "", "bash") for i in (3, 0, 2, 1)]
    seen = replay(spark.createDataFrame(rows, JOURNAL), lambda s: streams.stream_cooldown(s.withColumn("tool", F.lit("git")).withColumn("won_at", F.col("ts"))))
    assert sorted((r.seq, r.dur_ms) for r in seen.collect()) == [(0, None), (2, None)]


def test_rows_without_time_come_last_in_arrival_order(spark):
    """A row without a time passes the cooldown and stops no other of its batch, as numbers that are missing do."""
    rows = [("u", 0, None, "git push 0", 1, 5, "", "bash"), ("u", 1, T0, "git push 1", 1, None, "", "bash"), ("u", 2, T0, "git push 2", 1, 1, "", "bash")]
    tag = lambda s: s.withColumn("tool", F.lit("git")).withColumn("won_at", F.col("ts"))
    seen = replay(spark.createDataFrame(rows, JOURNAL), lambda s: streams.stream_cooldown(tag(s))).collect()
    assert sorted((r.seq, r.ts_us is None, r.dur_ms) for r in seen) == [(0, True, 5), (1, False, None)]
    fought = [("u", 0, T0, "git push a", 1, 5, "", "bash"), ("u", 1, T0 + timedelta(seconds=9), "git push a", 0, None, "", "bash"), ("u", 2, None, "git push a", 1, 5, "", "bash")]
    assert fight_rows(replay(spark.createDataFrame(fought, JOURNAL), streams.stream_fights)) == [("git", "bash", 1, "git push a", 2, 0)]
