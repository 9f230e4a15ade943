import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cmdlode.operators import fights as fight_ops
from cmdlode.operators import reports, retries, usage
from cmdlode.operators.sequence import dense_positions
from cmdlode.params import DEFAULTS
from cmdlode.plans.rebuild import Rebuild, project_listing
from tests import naive
from tests.conftest import JOURNAL, T0, dicts


def job(history, journal, *commands, entries=(), params=DEFAULTS):
    return Rebuild(history(*commands), journal(*entries), None, params)


def report(job, tool):
    rows = dicts(job.reports.where(F.col("tool") == tool))
    assert len(rows) == 1, rows
    return rows[0]


TYPO = ("terraform aply -auto", "terraform apply -auto", "terraform apply -no-color -auto")


def test_each_attempt_extends_a_chain(history, journal):
    r = report(job(history, journal, *TYPO), "terraform")
    assert [(h["command"], h["attempts"], h["certified"]) for h in r["hard_won"]] == [(TYPO[2], 3, False)]


def test_a_command_never_retries_itself(history, journal):
    r = report(job(history, journal, "rsync -a s d", "clear", "rsync  -a s d", "pwd", "rsync -a s d", "rsync -a s  d"), "rsync")
    assert [(h["command"], h["count"]) for h in r["hits"]] == [("rsync -a s d", 4)]
    assert r["hard_won"] == []


def test_looking_things_up_is_no_use(history, journal):
    done = job(history, journal, "man jq", "jq . in.json", "jq --help", "jq -?", "man cat", "tldr awk")
    r = report(done, "jq")
    assert (r["help_lookups"], r["total"]) == (3, 1)
    rows = {d["tool"]: (d["total"], d["help_lookups"]) for d in dicts(done.reports)}
    assert rows == {"jq": (1, 3), "awk": (0, 1)}
    assert [d["tool"] for d in dicts(usage.help_only_tools(done.counts))] == ["awk"]
    separate = {(d["tool"], d["help_lookups"]) for d in dicts(usage.help_lookups(done.classified))}
    assert separate == {("jq", 3), ("awk", 1)}


def test_what_is_counted_behind_wrappers(history, journal):
    done = job(history, journal, "echo hi", *["nohup time zig test"] * 2, *["LANG=C LC_ALL=C sort x"] * 4, "df /?", "df -k")
    assert {d["tool"]: d["total"] for d in dicts(done.reports)} == {"zig": 2, "sort": 4, "df": 1}


def test_chains_stay_within_intent_and_source(history, journal):
    assert dicts(job(history, journal, "podman volume prune", "podman system df -v").heuristic) == []
    mixed = [("fish", "pandoc a.md -o a.pdf"), ("bash", "pandoc a.md -o a.pfd")]
    assert dicts(job(history, journal, *mixed).heuristic) == []


def test_chain_window(history, journal):
    near = ["gcc -o a a.c", "pwd", "pwd", "gcc -O2 -o a a.c"]
    assert len(dicts(job(history, journal, *near).heuristic)) == 1
    assert dicts(job(history, journal, near[0], "pwd", *near[1:]).heuristic) == []


def test_hits_that_redact_alike_stay_apart_and_ranks_cut_at_eight(history, journal):
    commands = ["x --token a"] * 3 + ["x --token b"] * 4 + [c for n in range(9) for c in [f"x run{n:02d} job"] * 5]
    hits = [(h["command"], h["count"]) for h in report(job(history, journal, *commands), "x")["hits"]]
    assert hits == [(f"x run{n:02d} job", 5) for n in range(8)]
    few = report(job(history, journal, *commands[:7]), "x")["hits"]
    assert [(h["command"], h["count"]) for h in few] == [("x --token «redacted»", 4), ("x --token «redacted»", 3)]


def test_cost_runs_from_first_failure_to_end_of_success(history, journal):
    entries = [(0, "helm upgrade web ./chrt", 3, 400), (2, "helm upgrade web ./chart", 0, 1500)]
    r = report(job(history, journal, entries=entries), "helm")
    won = r["hard_won"][0]
    assert (won["attempts"], won["certified"], won["cost_ms"], won["cwd"]) == (2, True, 121_500, "/srv/app")
    assert r["total"] == 2


def test_the_same_command_may_fail_again(history, journal):
    entries = [(0, "pytest -x", 1, 100), (3, "pytest -x", 1, 200), (4, "pytest -x", 0, 2500)]
    won = report(job(history, journal, entries=entries), "pytest")["hard_won"]
    assert [(h["attempts"], h["cost_ms"]) for h in won] == [(3, 242_500)]


@pytest.mark.parametrize(
    "entries,n",
    [
        ([(0, "zig fetch one", 1, 30), (1, "zig std", 0, 10)], 0),
        ([(0, "zig build", 2, 70), (16, "zig build", 0, 60)], 0),
        ([(0, "zig build", 2, 70), (15, "zig build", 0, 60)], 1),
        ([(0, "zig build", 2, 70), (15 + 1 / 60, "zig build", 0, 60)], 0),
        ([(0, "zig build", 1, 1, "zsh"), (1, "zig build", 0, 1, "bash")], 0),
        ([(5, "zig build", 1, 1), (0, "zig build", 0, 1)], 1),
    ],
)
def test_what_closes_a_fight(history, journal, entries, n):
    done = job(history, journal, entries=entries)
    assert done.fights.count() == n
    assert {d["tool"] for d in dicts(done.reports)} == ({"zig"} if n else set())


def test_measured_and_guessed_evidence_meet(history, journal):
    done = job(history, journal, *TYPO, entries=[(0, TYPO[1], 1, 10), (2, TYPO[2], 0, 250)])
    r = report(done, "terraform")
    assert [(h["attempts"], h["certified"], h["cost_ms"]) for h in r["hard_won"]] == [(3, True, 120_250)]
    assert r["total"] == 3


def test_rollup_takes_place_of_the_last_shell(history, journal):
    entries = [
        (0, "make x", 0, 1, "zsh"),
        (1, "make x", 1, 0, "bash", "/b"), (2, "make x", 0, 5, "bash", "/b"),
        (3, "make x", 1, 0, "zsh", "/z"), (4, "make x", 1, 0, "zsh", "/z"), (5, "make x", 0, 7, "zsh", "/z"),
    ]
    got = dicts(job(history, journal, entries=entries).fight_rollup)
    assert [(g["attempts"], g["cost_ms"], g["cwd"]) for g in got] == [(3, 60_005 + 120_007, "/b")]


def test_journal_redacts_after_normalising(journal):
    used = fight_ops.journal_usage(journal((0, "x  --token   abc", 1, 1), (1, "  ", 0, 1)))
    assert [r.cmd for r in used.collect()] == ["x --token «redacted»"]


def test_order_of_biggest_fights_and_first_tool(history, journal):
    entries = [(m, "make x", int(m < 3), 1) for m in range(4)] + [(9, "go b", 1, 1), (10, "go b", 0, 1)]
    done = job(history, journal, "gcc -o a a.c", "gcc -O2 -o a a.c", *["z status now"] * 3, entries=entries)
    top = dicts(done.biggest_fights.orderBy("rank"))
    assert [(t["tool"], t["attempts"]) for t in top] == [("make", 4), ("gcc", 2), ("go", 2)]
    whole = dicts(reports.biggest_fights(done.reports, per_scope=False))
    assert [t["tool"] for t in whole] == ["make", "gcc", "go"]
    assert [d["tool"] for d in dicts(reports.first_tool(done.reports))] == ["make"]
    assert [d["tool"] for d in dicts(reports.ordered_reports(done.reports))] == ["make", "z", "gcc", "go"]


def test_tail(journal):
    rows = dicts(reports.journal_tail(journal(*[(m, f"x {m}", m % 2 * 7, 5) for m in range(12)])))
    assert [r["cmd"] for r in rows] == [f"x {m}" for m in range(2, 12)]
    assert rows[-1]["line"] == "2031-03-05 08:31:00  bash     exit 7       5ms  x 11"


def test_project_listing(journal):
    entries = [
        (0, "make x", 1, 1, "bash", "/w/api/src"), (1, "make x", 0, 1, "bash", "/w/api/src"),
        (2, "make y", 1, 1, "bash", "/w/web"), (3, "make y", 0, 1, "bash", "/w/web"),
    ]
    got = dicts(project_listing(journal(*entries), F.lit("/w/web")))
    assert [(g["command"], g["rank"], g["total"]) for g in got] == [("make y", 2, 4)]


# --- buckets never change results ------------------------------------------------


def random_rows(rng, n):
    cmds = ["git push a", "git push b", "git pusk a", "git pull x y", "git push a --force", "git x"]
    rows, pos = [], 0
    for _ in range(n):
        pos += rng.choice([1, 1, 1, 1, 1, 2, 3, 4, 9])
        source = "bash" if rng.random() < 0.8 else "zsh"
        tool = "git" if rng.random() < 0.9 else "hub"
        rows.append((source, tool, pos, rng.choice(cmds[:3] if rng.random() < 0.9 else cmds)))
    return rows


@pytest.mark.parametrize("bucket", [1, 2, 3, 7, 50, 1 << 20])
def test_chains_across_buckets(spark, bucket):
    rows = random_rows(random.Random(bucket), 1500)
    df = spark.createDataFrame([("s", *r) for r in rows], "scope string, source string, tool string, pos bigint, cmd string")
    got = retries.retry_chains(df, replace(DEFAULTS, bucket_rows=bucket))
    want = sorted(naive.chains(rows, naive.judged([r[3] for r in rows])))
    assert sorted((r.source, r.tool, r.cmd, r.attempts) for r in got.collect()) == want
    assert any(w[3] > 3 for w in want)


@pytest.mark.parametrize("bucket", [1, 2, 5, 40, 1 << 20])
def test_fights_across_buckets(spark, bucket):
    rng = random.Random(bucket)
    rows, at = [], 0
    for _, tool, seq, cmd in random_rows(rng, 1500):
        at += rng.choice([1, 30, 200, 899, 900, 901]) if rng.random() < 0.9 else -100
        rows.append(((tool, rng.choice(["bash", "zsh"])), seq, at, cmd, int(rng.random() < 0.7), rng.randint(0, 3000)))
    frame = [("s", t, sh, seq, T0.timestamp() + a, c, e, d, "/p") for (t, sh), seq, a, c, e, d in rows]
    df = spark.createDataFrame(
        frame, "scope string, tool string, shell string, seq bigint, at double, cmd string, exit int, dur_ms bigint, cwd string"
    ).withColumn("ts", F.timestamp_seconds("at"))
    got = fight_ops.fights(df, replace(DEFAULTS, bucket_rows=bucket)).collect()
    want = sorted(naive.fights(rows, 900, naive.judged([r[3] for r in rows])))
    assert sorted(((r.tool, r.shell), r.seq, r.command, r.attempts, r.cost_ms) for r in got) == want
    assert any(w[3] > 4 for w in want)


@pytest.mark.parametrize("hot", [1, 100, 1 << 22])
def test_positions_of_hot_keys(spark, hot):
    rng = random.Random(hot)
    rows = [(rng.choice("aaab"), rng.randint(0, 400), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, at bigint, id bigint")
    for width, place in ((10, None), (10, F.col("at")), (1000, F.col("at"))):
        bucket = F.floor(F.col("at") / width)
        got = dense_positions(df, ["k"], ["at", "id"], bucket, "pos", replace(DEFAULTS, hot_key_rows=hot), place=place)
        assert got.columns == ["k", "at", "id", "pos"]
        for key in "ab":
            mine = sorted((r.pos, r.at, r.id) for r in got.where(F.col("k") == key).collect())
            assert [(a, i) for _, a, i in mine] == sorted((a, i) for k, a, i in rows if k == key)
            assert [p for p, _, _ in mine] == list(range(len(mine)))


def test_a_full_bucket_is_numbered_in_several_tasks(spark):
    """All rows of a key in one bucket: the window over them has as many parts as quantiles."""
    from cmdlode.operators.sequence import _ranges

    rows = spark.range(5000).selectExpr("'k' AS k", "id * id AS at", "true AS _hot", "0L AS _bucket")
    ranged = _ranges(rows, ["k"], F.col("at"), replace(DEFAULTS, hot_key_rows=500))
    sizes = [r["count"] for r in ranged.groupBy("_range").count().collect()]
    assert len(sizes) >= 30 and max(sizes) < 400


def test_empty_inputs(spark):
    commands = spark.createDataFrame([], "scope string, source string, pos bigint, command string")
    done = Rebuild(commands, spark.createDataFrame([], JOURNAL))
    for frame in (done.reports, done.victories, done.biggest_fights, done.hits):
        assert frame.collect() == []
