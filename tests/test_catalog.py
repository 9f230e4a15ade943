"""Every named query against its SQL on another engine, and what the plans look like."""

import re
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry_points
from cmdlode.plans.catalog import catalog
from oracle.compare import compare, connect
from oracle.queries import oracle_sql

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(oracle_sql()) == set(catalog()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(catalog()))
def test_query(spark, con, name):
    assert compare(spark, con, name, catalog()[name], SF) is None


def test_entry(spark):
    assert entry_points.entry(spark).count() >= 0


def test_entry_without_a_library_that_training_data_needs():
    """The other queries load where one is missing."""
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    root = Path(entry_points.__file__).parent
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert done.stdout.split() == [str(len(catalog()))] * 2


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


BATCH = sorted(name for name in catalog() if not name.startswith("stream_"))
# Scans of narrow stored tables in a query's last job, before reuse; inputs that several branches share are stored before.
MOST_SCANS = {"tool_reports": 8, "sheet_text": 8, "suggestions": 8, "suggestions_cooldown": 3, "history_pwsh": 2}


@pytest.mark.parametrize("name", BATCH)
def test_batch_plans_have_no_python_and_no_cross_join(spark, name):
    text = plan(catalog()[name](spark, SF))
    assert not re.search(r"Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", text)
    if name in MOST_SCANS:
        assert text.count("FileScan") <= MOST_SCANS[name]


def test_files_are_read_twice_at_most(spark, tmp_path):
    """Once to count the lines of their splits, once for everything that is made of them."""
    from cmdlode.plans.rebuild import Rebuild
    from cmdlode.sources.histories import Probe, load_histories
    from cmdlode.sources.journal import read_journal

    (tmp_path / "h").write_text("make a\nmake ab\n" * 5)
    (tmp_path / "j.jsonl").write_text('{"ts":"2031-03-05T08:00:00Z","cmd":"make a","exit":1}\n{"ts":"2031-03-05T08:01:00Z","cmd":"make a"}\n')
    commands, _ = load_histories(spark, [Probe("bash", "bash", str(tmp_path / "h"))])
    job = Rebuild(commands, read_journal(spark, str(tmp_path / "j.jsonl")))
    assert plan(commands).count("FileScan text") <= 2  # the rows, and the count that looks for hot files
    for result in (job.reports, job.victories, job.biggest_fights):
        assert "FileScan text" not in plan(result)
    job.write(str(tmp_path / "won"), str(tmp_path / "sheets"), "2031-03-06")
    assert job.victories.count() == 1


def test_top_k_is_cut_before_the_shuffle(spark):
    text = plan(catalog()["greatest_hits"](spark, SF))
    assert text.count("WindowGroupLimit") >= 2


def test_only_needed_columns_are_read(spark):
    text = plan(catalog()["tool_usage"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in text
