from __future__ import annotations

import pytest

from cmdlode.llm import quality as Q
from tests.llm import brute

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _texts(prose):
    phrase = prose(8, 3)
    return [
        None, "", " \t\r\n\x0b\x0c", "one", "a\x0bb\x0cc\x1cd e f", phrase, f"{phrase} {phrase}", f"{phrase} x {phrase}",
        " ".join(["ja"] * 7), " ".join(["ja"] * 8), " ".join(["ja"] * 9), " ".join(["ja"] * 500), prose(300, 1),
        prose(100, 2) + " " + phrase + " " + prose(40, 4) + " " + phrase, "x\nx\n\n \nx\ny\n", "# $ % & | < > *" * 30,
        "𝔘 é ß " * 30, "\n".join([prose(12, 5)] * 10), prose(30_000, 6), f" {prose(30, 7)}\n",
    ]


def test_counts_equal_plain_counts(docs, prose):
    texts = _texts(prose)
    frame = docs(*texts, *texts)
    for row in Q.judge(frame).collect():
        text = (texts + texts)[row["doc_id"]]
        assert tuple(row[n] for n in NAMES) == brute.quality(text), (text or "")[:80]
        if row["base_failed"]:
            assert not row["kept"]


def test_rules(docs, prose):
    clean = " ".join(f"the {prose(5, i)} of" for i in range(20))
    noisy = " ".join(f"{w}###" for w in clean.split())
    endless = " ".join(w * 9 for w in clean.split())
    wordy = " ".join(f"zuk{i}" for i in range(80))
    broken = {r["doc_id"]: r["broken"] for r in Q.judge(docs(clean, noisy, endless, wordy)).collect()}
    assert broken == {0: [], 1: ["symbols", "stop_words"], 2: ["word_length", "stop_words"], 3: ["stop_words"]}


def test_table_of_rules_is_compiled(docs, prose):
    rules = (Q.Rule("short", "n_words / n_lines", high=10),)
    rows = Q.judge(docs(prose(30, 1), "\n".join(prose(9, i) for i in range(5))), rules=rules).collect()
    assert [r["broken"] for r in rows] == [["short"], []]


def test_keep_good_keeps_columns(docs, prose):
    clean = " ".join(f"the {prose(5, i)} of" for i in range(20))
    frame = docs(clean, None, "x", clean)
    kept = Q.keep_good(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3]
    assert kept.where("n_words = 7 and _text = 'mine' and kept and size = 1").count() == 2
    assert Q.keep_good(frame.where("false")).count() == 0


def test_no_python_in_plan(docs):
    plan = Q.judge(docs("a"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("window", [2, 4])
def test_other_windows(docs, window):
    from pyspark.sql import functions as F

    ids = docs("a b c a b d").select(F.transform(F.split("text", " "), lambda w: F.xxhash64(w)).alias("i"))
    assert Q.repeated_words(ids, "i", window).first()["n_repeat_words"] == (4 if window == 2 else 0)
