from __future__ import annotations

from collections import defaultdict

from cmdlode.llm import mixing as M
from tests.llm.brute import WORD


def _rows(spark, sizes):
    """(source, number of words) in order of ids."""
    data = [(i, None if n is None else "w " * n, source) for i, (source, n) in enumerate(sizes)]
    return spark.createDataFrame(data, "doc_id bigint, text string, source string")


def _fill(sizes, weights=(1, 2, 3), cap=3):
    """Targets by clamping one round after the other."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = float(sum(sizes.values())), set(order), {}
    while open_:
        share = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / share >= cap * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / share for s in open_}
        for s in over:
            target[s] = float(cap * sizes[s])
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


def _check(rows, docs):
    sizes = defaultdict(int)
    for row in docs:
        sizes[row["source"]] += len(WORD.findall(row["text"] or ""))
    targets, taken = _fill(dict(sizes)), defaultdict(int)
    source = {r["doc_id"]: r["source"] for r in docs}
    for row in rows:
        s = source[row["doc_id"]]
        assert row["source_size"] == sizes[s]
        assert abs(row["target"] - targets[s]) < 1e-6 * max(1, targets[s])
        assert 0 <= row["taken"] <= 3 * row["size"]
        taken[s] += row["taken"]
    for s, target in targets.items():
        assert abs(taken[s] - target) <= 1, s


def test_targets_and_words_taken(spark):
    sizes = [("b", n) for n in range(1, 60)] + [("a", 5), ("a", 0), (None, 40), (None, None), ("Z", 900), ("é", 3), ("c", 0)]
    docs = _rows(spark, sizes)
    _check(M.mix_counts(docs).collect(), docs.collect())


def test_given_documents(spark, given):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first, second = M.mix_counts(docs).collect(), M.mix_counts(docs.repartition(7)).collect()
    _check(first, given("documents"))
    assert sorted(first) == sorted(second)


def test_mix_repeats_whole_documents_and_cuts_one(spark):
    docs = _rows(spark, [("a", 7), ("a", 11), ("a", 2), ("b", 300), ("c", 10), ("c", 3)]).selectExpr("*", "'k' AS size", "1 AS _digest")
    counts = {r["doc_id"]: r["taken"] for r in M.mix_counts(docs).collect()}
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns
    taken = defaultdict(int)
    for row in mixed.collect():
        taken[row["doc_id"]] += len(WORD.findall(row["text"]))
        assert row["size"] == "k"
    assert {k: v for k, v in counts.items() if v} == dict(taken)


def test_repeated_null_ids_and_empty_tables(spark):
    docs = _rows(spark, [("a", 10)] * 3 + [("b", 40)])
    same = docs.selectExpr("cast(null as bigint) AS doc_id", "text", "source")
    rows = M.mix_counts(same).collect()
    assert len(rows) == 4 and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert sum(r["taken"] for r in rows) == sum(round(t) for t in _fill({"a": 30, "b": 40}).values())
    assert M.mix_counts(docs.where("false")).count() == 0
    assert M.mix(docs.where("false")).count() == 0
    assert [r["taken"] for r in M.mix_counts(_rows(spark, [("a", None), ("b", 0)])).collect()] == [0, 0]


def test_a_thousand_rows_alike_come_to_the_target(spark, monkeypatch):
    """Rows without id and of one word: a target between whole repetitions is met to the word."""
    monkeypatch.setattr(M, "_BLOCK_BITS", 4)
    monkeypatch.setattr(M, "_COPIES", 7)
    for words in (1, 7):
        docs = _rows(spark, [("a", words)] * 1000 + [("b", 300 * words), ("b", 77), ("c", 5)]).selectExpr("cast(null as bigint) AS doc_id", "text", "source")
        sizes = {"a": 1000 * words, "b": 300 * words + 77, "c": 5}
        rows, targets = M.mix_counts(docs.repartition(5)).collect(), _fill(sizes)
        taken = defaultdict(int)
        for row in rows:
            taken[{v: k for k, v in sizes.items()}[row["source_size"]]] += row["taken"]
            assert row["taken"] <= 3 * row["size"]
        assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)
        again = defaultdict(int)
        for row in M.mix(docs).collect():
            again[row["source"]] += len(WORD.findall(row["text"]))
        assert again == taken
