from __future__ import annotations

import pytest

import corpus_pipeline
from cmdlode.llm import quality
from cmdlode.llm.queries import ORACLE_SQL, queries
from cmdlode.llm.tokenize import vocabulary_path
from oracle.compare import _rows, connect
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_sql_agrees(spark, name):
    frame = queries()[name](spark, SMALL)
    result = connect(SMALL).execute(ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert _rows(frame.columns, frame.collect()) == _rows(columns, result.fetchall())


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(vocabulary_path())
    made.encode_special_tokens = True
    return made


def test_contracts(spark, given, tokenizer):
    docs = [(r["doc_id"], r["text"]) for r in given("documents")]
    items = [(r["item_id"], r["text"]) for r in given("benchmark")]
    rows = lambda name: {r["doc_id"]: r for r in queries()[name](spark, SMALL).collect()}
    secrets = rows("op1_secret_scan")
    for doc_id, text in docs:
        counts, spans = brute.secrets(text)
        row = secrets[doc_id]
        assert (row["n_assign"], row["n_access"], row["n_hex"], row["base_sha256"]) == (*counts.values(), brute.sha(spans))
        assert set(spans.split(",")) <= set(row["spans"].split(","))
    near = brute.near_duplicates(docs)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in rows("op5_minhash_near_dedup").items()} == near
    judged = rows("op9_decontamination")
    assert {i: tuple(r[k] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for i, r in judged.items()} == (
        brute.contamination(docs, items)
    )
    tokens = rows("op10_token_files")
    assert {i: (r["start"], r["n_tokens"], r["ids_crc32"]) for i, r in tokens.items()} == brute.token_rows(docs, tokenizer)


def test_pipeline(spark, given, tokenizer):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in given("documents")]
    docs = [d for d in docs if brute.keeps(d[1], set(quality.STOP_WORDS))]
    near = brute.near_duplicates([d[:2] for d in docs])
    docs = [d for d in docs if near[d[0]][1] == d[0]]
    bad = brute.contamination([d[:2] for d in docs], [(r["item_id"], r["text"]) for r in given("benchmark")])
    docs = [d for d in docs if not bad[d[0]][4]]
    mixed = brute.mix(docs)
    got = corpus_pipeline.run(spark, SMALL).collect()
    length = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == sorted((i, length(text)) for i, text in mixed)
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert stage(spark, docs.where("false"), SMALL).count() == 0, name
