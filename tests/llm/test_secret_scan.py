from __future__ import annotations

import random
import re

from cmdlode.llm import secret_scan as S
from tests.llm import brute


def _model(spark, docs):
    return S.train(S.random_strings(spark).unionByName(S.ordinary_strings(docs)))


def test_base_spans_equal_plain_search(spark, docs):
    texts = [
        None, "", " \n", "no secret here", "password = hunter22", 'x "secret": "abc", token:abcdef9', "api-key=short",
        "ApiKey = token=abcdef", "token = token = abcdefg", "AKIA" + "A" * 16 + " AKIAABC " + "AKIA" + "B" * 30,
        "é𝔘 " + "0123456789abcdef" * 2 + "\né token='zz_zz.zz-zz'", "0123456789abcdef0123456" + "g" + "f" * 24,
        "passwd:" + " " * 50 + "abcdef123", "ſecret=abcdefgh TOKEN\"=\"ABCDEF==\"", "lorem ipsum " * 20_000 + "secret=abcdefgh1",
    ]
    frame = docs(*texts, *texts[:5])
    rows = S.scan(frame, S.train(S.random_strings(spark, 10))).collect()
    assert len(rows) == len(texts) + 5
    for row in rows:
        counts, spans = brute.secrets((texts + texts)[row["doc_id"]])
        base = [s for s in row["found"] if s["kind"] != S.RANDOM]
        assert ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in base) == spans
        assert sum(counts.values()) == len(base)
    assert rows[0]["lang"] is None and "text" not in rows[0].asDict()


def test_random_runs_are_told_from_identifiers(spark, docs, prose):
    keys = ["Zq8xV2kP0sRt7LmN4bWyAa3e", "ghx_9fK2mQ7Lx0Zp4VtR8sWd1BnC6", "mF9/xT+2kLqZ7vB0nRyW5sPd8gH="]
    names = ["rotalimo" * 4, "sano_kelu_timora_bedi_sole", "-" * 40, "=" * 60, "sanoKeluTimoraBediSole"]  # as the prose sounds
    frame = docs(*keys, *names, *(prose(200, i) for i in range(30)))
    model = _model(spark, frame)
    rows = {r["doc_id"]: [s["kind"] for s in r["found"]] for r in S.scan(frame, model).collect()}
    assert [rows[i] for i in range(3)] == [["random"]] * 3
    assert {i: kinds for i, kinds in rows.items() if i >= 3 and kinds} == {}


def test_held_out_accuracy(spark, docs, prose):
    from pyspark.sql import functions as F

    frame = docs(*(prose(300, i) for i in range(40)))
    samples = S.random_strings(spark, 4000).unionByName(S.ordinary_strings(frame)).where(F.length("value") >= 8).cache()
    part = F.pmod(F.xxhash64("value"), F.lit(5))
    model = S.train(samples.where(part > 0))
    held = samples.where(part == 0).select("secret", (model.score(F.col("value")) >= S.MIN_SCORE).alias("said"))
    right = {(r["secret"], r["said"]): r["count"] for r in held.groupBy("secret", "said").count().collect()}
    positive = right.get((True, True), 0) + right.get((True, False), 0)
    negative = right.get((False, True), 0) + right.get((False, False), 0)
    assert positive > 200 and right.get((True, True), 0) >= 0.97 * positive
    assert negative > 200 and right.get((False, True), 0) <= 0.01 * negative


def brute_random(text, model, base):
    """Scores run by run, in Python."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text or ""):
        codes = [ord(c) - S._FIRST for c in m.group()]
        score = 0.0
        for a, b in zip(codes, codes[1:]):
            score += model.weights[a * S._WIDTH + b]
        is_id = re.fullmatch(S.ORDINARY, m.group())
        if score >= S.MIN_SCORE and not is_id and not any(a < m.end() and m.start() < b for a, b in base):
            out.append((m.start(), m.end()))
    return out


def test_random_spans_equal_plain_scores(spark, docs, prose):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
    texts = [None, "", "é " * 30]
    for i in range(60):
        parts = [prose(rng.randint(0, 30), i)]
        for _ in range(rng.randint(0, 12)):
            n = rng.randint(15, 60)
            parts += ["".join(rng.choice(letters) for _ in range(n)), rng.choice(["é𝔘", " ", ".", "secret="]), prose(2, i)]
        parts.append("%08x-1234-abcd-ef01-%012x" % (rng.getrandbits(32), rng.getrandbits(48)))
        parts.append("%040x" % rng.getrandbits(160))
        texts.append(" ".join(parts) if i % 2 else "".join(parts))
    texts.append(" ".join("%040x" % rng.getrandbits(160) for _ in range(700)) + " " + "".join(rng.choice(letters) for _ in range(4000)))
    frame = docs(*texts)
    model = _model(spark, frame)
    several = 0
    for row in S.scan(frame, model).collect():
        text = texts[row["doc_id"]]
        base = [(s["start"], s["end"]) for s in row["found"] if s["kind"] != S.RANDOM]
        got = [(s["start"], s["end"]) for s in row["found"] if s["kind"] == S.RANDOM]
        assert got == brute_random(text, model, base)
        several += len(got) > 1
    assert several > 20


def test_names_that_look_real(spark, docs):
    """Paths, dotted and dashed names, addresses and ids are not secrets; trained on text with such words."""
    words = (
        "usr local share python packages site config service manager handler request response user account "
        "internal server client module component controller repository application main resources static images "
        "thumbnail product category description customer order history payment gateway session timeout default"
    ).split()
    rng = random.Random(5)
    frame = docs(*(" ".join(rng.choice(words) for _ in range(300)) for _ in range(30)))
    names = [
        "/usr/local/share/python/site-packages/config", "com.service.internal.RequestHandlerFactory", "user_account_session_timeout_default",
        "https://server/static/images/product/category/thumbnail", "ApplicationControllerRepository", "internal-service-manager-component",
        "123e4567-e89b-12d3-a456-426614174000", "CUSTOMER_ORDER_HISTORY_DESCRIPTION", "resources/main/application/config_default",
        "paymentGatewaySessionHandler", "-" * 80, "____________________________", "customer_order_2024-05-17", "==========================",
    ]
    keys = ["q8ZxV2kP0sRt7LmN4bWyAa3e", "mF9/xT+2kLqZ7vB0nRyW5sPd8gH=", "x9fK2mQ7Lx0Zp4VtR8sWd1BnC6", "JBSWY3DPEHPK3PXPJBSWY3DPEHPK3PXP"]
    model = _model(spark, frame)
    found = {r["doc_id"]: [s["kind"] for s in r["found"]] for r in S.scan(docs(*names, *keys), model).collect()}
    wrong = [names[i] for i in range(len(names)) if found[i]]
    assert wrong == []
    assert [found[len(names) + i] for i in range(len(keys))] == [["random"]] * len(keys)


def test_long_runs_and_many_matches(spark, docs):
    """A run of a million characters and 30,000 hashes: either would take hours if work grew with the square."""
    rng = random.Random(9)
    model = S.train(S.random_strings(spark, 50).unionByName(docs("a").selectExpr("'plainwordshere' AS value", "false AS secret")))
    run = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(1_000_000))
    hashes = " ".join("%040x" % rng.getrandbits(160) for _ in range(30_000))
    rows = {r["doc_id"]: r["found"] for r in S.scan(docs(run, hashes), model).collect()}
    assert [(s["start"], s["end"]) for s in rows[0] if s["kind"] == S.RANDOM] in ([], [(0, len(run))])
    assert sum(s["kind"] == "hex" for s in rows[1]) == 30_000
    assert rows[1][-1]["end"] == len(hashes)


def test_empty_table_and_no_samples(spark, docs):
    model = S.train(S.random_strings(spark, 0))
    assert set(model.weights) == {0.0}
    assert S.scan(docs("a").where("false"), model).count() == 0
