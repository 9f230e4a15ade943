from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from cmdlode.llm import simhash
from cmdlode.llm.queries import queries


def slow_print(text):
    words = [w for w in _split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    size = min(4, len(words))
    hashes = [xxhash.xxh64(" ".join(words[i : i + size]).encode(), seed=42).intdigest() for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _split(text):
    word = ""
    for c in text:
        if c in " \t\n\x0b\x0c\r":
            yield word
            word = ""
        else:
            word += c
    yield word


def brute(rows):
    """All pairs of prints, joined with union-find; rows are (doc_id, text)."""
    prints = [slow_print(text) for _, text in rows]
    return prints, brute_roots(prints, [r[0] for r in rows])


def brute_roots(prints, ids):
    distinct = sorted(set(prints))
    parent = {p: p for p in distinct}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if bin(a ^ b).count("1") <= simhash.MOST:
                parent[root(a)] = root(b)
    least = {}
    for p, doc_id in zip(prints, ids):
        if doc_id is not None:
            least[root(p)] = min(least.get(root(p), doc_id), doc_id)
    return [least.get(root(p)) for p in prints]


def ours(frame):
    return sorted(map(tuple, simhash.near_duplicates(frame).collect()), key=repr)


def expected(rows):
    prints, roots = brute(rows)
    return sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, roots)), key=repr)


def test_edges(docs, prose):
    long = prose(30000, 1)
    rows = [
        (5, None), (4, ""), (9, " \t\n"), (None, "one"), (1, "ONE"), (1, "one"), (2, "one two three"), (3, "One  two\nthree"),
        (6, "Ä ä"), (7, "ä ä"), (8, long), (10, long + " tail"), (None, None), (11, "a\x1fb a\x1fb"), (12, "x" * 100000),
    ]
    assert ours(docs(*rows)) == expected(rows)


def test_empty_table(docs):
    assert ours(docs((1, "x")).limit(0)) == []


def test_given_tables(spark, given):
    rows = [(r["doc_id"], r["text"]) for r in given("documents")]
    found = queries()["op13_simhash_near_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, found), key=repr) == expected(rows)


def families(seed, n):
    """Prints in families of variants with few bits changed, chains, and strangers that share blocks."""
    rng = random.Random(seed)
    out = set()
    for _ in range(n):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            changed = base
            for bit in rng.sample(range(64), rng.randint(0, 6)):
                changed ^= 1 << bit
            out.add(changed)
            if rng.random() < 0.3:
                base = changed
        out.add(base ^ (rng.getrandbits(64) & ~((1 << 32) - 1)))
    return sorted(out)


@pytest.mark.parametrize("blocks", [6, 7, 8])
def test_links_equal_to_all_pairs(spark, blocks):
    prints = families(blocks, 25)
    signed = [simhash._signed(p) for p in prints]
    classes = spark.createDataFrame([(p, 1) for p in signed], "print bigint, n bigint")
    roots = {r["node"]: r["root"] for r in simhash.links(classes, blocks).collect()}
    found = [roots.get(p, p) for p in signed]
    assert found == brute_roots(prints, signed)


def test_one_family_around_a_hot_print(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    prints = sorted({base} | {base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)})
    signed = [simhash._signed(p) for p in prints]
    classes = spark.createDataFrame([(p, 900 if p == simhash._signed(base) else 1) for p in signed], "print bigint, n bigint")
    roots = {r["node"]: r["root"] for r in simhash.links(classes, 6).collect()}
    assert {roots.get(p, p) for p in signed} == {min(signed)}


def test_pivots_never_discard_links(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, 8)):
            b ^= 1 << bit
        rows.append((simhash._signed(a), simhash._signed(b)))
    pairs = spark.createDataFrame(rows, "a bigint, b bigint")
    x = pairs.select("a", "b", *simhash.far_table(pairs["a"]), simhash.near_keys(pairs["a"], 6).alias("keys")).withColumnRenamed("a", "print")
    y = pairs.select(pairs["a"].alias("of"), pairs["b"].alias("print"), *simhash.far_table(pairs["b"]), simhash.near_keys(pairs["b"], 6).alias("keys"))
    joined = x.alias("x").join(y.alias("y"), x["print"] == y["of"])
    found = joined.selectExpr("x.print a", "y.print b", "arrays_overlap(x.keys, y.keys) met")
    linked = {(r["a"], r["b"]) for r in joined.where(simhash._linked("x", "y")).selectExpr("x.print a", "y.print b").collect()}
    near = {(a, b) for a, b in rows if bin((a ^ b) & (1 << 64) - 1).count("1") <= simhash.MOST}
    assert linked == near
    assert all(r["met"] for r in found.collect() if (r["a"], r["b"]) in near)


def test_blocks_grow_with_the_classes():
    assert [simhash.blocks_for(n) for n in (0, 1000, 1 << 18, 1 << 24, 1 << 29, 1 << 60)] == [6, 6, 6, 7, 8, 10]
    masks = simhash.block_masks(7)
    assert sum(masks) == (1 << 64) - 1 and all(8 <= bin(m).count("1") <= 10 for m in masks)


def test_print_of_bytes_and_planes():
    rng = np.random.default_rng(0)
    for n in (1, 3, 4, 5, 200):
        text = " ".join(rng.choice(["ab", "Cd", "e", "ÉF"], n))
        assert simhash.fingerprint(text.encode()) == slow_print(text)
