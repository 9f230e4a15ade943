from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from cmdlode.llm import token_counts as K
from cmdlode.llm import token_files as F
from cmdlode.llm.tokenize import Encoder, read_vocabulary, vocabulary_path
from tests.llm import brute

ODD = [
    None, "", " ", "\n", "  ", "a", " a", "a ", "a  b", "a\nb", "a \nb", "a\n b", "\n\na", "a\n\n", "x  y", "x  y", "  a",
    "don't we'll  I'm", "<|endoftext|> a <|endoftext|>", "\x1c a \x1cb", "\x01a b", "é𝔘 ß\tä", "a\r\nb c", "1 22 333,4", "a" * 5000,
    "tab\tone two", "\x85 a \x85", "end \n", " \n ",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(vocabulary_path())
    made.encode_special_tokens = True
    return made


def test_pieces_give_the_ids_of_the_whole(tokenizer, given, prose):
    encoder = Encoder(read_vocabulary(), most_kept=50)
    texts = ODD + [r["text"] for r in given("documents")] + [prose(50, 1).replace(" ", "  ")]
    for first in range(0, len(texts), 40):
        part = texts[first : first + 40]
        for text, data in zip(part, encoder.encode(part)):
            assert np.frombuffer(data, encoder.dtype).tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_histogram_and_limits(spark, docs, tokenizer):
    frame = docs(*ODD, *ODD[:9])
    want = Counter(len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in ODD + ODD[:9])
    report = K.length_report(K.histogram(K.encoded_lengths(frame))).cache()
    lengths = list(want.elements())
    assert {r["length"]: r["n_docs"] for r in report.collect()} == want
    for row in report.collect():
        assert row["tokens_cut"] == sum(min(n, row["length"]) for n in lengths)
        assert row["total"] == sum(lengths) and row["n_over"] == sum(n > row["length"] for n in lengths)
    for row in K.at_limits(report, [0, 1, 3, 7, 10**6]).collect():
        assert row["tokens_cut"] == sum(min(n, row["limit"]) for n in lengths)
        assert row["n_fit"] == sum(n <= row["limit"] for n in lengths) and row["total"] == sum(lengths)
    median = sorted(lengths)[(len(lengths) - 1) // 2]
    assert K.quantiles(report, [0.5]).first()["length"] == median


def test_counts_of_an_empty_table(spark, docs):
    report = K.length_report(K.histogram(K.encoded_lengths(docs("a").where("false"))))
    assert report.count() == 0
    assert K.at_limits(report, [5]).first().asDict() == {"limit": 5, "n_fit": 0, "n_over": 0, "tokens_fit": 0, "tokens_cut": 0, "total": 0}
    assert K.quantiles(report, [0.5]).first()["length"] is None


def test_files_round_trip(spark, docs, tokenizer, tmp_path, given):
    rows = [(r["doc_id"], r["text"]) for r in given("documents")] + [(10**12 + i, t) for i, t in enumerate(ODD)]
    frame = docs(*rows).repartition(5)
    got = F.tokenize_to_files(frame, f"{tmp_path}/a").collect()
    want = brute.token_rows(rows, tokenizer)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == want
    assert not list(tmp_path.glob("a/*.tmp"))
    reader = F.TokenReader(f"file://{tmp_path}/a", parts=1)
    for doc_id, text in rows[::7]:
        assert reader.ids(doc_id).tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
    assert reader.ids(5 * 10**12) is None and reader.ids(3, copy=1) is None and reader.ids(None) is None


def test_repeated_and_null_ids(spark, docs, tokenizer, tmp_path, monkeypatch):
    monkeypatch.setattr(F, "KEYS_PER_PART", 8)
    rows = [(7, f"text {i}") for i in range(40)] + [(7, "same")] * 5 + [(None, "x"), (None, "y z"), (3, None), (9, "")]
    got = F.tokenize_to_files(docs(*rows), f"{tmp_path}/b").collect()
    length = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    key = lambda i: (i is not None, i or 0)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((i, length(t)) for i, t in rows)
    at = 0
    for row in sorted(got, key=lambda r: r["start"]):
        assert row["start"] == at
        at += row["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=key)


def test_empty_table(spark, docs, tmp_path):
    assert F.tokenize_to_files(docs("a").where("false"), f"{tmp_path}/c").count() == 0


def test_index_is_minimal_and_perfect(spark):
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 700, 20_000):
        ids = rng.choice(1 << 50, size=n, replace=False)
        hashes = F.key_hashes(ids, np.zeros(n, bool), np.zeros(n, np.int64))
        slots = np.zeros(n, F.SLOT)
        slots["start"] = np.arange(n)
        data = F.build_part(hashes, slots)
        part = F.IndexPart(lambda at, k, data=data: data[at : at + k])
        assert sorted(part.positions(hashes)) == list(range(n))
        found, fits = part.slots(hashes)
        assert fits.all() and (found["start"] == np.arange(n)).all()
        foreign = F.key_hashes(rng.integers(1 << 51, 1 << 52, size=500), np.zeros(500, bool), np.zeros(500, np.int64))
        assert part.slots(foreign)[1].sum() == 0


def test_parts_agree_with_spark(spark):
    from pyspark.sql import functions as f

    rows = [(0, 0), (5, 2), (-3, 1), (None, 4), (2**62, 0)]
    frame = spark.createDataFrame(rows, "doc_id bigint, copy bigint")
    got = [r[0] for r in frame.select(F.part_of(f.col("doc_id"), f.col("copy"), 97)).collect()]
    assert got == [F.part_of_key(*row, 97) for row in rows]


def test_names_of_added_tokens_give_their_id(spark, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary_path())
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in ODD]
    encoder = Encoder(read_vocabulary(), names_are_text=False)
    assert [np.frombuffer(data, encoder.dtype).tolist() for data in encoder.encode(ODD)] == want
    assert sum(ids.count(50256) for ids in want) == 2
    lengths = K.encoded_lengths(docs(*ODD), keep=("doc_id",), names_are_text=False)
    assert {r["doc_id"]: r["length"] for r in lengths.collect()} == {i: len(ids) for i, ids in enumerate(want)}


def test_words_with_marks_and_accents_are_asked_of_the_model(tokenizer):
    letters = [c for c in map(chr, range(0x41, 0x260)) if c.isalpha()]
    marks = [c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum()]
    words = ["héé", "Œuvre", "don't", "l'été", "x'", "''s", "e-mail", "a" * 60 + ".", "été" * 30 + "!?", *(f"a{c}e" for c in letters)]
    words += [f"{c}é{m}" for c in "zß" for m in [*marks, "...", "'s", "!'", "?!,", "1.", ".b"]]
    texts = [" ".join(words), "é " + " ".join(words[::-1]) + "\nfin.", "one two  three", None, " ".join(f"{w}," for w in words)]
    encoder = Encoder(read_vocabulary())
    for _ in range(2):  # new to the encoder, then remembered
        for text, data in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(data, encoder.dtype).tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids

    class Counting(Encoder):
        sent: list[str] = []

        def _plain(self, texts):
            self.sent.extend(texts)
            return super()._plain(texts)

    Counting(read_vocabulary()).encode(["first été, où, garçon! ça... mot; mot. mot"])
    assert Counting.sent == ["first"]


@pytest.mark.parametrize("kind", ["lower", "marks", "letters"])
def test_other_vocabularies_give_their_own_ids(kind):
    from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

    made = Tokenizer.from_file(vocabulary_path())
    if kind == "lower":
        made.normalizer = normalizers.Lowercase()
    else:
        first = pre_tokenizers.Punctuation("isolated") if kind == "marks" else pre_tokenizers.Split(Regex("é"), "isolated")
        made.pre_tokenizer = pre_tokenizers.Sequence([first, pre_tokenizers.ByteLevel(add_prefix_space=False)])
    made.encode_special_tokens = True
    texts = ["Le Café est là... Oui?! été, Été", "A bc, DÉ\nFin.", "x  Y é"]
    encoder = Encoder(made.to_str())
    for text, data in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(data, encoder.dtype).tolist() == made.encode(text, add_special_tokens=False).ids
