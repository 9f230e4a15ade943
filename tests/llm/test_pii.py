from __future__ import annotations

import re
from datetime import date

import pytest

from cmdlode.llm import pii as P

KEY = b"k1"


def _one(text, key=KEY):
    return P.Pseudonyms(key).replace(text)[0]


def _there_and_back(text, key=KEY):
    return P.Pseudonyms(key, back=True).restore(*P.Pseudonyms(key).replace(text))


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_permutation_is_one(size):
    made = P.Permutation(KEY)
    moved = [made.permute("t", size, v) for v in range(size)]
    assert sorted(moved) == list(range(size))
    assert [made.permute("t", size, v, back=True) for v in moved] == list(range(size))
    if size > 90:
        assert moved != [made.permute("u", size, v) for v in range(size)] != [P.Permutation(b"k2").permute("t", size, v) for v in range(size)]


VALUES = [
    "4539578763621486", "4539 5787 6362 1486", "3782-822463-10005", "10.20.30.40", "255.1.0.9", "2024-02-29", "31.12.1999", "12/31/2001",
    "31/12/2001", "123-45-6789", "+1 (555) 123-4567", "(555) 123-4567", "555-123-4567", "+49 30 1234567", "jo.e_42@mail.example.org",
    "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32",
]


@pytest.mark.parametrize("value", VALUES)
def test_format_link_and_restore(value):
    text = f"see {value}, then ({value}) and {value}"
    new = _one(text)
    found = re.fullmatch(r"see (.*), then \((.*)\) and (.*)", new)
    assert found and len(set(found.groups())) == 1 and found[1] != value
    if not re.fullmatch(r"[0-9]+(\.[0-9]+){3}", value):
        assert re.sub(r"[0-9]", "9", re.sub(r"[A-Z]", "A", re.sub("[a-z]", "a", found[1]))) == re.sub(
            r"[0-9]", "9", re.sub(r"[A-Z]", "A", re.sub("[a-z]", "a", value)))
    assert _there_and_back(text) == text
    assert _one(new) != new and _one(text, b"other") != new


def test_results_stay_valid():
    card = re.sub(r"\D", "", _one("4539578763621486"))
    assert P.luhn(card[:-1]) == int(card[-1])
    assert P.iban_rest(_one("DE89370400440532013000")) == 1
    date.fromisoformat(_one("2024-02-29"))
    assert all(int(p) < 256 for p in _one("10.20.30.40").split("."))


@pytest.mark.parametrize(
    "text",
    ["4539578763621487", "2023-02-29", "300.1.1.1", "1.2.3.4.5", "000-12-3456", "DE89370400440532013001", "version 4.0. of 2001", "",
     "no digits", "12345", "99/99/2001", "a@b", "2024-01-01T00"],
)
def test_invalid_values_stay(text):
    assert _one(text) == text


def test_table(spark, docs):
    frame = docs(None, "", "mail a.b@x.org", "card 4539578763621486 4539578763621486", "mail a.b@x.org", "z" * 300_000 + " 10.20.30.40")
    rows = {r["doc_id"]: r for r in P.pseudonymize(frame, KEY).collect()}
    assert rows[0]["text"] is None and rows[1]["text"] == ""
    assert rows[2]["text"] == rows[4]["text"] != "mail a.b@x.org" and rows[2]["n_email"] == 1
    assert rows[3]["n_card"] == 2 and rows[5]["n_ip"] == 1 and rows[5]["_text"] == "mine" and rows[5]["n_words"] == 7
    back = P.restore(P.pseudonymize(frame, KEY), KEY)
    assert back.columns == frame.columns
    assert sorted(back.collect(), key=lambda r: r["doc_id"]) == sorted(frame.collect(), key=lambda r: r["doc_id"])
    assert P.pseudonymize(frame.where("false"), KEY).count() == 0


def test_given_documents_restore(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    back = P.restore(P.pseudonymize(frame, KEY), KEY)
    assert back.exceptAll(frame).count() == 0


PHONE, IP, CARD, IBAN = "+1 (826) 555-4081", "190.137.223.204", "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"


@pytest.mark.parametrize(
    "before, value, after",
    [("", PHONE, " 190"), ("", PHONE, " 12"), ("", CARD, " 12/27"), ("", CARD, " 123"), ("", CARD, "-123"), ("1234 ", CARD, ""), ("", IBAN, " BIC"),
     ("", IBAN, " BIC ABC"), ("", "4111111111111111", " 123"), ("12 ", IBAN, " 7"), ("", "+49 30 1234567", " 12"),
     ("", "+49-30-123-4567", " 12"), ("12 34 ", CARD, " 5")],
)
def test_neighbours_stay_and_values_link(before, value, after):
    text = f"see {before}{value}{after}, or"
    assert _one(text) == f"see {before}{_one(value)}{after}, or"
    assert _there_and_back(text) == text


@pytest.mark.parametrize("first", [PHONE, IP, CARD, IBAN, "+49 30 1234567", "123-45-6789", "2024-02-29", "a.b@x.org", "4111111111111111"])
@pytest.mark.parametrize("second", [PHONE, IP, CARD, IBAN, "31.12.1999", "2024-02-29", "123-45-6789", "555-123-4567", "a.b@x.org"])
def test_two_values_side_by_side(first, second):
    new, spans = P.Pseudonyms(KEY).replace(f"{first} {second}")
    assert new == f"{_one(first)} {_one(second)}" and len(spans) == 2
    assert _there_and_back(f"{first} {second}") == f"{first} {second}"


def _read_by_places(text):
    """A plain reader: at each place in turn, the first value that begins there, and on behind it."""
    reader, at, out = P.Pseudonyms(KEY), 0, []
    while at < len(text):
        value = reader._value_at(text, at)
        if value:
            out.append((at, *value))
        at = value[1] if value else at + 1
    return out


def test_random_neighbours_keep_links():
    """Whatever stands beside a value that is read, its pseudonym is the same, and all is restored."""
    import random

    rng, seen, read = random.Random(5), {}, 0
    values = [PHONE, IP, CARD, IBAN, "+49 30 1234567", "2024-02-29", "31.12.1999", "123-45-6789", "a.b@x.org", "4111111111111111", "555-123-4567"]
    number = lambda: "".join(rng.choice("0123456789") for _ in range(rng.randint(1, 6)))
    pseudonyms = P.Pseudonyms(KEY)
    for _ in range(20_000):
        parts = [number(), rng.choice(values), rng.choice([number(), rng.choice(values)]), number()]
        text = rng.choice([" ", " ", "-", ", ", "/"]).join(parts)
        new, spans = pseudonyms.replace(text)
        found = _read_by_places(text)
        assert [(s, k, e) for s, k, e in pseudonyms._read(text)] == found
        for (start, kind, end), (_, a, b) in zip(found, spans):
            assert seen.setdefault((kind, text[start:end]), new[a:b]) == new[a:b]
            read += 1
        assert P.Pseudonyms(KEY, back=True).restore(new, spans) == text
    assert read > 20_000


def test_one_pseudonym_in_all_formats():
    dates = {date.fromisoformat(_one("2024-02-29")), date(*map(int, _one("29.02.2024").split(".")[::-1]))}
    month, day, year = map(int, _one("02/29/2024").split("/"))
    dates.add(date(year, month, day))
    day, month, year = map(int, _one("29/02/2024").split("/"))
    assert dates == {date(year, month, day)}
    digits = lambda text: re.sub(r"\D", "", _one(text))
    assert digits("+1 (555) 123-4567")[1:] == digits("(555) 123-4567") == digits("555-123-4567") == digits("555.123.4567")
    assert digits("+49 30 1234567") == digits("+49-30-123-4567") == digits("+49301234567".replace("+4930", "+49 30 "))
    assert digits("+353 1 234 5678")[:3] == "353"


def test_every_date_moves_within_its_class():
    moved = {}
    for n in range(0, 73_049, 7):
        d = P._DAYS[0] + P.timedelta(n)
        new = date.fromisoformat(_one(d.isoformat()))
        assert (new.day > 12) == (d.day > 12)
        assert moved.setdefault(new, d) == d
