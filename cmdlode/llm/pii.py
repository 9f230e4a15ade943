"""Format-preserving pseudonyms for personal numbers, dates and addresses.

A value is recognised, validated (check digits, ranges, the calendar), mapped to its
place among the valid values of its format, and that place is permuted by a keyed
Feistel network with cycle walking. The result is written back in the same format, so
it is valid too. A pseudonym depends on the value and the key alone, whatever stands beside it, so
equal values stay linked in every document. A date has one pseudonym in all its formats, a phone
number one whatever its groups. ``pseudonymize`` tells where it has put pseudonyms; with these
spans and the key ``restore`` undoes them.

Work is done per document, with one pattern over each text that holds a digit or an at
sign; nothing is shuffled. Where a shape fits but the value is not valid, the shorter
ones from the same place are tried (cut between groups), then the search goes on one
character further, so a valid value beside other numbers is found.

Defined results: a null text stays null, other texts keep everything that is no valid
value. Repeated rows are treated alike; an empty table gives no rows. A format with few
values (dates: 73,049) permutes just these, so it hides no more than that.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

ROUNDS = 8
_DAYS = (date(1900, 1, 1), date(2099, 12, 31))

# Shapes of the kinds, tried in this order at each place.
_KIND = {
    "email": r"(?<![\w.+-])[A-Za-z0-9_][A-Za-z0-9._+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.\w-])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "date": r"(?<![\w-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![\w-])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "card": r"(?<![\w-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[\x20.-]?[0-9]{2,4}){2,4}"
    r"|\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\w-])",
}
_SHAPES = re.compile("|".join(f"(?P<{kind}>{shape})" for kind, shape in _KIND.items()))
_ONE = {kind: re.compile(shape) for kind, shape in _KIND.items()}
_CUTS = {"iban": re.compile(r"\x20"), "card": re.compile(r"[\x20-]"), "phone": re.compile(r"[\x20.]")}  # group boundaries
_USUAL_CARDS = ([4, 4, 4, 4], [4, 6, 5], [4, 6, 4])
# Lengths of account numbers by country; others may have any.
_IBAN_LENGTHS = dict(
    pair.split(":")
    for pair in (
        "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 "
        "FI:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 "
        "LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 "
        "SA:24 SC:31 SE:24 SI:19 SK:24 SM:27 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20"
    ).split()
)
# Calling codes of one and two digits; all others have three.
_CALLING_CODES = {
    "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53",
    "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
}
_HOME_CODE = "1"  # of phone numbers without a code: only shapes of ten digits are read
KINDS = ("email", "iban", "ip", "date", "ssn", "card", "phone")


class Permutation:
    """Keyed permutation of ``range(size)``, different for each tweak."""

    def __init__(self, key: bytes):
        self._key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: str, size: int, number: int, half: int, bits: int) -> int:
        seed = f"{tweak}:{size}:{number}:{half}".encode()
        digest = hashlib.blake2b(seed, key=self._key, digest_size=-(-bits // 8)).digest()
        return int.from_bytes(digest, "big") & ((1 << bits) - 1)

    def _once(self, tweak: str, size: int, value: int, bits: int, back: bool) -> int:
        left, right = value >> bits, value & ((1 << bits) - 1)
        for number in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ self._round(tweak, size, number, left, bits), left
            else:
                left, right = right, left ^ self._round(tweak, size, number, right, bits)
        return left << bits | right

    def permute(self, tweak: str, size: int, value: int, back: bool = False) -> int:
        if size < 2:
            return value
        bits = max(1, -(-(size - 1).bit_length() // 2))
        while True:  # about four steps at most on average: the network covers under 4 * size values
            value = self._once(tweak, size, value, bits, back)
            if value < size:
                return value


def luhn(digits: str) -> int:
    """The check digit for the digits before it."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _refill(shape: str, characters: str) -> str:
    """``characters`` in the places of letters and digits of ``shape``."""
    left = iter(characters)
    return "".join(next(left) if c.isalnum() else c for c in shape)


class Pseudonyms:
    """Replaces values one by one; ``back`` restores them instead."""

    def __init__(self, key: bytes, back: bool = False):
        self._permutation, self._back = Permutation(key), back

    def _move(self, tweak: str, size: int, value: int) -> int:
        return self._permutation.permute(tweak, size, value, self._back)

    def _digits(self, tweak: str, digits: str) -> str:
        return str(self._move(f"{tweak}{len(digits)}", 10 ** len(digits), int(digits))).zfill(len(digits)) if digits else ""

    def _classes(self, tweak: str, text: str) -> str:
        """Permute among texts with digits, small and capital letters in the same places."""
        classes = ["0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text]
        value, size, out = 0, 1, []
        for c, members in zip(text, classes):
            value, size = value * len(members) + members.index(c), size * len(members)
        shape = "".join("0" if m[0] == "0" else m[0] for m in classes)
        value = self._move(f"{tweak}{shape}", size, value)
        for members in reversed(classes):
            value, place = divmod(value, len(members))
            out.append(members[place])
        return "".join(reversed(out))

    def email(self, text: str) -> str | None:
        local, _, domain = text.partition("@")
        plain = "".join(c for c in local if c.isalnum())
        return f"{_refill(local, self._classes('email', plain))}@{domain}" if plain else None

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_rest(plain) != 1 or not 2 <= int(plain[2:4]) <= 98:
            return None
        account = self._classes("iban" + plain[:2], plain[4:])
        check = 98 - iban_rest(plain[:2] + "00" + account)
        return _refill(text, f"{plain[:2]}{check:02d}{account}")

    def ip(self, text: str) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or (p[0] == "0" and p != "0") for p in parts):
            return None
        value = self._move("ip", 1 << 32, int.from_bytes(bytes(map(int, parts)), "big"))
        return ".".join(map(str, value.to_bytes(4, "big")))

    def date(self, text: str) -> str | None:
        iso = text[4] == "-"
        fields = [int(f) for f in re.split(r"[./-]", text)]
        month_first = not iso and text[2] == "/" and fields[0] <= 12
        year, month, day = fields if iso else (fields[2], *(fields[:2] if month_first else fields[1::-1]))
        try:
            value = (date(year, month, day) - _DAYS[0]).days
        except ValueError:
            return None
        size = (_DAYS[1] - _DAYS[0]).days + 1
        if not 0 <= value < size or (not iso and text[2] != text[5]):
            return None
        late = day > 12  # kept, so that what can only be read day first still is
        while True:
            value = self._move("date", size, value)
            moved = _DAYS[0] + timedelta(value)
            if (moved.day > 12) == late:
                break
        if iso:
            return moved.isoformat()
        order = (moved.month, moved.day) if month_first else (moved.day, moved.month)
        return f"{order[0]:02d}{text[2]}{order[1]:02d}{text[2]}{moved.year:04d}"

    def ssn(self, text: str) -> str | None:
        value = text

        def good(v: str) -> bool:
            return v[:3] not in ("000", "666") and v[0] != "9" and v[4:6] != "00" and v[7:] != "0000"

        if not good(value):
            return None
        while True:
            value = _refill(text, self._digits("ssn", value.replace("-", "")))
            if good(value):
                return value

    def card(self, text: str) -> str | None:
        plain = "".join(c for c in text if c.isdigit())
        if not 13 <= len(plain) <= 19 or luhn(plain[:-1]) != int(plain[-1]) or not plain.strip("0"):
            return None
        body = self._digits("card", plain[:-1])
        return _refill(text, f"{body}{luhn(body)}")

    def phone(self, text: str) -> str | None:
        plain = "".join(c for c in text if c.isdigit())
        if not 9 <= len(plain) <= 15:
            return None
        if text[0] != "+":
            return _refill(text, self._digits("phone" + _HOME_CODE, plain))
        prefix = next((n for n in (1, 2) if plain[:n] in _CALLING_CODES), 3)
        return _refill(text, plain[:prefix] + self._digits("phone" + plain[:prefix], plain[prefix:]))

    def _ends(self, kind: str, text: str, start: int) -> list[int]:
        """Where a value of this shape may end: its usual form first, then the longest."""
        found = _ONE[kind].match(text, start)
        if not found:
            return []
        if kind not in _CUTS:
            return [found.end()]
        cuts = [m.start() for m in _CUTS[kind].finditer(text, start, found.end())]
        ends = [e for e in (found.end(), *reversed(cuts)) if e == found.end() or _ONE[kind].fullmatch(text, start, e)]
        return sorted(ends, key=lambda e: not self._usual(kind, text, start, e))

    def _usual(self, kind: str, text: str, start: int, end: int) -> bool:
        value = text[start:end]
        if kind == "iban":
            return str(len(value.replace(" ", ""))) == _IBAN_LENGTHS.get(value[:2])
        groups = [len(g) for g in re.findall("[0-9]+", value)]
        if kind == "card":
            return len(groups) == 1 or groups in _USUAL_CARDS
        if value[0] != "+" or not 9 <= sum(groups) <= 15 or text[end : end + 1] not in (" ", "."):
            return False
        if re.match(r"\+1(?![0-9])", value):
            return sum(groups) == 11
        if self._value_at(text, end + 1, [k for k in KINDS if k != "phone"]):
            return True
        return text[end] == " " and (groups[-1] >= 6 or value[-groups[-1] - 1] in "-.")

    def _value_at(self, text: str, start: int, kinds: Iterable[str] = KINDS) -> tuple[str, int] | None:
        """Kind and end of the value that begins here."""
        for kind in kinds:
            for end in self._ends(kind, text, start):
                if getattr(self, kind)(text[start:end]) is not None and not (kind == "card" and self._hides_card(text, start, end)):
                    return kind, end
        return None

    def _hides_card(self, text: str, start: int, end: int) -> bool:
        """Whether digits of an unusual form go into a card of usual form behind them."""
        cuts = [m.start() for m in _CUTS["card"].finditer(text, start, end)]
        if self._usual("card", text, start, end):
            return False
        for cut in cuts:
            for inner in self._ends("card", text, cut + 1):
                if self._usual("card", text, cut + 1, inner) and self.card(text[cut + 1 : inner]) is not None:
                    return True
        return False

    def _read(self, text: str) -> Iterator[tuple[int, str, int]]:
        """Start, kind and end of each value."""
        at = 0
        while found := _SHAPES.search(text, at):
            start = found.start()
            value = self._value_at(text, start)
            if value:
                yield start, *value
            at = value[1] if value else start + 1

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and kind, start and end of each in it."""
        out, spans, at, size = [], [], 0, 0
        for start, kind, end in self._read(text):
            new = getattr(self, kind)(text[start:end])
            size += start - at
            spans.append((kind, size, size + len(new)))
            out += text[at:start], new
            at, size = end, size + len(new)
        return "".join((*out, text[at:])), spans

    def restore(self, text: str, spans: Iterable[tuple[str, int, int]]) -> str:
        """The text with the values at ``spans`` moved as this object moves them (``back``)."""
        out, at = [], 0
        for kind, start, end in spans:
            out += text[at:start], getattr(self, kind)(text[start:end])
            at = end
        return "".join((*out, text[at:]))


_SIGN = re.compile("[0-9@]")


SPANS = "spans"
_SPAN = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
_ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def pseudonymize(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """Columns of ``docs``, the text replaced, the number of values of each kind as ``n_<kind>``, and
    ``spans`` of the pseudonyms (code points, the end exclusive).

    Columns of these names are replaced; the others pass through untouched.
    """
    counts = [f"n_{kind}" for kind in KINDS]
    docs = docs.drop(*(c for c in docs.columns if c in (*counts, SPANS)))
    names = docs.columns
    added = [*(StructField(c, LongType()) for c in counts), StructField(SPANS, ArrayType(_SPAN))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pseudonyms = Pseudonyms(key)
        for batch in batches:
            texts = (value.as_py() for value in batch.column(text_col))
            done = [pseudonyms.replace(t) if t and _SIGN.search(t) else (t, []) for t in texts]
            new = pa.array([t for t, _ in done], pa.string())
            columns = [new if c == text_col else batch.column(c) for c in names]
            numbers = [pa.array([sum(k == kind for k, *_ in spans) for _, spans in done], pa.int64()) for kind in KINDS]
            placed = pa.array([[dict(zip(("kind", "start", "end"), s)) for s in spans] for _, spans in done], pa.list_(_ARROW_SPAN))
            yield pa.RecordBatch.from_arrays([*columns, *numbers, placed], names=[*names, *counts, SPANS])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added]))


def restore(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """The result of ``pseudonymize`` with the same key, its texts as before; ``n_<kind>`` and ``spans`` go."""
    names = [c for c in docs.columns if c not in (*(f"n_{kind}" for kind in KINDS), SPANS)]
    schema = StructType([docs.schema[c] for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pseudonyms = Pseudonyms(key, back=True)
        for batch in batches:
            rows = zip(batch.column(text_col), batch.column(SPANS))
            texts = [
                pseudonyms.restore(text.as_py(), [tuple(s.values()) for s in spans.as_py()]) if spans.is_valid and len(spans) else text.as_py()
                for text, spans in rows
            ]
            new = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([new if c == text_col else batch.column(c) for c in names], names=names)

    return docs.mapInArrow(run, schema)
