from __future__ import annotations

import re
import textwrap

import pytest

from cmdlode.llm import license_scan as L

SCANNER = L.Scanner()


def _found(text):
    return [(f.license, text[f.start : f.end], f.missing, f.extra) for f in SCANNER.scan(text)]


@pytest.mark.parametrize("number", range(len(L.TEMPLATES)))
def test_every_template_finds_itself(number, prose):
    name, wording = L.TEMPLATES[number]
    for text in (wording, wording.upper(), f"{prose(40, 1)}.\n{wording}\n{prose(40, 2)}.", f"{prose(90, 3)}. {wording} {prose(90, 4)}."):
        found = SCANNER.scan(text)
        assert [(f.license, f.missing, f.extra) for f in found] == [(name, "", "")], text[:200]
        assert text[found[0].start : found[0].end].lower().strip(". /") == wording.lower().strip(". /")


def test_differences_are_told():
    text = "Licensed under the famous Apache License, Version 2.0."
    assert _found(text) == [("Apache-2.0", text[:-1], "", "famous")]
    assert _found("This work is licensed under GNU General Public License, version 3.")[0][2] == "the"


def test_words_that_tell_licenses_apart():
    assert _found("This work is licensed under the GNU General Public License, version 4.") == []
    assert _found("Released under the BUT License.") == []
    assert [f[0] for f in _found("Licensed under CC BY-NC-ND 4.0.")] == ["CC-BY-NC-ND-4.0"]


def test_two_statements_in_one_block():
    text = "Released under the MIT License. Licensed under CC BY 4.0."
    assert [f[0] for f in _found(text)] == ["MIT", "CC-BY-4.0"]


def test_no_statement(prose):
    for text in (None, "", "a driving licence", "He had no permission to copyright it.", prose(3000, 1) + " license " + prose(3000, 2)):
        assert SCANNER.scan(text) == []


def test_table(spark, docs, prose):
    line = "Released under the MIT License."
    frame = docs(line, None, "", (None, line), (0, line), prose(100, 1), "é𝔘\n" + line, prose(30_000, 2) + "\n" + line)
    rows = sorted(L.find_licenses(frame).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert [(r["doc_id"], r["license"], r["exact"]) for r in rows] == [(i, "MIT", True) for i in (0, 0, 6, 7, None)]
    assert rows[2]["start"] == 3 and rows[2]["given_bytes"] < rows[2]["plain_bytes"]
    assert L.find_licenses(frame.where("false")).count() == 0
    assert L.find_licenses(docs("a")).count() == 0


LINES = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "All rights reserved.": "proprietary",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
}


def test_lines_of_the_given_documents(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = [
        (r["doc_id"], m.start(), name)
        for r in frame.collect()
        for line, name in LINES.items()
        for m in re.finditer(re.escape(line), r["text"] or "")
    ]
    assert {name for *_, name in want} == set(LINES.values())
    assert sorted((r["doc_id"], r["start"], r["license"]) for r in L.find_licenses(frame).collect()) == sorted(want)


@pytest.mark.parametrize("sign", ["", "# ", " * ", "// ", "dnl "])
@pytest.mark.parametrize("number", range(len(L.TEMPLATES)))
def test_wrapped_notices(number, sign, prose):
    name, wording = L.TEMPLATES[number]
    lines = textwrap.wrap(wording, 70, break_long_words=False, break_on_hyphens=False)
    for before, after in (("", ""), (prose(300, 1) + "\n", "\n" + prose(300, 2)), ("He is the one, and this work to be.\n", "\nAny of the use in this.")):
        text = before + "\n".join(sign + line for line in lines) + after
        assert [(f.license, f.template, f.missing) for f in SCANNER.scan(text)] == [(name, number, "")], text


def test_no_statement_is_crowded_out():
    header = (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    )
    for statement, name in (("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Released under the BSD License.", "BSD"), ("All rights reserved.", "proprietary")):
        for text in (f"{header}\n{statement}", f"{statement}\n{header}", f"{header}\n{statement}\n{header}"):
            assert [f[:2] for f in _found(text)] == [(name, statement[:-1])]


def test_many_statements_side_by_side():
    line = "Released under the MIT License.\n"
    assert [(f.license, f.start) for f in SCANNER.scan(line * 2000)] == [("MIT", len(line) * i) for i in range(2000)]
    mixed = [L.TEMPLATES[i % 26] for i in range(300)]
    found = SCANNER.scan("\n".join(wording for _, wording in mixed))
    assert [(f.license, f.missing, f.extra) for f in found] == [(name, "", "") for name, _ in mixed]
