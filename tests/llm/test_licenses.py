import itertools
import textwrap

import pytest

from barvault.llm import licenses
from tests.llm.helpers import AWKWARD, documents, with_clashes


def text_of(*names, between="\n"):
    return between.join(licenses.TEXTS[n] for n in names)


MIT = text_of("mit-grant", "mit-notice", "mit-warranty")


def found(docs, **options):
    rows = licenses.scan_licenses(docs, **options).collect()
    return sorted(((r[0], r["n_known"], r["licenses"], len(r["matches"])) for r in rows), key=str)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Licensed under CC BY-NC 4.0.", (1, ["CC-BY-NC-4.0"], 1)),
        ("Words. This work is licensed under the GNU General Public License, version 3.\nMore.", (1, ["GPL-3.0"], 1)),
        ("RELEASED  under\tthe MIT License.  Licensed under the Apache License, Version 2.0", (2, ["Apache-2.0", "MIT"], 2)),
        ("SPDX-License-Identifier: MPL-2.0", (1, ["MPL-2.0"], 1)),
        ("// SPDX-License-Identifier: Apache-2.0\n", (1, ["Apache-2.0"], 1)),
        ("License: MIT", (1, ["MIT"], 1)),
        ("This project is MIT licensed.", (1, ["MIT"], 1)),
        ("SPDX-License-Identifier. MPL-2.0 and more", (0, [], 0)),
        ("SPDX License Identifier MPL-2.0", (1, ["MPL-2.0"], 1)),
        ("Copyright (c) someone\n\n" + MIT, (3, ["MIT"], 1)),
        (MIT.replace("\n", " "), (3, ["MIT"], 1)),
        ("# " + MIT.upper().replace("\n", "\n# "), (3, ["MIT"], 1)),
        (text_of("mit-notice", "mit-grant", "mit-warranty"), (3, [], 0)),
        (text_of("mit-grant", "mit-notice"), (2, [], 0)),
        (text_of("bsd-grant", "bsd-source", "bsd-binary"), (3, ["BSD-2-Clause"], 1)),
        (text_of("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"), (4, ["BSD-3-Clause"], 1)),
        (text_of("mit-grant", "mit-notice", "mit-warranty", between="\nother\n"), (3, ["MIT"], 1)),
        (text_of("mit-grant", "mit-notice", "mit-warranty", between="\nother" * 30 + "\n"), (3, [], 0)),
        ("the licence of this is unknown", (0, [], 0)),
        ("Licensed under CC BY-NC 4.0 and more.", (0, [], 0)),
    ],
)
def test_texts(spark, text, expected):
    assert found(documents(spark, [(1, text)])) == [(1, *expected)]


def test_every_rule_is_met_by_its_own_sentences(spark):
    known = {name: sentence for sentence, name in licenses.known_sentences().items()}
    assert len(licenses.known_sentences()) == len(known) - len(licenses.NAMES) + sum(
        len({licenses.normal_form(s.format(n)) for s in licenses.STATEMENTS for n in names}) for names in licenses.NAMES.values()
    )
    rows = [(i, "\n".join(known[s] for s in ids)) for i, (_, ids) in enumerate(licenses.rules())]
    got = found(documents(spark, rows))
    assert sorted((r[0], r[2]) for r in got) == [(i, [licence]) for i, (licence, _) in enumerate(licenses.rules())]


def test_awkward_rows_and_clashing_names(spark):
    rows = [*AWKWARD, (20, MIT), (20, MIT), (None, MIT)]
    got = found(with_clashes(documents(spark, rows)))
    assert len(got) == len(rows) and sum(r[2] == ["MIT"] for r in got) == 3
    assert found(documents(spark, [])) == []


def test_every_rule_is_met_by_its_own_punctuated_texts(spark):
    # a text without a closing stop, such as an address, ends with its line
    rows = [(i, text_of(*ids, between="  ").replace("LICENSE-2.0  ", "LICENSE-2.0\n")) for i, (_, ids) in enumerate(licenses.SEQUENCES)]
    expected = [(i, len(ids), [licence], 1) for i, (licence, ids) in enumerate(licenses.SEQUENCES)]
    assert found(documents(spark, rows)) == sorted(expected, key=str)


def test_statements_with_stops_are_known(spark):
    cases = [(n, f"{s.format(name)}.") for n, names in licenses.NAMES.items() for name in names for s in licenses.STATEMENTS]
    got = found(documents(spark, [(i, text) for i, (_, text) in enumerate(cases)]))
    assert sorted(got) == [(i, 1, [n], 1) for i, (n, _) in enumerate(cases)]


def test_nested_sentences_name_one_licence():
    """A shorter known sentence inside a longer one, which may take its place at a break, says no other licence."""
    known = licenses.known_sentences()
    of_text = {i: {licence for licence, ids in licenses.SEQUENCES if i in ids} for i in licenses.TEXTS}
    of_text |= {f"is:{licence}": {licence} for licence in licenses.NAMES}
    for inner, a in known.items():
        for outer, b in known.items():
            if inner != outer and f" {inner} " in f" {outer} ":
                assert of_text[a] == of_text[b], (inner, outer)


def test_wrapped_texts(spark):
    """Paragraphs wrapped at a width, in prose and in comment blocks."""
    rows, expected = [], []
    for width, mark in itertools.product((20, 44, 72, 80), ("", "# ", " * ", "    ")):
        for licence, ids in licenses.SEQUENCES:
            wrapped = [textwrap.wrap(licenses.TEXTS[name], width, break_long_words=False) for name in ids]
            lines = [mark + line for paragraph in wrapped for line in [*paragraph, ""]]
            rows.append((len(rows), "\n".join(["/*", *lines, "*/"])))
            expected.append(([licence], 1))
        rows.append((len(rows), f"{mark}This project is licensed under\n{mark}the MIT\n{mark}License."))
        expected.append((["MIT"], 1))
    got = found(documents(spark, rows))
    assert [(k, licences, n) for k, _, licences, n in sorted(got)] == [(i, *e) for i, e in enumerate(expected)]


APACHE = """
   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS.
"""
GPL = """
 This program is free software: you can redistribute it and/or modify
 it under the terms of the GNU General Public License as published by
 the Free Software Foundation, either version 3 of the License, or
 (at your option) any later version.

 This program is distributed in the hope that it will be useful,
 but WITHOUT ANY WARRANTY; without even the implied warranty of
 MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 GNU General Public License for more details.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""


def test_notices_as_they_are_printed(spark):
    texts = [(1, APACHE), (2, GPL), (3, BSD)]
    rows = [(k, t) for k, t in texts] + [(k + 10, t.replace("\n", "\n// ")) for k, t in texts]
    rows += [(k + 20, t.replace("\n", "\r\n")) for k, t in texts]
    names = {1: (2, ["Apache-2.0"], 1), 2: (2, ["GPL-3.0"], 1), 3: (3, ["BSD-2-Clause"], 1)}
    assert found(documents(spark, rows)) == sorted(((k, *names[k % 10]) for k, _ in rows), key=str)


def test_every_licence_is_found_by_its_tag(spark):
    rows = [(i, f"/* SPDX-License-Identifier: {name} */") for i, name in enumerate(licenses.NAMES)]
    assert [r[2] for r in sorted(found(documents(spark, rows)), key=lambda r: r[0])] == [[name] for name in licenses.NAMES]


def test_pieces_of_matches(spark):
    text = "One.\nThis Source Code Form is subject\nto the terms of the Mozilla Public License, v. 2.0.\nEnd."
    row = licenses.scan_licenses(documents(spark, [(1, text)])).first()
    assert [tuple(m) for m in row["matches"]] == [("MPL-2.0", 1, 3)]
