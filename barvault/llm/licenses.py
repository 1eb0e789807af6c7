"""Licences of documents, recognised by known sentences in the order that rules ask for."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barvault.llm.support import ascii_lower, indices, let, row_key
from barvault.operators.joins import join_unique

GAP = 8

# Names under which licences are stated, by identifier.
NAMES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("the apache license, version 2.0", "the apache license 2.0", "apache-2.0"),
    "MIT": ("the mit license", "mit"),
    "ISC": ("the isc license", "isc"),
    "BSD-2-Clause": ("the 2-clause bsd license", "the simplified bsd license", "bsd-2-clause"),
    "BSD-3-Clause": ("the 3-clause bsd license", "the new bsd license", "bsd-3-clause"),
    "GPL-2.0": ("the gnu general public license, version 2", "the gnu general public license version 2", "gpl-2.0"),
    "GPL-3.0": ("the gnu general public license, version 3", "the gnu general public license version 3", "gpl-3.0"),
    "LGPL-2.1": ("the gnu lesser general public license, version 2.1", "lgpl-2.1"),
    "LGPL-3.0": ("the gnu lesser general public license, version 3", "lgpl-3.0"),
    "AGPL-3.0": ("the gnu affero general public license, version 3", "agpl-3.0"),
    "MPL-2.0": ("the mozilla public license, version 2.0", "the mozilla public license, v. 2.0", "mpl-2.0"),
    "Unlicense": ("the unlicense", "unlicense"),
    "Zlib": ("the zlib license", "zlib"),
    "CC0-1.0": ("cc0 1.0", "cc0 1.0 universal", "cc0-1.0"),
    "CC-BY-4.0": ("cc by 4.0", "cc-by-4.0", "a creative commons attribution 4.0 international license"),
    "CC-BY-SA-4.0": ("cc by-sa 4.0", "cc-by-sa-4.0", "a creative commons attribution-sharealike 4.0 international license"),
    "CC-BY-NC-4.0": ("cc by-nc 4.0", "cc-by-nc-4.0", "a creative commons attribution-noncommercial 4.0 international license"),
    "CC-BY-ND-4.0": ("cc by-nd 4.0", "cc-by-nd-4.0", "a creative commons attribution-noderivatives 4.0 international license"),
    "CC-BY-NC-SA-4.0": ("cc by-nc-sa 4.0", "cc-by-nc-sa-4.0"),
    "CC-BY-NC-ND-4.0": ("cc by-nc-nd 4.0", "cc-by-nc-nd-4.0"),
}

# Ways to state them; each makes a sentence with each name.
STATEMENTS = (
    "licensed under {}", "released under {}", "distributed under {}", "available under {}",
    "this work is licensed under {}", "this file is licensed under {}", "this project is licensed under {}",
    "this software is licensed under {}", "this program is licensed under {}",
    "this software is released under {}", "this project is released under {}",
    "spdx-license-identifier: {}", "license: {}", "licence: {}", "this project is {} licensed",
    "this software is {} licensed", "this project uses {}",
)

# Sentences of licence texts and notices, by identifier.
TEXTS: dict[str, str] = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial "
    "portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
    "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
    "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "isc-liability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR "
    "ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR "
    "OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
    "PURPOSE ARE DISCLAIMED.",
    "bsd-liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, "
    "and to alter it and redistribute it freely, subject to the following restrictions:",
    "apache-grant": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is "
    "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
    "any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
    "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) "
    "any later version.",
    "lgpl-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
    "option) any later version.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
    "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
    "option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
    "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
    "option) any later version.",
    "cc0-dedication": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring "
    "rights to this software to the public domain worldwide.",
    "cc0-warranty": "This software is distributed without any warranty.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl-source": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
    "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

# Rules beyond single statements: a licence and the sentences that have to follow each other.
# A licence has several where a notice or a text is often given in part; the longest one that is met counts.
SEQUENCES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("ISC", ("isc-grant", "isc-warranty", "isc-liability")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Zlib", ("zlib-warranty", "zlib-liability", "zlib-grant")),
    ("Apache-2.0", ("apache-grant", "apache-copy", "apache-basis", "apache-see")),
    ("Apache-2.0", ("apache-grant", "apache-copy")),
    ("GPL-2.0", ("gpl2-free", "gpl-hope")),
    ("GPL-3.0", ("gpl-free", "gpl-hope")),
    ("LGPL-2.1", ("lgpl21-free", "lgpl-hope")),
    ("LGPL-3.0", ("lgpl-free", "lgpl-hope")),
    ("AGPL-3.0", ("agpl-free", "gpl-hope")),
    ("CC0-1.0", ("cc0-dedication", "cc0-warranty")),
    ("CC0-1.0", ("cc0-dedication",)),
    ("MPL-2.0", ("mpl-source", "mpl-copy")),
    ("MPL-2.0", ("mpl-source",)),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Unlicense", ("unlicense-free",)),
)

SENTENCE_END = r"([.!?:;])[\t\n\x0B\f\r ]+"

# What may stand between words of a known sentence, at stops it has itself, and behind it. Lines may be wrapped anywhere.
WITHIN_PIECE = "(?: |\n+)"
AT_STOP = "(?: |S?\n+)"
END = "(?=S?\n)"


def normal_form(sentence: str) -> str:
    """Letters and digits in lower case, runs of all else as one space."""
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in sentence).lower()
    return " ".join(words.split())


def known_texts() -> list[str]:
    """The sentences of licence texts and all statements, as they are written."""
    stated = [statement.format(name) for names in NAMES.values() for name in names for statement in STATEMENTS]
    return [text.lower() for text in TEXTS.values()] + stated


def known_sentences() -> dict[str, str]:
    """Normalised sentence -> identifier. Every statement of a licence has the identifier ``is:`` + licence."""
    known = {normal_form(text): name for name, text in TEXTS.items()}
    for licence, names in NAMES.items():
        for statement in STATEMENTS:
            known |= {normal_form(statement.format(name)): f"is:{licence}" for name in names}
    return known


def known_pieces() -> list[tuple[tuple[str, ...], str]]:
    """(normalised pieces, identifier) of all known sentences, cut at their own stops and whole."""
    known = known_sentences()
    cut = {tuple(map(normal_form, re.sub(SENTENCE_END, r"\1\n", text).split("\n"))): known[normal_form(text)] for text in known_texts()}
    return sorted((cut | {(sentence,): name for sentence, name in known.items()}).items())


def rules() -> list[tuple[str, tuple[str, ...]]]:
    """(licence, sentence identifiers in order): longer rules first, so that they can replace shorter ones."""
    stated = [(licence, (f"is:{licence}",)) for licence in NAMES]
    return sorted([*SEQUENCES, *stated], key=lambda rule: (-len(rule[1]), rule))


def lines_of_words(text: Column) -> Column:
    """The normalised pieces of a text, cut at line breaks and at stops before white space: a line break before each
    piece and after the last, and an S before those that stand for a stop."""
    cut = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), SENTENCE_END, "$1S\n")
    words = F.regexp_replace(F.concat(F.lit("\n"), cut, F.lit("\n")), "[^a-z0-9S\n]+", " ")
    return F.regexp_replace(words, " ?(S?\n) ?", "$1")


def sentence_pattern() -> str:
    """A regular expression for a break and any known sentence up to a break, cut like the pieces of documents.

    The alternatives are a tree of words, so that a piece is given up at its first strange word. A sentence that
    ends at a break counts there, even where a longer one goes on: see the test of nested sentences.
    """
    tree: dict = {}
    for text in known_texts():
        node, after = tree, ""
        for piece in re.sub(SENTENCE_END, r"\1\n", text).split("\n"):
            for word in normal_form(piece).split(" "):
                node = node.setdefault((after, word), {})
                after = WITHIN_PIECE
            after = AT_STOP
        node[END] = {}

    def listed(node: dict) -> str:
        ways = [END] if END in node else []
        ways += [k[0] + k[1] + listed(node[k]) for k in sorted(k for k in node if k != END)]
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    return f"\n({listed(tree)})"


def marked_sentences(text: Column) -> Column:
    """(pos, last, sentence) of each known sentence of a text: the numbers of its first and last piece, and its words.
    Null without any."""

    def numbers(pieces: Column, test: Callable[[Column], Column]) -> Column:
        return F.filter(F.transform(pieces, lambda p, i: F.when(test(p), i)), lambda i: i.isNotNull())

    def listed(marked: Column) -> Column:
        # the first of the split is what stands before the first break
        pieces = let(F.split(marked, "\n"), lambda p: F.slice(p, 2, F.size(p)))
        found = F.transform(
            F.regexp_extract_all(marked, F.lit("<([^>]*)>"), F.lit(1)), lambda s: F.regexp_replace(s, "S?\n+", " ")
        )
        return let(
            pieces,
            lambda p: F.arrays_zip(
                numbers(p, lambda piece: piece.startswith("<")).alias("pos"),
                numbers(p, lambda piece: piece.contains(">")).alias("last"),
                found.alias("sentence"),
            ),
        )

    marked = F.regexp_replace(lines_of_words(text), sentence_pattern(), "\n<$1>")
    return let(marked, lambda m: F.when(m.contains("<"), listed(m)))


def sentence_table(spark: SparkSession) -> DataFrame:
    """(sentence, sentence_id): a fixed table of some hundred rows."""
    known = known_sentences()
    pairs = ", ".join(f"('{text}', '{name}')" for text, name in sorted(known.items()))
    return spark.sql(f"SELECT * FROM VALUES {pairs} AS t(sentence, sentence_id)")


def _rule_array() -> Column:
    listed = [
        F.struct(F.lit(licence).alias("licence"), F.array(*[F.lit(i) for i in ids]).alias("ids")) for licence, ids in rules()
    ]
    return F.array(*listed)


def identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row_id, pos, last, sentence_id) for every known sentence of a document."""
    found = docs.select(row_key(key, text).alias("row_id"), F.explode(marked_sentences(F.col(text))).alias("met"))
    known = F.broadcast(sentence_table(docs.sparkSession))
    return found.select("row_id", "met.*").join(known, "sentence").select("row_id", "pos", "last", "sentence_id")


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", gap: int = GAP) -> DataFrame:
    """(key, n_known, licenses, matches) per row of ``docs``.

    A text is cut into pieces at line breaks and at stops before white space; a known sentence is one piece or several
    that follow each other: it may be wrapped at any word, with comment marks and empty lines between, but holds no
    stops besides its own.
    ``n_known`` counts known sentences, ``licenses`` are the identifiers of all rules met, sorted and distinct, and
    ``matches`` lists (licence, first, last): the piece numbers of each rule that is met where its sentences
    follow each other among the known ones, at most ``gap`` other pieces apart. Where a rule's sentences begin
    a longer rule's that is met, the longer one counts. A null or empty text has no licences; repeated
    rows come back as often as they are there; an empty table gives an empty result.
    """
    per_doc = (
        identified(docs, key, text)
        .groupBy("row_id")
        .agg(F.array_sort(F.collect_set(F.struct("pos", "last", "sentence_id"))).alias("found"))
    )

    def apart(run: Column) -> Column:
        """Pieces from the first sentence to the last, each sentence taken as one piece."""
        inner = F.aggregate(run, F.lit(0), lambda n, x: n + x["last"] - x["pos"])
        return F.element_at(run, -1)["last"] - F.element_at(run, 1)["pos"] - inner

    def at(found: Column, i: Column) -> Column:
        """The rule that matches from the i-th known sentence on: the longest comes first in the list."""
        met = F.filter(
            _rule_array(),
            lambda rule: let(
                F.slice(found, i + 1, F.size(rule["ids"])),
                lambda run: (F.transform(run, lambda x: x["sentence_id"]) == rule["ids"])
                & (apart(run) <= (F.size(rule["ids"]) - 1) * (gap + 1)),
            ),
        )
        return let(
            F.get(met, F.lit(0)),
            lambda rule: F.when(
                rule.isNotNull(),
                F.struct(
                    rule["licence"].alias("licence"),
                    F.get(found, i)["pos"].alias("first"),
                    F.get(found, i + F.size(rule["ids"]) - 1)["last"].alias("last"),
                ),
            ),
        )

    matches = let(
        F.col("found"),
        lambda found: F.filter(F.transform(indices(F.size(found)), lambda i: at(found, i)), lambda m: m.isNotNull()),
    )
    matched = per_doc.select("row_id", F.size("found").alias("n_known"), matches.alias("matches"))
    rows = docs.select(row_key(key, text).alias("row_id"), F.col(key).alias(key))
    none = F.array().cast("array<struct<licence:string,first:int,last:int>>")
    return join_unique(rows, matched, ["row_id"]).select(
        key,
        F.coalesce("n_known", F.lit(0)).alias("n_known"),
        F.array_sort(F.array_distinct(F.transform(F.coalesce("matches", none), lambda m: m["licence"]))).alias("licenses"),
        F.coalesce("matches", none).alias("matches"),
    )
