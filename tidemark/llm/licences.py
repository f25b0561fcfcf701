"""Licence scans by sentence rules, with Spark expressions only.

A text is normalised to lower-case words of letters and digits, with marks where a sentence may begin
or end: line ends, . ! ? ; : before a blank, and list numbers. A known licence sentence is found where
its words stand in a row from one mark to another, whatever marks are between, so it may be wrapped
over lines, with comment leaders, or share a line with others; one of LONG words or more needs no marks
around it. Of sentences that overlap the first counts, and of those with the same begin the longest.
The sentences stand in one pattern as a tree of their words, so a place in a text is compared with the
words that can follow, not with every sentence. The text's sequence of identifiers is matched against
licence rules, each a sequence of identifiers that must occur in a row: long rules first, and what a
rule has matched isn't matched by a shorter one again. Licences are reported in the order of the rules;
the first one is the text's licence. Sentences and rules are a parameter (RuleBase).

The SQL equivalent knows SENTENCES and RULES alone, and sentences that have a line or the space
between two of . ! ? to themselves; on such texts both give the same.

Defined results: a null, empty or licence-free text has no sentence, no rule and a null licence;
unknown sentences between known ones don't break a sequence; rules that match equally long sequences
tie and are both reported; repeated rows are scanned each; an empty table gives an empty result; further columns are ignored; whole texts are scanned, however
long.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known sentences, normalised; an identifier is the place in this list, from 1.
SENTENCES = [
    "this work is licensed under the gnu general public license version 3",
    "licensed under cc by nc 4 0",
    "released under the mit license",
    "licensed under the apache license version 2 0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "licensed under the apache license version 2 0 the license",
    "you may not use this file except in compliance with the license",
    "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "see the license for the specific language governing permissions and limitations under the license",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "see the gnu general public license for more details",
    "you should have received a copy of the gnu general public license along with this program",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "this source code form is subject to the terms of the mozilla public license v 2 0",
    "this is free and unencumbered software released into the public domain",
    "spdx license identifier mit",
    "spdx license identifier apache 2 0",
    "spdx license identifier gpl 3 0 only",
    "spdx license identifier bsd 3 clause",
    "licensed under cc by 4 0",
    "licensed under cc by sa 4 0",
    "this work is licensed under a creative commons attribution 4 0 international license",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "all rights reserved",
]
# The ordered rules; longer texts of a licence stand before its short notices.
RULES = [
    ("MIT", (5, 6)),
    ("MIT", (3,)),
    ("MIT", (23,)),
    ("Apache-2.0", (7, 8, 9, 10, 11)),
    ("Apache-2.0", (4,)),
    ("Apache-2.0", (24,)),
    ("GPL-3.0-or-later", (12, 14, 15)),
    ("GPL-2.0-or-later", (13, 14, 15)),
    ("GPL-3.0", (1,)),
    ("GPL-3.0", (25,)),
    ("BSD-3-Clause", (17, 18, 19, 20)),
    ("BSD-3-Clause", (26,)),
    ("BSD-2-Clause", (17, 18, 19)),
    ("MPL-2.0", (21,)),
    ("Unlicense", (22,)),
    ("CC-BY-NC-4.0", (2,)),
    ("CC-BY-NC-4.0", (30,)),
    ("CC-BY-SA-4.0", (28,)),
    ("CC-BY-4.0", (27,)),
    ("CC-BY-4.0", (29,)),
    ("Proprietary", (31,)),
]

# Further wordings, each a licence by itself, among them names of licences, which may
# have LEAD before and TAIL after them.
WORDINGS = [
    *[("MIT", s) for s in ("the mit license", "the mit license mit", "mit license mit")],
    ("Apache-2.0", "apache license version 2 0 january 2004"),
    ("GPL-3.0", "gnu general public license version 3 29 june 2007"),
    ("GPL-2.0", "gnu general public license version 2 june 1991"),
    ("MPL-2.0", "mozilla public license version 2 0"),
    *[("MPL-2.0", f"this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at {h} mozilla org mpl 2 0") for h in ("http", "https")],
]
NAMED = {
    "MIT": ["mit license", "mit licence"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache 2 0 license"],
    "GPL-3.0": ["gnu general public license version 3", "gnu general public license v3 0", "gnu gpl v3", "gpl v3", "gplv3", "gplv3 license"],
    "GPL-2.0": ["gnu general public license version 2", "gnu general public license v2 0", "gnu gpl v2", "gpl v2", "gplv2", "gplv2 license"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v 2 0"],
}
LEAD = "(?:(?:this|the) (?:project|software|work|code|program|library|file) is )?(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?"
TAIL = " see (?:the )?license(?: md| txt)?(?: license(?: md| txt)?)?(?: file)?(?: for (?:more )?(?:details|information))?"
SPDX = {
    "MIT": ["mit"], "Apache-2.0": ["apache 2 0"], "GPL-3.0-or-later": ["gpl 3 0 or later"], "GPL-2.0-or-later": ["gpl 2 0 or later"], "GPL-3.0": ["gpl 3 0", "gpl 3 0 only"], "GPL-2.0": ["gpl 2 0", "gpl 2 0 only"],
    "BSD-3-Clause": ["bsd 3 clause"], "BSD-2-Clause": ["bsd 2 clause"], "MPL-2.0": ["mpl 2 0"], "Unlicense": ["unlicense"], "CC-BY-NC-4.0": ["cc by nc 4 0"], "CC-BY-SA-4.0": ["cc by sa 4 0"], "CC-BY-4.0": ["cc by 4 0"],
}
# Sentences that begin the notices or texts of further licences.
TEXTS = [
    ("ISC", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("BSL-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software"),
    ("Zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("EPL-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("EPL-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0"),
    ("CC0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("WTFPL", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
]
# The notice of the GNU licences, by subject, name and version.
GNU = {"LGPL-2.1": ("library", "lesser ", "2 1"), "LGPL-3.0": ("library", "lesser ", "3"), "LGPL-3.0 ": ("program", "lesser ", "3"), "AGPL-3.0": ("program", "affero ", "3")}
TEXTS += [
    (f"{name.strip()}-or-later", f"this {subject} is free software you can redistribute it and or modify it under the terms of the gnu {kind}general public license as published by the free software foundation either version {version} of the license or at your option any later version")
    for name, (subject, kind, version) in GNU.items()
]
# Identifiers, each with its words; GNU ones have two more forms.
MORE_SPDX = ["ISC", "BSL-1.0", "Zlib", "EPL-2.0", "CC0-1.0", "WTFPL", "0BSD", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "EPL-1.0", "MPL-1.1", "Artistic-2.0", "PostgreSQL", "CC-BY-SA-3.0", "CC-BY-3.0", "OFL-1.1", "MIT-0"]
WORDINGS += [(name, s) for name, forms in NAMED.items() for s in forms]
WORDINGS += [(name, f"spdx license identifier {i}") for name, ids in SPDX.items() for i in ids]
for name in MORE_SPDX:
    ends = {"": "", "-only": "", "-or-later": "-or-later"} if "GPL" in name else {"": ""}
    WORDINGS += [(name + said, f"spdx license identifier {(name + form).lower().replace('-', ' ').replace('.', ' ')}") for form, said in ends.items()]
WORDINGS += TEXTS
# The full texts' own variants: MIT's second condition, Apache's address.
VARIANTS = [
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software",
    "you may obtain a copy of the license at https www apache org licenses license 2 0",
]
# Words from which a sentence needs no marks around it.
LONG = 12


class RuleBase:
    """sentences: normalised, identified by their place from 1; rules: (licence, identifiers), licences in
    the order of the rules; names: wordings that may have LEAD before and TAIL after them."""

    def __init__(self, sentences: list[str], rules: list[tuple[str, tuple[int, ...]]], names: list[str] = ()):
        self.sentences, self.rules, self.names = sentences, rules, list(names)

    @classmethod
    def default(cls) -> RuleBase:
        sentences = list(dict.fromkeys([*SENTENCES, *VARIANTS, *[s for _, s in WORDINGS]]))
        order = list(dict.fromkeys(name for name, _ in RULES))
        order.insert(order.index("GPL-3.0") + 1, "GPL-2.0")
        order += [name for name in dict.fromkeys(name for name, _ in WORDINGS) if name not in order]
        number = {s: i for i, s in enumerate(sentences, 1)}
        rules = [*RULES, ("MIT", (5, 32)), ("Apache-2.0", (7,)), ("Apache-2.0", (7, 8, 33, 10, 11)), *[(name, (number[s],)) for name, s in WORDINGS]]
        return cls(sentences, sorted(rules, key=lambda r: order.index(r[0])), [s for forms in NAMED.values() for s in forms])

    def triggers(self) -> list[str]:
        """Words of which every sentence has one: long ones, as they are rare in other texts, where it has any."""
        left, out = [set(s.split(" ")) for s in (*self.sentences, *self.names)], []
        while left:
            counts: dict[str, int] = {}
            for words in left:
                for w in words:
                    counts[w] = counts.get(w, 0) + 1
            out.append(max(sorted(counts), key=lambda w: (len(w) > 5, counts[w], len(w))))
            left = [words for words in left if out[-1] not in words]
        return out

    def pattern(self) -> str:
        """A known sentence from mark to mark, or of LONG words or more anywhere; its blanks may be marks."""
        long = [s for s in self.sentences if s.count(" ") + 1 >= LONG]
        short = [s for s in self.sentences if s.count(" ") + 1 < LONG]
        marked = [rf"(?<=\n){tree(short)}(?=\n)"] if short else []
        if self.names:
            marked.append(rf"(?<=\n)(?:{LEAD})?{tree(self.names)}(?:{TAIL})?(?=\n)".replace(" ", BLANK))
        return "|".join([*([rf"(?<=[ \n]){tree(long)}(?=[ \n])"] if long else []), *marked])


BLANK = r"[ \n]"


def tree(sentences: list[str]) -> str:
    """A pattern of these sentences that goes word by word: the longest one along a path."""
    top: dict = {}
    for s in sentences:
        node = top
        for word in s.split(" "):
            node = node.setdefault(word, {})
        node[""] = {}

    def written(node: dict, first: bool) -> str:
        rest = [("" if first else BLANK) + word + written(child, False) for word, child in sorted(node.items()) if word]
        if not rest:
            return ""
        both = "(?:" + "|".join(rest) + ")" if len(rest) > 1 else rest[0]
        return f"(?:{both})?" if "" in node else both

    return written(top, True)


def marked(text: Column) -> Column:
    """Words of a-z and 0-9 with a blank or, where a sentence may begin or end, a newline between them."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?m)^[ \t]*(?:dnl|rem)[ \t]", "")
    ends = F.regexp_replace(plain, r"([.!?;:][\"')\]]?)[ \t\r\n]+", "$1\n")
    ends = F.regexp_replace(ends, r"(?m)^([^a-z0-9\n]{0,20}[a-z0-9]{1,3}\))[ \t]+", "$1\n")
    words = F.concat(F.lit("\n"), F.regexp_replace(ends, r"[^a-z0-9\n]+", " "), F.lit("\n"))
    return F.regexp_replace(words, r" ?\n[ \n]*", "\n")


def key(ids: tuple[int, ...]) -> str:
    return "|" + "|".join(map(str, ids)) + "|"


def scan_licences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: RuleBase | None = None) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids, licences (names of matching rules, in order,
    comma-joined) and licence (the first, or null) of every text of df."""
    base = base or RuleBase.default()
    known = F.create_map(*[F.lit(x) for i, s in enumerate(base.sentences, 1) for x in (s, i)])
    # A text without any of these words holds no sentence, so that most texts aren't normalised at all.
    lower = F.lower(F.coalesce(df[text_col], F.lit("")))
    any_of = lambda x: reduce(Column.__or__, [F.contains(x, F.lit(w)) for w in base.triggers()], F.lit(False))
    may_hold = F.get(F.transform(F.array(lower), any_of), F.lit(0))
    marks = F.when(may_hold, marked(df[text_col])).otherwise("")
    held = F.transform(F.regexp_extract_all(marks, F.lit(base.pattern()), F.lit(0)), lambda s: F.translate(s, "\n", " "))
    name = lambda s: F.regexp_replace(s, f"^{LEAD}|{TAIL}$", "")
    ids = F.transform(held, lambda s: F.coalesce(F.try_element_at(known, s), F.try_element_at(known, name(s))))
    found = df.select(df[id_col].cast("long").alias("doc_id"), F.array_join(ids.cast("array<string>"), "|").alias("ids"))
    # Long rules first; what one has matched is marked as 0.
    order = {name: k for k, name in enumerate(dict.fromkeys(name for name, _ in base.rules))}
    rules = F.array(*[F.struct(F.lit(key(i)).alias("key"), F.lit(order[n]).alias("place")) for n, i in sorted(base.rules, key=lambda r: -len(r[1]))])
    start = F.struct(F.concat(F.lit("|"), F.col("ids"), F.lit("|")).alias("left"), F.array().cast("array<int>").alias("places"))
    step = lambda state, rule: F.when(F.contains(state["left"], rule["key"]), F.struct(F.replace(state["left"], rule["key"], F.lit("|0|")).alias("left"), F.array_append(state["places"], rule["place"]).alias("places"))).otherwise(state)
    places = F.when(F.col("ids") == "", F.array().cast("array<int>")).otherwise(F.aggregate(rules, start, step, lambda state: F.array_sort(F.array_distinct(state["places"]))))
    licences = F.array(*map(F.lit, order))
    names = F.transform(places, lambda k: F.get(licences, k))
    return found.select(
        "doc_id", F.when(F.col("ids") == "", F.lit(0)).otherwise(F.size(F.split("ids", r"\|"))).cast("long").alias("n_sentences"),
        F.col("ids").alias("sentence_ids"), F.array_join(names, ",").alias("licences"), F.try_element_at(names, F.lit(1)).alias("licence"),
    )


def oracle_sql() -> str:
    known = f"map([{', '.join(repr(s) for s in SENTENCES)}], [{', '.join(map(str, range(1, len(SENTENCES) + 1)))}])"
    rules = ", ".join(f"CASE WHEN contains('|' || ids || '|', '{key(i)}') THEN '{name}' END" for name, i in RULES)
    order = ", ".join(f"'{n}'" for n in dict.fromkeys(name for name, _ in RULES))
    return f"""
WITH parts AS (
  SELECT doc_id, list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)),
         lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))) AS normal FROM documents
), ids AS (
  SELECT doc_id, array_to_string(list_transform(list_filter(normal, lambda s: map_contains({known}, s)), lambda s: CAST({known}[s] AS VARCHAR)), '|') AS ids FROM parts
), named AS (
  SELECT doc_id, ids, list_filter([{order}], lambda n: list_contains([{rules}], n)) AS names FROM ids
)
SELECT doc_id, CAST(CASE WHEN ids = '' THEN 0 ELSE len(string_split(ids, '|')) END AS BIGINT) AS n_sentences, ids AS sentence_ids,
       array_to_string(names, ',') AS licences, names[1] AS licence FROM named
"""
