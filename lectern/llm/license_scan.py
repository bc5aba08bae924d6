"""License scans by sentence rules, in DataFrame functions alone.

A text is cut into segments (at stops followed by white space, and at blank lines).  Each line of a
segment, and then the whole segment where it has several lines, is normalised (A-Z lowered, runs
of anything but letters and digits to one space) and looked up among the parts of known licence
sentences.  A known sentence that has stops inside is met where all its parts follow one
another.  The identifiers met, in order of appearance, are matched against ordered rules: a rule
names identifiers that must come in that order, with others between them allowed.

One scan, no exchange, no Python; the sentence table is a literal of the plan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Sentences of public licences and of the notices that name them.
SENTENCES: dict[int, list[str]] = {
    1: ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "The MIT License (MIT)", "MIT License"],
    2: ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    3: ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    4: ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    10: ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License");', "This project is licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0."],
    11: ["you may not use this file except in compliance with the License."],
    12: ["You may obtain a copy of the License at"],
    13: ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    14: ["See the License for the specific language governing permissions and limitations under the License."],
    20: ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    21: ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."],
    22: ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."],
    23: ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    24: ["See the GNU General Public License for more details."],
    25: ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License."],
    26: ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    27: ["See the GNU Affero General Public License for more details."],
    28: ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    29: ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    30: ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    31: ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    32: ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    33: ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    40: ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    41: ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    42: ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    50: ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    51: ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    60: ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    70: ["This is free and unencumbered software released into the public domain."],
    80: ["This software is provided 'as-is', without any express or implied warranty."],
    81: ["In no event will the authors be held liable for any damages arising from the use of this software."],
    82: ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    90: ['Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'],
    91: ["Distributed under the Boost Software License, Version 1.0."],
    95: ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
}
# Names after "SPDX-License-Identifier:"; the k-th is identifier 200 + k.
SPDX = ["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"]
SENTENCES |= {200 + k: [f"SPDX-License-Identifier: {name}"] for k, name in enumerate(SPDX)}
# Fixed values: (licence, kind of evidence, identifiers in order).  A text may meet several.
RULES: list[tuple[str, str, list[int]]] = [
    ("MIT", "text", [2, 3, 4]),
    ("MIT", "notice", [1]),
    ("Apache-2.0", "header", [10, 11, 12, 13, 14]),
    ("Apache-2.0", "notice", [10]),
    ("GPL-3.0-or-later", "header", [21, 23, 24]),
    ("GPL-2.0-or-later", "header", [22, 23, 24]),
    ("GPL-3.0-only", "notice", [20]),
    ("BSD-3-Clause", "text", [30, 31, 32, 33]),
    ("BSD-2-Clause", "text", [30, 31, 32]),
    ("CC-BY-NC-4.0", "notice", [40]),
    ("CC-BY-4.0", "notice", [41]),
    ("CC-BY-SA-4.0", "notice", [42]),
    ("MPL-2.0", "header", [50, 51]),
    ("MPL-2.0", "notice", [50]),
    ("ISC", "text", [60]),
    ("Unlicense", "text", [70]),
    ("GPL-2.0-only", "header", [25, 23, 24]),
    ("AGPL-3.0-or-later", "header", [26, 23, 27]),
    ("LGPL-2.1-or-later", "header", [28]),
    ("LGPL-3.0-or-later", "header", [29]),
    ("Zlib", "text", [80, 81, 82]),
    ("BSL-1.0", "text", [90]),
    ("BSL-1.0", "notice", [91]),
    ("EPL-2.0", "header", [95]),
]
RULES += [(name, "spdx", [200 + k]) for k, name in enumerate(SPDX)]


#: Every known sentence has one of these words, and no line end can split one: a text with none has no identifier.
ANCHORS = r"license|permission|software|copyright|warranty|redistribution|(?<![a-z0-9])mpl(?![a-z0-9])"


def cut_sentences(text: str) -> list[str]:
    """The normalised sentences of a text, as the plan cuts them."""
    cut = re.sub(r"[.!?;:]+[ \t\r\n]+", "\n", text.translate(str.maketrans(UPPER, LOWER)))
    return [s.strip(" ") for s in re.sub(r"[^a-z0-9\n]+", " ", cut).split("\n")]


def sentence_parts() -> tuple[dict[str, str], list[tuple[str, str]]]:
    """Normalised part -> token, and (tokens that follow one another, identifier), longest first.

    A token stands in angle brackets.  That of a sentence without stops inside is its identifier; the parts
    of the others are numbered behind a p."""
    listed = [(i, [p for p in cut_sentences(t) if p]) for i, texts in SENTENCES.items() for t in texts]
    known = {parts[0]: f"<{i}>" for i, parts in listed if len(parts) == 1}
    sequences = []
    for i, parts in listed:
        if len(parts) > 1:
            for p in parts:
                if not known.setdefault(p, f"<p{len(known)}>").startswith("<p"):
                    raise ValueError(f"a sentence of its own and a part of another: {p}")
            sequences.append(("".join(known[p] for p in parts), f"<{i}>"))
    return known, sorted(sequences, key=lambda x: (-x[0].count("<"), x))


def _found(text: Column) -> Column:
    """Identifiers met, in order, each with a comma before and after the last: ``,2,3,4,``; a comma twice if none."""
    known, sequences = sentence_parts()
    cut = F.regexp_replace(F.translate(text, "\x01", " "), "[.!?;:]+[ \t\r\n]+", "\x01")
    plain = F.regexp_replace(F.regexp_replace(cut, "[^a-z0-9\n\x01]+", " "), "\n *(?:\n *)+", "\x01")
    lookup = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    one = lambda s: F.element_at(lookup, F.trim(s))
    whole = lambda s: F.when(F.instr(s, "\n") > 0, one(F.regexp_replace(s, " *\n *", " ")))
    # what has no known line or whole stands as <> between its neighbours
    token = lambda s: F.array_join(F.concat(F.transform(F.split(s, "\n"), one), F.array(whole(s))), "")
    met = F.array_join(F.transform(F.split(plain, "\x01"), lambda s: F.coalesce(F.nullif(token(s), F.lit("")), F.lit("<>"))), "")
    for tokens, i in sequences:
        met = F.replace(met, F.lit(tokens), F.lit(i))
    return F.concat(F.lit(","), F.regexp_replace(F.regexp_replace(F.regexp_replace(met, "<(p[0-9]+)?>", ""), "><", ","), "[<>]", ""), F.lit(","))


def _meets(ids: Column, rule: list[int]) -> Column:
    return ids.rlike("," + "".join(f"{i}," + ("(?:[0-9]+,)*" if k < len(rule) - 1 else "") for k, i in enumerate(rule)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentence_ids, licenses, evidence, n_licenses) for each row of ``docs``.

    ``sentence_ids`` are the identifiers met, joined by commas; ``licenses`` the
    distinct licences of the rules that hold, in the order of the rules, joined by commas, and
    ``evidence`` those rules as licence:kind.  Null and empty texts have empty lists; a null id
    stays null; repeated rows give repeated results.  Other columns are not read.
    """
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    rows = rows.select("doc_id", F.when(F.col("t").rlike(ANCHORS), _found(F.col("t"))).otherwise(",,").alias("ids"))
    evidence = F.filter(F.array(*(F.when(_meets(F.col("ids"), r), F.lit(f"{lic}:{kind}")) for lic, kind, r in RULES)), lambda x: x.isNotNull())
    rows = rows.select("doc_id", F.trim(F.col("ids"), F.lit(",")).alias("sentence_ids"), F.when(F.col("ids") != ",,", evidence).otherwise(F.array().cast("array<string>")).alias("e"))
    names = F.array_distinct(F.transform("e", lambda x: F.substring_index(x, ":", 1)))
    return rows.select("doc_id", "sentence_ids", F.array_join(names, ",").alias("licenses"), F.array_join("e", ",").alias("evidence"), F.size(names).cast("long").alias("n_licenses"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    parts, sequences = sentence_parts()
    known = ", ".join(f"({q(s)}, {q(t)})" for s, t in parts.items())
    met = "string_agg(token, '' ORDER BY seg)"
    for tokens, i in sequences:
        met = f"replace({met}, {q(tokens)}, {q(i)})"
    rule = lambda r: q("," + "".join(f"{i}," + ("(?:[0-9]+,)*" if k < len(r) - 1 else "") for k, i in enumerate(r)))
    when = ", ".join(f"CASE WHEN regexp_matches(ids, {rule(r)}) THEN {q(f'{lic}:{kind}')} END" for lic, kind, r in RULES)
    order = ", ".join(q(x) for x in dict.fromkeys(lic for lic, _, _ in RULES))
    return f"""
WITH known(s, token) AS (VALUES {known}),
d AS (SELECT doc_id, replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), chr(1), ' ') AS t FROM documents),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[.!?;:]+[ \\t\\r\\n]+', chr(1), 'g'), '[^a-z0-9\\n\\x01]+', ' ', 'g'), '\\n *(?:\\n *)+', chr(1), 'g') AS t FROM d),
g AS (SELECT doc_id, unnest(string_split(t, chr(1))) AS s, generate_subscripts(string_split(t, chr(1)), 1) AS seg FROM c),
l AS (
  SELECT doc_id, seg, unnest(string_split(s, chr(10))) AS part, generate_subscripts(string_split(s, chr(10)), 1) AS pos FROM g
  UNION ALL SELECT doc_id, seg, regexp_replace(s, ' *\\n *', ' ', 'g'), 2147483647 FROM g WHERE contains(s, chr(10))
),
k AS (SELECT doc_id, seg, coalesce(string_agg(token, '' ORDER BY pos), '<>') AS token FROM l LEFT JOIN known ON trim(part) = s GROUP BY 1, 2),
m AS (SELECT doc_id, regexp_replace({met}, '<(p[0-9]+)?>', '', 'g') AS met FROM k GROUP BY 1),
i AS (SELECT doc_id, ',' || regexp_replace(replace(met, '><', ','), '[<>]', '', 'g') || ',' AS ids FROM m),
e AS (SELECT doc_id, trim(ids, ',') AS sentence_ids, list_filter([{when}], lambda x: x IS NOT NULL) AS e FROM i),
n AS (SELECT *, list_filter([{order}], lambda x: list_contains(list_transform(e, lambda y: split_part(y, ':', 1)), x)) AS names FROM e)
SELECT doc_id, sentence_ids, array_to_string(names, ',') AS licenses, array_to_string(e, ',') AS evidence, CAST(len(names) AS BIGINT) AS n_licenses FROM n
"""


OP6_SQL = _sql()
