"""License scans by sentence rules.

A text is cut into sentences; a sentence is normalised (lower case, letters and figures
only) and looked up among known licence sentences, which gives it
an identifier. Sentences of several lines are put together again, however they are wrapped. Sentences
that are not known break a sequence only where more than `GAP` of them follow each other; parts
without a letter or figure are no sentences. Ordered rules then look at the sequence of identifiers, longest rule
first: where a rule's identifiers occur in its order, it names the licence and consumes them.
Identifiers that no rule consumes are reported as an unknown licence text.

The sentence table and the rules are fixed and small; they travel with the task. Rows are
handled one by one, so there is no shuffle and no hot group.

Cases: a null or empty text has no licence. Null ids and repeated rows are carried. Very long texts are
read whole. An empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighyard.llm.common import col, text_of

#: Unknown sentences that may stand between two sentences of one licence.
GAP = 2

# --- fixed values: sentences of public licence texts and what they are called ---------------------
SENTENCES = {
    "mit_grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit_notice": ["The above copyright notice and this permission notice shall be included in all copies or "
                   "substantial portions of the Software."],
    "as_is_software": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
                       "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
                       "NONINFRINGEMENT."],
    "no_liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
                     "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
                     "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "mit_reference": ["Released under the MIT License.", "Licensed under the MIT License.",
                      "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "apache_reference": ["Licensed under the Apache License, Version 2.0.",
                         "Licensed under the Apache License, Version 2.0 (the \"License\");",
                         "Released under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "apache_limit": ["you may not use this file except in compliance with the License."],
    "apache_copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "apache_as_is": ["Unless required by applicable law or agreed to in writing, software distributed under the License "
                     "is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express "
                     "or implied."],
    "gpl3_reference": ["This work is licensed under the GNU General Public License, version 3.",
                       "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "gpl2_free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                  "General Public License as published by the Free Software Foundation; either version 2 of the License, "
                  "or (at your option) any later version."],
    "lgpl_free": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                  "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
                  "License, or (at your option) any later version."],
    "lgpl_hope": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "lgpl_details": ["See the GNU Lesser General Public License for more details."],
    "agpl_free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                  "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
                  "License, or (at your option) any later version."],
    "agpl_details": ["See the GNU Affero General Public License for more details."],
    "mpl_form": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "mpl_copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
                 "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "isc_grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
                  "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "isc_as_is": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
                  "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "cc0_waiver": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights "
                   "to this work."],
    "gpl_free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                 "or (at your option) any later version."],
    "gpl_hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "gpl_details": ["See the GNU General Public License for more details."],
    "cc_by_nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc_by": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.",
              "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "bsd_grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted "
                  "provided that the following conditions are met:"],
    "bsd_source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and "
                   "the following disclaimer."],
    "bsd_binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
                   "and the following disclaimer in the documentation and/or other materials provided with the "
                   "distribution."],
    "bsd_endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                    "promote products derived from this software without specific prior written permission."],
}
#: Ordered rules: (licence, identifiers in order, whether its use is restricted).
RULES = [
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"), False),
    ("MIT", ("mit_grant", "mit_notice", "as_is_software", "no_liability"), False),
    ("Apache-2.0", ("apache_reference", "apache_limit", "apache_copy", "apache_as_is"), False),
    ("GPL-3.0-or-later", ("gpl_free", "gpl_hope", "gpl_details"), True),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary"), False),
    ("MIT", ("mit_grant", "mit_notice", "as_is_software"), False),
    ("Apache-2.0", ("apache_reference", "apache_limit"), False),
    ("MIT", ("mit_grant", "mit_notice"), False),
    ("GPL-3.0-or-later", ("gpl_free",), True),
    ("MIT", ("mit_reference",), False),
    ("Apache-2.0", ("apache_reference",), False),
    ("GPL-3.0-only", ("gpl3_reference",), True),
    ("CC-BY-NC-4.0", ("cc_by_nc",), True),
    ("CC-BY-4.0", ("cc_by",), False),
    ("LGPL-2.1-or-later", ("lgpl_free", "lgpl_hope", "lgpl_details"), True),
    ("AGPL-3.0-or-later", ("agpl_free", "gpl_hope", "agpl_details"), True),
    ("GPL-2.0-or-later", ("gpl2_free", "gpl_hope", "gpl_details"), True),
    ("MPL-2.0", ("mpl_form", "mpl_copy"), True),
    ("ISC", ("isc_grant", "isc_as_is"), False),
    ("LGPL-2.1-or-later", ("lgpl_free",), True),
    ("AGPL-3.0-or-later", ("agpl_free",), True),
    ("GPL-2.0-or-later", ("gpl2_free",), True),
    ("MPL-2.0", ("mpl_form",), True),
    ("ISC", ("isc_grant",), False),
    ("CC0-1.0", ("cc0_waiver",), False),
]
#: Further licences that are named in one sentence: identifier -> (full name, whether its use is restricted).
NAMED = {
    "MIT": ("MIT License", False), "Apache-2.0": ("Apache License 2.0", False),
    "BSD-2-Clause": ("BSD 2-Clause License", False), "BSD-3-Clause": ("BSD 3-Clause License", False),
    "ISC": ("ISC License", False), "CC0-1.0": ("CC0 1.0 Universal", False), "Unlicense": ("Unlicense", False),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0", False), "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0", True),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0", True),
    "GPL-2.0-only": ("GNU General Public License v2.0", True), "GPL-2.0-or-later": ("GNU General Public License v2.0 or later", True),
    "GPL-3.0-only": ("GNU General Public License v3.0", True), "GPL-3.0-or-later": ("GNU General Public License v3.0 or later", True),
    "LGPL-2.1-only": ("GNU Lesser General Public License v2.1", True), "LGPL-2.1-or-later": ("GNU Lesser General Public License v2.1 or later", True),
    "LGPL-3.0-only": ("GNU Lesser General Public License v3.0", True), "LGPL-3.0-or-later": ("GNU Lesser General Public License v3.0 or later", True),
    "AGPL-3.0-only": ("GNU Affero General Public License v3.0", True), "AGPL-3.0-or-later": ("GNU Affero General Public License v3.0 or later", True),
    "MPL-2.0": ("Mozilla Public License 2.0", True),
}
UNKNOWN = "unknown"

#: A sentence ends at a line end that follows a sign of its end, at an empty line, or after a sign and
#: white space; a figure's point is none, since no white space follows it.
_END = re.compile(r"(?<=[.;:!?])[!]*\s+|\n")
_OTHER = re.compile(r"[^a-z0-9]+")


def normalised(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.lower()).strip()


#: How a sentence names a licence.
NAMING = ("Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "This project is licensed under the {}.",
          "This work is licensed under the {}.", "This software is licensed under the {}.")


def _known() -> dict[str, str]:
    """Normalised sentences and what they are called; `name:` is followed by the licence that a sentence names."""
    table = {normalised(way.format(name)): f"name:{licence}" for licence, (name, _) in NAMED.items() for way in NAMING}
    return table | {normalised(sentence): name for name, sentences in SENTENCES.items() for sentence in sentences}


KNOWN = _known()
#: Sentences of several lines are put together again up to the most words that any known one has.
_LONGEST = max(len(key.split()) for key in KNOWN)
_STARTS = {" ".join(key.split()[:2]) for key in KNOWN} | {key.split()[0] for key in KNOWN}
#: An identifier line with an expression: licences, brackets, and the words between them.
_EXPRESSION = re.compile(r"SPDX-License-Identifier:[ \t(]*([A-Za-z0-9.+-]+(?:[ \t()]+[A-Za-z0-9.+-]+)*)")
_BY_CASE = {licence.lower(): licence for licence in NAMED}


def expression_ids(sentence: str) -> list[str]:
    """The licences of an identifier line, in order; an unknown one is named `unknown`, exceptions are left out."""
    found = _EXPRESSION.search(sentence)
    if not found:
        return []
    words = re.split(r"[ \t()]+", found.group(1))
    out, skip = [], False
    for word in words:
        if word.upper() in ("OR", "AND", "WITH"):
            skip = word.upper() == "WITH"
        elif not skip:
            out.append(_BY_CASE.get(word.rstrip(".").lower(), UNKNOWN))
    return out


def sentence_ids(text: str) -> list[tuple[str, int, int, int, int]]:
    """(identifier, start, end, first part, last part) of all known sentences, in order.

    Parts are what stands between sentence ends and line ends; those without a word are left out. A
    sentence that goes on is put together word by word, so a text costs its length times a constant.
    """
    parts, at = [], 0
    for start, end in [*((m.start(), m.end()) for m in _END.finditer(text)), (len(text), len(text))]:
        key = normalised(text[at:start])
        if key:
            parts.append((key, at, start))
        at = end
    found, number = [], 0
    while number < len(parts):
        key, start, end = parts[number]
        last = number
        words = key.split()
        named = []
        if key.startswith("spdx license identifier"):  # its colon ends a part; the expression is the line's rest
            line_end = text.find("\n", start) % (len(text) + 1)
            named = expression_ids(text[start:line_end])
            while named and last + 1 < len(parts) and parts[last + 1][1] < line_end:
                last += 1
            found += [(f"name:{licence}", start, parts[last][2], number, last) for licence in named]
        if not named and " ".join(words[:2]) in _STARTS:
            while key not in KNOWN and last + 1 < len(parts) and len(words) < _LONGEST:
                last += 1
                words += parts[last][0].split()
                key = " ".join(words)
            if key in KNOWN:
                found.append((KNOWN[key], start, parts[last][2], number, last))
            else:
                last = number
        number = last + 1
    return found


def matched_rules(ids: list[tuple[str, int, int, int, int]]) -> list[tuple[str, int, int, bool]]:
    """(licence, start, end, restricted) of the rules that consume the identifiers, in text order."""
    out, at = [], 0
    while at < len(ids):
        name, start, end, _, _ = ids[at]
        if name.startswith("name:"):
            licence = name.removeprefix("name:")
            out.append((licence, start, end, NAMED.get(licence, ("", True))[1]))
            at += 1
            continue
        for licence, sequence, restricted in RULES:
            part = ids[at:at + len(sequence)]
            close = all(after[3] - before[4] - 1 <= GAP for before, after in zip(part, part[1:], strict=False))
            if tuple(x[0] for x in part) == sequence and close:
                out.append((licence, start, part[-1][2], restricted))
                at += len(sequence)
                break
        else:
            out.append((UNKNOWN, start, end, True))
            at += 1
    return out


_FOUND = "array<struct<license: string, start: int, end: int, restricted: boolean>>"


def scan(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    """Per row: doc_id, `sentences` (identifiers in order) and `found` (license, start, end, restricted).

    Positions count code points, ends are exclusive.
    """
    def run(batches):
        for batch in batches:
            ids = [sentence_ids(body) for body in batch["body"].to_pylist()]
            found = [[dict(zip(("license", "start", "end", "restricted"), x, strict=True)) for x in matched_rules(row)]
                     for row in ids]
            kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                       ("restricted", pa.bool_())]))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([[x[0] for x in row] for row in ids], pa.list_(pa.string())),
                 pa.array(found, kind)], names=["doc_id", "sentences", "found"])

    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("body"))
    return rows.mapInArrow(run, f"doc_id long, sentences array<string>, found {_FOUND}")


def licenses(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    """Per row: doc_id, the distinct licences by name, their spans and whether one restricts use."""
    return scan(docs, text, doc_id).select(
        "doc_id", F.array_join(F.array_sort(F.array_distinct(F.col("found.license"))), ",").alias("licenses"),
        F.expr("array_join(transform(found, x -> concat_ws(':', x.license, x.start, x.end)), ',')").alias("spans"),
        F.size("sentences").cast("long").alias("n_sentences"),
        F.expr("exists(found, x -> x.restricted)").alias("restricted"))
