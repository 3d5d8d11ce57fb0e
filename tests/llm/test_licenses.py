"""Licence sentences however they are wrapped, named licences and expressions, and a plain matcher beside them."""

import random
import re
import time

import pytest

from weighyard.llm import licenses

TEXTS = {
    "MIT": ("mit_grant", "mit_notice", "as_is_software", "no_liability"),
    "Apache-2.0": ("apache_reference", "apache_limit", "apache_copy", "apache_as_is"),
    "BSD-3-Clause": ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"),
    "BSD-2-Clause": ("bsd_grant", "bsd_source", "bsd_binary"),
    "GPL-3.0-or-later": ("gpl_free", "gpl_hope", "gpl_details"),
    "GPL-2.0-or-later": ("gpl2_free", "gpl_hope", "gpl_details"),
    "LGPL-2.1-or-later": ("lgpl_free", "lgpl_hope", "lgpl_details"),
    "AGPL-3.0-or-later": ("agpl_free", "gpl_hope", "agpl_details"),
    "MPL-2.0": ("mpl_form", "mpl_copy"),
    "ISC": ("isc_grant", "isc_as_is"),
    "CC0-1.0": ("cc0_waiver",),
}


def whole(name):
    return " ".join(licenses.SENTENCES[x][0] for x in TEXTS[name])


def wrapped(text, width):
    lines, line = [], ""
    for word in text.split():
        if line and len(line) + 1 + len(word) > width:
            lines.append(line)
            line = word
        else:
            line = f"{line} {word}".strip()
    return "\n".join([*lines, line])


def named(text):
    return [x[0] for x in licenses.matched_rules(licenses.sentence_ids(text))]


@pytest.mark.parametrize("width", [40, 60, 72, 76, 80, 100, 120, 10_000])
@pytest.mark.parametrize("name", TEXTS)
def test_wrapped_texts(name, width):
    text = f"Some words before.\n\n{wrapped(whole(name), width)}\n\nAnd more after."
    assert named(text) == [name]
    commented = "\n".join("# " + line for line in text.split("\n"))
    assert named(commented) == [name]


@pytest.mark.parametrize("line, expected", [
    ("SPDX-License-Identifier: MIT", ["MIT"]), ("// SPDX-License-Identifier: BSD-3-Clause", ["BSD-3-Clause"]),
    ("SPDX-License-Identifier: GPL-2.0-only", ["GPL-2.0-only"]), ("SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"]),
    ("SPDX-License-Identifier: (MPL-2.0 AND isc)", ["MPL-2.0", "ISC"]),
    ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", ["GPL-2.0-or-later"]),
    ("SPDX-License-Identifier: Foo-1.0", ["unknown"]), ("This software is licensed under the ISC License.", ["ISC"]),
    ("Distributed under the BSD 2-Clause License.", ["BSD-2-Clause"]), ("The MIT in Boston.", []), ("SPDX-License-Identifier:", []),
])
def test_named_licences(line, expected):
    assert named(f"Words.\n{line}\nMore.") == expected


def plain(text):
    """Every run of parts against the table, longest start first: what sentence_ids does without its shortcuts."""
    parts = [licenses.normalised(x) for x in re.split(r"(?<=[.;:!?])[!]*\s+|\n", text)]
    parts = [p for p in parts if p]
    out, at = [], 0
    while at < len(parts):
        for end in range(at + 1, len(parts) + 1):
            if " ".join(parts[at:end]) in licenses.KNOWN:
                out.append((licenses.KNOWN[" ".join(parts[at:end])], at, end - 1))
                at = end
                break
        else:
            at += 1
    return out


def test_against_a_plain_matcher():
    rng = random.Random(4)
    pool = [x for xs in licenses.SENTENCES.values() for x in xs if not x.startswith("SPDX")]
    for _ in range(150):
        pieces = [rng.choice(pool) if rng.random() < 0.6 else "Words of other kinds stand here." for _ in range(rng.randint(1, 8))]
        text = wrapped(rng.choice([" ", "\n", "\n\n"]).join(pieces), rng.choice([30, 50, 80, 1000]))
        assert [(a, d, e) for a, _, _, d, e in licenses.sentence_ids(text)] == plain(text)


def test_long_texts_of_starts_and_blank_lines_stay_linear():
    took = []
    for n in (4000, 16000):
        started = time.perf_counter()
        licenses.sentence_ids("Permission is\n" * n + "\n" * n + "Permission is hereby granted\n" * n)
        took.append(time.perf_counter() - started)
    assert took[1] < 12 * took[0] + 1


def test_spans_are_code_points_of_the_text():
    text = "Ünï. " + licenses.SENTENCES["cc_by"][0] + " Ende"
    (licence, start, end, restricted), = licenses.matched_rules(licenses.sentence_ids(text))
    assert (licence, text[start:end], restricted) == ("CC-BY-4.0", licenses.SENTENCES["cc_by"][0], False)
