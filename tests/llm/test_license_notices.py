"""License notices as they are written: wrapped, hyphenated, tagged, as titles."""

import os
import time

import numpy as np
import pandas as pd
import pytest
from codestrata.llm import license_scan


def found(text):
    return [f.license for f in license_scan.scanner(license_scan.TEMPLATES, 3, 0.15).scan(text)]


@pytest.mark.parametrize("text,name", [
    ("This work is licensed under a Creative Commons\nAttribution 4.0 International License.", "CC-BY-4.0"),
    ("Licensed under the Apache License,\nVersion 2.0.", "Apache-2.0"),
    ("# Some tool\n#\n# Licensed under the Apache License,\n# Version 2.0.\n#\n# More words", "Apache-2.0"),
    ("/*\n * This project is licensed under the\n * terms of the MIT license.\n */\nint main;", "MIT"),
])
def test_wrapped_notices(text, name):
    assert found(text) == [name]


def test_notices_on_lines_of_their_own():
    assert found("Licensed under the MIT License\nAll rights reserved\n") == ["MIT", "Proprietary"]


def full(name, start):
    return next(t for n, t in license_scan.TEMPLATES if n == name and t.startswith(start) and len(t) > 300)


def test_every_license_of_a_block():
    apache, gpl, isc = full("Apache-2.0", "Licensed under"), full("GPL-3.0", "This program"), full("ISC", "Permission to use")
    mit, bsd = full("MIT", "Permission is"), full("BSD-3-Clause", "Redistribution")
    assert found(gpl + "\n\nor\n\n" + apache) == ["GPL-3.0", "Apache-2.0"]
    assert found(isc + "\n\n" + isc) == ["ISC", "ISC"]
    assert found(mit + "\n\nCopyright (c) Other\n\n" + bsd) == ["MIT", "BSD-3-Clause"]
    assert found(isc + "\n" + isc.replace("copyright notice", "copyright note") + "\n" + apache + "\n" + isc) == ["ISC", "ISC", "Apache-2.0", "ISC"]


def test_two_notices_in_one_sentence():
    assert found("Licensed under the MIT License, or licensed under the Apache License, Version 2.0, as you like.") == ["MIT", "Apache-2.0"]


@pytest.mark.parametrize("text,names", [
    ("Distributed under the MIT License.", ["MIT"]),
    ("Licensed under the terms of the MIT License.", ["MIT"]),
    ("This software is released under the terms of the MIT license.", ["MIT"]),
    ("The code is available under the Apache License 2.0.", ["Apache-2.0"]),
    ("It is distributed under version 2 of the GNU General Public License.", ["GPL-2.0"]),
    ("Released under GPLv3.", ["GPL-3.0"]),
    ("Licensed under either the MIT license or the Apache License, Version 2.0 at your option.", ["MIT", "Apache-2.0"]),
    ("This text is licensed under the terms of CC BY-SA 4.0.", ["CC-BY-SA-4.0"]),
    ("You need a license to drive under the bridge of MIT.", []),
    ("Not everything was released under Apache rule.", []),
])
def test_usual_wordings(text, names):
    assert found(text) == names


@pytest.mark.parametrize("text,names", [
    ("All rights\nreserved.", ["Proprietary"]),
    ("# All rights\n# reserved.", ["Proprietary"]),
    ("This work is dedicated to the public\ndomain under CC0 1.0.", ["CC0-1.0"]),
    ("This work is dedicated to the public-domain under CC0 1.0.", ["CC0-1.0"]),
    ("License: MIT", ["MIT"]),
    ("License: GPLv3", ["GPL-3.0"]),
    ('{"name": "x", "license": "BSD-3-Clause"}', ["BSD-3-Clause"]),
    ("MIT License\n\nCopyright (c) 2020 Someone", ["MIT"]),
    ("The MIT License (MIT)\n\nCopyright", ["MIT"]),
    ("Apache License\nVersion 2.0, January 2004\n", ["Apache-2.0"]),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n", ["GPL-3.0"]),
    ("// SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]),
    ("# SPDX-License-Identifier: MIT OR GPL-2.0-only\nimport os", ["MIT", "GPL-2.0"]),
    ("Licensed under the GPL.", ["GPL"]),
    ("MIT License texts are short.", []),
    ("license = valid and paid", []),
    ("The public likes the domain; rights are seldom reserved.", []),
    ("Software without a license: nobody may use it.", []),
])
def test_usual_forms(text, names):
    assert found(text) == names
    assert found("Some words before.\n\n" + text + "\n\nSome words after.") == names


@pytest.mark.parametrize("name,called", license_scan.NAMES)
def test_every_name_saves_and_is_confirmed(name, called):
    assert found(f"released under {called}") == found(f"license: {called}") == [name]


def test_hints_survive_any_loss_within_tolerance():
    """Whatever words go, up to the tolerance, a text stays a candidate."""
    rng = np.random.default_rng(3)
    own = license_scan.Scanner(license_scan.TEMPLATES, None, 0.15)
    for _, text in license_scan.TEMPLATES:
        words = license_scan.words(text)
        hinted = [i for i, w in enumerate(words) if own.hint.search(w)]
        slack = int(0.15 * len(words))
        for k in range(20):
            first = hinted[:slack] if k < 10 else []  # the words that are hints go first
            rest = rng.permutation([i for i in range(len(words)) if i not in first])[: slack - len(first)]
            left = [w for i, w in enumerate(words) if i not in first and i not in rest]
            assert own.hint.search("\n".join(left)), (text, left)


def every_place(text, templates, tolerance=0.15):
    """Names and character ranges of every template confirmed anywhere in a text, without hints, sentences or windows."""
    spans = [m.span() for m in license_scan._WORD.finditer(text)]
    words = np.array([text[a:b].lower() for a, b in spans], object)
    for t in templates:
        n, slack = len(t.words), int(tolerance * len(t.words))
        known = np.cumsum(np.concatenate(([0], np.isin(words, t.words))))
        at = 0
        while at < len(words):
            if known[min(at + n + slack, len(words))] - known[at] >= n - slack:
                block = list(words[at : at + n + slack])
                missing, extra, first, last = t.differences(block, slack)
                if missing + extra <= tolerance * n:
                    yield t.name, spans[at + first][0], spans[at + last - 1][1]
                    at += last
                    continue
            at += 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no shared tables")
def test_whole_scan_misses_nothing():
    """Every template at every position, with words lost and lines wrapped: each place has a finding."""
    rng = np.random.default_rng(4)
    plain = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text.dropna().tolist()
    lines = ["\n".join(" ".join(w) for w in np.array_split(t.split(), max(1, len(t) // 40))) for _, t in license_scan.TEMPLATES]
    worn = [" ".join(w for w in t.split() if rng.random() > 0.04) for _, t in license_scan.TEMPLATES for _ in range(2)]
    texts = plain + [plain[i][:500] + "\n" + t + "\n" + plain[-i][:500] for i, t in enumerate(lines + worn)]
    own = license_scan.Scanner(license_scan.TEMPLATES, None, 0.15)
    places = 0
    for text in texts:
        got = [(f.start, f.end) for f in own.scan(text)]
        for name, lo, hi in every_place(text, own.short + own.long):
            places += 1
            assert any(a < hi and lo < b for a, b in got), (name, text[lo:hi])
    assert places > 150


@pytest.mark.parametrize("text", ["licensed " * 50_000, "license: mit. " * 20_000, "under the " * 100_000 + "license", "rights reserved " * 50_000, "x" * 5_000_000 + " license"])
def test_long_texts_take_linear_time(text):
    begun = time.time()
    found(text)
    assert time.time() - begun < 30
