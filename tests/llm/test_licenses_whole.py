"""Whole licences, however they are wrapped, commented and punctuated."""

import re
import textwrap
from pathlib import Path

import pytest

from tidemark.llm import licenses

FILES = sorted((Path(licenses.__file__).parent / "known_licenses").glob("*.txt"))
OWN = "Copyright (c) 2021 Some One <some@one.example>\nAll rights reserved.\n\n"


def wrapped(text, width):
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in re.split(r"\n[ \t]*\n", text))


def scan(spark, rows):
    return {r["doc_id"]: r["license_id"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_every_known_text_at_every_width(spark):
    rows, want = [], {}
    for file in FILES:
        text = file.read_text()
        for width in (40, 50, 51, 52, 61, 62, 72, 80, 82, 100, 120, 10**6):
            for form in (wrapped(text, width), "\n".join(f" * {line}".rstrip() for line in wrapped(text, width).split("\n")), wrapped(text, width).upper().replace(",", " ,").replace('"', "''").replace("\n", "\r\n")):
                want[len(rows)] = file.stem
                rows.append((len(rows), form))
    got = scan(spark, rows)
    assert {(want[i], got[i]) for i in want if want[i] != got[i]} == set()


def test_own_copyright_and_owner(spark):
    rows, want = [], {}
    for name in ("MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "Zlib"):
        heading, _, rest = next(f for f in FILES if f.stem == name).read_text().partition("\n\n")
        for width in (44, 60, 80, 100):
            body = wrapped(rest, width)
            for form in (OWN + body, f"{heading}\n\n{OWN}{body}", f"The {heading}\n\n(c) 1999-2003 A, B and C\n\n{body}", "# " + f"{OWN}{body}".replace("\n", "\n# ")):
                want[len(rows)] = name
                rows.append((len(rows), form))
    rest = next(f for f in FILES if f.stem == "BSD-3-Clause").read_text().partition("\n\n")[2]
    for form in (rest.replace("the copyright holder nor", "the University of Somewhere nor").replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS AND CONTRIBUTORS").replace("COPYRIGHT HOLDER OR CONTRIBUTORS", "REGENTS OR CONTRIBUTORS"), OWN + rest.replace("COPYRIGHT HOLDER", "COPYRIGHT OWNER")):
        want[len(rows)] = "BSD-3-Clause"
        rows.append((len(rows), form))
    got = scan(spark, rows)
    assert {(i, want[i], got[i]) for i in want if want[i] != got[i]} == set()


def test_changed_texts_are_not_known(spark):
    mit = next(f for f in FILES if f.stem == "MIT").read_text()
    assert scan(spark, [(1, mit.replace("free of charge", "for a fee")), (2, mit + "\nThe Software shall be used for Good, not Evil."), (3, "x"), (4, None), (5, "")]) == dict.fromkeys(range(1, 6))


@pytest.mark.skipif(not Path("/usr/share/common-licenses/GPL-3").exists(), reason="no installed licences")
def test_installed_texts(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0"}
    rows = [(i, Path(f"/usr/share/common-licenses/{n}").read_text()) for i, n in enumerate(names)]
    assert scan(spark, rows) == dict(enumerate(names.values()))
