import textwrap
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from netsift.llm import licenses

COMMON = Path("/usr/share/common-licenses")
TEXTS = dict(licenses.LICENSES)


def _cases():
    mit, bsd, isc = (TEXTS[x] for x in ("MIT", "BSD-3-Clause", "ISC"))
    body = mit.removeprefix("MIT License\n\n")
    bullets = bsd.replace("1. ", "  * ").replace("2. ", "  * ").replace("3. ", "  * ")
    named = bsd.replace("Neither the name of the copyright holder nor", "Neither the name of Foo, Inc. nor").replace("PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "PROVIDED BY FOO, INC. AND OTHERS")
    wrapped = "\n".join(textwrap.fill(p, 60) for p in bsd.split("\n\n"))
    return [
        (mit, "MIT"), (body, "MIT"), (f"The MIT License (MIT)\n\nCopyright (c) 2019-2021 Some One <x@y.z>\n\n{body}", "MIT"), (f"(c) 2020 Foo\n\n{body}", "MIT"), (f"Copyright The Authors\n\n{body}", "MIT"),
        (f"© Foo\r\n\r\n{body}".replace("\n", "\r\n"), "MIT"), (mit.replace("\n", " "), "MIT"), ("\n".join(f"// {x}" for x in body.split("\n")), "MIT"), (mit.replace("license", "licence").upper(), "MIT"),
        (f"BSD 3-Clause License\n\nCopyright (c) 2017, Foo\nAll rights reserved.\n\n{bsd}", "BSD-3-Clause"), (bullets, "BSD-3-Clause"), (bsd.replace("1. ", "a) ").replace("2. ", "b) "), "BSD-3-Clause"), (named, "BSD-3-Clause"), (wrapped, "BSD-3-Clause"),
        (f"ISC License\n\nCopyright 2020 X\n{isc}", "ISC"), (TEXTS["0BSD"], "0BSD"), (TEXTS["BSD-2-Clause"], "BSD-2-Clause"),
        (f"{mit} and more", None), (f"Preface.\n{bsd}", None), (body[:-20], None), ("This project is licensed under the terms of the Apache License 2.0.", "Apache-2.0-notice"), ("SPDX-License-Identifier: GPL-3.0", "GPL-3.0-notice"),
        ("Released under the Foo License.", None), ("MIT License", None), (f"Copyright (c) 2020 X {body}".replace("\n", " "), None), ("", None), (None, None), ("\n \n", None), ("word " * 60_000, None),
    ]


def _common():
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0"}
    return [(f.read_text(errors="replace"), spdx) for name, spdx in names.items() if (f := COMMON / name).is_file()]


@pytest.fixture(scope="module")
def cases():
    whole = _common()
    again = [(f"Copyright 2021 Y\n\n{t.upper()}", s) for t, s in whole]
    mixed = [("some prose\nReleased under the MIT License.\nmore\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT Licence", None)]
    return _cases() + whole + again + mixed


def test_whole_texts(spark, cases):
    docs = spark.createDataFrame([(i, t, 1) for i, (t, _) in enumerate(cases)], "doc_id long, text string, license_id int")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert [(i, got[i].license_id) for i in range(len(cases))] == [(i, want) for i, (_, want) in enumerate(cases)]
    assert got[len(cases) - 1].notices == "Apache-2.0,MIT" and got[26].notices == ""


def test_sql_written_apart_agrees(spark, cases):
    rows = [(i, t) for i, (t, _) in enumerate(cases)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = {r[0]: r[1:] for r in con.execute(licenses.ORACLE).fetchall()}
    got = {r.doc_id: (r.canonical_sha256, r.license_id, r.notices) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and sum(r[1] is not None for r in want.values()) > 15
