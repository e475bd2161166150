"""Whole licences are found however their lines are broken; only copyright statements are left out."""

import textwrap

from fieldloom.llm import license_scan
from fieldloom.llm import license_texts as t
from fieldloom.llm.license_whole import APACHE_2, GPL_3

HOLDERS = "Copyright (c) 2020-2024 Jane Q. Doe, Foo Inc. and contributors"


def wrappings(text):
    """The text on one line, and with its lines broken at many widths (each word comes first in a line at some width)."""
    words = " ".join(text.split())
    return [words, *(textwrap.fill(words, w, break_long_words=False, break_on_hyphens=False) for w in (1, 40, 66, 70, 72, 76, 79, 80, 100))]


def scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [tuple(r)[2:] for r in license_scan.scan_licenses(docs, license_scan.known_digests(spark)).orderBy("doc_id").collect()]


def test_wrapping_does_not_matter(spark):
    bsd = t.BSD_2 + "\n" + t.BSD_3 + "\n" + t.BSD_DISCLAIMER
    cases = []
    for name, text in (("MIT", t.MIT), ("ISC", t.ISC), ("0BSD", t.ZERO_BSD), ("BSD-3-Clause", bsd), ("Zlib", t.ZLIB), ("Apache-2.0", APACHE_2), ("GPL-3.0", GPL_3)):
        cases += [(name, x) for x in wrappings(text)]
        if len(text) < 9000:
            cases += [(name, f"{HOLDERS}\n\n{x}") for x in wrappings(text)]
    cases += [("MIT", f"MIT License\n\n{HOLDERS}. All rights reserved.\n\n{x}") for x in wrappings(t.MIT)]
    cases += [("MIT", f"The MIT License (MIT) {HOLDERS} {t.MIT}"), ("MIT", f"{HOLDERS} {' '.join(t.MIT.split())}")]
    cases += [("BSD-3-Clause", f"BSD 3-Clause License\n\n{HOLDERS}\nAll rights reserved.\n\n{x}") for x in wrappings(bsd)]
    cases += [("Apache-2.0", APACHE_2.replace("Copyright [yyyy] [name of copyright owner]", HOLDERS)), ("Apache-2.0", APACHE_2), ("GPL-3.0", GPL_3)]
    got = scan(spark, [x for _, x in cases])
    assert [(i, c[0], g[0]) for i, (c, g) in enumerate(zip(cases, got)) if c[0] != g[0]] == []


def test_notices_behind_statements_stay(spark):
    got = scan(
        spark,
        [
            "Copyright 2020 X. Released under the MIT License.",
            "(c) 2021 Foo Inc., licensed under the Apache License, Version 2.0.",
            "© Foo Ltd. 2020. All rights reserved.",
            "Copyright (C) 2007 Foo\nall of it",
            "copyright notice and this permission notice",
            "(c) You must keep the notices",
        ],
    )
    assert got[:2] == [("MIT", "MIT", 1), ("Apache-2.0", "Apache-2.0", 1)]
    plain = spark.createDataFrame([("© Foo Ltd. 2020. All rights reserved.",), ("Copyright (C) 2007 Foo\nall of it",), ("copyright notice and this",), ("(c) You must keep",)], "x string")
    lines = [r[0] for r in plain.select(license_scan.canonical_lines(plain["x"])).collect()]
    assert lines == [[], ["all of it"], ["copyright notice and this"], ["c you must keep"]]
