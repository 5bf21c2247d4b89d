from __future__ import annotations

import re

import duckdb
from llm_helpers import documents, prose

from salesmart.llm import licenses
from salesmart.llm.oracle import ORACLE


def pairs(text: str) -> set:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return set(zip(words, words[1:]))


NOTICES = [(name, pairs(notice)) for name, notice in licenses.TEMPLATES]


def best(passage: str) -> tuple | None:
    own = pairs(passage)
    told = [(-2 * len(own & n) / (len(own) + len(n)), name) for name, n in NOTICES if own]
    return (min(told)[1], -min(told)[0]) if told and -min(told)[0] >= licenses.THRESHOLD else None


def brute(rows) -> set:
    out = set()
    for doc, text in rows:
        text, space = text or "", " \t\r\n"
        units = [("line", n, line) for n, line in enumerate(text.split("\n"), start=1)]
        seen = {line.strip(space) for _, _, line in units}
        paragraphs = re.split("\n[ \t\r]*\n", text)
        sentences = [s for p in paragraphs for s in re.split("(?<=[.!?:])[ \t\r\n]+", p)]
        for unit, found in (("sentence", sentences), ("paragraph", paragraphs), ("text", [text])):
            found = {f.strip(space) for f in found}
            units += [(unit, 0, f) for f in found - seen]
            seen |= found
        out |= {(doc, unit, n, *best(found), found) for unit, n, found in units if best(found)}
    return out


def found(docs, **more) -> list:
    return [(r.doc_id, r.unit, r.line, r.license, r.dice, r.found) for r in licenses.scan(docs, **more).collect()]


def test_lines_as_by_all_templates(spark):
    notices = [n for _, n in licenses.TEMPLATES]
    rows = [(i, "\n".join([prose(i, 30), n, n.upper() + "!", n.replace("License", "licence"), "// " + n + " (c)", n + " " + prose(i, 2), prose(i, 400) + n])) for i, n in enumerate(notices)]
    expected = brute(rows)
    assert len(expected) > 4 * len(notices)
    got = found(documents(spark, rows))
    assert set(got) == expected and len(got) == len(expected)


MIT = f"""The MIT License (MIT)

Copyright (c) 2020 Foo Bar

{licenses._MIT_GRANT}

{licenses._MIT_NOTICE}

{licenses._MIT_WARRANTY}
"""
BSD = ["Copyright (c) 2021, Foo", licenses._BSD_GRANT, "1. " + licenses._BSD_SOURCE, "2. " + licenses._BSD_BINARY, "3. " + licenses._BSD_THIRD, licenses._BSD_WARRANTY]
APACHE = """Copyright 2020 Foo

Licensed under the Apache License,
Version 2.0 (the "License"); you may not use this file except in
compliance with the License."""
GPL = """foo - a program
This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful."""


def test_headers_texts_and_notices_in_prose(spark):
    cases = {
        1: (MIT, {("line", "MIT"), ("paragraph", "MIT"), ("text", "MIT")}),
        2: ("\n\n".join(BSD), {("text", "BSD-3-Clause"), ("paragraph", "BSD-3-Clause"), ("paragraph", "BSD")}),
        3: ("\n\n".join(BSD[:4] + BSD[5:]), {("text", "BSD-2-Clause")}),
        4: ("Copyright Foo\n\n" + licenses._ISC_GRANT + "\n\n" + licenses._ISC_WARRANTY, {("text", "ISC")}),
        5: (APACHE, {("sentence", "Apache-2.0"), ("text", "Apache-2.0")}),
        6: (GPL, {("sentence", "GPL-2.0-or-later")}),
        7: (f"{prose(1, 80)}. Licensed under the MIT License. {prose(2, 80)}", {("sentence", "MIT")}),
        8: (f"{prose(3, 40)}.\nCopyright 2020 Foo Inc. All rights reserved. {prose(4, 40)}", {("sentence", "Proprietary")}),
        9: ("Licensed under the MIT License. See LICENSE in the project root for license information.", {("sentence", "MIT")}),
        10: (GPL.replace("the GNU General", "the GNU\n  Lesser General").replace("version 2", "version 2.1"), {("sentence", "LGPL-2.1-or-later")}),
        11: (prose(5, 300) + ". The software is free, and its license is read by nobody without permission.", set()),
    }
    rows = [(i, text) for i, (text, _) in cases.items()]
    got = found(documents(spark, rows))
    assert set(got) == brute(rows)
    for i, (_, expected) in cases.items():
        told = {(unit, name) for doc, unit, _, name, _, _ in got if doc == i}
        assert expected <= told and (expected or not told), (i, told)


def test_crafted_texts_by_sql(spark):
    """The twin on texts of several units, with repeated passages and white space at their ends."""
    rows = [(1, MIT), (2, "\n\n".join(BSD)), (3, APACHE + "\n \t\r\n" + GPL), (3, MIT + MIT), (4, None), (5, ""), (6, " All rights reserved. \n\n All rights reserved. \n")]
    docs = documents(spark, rows)
    duck = duckdb.connect()
    duck.register("documents", docs.toPandas())
    expected = duck.execute(ORACLE["op8_licenses"]).fetchall()
    assert len(expected) > 20 and sorted(found(docs)) == sorted(expected)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert set(found(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edge_rows(spark):
    mit = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, "License"), (4, mit), (4, mit), (None, mit), (5, (prose(1, 50) + "\n") * 3000 + mit), (6, "\n\n" + mit + "\r\n"), (7, "all rights reserved")]
    docs = documents(spark, rows).withColumnRenamed("source", "license").withColumnRenamed("lang", "pairs")
    got = found(docs)
    assert sorted((d or 0, line, name) for d, _, line, name, _, _ in got) == [(0, 1, "MIT"), (4, 1, "MIT"), (4, 1, "MIT"), (5, 3001, "MIT"), (6, 3, "MIT"), (7, 1, "Proprietary")]
    assert found(docs.where("false")) == []
    ties = spark.createDataFrame([("B", "alpha beta gamma"), ("A", "alpha beta gamma"), (None, "alpha beta gamma"), ("C", "one"), ("D", None)], "license string, notice string")
    one = documents(spark, [(1, "Alpha, beta: gamma")])
    assert found(one, notices=ties) == [(1, "line", 1, "A", 1.0, "Alpha, beta: gamma")]
    assert found(one, notices=ties.where("license = 'C'")) == []
    assert [r[3] for r in found(documents(spark, [(1, "alpha\nbeta\ngamma")]), notices=ties, separator=None)] == ["A"]


def test_only_jvm_operators(spark):
    plan = licenses.scan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange|CartesianProduct|NestedLoop", plan)
