"""Digests against the published wordings, in the forms that texts have them; Spark and SQL alike."""

import pytest
from pyspark.sql import functions as F

from tests.compare import rows
from tests.llm.fixtures import SCHEMA
from tests.llm.wordings import FOLDER, LONG, SHORT, wordings
from tidemark.llm import licences

NOTICES = (
    "Copyright (c) 2020 A. Person", "Copyright © 1999-2021 Some Company, Inc.", "Copyright Jane Doe 2020", "(c) 2012 by J. R. Hacker <j@r.example>", "Copyright 2011, The Regents of the University of California", "© 2020 Ünal Özgür",
    "Copyright (C) 2001 A\nCopyright (c) 2002-2004, B and contributors", "Copyright (c) 2019 Acme Corp. All rights reserved.", "Copyright by Jane Doe 2020", "# Copyright: 2015 the authors", "",
)
PROSE = ("© of the sea", "The © sign is old. Copyright (c) 2020 Jane Doe. A long tale of rivers follows here.", "Copyright (c) 2020 Jane Doe", "all rights reserved", "he holds the copyright of the book and the licence to print it")


@pytest.fixture(scope="module")
def texts():
    out = [(name, t) for name, t in wordings().items()]
    for name, t in SHORT.items():
        if "{notice}" in t:
            out += [(name, t.replace("{notice}", n)) for n in NOTICES]
            one_line = lambda n: " ".join(t.replace("{notice}", n).split())  # noqa: B023, E731
            out += [(name, one_line(n)) for n in NOTICES if n.startswith(("Copyright (c)", "Copyright ©", "(c)")) and "\n" not in n]
    out += [("MIT", SHORT["MIT"].replace("{notice}", NOTICES[0]).upper()), ("MIT", SHORT["MIT"].replace("{notice}", "").replace("sublicense", "sub-licence").replace(",", " ,").replace(" ", "\n "))]
    out += [(None, t) for t in PROSE] + [(None, None), (None, ""), (None, SHORT["MIT"].replace("without limitation", "with limitation")), (None, SHORT["MIT"] + " and more")]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(k, t, None, None, 0) for k, (_, t) in enumerate(texts)], SCHEMA).repartition(4)


def test_wordings_are_found_in_every_form(docs, texts):
    got = {r["doc_id"]: r["licence"] for r in licences.scan(docs).collect()}
    assert {k: (got[k], t) for k, (name, t) in enumerate(texts) if got[k] != name} == {}


def test_every_known_digest_has_a_wording():
    have = set(wordings())
    assert set(licences.KNOWN) == have if FOLDER.exists() else set(licences.KNOWN) - have <= {*LONG, "Apache-2.0 (terms)"}


def test_sql_finds_the_same(spark, docs):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(r["doc_id"], r["text"]) for r in docs.collect()])
    out = licences.scan(docs)
    cur = con.execute(licences.oracle())
    assert rows(out.columns, out.collect()) == rows([d[0] for d in cur.description], cur.fetchall())


def test_a_text_of_notices_keeps_them(spark):
    texts = [*PROSE, ""]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["c"] for r in d.select("doc_id", licences.canonical(F.col("text")).alias("c")).collect()}
    assert got[0] == "of the sea" and got[1] == "the sign is old a long tale of rivers follows here" and got[2] == "copyright c 2020 jane doe" and got[3] == "all rights reserved" and got[5] == ""


def test_own_table_of_digests(spark):
    body = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
    texts = [body, body.upper(), "Copyright (c) 2020 A. Person\n" + body.replace(",", " ,"), body.replace("purpose", "reason")]
    known = spark.createDataFrame([(spark.range(1).select(licences.digest(F.lit(body)).alias("d")).first()["d"], name) for name in ("own", "other", "own")], "digest string, licence string")
    out = licences.scan(spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], SCHEMA), known)
    assert {r["doc_id"]: r["licence"] for r in out.collect()} == {0: "other", 1: "other", 2: "other", 3: None}
