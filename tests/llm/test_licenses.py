"""Licence lines: families, unknown ones, prose, and the filters before the model."""

import re

import pytest
from pyspark.sql import functions as F

from classweave.llm import licenses, queries
from classweave.llm.license_texts import COMMON_WORDS
from classweave.session import materialise

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scanner(spark):
    return licenses.fit(queries.table(spark, SF, "documents"))


def plain_grams(text):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    return [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)
            if set(words[i:i + n]) - set(COMMON_WORDS)]


@pytest.mark.parametrize("text", [
    "", "the of", "One", "This is the MIT License.", "É été, 2.0 l'un", "a a b a"])
def test_grams(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(
        licenses.grams_of(licenses.words_of(F.col("t"))).alias("g")).first()
    assert sorted(row.g) == sorted(plain_grams(text))


FOUND = {
    "Released under the MIT license": "MIT",
    "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0": "Apache-2.0",
    "Permission is hereby granted, free of charge, to any person obtaining": "MIT",
    "This work is licensed under the GNU General Public License, version 2.": "GPL",
    "it under the terms of the GNU Lesser General Public License as published by": "LGPL",
    "Licensed under CC BY-NC 4.0": "CC-BY-NC",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA",
    "Redistribution and use in source and binary forms, with or without": "BSD",
    "subject to the terms of the Mozilla Public License, v. 2.0": "MPL-2.0",
    "Copyright (c) 2019 Someone. All rights reserved.": "Proprietary",
    "Licensed under the Foo Bar license, version 9.": "unknown",
}
PROSE = ["", " ", "the of and", "some work was done by the public", "copy the file",
         "She renewed her fishing license in the city.", "a free person", "version",
         "The general public was granted access to the work."]


def test_families(spark, scanner):
    texts = [*FOUND, *PROSE]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {texts[r.doc_id]: r.family for r in licenses.scan(docs, scanner).collect()}
    assert found == FOUND


def test_filters_drop_nothing(spark, scanner, small):
    """Lines passed over before the model are no licences to the model."""
    docs = queries.table(spark, small, "documents").limit(60)
    lines = materialise(docs.select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).select(
        "doc_id", "line", licenses.words_of(F.col("text")).alias("words")))
    every = licenses.best_family(scanner, scanner.model.transform(
        lines.withColumn("grams", licenses.grams_of(F.col("words")))))
    slow = {(r.doc_id, r.line) for r in every.where(
        F.col("no_license") < scanner.limit).collect()}
    fast = {(r.doc_id, r.line) for r in licenses.scan(docs, scanner).collect()}
    assert fast == slow != set()


def test_odd_rows(spark, scanner):
    mit = "Released under the MIT License."
    rows = [(1, None, "a", "x"), (2, "", "b", "x"), (3, f"x\n\n{mit}\nprose", "c", "x"),
            (3, f"x\n\n{mit}\nprose", "c", "x"), (None, mit, None, "x"),
            (5, "word " * 100_000 + "\n" + mit, "d", "x"),
            (6, "of the license " * 10_000, "e", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, family string, words string")
    found = sorted(((r.doc_id or 0, r.line) for r in licenses.scan(docs, scanner).where(
        "family = 'MIT' and confirmed").collect()))
    assert found == [(0, 0), (3, 2), (3, 2), (5, 1)]
    assert licenses.scan(docs.where("doc_id < 0"), scanner).count() == 0


def test_trains_without_documents(spark):
    none = queries.table(spark, SF, "documents").where("doc_id < 0")
    own = licenses.fit(none)
    docs = spark.createDataFrame([(1, "Released under the MIT License.")],
                                 "doc_id long, text string")
    assert [r.family for r in licenses.scan(docs, own).collect()] == ["MIT"]


def test_query(spark):
    found = queries.QUERIES["op5_licenses"](spark, SF)
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().toString())
    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    expected = {(i, n) for i, t in texts.items() for n, line in enumerate(t.split("\n"))
                if re.search(r"licensed? |license\.|rights reserved", line + " ", re.I)}
    assert {(r.doc_id, r.line) for r in found.where("confirmed").collect()} == expected != set()
