"""Licences and personal data: the SQL on odd rows, and cases by hand."""

import duckdb
import pytest
from oracle import compare

from larder.llm import licences, pii, pii_sql

APACHE = "Licensed under the Apache License, Version 2.0."
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "CC BY and cc-by; GENERAL Public License"), (4, "CC BY and cc-by; GENERAL Public License"),
    (None, f"été {APACHE} ünï All rights reserved"), (None, None), (5, APACHE * 30), (6, "cc by nc 4 0 " * 400), (7, "general public license general"),
    (8, "Released under the MIT License. x@y.z a@b.c+d@e.f x@y 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255"),
    (9, "4111 1111 1111 1111. 4111-1111-1111-1112; 1 0000000000000, 0000000000000, +1 (375) 555-4393. +49 30 1 +1--2 +123456789012345678 ü +44 20 7946 0958"),
    (10, "iban GB82 WEST 1234 5698 7654 32 and account DE89370400440532013000, DE88370400440532013000; ssn 123-45-6789 and 123-45-6789"),
    (11, "9" * 30000 + " a@b.co " * 300 + "a" * 20000 + "@x"), (12, "1-" * 20000 + "+1" + "(" * 30000), (13, "@" * 1000 + "." * 1000),
    (14, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    (15, " cc by 全角 cc by x"), (16, "DE89 3704 0044 0532 0130 00 bank, 078-05-1120 tax id order"),
]


@pytest.fixture(scope="module")
def odd(make_docs):
    docs = make_docs(ODD)
    con = duckdb.connect()
    arrow = docs.select("doc_id", "text").toArrow()
    con.register("documents", arrow)
    return docs, con


def test_licences_equal_sql(odd):
    docs, con = odd
    problem, n = compare(licences.summary(licences.scan_licences(docs)), con, licences.oracle())
    assert problem is None and n == len(ODD)
    assert licences.scan_licences(docs.limit(0)).count() == 0


def test_licence_labels(odd):
    got = {r.doc_id: r for r in licences.summary(licences.scan_licences(odd[0])).collect() if r.doc_id}
    assert got[4].base_labels == "cc-by,gpl" and (got[4].n_base, got[4].first_word, got[4].last_word) == (3, 0, 5)
    assert got[5].labels == "apache-2.0" and got[5].n_base == 0 and got[5].score == 1.0
    assert "cc-by-nc" in got[6].labels and got[6].n_base == 400
    assert got[8].labels == "mit" and got[14].labels == "mit" and got[7].base_labels == "gpl"
    assert (got[1].n_words, got[1].labels, got[1].score, got[1].first_word) == (0, "", 0.0, None)


def test_personal_data_equals_sql(odd):
    docs, con = odd
    problem, n = compare(pii.digest(pii.find_personal(docs)), con, pii_sql.oracle())
    assert problem is None and n == len(ODD)
    assert pii.find_personal(docs.limit(0)).count() == 0


def test_personal_spans(odd):
    got = {r.doc_id: [(s.kind, s.text) for s in r.spans] for r in pii.find_personal(odd[0]).collect() if r.doc_id}
    texts = dict(ODD)
    for r in pii.find_personal(odd[0]).where("doc_id IS NOT NULL").collect():
        assert all(texts[r.doc_id][s.start:s.end] == s.text for s in r.spans)
    assert [t for k, t in got[8] if k == "email"] == ["x@y.z", "a@b.c", "+d@e.f"]
    assert [t for k, t in got[8] if k == "ip"] == ["1.2.3.4", "5.6.7.8", "001.002.003.255"]
    assert [t for k, t in got[9] if k == "card"] == ["4111 1111 1111 1111", "0000000000000"]  # a run of groups is one match
    assert [t for k, t in got[9] if k == "phone"] == ["+1 (375) 555-4393", "+44 20 7946 0958"]
    assert ("iban", "GB82 WEST 1234 5698 7654 32") in got[10] and ("iban", "DE89370400440532013000") in got[10]
    assert not any(t.startswith("DE88") for _, t in got[10]) and ("ssn", "123-45-6789") in got[10]
    assert not any(k == "ssn" for k, _ in got[16])  # words against it outweigh its score
