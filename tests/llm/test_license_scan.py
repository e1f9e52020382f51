import textwrap

import pytest

from lakeloom.llm.license_scan import KNOWN, library, license_scan, license_sql

MIT, NOTICE = KNOWN["MIT"], KNOWN["notice:MIT"]


def test_license_scan(spark):
    spelled = KNOWN["notice:Apache-2.0"].replace("License", "LICENCE").replace(",", " --")
    rows = [(1, MIT), (2, "Copyright (c) 2020 Some One\n\n" + MIT.upper().replace("\n", "\n\n  ")), (3, MIT + " and more"), (4, f"some text\n  {NOTICE}\n{spelled}!\nend"), (5, None), (6, " \n"), (7, NOTICE), (7, "other"), (4, f"some text\n  {NOTICE}\n{spelled}!\nend"), (None, MIT), (8, "© 1999 all\n" + "w " * 40000)]
    df = spark.createDataFrame([(i, t, "d", "l") for i, t in rows], "doc_id long, text string, digest string, license string").repartition(3)
    got = sorted(((r.doc_id, r.license, list(r.notices)) for r in license_scan(df).collect()), key=str)
    both = ["notice:Apache-2.0", "notice:MIT"]
    want = [(1, "MIT", []), (2, "MIT", []), (3, None, []), (4, None, both), (4, None, both), (5, None, []), (6, None, []), (7, "notice:MIT", ["notice:MIT"]), (7, None, []), (8, None, []), (None, "MIT", [])]
    assert got == sorted(want, key=str)
    assert license_scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("known", [{}, {"a": "...", "b": "Same Text", "c": "same, text"}])
def test_known_texts(spark, known):
    df = spark.createDataFrame([(1, "same text"), (2, "")], "doc_id int, text string")
    table = spark.createDataFrame(list(known.items()), "license string, text string")
    got = {r.doc_id: r.license for r in license_scan(df, table).collect()}
    assert got == {1: "b" if known else None, 2: None}


def test_whole_texts_however_titled_and_wrapped(spark):
    def wrapped(text, width):  # paragraphs without a copyright notice
        parts = text.split("\n\n")
        return "\n\n".join(p if "opyright (" in p or "opyright [" in p else textwrap.fill(p, width, break_on_hyphens=False, break_long_words=False) for p in parts)

    whole = [(name, text) for name, text in library() if not name.startswith("notice:")]
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "MIT", "ISC"} <= {name for name, _ in whole}
    rows = [(name, wrapped(text, width)) for name, text in whole for width in (40, 66, 72, 75, 80, 100, 10**6)] + whole
    title = {"MIT": ["MIT License", "The MIT License (MIT)"], "ISC": ["ISC License"]}
    rows += [(name, f"{t}\n\nCopyright (c) 2021 Some One\n\n{wrapped(KNOWN[name], 76)}") for name, ts in title.items() for t in ts]
    texts = dict(whole)
    mine = texts["BSD-3-Clause"].replace("The Regents of the University of California", "2019, Some One").replace("the name of the University", "the name of Some One").replace("REGENTS", "COPYRIGHT HOLDERS").replace("\n1.", "\n*").replace("\n2.", "\n*").replace("\n3.", "\n*")
    rows += [("BSD-3-Clause", "BSD 3-Clause License\n\n" + mine), ("Apache-2.0", texts["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2020 Some One")), (None, texts["Apache-2.0"].replace("(c) You must", "(c) You need not")), (None, texts["BSD-2-Clause"] + " more")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id int, text string")
    got = {r.doc_id: r.license for r in license_scan(df, library()).collect()}
    assert [(i, rows[i][0], got[i], rows[i][1][:60]) for i in got if got[i] != rows[i][0]] == []


def test_sql_equals_the_scan_on_licences(spark):
    """Whole texts at several widths, notices, phrases and copyright lines of all kinds, by the registered SQL."""
    duckdb = pytest.importorskip("duckdb")
    pandas = pytest.importorskip("pandas")
    texts = [text for _, text in library()]
    texts += ["\n\n".join(textwrap.fill(p, width, break_on_hyphens=False) for p in text.split("\n\n")) for text in texts for width in (60, 77, 100)]
    lines = ["Copyright (c) 2020 A", "(c) 2001 B", "(C) Copyright C", "(c) You must", "© D", "copyright notice and this", "Copyright: E", "Copyright holders", "copyright, 2020", "  Copyright F, all rights reserved", "copyright (a) g", "copyright (", "(c) all rights reserved"]
    texts += [f"{x}\n{KNOWN['MIT']}" for x in lines] + [f"{x}\nAll rights reserved." for x in lines]
    texts += ["The Copyright Owner may sub-license ten per cent per cent.", KNOWN["MIT"].replace("COPYRIGHT HOLDERS", "COPYRIGHT OWNERS").replace("sublicense", "sub-licence"), None, "", "...", NOTICE]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.digest, r.license, ",".join(r.notices)) for r in license_scan(df, library()).collect()}
    con = duckdb.connect()
    con.register("documents", pandas.DataFrame({"doc_id": range(len(texts)), "text": pandas.Series(texts, dtype=object)}))
    want = {r[0]: r[1:] for r in con.execute(license_sql()).fetchall()}
    assert {i: (got[i], want[i], texts[i]) for i in got if got[i] != want[i]} == {}
    assert got[len(texts) - 5][1] == "MIT" and sum(x[1] is not None for x in got.values()) > 60
