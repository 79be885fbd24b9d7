"""Licence texts as they stand in files: wrapped, in comments, tagged."""

import textwrap

import pytest

import __spark_entry__ as entry
from tessera.llm import licenses

MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.'


def wrap(text, width=72, lead=""):
    return "\n".join(lead + x for x in textwrap.wrap(text, width))


TEXTS = {
    1: ("Copyright 2020 A\n\n" + wrap(MIT) + "\n\n" + wrap(NOTICE), "MIT"), 2: ("/*\n" + wrap(GPL, 70, " * ") + "\n */", "GPL-3.0"), 3: (" * " + APACHE.replace("\n", "\n * "), "Apache-2.0"),
    4: (wrap(BSD) + "\n\n1. " + wrap(SOURCE), "BSD-2-Clause"), 5: (wrap(BSD) + "\n\n(1) " + wrap(SOURCE), "BSD-2-Clause"), 6: (wrap(BSD, 30) + "\n* " + wrap(SOURCE, 30), "BSD-2-Clause"),
    7: ("// SPDX-License-Identifier: MIT\nint x;", "MIT"), 8: ("# SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), 9: ("SPDX-License-Identifier: GPL-3.0-or-later\n", "GPL-3.0"),
    10: ("x. This project is released under the MIT License. y", "MIT"), 11: ("Released under the MIT License\nCopyright 2020 A", "MIT"), 12: ("This software is\ndistributed under the BSD 3-Clause\nLicense.", "BSD-3-Clause"),
    13: ("Released under the\n\nMIT License.", None), 14: ("The MIT License is named here.", None), 15: (None, None),
}


def test_wrapped_texts(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in TEXTS.items()], "doc_id long, text string")
    want = {i: [x] for i, (_, x) in TEXTS.items() if x}
    assert {r.doc_id: r.licenses for r in licenses.scan_wrapped(rows).collect()} == want


def test_against_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = spark.createDataFrame([(i, t) for i, (t, _) in TEXTS.items()], "doc_id long, text string")
    for docs in (rows, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")):
        docs.toPandas().to_parquet(path := str(tmp_path / "d.parquet"))
        con = duckdb.connect()
        con.sql(f"create view documents as select * from read_parquet('{path}')")
        want = sorted(con.sql(entry.oracle_sql()["op8_license_scan_wrapped"]).fetchall())
        got = sorted((r.doc_id, r.n_sentences, " ".join(r.sentence_ids), " ".join(r.licenses)) for r in licenses.scan_wrapped(docs).collect())
        assert got == want and got
