"""Operator 8 on licence texts as they are published, wrapped and commented."""

import pytest

from tessera.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at"""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission."""
COMMENTED = "\n".join(f" * {line}" for line in MIT.split("\n"))
GPL = """This program is free software{}: you can redistribute it and/or modify
it under the terms of the GNU {}General Public License as published by
the Free Software Foundation, either version {} of the License, or
(at your option) any later version."""
CASES = [
    (MIT, "MIT"), (" ".join(MIT.split()), "MIT"), (COMMENTED, "MIT"), (APACHE, "Apache-2.0"), ("\n".join(f"# {x}" for x in APACHE.split("\n")), "Apache-2.0"), (BSD2, "BSD-2-Clause"), (BSD3, "BSD-3-Clause"),
    (GPL.format("", "", "2"), "GPL-2.0"), (GPL.format("", "", "3"), "GPL-3.0"), (GPL.format("", "Lesser ", "2.1"), "LGPL-2.1"), (GPL.format("", "Lesser ", "3"), "LGPL-3.0"), (GPL.format("", "Affero ", "3"), "AGPL-3.0"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n", "GPL-2.0"), ("GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007", "GPL-3.0"),
    ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999", "LGPL-2.1"), ("Mozilla Public License Version 2.0\n=====", "MPL-2.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\n License, v. 2.0. If a copy", "MPL-2.0"), ("                              Apache License\n                        Version 2.0, January 2004", "Apache-2.0"),
    ("// SPDX-License-Identifier: MIT", "MIT"), ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("x SPDX-License-Identifier: GPL-3.0-or-later y", "GPL-3.0"),
    ("This code is released under the MIT License.", "MIT"), ("It is licensed under CC BY 4.0.", "CC-BY-4.0"), ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
    ("SPDX-License-Identifier: BSD-3-Clause-Clear", None), ("/* SPDX-License-Identifier: Apache-2.0 OR MIT */", "Apache-2.0 MIT"), ("# spdx-license-identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND (MIT OR 0BSD)\nx", "GPL-2.0 MIT"),
    ("SPDX-License-Identifier: MIT-0", None), ("SPDX-License-Identifier: MIT.\nSPDX-License-Identifier:\tISC", "ISC MIT"), ("SPDX-License-Identifier: or", None),
    ("MIT License\n\nCopyright (c) 2020", "MIT"), ("  # BSD 3-Clause License #", "BSD-3-Clause"), ("The MIT License\n", "MIT"), ("an MIT License thing\n", None), ("MIT\nLicense", None),
    (GPL.format("", "", "2").replace("of the License, or", ", or"), "GPL-2.0"), (GPL.format("", "Lesser ", "2.1").replace(" of the License, or", ", or"), "LGPL-2.1"),
    ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"), ("This work is not licensed under the MIT license.", "MIT"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"), ("No license here; permission was hereby granted by nobody.", None), ("He studied under MIT professors.", None), ("", None), (None, None),
]


def test_published_texts(spark):
    got = {r.doc_id: r for r in licenses.recognise(spark.createDataFrame([(i, t, 1, "x") for i, (t, _) in enumerate(CASES)], "doc_id long, text string, at int, head string")).collect()}
    for i, (text, want) in enumerate(CASES):
        assert (" ".join(got[i].licenses) if i in got else None) == want, text
    assert licenses.recognise(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_order_and_own_tables(spark):
    """Identifiers must follow in a rule's order, at any distance; all places of a sentence count, and a long text is read whole."""
    known = {"first words here": "a", "second words here": "b", "first words here too": "long"}
    rules = (("AB", ("a", "b"), ()), ("BA", ("b", "a"), ()), ("only A", ("a",), ("b",)))
    texts = ["second words here. First words here", "first words here " + "x " * 50000 + "second\nwords here", "second words here first words here second words here", "First words here!", "first words here too", "firstwords here"]
    got = {r.doc_id: (r.sentence_ids, r.licenses) for r in licenses.recognise(spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string"), known, rules).collect()}
    assert got == {0: (["b", "a"], ["BA"]), 1: (["a", "b"], ["AB"]), 2: (["b", "a", "b"], ["AB", "BA"]), 3: (["a"], ["only A"]), 4: (["long"], [])}


def test_triggers_cover_all():
    known, rules = licenses.vocabulary()
    some = licenses.triggers(known)
    assert len(some) < 12 and all(set(some) & set(t.split()) for t in known)
    assert {x for _, ids, absent in rules for x in (*ids, *absent)} <= set(known.values())


@pytest.mark.parametrize("known", [{"one": "a"}])
def test_known_sentences_have_two_words(spark, known):
    with pytest.raises(ValueError):
        licenses.recognised(spark.createDataFrame([], "doc_id long, text string"), known)
