"""License scans by sentence rules, in DataFrame functions only.

A text is normalised, its known licence sentences become their identifiers, and the identifiers found, in
the order of the text, are matched against ordered rules. recognise() finds known sentences wherever their
words begin, so line ends, comment leaders, lead-ins and what follows don't hide one; scan() looks only at
sentences that stand by themselves on a line, and scan_wrapped() at those that go over line ends.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ascii_lower, id_text

# Sentences of public licences and licence notes in normalised form, by identifier.
SENTENCES = {
    "mit.released": "released under the mit license",
    "mit.licensed": "licensed under the mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit.spdx": "spdx license identifier mit",
    "apache2.licensed": "licensed under the apache license version 2 0",
    "apache2.comply": "you may not use this file except in compliance with the license",
    "apache2.spdx": "spdx license identifier apache 2 0",
    "gpl3.work": "this work is licensed under the gnu general public license version 3",
    "gpl3.licensed": "licensed under the gnu general public license version 3",
    "gpl3.redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl3.spdx": "spdx license identifier gpl 3 0 only",
    "bsd.redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by.licensed": "licensed under cc by 4 0",
    "cc-by-sa.licensed": "licensed under cc by sa 4 0",
    "cc-by-nc.licensed": "licensed under cc by nc 4 0",
    "cc-by-nc.work": "this work is licensed under cc by nc 4 0",
    "cc0.public": "to the extent possible under law the author has waived all copyright and related rights to this work",
    "proprietary.all": "all rights reserved",
}
# Rules as (licence, identifiers that must follow one another in this order, with others allowed between).
RULES = (
    ("MIT", ("mit.released",)), ("MIT", ("mit.licensed",)), ("MIT", ("mit.grant", "mit.notice")), ("MIT", ("mit.spdx",)),
    ("Apache-2.0", ("apache2.licensed",)), ("Apache-2.0", ("apache2.spdx",)),
    ("GPL-3.0", ("gpl3.work",)), ("GPL-3.0", ("gpl3.licensed",)), ("GPL-3.0", ("gpl3.redistribute",)), ("GPL-3.0", ("gpl3.spdx",)),
    ("BSD-2-Clause", ("bsd.redistribution", "bsd.source")), ("BSD-3-Clause", ("bsd.redistribution", "bsd.source", "bsd.endorse")),
    ("CC-BY-4.0", ("cc-by.licensed",)), ("CC-BY-SA-4.0", ("cc-by-sa.licensed",)), ("CC-BY-NC-4.0", ("cc-by-nc.licensed",)), ("CC-BY-NC-4.0", ("cc-by-nc.work",)),
    ("CC0-1.0", ("cc0.public",)),
)
#: Sentences end at . ! ? : ; before white space or the end, and at line ends.
ENDS = r"[.!?:;]+(?=\s|$)|\n"


def normalised(sentence: Column) -> Column:
    """Lower case (A-Z), every run of other characters than ASCII letters and digits as one space."""
    return F.trim(F.regexp_replace(ascii_lower(sentence), "[^a-z0-9]+", " "))


def licence_sentences(docs: DataFrame, sentences: Mapping[str, str] = SENTENCES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, place, sentence_id) of the known sentences; place is the sentence's number in its text."""
    known = docs.sparkSession.createDataFrame(sorted((text, name) for name, text in sentences.items()), "normal string, sentence_id string")
    rows = id_text(docs, id_col, text_col).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), ENDS)).alias("place", "sentence"))
    # normalising never makes a sentence longer, so those shorter than every known one stop here
    rows = rows.filter(F.length("sentence") >= min(map(len, sentences.values())))
    # the table of known sentences is a parameter of the call and is sent with the plan: its size is bounded by it
    return rows.select("doc_id", "place", normalised(F.col("sentence")).alias("normal")).join(F.broadcast(known), "normal").select("doc_id", "place", "sentence_id")


def follows(ids: Column, wanted: Sequence[str]) -> Column:
    """Whether the identifiers occur in this order: each is looked for after the place of the one before."""
    step = lambda s, x: F.when((s < len(wanted)) & (x == F.array(*map(F.lit, wanted))[F.least(s, F.lit(len(wanted) - 1))]), s + 1).otherwise(s)
    return F.aggregate(ids, F.lit(0), step) == len(wanted)


def scan(docs: DataFrame, sentences: Mapping[str, str] = SENTENCES, rules: Sequence[tuple[str, Sequence[str]]] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids in the text's order, licenses (sorted, distinct), of texts with a known sentence.

    Null and empty texts: no row. Empty table: no rows. Repeated rows and rows of one id: taken as one
    text. A licence is found when one of its rules fits; known sentences that complete no rule leave
    `licenses` empty.
    """
    return _judged(licence_sentences(docs, sentences, id_col, text_col).distinct(), rules)


def _judged(found: DataFrame, rules: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    each = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "sentence_id"))).alias("found"))
    each = each.select("doc_id", F.transform("found", lambda x: x["sentence_id"]).alias("sentence_ids"))
    fitting = F.array(*(F.when(follows(F.col("sentence_ids"), ids), F.lit(name)) for name, ids in rules))
    return each.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), "sentence_ids", F.sort_array(F.array_distinct(F.array_compact(fitting))).alias("licenses"))


def _variants() -> dict[str, str]:
    """Known sentences by normalised form: those above and, for all licences alike, the usual ways to name one."""
    names = {
        "MIT": ("mit license", "mit"), "Apache-2.0": ("apache license version 2 0", "apache license version 2 0 the license", "apache license 2 0", "apache 2 0 license", "apache 2 0"),
        "GPL-3.0": ("gnu general public license version 3", "gnu general public license v3 0", "gnu general public license v3", "gnu gpl v3", "gpl v3", "gplv3", "gpl 3 0"),
        "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "bsd 2 clause"), "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "bsd 3 clause"),
        "CC-BY-4.0": ("cc by 4 0", "cc by 4 0 license", "creative commons attribution 4 0 international license"), "CC-BY-SA-4.0": ("cc by sa 4 0", "cc by sa 4 0 license", "creative commons attribution sharealike 4 0 international license"),
        "CC-BY-NC-4.0": ("cc by nc 4 0", "cc by nc 4 0 license", "creative commons attribution noncommercial 4 0 international license"), "CC0-1.0": ("cc0 1 0", "cc0 1 0 universal", "cc0 1 0 license"),
    }
    whole = [""] + [f"{the} {x} is " for the in ("this", "the") for x in ("project", "software", "work", "code", "source code", "file", "program", "library", "package", "repository")]
    out = {f"{w}{verb} under {the}{n}": f"named.{x}" for x, forms in names.items() for n in forms for w in whole for verb in ("released", "licensed", "distributed", "available", "made available") for the in ("", "the ", "a ")}
    tags = {"MIT": ("mit",), "Apache-2.0": ("apache 2 0",), "GPL-3.0": ("gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later"), "BSD-2-Clause": ("bsd 2 clause",), "BSD-3-Clause": ("bsd 3 clause",), "CC-BY-4.0": ("cc by 4 0",), "CC-BY-SA-4.0": ("cc by sa 4 0",), "CC-BY-NC-4.0": ("cc by nc 4 0",), "CC0-1.0": ("cc0 1 0",)}
    out |= {f"spdx license identifier {t}": f"spdx.{x}" for x, forms in tags.items() for t in forms}
    out["neither the name of the copyright holder nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission"] = "bsd.endorse"
    return out | {text: name for name, text in SENTENCES.items()}


#: Identifiers by normalised sentence, and the rules above with one for each licence that is named or tagged.
WRAPPED = _variants()
WRAPPED_RULES = (*RULES, *((x, (f"{kind}.{x}",)) for kind in ("named", "spdx") for x in ("MIT", "Apache-2.0", "GPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0")))
#: A sentence surely ends at . ! ? before white space or the end, and at lines without ASCII letters and digits. It may end, or go on, at line ends, : and ; and after list marks.
SURE, BLANK, MARK, MAYBE = r"[.!?]+(?=\s|$)", r"\n[^A-Za-z0-9\n]*\n", r"(^|[\n\x01])([^A-Za-z0-9\n\x01]*[0-9A-Za-z]{1,3}\))[ \t]", r"\n|[:;]+(?=\s|$)"


def wrapped_sentences(docs: DataFrame, known: Mapping[str, str] = WRAPPED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, place, sentence_id) of the known sentences, over line ends or not: from each place the longest, without those that begin inside one."""
    table = docs.sparkSession.createDataFrame(sorted(known.items()), "normal string, sentence_id string")
    begins = sorted({" ".join(text.split()[:2]) for text in known})
    longest = max(len(text.split()) for text in known)
    rows = id_text(docs, id_col, text_col).distinct().withColumn("row", F.xxhash64("text"))
    text = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), BLANK, "\x01"), SURE, "\x01")
    rows = rows.select("doc_id", "row", F.posexplode(F.split(F.regexp_replace(text, MARK, "$1$2\n"), "\x01")).alias("group", "part"))
    rows = rows.filter(F.length("part") >= min(map(len, known))).withColumn("parts", F.filter(F.transform(F.split("part", MAYBE), normalised), lambda x: x != ""))
    rows = rows.select("doc_id", "row", "group", "parts", F.posexplode("parts").alias("i", "part"))
    rows = rows.filter(F.substring_index(F.array_join(F.slice("parts", F.col("i") + 1, 2), " "), " ", 2).isin(begins))
    # each part has a word at least, so no known sentence has more parts than words
    rows = rows.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("parts") - F.col("i")))))
    rows = rows.withColumn("normal", F.array_join(F.slice("parts", F.col("i") + 1, F.col("n")), " ")).join(F.broadcast(table), "normal")
    rows = rows.groupBy("doc_id", "row", "group", "i").agg(F.max(F.struct("n", "sentence_id")).alias("best"))
    before = F.max(F.col("i") + F.col("best.n")).over(Window.partitionBy("doc_id", "row", "group").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", before).filter("before is null or before <= i")
    return rows.select("doc_id", F.struct("group", "i", "row").alias("place"), F.col("best.sentence_id").alias("sentence_id"))


def scan_wrapped(docs: DataFrame, known: Mapping[str, str] = WRAPPED, rules: Sequence[tuple[str, Sequence[str]]] = WRAPPED_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As scan, with sentences that are wrapped at line ends, SPDX tags and the usual variants."""
    return _judged(wrapped_sentences(docs, known, id_col, text_col), rules)


# Further sentences of public licences, in normalised form, by identifier.
MORE_SENTENCES = {
    "agpl3.title": "gnu affero general public license version 3 19 november 2007",
    "agpl3.either": "gnu affero general public license as published by the free software foundation either version 3 of the license",
    "apache2.title": "apache license version 2 0 january 2004",
    "apache2.header": "licensed under the apache license version 2 0 the license",
    "bsd.names": "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsl1.title": "boost software license version 1 0",
    "cc0.title": "cc0 1 0 universal",
    "epl2.title": "eclipse public license v 2 0",
    "epl2.terms": "under the terms of the eclipse public license 2 0",
    "gpl2.title": "gnu general public license version 2 june 1991",
    "ccby4.title": "creative commons attribution 4 0 international license",
    "ccbync4.title": "creative commons attribution noncommercial 4 0 international license",
    "ccbysa4.title": "creative commons attribution sharealike 4 0 international license",
    "gpl2.either": "gnu general public license as published by the free software foundation either version 2 of the license",
    "gpl2.older": "gnu general public license as published by the free software foundation either version 2 or at your option any later version",
    "gpl3.older": "gnu general public license as published by the free software foundation either version 3 or at your option any later version",
    "gpl3.title": "gnu general public license version 3 29 june 2007",
    "gpl3.either": "gnu general public license as published by the free software foundation either version 3 of the license",
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl21.title": "gnu lesser general public license version 2 1 february 1999",
    "lgpl21.either": "gnu lesser general public license as published by the free software foundation either version 2 1 of the license",
    "lgpl21.older": "gnu lesser general public license as published by the free software foundation either version 2 1 or at your option any later version",
    "lgpl3.title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl3.either": "gnu lesser general public license as published by the free software foundation either version 3 of the license",
    "mpl2.title": "mozilla public license version 2 0",
    "mpl2.form": "subject to the terms of the mozilla public license v 2 0",
    "unlicense.free": "this is free and unencumbered software released into the public domain",
    "wtfpl.title": "do what the fuck you want to public license",
    "zlib.liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib.origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
}
# Names of licences in normalised form, as they follow "under the", and their public short identifiers.
NAMES = {
    "AGPL-3.0": ("gnu affero general public license version 3", "agplv3", "agpl 3 0"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"),
    "BSL-1.0": ("boost software license", "boost software license version 1 0"),
    "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0 international"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international"),
    "CC0-1.0": ("cc0 1 0", "cc0"),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license v2 0", "epl 2 0"),
    "GPL-2.0": ("gnu general public license version 2", "gnu general public license v2", "gnu gpl v2", "gplv2", "gpl 2 0"),
    "GPL-3.0": ("gnu general public license version 3", "gnu general public license v3", "gnu gpl v3", "gplv3", "gpl v3", "gpl 3 0"),
    "ISC": ("isc license",),
    "LGPL-2.1": ("gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "lgplv2 1", "lgpl 2 1"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "gnu lesser general public license v3", "lgplv3", "lgpl 3 0"),
    "MIT": ("mit license", "mit licence", "expat license"),
    "MPL-2.0": ("mozilla public license 2 0", "mozilla public license version 2 0", "mpl 2 0"),
    "Unlicense": ("unlicense",),
    "Zlib": ("zlib license",),
}
# Rules beside one for each name and tag, as (licence, identifiers in this order, identifiers that must be absent).
ORDERED = (
    ("AGPL-3.0", ("agpl3.title",), ()), ("AGPL-3.0", ("agpl3.either",), ()),
    ("Apache-2.0", ("apache2.title",), ()), ("Apache-2.0", ("apache2.header", "apache2.comply"), ()), ("Apache-2.0", ("apache2.licensed",), ()), ("Apache-2.0", ("apache2.header",), ()),
    ("BSD-3-Clause", ("bsd.redistribution", "bsd.source", "bsd.endorse"), ()), ("BSD-3-Clause", ("bsd.redistribution", "bsd.source", "bsd.names"), ()),
    ("BSD-2-Clause", ("bsd.redistribution", "bsd.source"), ("bsd.endorse", "bsd.names")),
    ("BSL-1.0", ("bsl1.title",), ()), ("CC0-1.0", ("cc0.title",), ()), ("CC0-1.0", ("cc0.public",), ()),
    ("EPL-2.0", ("epl2.title",), ()), ("EPL-2.0", ("epl2.terms",), ()),
    ("GPL-2.0", ("gpl2.title",), ()), ("GPL-2.0", ("gpl2.either",), ()), ("GPL-2.0", ("gpl2.older",), ()), ("GPL-3.0", ("gpl3.older",), ()), ("LGPL-2.1", ("lgpl21.older",), ()),
    ("CC-BY-4.0", ("ccby4.title",), ()), ("CC-BY-NC-4.0", ("ccbync4.title",), ()), ("CC-BY-SA-4.0", ("ccbysa4.title",), ()), ("GPL-3.0", ("gpl3.title",), ()), ("GPL-3.0", ("gpl3.either",), ()), ("GPL-3.0", ("gpl3.redistribute",), ()),
    ("ISC", ("isc.grant",), ()),
    ("LGPL-2.1", ("lgpl21.title",), ()), ("LGPL-2.1", ("lgpl21.either",), ()), ("LGPL-3.0", ("lgpl3.title",), ()), ("LGPL-3.0", ("lgpl3.either",), ()),
    ("MIT", ("mit.grant", "mit.notice"), ()), ("MPL-2.0", ("mpl2.title",), ()), ("MPL-2.0", ("mpl2.form",), ()),
    ("Unlicense", ("unlicense.free",), ()), ("WTFPL", ("wtfpl.title",), ()), ("Zlib", ("zlib.liable", "zlib.origin"), ()),
)
#: The expression of a tag, and what joins its identifiers; a word that ends each where they stand as sentences.
TAG, JOINED, END = r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+()-]+(?:[ \t]+(?:OR|AND|WITH)[ \t]+[A-Za-z0-9.+()-]+)*)", r"(?i)[ \t]+(?:OR|AND|WITH)[ \t]+", "endofname"
#: What stands before a name that licenses something.
UNDER = ("under", "under the", "under a", "under an", "under the terms of the", "under the terms of", "under the conditions of the")


def vocabulary() -> tuple[dict[str, str], tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...]]:
    """The packaged known sentences (identifier by normalised sentence) and rules; a table of a user's own may take their place."""
    short = {x: " ".join("".join(c if c.isalnum() else " " for c in x.lower()).split()) for x in NAMES}
    known = {f"{u} {n}": f"named.{x}" for x, forms in NAMES.items() for n in forms for u in UNDER}
    for x, s in short.items():
        ends = ("", " only", " or later") if "GPL" in x else ("",)
        known |= {f"spdx license identifier {s}{e} {END}": f"tagged.{x}" for e in ends}
        known |= {f"license heading {n} {END}": f"headed.{x}" for n in NAMES[x]}
    known |= {text: name for name, text in (SENTENCES | MORE_SENTENCES).items() if not name.endswith(".spdx")}
    named = tuple((x, (f"{kind}.{x}",), ()) for x in NAMES for kind in ("named", "tagged", "headed"))
    return known, (*ORDERED, *named)


def heading() -> str:
    """A line that is a licence's name and nothing else, as a pattern."""
    names = sorted({n for forms in NAMES.values() for n in forms}, key=lambda n: (-len(n), n))
    return r"(?im)^[^A-Za-z0-9\n]*(?:the )?(" + "|".join(n.replace(" ", r"[^A-Za-z0-9\n]+") for n in names) + r")[^A-Za-z0-9\n]*$"


def set_apart(text: Column) -> Column:
    """The identifiers of tags and the names that are lines of their own, as sentences, each with a word at its end: a longer identifier is another one."""
    ids = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(TAG), F.lit(1)), lambda x: F.split(x, JOINED)))
    tags = F.transform(ids, lambda x: F.concat(F.lit("spdx license identifier "), normalised(x), F.lit(f" {END}")))
    heads = F.transform(F.regexp_extract_all(text, F.lit(heading()), F.lit(1)), lambda x: F.concat(F.lit("license heading "), normalised(x), F.lit(f" {END}")))
    return F.array_join(F.concat(tags, heads), " | ")


def triggers(known: Mapping[str, str]) -> list[str]:
    """A few words of which every known sentence has one."""
    left, chosen = [set(text.split()) for text in known], []
    while left:
        counts: dict[str, int] = {}
        for words in left:
            for w in words:
                counts[w] = counts.get(w, 0) + len(w)
        best = max(sorted(counts), key=counts.__getitem__)
        chosen.append(best)
        left = [words for words in left if best not in words]
    return chosen


def recognised(docs: DataFrame, known: Mapping[str, str], id_col: str = "doc_id", text_col: str = "text", head: int = 2) -> DataFrame:
    """(doc_id, place, sentence_id) of the known sentences, wherever their words stand in a row; of those that begin at one word the longest."""
    begin = lambda text: " ".join(text.split()[:head])
    table = docs.sparkSession.createDataFrame(sorted((begin(t), t, n) for t, n in known.items()), "head string, sentence string, sentence_id string")
    heads = sorted({begin(t) for t in known})
    if min(len(t.split()) for t in known) < head:
        raise ValueError(f"known sentences have {head} words at least")
    plain = [t for t in known if not t.endswith(f" {END}")]
    looked_for = ["spdx", *triggers(plain)] if plain else ["spdx"]
    rows = id_text(docs, id_col, text_col).filter(F.col("text").rlike("(?i)" + "|".join(looked_for)) | F.col("text").rlike(heading())).distinct()
    rows = rows.select("doc_id", F.concat(F.lit("| "), normalised(F.col("text")), F.lit(" | "), set_apart(F.col("text")), F.lit(" ")).alias("normal"))
    # pieces begin where a known sentence may; their lengths give the places
    rows = rows.withColumn("pieces", F.split("normal", "(?= (?:" + "|".join(heads) + ") )")).filter(F.size("pieces") > 1)
    rows = rows.withColumn("lengths", F.transform("pieces", F.length)).select("doc_id", "normal", "lengths", F.explode(F.sequence(F.lit(1), F.size("pieces") - 1)).alias("k"))
    rows = rows.withColumn("at", F.aggregate(F.slice("lengths", 1, F.col("k")), F.lit(0), lambda s, x: s + x))
    first = F.substring("normal", F.col("at") + 2, F.lit(max(map(len, heads)) + 1))  # heads may overlap, so that a piece ends before its own does
    rows = rows.withColumn("head", F.array_join(F.slice(F.split(first, " ", head + 1), 1, head), " "))
    # the table of known sentences is a parameter of the call and is sent with the plan: its size is bounded by it
    found = rows.join(F.broadcast(table), "head").filter(F.substring("normal", F.col("at") + 1, F.length("sentence") + 2) == F.concat(F.lit(" "), F.col("sentence"), F.lit(" ")))
    best = found.groupBy("doc_id", F.xxhash64("normal").alias("row"), "at").agg(F.max_by("sentence_id", F.length("sentence")).alias("sentence_id"))
    return best.select("doc_id", F.struct("row", "at").alias("place"), "sentence_id")


def recognise(docs: DataFrame, known: Mapping[str, str] | None = None, rules: Sequence[tuple[str, Sequence[str], Sequence[str]]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids in the text's order, licenses (sorted, distinct), of texts with a known sentence.

    Identifiers of SPDX tags, each of an expression by itself, and lines that are a licence's name come after the
    other sentences. A name counts whatever is said of it: `not licensed under the MIT license` names MIT.
    Null and empty texts: no row. Empty table: no rows. Repeated rows: taken as one; other rows of one id:
    one after another. A licence is found when one of its rules fits: its identifiers in this order, and
    none of those that must be absent.
    """
    packaged = vocabulary()
    known, rules = known or packaged[0], rules or packaged[1]
    each = recognised(docs, known, id_col, text_col).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "sentence_id"))).alias("found"))
    each = each.select("doc_id", F.transform("found", lambda x: x["sentence_id"]).alias("sentence_ids"))
    has = lambda ids: F.arrays_overlap("sentence_ids", F.array(*map(F.lit, ids)))
    fits = lambda ids, absent: follows(F.col("sentence_ids"), ids) & (~has(absent) if absent else F.lit(True)) if len(ids) > 1 or absent else has(ids)
    fitting = F.array(*(F.when(fits(ids, absent), F.lit(name)) for name, ids, absent in rules))
    return each.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), "sentence_ids", F.sort_array(F.array_distinct(F.array_compact(fitting))).alias("licenses"))
