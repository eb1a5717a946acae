"""Licence scans by sentence rules, row by row in the JVM.

A text is cut into sentences (line ends, and white space after a full stop,
question or exclamation mark) and normalised (lower case, only letters, digits and dots
between digits, spaces).  Notices and titles count where they are whole sentences;
:data:`PHRASES`, parts of the licence texts' long sentences, count wherever their words
follow each other.  Lines are joined for both: a line end may stand between any two words,
so a text is found alike unwrapped and wrapped at any column.  The DuckDB form knows
sentences inside one line only, as they are in the given tables.
A rule is an ordered list of identifiers; it
matches when its identifiers occur in this order in the text's identifier
sequence.  Of rules for one licence the first that matches counts.

Edge cases: null and empty texts have no identifiers and no licence; very long texts
are scanned whole; nothing is grouped, so repeated rows and ids are independent; null ids
stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "apache2-notice": "Licensed under the Apache License, Version 2.0.",
    "apache2-notice-long": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache2-compliance": "you may not use this file except in compliance with the License.",
    "apache2-obtain": "You may obtain a copy of the License at",
    "apache2-as-is": 'distributed under the License is distributed on an "AS IS" BASIS,',
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "Licensed under the MIT License.",
    "mit-title": "MIT License",
    "mit-title-2": "The MIT License (MIT)",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "mit-keep": "The above copyright notice and this permission notice shall be included in all",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR',
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify",
    "gpl3-or-later": "the Free Software Foundation, either version 3 of the License, or",
    "gpl2-or-later": "the Free Software Foundation; either version 2 of the License, or",
    "cc-by-nc-4-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4-notice": "Licensed under CC BY-SA 4.0.",
    "bsd-redistribute": "Redistribution and use in source and binary forms, with or without",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice,",
    "bsd-names": "Neither the name of the copyright holder nor the names of its",
    "rights-reserved": "All rights reserved.",
    "gpl-terms": "under the terms of the GNU General Public License",
    "lgpl-terms": "under the terms of the GNU Lesser General Public License",
    "lgpl21-or-later": "either version 2.1 of the License, or",
    "agpl-terms": "under the terms of the GNU Affero General Public License",
    "mpl2-terms": "subject to the terms of the Mozilla Public License",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications",
    "unlicense-notice": "This is free and unencumbered software released into the public domain.",
    "cc0-title": "CC0 1.0 Universal",
    "cc0-dedication": "copyright and related and neighboring rights to this software to the public domain worldwide",
    "epl2-terms": "made available under the terms of the Eclipse Public License 2.0",
    "bsl1-title": "Boost Software License - Version 1.0",
    "bsl1-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software",
}

# Ordered rules: licence, identifiers in their order of appearance; the first match of a licence counts.
RULES = [
    ("Apache-2.0", ["apache2-notice"]),
    ("Apache-2.0", ["apache2-notice-long", "apache2-compliance"]),
    ("Apache-2.0", ["apache2-notice-long", "apache2-obtain"]),
    ("Apache-2.0", ["apache2-obtain", "apache2-as-is"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-notice-2"]),
    ("MIT", ["mit-title", "mit-grant"]),
    ("MIT", ["mit-title-2", "mit-grant"]),
    ("MIT", ["mit-grant", "mit-keep", "mit-as-is"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("GPL-3.0", ["gpl-free", "gpl-terms", "gpl3-or-later"]),
    ("GPL-2.0", ["gpl-free", "gpl-terms", "gpl2-or-later"]),
    ("LGPL-3.0", ["lgpl-terms", "gpl3-or-later"]),
    ("LGPL-2.1", ["lgpl-terms", "lgpl21-or-later"]),
    ("AGPL-3.0", ["agpl-terms", "gpl3-or-later"]),
    ("MPL-2.0", ["mpl2-terms"]),
    ("ISC", ["isc-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("Unlicense", ["unlicense-notice"]),
    ("CC0-1.0", ["cc0-title"]),
    ("CC0-1.0", ["cc0-dedication"]),
    ("EPL-2.0", ["epl2-terms"]),
    ("BSL-1.0", ["bsl1-title"]),
    ("BSL-1.0", ["bsl1-grant"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-notice"]),
    ("CC-BY-4.0", ["cc-by-4-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-notice"]),
    ("BSD-3-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary"]),
    ("proprietary", ["rights-reserved"]),
]

#: parts of long sentences, found inside them; all other entries are whole sentences
PHRASES = {"apache2-notice-long", "apache2-compliance", "apache2-obtain", "apache2-as-is", "mit-grant", "mit-keep", "mit-as-is",
           "gpl-free", "gpl3-or-later", "gpl2-or-later", "bsd-redistribute", "bsd-source", "bsd-binary", "bsd-names",
           "gpl-terms", "lgpl-terms", "lgpl21-or-later", "agpl-terms", "mpl2-terms", "isc-grant", "zlib-grant", "cc0-dedication",
           "epl2-terms", "bsl1-grant"}

#: a sentence's end inside a line becomes CUT; a line end stays
CUT = "\x01"
SENTENCE_END = r"(?<=[.!?])[ \t\r]+"
#: what normalisation turns into a space: all but letters, digits and dots inside numbers
OTHER = r"[^a-z0-9.]+|\.(?![0-9])"


def normalise(sentence: str) -> str:
    import re

    return re.sub(OTHER, " ", re.sub("[A-Z]", lambda m: m.group().lower(), sentence)).strip(" ")


def known_sentences(sentences: dict[str, str] = SENTENCES) -> dict[str, str]:
    return {normalise(s): i for i, s in sentences.items()}


def pattern(sentences: dict[str, str] = SENTENCES, phrases=PHRASES) -> str:
    """One match per known entry, with the cut or space before it."""
    def either(part):  # the longest first: an entry may begin with another
        known = sorted((normalise(s) for i, s in sentences.items() if (i in phrases) == part), key=len, reverse=True)
        return "|".join(s.replace(".", r"\.").replace(" ", "[ \n]+") for s in known) or "(?!)"

    return f"[\n{CUT}] *(?:{either(False)}) *(?=[\n{CUT}])|[ \n{CUT}](?:{either(True)})(?=[ \n{CUT}])"


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules=RULES, phrases=PHRASES) -> DataFrame:
    """``doc_id, licenses, sentence_ids, first_sentence``: licences in rule order, identifiers in text
    order, and the number (from 0) of the sentence in which the first one begins."""
    table = F.create_map(*[F.lit(x) for kv in known_sentences(sentences).items() for x in kv])
    found = pattern(sentences, phrases)
    text = F.translate(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), CUT, "-")
    text = F.regexp_replace(F.regexp_replace(text, SENTENCE_END, CUT), OTHER.replace("[^", f"[^\n{CUT}"), " ")
    d = docs.select("doc_id", F.concat(F.lit("\n"), text, F.lit("\n")).alias("_t"))
    ids = F.transform(F.regexp_extract_all("_t", F.lit(found), F.lit(0)),
                      lambda m: F.element_at(table, F.trim(F.regexp_replace(m, f"[ \n{CUT}]+", " "))))
    d = d.select("doc_id", "_t", ids.alias("sentence_ids"))
    head = F.substring("_t", F.lit(1), F.length(F.split("_t", found, 2)[0]) + 1)
    cuts = F.length(F.regexp_replace(head, f"[^\n{CUT}]+", "")) - 1
    d = d.select("doc_id", "sentence_ids", F.when(F.size("sentence_ids") > 0, cuts).alias("first_sentence"))
    # one place per rule moves on with every identifier that the rule waits for: linear in the identifiers
    waits = F.array(*[F.array(*map(F.lit, own)) for _, own in rules])

    def step(places, one):
        return F.zip_with(places, waits, lambda p, own: p + F.coalesce((F.get(own, p) == one).cast("int"), F.lit(0)))

    places = F.when(F.size("sentence_ids") > 0, F.aggregate("sentence_ids", F.array_repeat(F.lit(0), len(rules)), step))
    d = d.select("*", places.alias("_p"))
    found = [F.when(F.get("_p", F.lit(i)) == len(own), F.lit(name)) for i, (name, own) in enumerate(rules)]
    return d.select("doc_id", F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("licenses"),
                    "sentence_ids", F.col("first_sentence").cast("long").alias("first_sentence"))


def oracle(sentences: dict[str, str] = SENTENCES, rules=RULES) -> str:
    """The same in DuckDB."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = known_sentences(sentences)
    table = f"MAP {{{', '.join(f'{q(k)}: {q(v)}' for k, v in known.items())}}}"
    cases = ", ".join(f"CASE WHEN regexp_matches(line, {q(',' + ',(?:.*,)?'.join(ids) + ',')}) THEN {q(name)} END" for name, ids in rules)
    marks = r"regexp_replace(coalesce(text, ''), '([.!?])[ \t\r]+', '\1' || chr(10), 'g')"
    return f"""
WITH s AS (SELECT doc_id, string_split({marks}, chr(10)) AS parts FROM documents),
i AS (SELECT doc_id, list_transform(parts, lambda x: ({table})[trim(regexp_replace(regexp_replace(lower(x),
        '\\.([0-9])', chr(1) || '\\1', 'g'), '[^a-z0-9' || chr(1) || ']+', ' ', 'g').replace(chr(1), '.'), ' ')]) AS ids FROM s),
k AS (SELECT doc_id, list_filter(ids, lambda x: x IS NOT NULL) AS sentence_ids,
        list_position(list_transform(ids, lambda x: x IS NOT NULL), true) - 1 AS first_sentence FROM i),
l AS (SELECT *, ',' || array_to_string(sentence_ids, ',') || ',' AS line FROM k),
r AS (SELECT *, list_filter([{cases}], lambda x: x IS NOT NULL) AS found FROM l)
SELECT doc_id, list_filter(found, lambda x, n: list_position(found, x) = n) AS licenses, sentence_ids,
       CAST(first_sentence AS BIGINT) AS first_sentence FROM r"""
