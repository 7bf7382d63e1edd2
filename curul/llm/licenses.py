"""License scans by sentence rules.

Known licence sentences have identifiers; a licence rule is an ordered list of them. Texts are normalised,
known sentences are looked up between sentence or line ends, however their own lines are wrapped, and a rule
matches where its identifiers follow each other in a text's sequence of known sentences.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curul.llm.common import let, query, table, texts

# Sentences of published licence notices, by identifier. A sentence begins and ends at a full stop before
# white space, or with a line; inside, a single line end is white space and a blank line is not. Case, white space,
# punctuation and with it comment marks do not count. "..." stands for up to twelve words, "v~" for v with or without a stop.
SENTENCES = {
    "apache2-by": "Licensed under the Apache License, Version 2.0",
    "apache2-not-except": "you may not use this file except in compliance with the License",
    "apache2-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
    "apache2-copy": "You may obtain a copy of the License at",
    "apache2-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "mit-released": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-name": "The MIT License (MIT)",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-by": "Licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-see": "See the GNU General Public License for more details",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0",
    "cc-by-4": "Licensed under CC BY 4.0",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "reserved": "All rights reserved",
    "apache2-copy-http": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache2-copy-https": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "mit-title": "MIT License",
    "mit-the-title": "The MIT License",
    "bsd2-title": "BSD 2-Clause License",
    "bsd3-title": "BSD 3-Clause License",
    "bsd-names-of": "Neither the name of ... nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl2-free": "This ... is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl2-only": "This ... is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License",
    "gpl2-only-version": "This ... is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl3-free": "This ... is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl2-free": "This ... is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "lgpl21-free": "This ... is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-free": "This ... is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3-free": "This ... is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v~ 2.0",
    "isc-title": "ISC License",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "epl1-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v~ 1.0 which ... available at ...",
    "epl2-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v~ 2.0 which ... available at ...",
}

#: Licence rules in the order in which they are tried: the longest sequences first.
RULES = (
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-names-of")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl3-free", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-see")),
    ("GPL-2.0-only", ("gpl2-only", "gpl-hope", "gpl-see")),
    ("GPL-2.0-only", ("gpl2-only-version", "gpl-hope", "gpl-see")),
    ("Apache-2.0", ("apache2-notice", "apache2-copy", "apache2-as-is")),
    ("Apache-2.0", ("apache2-notice", "apache2-copy-http", "apache2-as-is")),
    ("Apache-2.0", ("apache2-notice", "apache2-copy-https", "apache2-as-is")),
    ("MIT", ("mit-grant", "mit-keep")),
    ("Apache-2.0", ("apache2-notice",)),
    ("Apache-2.0", ("apache2-by",)),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-name",)),
    ("GPL-3.0-only", ("gpl3-work",)),
    ("GPL-3.0-only", ("gpl3-by",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC0-1.0", ("cc0",)),
    ("all-rights-reserved", ("reserved",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-the-title",)),
    ("BSD-2-Clause", ("bsd2-title",)),
    ("BSD-3-Clause", ("bsd3-title",)),
    ("GPL-3.0-or-later", ("gpl3-free",)),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("GPL-2.0-only", ("gpl2-only",)),
    ("GPL-2.0-only", ("gpl2-only-version",)),
    ("LGPL-2.0-or-later", ("lgpl2-free",)),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("MPL-2.0", ("mpl2-subject",)),
    ("ISC", ("isc-title",)),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-grant-and",)),
    ("Unlicense", ("unlicense-free",)),
    ("EPL-1.0", ("epl1-terms",)),
    ("EPL-2.0", ("epl2-terms",)),
)

#: Every known sentence holds one of these, so texts without any are passed over.
HINTS = r"(?i)licen|permission|redistribut|free\W+software|warrant|copyright|permitted|rights\W+reserved|contributors\W+may\W+be\W+used|public\W+domain"
#: In a normalised text: the end of a sentence or paragraph, the end of a line inside one, and the start of a known sentence.
END, LINE, KNOWN = "\x01", "\x02", "\x03"


def normal(text: Column) -> Column:
    """Words with one space between them, and the marks of sentence and line ends."""
    steps = (
        (f"[{END}{LINE}{KNOWN}]", " "), (r"[.!?]+(?=\s|$)", END), (r"\n", LINE), (rf"[^\p{{L}}\p{{N}}.{END}{LINE}]+", " "),
        (f" *([{END}{LINE}]) *", "$1"), (f"{LINE}{{2,}}|[{END}{LINE}]*{END}[{END}{LINE}]*", END),
    )
    out = F.lower(text)
    for pattern, by in steps:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def written(sentence: str) -> str:
    """A known sentence as a pattern over normalised texts. A long one may follow the number or letter of a clause."""
    words = re.sub(r"[^\w.~]+", " ", sentence.lower()).split()
    some = rf"(?:[^ {END}{LINE}]+[ {LINE}]){{0,11}}[^ {END}{LINE}]+"
    parts = [some if w == "..." else w.replace(".", r"\.") for w in words]
    joined = f"[ {LINE}]".join(parts).replace(f"v~[ {LINE}]", f"v[ .{END}{LINE}]*")
    return (rf"(?:(?:\d{{1,2}}|[a-z])[ {LINE}])?" if len(words) > 12 else "") + joined


#: Longer sentences are tried first, and a sentence with fixed words before one with gaps.
PATTERNS = {name: written(SENTENCES[name]) for name in sorted(SENTENCES, key=lambda n: ("..." in SENTENCES[n], -len(SENTENCES[n])))}
SENTENCE = f"(?<![^{END}{LINE}])(?:{'|'.join(PATTERNS.values())})(?![^{END}{LINE}])"


#: A text's known sentences are written ``id@place`` in order; the rules are one pattern over that writing.
RULE = "(?<![^ ])(?:" + "|".join(" ".join(rf"{name}@\d+" for name in ids) for _, ids in RULES) + ")(?![^ ])"


def rule_spans(known: Column) -> Column:
    """(licence, first, last sentence place) of each rule met in a text's known sentences (place, id).

    From left to right, the earliest rule of the list whose ids follow each other from a sentence on takes them all.
    """
    licences = F.create_map(*(F.lit(x) for licence, ids in RULES for x in (" ".join(ids), licence)))
    written = F.array_join(F.transform(known, lambda s: F.concat(s["id"], F.lit("@"), s["place"].cast("string"))), " ")
    return F.transform(
        F.regexp_extract_all(written, F.lit(RULE), F.lit(0)),
        lambda m: F.struct(
            F.element_at(licences, F.regexp_replace(m, r"@\d+", "")).alias("licence"),
            F.regexp_extract(m, r"@(\d+)", 1).cast("int").alias("first"),
            F.regexp_extract(m, r"@(\d+)$", 1).cast("int").alias("last"),
        ),
    )


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``known``, its licence sentences in order, and ``spans``, the rules they match.

    Null and empty texts know no sentence. A sentence that repeats is known each time; rows that
    repeat are scanned each. All of a text is read; sentences stay in their row, so nothing is shuffled.
    """
    between, found = (lambda t: F.split(t, SENTENCE)), (lambda t: F.regexp_extract_all(t, F.lit(SENTENCE), F.lit(0)))

    def units(text: Column) -> Column:
        cut = F.zip_with(between(text), found(text), lambda other, known: F.concat(F.split(F.coalesce(other, F.lit("")), f"[{END}{LINE}]"), F.array(F.concat(F.lit(KNOWN), known))))
        return F.filter(F.flatten(F.transform(cut, lambda c: F.coalesce(c, F.array().cast("array<string>")))), lambda u: u != "")

    def name(known: Column) -> Column:
        return F.coalesce(*(F.when(known.rlike(f"^{KNOWN}{pattern}$"), F.lit(name)) for name, pattern in PATTERNS.items()))

    none = F.array().cast("array<string>")
    sentences = F.when(F.col("text").rlike(HINTS), let(normal(F.col("text")), lambda t: F.when(t.rlike(SENTENCE), units(t)).otherwise(none))).otherwise(none)
    numbered = docs.withColumn("known", F.transform(sentences, lambda u, i: F.struct(i.alias("place"), u.alias("id"))))
    rows = numbered.withColumn("known", F.transform(F.filter("known", lambda u: u["id"].startswith(KNOWN)), lambda u: F.struct(u["place"].alias("place"), name(u["id"]).alias("id"))))
    return rows.withColumn("spans", F.when(F.size("known") == 0, F.array().cast("array<struct<licence: string, first: int, last: int>>")).otherwise(rule_spans(F.col("known"))))


@query(
    r"""
WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]+(?:\s|$)|\n')) AS s FROM documents),
     n AS (SELECT doc_id, trim(regexp_replace(lower(s), '[^\p{L}\p{N}.]+', ' ', 'g')) AS s FROM s),
     k AS (SELECT doc_id, CASE s WHEN 'licensed under the apache license version 2.0' THEN 'Apache-2.0' WHEN 'released under the mit license' THEN 'MIT'
                                 WHEN 'this work is licensed under the gnu general public license version 3' THEN 'GPL-3.0-only'
                                 WHEN 'licensed under cc by nc 4.0' THEN 'CC-BY-NC-4.0' WHEN 'licensed under cc by 4.0' THEN 'CC-BY-4.0'
                                 WHEN 'licensed under cc by sa 4.0' THEN 'CC-BY-SA-4.0' WHEN 'all rights reserved' THEN 'all-rights-reserved' END AS l FROM n)
SELECT d.doc_id, count(l) AS n_sentences, coalesce(string_agg(DISTINCT l, ',' ORDER BY l), '') AS licences
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id"""
)
def op8_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Licences of all documents: how many known sentences, and which licences their rules give."""
    rows = scanned(texts(table(spark, folder, "documents")))
    names = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["licence"])))
    return rows.select("doc_id", F.size("known").cast("long").alias("n_sentences"), F.array_join(names, ",").alias("licences"))
