"""Licence scans by sentences: known sentences become identifiers, and ordered rules recognise licences in their sequence.

All is done inside each row by expressions, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of public licences and of lines that name them, by identifier.
SENTENCES = {
    "MitGrant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "MitNotice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "AsIs": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "NoLiability": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "BsdConditions": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BsdSource": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BsdBinary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "BsdEndorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "IscGrant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "ApacheMayNotUse": ["you may not use this file except in compliance with the license"],
    "ApacheObtain": ["you may obtain a copy of the license at"],
    "GplFree": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "GplHope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "GplDetails": ["see the gnu general public license for more details"],
    "MplTerms": ["this source code form is subject to the terms of the mozilla public license v. 2.0"],
    "Unlicense": ["this is free and unencumbered software released into the public domain"],
    "NamesMit": ["released under the mit license", "licensed under the mit license", "this work is licensed under the mit license"],
    "NamesApache2": ["licensed under the apache license version 2.0", "this work is licensed under the apache license version 2.0", "released under the apache license version 2.0"],
    "NamesGpl3": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3"],
    "NamesGpl2": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "released under the gnu general public license version 2"],
    "NamesLgpl3": ["licensed under the gnu lesser general public license version 3", "this work is licensed under the gnu lesser general public license version 3"],
    "NamesBsd3": ["licensed under the bsd 3 clause license", "released under the bsd 3 clause license"],
    "NamesCcBy": ["licensed under cc by 4.0", "this work is licensed under cc by 4.0"],
    "NamesCcByNc": ["licensed under cc by nc 4.0", "this work is licensed under cc by nc 4.0"],
    "NamesCcBySa": ["licensed under cc by sa 4.0", "this work is licensed under cc by sa 4.0"],
    "NamesCc0": ["licensed under cc0 1.0", "this work is dedicated to the public domain under cc0 1.0"],
    "AllRights": ["all rights reserved"],
}
# Rules in the order they are tried; what a rule has taken, later ones don't see.
RULES = [
    ("MIT", ["MitGrant", "MitNotice", "AsIs", "NoLiability"]),
    ("BSD-3-Clause", ["BsdConditions", "BsdSource", "BsdBinary", "BsdEndorse"]),
    ("BSD-2-Clause", ["BsdConditions", "BsdSource", "BsdBinary"]),
    ("Apache-2.0", ["NamesApache2", "ApacheMayNotUse", "ApacheObtain"]),
    ("GPL-3.0-or-later", ["GplFree", "GplHope", "GplDetails"]),
    ("ISC", ["IscGrant"]),
    ("MPL-2.0", ["MplTerms"]),
    ("Unlicense", ["Unlicense"]),
    ("Apache-2.0", ["NamesApache2"]),
    ("BSD-3-Clause", ["NamesBsd3"]),
    ("CC-BY-4.0", ["NamesCcBy"]),
    ("CC-BY-NC-4.0", ["NamesCcByNc"]),
    ("CC-BY-SA-4.0", ["NamesCcBySa"]),
    ("CC0-1.0", ["NamesCc0"]),
    ("GPL-2.0", ["NamesGpl2"]),
    ("GPL-3.0", ["NamesGpl3"]),
    ("LGPL-3.0", ["NamesLgpl3"]),
    ("MIT", ["NamesMit"]),
]
#: Further wordings, as licence texts and file headers have them; the SQL does not know these.
WORDINGS = {
    "IscGrant": ["permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "ApacheObtain": [
        f"you may obtain a copy of the license at {scheme} www.apache.org licenses license 2.0{rest}"
        for scheme in ("http", "https")
        for rest in ("", " unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied")
    ],
    "NamesApache2": ["licensed under the apache license version 2.0 the license", "the asf licenses this file to you under the apache license version 2.0 the license"],
    "Gpl2Free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
}
WORDING_RULES = [("GPL-2.0-or-later", ["Gpl2Free", "GplHope", "GplDetails"])]
#: Ends of sentences. The scan also finds known sentences across them, as wrapped lines and abbreviations have them inside.
BREAKS = r"[.!?;:]+[\x20\t\r\n]+|[\r\n]+"
#: An end of a sentence and a comment marker of letters after it.
MARKER = r"[\x20\t]*(?:dnl|rem)\b"
BREAK = rf"(?:{BREAKS})(?:{MARKER})?|^{MARKER}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _tag(ids: list[str]) -> str:
    return "".join(f"<{x}>" for x in ids)


def _openings() -> dict[str, str]:
    """Known sentence -> identifier."""
    return {s: k for k, many in SENTENCES.items() for s in many}


def sentence_ids(text: Column) -> Column:
    """Identifiers of a text's known sentences, in order.

    A known sentence begins and ends where a sentence does. Breaks between its words (wrapped lines, comment markers, a
    semicolon, the dot of an abbreviation) don't count.
    """
    every = _openings() | {s: k for k, many in WORDINGS.items() for s in many}
    every = {s.replace(". ", " "): k for s, k in every.items()}
    known = F.create_map(*[F.lit(x) for pair in every.items() for x in pair])
    t = F.translate(F.coalesce(text, F.lit("")), UPPER + "|", LOWER + "-")
    # Breaks become bars without spaces and dots around them, other symbols single spaces.
    for old, new in ((BREAK, "|"), (r"[^a-z0-9.|]+", " "), (r"(?<![ .|])(?=[ .]*+\|)[ .|]++", "|")):
        t = F.regexp_replace(t, old, new)
    # Of sentences that begin alike, the longest one is tried first.
    one = "|".join("(?:[| ]|[.] )".join(w.replace(".", "[.]") for w in s.split()) for s in sorted(every, key=len, reverse=True))
    found = F.regexp_extract_all(t, F.lit(rf"(?:^[ .]*|\|)({one})(?=\||[ .]*$)"), F.lit(1))
    return F.filter(F.transform(found, lambda s: F.element_at(known, F.regexp_replace(s, r"\||[.] ", " "))), lambda k: k.isNotNull())


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, n_sentences (known ones), sentences (their identifiers), licenses (distinct
    names of rules that matched, sorted, comma-joined), n_unmatched (known sentences that no rule took).

    A rule matches its identifiers next to each other, whatever other text lies between their sentences. Null and empty
    texts have none, as have texts that only mention a licence inside a sentence. Rows that repeat an id each get a row;
    an empty table gives none; other columns are not read.
    """
    rows = docs.select(F.col(id_col), sentence_ids(F.col(text_col)).alias("ids"))
    sequence = F.array_join(F.transform("ids", lambda k: F.concat(F.lit("<"), k, F.lit(">"))), "")
    left = sequence
    for name, ids in [*RULES, *WORDING_RULES]:
        left = F.replace(left, F.lit(_tag(ids)), F.lit(f"[{name}]"))
    rows = rows.select(id_col, F.size("ids").cast("long").alias("n_sentences"), sequence.alias("sentences"), left.alias("left"))
    names = F.array_sort(F.array_distinct(F.regexp_extract_all("left", F.lit(r"\[([^\]]+)\]"))))
    return rows.select(id_col, "n_sentences", "sentences", F.array_join(names, ",").alias("licenses"), F.regexp_count("left", F.lit("<")).cast("long").alias("n_unmatched"))


def scan_sql() -> str:
    """DuckDB SQL of the scan over the table documents, for known sentences without a break inside and without WORDINGS."""
    known = ", ".join(f"'{s}': '{k}'" for s, k in _openings().items())
    left = "sentences"
    for name, ids in RULES:
        left = f"replace({left}, '{_tag(ids)}', '[{name}]')"
    return rf"""
WITH p AS (
  SELECT doc_id, string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BREAKS}') AS parts FROM documents
), i AS (
  SELECT doc_id, list_filter(list_transform(parts, lambda s: map_extract_value(MAP {{{known}}}, regexp_replace(regexp_replace(s, '[^a-z0-9.]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g'))), lambda k: k IS NOT NULL) AS ids FROM p
), s AS (
  SELECT doc_id, len(ids) AS n_sentences, coalesce(array_to_string(list_transform(ids, lambda k: '<' || k || '>'), ''), '') AS sentences FROM i
), r AS (SELECT *, {left} AS rest FROM s)
SELECT doc_id, n_sentences, sentences, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(rest, '\[([^\]]+)\]', 1))), ','), '') AS licenses,
       len(rest) - len(replace(rest, '<', '')) AS n_unmatched
FROM r"""
