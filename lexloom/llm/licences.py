"""Licence scans by sentence rules (DataFrame functions only).

A text is cut into sentences, each sentence is normalised (lower case, runs of anything but letters and digits become one
blank) and looked up among the known licence sentences. Whether a line break ends a sentence can't be told from the break:
a line that begins with a small letter goes on with the one before; any other break may end a title or be a wrap ('BASIS,'
and 'WITHOUT WARRANTIES'), so each run of whole lines between two sentence ends is looked up that begins like a known
sentence. Blank lines end a sentence; marks of comments don't count. The found identifiers, in text order, are matched
against ordered licence rules: a rule holds if its identifiers appear in that order; sentences in between that are not
known don't matter. A rule that is part of a longer rule (say two clauses of three) gives way to it.

The SQL cuts at every line break that isn't followed by a small letter, so it finds less in wrapped and commented notices.

All of this is one narrow projection: no shuffle, no join, so no key can be hot. The sentence table is a literal map.

Defined results: a null text counts as empty and has no licence; other columns are ignored; repeated rows give repeated
rows; an empty table gives an empty result. `sentence_ids` is '' and n_licences 0 where nothing is found.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences (public licence texts and common notices), already normalised, by identifier.
SENTENCES: dict[str, str] = {
    "mit-ref": "released under the mit license",
    "mit-ref2": "licensed under the mit license",
    "mit-ref3": "this project is licensed under the terms of the mit license",
    "mit-title": "the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-asis": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache2-ref": "licensed under the apache license version 2 0",
    "apache2-ref2": "licensed under the apache license version 2 0 the license",
    "apache2-comply": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "apache2-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-limits": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-ref": "this work is licensed under the gnu general public license version 3",
    "gpl2-ref": "this work is licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software",
    "gpl3-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "mpl2-terms": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "ccbync4-ref": "licensed under cc by nc 4 0",
    "ccby4-ref": "licensed under cc by 4 0",
    "ccby4-ref2": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccbysa4-ref": "licensed under cc by sa 4 0",
    "cc0-ref": "this work is released under cc0 1 0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-grant": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "reserved": "all rights reserved",
}

# Ordered rules; each licence has one or more sequences of sentence identifiers.
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["apache2-ref"]),
    ("Apache-2.0", ["apache2-ref2", "apache2-comply", "apache2-asis", "apache2-limits"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("CC-BY-4.0", ["ccby4-ref"]),
    ("CC-BY-4.0", ["ccby4-ref2"]),
    ("CC-BY-NC-4.0", ["ccbync4-ref"]),
    ("CC-BY-SA-4.0", ["ccbysa4-ref"]),
    ("CC0-1.0", ["cc0-ref"]),
    ("GPL-2.0-only", ["gpl2-ref"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-terms"]),
    ("GPL-3.0-only", ["gpl3-ref"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-terms"]),
    ("ISC", ["isc-grant", "isc-asis"]),
    ("MIT", ["mit-ref"]),
    ("MIT", ["mit-ref2"]),
    ("MIT", ["mit-ref3"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-asis"]),
    ("MPL-2.0", ["mpl2-terms"]),
    ("Unlicense", ["unlicense-free", "unlicense-grant"]),
    ("all-rights-reserved", ["reserved"]),
]

#: A wrapped line: no sentence end before the line break, a small letter after it. Both engines use this pattern.
WRAP = r"([^.;:!?\s])[ \t]*\r?\n[ \t]*([a-z])"
#: The SQL's sentences end at a line break, or at . ; : ! or ? before white space or the end.
CUT = r"[.;:!?]+(?:\s+|$)|[\r\n]+"
#: Comment marks that would count as words or sentence ends (NOISE takes the others), and the marks of list items.
WORD_MARKS = r"(?m)^[ \t]*(?:dnl|rem|c[ \t])(?:[ \t]|$)"  # before WRAP, which would take them for words
MARKS = r"(?m)^[ \t]*(?:[/*#%>-]*[;!:.]+[ \t]|(?:DNL|REM|C[ \t])(?:[ \t]|$)|[*#/% \t-]*\(?[0-9a-zA-Z]{1,2}\)[ \t])[ \t]*"
#: Sentences end at . ; : ! or ? before white space or the end, but not in 'v. 2' and '; either version', or at a blank line (of a comment, too).
END = r"(?:\.(?<!\b[vV]\.(?=\s{1,9}[0-9]))|[:!?]|;(?!\W+either\W+version\b))[.;:!?]*(?:\s+|$)|(?:\r\n|\n|\r(?!\n))[^\p{L}\p{N}\r\n]*(?=[\r\n])"
BREAK = r"[\r\n]+"
NOISE = r"[^a-z0-9]+"


def _sequences() -> dict[str, list[str]]:
    """Licence -> LIKE patterns over '<id><id>...'."""
    out: dict[str, list[str]] = {}
    for licence, ids in RULES:
        out.setdefault(licence, []).append("%" + "%".join(f"<{i}>" for i in ids) + "%")
    return out


#: A licence whose rule is part of the other's rule gives way to that.
GIVES_WAY = [(a, b) for a, x in RULES for b, y in RULES if a != b and len(x) < len(y) and y[: len(x)] == x]


def normalise_sentence(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(col), NOISE, " "))


def scan_licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, sentence_ids ('<id><id>...' in text order), n_sentences (known ones), licences (sorted, comma-joined), n_licences."""
    known = F.create_map(*chain.from_iterable((F.lit(s), F.lit(i)) for i, s in SENTENCES.items()))
    longest, shortest = max(map(len, SENTENCES.values())), min(map(len, SENTENCES.values()))
    sentences = F.array(*map(F.lit, SENTENCES.values()))
    most = max(len(s.split()) for s in SENTENCES.values())  # lines: each has a word
    unwrapped = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WORD_MARKS, ""), WRAP, "$1 $2")
    pieces = F.split(F.regexp_replace(unwrapped, MARKS, ""), END)
    # Normalising never makes a sentence longer than it was, so short pieces can't be known sentences.
    plausible = F.filter(pieces, lambda s: F.length(s) >= shortest)
    lines = F.transform(plausible, lambda s: F.filter(F.transform(F.split(s, BREAK), normalise_sentence), lambda x: x != ""))

    def runs(own: Column) -> Column:
        """The runs of lines that may be known sentences, by their first line, then by their length."""
        def from_line(x: Column, i: Column) -> Column:
            begins = F.exists(sentences, lambda s: s.startswith(x))
            return F.when(begins, F.transform(F.sequence(F.lit(1), F.least(F.size(own) - i, F.lit(most))), lambda n: F.array_join(F.slice(own, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))

        return F.when(F.size(own) <= 1, own).otherwise(F.flatten(F.transform(own, from_line)))

    normal = F.filter(F.flatten(F.transform(lines, runs)), lambda s: F.length(s).between(shortest, longest))
    found = F.filter(F.transform(normal, lambda s: F.try_element_at(known, s)), lambda s: s.isNotNull())
    rows = docs.select(F.col(doc_id).alias("doc_id"), found.alias("__ll_ids"))
    rows = rows.withColumn("sentence_ids", F.array_join(F.transform("__ll_ids", lambda s: F.concat(F.lit("<"), s, F.lit(">"))), ""))
    holds: dict[str, Column] = {}
    for licence, patterns in _sequences().items():
        hit = F.lit(False)
        for p in patterns:
            hit = hit | F.col("sentence_ids").like(p)
        holds[licence] = hit
    final = {}
    for licence, hit in holds.items():
        for a, b in GIVES_WAY:
            if a == licence:
                hit = hit & ~holds[b]
        final[licence] = hit
    licences = F.array_compact(F.array(*[F.when(final[x], F.lit(x)) for x in sorted(final)]))
    rows = rows.withColumn("__ll_l", F.when(F.col("sentence_ids") == "", F.array().cast("array<string>")).otherwise(licences))
    return rows.select("doc_id", "sentence_ids", F.size("__ll_ids").cast("int").alias("n_sentences"), F.array_join("__ll_l", ",").alias("licences"), F.size("__ll_l").cast("int").alias("n_licences"))


def oracle_sql() -> str:
    """The same scan in DuckDB's SQL, from the same tables of sentences and rules."""
    def lit(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    keys = ", ".join(lit(s) for s in SENTENCES.values())
    ids = ", ".join(lit(i) for i in SENTENCES)
    hits = {}
    for licence, patterns in _sequences().items():
        hits[licence] = "(" + " OR ".join(f"sentence_ids LIKE {lit(p)}" for p in patterns) + ")"
    final = {}
    for licence, hit in hits.items():
        final[licence] = " AND ".join([hit, *[f"NOT {hits[b]}" for a, b in GIVES_WAY if a == licence]])
    cases = ", ".join(f"CASE WHEN {final[x]} THEN {lit(x)} END" for x in sorted(final))
    return f"""
WITH known AS (SELECT unnest([{keys}]) AS s, unnest([{ids}]) AS i),
pieces AS (
  SELECT rid, doc_id, p, trim(regexp_replace(lower(sentence), '{NOISE}', ' ', 'g')) AS s FROM (
    SELECT rid, doc_id, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS p FROM (
      SELECT row_number() OVER () AS rid, doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '{WRAP}', '\\1 \\2', 'g'), '{CUT}') AS parts FROM documents))
), found AS (
  SELECT rid, string_agg('<' || i || '>', '' ORDER BY p) AS sentence_ids, count(*) AS n FROM pieces JOIN known USING (s) GROUP BY rid
), ids AS (
  SELECT doc_id, coalesce(sentence_ids, '') AS sentence_ids, coalesce(n, 0)::INT AS n_sentences
  FROM (SELECT row_number() OVER () AS rid, doc_id FROM documents) LEFT JOIN found USING (rid)
), named AS (SELECT *, list_filter([{cases}], lambda x: x IS NOT NULL) AS l FROM ids)
SELECT doc_id, sentence_ids, n_sentences, array_to_string(l, ',') AS licences, len(l)::INT AS n_licences FROM named
"""
