"""Licence scan: sentences to identifiers, identifier sequences to licences.

Only sentences with a word that licence texts use are looked at.  Each is
normalised and mapped to a known sentence identifier; the identifiers of a
document, in order, are matched against ordered rules.  A rule that matches
takes its identifiers out, so a later, shorter rule cannot claim them again.
Sentences run over single line feeds, as licence texts are wrapped; a known
sentence that fills whole lines is found even if its neighbours have no end.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A sentence with none of these words is not about licensing.
CRITICAL = (
    "licen[cs]e|copyright|rights reserved|public domain|permission|redistribut|warrant|spdx|free software|"
    "gnu general public|gnu lesser|without modification|liable"
)

# Normalised sentence to identifier: fixed values.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache-2-ref",
    "licensed under the apache license version 2 0 the license": "apache-2-ref",
    "you may not use this file except in compliance with the license": "apache-use",
    "you may obtain a copy of the license at": "apache-copy",
    "spdx license identifier apache 2 0": "apache-2-spdx",
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "spdx license identifier mit": "mit-spdx",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind": "as-is",
    "this work is licensed under the gnu general public license version 3": "gpl-3-ref",
    "spdx license identifier gpl 3 0 only": "gpl-3-spdx",
    "this program is free software": "gpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "either version 3 of the license or at your option any later version": "gpl-3-later",
    "either version 2 of the license or at your option any later version": "gpl-2-later",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-no-warranty",
    "licensed under cc by nc 4 0": "cc-by-nc-4-ref",
    "licensed under cc by 4 0": "cc-by-4-ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4-ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "this work is in the public domain": "public-domain",
    "all rights reserved": "all-rights",
}

# Sequences of identifiers in the order they are tried: fixed values.
RULES = (
    ("GPL-3.0-or-later", ("gpl-free", "gpl-terms", "gpl-3-later")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-terms", "gpl-2-later")),
    ("GPL-3.0-or-later", ("gpl-terms", "gpl-3-later")),
    ("GPL-2.0-or-later", ("gpl-terms", "gpl-2-later")),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-2-ref", "apache-use", "apache-copy")),
    ("Apache-2.0", ("apache-2-ref",)),
    ("Apache-2.0", ("apache-2-spdx",)),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-spdx",)),
    ("GPL-3.0-only", ("gpl-3-ref",)),
    ("GPL-3.0-only", ("gpl-3-spdx",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-ref",)),
    ("CC-BY-4.0", ("cc-by-4-ref",)),
    ("Public-Domain", ("public-domain",)),
    ("Proprietary", ("all-rights",)),
)

# Sentences of the official texts as they stand there; "*" is one or more words.
_NAMES = "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_TERMS = "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version"
OFFICIAL = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as-is",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    f"{_TERMS} 3 of the license or at your option any later version": "gpl-3-notice",
    f"{_TERMS} 2 of the license or at your option any later version": "gpl-2-notice",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-no-implied",
    "see the gnu general public license for more details": "gpl-see",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    f"neither the name of * {_NAMES}": "bsd-name",
    _NAMES: "bsd-name",
}

# Tried before RULES.
OFFICIAL_RULES = (
    ("GPL-3.0-or-later", ("gpl-free", "gpl-3-notice")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-2-notice")),
    ("GPL-3.0-or-later", ("gpl-3-notice",)),
    ("GPL-2.0-or-later", ("gpl-2-notice",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
)

# Further notices as they stand in the official texts and in common use: fixed values.
_FSF = "you can redistribute it and or modify it under the terms of the gnu {} general public license as published by the free software foundation"
OFFICIAL |= {
    "this library is free software": "lgpl-free",
    _FSF.format("lesser"): "lgpl-terms",
    "either version 2 1 of the license or at your option any later version": "lgpl-2-1-later",
    f"{_FSF.format('lesser')} either version 3 of the license or at your option any later version": "lgpl-3-notice",
    f"{_FSF.format('affero')} either version 3 of the license or at your option any later version": "agpl-3-notice",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this is free and unencumbered software released into the public domain": "unlicense",
    # The stop of "v. 2.0" ends the sentence.
    "this source code form is subject to the terms of the mozilla public license v": "mpl-2-notice",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4-ref",
    "this work is licensed under the creative commons attribution sharealike 4 0 international license": "cc-by-sa-4-ref",
    "licensed under cc by sa 4 0": "cc-by-sa-4-ref",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-as-is",
}
REFERENCES = {
    "mit license": "mit-ref", "apache license version 2 0": "apache-2-ref", "apache license 2 0": "apache-2-ref", "isc license": "isc-ref",
    "mozilla public license 2 0": "mpl-2-ref", "gnu general public license version 3": "gpl-3-ref", "bsd 3 clause license": "bsd-3-ref",
}
for _name, _id in REFERENCES.items():
    for _end in ("", " *"):
        OFFICIAL |= {f"this * is licensed under the {_name}{_end}": _id, f"licensed under the {_name}{_end}": _id}
OFFICIAL_RULES += (
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl-terms", "lgpl-2-1-later")),
    ("LGPL-3.0-or-later", ("lgpl-3-notice",)),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl-3-notice")),
    ("AGPL-3.0-or-later", ("agpl-3-notice",)),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-ref",)),
    ("Unlicense", ("unlicense",)),
    ("MPL-2.0", ("mpl-2-notice",)),
    ("MPL-2.0", ("mpl-2-ref",)),
    ("BSD-3-Clause", ("bsd-3-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-ref",)),
)

# Names in SPDX tags beside the three of SENTENCES: fixed values.
SPDX = (
    "AGPL-3.0-only", "AGPL-3.0-or-later", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0",
    "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
)
# Older names and what they mean today; an exception is no licence of its own.
SPDX_OLD = {"GPL-2.0": "GPL-2.0-only", "GPL-3.0": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3.0": "LGPL-3.0-only", "AGPL-3.0": "AGPL-3.0-only"}
SPDX_EXCEPTIONS = ("Classpath-exception-2.0", "GCC-exception-3.1", "LLVM-exception", "Bison-exception-2.2", "Linux-syscall-note")


def _tag(name: str) -> str:
    return "spdx license identifier " + re.sub("[^a-z0-9]+", " ", name.lower())


def _tag_id(name: str) -> str:
    return "spdx-" + re.sub("[^a-z0-9]+", "-", name.lower())


TAGS = {
    **{_tag(n): _tag_id(n) for n in SPDX}, **{_tag(old): _tag_id(now) for old, now in SPDX_OLD.items()},
    **{_tag(n): "spdx-exception" for n in SPDX_EXCEPTIONS},
}
TAG_RULES = tuple((n, (_tag_id(n),)) for n in (*SPDX, "GPL-3.0-only"))

COPYRIGHT, UNKNOWN = "copyright", "unknown"
# Sentences end at . ! ? ; : before a blank or the end of the line, or at a line without letters and digits.
# The colon of an SPDX tag ends none.
BREAK = r"(?<![.!?;:])(?<!spdx-license-identifier)[.!?;:]++(?:[ \t\r]++|[^a-z0-9\n]*+\n)|\n[^a-z0-9]*\n"
# Where a sentence goes on in the next line, with its indent or comment mark.
WRAP = r"[^a-z0-9\n]*\n[^a-z0-9]*"
# For the SQL, in which a sentence also ends at every line feed.
LINE_BREAK = r"\n|[.!?;:]+[ \t\r]+"


# An SPDX expression of up to so many names is read name by name.
NAMES = 8
_EXPRESSION = r"(spdx-license-identifier:[^\n]*?[a-z0-9.)])[ \t]+(?:or|and|with)[ \t]+"
_OR_LATER = r"(spdx-license-identifier:[^\n]*?[0-9])\+"


def single_tags(text: Column) -> Column:
    """A lower-case text in which each name of an SPDX expression has a tag of its own."""
    out = text
    for _ in range(NAMES):
        out = F.regexp_replace(out, _OR_LATER, "$1-or-later")
    for _ in range(NAMES - 1):
        out = F.regexp_replace(out, _EXPRESSION, "$1. spdx-license-identifier: ")
    return F.when(F.contains(text, F.lit("spdx-license-identifier:")), out).otherwise(text)


def normalised(sentence: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def _parts(sentence: Column, sentences: Mapping[str, str]) -> Column:
    """Identifiers of a lower-case sentence of several lines that is not known as a whole.

    Known sentences that fill whole lines are taken out first, the longest
    first, then lines that start as a copyright notice; the lines between two
    of these are one sentence.
    """
    lines = F.trim(F.regexp_replace(F.regexp_replace(sentence, WRAP, "\n"), "[^a-z0-9\n]+", " "))
    for words in sorted(sentences, key=len, reverse=True):
        pattern = "[ \n]".join(words.split()).replace("*", "[a-z0-9 \n]+?")
        lines = F.regexp_replace(lines, f"(?m)^{pattern}$", f"={sentences[words]}")
    rest = F.split(F.regexp_replace(lines, "(?m)^(=.*|copyright (?:c |[0-9]).*)$", "|$1|"), r"\|")
    critical = F.filter(
        F.transform(rest, lambda x: F.trim(F.replace(x, F.lit("\n"), F.lit(" ")))), lambda x: x.startswith("=") | x.rlike(CRITICAL)
    )
    return F.transform(
        critical,
        lambda x: F.when(x.startswith("="), F.substring(x, 2, 1000)).when(x.startswith("copyright"), F.lit(COPYRIGHT)).otherwise(F.lit(UNKNOWN)),
    )


def scan_licenses(
    docs: DataFrame, identity: str = "doc_id", text: str = "text",
    sentences: Mapping[str, str] = {**SENTENCES, **OFFICIAL, **TAGS}, rules: Sequence[tuple[str, Sequence[str]]] = (*OFFICIAL_RULES, *RULES, *TAG_RULES),
) -> DataFrame:
    """Per row: (doc_id, n_sentences, n_unknown, sentence_ids, licenses).

    ``sentence_ids`` are the identifiers of all licence sentences in order,
    comma-joined; a sentence that starts with "copyright" is ``copyright``,
    any other that is not known is ``unknown``.  ``licenses`` are the distinct
    licences whose rules matched, in rule order, comma-joined.  A null or
    empty text, or one without licence sentences, gives zeros and empty
    strings.  A licence sentence repeated in one text is listed each time.
    Every name of an SPDX expression (``OR``, ``AND``, ``WITH``) is a sentence.
    Rows are judged one by one: ties, repeated rows and null ids stay as they
    are, an empty table gives no rows, other columns are ignored.
    """
    known = F.create_map(*[F.lit(x) for pair in sentences.items() if "*" not in pair[0] for x in pair])
    wide = [(s.replace("*", ".+"), i) for s, i in sentences.items() if "*" in s]
    parts = F.split(single_tags(F.lower(F.coalesce(F.col(text), F.lit("")))), BREAK)

    def identified(s: Column) -> Column:
        whole = F.element_at(known, normalised(s))
        for pattern, name in wide:
            # A sentence over several lines may hold a known one of its own, so it is left to _parts.
            whole = F.coalesce(whole, F.when(~F.contains(s, F.lit("\n")) & normalised(s).rlike(f"^{pattern}$"), F.lit(name)))
        alone = F.when(normalised(s).startswith("copyright"), F.lit(COPYRIGHT)).otherwise(F.lit(UNKNOWN))
        return (
            F.when(whole.isNotNull(), F.array(whole))
            .when(F.contains(s, F.lit("\n")), _parts(s, sentences)).otherwise(F.array(alone))
        )

    critical = CRITICAL.replace(" ", f"(?: |{WRAP})")
    named = F.flatten(F.transform(F.filter(parts, lambda s: s.rlike(critical)), identified))
    out = docs.select(F.col(identity).alias("doc_id"), named.alias("ids")).withColumns({
        "_rest": F.concat(F.lit(","), F.array_join(F.filter("ids", lambda x: ~x.isin(COPYRIGHT, UNKNOWN)), ",,"), F.lit(",")),
        "_found": F.array().cast("array<string>"),
    })
    # Every identifier stands between two commas of its own, so that a match never cuts into a neighbour.
    for name, sequence in rules:
        wanted = F.lit("," + ",,".join(sequence) + ",")
        out = out.withColumns({
            "_found": F.when(F.contains("_rest", wanted), F.array_append("_found", F.lit(name))).otherwise(F.col("_found")),
            "_rest": F.replace("_rest", wanted, F.lit("|")),
        })
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.size(F.filter("ids", lambda x: x == UNKNOWN)).cast("long").alias("n_unknown"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(F.array_distinct("_found"), ",").alias("licenses"),
    )


def _oracle() -> str:
    pairs = ", ".join(f"('{s}', '{i}')" for s, i in {**SENTENCES, **TAGS}.items())
    steps, last = [], "seq"
    for n, (name, sequence) in enumerate((*RULES, *TAG_RULES)):
        wanted = "," + ",,".join(sequence) + ","
        steps.append(
            f"r{n} AS (SELECT doc_id, ids, replace(rest, '{wanted}', '|') AS rest, "
            f"CASE WHEN contains(rest, '{wanted}') AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END AS found FROM {last})"
        )
        last = f"r{n}"
    return rf"""
WITH known(sentence, id) AS (VALUES {pairs}),
lines AS (SELECT doc_id, string_split(lower(coalesce(text, '')), chr(10)) AS l FROM documents),
-- A line with an SPDX tag is as many sentences as its expression has names.
tagged AS (SELECT doc_id, array_to_string(list_transform(l, lambda x: CASE WHEN contains(x, 'spdx-license-identifier:') THEN
    regexp_replace(regexp_replace(regexp_replace(x, '([0-9])\+', '\1-or-later', 'g'), '[ \t]+(or|and|with)[ \t]+', chr(10) || 'spdx-license-identifier ', 'g'),
      'spdx-license-identifier:', 'spdx-license-identifier', 'g') ELSE x END), chr(10)) AS text FROM lines),
parts AS (SELECT doc_id, s, pos FROM (
  SELECT doc_id, unnest(p) AS s, unnest(range(len(p))) AS pos FROM (SELECT doc_id, string_split_regex(text, '{LINE_BREAK}') AS p FROM tagged))
  WHERE regexp_matches(lower(s), '{CRITICAL}')),
ids AS (SELECT doc_id, pos, coalesce(id, CASE WHEN starts_with(n, 'copyright') THEN '{COPYRIGHT}' ELSE '{UNKNOWN}' END) AS id
  FROM (SELECT doc_id, pos, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS n FROM parts) LEFT JOIN known ON n = sentence),
seq AS (SELECT doc_id, coalesce(l, []::VARCHAR[]) AS ids,
    ',' || array_to_string([x FOR x IN coalesce(l, []::VARCHAR[]) IF x NOT IN ('{COPYRIGHT}', '{UNKNOWN}')], ',,') || ',' AS rest, []::VARCHAR[] AS found
  FROM documents LEFT JOIN (SELECT doc_id, list(id ORDER BY pos) AS l FROM ids GROUP BY doc_id) USING (doc_id)),
{",".join(steps)}
SELECT doc_id, len(ids)::BIGINT AS n_sentences, len([x FOR x IN ids IF x = '{UNKNOWN}'])::BIGINT AS n_unknown,
  coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(array_to_string(found, ','), '') AS licenses FROM {last}"""


ORACLE = _oracle()
