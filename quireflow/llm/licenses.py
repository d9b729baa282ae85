"""License scan by sentences and rules, in column expressions only.

A text is cut into sentences, each is normalised and mapped to the identifier of a known licence sentence, and the
sequence of identifiers is matched against an ordered list of rules; a rule that matches takes its sentences away from
the rules after it. Row by row: no shuffle, nothing is broadcast but the constant tables below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifier and pattern of known licence sentences, as normalised by `normalised` (public licence texts).
# "v. 2.0" is cut behind the "v"; no other version of that licence has the sentence.
SENTENCES = [
    ("apache2-licensed", r"(this (work|file|software|project) is )?licensed under the apache license,? version 2(\.0)?( \(the \"?license\"?\))?(;? you may not use this file except in compliance with the license)?"),
    ("apache2-condition", r"you may not use this file except in compliance with the license"),
    ("apache2-copy", r"you may obtain a copy of the license at https?://www\.apache\.org/licenses/license-2\.0"),
    ("apache2-asis", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"?as is\"? basis, without warranties or conditions of any kind, either express or implied"),
    ("apache2-limits", r"see the license for the specific language governing permissions and limitations under the license"),
    ("mit-named", r"(this (work|file|software|project) is )?(released|licensed|distributed|available) under the (terms of the )?mit licen[sc]e"),
    ("mit-title", r"(the )?mit license( \(mit\))?"),
    ("mit-grant", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \(the \"?software\"?\), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions:?"),
    ("mit-notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-asis", r"the software is provided \"?as is\"?, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"),
    ("mit-liability", r"in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"),
    ("isc-grant", r"permission to use, copy, modify, and(/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd-grant", r"redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:?"),
    ("bsd-source", r"([0-9*][.)]? ?)?redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-binary", r"([0-9*][.)]? ?)?redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-endorse", r"([0-9*][.)]? ?)?neither the name of .{1,200} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd3-named", r"(this (work|file|software|project) is )?(released|licensed|distributed) under the (terms of the )?(bsd 3-clause|3-clause bsd|new bsd) licen[sc]e"),
    ("bsd2-named", r"(this (work|file|software|project) is )?(released|licensed|distributed) under the (terms of the )?(bsd 2-clause|2-clause bsd|simplified bsd) licen[sc]e"),
    ("gpl3-named", r"(this (work|file|software|program|project) is )?(released|licensed|distributed) under the (terms of the )?gnu general public license,? (version 3|v3)(\.0)?( only)?"),
    ("gpl2-named", r"(this (work|file|software|program|project) is )?(released|licensed|distributed) under the (terms of the )?gnu general public license,? (version 2|v2)(\.0)?( only)?"),
    ("lgpl3-named", r"(this (work|file|software|program|project) is )?(released|licensed|distributed) under the (terms of the )?gnu lesser general public license,? (version 3|v3)(\.0)?( only)?"),
    ("agpl3-named", r"(this (work|file|software|program|project) is )?(released|licensed|distributed) under the (terms of the )?gnu affero general public license,? (version 3|v3)(\.0)?( only)?"),
    ("gpl3-orlater", r"this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or \(at your option\) any later version"),
    ("gpl2-orlater", r"this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; either version 2 of the license, or \(at your option\) any later version"),
    ("gpl-hope", r"this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-received", r"you should have received a copy of the gnu general public license along with this program"),
    ("mpl2-terms", r"this source code form is subject to the terms of the mozilla public license, v(\. 2\.0)?"),
    ("mpl2-copy", r"if a copy of the mpl was not distributed with this file, you can obtain one at https?://mozilla\.org/mpl/2\.0/?"),
    ("cc-by-nc4-named", r"(this (work|file|text|document) is )?(released|licensed) under (a |the )?(cc by-nc 4\.0|creative commons attribution-noncommercial 4\.0 international)( licen[sc]e)?"),
    ("cc-by-sa4-named", r"(this (work|file|text|document) is )?(released|licensed) under (a |the )?(cc by-sa 4\.0|creative commons attribution-sharealike 4\.0 international)( licen[sc]e)?"),
    ("cc-by4-named", r"(this (work|file|text|document) is )?(released|licensed) under (a |the )?(cc by 4\.0|creative commons attribution 4\.0 international)( licen[sc]e)?"),
    ("cc0-named", r"(this (work|file|text|document) is )?(released|licensed|dedicated) (under|to) (the )?(cc0 1\.0|public domain under cc0 1\.0)( universal)?"),
    ("unlicense-domain", r"this is free and unencumbered software released into the public domain"),
    ("zlib-asis", r"this software is provided 'as-is', without any express or implied warranty"),
    ("zlib-grant", r"permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:?"),
    ("spdx-apache2", r"spdx-license-identifier: apache-2\.0"),
    ("spdx-mit", r"spdx-license-identifier: mit"),
    ("spdx-bsd3", r"spdx-license-identifier: bsd-3-clause"),
    ("spdx-gpl3", r"spdx-license-identifier: gpl-3\.0(-only|-or-later)?"),
    ("spdx-gpl2", r"spdx-license-identifier: gpl-2\.0(-only|-or-later)?"),
]

# Licence and the sentence identifiers that state it, in order; longer rules stand before their parts.
RULES = [
    ("Apache-2.0", ["apache2-licensed", "apache2-condition", "apache2-copy", "apache2-asis", "apache2-limits"]),
    ("Apache-2.0", ["apache2-licensed", "apache2-copy", "apache2-asis", "apache2-limits"]),
    ("Apache-2.0", ["apache2-licensed", "apache2-condition"]),
    ("Apache-2.0", ["apache2-licensed"]),
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "mit-asis", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-asis", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-named"]),
    ("MIT", ["mit-title"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd3-named"]),
    ("BSD-2-Clause", ["bsd2-named"]),
    ("ISC", ["isc-grant"]),
    ("GPL-3.0-or-later", ["gpl3-orlater", "gpl-hope", "gpl-received"]),
    ("GPL-3.0-or-later", ["gpl3-orlater"]),
    ("GPL-2.0-or-later", ["gpl2-orlater", "gpl-hope", "gpl-received"]),
    ("GPL-2.0-or-later", ["gpl2-orlater"]),
    ("GPL-3.0", ["gpl3-named"]),
    ("GPL-2.0", ["gpl2-named"]),
    ("LGPL-3.0", ["lgpl3-named"]),
    ("AGPL-3.0", ["agpl3-named"]),
    ("MPL-2.0", ["mpl2-terms", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-terms"]),
    ("CC-BY-NC-4.0", ["cc-by-nc4-named"]),
    ("CC-BY-SA-4.0", ["cc-by-sa4-named"]),
    ("CC-BY-4.0", ["cc-by4-named"]),
    ("CC0-1.0", ["cc0-named"]),
    ("Unlicense", ["unlicense-domain"]),
    ("Zlib", ["zlib-asis", "zlib-grant"]),
    ("Apache-2.0", ["spdx-apache2"]),
    ("MIT", ["spdx-mit"]),
    ("BSD-3-Clause", ["spdx-bsd3"]),
    ("GPL-3.0", ["spdx-gpl3"]),
    ("GPL-2.0", ["spdx-gpl2"]),
]

# Every sentence above has one of these in it, so a sentence without them is none of the known ones; none has a blank,
# which may be a line end with a comment sign in the text as it stands.
MARKS = r"licen[sc]e|permission|permitted|redistribution|copyright|software|warranty|mpl|cc0|4\.0"
# Comment signs and list stars in front of a line, a full stop at the end of a sentence, and runs of white space.
_LINE_HEAD = r"(?m)^[ \t]*(//+|#+|/\*+|\*+/?|;+|--|<!--)[ \t]*"


def normalised(sentence: Column) -> Column:
    """Lower case, curly quotes made plain, white space made one blank, no blank or full stop at the ends."""
    plain = F.translate(F.lower(sentence), "“”‘’\t\n\r\f", "\"\"''    ")
    return F.regexp_replace(F.regexp_replace(plain, " +", " "), r"^ |[ .!?]+$", "")


def sentences(text: Column) -> Column:
    """The sentences of a text: those of its lines, then those that run over line ends, as two arrays.

    A licence may stand on a line of its own after a line without a full stop, or be wrapped at a fixed width; the
    first array has the former whole and the second the latter. An address set off by blank lines belongs to the sentence
    before it. A colon ends a sentence at a line end and in front of a list, not inside a line.
    """
    clean = F.regexp_replace(text, _LINE_HEAD, "")
    ends = F.regexp_replace(clean, r"([.!?])[ \t\r\f]+", "$1\n")
    joined = F.regexp_replace(clean, r"\n[ \t\r\f]*\n[ \t\r\f]*(https?://)", " $1")
    listed = F.regexp_replace(F.regexp_replace(joined, r":[ \t\r\f]*\n", ":\n\n"), r":[ \t\r\f]+([0-9*(])", ":\n\n$1")
    wrapped = F.regexp_replace(F.regexp_replace(listed, r"\n[ \t\r\f]*\n", ".\n\n"), r"([^\n])\n([^\n])", "$1 $2")
    ends_wrapped = F.regexp_replace(wrapped, r"([.!?])[ \t\r\f]+", "$1\n")
    return F.array(F.split(ends, r"\n+"), F.split(ends_wrapped, r"\n+"))


def identified(sentence: Column) -> Column:
    """Identifier of a normalised sentence, null if it is none of the known ones; the first pattern that fits decides."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(SENTENCES):
        found = F.when(sentence.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(found)
    return found


def _matched(ids: Column) -> Column:
    """Licences whose rules match a sequence '|a|b|', as an array in rule order; a rule uses its sentences up."""

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["left"], rule["ids"])
        return F.struct(
            F.when(hit, F.replace(state["left"], rule["ids"], F.lit("|-|"))).otherwise(state["left"]).alias("left"),
            F.when(hit, F.concat(state["found"], F.array(rule["license"]))).otherwise(state["found"]).alias("found"))

    rules = F.array(*[F.struct(F.lit(name).alias("license"), F.lit("|" + "|".join(seq) + "|").alias("ids")) for name, seq in RULES])
    # each identifier gets bars of its own, so that rules match side by side
    start = F.struct(ids.alias("left"), F.array().cast("array<string>").alias("found"))
    return F.array_distinct(F.aggregate(rules, start, step, lambda state: state["found"]))


def scan_licenses(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, sentence_ids (array, in order), licenses (array, sorted), n_sentences known: one row for each row given.

    A null or empty text, or one without a known sentence, has empty arrays. Repeated rows give repeated results.
    Sentence identifiers without a matching rule are reported but name no licence. Columns other than the two named
    are ignored. Texts are read whole.
    """
    marked = F.col("text").rlike(f"(?i){MARKS}")

    def known(part: Column) -> Column:
        suspects = F.filter(part, lambda s: s.rlike(f"(?i){MARKS}"))
        return F.filter(F.transform(suspects, lambda s: identified(normalised(s))), lambda name: name.isNotNull())

    none = F.array().cast("array<string>")
    base = rows.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = base.select("key", F.when(marked, sentences(F.col("text"))).alias("parts"))
    ids = parts.select(
        "key", F.when(F.col("parts").isNull(), none).otherwise(known(F.col("parts")[0])).alias("lines"),
        F.when(F.col("parts").isNull(), none).otherwise(known(F.col("parts")[1])).alias("wrapped"))

    def licenses(seq: str) -> Column:
        return F.when(F.size(seq) == 0, none).otherwise(_matched(F.concat(F.lit("|"), F.array_join(seq, "|"), F.lit("|"))))

    longest = F.when(F.size("wrapped") > F.size("lines"), F.col("wrapped")).otherwise(F.col("lines"))
    return ids.select(
        F.col("key").alias(key), longest.alias("sentence_ids"),
        F.array_sort(F.array_distinct(F.concat(licenses("lines"), licenses("wrapped")))).alias("licenses"),
        F.greatest(F.size("lines"), F.size("wrapped")).alias("n_sentences"))
