"""License scans by sentence rules (DataFrame functions only).

A text is cut into sentences, each normalised to its words in lower case; sentences known from licences become
identifiers, all others go, and the sequence of identifiers is matched against ordered rules, each a sequence of
identifiers that must occur in that order (others may stand between them). Texts are cut twice: at sentence ends, so
that a sentence may run over lines, and at sentence ends and line ends, so that a notice of one line is found among
lines without a full stop. Besides, sentences are found in the whole text as runs of lines, each from a sentence or line end
to the next or a later line end, so that one may run over lines below a title or copyright line. All of it is a projection: nothing is shuffled, and a text is never joined to another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: Known sentences, normalised: letters and digits in lower case, single spaces.
SENTENCES: dict[int, str] = {
    1: "released under the mit license",
    2: "licensed under the mit license",
    3: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    4: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    5: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    6: "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    11: "licensed under the apache license version 2 0",
    12: "licensed under the apache license version 2 0 the license",
    13: "you may not use this file except in compliance with the license",
    14: "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    15: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    16: "see the license for the specific language governing permissions and limitations under the license",
    21: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    22: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    23: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    24: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    31: "this program is free software",
    32: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    33: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    34: "this work is licensed under the gnu general public license version 3",
    35: "this work is licensed under the gnu general public license version 2",
    36: "you should have received a copy of the gnu general public license along with this program",
    41: "licensed under cc by 4 0",
    42: "licensed under cc by sa 4 0",
    43: "licensed under cc by nc 4 0",
    44: "licensed under cc by nd 4 0",
    45: "licensed under cc by nc sa 4 0",
    46: "licensed under cc0 1 0",
    47: "this work is licensed under a creative commons attribution 4 0 international license",
    48: "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    49: "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    51: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    52: "this is free and unencumbered software released into the public domain",
    53: "this source code form is subject to the terms of the mozilla public license v",
    61: "all rights reserved",
}
#: (licence, identifiers in order), the first that matches names the text; a full licence stands before its notice.
RULES: list[tuple[str, tuple[int, ...]]] = [
    ("MIT", (3, 4, 5, 6)),
    ("Apache-2.0", (12, 13, 15, 16)),
    ("Apache-2.0", (12, 13, 14, 16)),
    ("BSD-3-Clause", (21, 22, 23, 24)),
    ("BSD-2-Clause", (21, 22, 23)),
    ("GPL-3.0-or-later", (31, 32)),
    ("GPL-2.0-or-later", (31, 33)),
    ("ISC", (51,)),
    ("Unlicense", (52,)),
    ("MPL-2.0", (53,)),
    ("MIT", (1,)),
    ("MIT", (2,)),
    ("MIT", (3, 4)),
    ("Apache-2.0", (11,)),
    ("Apache-2.0", (12,)),
    ("GPL-3.0-only", (34,)),
    ("GPL-2.0-only", (35,)),
    ("CC-BY-NC-SA-4.0", (45,)),
    ("CC-BY-NC-4.0", (43,)),
    ("CC-BY-NC-4.0", (49,)),
    ("CC-BY-SA-4.0", (42,)),
    ("CC-BY-SA-4.0", (48,)),
    ("CC-BY-ND-4.0", (44,)),
    ("CC-BY-4.0", (41,)),
    ("CC-BY-4.0", (47,)),
    ("CC0-1.0", (46,)),
    ("all-rights-reserved", (61,)),
]
#: Every known sentence has one of these parts of words, so a text without them needs no cutting.
CUES = ("licens", "reserved", "permission", "warrant", "redistribut", "liable", "software", "domain")
SENTENCE_END = r"[.!?;:]+(\s+|\z)"
LINE_END = r"\n+"
#: Stands for a sentence end in a normalised text.
STOP = "\x01"


def identifiers(text: Column, ends: str) -> Column:
    """The known sentences of a text, in order, as identifiers."""
    bare = F.transform(F.split(text, ends), lambda s: F.trim(F.lower(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " "))))
    known = F.create_map(*[F.lit(x) for i, s in SENTENCES.items() for x in (s, i)])
    return F.transform(F.filter(bare, lambda s: s.isin(*SENTENCES.values())), lambda s: F.element_at(known, s))


def runs(text: Column) -> Column:
    """The known sentences that are whole runs of lines within a sentence, in order, as identifiers; the longest first."""
    marked = F.regexp_replace(F.translate(text, STOP, " "), SENTENCE_END, STOP)
    bare = F.lower(F.regexp_replace(marked, rf"[^\p{{L}}\p{{N}}\n{STOP}]+", " "))
    lines = F.regexp_replace(F.regexp_replace(F.trim(bare), r" *\n[ \n]*", "\n"), f" *{STOP} *", STOP)
    longest = sorted(SENTENCES.values(), key=lambda s: (-len(s), s))
    whole = rf"(?<![^\n{STOP}])(?:{'|'.join(s.replace(' ', r'[ \n]') for s in longest)})(?![^\n{STOP}])"
    known = F.create_map(*[F.lit(x) for i, s in SENTENCES.items() for x in (s, i)])
    return F.transform(F.regexp_extract_all(lines, F.lit(whole), F.lit(0)), lambda s: F.element_at(known, F.translate(s, "\n", " ")))


def matches(sequence: Column) -> list[Column]:
    """For each rule, whether its identifiers occur in this order in ",1,2,3,"."""
    return [sequence.rlike("," + ",([0-9]+,)*".join(map(str, ids)) + ",") for _, ids in RULES]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_sentences (known ones), sentence_ids, rule (its number, from 1), license (by the
    first rule that matches), licenses (of all rules, sorted).

    Null and empty texts, and texts without a known sentence, have 0, empty texts and a null rule and license. Null
    ids and repeated rows are kept as they are; other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cued = F.lower(text).rlike("|".join(CUES))
    none = F.array().cast("array<int>")
    cut = docs.select(F.col(id_col), F.when(cued, identifiers(text, f"{SENTENCE_END}|{LINE_END}")).otherwise(none).alias("_lines"), F.when(cued, identifiers(text, SENTENCE_END)).otherwise(none).alias("_wrapped"), F.when(cued, runs(text)).otherwise(none).alias("_runs"))
    # whichever knows most sentences; the lines, then the wrapped, if equal
    two = F.when(F.size("_wrapped") > F.size("_lines"), F.col("_wrapped")).otherwise(F.col("_lines"))
    best = cut.select(id_col, F.when(F.size("_runs") > F.size(two), F.col("_runs")).otherwise(two).alias("_ids"), "_lines", "_wrapped", "_runs")
    joined = lambda c: F.concat(F.lit(","), F.array_join(F.col(c).cast("array<string>"), ","), F.lit(","))
    seen = best.select(id_col, "_ids", joined("_lines").alias("_a"), joined("_wrapped").alias("_b"), joined("_runs").alias("_c"))
    found = seen.withColumn("_rules", F.when(F.size("_ids") > 0, F.array(*[a | b | c for a, b, c in zip(*[matches(F.col(x)) for x in ("_a", "_b", "_c")])])))
    names = F.array(*[F.lit(n) for n, _ in RULES])
    first = F.array_position("_rules", F.lit(True))
    licenses = F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda n, i: F.when(F.element_at("_rules", i + 1), n)), lambda n: n.isNotNull())))
    return found.select(
        id_col, F.size("_ids").cast("long").alias("n_sentences"), F.array_join(F.col("_ids").cast("array<string>"), ",").alias("sentence_ids"),
        F.when(first > 0, first.cast("long")).alias("rule"), F.when(first > 0, F.element_at(names, first.cast("int"))).alias("license"),
        F.coalesce(F.array_join(licenses, ","), F.lit("")).alias("licenses"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _sql() -> str:
    known = ", ".join(f"({i}, '{s}')" for i, s in SENTENCES.items())
    rules = ", ".join(f"({n}, '{name}', '{',' + ',([0-9]+,)*'.join(map(str, ids)) + ','}')" for n, (name, ids) in enumerate(RULES, 1))
    one = lambda ends: rf"""SELECT d.r, coalesce(list(k.id ORDER BY u.n) FILTER (WHERE k.id IS NOT NULL), []) AS ids FROM d LEFT JOIN (SELECT r, unnest(string_split_regex(t, '{ends}')) AS s, generate_subscripts(string_split_regex(t, '{ends}'), 1) AS n FROM d) u ON u.r = d.r LEFT JOIN k ON k.s = trim(lower(regexp_replace(u.s, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))) GROUP BY d.r"""
    return rf"""
WITH k(id, s) AS (VALUES {known}), rules(n, name, p) AS (VALUES {rules}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
a AS ({one(f"{SENTENCE_END}|{LINE_END}")}),
b AS ({one(SENTENCE_END)}),
f AS (
  SELECT d.doc_id, d.r, CASE WHEN len(b.ids) > len(a.ids) THEN b.ids ELSE a.ids END AS ids,
         ',' || array_to_string(a.ids, ',') || ',' AS x, ',' || array_to_string(b.ids, ',') || ',' AS y
  FROM d JOIN a USING (r) JOIN b USING (r)
), m AS (
  SELECT f.r, min(n) AS rule, min_by(name, n) AS license, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses
  FROM f JOIN rules ON len(ids) > 0 AND (regexp_matches(x, p) OR regexp_matches(y, p)) GROUP BY f.r
)
SELECT f.doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
       CAST(rule AS BIGINT) AS rule, license, coalesce(licenses, '') AS licenses
FROM f LEFT JOIN m USING (r)
"""


SQL = _sql()
