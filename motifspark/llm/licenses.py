"""License scans by sentence rules (built-in functions only).

A text is cut into sentences: at full stops and the like, at blank lines and at colons that end a line, after marks of comments at
the beginnings of lines are taken off.  A sentence may run over several lines.  Each is normalised (words in lower case; a notice's
lead as in "this software is released under the" becomes "under"), and known license sentences become their
identifiers; the rest disappear.  A sentence that is not known as a whole is looked up without its first lines, as few as will do, then line by line.  The
sequence of identifiers is then matched against ordered rules: a rule claims each place where its identifiers stand next to each
other, and what it claims is taken out of the sequence before the next rule looks, so full texts go before notices.

Defined results: null and empty texts have no sentences and no licenses; a text has a list of distinct licenses in rule
order; identifiers that no rule claims are reported as ``unclaimed``; rows repeated stay repeated; extra columns are ignored.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import let

# Known license sentences (normalised) and their identifiers.
SENTENCES = {
    "mit license": "mit_title",
    "the mit license": "mit_title",
    "the mit license mit": "mit_title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_notice_rule",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit_warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit_liability",
    "isc license": "isc_title",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "bsd0_grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc_warranty",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "isc_liability",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_endorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd_warranty",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd_liability",
    "apache license version 2 0 january 2004": "apache2_title",
    "terms and conditions for use reproduction and distribution": "apache2_terms",
    "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form": "apache2_copyright",
    "under apache license version 2 0 the license you may not use this file except in compliance with the license": "apache2_header",
    "under apache license version 2 0 the license": "apache2_short_header",
    "you may not use this file except in compliance with the license": "apache2_compliance",
    "you may obtain a copy of the license at": "apache2_obtain",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache2_obtain",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache2_obtain",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2_warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache2_limits",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2_subject",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl2_obtain",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2_obtain",
    "mozilla public license version 2 0": "mpl2_title",
    "this is free and unencumbered software released into the public domain": "unlicense_public",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense_anyone",
    "this software is provided as is without any express or implied warranty": "zlib_warranty",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib_liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib_grant",
    "boost software license version 1 0 august 17th 2003": "boost_title",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "boost_grant",
    "gnu general public license version 3 29 june 2007": "gpl3_title",
    "gnu general public license version 2 june 1991": "gpl2_title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3_title",
    "gnu lesser general public license version 2 1 february 1999": "lgpl21_title",
    "gnu affero general public license version 3 19 november 2007": "agpl3_title",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "gnu_verbatim",
    "cc0 1 0 universal": "cc0_title",
    "all rights reserved": "all_rights_reserved",
}
# Names of licenses in notices, normalised, and the license they name.
NAMES = {
    "mit license": "MIT", "mit": "MIT", "isc license": "ISC", "bsd license": "BSD", "bsd 2 clause license": "BSD-2-Clause", "simplified bsd license": "BSD-2-Clause",
    "bsd 3 clause license": "BSD-3-Clause", "new bsd license": "BSD-3-Clause", "apache license version 2 0": "Apache-2.0", "apache license 2 0": "Apache-2.0", "apache 2 0 license": "Apache-2.0",
    "apache license v2 0": "Apache-2.0", "apache 2 0": "Apache-2.0", "mozilla public license version 2 0": "MPL-2.0", "mozilla public license 2 0": "MPL-2.0", "mpl 2 0": "MPL-2.0",
    "unlicense": "Unlicense", "zlib license": "Zlib", "boost software license version 1 0": "BSL-1.0", "eclipse public license 2 0": "EPL-2.0", "cc0 1 0": "CC0-1.0", "cc0 1 0 license": "CC0-1.0",
}
# The GNU licenses (words, letters, versions) and the parts of Creative Commons licenses.
GNU = [("", "gpl", ("2", "3")), ("lesser ", "lgpl", ("2 1", "3")), ("affero ", "agpl", ("3",))]
CREATIVE = {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}
CREATIVE_KINDS = ["by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"]
CREATIVE_VERSIONS = ["2 0", "2 5", "3 0", "4 0"]
# Ordered rules, identifiers that follow each other and the license they name.
RULES = [
    ("mit_grant mit_notice_rule mit_warranty mit_liability", "MIT"),
    ("mit_grant mit_notice_rule mit_warranty", "MIT"),
    ("boost_grant", "BSL-1.0"),
    ("isc_grant isc_warranty isc_liability", "ISC"),
    ("isc_grant", "ISC"),
    ("bsd0_grant isc_warranty isc_liability", "0BSD"),
    ("bsd_grant bsd_source bsd_binary bsd_endorse bsd_warranty bsd_liability", "BSD-3-Clause"),
    ("bsd_grant bsd_source bsd_binary bsd_endorse", "BSD-3-Clause"),
    ("bsd_grant bsd_source bsd_binary bsd_warranty bsd_liability", "BSD-2-Clause"),
    ("bsd_grant bsd_source bsd_binary", "BSD-2-Clause"),
    ("apache2_title apache2_terms apache2_copyright", "Apache-2.0"),
    ("apache2_title apache2_terms", "Apache-2.0"),
    ("apache2_header apache2_obtain apache2_warranty apache2_limits", "Apache-2.0"),
    ("apache2_header", "Apache-2.0"),
    ("apache2_short_header apache2_compliance", "Apache-2.0"),
    ("apache2_short_header", "Apache-2.0"),
    ("mpl2_subject mpl2_obtain", "MPL-2.0"),
    ("mpl2_subject", "MPL-2.0"),
    ("mpl2_title", "MPL-2.0"),
    ("unlicense_public unlicense_anyone", "Unlicense"),
    ("unlicense_public", "Unlicense"),
    ("zlib_warranty zlib_liability zlib_grant", "Zlib"),
    ("boost_title", "BSL-1.0"),
    ("gpl3_title gnu_verbatim", "GPL-3.0"),
    ("gpl2_title gnu_verbatim", "GPL-2.0"),
    ("lgpl3_title gnu_verbatim", "LGPL-3.0"),
    ("lgpl21_title gnu_verbatim", "LGPL-2.1"),
    ("agpl3_title gnu_verbatim", "AGPL-3.0"),
    ("mit_title mit_grant", "MIT"),
    ("mit_grant", "MIT"),
    ("bsd_grant", "BSD"),
    ("cc0_title", "CC0-1.0"),
]


def _spdx(short: str, version: str) -> str:
    v = version.replace(" ", ".")
    return f"{short.upper()}-{v if '.' in v else v + '.0'}"


def _build() -> None:
    """Notices, and the GNU and Creative Commons sentences, which follow a pattern."""
    names = dict(NAMES)
    terms = "is free software you can redistribute it and or modify it under the terms of the gnu {}general public license as published by the free software foundation"
    for words, short, versions in GNU:
        for v in versions:
            name, number = _spdx(short, v), v.replace(" ", "_")
            for form in (f"gnu {words}general public license version {v}", f"gnu {words}general public license v{v}", f"gnu {words}general public license {v}", f"gnu {short} version {v}", f"gnu {short} v{v}", f"{short} version {v}", f"{short} v{v}", f"{short}v{v}", f"{short} {v}"):
                for dot in ("", " 0") if " " not in v else ("",):
                    names[form + dot] = f"{name}-only"
                    names[f"{form}{dot} or later"] = f"{name}-or-later"
            for thing in ("program", "library", "file", "software"):
                start = f"this {thing} {terms.format(words)}"
                SENTENCES[f"{start} either version {v} of the license or at your option any later version"] = f"{short}{number}_later"
                SENTENCES[f"{start} version {v} of the license"] = f"{short}{number}_only"
                SENTENCES[f"{start} version {v}"] = f"{short}{number}_only"
                SENTENCES[f"you should have received a copy of the gnu {words}general public license along with this {thing}"] = "gnu_received"
                SENTENCES[f"this {thing} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"] = "gnu_warranty"
            SENTENCES[f"see the gnu {words}general public license for more details"] = "gnu_details"
            for kind, spdx in (("later", f"{name}-or-later"), ("only", f"{name}-only")):
                RULES.extend([(f"{short}{number}_{kind} gnu_warranty gnu_details gnu_received", spdx), (f"{short}{number}_{kind} gnu_warranty gnu_details", spdx), (f"{short}{number}_{kind}", spdx)])
    for kind in CREATIVE_KINDS:
        for v in CREATIVE_VERSIONS:
            spdx = f"CC-{kind.upper().replace(' ', '-')}-{v.replace(' ', '.')}"
            long = f"creative commons {' '.join(CREATIVE[k] for k in kind.split())} {v}"
            for form in (f"cc {kind} {v}", f"cc {kind} {v} license", f"{long} license", f"{long} international license", f"{long} unported license", f"{long} international"):
                names[form] = spdx
    for name, spdx in names.items():
        SENTENCES[f"under {name}"] = f"notice_{spdx.lower()}"
    for spdx in dict.fromkeys(names.values()):
        SENTENCES["spdx license identifier " + re.sub("[^a-z0-9]+", " ", spdx.lower())] = f"notice_{spdx.lower()}"
        RULES.append((f"notice_{spdx.lower()}", spdx))


_build()

MARKS = r"(^|\n)[ \t]*(?:/\*+|\*+/?|//+|#+|--+|;+|%+|>+)[ \t]*"  # of comments
ENDS = r"""[.!?]+["')\]]*(?:[ \t\n]+|$)|:[ \t]*\n|\n[ \t]*\n"""
LEAD = r"^(?:(?:this|the|that|all) (?:[a-z]+ )?(?:is|are) |it is )?(?:dual )?(?:also )?(?:released|licensed|distributed|available|made available|published|provided|offered) under (?:the terms of )?(?:the |an? )?"
#: Every sentence that counts has one of these words.
LIKELY = ("licen", "copyright", "permission", "software", "rights", "redistribut", "warrant", "copy", "liable", "terms", "public", "mpl", "cc0", "under")
_PATTERN = "(?i)" + "|".join(LIKELY)

MOST_WORDS = max(len(s.split()) for s in SENTENCES) + 8  # and those of a notice's lead


def _mark(ids: str) -> str:
    return "".join(f"<{x}>" for x in ids.split())


def _normal(s: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(s, "[^A-Za-z0-9]+", " "))), LEAD, "under ")


def _sequence(text: Column) -> Column:
    """``<id><id>...`` of the known sentences of a text."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    plain = F.regexp_replace(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), MARKS, "$1")
    some = F.filter(F.split(plain, ENDS), lambda s: s.rlike(_PATTERN))
    name = lambda w: F.when(w.isin(*SENTENCES), F.concat(F.lit("<"), F.element_at(known, w), F.lit(">")))
    lines = lambda x, n: F.array_join(F.transform(F.slice(x, 1, n), lambda s: F.coalesce(name(_normal(s)), F.lit(""))), "")
    tail = lambda x, n: name(_normal(F.array_join(F.slice(x, n + 1, F.size(x) - n), " ")))

    def parts(x: Column) -> Column:
        # a known sentence has no more lines than words, so longer ends need not be looked up
        starts = F.sequence(F.greatest(F.lit(1), F.size(x) - MOST_WORDS), F.size(x) - 1)
        ends = F.filter(F.transform(starts, lambda n: F.struct(n.alias("n"), tail(x, n).alias("id"))), lambda e: e["id"].isNotNull())
        best = let(F.get(ends, F.lit(0)), lambda e: F.when(e.isNotNull(), F.concat(lines(x, e["n"]), e["id"])))
        return F.when(F.size(x) > 1, F.coalesce(best, lines(x, F.size(x)))).otherwise(F.lit(""))

    found = F.transform(some, lambda s: F.coalesce(name(_normal(s)), let(F.split(s, "\n"), parts)))
    return F.when(text.rlike(_PATTERN), F.array_join(found, "")).otherwise(F.lit(""))


def license_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentence_ids, licenses, unclaimed) of every row."""
    out = docs.select(F.col(id_col).alias("doc_id"), _sequence(F.coalesce(F.col(text_col), F.lit(""))).alias("ids"))
    none = F.array().cast("array<string>")
    split = lambda c: F.filter(F.split(F.translate(c, "<|", ""), ">"), lambda x: x != "")

    # the rules in order: what is left of the sequence, and what was claimed so far
    rules = F.array(*[F.struct(F.lit(_mark(ids)).alias("mark"), F.lit(name).alias("name")) for ids, name in RULES])
    start = F.struct(F.col("ids").alias("rest"), none.alias("names"))

    def claim(a: Column, r: Column) -> Column:
        hit = F.contains(a["rest"], r["mark"])
        return F.when(hit, F.struct(F.replace(a["rest"], r["mark"], F.lit("|")).alias("rest"), F.array_append(a["names"], r["name"]).alias("names"))).otherwise(a)

    claimed = F.when(F.col("ids") == "", start).otherwise(F.aggregate(rules, start, claim))
    out = out.withColumn("claimed", claimed)
    return out.select(
        "doc_id",
        split(F.col("ids")).alias("sentence_ids"),
        F.array_distinct("claimed.names").alias("licenses"),
        split(F.col("claimed.rest")).alias("unclaimed"),
    )


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    out = license_findings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", " ").alias("sentence_ids"),
        F.array_join("licenses", " ").alias("licenses"),
        F.size("unclaimed").cast("long").alias("n_unclaimed"),
    )


def _oracle() -> str:
    table = ", ".join(f"('{s}', '<{i}>')" for s, i in SENTENCES.items())
    steps = []
    for k, (ids, _) in enumerate(RULES):
        steps.append(f"r{k} AS (SELECT *, contains(rest{k}, '{_mark(ids)}') AS c{k}, replace(rest{k}, '{_mark(ids)}', '|') AS rest{k + 1} FROM {f'r{k - 1}' if k else 'seq'})")
    n = len(RULES)
    # licenses in order of their first matching rule
    rank = ", ".join(f"CASE WHEN c{k} THEN '{k:03d}{name}' END" for k, (_, name) in enumerate(RULES))
    ends, marks = ENDS.replace("'", "''"), MARKS
    normal = lambda x: rf"regexp_replace(lower(trim(regexp_replace({x}, '[^A-Za-z0-9]+', ' ', 'g'))), '{LEAD}', 'under ')"
    return rf"""
WITH k(s, id) AS (VALUES {table}),
d AS (SELECT row_number() OVER () AS rid, doc_id, string_split_regex(regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '{marks}', '\1', 'g'), '{ends}') AS pieces FROM documents),
p AS (SELECT rid, i, piece, string_split(piece, chr(10)) AS ln FROM (SELECT rid, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM d)),
l AS (SELECT rid, i, j, k.id FROM (SELECT rid, i, unnest(ln) AS x, generate_subscripts(ln, 1) AS j FROM p WHERE len(ln) > 1) JOIN k ON k.s = {normal('x')}),
e AS (SELECT rid, i, min(n) AS n, arg_min(k.id, n) AS id FROM (SELECT rid, i, ln, unnest(range(greatest(1, len(ln) - {MOST_WORDS}), len(ln))) AS n FROM p WHERE len(ln) > 1) JOIN k ON k.s = {normal("array_to_string(ln[n + 1:], ' ')")} GROUP BY rid, i),
la AS (SELECT l.rid, l.i, string_agg(l.id, '' ORDER BY j) AS every, coalesce(string_agg(l.id, '' ORDER BY j) FILTER (j <= e.n), '') AS before FROM l LEFT JOIN e ON e.rid = l.rid AND e.i = l.i GROUP BY l.rid, l.i),
m AS (
  SELECT p.rid, p.i, coalesce(k0.id, coalesce(la.before, '') || e.id, la.every) AS id
  FROM p LEFT JOIN la ON la.rid = p.rid AND la.i = p.i LEFT JOIN k k0 ON k0.s = {normal('piece')} LEFT JOIN e ON e.rid = p.rid AND e.i = p.i
),
seq AS (SELECT d.doc_id, coalesce(string_agg(m.id, '' ORDER BY m.i), '') AS rest0 FROM d LEFT JOIN m ON m.rid = d.rid AND m.id <> '' GROUP BY d.rid, d.doc_id),
{", ".join(steps)}
SELECT doc_id, CAST(length(rest0) - length(replace(rest0, '>', '')) AS BIGINT) AS n_sentences, trim(replace(replace(rest0, '<', ''), '>', ' ')) AS sentence_ids,
  coalesce((SELECT string_agg(name, ' ' ORDER BY k0) FROM (SELECT substr(x, 4) AS name, min(substr(x, 1, 3)) AS k0 FROM (SELECT unnest([{rank}]) AS x) WHERE x IS NOT NULL GROUP BY 1)), '') AS licenses,
  CAST(length(rest{n}) - length(replace(rest{n}, '>', '')) AS BIGINT) AS n_unclaimed
FROM r{n - 1}
"""


ORACLE = _oracle()
