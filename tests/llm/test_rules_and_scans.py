"""Quality rules, decontamination and license scans: SQL on the smallest tables, brute force on odd cases."""
import hashlib
import re

import duckdb
import pytest

from motifspark.llm import decontaminate, licenses, quality_rules, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine = queries.queries()[name](spark, SF)
    cols = sorted(mine.columns)
    assert sorted(map(str, map(tuple, mine.select(*cols).collect()))) == sorted(map(str, con.sql(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall()))


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_hits(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        n = min(10, len(b))
        for j in range(len(b) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == b[j : j + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


ITEMS = [(1, " ".join(f"q{i}" for i in range(14))), (2, "Short ITEM ÉCOLE"), (3, "short"), (4, None), (5, "..."), (10, " ".join(f"q{i}" for i in range(2, 13))), (10, "short")]
TEXTS = [
    None, "", "  .,;", "short", "A short item École, short item ÉCOLE! short-item", " ".join(f"q{i}" for i in range(14)), "x " + "-".join(f"Q{i}" for i in range(3, 14)) + " y",
    "a b c " * 9000 + " ".join(f"q{i}" for i in range(1, 12)), "ÀÉÎ Kelvin KK short", " ".join(f"q{i}" for i in range(9)),
]


@pytest.mark.parametrize("limit", [500_000, 0])  # broadcast, and the shuffled way
def test_hits_against_brute_force(spark, limit):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, w string, n_words int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.benchmark_hits(docs, bench, broadcast_windows=limit).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == brute_hits(t, ITEMS)
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, t in enumerate(TEXTS) if not brute_hits(t, ITEMS)[1]]
    masked = {r["doc_id"]: r["words"] for r in decontaminate.mask_contaminated(docs, bench).collect()}
    assert masked[3] == [] and masked[6] == ["x", "y"] and masked[9] == words(TEXTS[9])


def test_hits_of_empty_and_repeated(spark):
    docs = spark.createDataFrame([(1, "short"), (1, "short"), (None, "short x")], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_hit"]) for r in decontaminate.benchmark_hits(docs, bench).collect())
    assert got == [(-1, 2, 1), (1, 1, 1), (1, 1, 1)]
    mixed = spark.createDataFrame([(1, "short", 1), (1, "clean", 2), (None, "short x", 3), (None, "clean", 4), (None, None, 5)], "doc_id long, text string, k1 int")
    assert sorted(r["k1"] for r in decontaminate.drop_contaminated(mixed, bench).collect()) == [2, 4, 5]
    assert decontaminate.drop_contaminated(mixed, bench).columns == mixed.columns
    assert decontaminate.benchmark_hits(docs.where("false"), bench).count() == 0
    assert [r["n_hit"] for r in decontaminate.benchmark_hits(docs, bench.where("false")).collect()] == [0, 0, 0]


def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    cover = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def test_counts_against_brute_force(spark):
    texts = [None, "", " \t\x0b", "a b c d e f g h " * 3, "x y\nx y\n\n \nx y", "é#|é $ 日本", "one two " * 8000, "a\x1fb c d", " ".join(map(str, range(20000))) + " 1 2 3 4 5 6 7 8", "#" * 9000]
    rows = [(i, t, lang, src, 7) for i, t in enumerate(texts) for lang, src in (("en", "s"), (None, None))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int")
    out = quality_rules.quality_verdicts(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        n, chars, symbols, dup, rep = brute_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep)
        assert r["base_failed"] == (n < 20 or 100 * rep > 30 * n) and not (r["kept"] and r["base_failed"])
    assert quality_rules.quality_verdicts(docs.where("false")).count() == 0


def test_thresholds_adapt_to_the_source(spark):
    plain = " ".join(f"word{i}" for i in range(40))
    marked = " ".join(f"#w{i}" for i in range(40))
    rows = [(i, plain, "en", "a") for i in range(300)] + [(1000 + i, marked, "en", "b") for i in range(300)] + [(5000, marked, "en", "a"), (5001, marked, "en", "b")]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[5000] and got[5001] and got[0]


def test_sketch_is_mergeable_and_close(spark):
    df = spark.range(5000).selectExpr("'en' AS lang", "'s' AS source", "false AS base_failed", "id * 7 AS symbol_rate", "id AS repeat_rate", "id % 31 AS dup_line_rate", "id * id AS word_length")
    a = {(r["rate"], r["bucket"]): r["n"] for r in quality_rules.sketches(df).collect()}
    parts = [quality_rules.sketches(df.where(f"symbol_rate % 2 = {k}")).collect() for k in (0, 1)]
    b = {}
    for r in parts[0] + parts[1]:
        b[r["rate"], r["bucket"]] = b.get((r["rate"], r["bucket"]), 0) + r["n"]
    assert a == b
    q = {r["rate"]: (r["low"], r["high"]) for r in quality_rules.quantiles(quality_rules.sketches(df), ["lang"]).collect()}
    for rate, (lo, hi) in {"symbol_rate": (249 * 7, 4749 * 7), "word_length": (249**2, 4749**2)}.items():
        assert 0 <= lo - q[rate][0] <= lo / 16 and 0 <= q[rate][1] - hi <= hi / 16


def test_planted_sources_have_limits_of_their_own(spark):
    """Four sources, each with more of one kind of trouble than the others: each rate's limit is highest there."""
    import numpy as np

    rng = np.random.default_rng(2)
    words = lambda n, long=5: ["".join(rng.choice(list("abcdefgh"), max(2, long + int(rng.integers(-2, 3))))) for _ in range(n)]
    rows = []
    for i in range(1600):
        source = ("sym", "rep", "dup", "long")[i % 4]
        t = words(120, 9 if source == "long" else 5)
        for kind, share in (("sym", 20), ("rep", 20), ("dup", 20)):
            if rng.integers(100) < share:
                k = int(rng.integers(12, 20)) if source == kind else int(rng.integers(4, 8))
                if kind == "sym":
                    t = ["#" * k + w if x < 8 else w for x, w in enumerate(t)]
                elif kind == "rep":
                    t = t[: 3 * k] + t[: k + 4] + t[3 * k :]
                else:
                    t = t + ["\nsame line" for _ in range(k)]
        lines = " ".join(t).split("\n")
        rows.append((i, "\n".join(lines if len(lines) > 1 else [" ".join(t[a : a + 8]) for a in range(0, len(t), 8)]), "en", source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r["source"]: r for r in quality_rules.quality_verdicts(docs).select("source", *[f"{r}_high" for r in quality_rules.RATES]).distinct().collect()}
    for rate, source in (("symbol_rate", "sym"), ("repeat_rate", "rep"), ("dup_line_rate", "dup"), ("word_length", "long")):
        high = {s: out[s][f"{rate}_high"] for s in out}
        assert len(set(high.values())) > 1 and max(high, key=high.get) == source, (rate, high)


MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
BSD3 = """Copyright 2020 Some One. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
"""
BSD2 = BSD3[: BSD3.index("3. Neither")]
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.
"""
GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU {}General Public License for more details.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
"""


def wrapped(text, width, mark=""):
    import textwrap

    parts = [textwrap.fill(p, width) if p.strip() else p for p in text.split("\n\n")]
    return "\n".join((mark + x).rstrip() for x in "\n\n".join(parts).split("\n"))


REAL = [(MIT, "MIT"), (BSD3, "BSD-3-Clause"), (BSD2, "BSD-2-Clause"), (APACHE, "Apache-2.0"), (GNU.format("", "3", ""), "GPL-3.0-or-later"), (GNU.format("", "2", ""), "GPL-2.0-or-later"), (GNU.format("Lesser ", "2.1", "Lesser "), "LGPL-2.1-or-later"), (GNU.format("Affero ", "3", "Affero "), "AGPL-3.0-or-later"), (MPL, "MPL-2.0"), (ISC, "ISC")]


def license_rows():
    rows, want = [], {}
    for k, (text, name) in enumerate(REAL):
        for j, (width, mark) in enumerate([(5000, ""), (78, ""), (60, "# "), (70, " * "), (72, "// ")]):
            rows.append((1000 + 10 * k + j, "Some code here.\n\n" + wrapped(text, width, mark) + "\n\nmore words"))
            want[1000 + 10 * k + j] = name
    for k, s in enumerate(licenses.SENTENCES):
        rows.append((10_000 + k, s.upper() + "."))
    return rows, want


def test_every_license_sentence_and_real_texts_with_sql(spark):
    rows, want = license_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.license_findings(docs).collect()}
    for i, name in want.items():
        assert got[i]["licenses"] == [name], (i, name, got[i])
    for k, (s, i) in enumerate(licenses.SENTENCES.items()):
        assert got[10_000 + k]["sentence_ids"] == [i], (s, got[10_000 + k])
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    sql = {r[0]: r[1:] for r in con.sql(f"SELECT doc_id, sentence_ids, licenses, n_unclaimed FROM ({licenses.ORACLE})").fetchall()}
    assert sql == {i: (" ".join(r["sentence_ids"]), " ".join(r["licenses"]), len(r["unclaimed"])) for i, r in got.items()}


def test_licenses(spark):
    texts = {
        1: None, 2: "", 3: "Some text\nReleased under the MIT License.\nMore text", 4: "Copyright 2020 X\n" + MIT[MIT.index("Permission") :], 5: "Licensed under the Apache License, Version 2.0. And CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.",
        6: "See the License for the specific language governing permissions and limitations under the License.", 7: "not licensed under the mit license at all", 8: "RELEASED UNDER THE MIT LICENSE! " * 2000,
        9: "This file is licensed under the Apache License, Version 2.0", 10: "// SPDX-License-Identifier: MPL-2.0\nimport x",
    }
    docs = spark.createDataFrame([(k, v, "x") for k, v in texts.items()] + [(3, texts[3], "y")], "doc_id long, text string, licenses string")
    rows = licenses.license_findings(docs).collect()
    got = {r["doc_id"]: (r["sentence_ids"], r["licenses"], r["unclaimed"]) for r in rows}
    assert len(rows) == 11
    assert got[1] == got[2] == got[7] == ([], [], [])
    assert got[3][1] == ["MIT"] and got[4] == (["mit_grant", "mit_notice_rule", "mit_warranty", "mit_liability"], ["MIT"], [])
    assert got[5][1] == ["Apache-2.0", "CC-BY-NC-4.0"] and got[6] == (["apache2_limits"], [], ["apache2_limits"])
    assert len(got[8][0]) == 2000 and got[8][1] == ["MIT"] and got[9][1] == ["Apache-2.0"] and got[10][1] == ["MPL-2.0"]
    assert hashlib and licenses.license_findings(docs.where("false")).count() == 0


def test_license_after_many_lines_without_a_stop(spark):
    """A wrapped grant is found however many unrelated lines stand before it."""
    from motifspark.llm import licenses

    grant = next(s for s, i in licenses.SENTENCES.items() if i == "mit_grant").split()
    wrapped = "\n".join(" ".join(grant[k : k + 9]) for k in range(0, len(grant), 9)) + ":\n"
    docs = [(n, "\n".join(f"Copyright {2000 + k} Someone" for k in range(n)) + "\n" + wrapped) for n in (1, 2, 3, 7, 200)]
    got = {r["doc_id"]: r["sentence_ids"] for r in licenses.license_findings(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {n: ["mit_grant"] for n, _ in docs}
