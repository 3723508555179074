"""Substring dedup, licence scan, mixing, quality classifier."""

import collections
import math
import textwrap
import zlib

import numpy as np
import pytest
from helpers import SF, awkward, nothing, table
from oracle import compare
from pyspark.sql import functions as F

from lexloom.llm import licences, mixing, quality, substring
from lexloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_oracle(spark, name, sf):
    assert compare(spark, f"/root/testdata/{sf}", QUERIES[name], ORACLE_SQL[name]) > 0


# ---- substring dedup ----

PASSAGE = "Here stands a sentence of the passage that repeats. Another sentence of it stands right after the first one. And the third one closes the passage after some more words."


def test_passage_inside_a_paragraph(spark):
    docs = spark.createDataFrame([(1, f"First text of its own. {PASSAGE} More of the first text."), (2, f"second text goes on and {PASSAGE} And this text ends.\nIts last line is its own."), (3, "Its last line is its own.\nother words entirely in this line")], "doc_id bigint, text string")
    found = {r.doc_id: r for r in substring.dedup_texts(docs, min_line=4, min_sentence=6).collect()}
    assert found[1].n_removed == 0 and PASSAGE in found[1].text
    # The passage's first sentence is merged with the words before it; the others go.
    assert found[2].text == "second text goes on and Here stands a sentence of the passage that repeats. And this text ends.\nIts last line is its own."
    assert found[3].text == "other words entirely in this line" and [tuple(s) for s in found[3].removed_spans] == [(0, 26)]


def test_spans_are_original_characters(spark):
    docs = table(spark, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    cut = 0
    for r in substring.dedup_texts(docs).collect():
        out, at = [], 0
        for a, b in r.removed_spans:
            out.append(texts[r.doc_id][at:a])
            at = b
        assert "".join(out) + texts[r.doc_id][at:] == r.text
        assert r.removed_chars == len(texts[r.doc_id]) - len(r.text) and r.n_removed == len(r.removed_spans)
        cut += r.n_removed
    assert cut


def test_substring_awkward(spark):
    rows = substring.dedup_texts(awkward(spark), min_line=4).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert len(rows) == 9 and set(rows[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "component_id", "copy", "score", "n_removed", "removed_chars", "removed_spans"}
    assert by[None][0].n_removed == 0  # ranks first
    assert [r.text for r in by[1]] == ["Another plain line of words there."] * 2
    assert by[2][0].text == "" and by[3][0].text == "" and by[4][0].text == " \n\t "
    assert substring.dedup_texts(nothing(spark)).count() == 0


def test_texts_are_read_in_small_batches(spark, tmp_path, monkeypatch):
    rows, arrow = "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = {key: spark.conf.get(key) for key in (rows, arrow)}, []
    make = substring.materialise
    monkeypatch.setattr(substring, "materialise", lambda *given: seen.append((spark.conf.get(rows), spark.conf.get(arrow))) or make(*given))
    line = "this line of more than ten words stands in the texts of two rows, number {}\n"
    texts = [(i, line.format(i % 700) + f"row {i} has a line of its own " + "x" * 5_000) for i in range(1_400)]  # 7 MB; copies lie far apart
    spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    try:
        for key in before:
            spark.conf.unset(key)  # as in a new session
        found = {r.doc_id: r for r in substring.dedup_texts(spark.read.parquet(f"{tmp_path}/docs")).collect()}
        assert seen == [("256", str(1 << 20))]
        assert (spark.conf.get(rows), spark.conf.get(arrow)) == ("256", str(8 << 20))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    for i, text in texts:
        cut = len(line.format(i % 700)) if i >= 700 else 0
        assert found[i].text == text[cut:] and [tuple(s) for s in found[i].removed_spans] == ([(0, cut)] if cut else [])


def test_text_without_blanks(spark):
    """Long runs count by their length; wide marks end sentences. As plain SQL has it, too."""
    passage = "\u8fd9\u662f\u4e00\u4e2a\u6ca1\u6709\u7a7a\u683c\u7684\u53e5\u5b50\u5b83\u5728\u8bb8\u591a\u6587\u4ef6\u4e2d\u91cd\u590d\u51fa\u73b0\u800c\u4e14\u5f88\u957f\u3002"
    docs = spark.createDataFrame([(1, "\u5f00\u59cb\u3002" + passage + "\u7ed3\u675f\uff01"), (2, "\u53e6\u4e00\u4e2a\uff1f" + passage + "\u5230\u6b64\u4e3a\u6b62\u3002"), (3, "short line\n\u77ed\n" + passage)], "doc_id bigint, text string")
    found = {r.doc_id: r for r in substring.dedup_texts(docs).collect()}
    assert [found[d].n_removed for d in (1, 2, 3)] == [0, 1, 1]
    assert found[2].text == "\u53e6\u4e00\u4e2a\uff1f\u5230\u6b64\u4e3a\u6b62\u3002" and found[3].text == "short line\n\u77ed\n"
    import duckdb

    db = duckdb.connect()
    db.register("documents", docs.toArrow())
    got = substring.query(docs).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == db.execute(ORACLE_SQL["op1_substring_dedup"] + " ORDER BY doc_id").fetchall()


def test_many_equal_lines(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("The same line everywhere it is.\nnumber own line of "), F.col("id").cast("string")).alias("text"))
    rows = substring.dedup_texts(docs, min_line=4, min_sentence=6).select("doc_id", "n_removed", "text").collect()
    assert sum(r.n_removed for r in rows) == 2999 and all((r.n_removed == 0) == (r.doc_id == 0) for r in rows)


# ---- licences ----

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
and associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
BSD = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."]


def test_licence_rules(spark):
    texts = [MIT, "\n".join(BSD[:3]), "\n".join(BSD), "\n".join([BSD[1], BSD[0], BSD[2]]), "Words. Licensed under the Apache License, Version 2.0. All rights reserved.", "no licence", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in licences.scan_licences(docs).collect()}
    assert [found[i].licences for i in range(7)] == ["MIT", "BSD-2-Clause", "BSD-3-Clause", "", "Apache-2.0,all-rights-reserved", "", ""]
    assert found[3].n_sentences == 3 and found[5].n_licences == 0


APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL3_NOTICE = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
GPL2_NOTICE = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version."""
MIT_NOTICE = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
ISC_NOTICE = """Copyright (c) 2020, Some One

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES."""
BSD_NOTICE = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
NOTICES = {"Apache-2.0": APACHE_NOTICE, "GPL-3.0-or-later": GPL3_NOTICE, "GPL-2.0-or-later": GPL2_NOTICE, "MIT": MIT_NOTICE, "ISC": ISC_NOTICE, "BSD-3-Clause": BSD_NOTICE, "MPL-2.0": MPL_NOTICE}


def in_comment(mark, text):
    return "".join(f"{mark} {x}".rstrip() + "\n" for x in text.split("\n"))


def narrow(text, width):
    return "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))


def test_published_notices(spark):
    ways = [lambda t: t, lambda t: t.replace("\n", "\r\n"), lambda t: narrow(t, 40), lambda t: narrow(t, 100_000), lambda t: f"/*\n{in_comment(' *', t)} */\ncode();"]
    ways += [lambda t, m=m: in_comment(m, t) + "code" for m in ("#", "//", "--", ";;", "!", "%", "dnl", "REM")]
    rows = [(i * 100 + k, way(t)) for i, t in enumerate(NOTICES.values()) for k, way in enumerate(ways)]
    found = {r.doc_id: r.licences for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    names = list(NOTICES)
    assert {d: x for d, x in found.items() if x != names[d // 100]} == {}


def test_lines_that_stand_alone_are_still_found(spark):
    texts = ["Some title\nLicensed under the MIT license\nAnother title", "Copyright 2020 Some One\nAll rights reserved", "a title\n# licensed under the MIT license", "a) All rights reserved.", "Licensed under the Apache License, Version 2.0\n(the \"Licence\")", "This is not\nlicensed under the MIT license."]
    found = {r.doc_id: r.licences for r in licences.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [found[i] for i in range(6)] == ["MIT", "all-rights-reserved", "MIT", "all-rights-reserved", "Apache-2.0", ""]


def test_licence_plan_is_narrow(spark):
    plan = licences.scan_licences(table(spark, "documents"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert licences.scan_licences(awkward(spark)).count() == 9 and licences.scan_licences(nothing(spark)).count() == 0


# ---- mixing ----


def test_rates_and_counts(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    rates = {r["__ll_source"]: r.rate for r in mixing.source_rates(docs)[0].collect()}
    mixed = mixing.mix_sources(docs).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("doc_id", "copy").alias("d")).collect()
    sizes = {r.source: r["count"] for r in docs.groupBy("source").count().collect()}
    for r in mixed:
        want = sizes[r.source] * rates[r.source]
        assert r.n == r.d and abs(r.n - want) < 5 * math.sqrt(want)
    weighted = mixing.mix_sources(docs, {"hot": 1.0, "s1": 3.0}).groupBy("source").count().collect()
    shares = {r.source: r["count"] for r in weighted}
    assert set(shares) == {"hot", "s1"} and shares["s1"] / shares["hot"] == pytest.approx(3, rel=0.1)


def test_large_rates_are_exact_poisson(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") < 399, "big").otherwise("tiny").alias("source"))
    row = mixing.mix_sources(docs, {"tiny": 1.0, "big": 0.0}, budget=5.0).agg(F.max("n_copies").alias("n"), F.count("*").alias("c")).collect()[0]
    assert row.n == row.c and abs(row.n - 2000) < 6 * math.sqrt(2000)  # 400 * 5 copies of one document: more than one draw


def test_mixing_is_native_and_repeatable(spark):
    docs = table(spark, "documents")
    a, b = (sorted((r.doc_id, r.copy) for r in mixing.mix_sources(d).collect()) for d in (docs, docs.repartition(13)))
    assert a == b
    plan = mixing.mix_sources(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mixing_awkward(spark):
    mixed = mixing.mix_sources(awkward(spark), budget=3.0)
    rows = mixed.collect()
    assert "score" in mixed.columns and mixed.columns.count("copy") == 1 and len(rows) > 0
    one = [r for r in rows if r.doc_id == 1]
    assert len(one) % 2 == 0
    assert mixing.mix_sources(nothing(spark)).count() == 0
    keys = [r.shuffle_key for r in rows]
    assert len(set(keys)) >= len(keys) // 2


# ---- quality ----


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    for v in np.unique(scores):
        ranks[scores == v] = ranks[scores == v].mean()
    pos = labels == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.classify(table(spark, "documents", sf), table(spark, "labels", sf)).join(table(spark, "labels", sf), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    y = np.array([r.quality for r in held])
    assert auc(np.array([r.score for r in held]), y) > 0.9
    assert np.mean([r.predicted == 1 for r in held if r.quality == 1]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def plain_features(text):
    """The same numbers from the text's bytes, one by one."""
    data = text.encode()
    words, n = data.split(), len(data)
    if not words:
        return [0.0] * quality.N_FEATURES
    m, lines = len(words), [x for x in data.split(b"\n") if x]
    small, capital, digit, wide = (sum(c in r for c in data) for r in (range(97, 123), range(65, 91), range(48, 58), range(128, 256)))
    blank, breaks = sum(c in b" \t\r\x0b\x0c" for c in data), data.count(b"\n")
    marks = [sum(c in chars for c in data) for chars in (b".,", b"!?", b"'\"-:;()", b"#$%&*+/<=>@[\\]^_`{|}~")]
    other = n - small - capital - digit - wide - blank - breaks - sum(marks)
    pairs = list(zip(words, words[1:]))
    entropy = -sum(k / n * math.log(k / n) for k in collections.Counter(data).values())
    return [
        math.log1p(n) / 10, math.log1p(m) / 10, blank / n, breaks / n * 10, small / n, capital / max(1, small + capital + wide), digit / n * 10,
        *[k / n * 10 for k in marks], wide / n, other / n * 10, (n - blank - breaks) / m / 10, len(set(words)) / m, len(set(pairs)) / len(pairs) if pairs else 1.0,
        sum(a == b for a, b in pairs) / max(1, len(pairs)), len(set(lines)) / max(1, len(lines)), math.log1p(m / max(1, len(lines))) / 5, entropy / 5,
    ]


def test_scores_text_by_text(spark):
    """Each row's score and decision from plain features and the network's weights."""
    docs, labels = table(spark, "documents"), table(spark, "labels")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    for r in docs.collect():
        x = [min(8, max(-8, (v - m) / s)) for v, m, s in zip(plain_features(r.text or ""), model.mean, model.scale)]
        hidden = [math.tanh(sum(a * w for a, w in zip(x, model.w1[:, j])) + model.b1[j]) for j in range(len(model.b1))]
        score = 1 / (1 + math.exp(-sum(h * w for h, w in zip(hidden, model.w2)) - model.b2))
        assert got[r.doc_id].score == pytest.approx(score, abs=1e-9) and got[r.doc_id].predicted == (score >= 0.3)


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.classify(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_quality_awkward(spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (6, 1, None), (None, 1, 0), (7, None, 0)], "doc_id bigint, quality int, toxic int")
    rows = quality.classify(awkward(spark), labels).collect()
    assert len(rows) == 9 and all(r.score is not None for r in rows)
    empty = {r.score for r in rows if r.doc_id in (2, 3, 4)}
    assert len(empty) == 1 and len({r.score for r in rows if r.doc_id == 1}) == 1
    assert quality.classify(nothing(spark), labels).count() == 0
    assert {r.score for r in quality.classify(awkward(spark), labels.limit(0)).collect()} == {0.5}


def test_non_negative_risk_separates():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (3000, quality.N_FEATURES)), rng.normal(-1, 1, (1000, quality.N_FEATURES))
    model = quality.train_nnpu(good[:1500], np.vstack([good[1500:], bad[:500]]), prior=0.75)
    assert (model.score(good) > 0.5).mean() > 0.97 and (model.score(bad) < 0.5).mean() > 0.97
