"""The corpus operators against brute force, the libraries and DuckDB, on tables of edge cases."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import catalog, chat, components, decontaminate, language, licences, line_dedup, ngram_jaccard, pieces, quality, token_counts, warc
from tidemark.runtime import settle

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None):
    rows = [(i, t, "en", f"s{k % 20}", None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return spark.createDataFrame(rows, DOCS).withColumns({"n_words": F.lit("clash"), "size": F.lit(1), "component_id": F.lit(2)})


EDGES = [None, "", " ", "\n\n", "a", "ab cd", "same text here now", "same text here now", "é ü ß 字 😀", "x" * 200_000, "word " * 30_000, "<|endoftext|> <|im_end|>", "tail\nline\n"]


def test_token_counts(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(catalog.tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(3)
    texts = EDGES + ["".join(rng.choice("ab c'stTL \n\t1२é字́\x85​😀,|<>end՘") for _ in range(50)) for _ in range(300)]
    import public_tokenizers

    got = {r.doc_id: r for r in token_counts.count_tokens(documents(spark, texts), catalog.tokenizer_path("byte_bpe_50k.json"), public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 1024)
    m = token_counts.merger(catalog.tokenizer_path("byte_bpe_50k.json"))
    assert m.count(b"x" * 5000) == m.count_long(b"x" * 5000)


def test_sentencepiece(spark):
    import sentencepiece

    path = catalog.tokenizer_path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    texts = EDGES + ["".join(rng.choice("ab ▁ \n字é\x00e the") for _ in range(40)) for _ in range(300)]
    digests = {r.doc_id: r for r in pieces.encode_digests(documents(spark, texts), path).collect()}
    codes = {r.doc_id: r for r in pieces.encode(documents(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        assert codes[i].ids == ids and codes[i].decoded == lib.decode(ids) and digests[i].n_tokens == len(ids)
        assert digests[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def grams(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_ngram_jaccard(spark):
    rng = random.Random(5)
    bases = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 60, 200]))] for _ in range(25)]
    texts = list(EDGES)
    for b in bases:
        for _ in range(rng.randrange(1, 12)):
            w = list(b)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(60)}"
            texts.append(" ".join(w))
    ids = rng.sample(range(1000), len(texts))
    got = {r.doc_id: r for r in ngram_jaccard.near_duplicate_components(documents(spark, texts, ids), 4, 85, 100).collect()}
    sets, top = [grams(t, 4) for t in texts], {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(ids[a]), find(ids[b])
                top[max(x, y)] = min(x, y)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), find(i)) for i, s in zip(ids, sets, strict=True)}
    assert ngram_jaccard.near_duplicate_components(documents(spark, []).limit(0), 4, 85, 100).isEmpty()


def test_components_of_a_long_path(spark):
    links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components.components(links).collect()} == {0}


def test_line_dedup(spark):
    shared = "a common footer line"
    texts = [f"own {i}\n{shared}\nend {i}" for i in range(12)] + [shared, None, "", f"{shared}\n{shared}"]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(documents(spark, texts)).collect()}
    assert out[0].text == texts[0] and out[0].n_removed == 0
    assert all(out[i].text == f"own {i}\nend {i}" for i in range(1, 12))
    assert out[12].text == "" and out[13].text is None and out[14].text == "" and out[15].text == "" and out[15].n_removed == 2


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), c.sql(catalog.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    text = lambda f: sorted(tuple("~" if pd.isna(x) else (f"{float(x):.9f}" if isinstance(x, (int, float, np.number)) else str(x)) for x in r) for r in f[columns].values.tolist())
    assert text(got) == text(want)


def test_warc(spark):
    page = "<html>" + "x" * 200
    rows = [(5, "http://a/%\n", page), (2, "http://b", page), (9, None, page), (1, "http://c", None), (3, "http://d", "small"), (4, "http://e", "small"), (6, "http://f", "y" * 600_000), (None, "http://g", page)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    bundles = settle(warc.write_bundles(pages), "test-warc")
    got = {r.page_id: r for r in warc.read_bundles(bundles).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {5: ("revisit", 2), 2: ("response", None), 9: ("revisit", 2), 1: ("response", None), 3: ("response", None), 4: ("response", None), 6: ("response", None), None: ("revisit", 2)}
    assert got[6].payload == b"y" * 600_000 and got[5].url == "http://a/%\n" and got[1].payload_bytes == 0
    assert got[9].payload_digest == hashlib.sha256(page.encode()).hexdigest()
    import zstandard

    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(bundles.first().bundle, read_across_frames=True).read(1 << 24) for _ in range(1))
    assert whole.startswith(b"WARC/1.1\r\n")
    assert warc.archive_digests(pages.limit(0)).isEmpty()


def test_quality(spark):
    texts = [*EDGES, "a b c a b c d", "l one\nl one\n  \nl two\nl one", "# * $ % & | < > é", " ".join(f"w{i}" for i in range(80)), " ".join(f"w{i % 40} q{i % 40}" for i in range(80))]
    got = {r.doc_id: r for r in quality.quality_rules(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = list(zip(w, w[1:], w[2:], strict=False))
        n, cover = collections.Counter(tri), set()
        for k, g in enumerate(tri):
            cover |= {k, k + 1, k + 2} if n[g] > 1 else set()
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert got[len(texts) - 2].kept and not got[len(texts) - 1].kept


def brute_hits(texts, items, window):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    found = []
    for t in texts:
        w, hit, who = words(t), set(), set()
        for i, x in items:
            x = words(x)
            m = min(window, len(x))
            for a in range(len(x) - m + 1 if m else 0):
                for k in range(len(w) - m + 1):
                    if w[k : k + m] == x[a : a + m]:
                        hit |= set(range(k, k + m))
                        who.add(str(i))
        found.append((len(w), sorted(hit), sorted(who)))
    return found


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontamination(spark, block):
    rng = random.Random(6)
    word = lambda: rng.choice("ab bc é the 12 x9".split())
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 4, 5, 7, 9])] + [(7, None), (8, ""), (None, "the"), (2, "ab-bc")]
    texts = [t for t in EDGES if not t or len(t) < 1000] + [" ".join(word() for _ in range(n))[: n * 2] for n in (3, 50, 600)] + ["AB, bc!\nThe_12"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.hits, r.items) for r in decontaminate.benchmark_hits(documents(spark, texts).select("doc_id", "text"), bench, 4, block_bytes=block).collect()}
    assert [got[i] for i in range(len(texts))] == brute_hits(texts, [x for x in items if x[0] is not None], 4)
    none = decontaminate.decontamination_report(documents(spark, texts), bench.limit(0))
    assert not none.filter("contaminated").count() and none.first().items_sha256 == hashlib.sha256(b"").hexdigest()


def test_decontamination_of_items_without_id(spark):
    passage = " ".join(f"w{k}" for k in range(12))
    docs = documents(spark, [f"before {passage} after", "of its own", f"x {passage} named item"])
    bench = spark.createDataFrame([(None, passage), (None, None), (5, "named item")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontamination_report(docs, bench).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert [(got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) for i in range(3)] == [(12, 0, sha(""), True), (0, 0, sha(""), False), (14, 1, sha("5"), True)]
    assert [r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()] == [1]


def test_chat_reads_back(spark):
    texts = ["\\", "\\|", "<|im_end|>\n", "<\\|", "", None, "<", "|im_sep|>", "\\<|im_next|>", "$1 \\Q\\E"]
    rows = [(c, k % 7, ("user", "assistant", "a<|im_sep|>b", None)[(k * c) % 4], t) for c in range(1, 6) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.chat_digests(df).collect()}
    read = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    for c in range(1, 6):
        turns = sorted((t, r or "", x or "") for i, t, r, x in rows if i == c)
        # Spark sorts by the escaped strings, which only differ among turns of one number.
        assert sorted((t.role, t.text) for t in read[c].turns) == sorted((r, x) for _, r, x in turns)
        assert got[c].n_turns == len(turns) and got[c].loss_chars == sum(len(x) for _, r, x in turns if r == "assistant")
    assert chat.chat_digests(df.limit(0)).isEmpty()
    assert {r.conv_id: r.n_turns for r in chat.chat_digests(chat.with_probe(df.limit(0))).collect()} == {-1: 2}


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    texts = [*EDGES, mit, "Prose.  Licensed under CC BY-NC 4.0.\nAll rights reserved.", "released under the mit license"]
    got = {r.doc_id: (r.licences, r.licence) for r in licences.scan_licences(documents(spark, texts)).collect()}
    n = len(EDGES)
    assert all(got[i] == ("", None) for i in range(n))
    assert [got[n + i] for i in range(3)] == [("MIT", "MIT"), ("CC-BY-NC-4.0,Proprietary", "CC-BY-NC-4.0"), ("MIT", "MIT")]


def test_licences_as_they_are_written(spark):
    """Wrapped texts with list numbers, comment leaders and both line ends."""
    mit = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED."""
    apache = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
    gpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
    fulls = {mit: ("MIT", "5|6"), apache: ("Apache-2.0", "7|8|9|10|11"), gpl: ("GPL-3.0-or-later", "12|14|15|16"), bsd: ("BSD-3-Clause", "17|18|19|20")}
    shorts = {
        "This project is licensed under the MIT License - see the [LICENSE](LICENSE.md) file for details.": "MIT", "// SPDX-License-Identifier: GPL-2.0\nint x;": "GPL-2.0", "Code is good. Licensed under the\nApache License 2.0.": "Apache-2.0",
        "Why? The MIT\nLicense (MIT)": "MIT", "We read the MIT License and laughed.": None, "an unlicensed under the mit license": None,
    }
    wraps = [lambda t: t, lambda t: "x = 1\n" + "\n".join(f"# {x}".rstrip() for x in t.split("\n")) + "\ny = 2", lambda t: "/*\r\n" + "\r\n".join(f" * {x}" for x in t.split("\n")) + "\r\n */", lambda t: "\n".join(f"; {x}" for x in t.split("\n")), lambda t: "\n".join(f"dnl {x}" for x in t.split("\n")), lambda t: " ".join(t.split())]
    cases = [(w(t), name, ids) for t, (name, ids) in fulls.items() for w in wraps] + [(t, name, None) for t, name in shorts.items()]
    got = {r.doc_id: r for r in licences.scan_licences(documents(spark, [t for t, _, _ in cases])).collect()}
    for i, (t, name, ids) in enumerate(cases):
        assert got[i].licence == name, t
        assert ids is None or ids in got[i].sentence_ids, t


def test_language(spark):
    got = catalog.QUERIES["op10_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out")
    assert held.filter("lang_pred = lang").count() >= 0.98 * held.count() > 0
    odd = {r.doc_id: r for r in language.identify(documents(spark, [*EDGES, "½² 123"])).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (0, 1, 2, 3, len(EDGES))) and odd[4].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in odd.values())
    assert {r.lang_pred for r in language.identify(documents(spark, ["text"]).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    code = language.codewords(7)
    assert len({tuple(r) for r in code}) == 7 and (np.abs(code.sum(0)) < 7).all()


def test_chunks_hold_whole_rows():
    from tidemark.llm.batches import chunks

    batch = pa.RecordBatch.from_arrays([pa.array(["ab", None, "x" * 50, "c"])], ["text"])
    assert [p.num_rows for p in chunks(batch, most=4)] == [2, 1, 1]


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = settle(stage(spark, kept, SF), "test-stage")
        assert kept.columns == docs.columns and kept.count() <= before.count()
    rows = {r.doc_id: r.text for r in kept.collect()}
    sets = {i: grams(t, 5) for i, t in rows.items()}
    ids = sorted(rows)
    assert not [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(h for _, h, _ in brute_hits(list(rows.values())[:40], items, 10))
    final = corpus_pipeline.run(spark, SF)
    assert {r.doc_id: r.decoded for r in final.collect()} == rows


def groups_of_near_duplicates(sets):
    """The smallest id of each id's component of pairs with a similarity of 0.8 or more."""
    first = {i: i for i in sets}

    def root(i):
        while first[i] != i:
            i = first[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                first[y] = x
    return {i: root(i) for i in ids}


def test_pipeline_rows_by_brute_force(spark):
    """Every stage keeps just the documents and texts that brute force over all rows keeps."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    sources = {r.doc_id: r.source for r in docs.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(texts) == docs.count() == 200
    rows = docs

    def check(name, want):
        nonlocal rows
        rows = settle(stages[name](spark, rows, SF), "brute-stage")
        got = [(r.doc_id, r.text, r.n_chars) for r in rows.collect()]
        assert sorted(got) == sorted((i, t, len(t)) for i, t in want.items()), name
        return want

    clear = {r.doc_id for r in language.identify(docs).collect() if r.lang_pred != "und" and not r.ambiguous and r.score >= 0.5}
    texts = check("language identification", {i: t for i, t in texts.items() if i in clear})

    sites, place = collections.defaultdict(set), {}
    for i in sorted(texts):
        for k, line in enumerate(texts[i].split("\n")):
            if line.strip(" \t\r"):
                sites[line].add(sources[i])
                place.setdefault(line, (i, k))
    common = {line for line, s in sites.items() if len(s) >= 8}
    kept = {}
    for i, t in texts.items():
        lines = t.split("\n")
        left = [x for k, x in enumerate(lines) if x not in common or place[x] == (i, k)]
        if len(left) == len(lines) or any(x.strip(" \t\r") for x in left):
            kept[i] = "\n".join(left)
    assert kept != texts
    texts = check("line dedup", kept)

    first = groups_of_near_duplicates({i: grams(t, 5) for i, t in texts.items()})
    assert any(first[i] != i for i in texts)
    texts = check("n-gram Jaccard join", {i: t for i, t in texts.items() if first[i] == i})

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    runs = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    windows = collections.defaultdict(set)
    for w in (words(t) for _, t in items):
        if w:
            windows[min(10, len(w))] |= runs(w, min(10, len(w)))
    clean = {i: t for i, t in texts.items() if not any(runs(words(t), n) & held for n, held in windows.items())}
    assert len(clean) < len(texts)
    texts = check("benchmark decontamination", clean)

    assert sorted((r.doc_id, r.decoded) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(texts.items())


def test_stages_on_odd_rows(spark):
    """Nulls, repeated rows, shared ids, columns with the operators' own names, and empty tables."""
    import corpus_pipeline

    long = " ".join(f"word{k}" for k in range(30))
    footer = "a common footer line"
    texts = [None, "", long, long, long + " more", *[f"text {i} of its own\n{footer}" for i in range(9)], footer, long, f"{footer}\nx\ny", long]
    ids = [0, 1, 7, 7, 8, *range(20, 29), 40, None, 41, 41]
    clash = {c: F.lit(c) for c in ("hits", "items", "n_lines", "n_removed", "gone", "place", "line", "sig", "n", "first_id", "held_out")}
    docs = documents(spark, texts, ids).withColumn("source", F.concat(F.lit("s"), F.coalesce("doc_id", F.lit(0)))).withColumns(clash)
    stages = dict(corpus_pipeline.STAGES)
    held = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())

    def run(name, rows):
        out = settle(stages[name](spark, rows, SF), "odd-rows")
        assert out.columns == docs.columns and all(getattr(r, c) == c for r in out.collect() for c in clash)
        assert stages[name](spark, rows.limit(0), SF).count() == 0
        return held(out)

    lines = run("line dedup", docs)
    assert lines[20, texts[5]] == 1 and lines[21, "text 1 of its own"] == 1 and (40, "") not in lines
    assert lines[7, long] == 2 and lines[None, long] == 1 and lines[0, None] == 1 and lines[1, ""] == 1
    assert lines[41, "x\ny"] == 1 and lines[41, long] == 1
    near = run("n-gram Jaccard join", docs)
    assert near[7, long] == 1 and not {(8, texts[4]), (None, long)} & set(near) and near[0, None] == near[1, ""] == 1
    alone = documents(spark, ["of its own words", long, long], [None, 3, None]).withColumns(clash)
    assert run("n-gram Jaccard join", alone) == {(None, "of its own words"): 1, (3, long): 1, (None, long): 1}
    assert run("benchmark decontamination", docs) == held(docs)
    assert {t for _, t in run("language identification", docs)} == {t for t in texts if t}
    last = stages["SentencePiece encoding"](spark, docs, SF)
    assert last.count() == len(texts) and last.filter("doc_id = 0").first().decoded == ""


def test_language_counts_do_not_depend_on_blocks(monkeypatch):
    from tidemark.llm.textbytes import TextBytes

    texts = TextBytes(pa.array(["", "abcabcabc", None, "é字", "x", "x" * 70, ""]), lower=True)
    whole = language.ngram_counts(texts)
    assert whole.sum(1).tolist() == [0, 21, 0, 4 + 3 + 2, 0, 69 + 68 + 67, 0]
    for block in (1, 2, 3, 7, 64):
        monkeypatch.setattr(language, "BLOCK", block)
        assert (language.ngram_counts(texts) == whole).all()


def test_warc_of_repeated_rows(spark):
    """Every record has an identifier of its own; of equal rows one is the response."""
    big = "<html>" + "y" * 300
    rows = [(1, "http://a", "small")] * 2 + [(2, "http://b", big)] * 3 + [(2, "http://a", big), (7, "http://c", big), (8, "http://d", "z" * 200)] + [(None, "http://n", big)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    bundles = settle(warc.write_bundles(pages), "test-warc")
    got = warc.read_bundles(bundles).collect()
    assert len({r.record_id for r in got}) == len(rows) == len(got)
    assert sorted((r.page_id, r.url) for r in got if r.record_type == "response") == [(1, "http://a"), (1, "http://a"), (2, "http://a"), (8, "http://d")]
    assert {(r.refers_to, r.payload) for r in got if r.record_type == "revisit"} == {(2, b"")} and all(r.payload_bytes == len(big) for r in got if r.record_type == "revisit")
    again = settle(warc.write_bundles(pages.repartition(2)), "test-warc")
    assert {r.record_id for r in warc.read_bundles(again).collect()} == {r.record_id for r in got}


def test_warc_files(spark, tmp_path):
    """Exported files are plain .warc.zst: any reader of Zstandard finds WARC records with HTTP heads."""
    import zstandard

    rows = [(i, f"http://{i}", f"<p>{i}</p>" * 50 * (i % 3)) for i in range(40)]
    bundles = settle(warc.write_bundles(spark.createDataFrame(rows, "page_id long, url string, html string")), "test-warc")
    files = [r.file for r in warc.export_bundles(bundles, f"file://{tmp_path}/out").collect()]
    found = {}
    for f in files:
        data = open(f, "rb").read()
        assert warc.Reader(data).frame(0).startswith(b"WARC/1.1\r\n")
        rest = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        while rest:
            head, _, after = rest.partition(b"\r\n\r\n")
            size = int(re.search(rb"Content-Length: (\d+)", head).group(1))
            headers, block = warc.parse(rest[: len(head) + 4 + size + 4])
            rest = after[size + 4 :]
            found[int(headers["X-Page-Id"])] = block
            assert headers["WARC-Type"] == "revisit" or block.startswith(b"HTTP/1.1 200 OK\r\n")
    assert found[1].endswith(b"\r\n\r\n" + rows[1][2].encode()) and len(found) == 40


def test_language_by_brute_force(spark):
    """Counts, weights and decoding, written out plainly, give the same predictions and scores."""
    import math
    import zlib

    rng = random.Random(8)
    words = {"xx": ["aba", "bab", "abba"], "yy": ["cdc", "dcd", "bcd"], "zz": ["efe", "aef", "fef"]}
    texts = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 12))), lang) for i, lang in enumerate(rng.choices(list(words), k=90))]
    texts += [(200, "aba cdc", None), (201, None, "xx"), (202, "12 3", "yy"), (203, "é", "zz"), (203, "é", "zz")]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    B, K = language.BUCKETS, len(language.ORDERS)

    def counts(text):
        data, out = text.lower().encode(), collections.Counter()
        for k, n in enumerate(language.ORDERS):
            for a in range(len(data) - n + 1):
                out[k * B + (int.from_bytes(data[a : a + n], "big") * 0x9E3779B1 % (1 << 32) >> 20)] += 1
        return out

    learned = collections.defaultdict(lambda: [0.0] * (B * K))
    for i, text, lang in texts:
        if text is not None and lang is not None and zlib.crc32(str(i).encode()) % 5:
            c = counts(text)
            for b, x in c.items():
                learned[lang][b] += 1000 * x / max(sum(c.values()), 1)
    langs = sorted(learned)
    rates = {lang: [] for lang in langs}
    for lang in langs:
        for k in range(K):
            part = [x + 0.5 for x in learned[lang][k * B : (k + 1) * B]]
            total = sum(part)
            rates[lang] += [x / total for x in part]
    code = {lang: [1 if (s >> n) & 1 else -1 for s in range(1, 1 << (len(langs) - 1))] for n, lang in enumerate(langs)}
    n_bits = len(code[langs[0]])

    def mean(bit, sign, b):
        held = [rates[x][b] for x in langs if code[x][bit] == sign]
        return sum(held) / len(held)

    got = {r.doc_id: r for r in language.identify(df).collect()}
    for i, text, _ in texts:
        if not any(c.isalpha() for c in text or ""):
            assert got[i].lang_pred == "und" and got[i].score == 0
            continue
        c = counts(text)
        value = [sum(x * math.log(mean(bit, 1, b) / mean(bit, -1, b)) for b, x in c.items()) * language.SCALE / max(sum(c.values()), 1) for bit in range(n_bits)]
        loss = [sum(math.log1p(math.exp(-v * s)) for v, s in zip(value, code[x], strict=True)) for x in langs]
        p = [math.exp(min(loss) - x) for x in loss]
        assert got[i].lang_pred == langs[loss.index(min(loss))] and abs(got[i].score - max(p) / sum(p)) < 1e-6
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_language_ties_go_to_the_first_language():
    model = language.Model(["aa", "bb"], np.ones((2, language.BUCKETS * len(language.ORDERS))))
    best, score, unclear = model.decode(np.ones((1, language.BUCKETS * len(language.ORDERS))))
    assert best.tolist() == [0] and score.tolist() == [0.5] and unclear.tolist() == [True]


def test_decontamination_compares_words(monkeypatch):
    """Hashes that all clash change nothing but the time."""
    from tidemark.llm.textbytes import ALNUM_WORDS, TextBytes

    rng = random.Random(2)
    word = lambda: rng.choice("ab bc é the 12 x9 abc".split())
    items = [(str(i), " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 4, 5, 9])]
    docs = [" ".join(word() for _ in range(n)) for n in (0, 3, 40, 200)]
    monkeypatch.setattr(TextBytes, "hashes", lambda self, starts, ends: np.full(len(starts), 7, np.uint64))
    block, texts = decontaminate.Block(items, 4), TextBytes(pa.array(docs), lower=True)
    starts, ends, doc = texts.words(ALNUM_WORDS)
    first = np.searchsorted(doc, np.arange(len(docs) + 1))
    hits, who = [set() for _ in docs], [set() for _ in docs]
    for m, at, item in block.search(texts, starts, ends, texts.hashes(starts, ends), doc):
        for a, i in zip(at.tolist(), item.tolist(), strict=True):
            hits[doc[a]] |= set(range(a - first[doc[a]], a - first[doc[a]] + m))
            who[doc[a]].add(block.ids[i])
    assert [(int(first[d + 1] - first[d]), sorted(hits[d]), sorted(who[d])) for d in range(len(docs))] == brute_hits(docs, items, 4)


def test_decontamination_tables_are_bounded():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
    items = [(str(i), " ".join(rng.choice(words) for _ in range(100))) for i in range(500)]
    assert decontaminate.Block(items, 10).nbytes < 14 * sum(len(t) for _, t in items) + (1 << 17)


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    from tidemark.llm import textbytes

    texts = textbytes.TextBytes(pa.array(["ab c", "", "x" * 100 + " y", "ab " * 50, "zz"]))
    starts, ends, _ = texts.words(textbytes.BLANK_WORDS)
    whole = texts.hashes(starts, ends)
    assert len(set(whole.tolist())) == 5
    for block in (1, 2, 3, 7, 64):
        monkeypatch.setattr(textbytes, "BLOCK", block)
        textbytes.forget()
        assert (texts.hashes(starts, ends) == whole).all()
    textbytes.forget()


ODD = [None, "", "a", "twin text of some words here", "twin text of some words here", "LONG " * 200_000, "<|endoftext|>"]


def test_odd_tables(spark):
    """Empty tables, repeated rows (also of one doc_id) and very long texts, in every operator."""
    path = catalog.tokenizer_path
    import public_tokenizers

    bench = spark.createDataFrame([(1, "nothing of this occurs anywhere at all in any of those texts")], "item_id long, text string")
    model = language.Model(["aa", "bb"], np.random.default_rng(1).random((2, language.BUCKETS * len(language.ORDERS))))
    ops = {
        "op1": lambda d: token_counts.count_tokens(d, path("byte_bpe_50k.json"), public_tokenizers.PATTERN), "op2": ngram_jaccard.near_duplicate_components, "op3": line_dedup.line_report, "op5": quality.quality_report,
        "op6": lambda d: decontaminate.decontamination_report(d, bench), "op8": licences.scan_licences, "op9": lambda d: pieces.encode_digests(d, path("piece_bpe_32k.model")), "op10": lambda d: language.identify(d, model),
    }
    ids = [5, 5, 5, 7, 7, 8, None]
    docs = documents(spark, ODD, ids)
    for name, op in ops.items():
        assert op(docs.limit(0)).count() == 0, name
        rows = op(docs).collect()
        assert sorted(-1 if r.doc_id is None else r.doc_id for r in rows) == sorted(-1 if i is None else i for i in ids), name
        twins = [r for r in rows if r.doc_id == 7]
        assert twins[0] == twins[1], name
    assert language.identify(docs).count() == len(ODD)
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, "assistant", "x|<" * 300_000)], "conv_id long, turn long, role string, text string")
    got = chat.chat_digests(turns).first()
    assert got.n_turns == 3 and got.loss_chars == 900_000 and got.loss_sha256 == hashlib.sha256(b"x|<" * 300_000).hexdigest()


def test_licences_of_rules_by_length_and_of_own_rules(spark):
    """A licence whose rule is part of a longer match isn't reported; callers may bring hundreds of rules."""
    bsd = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
           "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
           "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."]
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose\nwith or without fee is hereby granted, provided that the above copyright notice\nand this permission notice appear in all copies."
    lgpl = "// This library is free software; you can redistribute it and/or\n// modify it under the terms of the GNU Lesser General Public\n// License as published by the Free Software Foundation; either\n// version 2.1 of the License, or (at your option) any later version."
    texts = ["\n".join(bsd), "\n".join(bsd[:3]), "\n".join([*bsd, "x", *bsd[:3]]), isc, lgpl, "# SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: 0BSD"]
    got = [r.licences for r in licences.scan_licences(documents(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["BSD-3-Clause", "BSD-2-Clause", "BSD-3-Clause,BSD-2-Clause", "ISC", "LGPL-2.1-or-later", "AGPL-3.0", "0BSD"]
    own = licences.RuleBase([f"sentence number {k} of the rules" for k in range(600)], [(f"L{k}", (k + 1, k + 2)) for k in range(599)] + [("first", (1,))])
    rows = licences.scan_licences(documents(spark, ["Sentence number 7 of the rules. Sentence number 8 of the rules.", "sentence number 0 of the rules", "sentence number 77"]), base=own)
    assert [r.licences for r in rows.orderBy("doc_id").collect()] == ["L7", "first", ""]
