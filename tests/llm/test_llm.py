"""The ten operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import collections
import hashlib
import html as html_lib
import random
import re

import pytest

pytest.importorskip("tracklake.llm")

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
SCHEMA = "doc_id bigint, text string, lang string, words string"


@pytest.fixture(scope="module")
def rows():
    """Made texts with exact and near copies, shared passages, repeated rows, nulls, empty and long ones."""
    rng = random.Random(5)
    vocabulary = ["w" + "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(900)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = line(40)
    out = []
    for k in range(60):
        lines = [line(rng.randint(3, 30)) for _ in range(rng.randint(1, 8))]
        if k % 5 == 0:
            lines.insert(rng.randint(0, len(lines)), shared)
        out.append("\n".join(lines))
    for k in range(20):  # near copies of every degree
        words = out[k].split(" ")
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append(" ".join(words))
    out += [out[3], out[3], out[4].upper(), "", " \n\t ", None, "a", "a", "#### ||", "x" * 99, "y" * 250, line(9000), "one two three four", "one two three four", "a  b   c \x1c\n \n d ", "ends <|endoftext|> here "]
    table = [(k, t, "en", "clash") for k, t in enumerate(out)]
    return [*table, table[0], table[7], (None, "a text without an id", "en", "clash"), (None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def unique(rows):
    return sorted({(i, t) for i, t, *_ in rows if i is not None})


def test_line_dedup(docs, rows, empty):
    from tracklake.llm.line_dedup import dedup_lines

    got = {(r.doc_id, r.text): (r.n_lines, r.n_removed, r.kept_text, r.words) for r in dedup_lines(docs).collect()}
    seen = []
    order = [*unique(rows), *((None, t) for t in ["a text without an id", None])]
    for i, t in order:
        keep, n_lines, removed, own = [], 0, 0, []
        for x in (t or "").split("\n"):
            w = frozenset(WORD.findall(x.lower()))
            n_lines += bool(w)
            gone = bool(w) and any(len(w & s) >= 0.8 * len(w | s) for s in seen + own)
            if w:
                own.append(w)
            removed += gone
            if not gone:
                keep.append(x)
        seen += own
        assert got[i, t][:3] == (n_lines, removed, "\n".join(keep)), i
    assert dedup_lines(docs).count() == len(rows)
    assert dedup_lines(empty).count() == 0


def like_earlier(sets):
    """Whether an earlier set is like each one."""
    return [any(len(x & s) >= 0.8 * len(x | s) for s in sets[:k]) for k, x in enumerate(sets)]


@pytest.mark.parametrize("hot", [1, 20, 4096])
def test_line_dedup_hot_words(spark, monkeypatch, hot):
    """Made of few words, one of them in a third of all lines: as keys of one word, or of two, in parts of any size."""
    from tracklake.llm import line_dedup

    monkeypatch.setattr(line_dedup, "JOIN_ROWS", 300)
    monkeypatch.setattr(line_dedup, "JOIN_BYTES", 1 << 14)
    monkeypatch.setattr(line_dedup, "_STEPS", 4)
    rng = random.Random(hot)
    vocabulary = [f"v{k}" for k in range(40)]
    lines = []
    for k in range(700):
        own = rng.sample(vocabulary, rng.randint(1, 14)) + (["rare", f"n{k % 9}"] if k % 3 == 0 else [])
        if k > 20 and k % 2:
            own = lines[rng.randrange(k)].split()
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
        lines.append(" ".join(own))
    d = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(d, hot=hot).collect()}
    want = like_earlier([set(x.split()) for x in lines])
    assert [bool(got[k]) for k in range(len(lines))] == want and 100 < sum(want) < 600


def test_line_dedup_names(spark):
    """Columns of any name are passed on, that of an added one is replaced."""
    from tracklake.llm.line_dedup import dedup_lines

    names = ["gone", "d", "rid", "__d", "__rid", "__gone", "of", "t", "key", "line", "n_lines"]
    d = spark.createDataFrame([(1, "a b c\nA B c", *names), (2, "x", *names), (2, "x y\nc b a", *names)], ["doc_id", "text", *names])
    out = dedup_lines(d)
    assert sorted(out.columns) == sorted([*d.columns, "n_removed", "kept_text"])
    rows = out.collect()
    assert sorted((r.doc_id, r.kept_text, r.n_lines) for r in rows) == [(1, "a b c", 2), (2, "x", 1), (2, "x y", 2)]
    assert all(r[c] == c for r in rows for c in names[:-1])


def test_line_dedup_near_misses(spark):
    """Near misses that pass the filters do not hide a later candidate."""
    from tracklake.llm.line_dedup import dedup_lines

    rng = random.Random(1)
    base = [f"t{k}" for k in range(30)]
    table = []
    for k in range(120):
        words = base[:]
        for j in rng.sample(range(30), rng.randint(2, 5)):
            words[j] = f"u{rng.randint(0, 60)}"
        table.append((k, " ".join(words)))
    got = {r.doc_id: r.n_removed for r in dedup_lines(spark.createDataFrame(table, "doc_id bigint, text string")).collect()}
    assert [bool(got[k]) for k in range(len(table))] == like_earlier([set(t.split()) for _, t in table])


def test_license_scan(spark, docs, rows, empty):
    from tracklake.llm.license_scan import SENTENCES, license_scan

    mit = ". ".join(SENTENCES[k].capitalize() for k in ("mit-grant", "mit-condition", "mit-asis")) + "."
    table = [(1, "Text.\nReleased under the MIT License.\nLicensed under the Apache License, Version 2.0."), (2, mit), (3, SENTENCES["mit-condition"]), (4, None), (5, ""), (6, "x " * 50_000), (7, "MIT License\n" + mit)]
    got = {r.doc_id: (list(r.rules), list(r.licenses), r.n_known_sentences) for r in license_scan(spark.createDataFrame(table, "doc_id int, text string")).collect()}
    assert got[1] == (["apache-2.0-notice", "mit-notice"], ["Apache-2.0", "MIT"], 2)
    assert got[2] == (["mit-text"], ["MIT"], 3)
    assert got[3] == ([], [], 1)
    assert got[4] == got[5] == got[6] == ([], [], 0)
    assert got[7] == (["mit-text", "mit-title"], ["MIT"], 4)
    assert license_scan(docs).count() == len(rows) and license_scan(empty).count() == 0


GENUINE = {
    "mpl-2.0-header": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\nint x;",
    "lgpl-2.1-or-later-header": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n\n"
    "This library is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU\nLesser General Public License for more details.",
    "agpl-3.0-or-later-header": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\n"
    "This program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU Affero General Public License for more details.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH\nREGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY\nAND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR',
    "unlicense-text": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.",
    "zlib-text": "This software is provided 'as-is', without any express or implied\nwarranty.  In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin",
    "epl-2.0-header": "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/\n\nContributors: one",
    "apache-2.0-named": "// SPDX-License-Identifier: Apache-2.0\npackage x",
    "lgpl-3.0-only-named": "This file is distributed under the terms of the GNU Lesser General Public License v3.",
    "cc-by-nc-sa-4.0-named": "# Note\nThis work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.\n",
    "epl-1.0-named": "Released under the Eclipse Public License, ver. 1.0, see Acme Inc. for more\n",
    "mit-notice": "Released under the MIT License\n" + "=" * 2000,
}


def test_license_scan_genuine(spark):
    """Notices as they stand in files; points of short forms end no sentence."""
    from tracklake.llm.license_scan import KNOWN, KNOWN_NAMES, RULES, license_scan

    assert {i for r in RULES for i in r.sentences} <= {*KNOWN.values(), *KNOWN_NAMES.values()} and len(RULES) > 70
    got = {r.rule: r.rules for r in license_scan(spark.createDataFrame([(k, v) for k, v in GENUINE.items()], "rule string, text string")).collect()}
    wanted = {k: [k] for k in GENUINE} | {"epl-1.0-named": []}
    assert got == wanted


BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS''."""
ENDORSE = "3. Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"


def test_license_scan_of_any_holder(spark):
    from tracklake.llm.license_scan import license_scan

    cases = {
        BSD.format(ENDORSE.format("the University")): ["BSD-3-Clause"], BSD.format(ENDORSE.format("Google Inc.")): ["BSD-3-Clause"], BSD.format(ENDORSE.format("the copyright holder")): ["BSD-3-Clause"],
        BSD.format("3. The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.\n"): ["BSD-3-Clause"], BSD.format(""): ["BSD-2-Clause"],
        "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n": ["Apache-2.0"],
        "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n": ["GPL-3.0-only"],
        "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999\n": ["LGPL-2.1-only"], "Mozilla Public License Version 2.0\n==================================\n": ["MPL-2.0"],
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.": ["GPL-2.0-only"],
        "SPDX-License-Identifier: (MIT OR Apache-2.0)": ["Apache-2.0", "MIT"], "// SPDX-License-Identifier: GPL-2.0-or-later": ["GPL-2.0-or-later"], "/* SPDX-License-Identifier: GPL-2.0-or-later OR MIT */": ["GPL-2.0-or-later", "MIT"],
        "Released under the terms of the MIT license, see the file LICENSE.": ["MIT"], "Licensed under the GNU GPL v3 or later.": ["GPL-3.0-or-later"], "Licensed under the MIT license and the Apache License, Version 2.0.": ["Apache-2.0", "MIT"],
        "She said the name of the author may be used with care.": [],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id int, text string")
    got = {r.doc_id: r.licenses for r in license_scan(df).collect()}
    for k, (text, want) in enumerate(cases.items()):
        assert got[k] == want, text


def test_license_scan_columns(spark):
    from tracklake.llm.license_scan import license_scan

    d = spark.createDataFrame([("All rights reserved", "a", "b", 9)], "text string, rules string, __ids0 string, n_known_sentences int")
    r = license_scan(d).first()
    assert list(r.rules) == ["all-rights-reserved"] and r["__ids0"] == "b" and r.n_known_sentences == 1


def test_license_scan_wrapped(spark):
    """Licence texts as they are wrapped, with and without comment marks, with lists, and unwrapped."""
    import textwrap

    from tracklake.llm.license_scan import SENTENCES, license_scan

    mit = [SENTENCES["mit-grant"] + ":", SENTENCES["mit-condition"] + ".", SENTENCES["mit-asis"].upper() + ". IN NO EVENT more"]
    gpl2 = ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."]
    bsd = [SENTENCES["bsd-redistribution"] + ":", "1. " + SENTENCES["bsd-source"] + ".", "2. " + SENTENCES["bsd-binary"] + ".", "3. " + SENTENCES["bsd-endorse"] + "."]
    apache = ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.']
    texts = {"mit-text": mit, "gpl-2.0-header": gpl2, "bsd-3-text": bsd, "apache-2.0-header": apache}
    table = []
    for rule, paragraphs in texts.items():
        for width in (30, 72, 10_000):
            for mark in ("", "# ", " * ", "// "):
                blocks = [textwrap.fill(p, width).split("\n") for p in paragraphs]
                for between in ([""], []) if rule == "bsd-3-text" else ([""],):
                    lines = [x for b in blocks for x in [*b, *between]]
                    table.append((rule, "\n".join(["int x", "", *[mark + x for x in lines], "", "y"])))
    table.append(("mit-licensed", "# Licensed under the MIT" + " " * 3000 + "License."))
    for r in license_scan(spark.createDataFrame(table, "rule string, text string")).collect():
        assert r.rules == [r.rule], (r.rule, r.rules, r.text)


def brute_classes(rows):
    sets = {}
    for i, t in unique(rows):
        w = WORD.findall((t or "").lower())
        s = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset([("", t or "")])
        sets[i] = s
    parent = {i: i for i in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def test_near_duplicates(docs, rows, empty):
    from tracklake.llm.minhash import drop_near_duplicates, near_duplicates

    want = brute_classes(rows)
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert all(r.class_id == want.get(r.doc_id) for r in got)
    left = [r.doc_id for r in drop_near_duplicates(docs).collect()]
    assert collections.Counter(left) == collections.Counter(i for i, *_ in rows if i is None or want[i] == i)
    assert near_duplicates(empty).count() == 0


def test_near_duplicates_of_large_buckets(spark, monkeypatch):
    """Pairs of texts that all share their buckets and are no near-duplicates of the leaders."""
    from tracklake.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK_ROWS", 16)
    base = [f"b{k}" for k in range(200)]
    table = []
    for k in range(40):
        own = base[:]
        own[4 * k : 4 * k + 4], own[-30:] = [f"x{k}y{j}" for j in range(4)], [f"v{k}z{j}" for j in range(30)]
        table += [(2 * k, " ".join(own)), (2 * k + 1, " ".join([*own, "end"]))]
    want = brute_classes(table)
    assert len(set(want.values())) == 40
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(table, "doc_id bigint, text string"), rows=1).collect()}
    assert got == want


def test_near_duplicates_of_one_id(spark):
    """One id with several texts is one document with the links of each."""
    from tracklake.llm.minhash import near_duplicates

    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    table = [(1, a), (5, a), (5, b), (7, b), (9, b + " end"), (11, "other words here"), (11, None), (12, "")]
    got = collections.defaultdict(set)
    for r in near_duplicates(spark.createDataFrame(table, "doc_id bigint, text string")).collect():
        got[r.doc_id].add(r.class_id)
    assert got == {1: {1}, 5: {1}, 7: {1}, 9: {1}, 11: {11}, 12: {11}}


def test_near_duplicates_recall(spark):
    """A bucket of hundreds of near copies of every degree, against all pairs: no link between different texts is lost."""
    from tracklake.llm.minhash import near_duplicates

    rng = random.Random(8)
    base = [f"b{k}" for k in range(150)]
    table = []
    for k in range(400):
        own = base[:]
        for _ in range(rng.randint(0, 12)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        table.append((k, " ".join(own)))
    want = brute_classes(table)
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(table, "doc_id bigint, text string")).collect()}
    assert len(set(want.values())) > 100
    assert sum(got[k] == want[k] for k in want) >= 0.99 * len(want)


def test_near_duplicates_with_repeated_shingles(spark):
    """Like as sets of shingles, unlike by their numbers."""
    from tracklake.llm.minhash import near_duplicates

    base = [f"b{k}" for k in range(100)]
    table = [(1, " ".join(base)), (2, " ".join([*base, *["z"] * 400])), (3, "z " * 300)]
    assert {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(table, "doc_id bigint, text string")).collect()} == {1: 1, 2: 1, 3: 3}


def test_prob_minhash_estimates_probability_jaccard():
    import numpy as np

    from tracklake.llm.minhash import prob_minhash
    from tracklake.llm.text import mix

    items = mix(np.arange(60, dtype=np.uint64)) >> np.uint64(14)
    a, b = np.r_[np.arange(1, 41), np.zeros(20)], np.r_[np.zeros(20), np.full(40, 7.0)]
    row = np.r_[np.zeros(40), np.ones(40)].astype(int)
    sig = prob_minhash(row, np.r_[items[:40], items[20:]], np.r_[a[:40], b[20:]], 2, 4000)
    want = sum(1 / np.maximum(a / a[d], b / b[d]).sum() for d in range(20, 40))
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def test_components(spark):
    from tracklake.llm.components import components

    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 201)]
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}


def test_bpe(docs, rows, empty):
    from tokenizers import Tokenizer

    from tracklake.llm import bpe
    from tracklake.llm.queries import tokenizer_path

    path = tokenizer_path()
    reference = Tokenizer.from_file(path)
    out = bpe.decode(bpe.encode(docs, path), path).collect()
    assert len(out) == len(rows)
    for r in out:
        want = reference.encode(r.text or "", add_special_tokens=False).ids
        assert [int.from_bytes(r.ids[k : k + 4], "little") for k in range(0, len(r.ids), 4)] == want
        assert r.decoded == reference.decode(want, skip_special_tokens=False) == (r.text or "")
    assert bpe.encode(empty, path).count() == 0


def test_bpe_every_character():
    from tokenizers import Tokenizer

    from tracklake.llm.bpe import PairIndexBpe
    from tracklake.llm.queries import tokenizer_path

    rng = random.Random(2)
    own, reference = PairIndexBpe(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    texts = [f"a{c}1{c} {c}{c}b" for c in map(chr, range(0, 0x3100))]
    texts += ["".join(rng.choice(" \n\tab'sé1.,\x85　<|endoftext|>") for _ in range(30)) for _ in range(2000)] + ["aaaaaaaaaaa " * 50, "x<|endoftext|> y"]
    want = [b"".join(i.to_bytes(4, "little") for i in e.ids) for e in reference.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts) == want


PAGE = (
    "<html><head><title>T</title><style>p{}</style></head><body><header><a>Home</a></header><nav><ul><li>One<li>Two</ul></nav><div class='cookie-notice'>We use cookies</div>"
    "<article><h1>Head %d &amp; more</h1><p>First <b>bo</b>ld&nbsp;text %d<br>next<p>Share this story</p><aside>side</aside><form><label>mail</label></form><section id=comments><p>reader</p></section>"
    "<script>if (a<b) document.write('<p>no</p>')</script></article><footer>foot</footer></body></html>"
)


def texts_of(spark, table, columns="page_id int, url string, html string"):
    from tracklake.llm.html_extract import extract_main_text

    got = collections.defaultdict(set)
    for r in extract_main_text(spark.createDataFrame(table, columns)).collect():
        got[r.page_id].add(r.text)
    return got


def test_html_extract(spark):
    from tracklake.llm.html_extract import deduce_templates, extract_main_text, page_tokens, token_vectors

    table = [(k, f"https://h.example/{k}", PAGE % (k, k * k)) for k in range(8)]
    table += [(100, "https://solo.example/", PAGE % (1, 1)), (101, "nonsense", "plain < text &lt;b&gt;"), (102, None, None), (103, "https://h.example/9", ""), table[0]]
    pages = spark.createDataFrame(table, "page_id int, url string, html string")
    got = texts_of(spark, table)
    # Paragraphs of one slot vary: it is content, with the lines that all pages have.
    assert got[3] == {"Head 3 & more First bold text 9 next Share this story"}
    assert got[100] == {"Head 1 & more First bold text 1 next Share this story"}
    assert got[101] == {"plain < text <b>"} and got[102] == got[103] == {""}
    templates = deduce_templates(token_vectors(page_tokens(pages))).collect()
    assert len(templates) == 1 and len(templates[0].texts) >= 3 and len(templates[0].paths) >= 5
    assert extract_main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [0, 500_000])
def test_html_templates_decide(spark, monkeypatch, bound):
    """Two layouts of one host without telling names: menus and notes go as they are constant, by layout; alone they stay."""
    from tracklake.llm import html_extract

    monkeypatch.setattr(html_extract, "BROADCAST_TOKENS", bound)
    one = "<body><div class=a1><div class=a2>Start Topics Shop</div><div class=a3><h1>Story %d</h1><p>Text of %d</p><p>The same closing words</p></div><div class=a4>%s</div></div></body>"
    two = "<body><div class=b1><span>Alpha</span><div class=b2><p>Other %d</p><p>and %d</p></div><div class=b3>%s</div><div class=b4>Imprint of two</div></div></body>"
    note, end = "We keep all rights to what you read here. " * 8, "Written by the staff"
    table = [(k, f"https://lay.example/{k}", one % (k, k * 7, note)) for k in range(18)]
    table += [(k, f"https://lay.example/{k}", two % (k, k * 7, end)) for k in range(18, 30)]
    table += [(99, "https://alone.example/", one % (5, 35, note)), (100, "https://lay.example/x", None)]
    got = texts_of(spark, table)
    assert all(got[k] == {f"Story {k} Text of {k * 7} The same closing words"} for k in range(18))
    assert all(got[k] == {f"Other {k} and {k * 7}"} for k in range(18, 30))
    assert got[99] == {f"Start Topics Shop Story 5 Text of 35 The same closing words {note.strip()}"} and got[100] == {""}


def test_html_copies_of_an_article(spark):
    """Copies of one article with menus of their own: its paragraphs stay, a note without a telling name goes."""
    page = "<body><div><a>%d</a></div><article><h1>The title</h1><p>The same text</p><div class=x9>Only a note</div></article></body>"
    got = texts_of(spark, [(k, f"https://copies.example/{k}", page % k) for k in range(20)])
    assert all(got[k] == {"The title The same text"} for k in range(20))


def test_html_attributes(spark):
    """Names count as values of class and id alone, not on the page's whole, and a post's own header is no page header."""
    pages = [
        '<body class="no-sidebar"><article style="overflow:hidden" data-id="share"><div class="post-header"><h1>Title</h1></div><p>Text</p></article></body>',
        '<body><div class="site-header">Site</div><article id=comment-story><header><h2>Head</h2><span>by one</span></header><p title="a > b">Body</p><div class="newsletterBox">Subscribe</div></article></body>',
        '<body><main class="form"><p hidden>no</p><p aria-hidden="false">yes</p><div role=Navigation>nav</div></main><footer>foot</footer></body>',
        "<body><article><nav>only a menu</nav></article><p>The text is here</p></body>",
    ]
    got = texts_of(spark, [(k, f"https://s{k}.example/", p) for k, p in enumerate(pages)])
    assert [got[k] for k in range(4)] == [{"Title Text"}, {"Head Body"}, {"yes"}, {"The text is here"}]


WRAPPERS = ['div class="layout with-sidebar"', 'div class="has-sidebar content"', 'div id="page" class="no-sidebar"', 'div class="post comments-open"', 'div class="social-science"', 'div class="form-of-government"', 'div class="cookie-recipes"', 'section class="article-header-body"', 'div class="content-ad-free"']
OTHERS = ['div class="site-header"', 'div class="cookie-banner"', 'div id="sidebar-left"', 'ul class="comment-list"', 'div class="ad"', 'div class="adSlot3"', 'div class="newsletter-box"', 'div class="user-comments"', 'div class="share-links"', 'div class="post-comments"', 'div class="navBar"']


def test_html_names_of_wrappers(spark):
    """A name marks other content only where it names it: wrappers that tell of a state or of a topic keep their text."""
    from tracklake.llm.html_extract import extract_main_text

    rows = [(k, f"<body><{w}><p>The main text {k}.</p></{w.split()[0]}></body>") for k, w in enumerate(WRAPPERS)]
    rows += [(100 + k, f"<body><{w}><p>Other things</p></{w.split()[0]}><div><p>Kept {k}.</p></div></body>") for k, w in enumerate(OTHERS)]
    rows += [(200, "<main><article>A teaser</article><p>The main text, which is much longer than that.</p></main>"), (201, "<main><article>The article, which is long enough to be it.</article><p>Short.</p></main>")]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame([(k, f"https://h{k}.org/", h) for k, h in rows], "page_id int, url string, html string")).collect()}
    for k in range(len(WRAPPERS)):
        assert got[k] == f"The main text {k}.", WRAPPERS[k]
    for k in range(len(OTHERS)):
        assert got[100 + k] == f"Kept {k}.", OTHERS[k]
    assert got[200] == "A teaser The main text, which is much longer than that." and got[201] == "The article, which is long enough to be it."


def test_html_columns_and_long_pages(spark):
    from tracklake.llm.html_extract import extract_main_text

    names = ["host", "paths", "texts", "__host", "__texts", "text"]
    long = "<p>" + "word " * 200_000 + "</p>"
    d = spark.createDataFrame([(1, "https://x.example/", long, *names), (1, "https://x.example/", long, *names)], ["page_id", "url", "html", *names])
    rows = extract_main_text(d).collect()
    assert len(rows) == 2 and all(r.text == ("word " * 200_000).strip() and all(r[c] == c for c in names[:-1]) for r in rows)


def test_html_pages_table(spark):
    from tracklake.llm.queries import op5_main_text

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in op5_main_text(spark, SF).collect():
        inner = pages[r.page_id].split("<article>", 1)[1].rsplit("</article>", 1)[0]
        assert r.text == " ".join(html_lib.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in unique(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        rest = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def test_suffix_dedup(docs, rows, empty):
    from tracklake.llm.suffix_dedup import remove_repeats

    want = brute_repeats(rows)
    got = remove_repeats(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
    assert remove_repeats(empty).count() == 0


def test_suffix_array_blocks(spark):
    """Small blocks: an anchor's strings are looked up across blocks."""
    import numpy as np

    from tracklake.llm.suffix_dedup import common_prefixes, kept_strings, suffix_array

    rng = random.Random(3)
    data = "".join(rng.choice(["ab", "a", "abc"]) for _ in range(1500)).encode()
    parts = [data[k : k + rng.randint(1, 260)] for k in range(0, 2400, 70)]
    size = np.array([len(p) for p in parts])
    begin = np.r_[0, np.cumsum(size)[:-1]]
    buf, end = np.frombuffer(b"".join(parts), np.uint8), np.repeat(begin + size, size)
    order, _ = suffix_array(buf, end)
    suffixes = [bytes(buf[i : end[i]]) for i in order]
    assert suffixes == sorted(suffixes)
    lcp = common_prefixes(buf, order, begin, size)
    for k in range(1, len(order)):
        a, b = suffixes[k - 1], suffixes[k]
        assert lcp[order[k]] == next((j for j in range(min(len(a), len(b), 100)) if a[j] != b[j]), min(len(a), len(b), 100))
    base = bytes(rng.randrange(97, 123) for _ in range(140))
    fragments = [(9, base[: k % 30] + bytes([65 + k % 3]) + base[k % 30 + 1 :], k, 0, 0, 41) for k in range(60)]
    # The blocks are full after eight fragments: strings of 11 blocks of one anchor, then another anchor.
    other = bytes(rng.randrange(97, 123) for _ in range(140))
    fragments += [(10, other[:k] + bytes([50 + k]) + other[k + 1 :], 100 + k, 0, 0, 41) for k in range(5)]
    df = spark.createDataFrame(fragments, "h bigint, frag binary, d bigint, rid int, at int, n int").coalesce(1).sortWithinPartitions("h", "d", "at")
    got = {(r.d, k) for r in kept_strings(df, block=500).collect() for k in range(r.a, r.b)}
    seen, want = set(), set()
    for h, f, d, *_ in fragments:
        own = {((h, f[k : k + 100]), k) for k in range(41)}
        want |= {(d, k) for w, k in own if w not in seen}
        seen |= {w for w, _ in own}
    assert got == want
    # In blocks or in one: the binary search over earlier blocks gives what one suffix array gives.
    assert got == {(r.d, k) for r in kept_strings(df).collect() for k in range(r.a, r.b)}


def test_quality_rules(docs, rows, empty):
    from tracklake.llm.quality_rules import quality_rules

    got = {(r.doc_id, r.text): r for r in quality_rules(docs.drop("words")).collect()}
    for i, t, *_ in rows:
        r, t = got[i, t], t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules(empty.drop("words")).count() == 0


def test_quality_rules_repeats(spark):
    from tracklake.llm.quality_rules import quality_rules

    texts = ["a b c d e a b c d e", "a b c d e f a b c d e f", "a a a a a a", "x " * 12, "a b c d e q a b c d e", "$$$ the cat *** the dog"]
    want = [10, 12, 6, 12, 10, 0]
    got = {r.text: r.n_repeat_words for r in quality_rules(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert [got[t] for t in texts] == want


ITEM = "A train of Smith leaves at 9 and travels for 3 hours with a steady speed of 60 km each hour how far is it"


def test_decontaminate(spark, docs, rows, empty):
    from tracklake.llm.decontaminate import decontaminate, matched_items

    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, "two words"), (4, "Alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id bigint, text string")
    table = [
        (1, f"before it {ITEM} after it"),
        (2, "so " + ITEM.replace("9", "11").replace("60", "75").replace("Smith", "Jones").replace(" 3 ", " 5 ")),
        (3, "we saw a train leave at nine and nothing else of note on that day"),
        (4, None), (5, ""), (6, "alpha beta gamma"), (7, "x alpha beta gamma delta epsilon zeta eta theta iota kappa"), (7, "x alpha beta gamma delta epsilon zeta eta theta iota kappa"),
        (None, ITEM),
    ]
    d = spark.createDataFrame(table, "doc_id bigint, text string").withColumn("item_id", __import__("pyspark").sql.functions.lit(0))
    got = {(r.doc_id, r.item_id): r.leaked for r in matched_items(d, bench).collect()}
    assert got == {(1, 1): True, (2, 1): True, (7, 4): True, (None, 1): True}
    assert sorted(r.doc_id for r in decontaminate(d, bench).collect()) == [3, 4, 5, 6]
    assert decontaminate(docs, bench).count() == len(rows) and decontaminate(empty, bench).count() == 0
    assert decontaminate(d, bench.limit(0)).count() == len(table)


@pytest.mark.parametrize("bound", [0, 200_000])
def test_decontaminate_in_any_case(spark, monkeypatch, bound):
    from tracklake.llm import decontaminate as dc

    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", bound)
    item = "a small shop sells apples near the old river, and yesterday Maria Lopez bought seven of them for her mother before the rain began to fall"
    other = "entirely different words stand here about trains that leave the city at night and never come back to the same platform again"
    around = "Some other words come first. {} And then the document goes on as it likes."
    docs = [(1, item), (2, item.upper()), (3, item.title()), (4, item.lower()), (5, around.format(item.title())), (6, around.format(item.upper())), (7, other.title()), (8, around.format(other.upper())), (9, "John Paul George Ringo " * 20), (None, item.upper()), (2, other)]
    d = spark.createDataFrame([(k, t, "x", "y", "z") for k, t in docs], "doc_id int, text string, __bad string, gone string, __own string")
    b = spark.createDataFrame([(1, item)], "item_id int, text string")
    got = {r.doc_id for r in dc.matched_items(d, b).where("leaked").collect()}
    assert got == {1, 2, 3, 4, 5, 6, None}
    assert sorted(r.doc_id for r in dc.decontaminate(d, b).collect()) == [7, 8, 9] and dc.decontaminate(d, b).columns == d.columns


def test_columns_of_internal_names_stay(spark):
    """Input columns named as internal ones are passed on."""
    from tracklake.llm import minhash, quality_rules, sharding

    names = ["__gone", "__s", "__b", "__n", "__start", "__block", "__q_words", "__q_text"]
    text = " ".join(f"word{k}" for k in range(40))
    df = spark.createDataFrame([(k, text if k < 3 else f"other text number {k} of its own", *names) for k in range(6)], ["doc_id", "text", *names])
    kept = minhash.drop_near_duplicates(df)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5] and kept.columns == df.columns
    for out in (quality_rules.quality_rules(df), sharding.number_slots(df.withColumn("shard", df.doc_id % 2), "shard", ["doc_id"])):
        rows = out.collect()
        assert len(rows) == 6 and all(r[n] == n for r in rows for n in names)


def test_decontaminate_slots_must_agree(spark):
    """A conflicting value takes out the windows that hold it, not those of the same words."""
    from tracklake.llm.decontaminate import matched_items

    item = "from 7 apples take away 2 apples and then add those same 7 apples back to the basket again"
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    other = item.replace("7", "8", 1).replace("2", "3").replace("same 7 apples", "same 9 apples")
    d = spark.createDataFrame([(1, item.replace("7", "8")), (2, item.replace("7", "8", 1)), (3, other)], "doc_id bigint, text string")
    got = {r.doc_id: (r.leaked, r.n_conflicts > 0, r.n_windows) for r in matched_items(d, bench).collect()}
    assert got == {1: (True, False, 14), 2: (True, True, 12), 3: (True, True, 6)}


def test_decontaminate_by_shuffle(spark, monkeypatch):
    """Beyond the bound of the broadcast the rows are the same."""
    from tracklake.llm import decontaminate as dc
    from tracklake.llm.queries import op8_decontaminate

    want = sorted(op8_decontaminate(spark, SF).collect())
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", 0)
    assert want == sorted(op8_decontaminate(spark, SF).collect()) and want


def test_decontaminate_items_of_few_literals(spark):
    """Items whose windows are wholly or mostly numbers or names leak as copies."""
    from tracklake.llm.decontaminate import matched_items

    items = {1: "12 4 7 9 33 5 8 2 11 40", 2: "Alpha Beta Gamma Delta Epsilon Zeta Eta Theta", 3: "compute the sum of all these numbers now " + " ".join(str(k) for k in range(30))}
    bench = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    table = [(k, f"so we read: {t}, and then more") for k, t in items.items()]
    table += [(11, items[1].replace("40", "41")), (12, items[2].replace("Theta", "Iota")), (13, "compute the sum of all other numbers now")]
    got = {(r.doc_id, r.item_id): (r.n_windows, r.leaked) for r in matched_items(spark.createDataFrame(table, "doc_id bigint, text string"), bench).collect()}
    assert got == {(1, 1): (5, True), (2, 2): (3, True), (3, 3): (5, True)}


def test_toxicity(spark, docs, rows, empty):
    from tracklake.llm import toxicity as tox

    rng = random.Random(4)
    plain = lambda n: " ".join("".join(rng.choice("aeionst") for _ in range(rng.randint(2, 7))) for _ in range(n))
    texts, labels = [], []
    for k in range(200):
        bad = k % 4 == 0
        t = f"{plain(30)} you are a friend"
        if bad:
            t = f"{plain(10)} you are a {['blorgan', 'blorgent', 'zakk'][k // 4 % 3]} {plain(5)}."
        texts.append((k, t))
        labels.append((k, int(bad)))
    texts += [(900, None), (901, ""), (902, "here you blorgix.")]
    d, y = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    grammar = tox.fit(d, y.where(~tox.held_out()))
    assert any(e.startswith("blor") for e in grammar.lexicon), grammar.lexicon
    assert "zakk" in {e.rstrip("*") for e in grammar.lexicon}
    got = {r.doc_id: r.score for r in tox.toxicity(d, grammar).collect()}
    assert all((got[k] >= 0.7) == bool(v) for k, v in labels)
    assert got[900] == got[901] < 0.7 <= got[902]
    assert tox.toxicity(docs, grammar).count() == len(rows) and tox.toxicity(empty, grammar).count() == 0
    # Without labels of both kinds nothing is toxic.
    none = tox.fit(d, y.limit(0))
    assert all(r.score == 0.5 for r in tox.toxicity(d, none).collect())


def test_toxicity_contexts():
    from tracklake.llm.toxicity import KINDS, Lexer

    lexer = Lexer(("moron", "blor*"))
    kind = lambda t: {k for k, n in zip(KINDS, lexer.clauses(t), strict=True) if n}
    cases = {
        "what a moron. fine": "plain", "You absolute blorxx": "targeted", "what a moron you are": "targeted", "moron, you": "targeted", "he is not a moron": "negated", "a moron he is not": "negated",
        "someone said moron": "reported", "moron, he said": "reported", "he wrote: moron": "reported", "he wrote: fine. moron": "plain",
        "i will kill you": "threat", "you i will kill": "", "ich werde dich töten": "threat", "je vais te tuer": "threat", "voy a matarte": "threat", "ich bringe dich um": "threat", "you're dead": "threat",
        "burn them": "", "i will not kill you": "negated", "he said he will hurt you": "reported", "kill weeds in spring": "", "you kill": "", "die burn": "", "": "", "nothing here": "",
    }
    for text, want in cases.items():
        assert kind(text) == ({want} if want else set()), text
    assert kind("you moron i will kill you") == {"targeted", "threat"}
    assert lexer.clauses("moron. moron! you moron") == [2, 1, 0, 0, 0]


def test_toxicity_threats_are_meant():
    """Threats in frames of intent or desert with a person as object, and sentences that only have the words."""
    from tracklake.llm.toxicity import KINDS, Lexer

    lexer = Lexer(("moron",))
    threat = lambda t: lexer.clauses(t)[KINDS.index("threat")] > 0
    for t in [
        "I am going to kill your family", "You people deserve to be shot", "I hope somebody stabs you", "someone should shoot him", "we'll burn you alive", "I'm gonna hurt you", "you deserve to die", "i want to strangle her", "they deserve to be hanged.",
        "ich will dich töten", "ich werde ihn umbringen", "je veux te tuer", "quiero matarte", "voy a golpear a tu madre", "mereces morir", "watch your back",
    ]:
        assert threat(t), t
    for t in [
        "Hang them on the wall.", "Shoot us an email if you have questions.", "The film is about an attempt to kill him.", "I will kill the process and restart it.", "You can burn the disc.", "Who will kill the lights? You?", "They hang out with you.",
        "This may hurt you a little", "I will hang the picture for you", "the stain will burn off, trust her", "you deserve a break", "matar el tiempo contigo", "Die Sonne wird dich nicht töten", "we should shoot the video", "i hope you like it. burn the candle",
    ]:
        assert not threat(t), t


def test_toxicity_automaton():
    """The table of the context transducer against the rules said clause by clause, for every string of symbols up to five."""
    import itertools

    from tracklake.llm import toxicity as tox

    def kinds(clause, carried):
        def open_(symbols):
            hits = [k for k, s in enumerate(clause) if s in symbols]
            return hits, any(tox.NEGATION not in clause[max(0, k - tox.REACH) : k] for k in hits) and clause[-1] != tox.NEGATION

        report = carried or tox.REPORT in clause
        out = set()
        hits, free = open_((tox.INSULT,))
        if hits:
            out.add("negated" if not free else "reported" if report else "targeted" if {tox.TARGET, tox.OBJECT} & set(clause) else "plain")
        hits, free = open_((tox.THREAT, tox.HARM))
        if hits and {tox.OBJECT, tox.HARM} & set(clause):
            out.add("negated" if not free else "reported" if report else "threat")
        return out

    for n in range(6):
        for string in itertools.product(range(10), repeat=n):
            want, clause, carried = collections.Counter(), [], False
            for s in [*string, tox.END]:
                if s < tox.END:
                    clause.append(s)
                    continue
                want.update(kinds(clause, carried) if clause else ())
                carried, clause = s == tox.COLON and (carried or tox.REPORT in clause), []
            got, state = collections.Counter(), 0
            for s in [*string, tox.END]:
                if s >= tox.END:
                    got.update(tox.KINDS[k] for k in tox._OUT[state])
                state = tox._TO[state][s]
            assert got == want, string


def test_toxicity_columns(spark):
    from tracklake.llm import toxicity as tox

    names = ["y", "t", "__k", "clauses", "score"]
    d = spark.createDataFrame([(k, f"text {k} blorgan" if k % 2 else f"text {k} fine", *names) for k in range(40)], ["doc_id", "text", *names])
    y = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id bigint, toxic int")
    rows = tox.toxicity(d, tox.fit(d, y)).collect()
    assert all((r.score > 0.5) == bool(r.doc_id % 2) and r.y == "y" and r.t == "t" for r in rows) and len(rows) == 40


def test_held_out_scores(spark):
    from tracklake.llm.queries import op9_toxicity

    y = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in op9_toxicity(spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in y]
    # A tenth of these labels is wrong at random; 113 rows.
    assert sum(r.predicted == y[r.doc_id] for r in rows) >= 0.9 * len(rows)
    assert sum(r.predicted > y[r.doc_id] for r in rows) <= 0.02 * len(rows)


def test_sharding_query(spark):
    """Every column of every row against the law: the hash of the key, the shard and the seed, step by step."""
    import hashlib
    import math
    import zlib

    from tracklake.llm.queries import op10_sharding

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    draw = lambda digits, *parts: int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:digits], 16)

    def shard(key, n):
        return max((-1 / math.log((draw(12, 0, i, key) + 0.5) / 2.0**48), i) for i in range(n))[1]

    got = {r.doc_id: r for r in op10_sharding(spark, SF).collect()}
    assert set(got) == set(texts)
    blocks = collections.defaultdict(list)
    for k, t in texts.items():
        size, crc = len(t.encode()) + 1, zlib.crc32(t.encode())
        r = got[k]
        assert (r.size, r.text_crc32, r.law, r.shard, r.grown_shard) == (size, crc, "key", shard(k, 8), shard(k, 9)), k
        blocks[r.shard].append((draw(8, k, size, crc) % 1024, k))
    assert all([got[k].slot for _, k in sorted(b)] == list(range(len(b))) for b in blocks.values())


def test_sharding(spark, docs, rows, empty):
    from pyspark.sql import functions as F

    from tracklake.llm.sharding import assign_shards, number_slots

    d = spark.range(4000).select(F.col("id").alias("doc_id"))
    both = assign_shards(assign_shards(d), weights=(1.0,) * 9, to="grown").collect()
    assert all(r.grown in (r.shard, 8) for r in both)
    assert all(350 < n < 650 for n in collections.Counter(r.shard for r in both).values())
    heavy = collections.Counter(r.shard for r in assign_shards(d, weights=(1.0, 3.0)).collect())
    assert 2.6 < heavy[1] / heavy[0] < 3.4
    slots = collections.defaultdict(list)
    for r in number_slots(assign_shards(docs), "shard", ["doc_id", "text"]).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == len(rows)
    assert number_slots(assign_shards(empty), "shard", ["doc_id"]).count() == 0


def test_pipeline(spark, rows):
    """The stages over a small folder of tables, against the brute-force versions."""
    import tempfile

    import corpus_pipeline as p

    folder = tempfile.mkdtemp()
    some = [(i, t, "en", "s", len(t or "")) for i, t, *_ in rows]
    spark.createDataFrame(some, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    leak = next(t for i, t, *_ in rows if i == 11)
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in p.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == p.COLUMNS, name
        if name in ("toxicity", "line_dedup"):
            assert out.count() == docs.count()
        docs = spark.createDataFrame(out.collect(), out.schema)
        if name == "near_dedup":
            want = brute_classes([(r.doc_id, r.text) for r in docs.collect()])
            assert all(k == v for k, v in want.items())
    assert 11 not in {r.doc_id for r in docs.collect()}
    result = p.run(spark, folder).collect()
    assert sorted(r.doc_id for r in result if r.doc_id is not None) == sorted(r.doc_id for r in docs.collect() if r.doc_id is not None)
    assert all(r.round_trip for r in result)
