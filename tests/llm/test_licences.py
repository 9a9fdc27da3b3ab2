import math
import re
from collections import Counter

from mnemospark.llm import licences
from tests.llm.helpers import empty_frame, odd_frame

MIT, APACHE, GPL = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."
FILES = [
    ("LICENSE", MIT + "\n\nnot more than that"), ("a/b/x.py", "nothing here"), ("a/b/c/y.py", f"some words\n{APACHE}\nand more words of all kinds that follow on it"),
    ("a/COPYING.txt", GPL), ("a/b/c/d/z.py", None), ("q/only.py", ""), ("a/b/c/LICENSE-APACHE", APACHE), ("a/b/c/LICENSE-GPL", GPL), ("top.py", "x"),
    ("a/b/x.py", "nothing here"), (None, "copyright of nobody, licensed to none"), ("w/copyright.txt", "Copyright the licence of something else altogether, whatever it may be"),
]


def brute(files):
    docs = [re.findall("[a-z0-9]+", (t or "").lower()) for _, t in files]
    templates = licences.template_terms()
    weight = lambda t: math.log((len(docs) + 1) / (sum(t in d for d in docs) + 1)) + 1 if any(t in c for c in templates) else 1.0
    out = []
    for (path, text), words in zip(files, docs):
        by_name = bool(re.search(licences.LICENCE_FILE, (path or "").lower()))
        lines = [text or ""] if by_name else [s for s in (text or "").split("\n") if re.search(licences.CUE, s.lower())]
        found, covered = [], 0
        for line in lines:
            c = Counter(re.findall("[a-z0-9]+", line.lower()))
            norm = math.sqrt(sum((n * weight(t)) ** 2 for t, n in c.items()))
            scores = []
            for (name, _), other in zip(licences.NOTICES, templates):
                length = math.sqrt(sum((n * weight(t)) ** 2 for t, n in other.items()))
                scores.append((-round(sum(c[t] * n * weight(t) ** 2 for t, n in other.items()) / length / norm, 6) if c else 0, name))
            if c and -min(scores)[0] >= licences.LEAST_COSINE:
                found.append(min(scores))
                covered += sum(c.values())
        own = min(found, default=(None, None))
        out.append([path, own[1], own[0] and -own[0], bool(found) and (by_name or covered / len(words) >= licences.LEAST_COVER)])
    speaks = {}
    for path, name, cosine, is_file in out:
        if is_file and path is not None:
            key = path.rpartition("/")[0]
            speaks[key] = min(speaks.get(key, (0, "~")), (-cosine, name))
    result = []
    for path, name, cosine, _ in out:
        origin, source = ("own", None) if name else ("none", None)
        if not name and path is not None:
            up = path.rpartition("/")[0]
            while True:
                if up in speaks:
                    name, origin, source = speaks[up][1], "inherited", up
                    break
                if not up:
                    break
                up = up.rpartition("/")[0]
        result.append((path, name, cosine, origin, source))
    return result


def test_files_against_brute_force(spark):
    frame = spark.createDataFrame([(p, t, "x", "y", 1) for p, t in FILES], "path string, text string, dir string, licence string, best int")
    got = [tuple(r) for r in licences.licences(frame, []).select("path", "licence", "cosine", "origin", "from_dir").collect()]
    order = lambda r: tuple(str(x) for x in r)
    want = sorted(brute(FILES), key=order)
    assert sorted(got, key=order) == want
    origins = {r[0]: (r[1], r[3], r[4]) for r in want}
    assert origins["a/b/x.py"] == ("GPL-3.0", "inherited", "a") and origins["top.py"] == ("MIT", "inherited", "")
    assert origins["a/b/c/d/z.py"][1:] == ("inherited", "a/b/c") and origins["q/only.py"][2] == ""


def test_odd_documents_and_none(spark):
    frame, rows = odd_frame(spark)
    docs = frame.drop("start").selectExpr("*", "cast(null as string) source", "'en' lang")
    got = licences.licences(licences.document_files(docs), ["doc_id"])
    assert got.count() == len(rows) and got.where("origin != 'none'").count() == 0
    assert licences.licences(licences.document_files(empty_frame(spark)), ["doc_id"]).count() == 0


def test_every_template_finds_itself(spark):
    rows = [(f"d{k}/f.txt", f"filler words\n{text}\nmore filler words") for k, (_, text) in enumerate(licences.NOTICES)]
    got = {r.path: r.licence for r in licences.licences(spark.createDataFrame(rows, "path string, text string"), []).collect()}
    marked = {f"d{k}/f.txt": name for k, (name, text) in enumerate(licences.NOTICES) if re.search(licences.CUE, text.lower())}
    assert {p: got[p] for p in marked} == marked


GPL_HEADER = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
MIT_FULL = """MIT License

Copyright (c) 2020 Some Body

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
LGPL_HEAD = "GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n" + "Everyone may copy this document word for word.\n" * 60


def test_wrapped_headers_and_full_texts(spark):
    code = "\n\nimport os\nprint(os.name)\n" * 20
    narrow = "Permission is\nhereby granted, free\nof charge, to any\nperson obtaining a\ncopy of this software\nand associated\ndocumentation files\n" + code
    files = [("g/x.py", GPL_HEADER + code), ("m/LICENSE", MIT_FULL), ("m/y.py", "x = 1"), ("n/z.py", narrow), ("l/COPYING", LGPL_HEAD), ("l/w.py", "y = 2"), ("f/a.py", "words of no kind")] + [(f"f/{k}.py", f"plain text {k}") for k in range(20)]
    frame = spark.createDataFrame(files, "path string, text string")
    got = {r.path: (r.licence, r.origin) for r in licences.licences(frame, [], windows=True).collect()}
    assert len(got) == len(files)
    assert got["g/x.py"] == ("GPL-3.0", "own") and got["n/z.py"] == ("MIT", "own")
    assert got["m/LICENSE"] == ("MIT", "own") and got["m/y.py"] == ("MIT", "inherited")
    assert got["l/COPYING"] == ("LGPL-3.0", "own") and got["l/w.py"] == ("LGPL-3.0", "inherited")
    assert got["f/a.py"] == (None, "none")


def brute_windows(files):
    """(licence, cosine) of each file without a licence file's name, from all windows of lines that hold a cue."""
    docs = [re.findall("[a-z0-9]+", (t or "").lower()) for _, t in files]
    idf = lambda t: math.log((len(docs) + 1) / (sum(t in d for d in docs) + 1)) + 1
    out = {}
    for path, text in files:
        lines, found = (text or "").lower().split("\n"), []
        for a in range(len(lines)):
            for b in range(a + 1, min(len(lines), a + licences.MOST_LINES) + 1):
                if any(re.search(licences.CUE, s) for s in lines[a:b]):
                    c = Counter(re.findall("[a-z0-9]+", "\n".join(lines[a:b])))
                    norm = math.sqrt(sum((n * idf(t)) ** 2 for t, n in c.items()))
                    for (name, _), other in zip(licences.NOTICES, licences.template_terms()):
                        length = math.sqrt(sum((n * idf(t)) ** 2 for t, n in other.items()))
                        found.append((-round(sum(c[t] * n * idf(t) ** 2 for t, n in other.items()) / length / norm, 6), name))
        minus, name = min(found, default=(0, None))
        out[path] = (name, -minus) if -minus >= licences.LEAST_COSINE else (None, None)
    return out


def test_rare_terms_weigh_in_the_norm(spark):
    ecl = "Licensed under the Educational Community License, Version 2.0."
    files = [("e/x.py", ecl), ("a/x.py", f"{APACHE}\nsome code"), ("g/x.py", GPL_HEADER), ("m/x.py", f"one\n{MIT}\ntwo")]
    files += [(f"n/{k}.py", "the version of this is 2 0 and under that") for k in range(300)] + [(f"p/{k}.py", APACHE) for k in range(40)] + [(f"z/{k}.py", None) for k in range(9)]
    rows = licences.licences(spark.createDataFrame(files, "path string, text string"), [], windows=True).collect()
    got = {r.path: (r.licence if r.origin == "own" else None, r.cosine) for r in rows}
    assert got["e/x.py"] == (None, None) and got["a/x.py"] == ("Apache-2.0", 1.0)
    want = brute_windows(files)
    assert {p: v[0] for p, v in got.items()} == {p: v[0] for p, v in want.items()}
    assert all(abs((got[p][1] or 0) - (want[p][1] or 0)) <= 1e-6 for p in want)


def test_whole_texts_and_identifiers(spark):
    """Every kind of template by the kind of file it is for; an identifier that is not listed is no licence."""
    code = "\n\ndef run(x):\n    return x\n" * 10
    wrap = lambda text: "\n".join(text[k : k + 70] for k in range(0, len(text), 70))
    files = [(f"w{k}/LICENSE", f"Copyright (c) 2021 Some One and others\n\n{wrap(text)}\n") for k, (_, text) in enumerate(licences.WHOLE)] + [(f"w{k}/a/b.py", "y = 1") for k in range(len(licences.WHOLE))]
    files += [(f"s{k}/x.py", f"# SPDX-License-Identifier: {name}\n{code}") for k, (_, name) in enumerate(licences.IDENTIFIERS)] + [("t/x.py", "// SPDX-License-Identifier: EPL-2.0\n" + code), ("t/y.py", "// spdx-license-identifier:mit\n" + code)]
    files += [(f"p/{k}.py", "plain version of this software is granted in all copies to the license" if k % 2 else code) for k in range(60)]
    got = {r.path: (r.licence, r.origin) for r in licences.licences(spark.createDataFrame(files, "path string, text string"), [], windows=True).collect()}
    for k, (name, _) in enumerate(licences.WHOLE):
        assert got[f"w{k}/LICENSE"] == (name, "own") and got[f"w{k}/a/b.py"] == (name, "inherited")
    for k, (name, _) in enumerate(licences.IDENTIFIERS):
        assert got[f"s{k}/x.py"] == (name, "own")
    assert got["t/x.py"] == (None, "none") and got["t/y.py"] == ("MIT", "own")
