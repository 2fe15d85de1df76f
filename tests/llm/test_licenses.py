import math
import os
import re
from collections import Counter

from pyspark.sql import functions as F

from lodestream.llm.licenses import FILES, HEADERS, scan_licenses
from lodestream.llm.registry import QUERIES

WORD = re.compile(r"(?:[^\W_]|(?<=\d)[.,](?=\d))+")


def terms(text):
    return Counter(WORD.findall(text.lower()))


def brute(rows):
    """Every sentence against every header, every text against every file."""
    headers = [(k, terms(t)) for k, v in sorted(HEADERS.items()) for t in v]
    files = [(k, terms(t)) for k, t in sorted(FILES.items())]
    n, vocabulary = len(rows), {t for _, c in headers + files for t in c}
    df = Counter(t for _, _, x in rows for t in set(terms(x or "")) & vocabulary)
    w = lambda t: math.log((1 + n) / (1 + df[t])) + 1 if t in vocabulary else math.log(1 + n) + 1
    norm = lambda c: math.sqrt(sum((x * w(t)) ** 2 for t, x in c.items()))
    cosine = lambda a, b: sum(x * b[t] * w(t) ** 2 for t, x in a.items()) / norm(a) / norm(b) if a and b else 0
    out = []
    for i, path, x in rows:
        own = [terms(s) for s in re.split(r"\n|(?<=[.!?])(?=[ \t\r])", x or "")]
        h = max(((cosine(s, c), k) for s in own for k, c in headers), default=(0, None))[0]
        f = max(((cosine(terms(x or ""), c), k) for k, c in files), default=(0, None))[0]
        out.append((i, round(h, 9) if h >= 0.8 else 0.0, round(f, 9) if f >= 0.6 else 0.0))
    return out


ROWS = [
    (1, "/a/LICENSE", FILES["MIT"]), (2, "/a/b/c/x.txt", "plain words only"), (3, "/a/b/LICENSE", FILES["GPL-3.0"]), (4, "/a/b/c/d/y.txt", "more plain words"),
    (5, "/a/z.txt", "text before.\nLicensed under the Apache License, Version 2.0. And text after it."), (6, "/q/w.txt", None), (7, "/a/e.txt", ""),
    (8, None, "no path"), (None, "/a/b/n.txt", "no id"), (9, "/a//", "odd path"), (10, "/a/b/LICENSE2", FILES["MIT"] + " and"), (2, "/a/b/c/x.txt", "plain words only"),
    (11, "/x", "Licensed under CC BY-NC 4.0."), (12, "/x", "licensed under the mit license\nAll rights reserved"), (13, "/y", "the of and under " * 50_000),
]


def test_matches_and_inheritance(spark):
    frame = spark.createDataFrame(ROWS, "doc_id bigint, p string, text string").withColumns({"path": F.lit(1), "license": F.lit("x"), "id": F.lit(3)})
    rows = scan_licenses(frame, F.col("p")).collect()
    key = lambda r: (str(r[0]), *map(str, r[1:]))
    assert sorted(((r["doc_id"], round(r["header_cosine"], 9), round(r["file_cosine"], 9)) for r in rows), key=key) == sorted(brute(ROWS), key=key)
    got = {(r["doc_id"], r["path"]): (r["license"], r["origin"]) for r in rows}
    assert len(rows) == len(ROWS)
    assert got[1, "/a/LICENSE"] == ("MIT", "file") and got[2, "/a/b/c/x.txt"] == ("GPL-3.0", "inherited") and got[4, "/a/b/c/d/y.txt"] == ("GPL-3.0", "inherited")
    assert got[5, "/a/z.txt"] == ("Apache-2.0", "header") and got[6, "/q/w.txt"] == (None, "none") and got[7, "/a/e.txt"] == ("MIT", "inherited")
    assert got[8, None] == (None, "none") and got[None, "/a/b/n.txt"] == ("GPL-3.0", "inherited") and got[11, "/x"] == ("CC-BY-NC-4.0", "header")
    assert scan_licenses(frame.limit(0), F.col("p")).count() == 0


def test_query(spark, sf_dir="/root/testdata/sf0.01"):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text").collect()]
    rows = {r["doc_id"]: r for r in QUERIES["op10_license_scan"](spark, sf_dir).collect()}
    assert sorted((i, round(r["header_cosine"], 9), round(r["file_cosine"], 9)) for i, r in rows.items()) == sorted(brute(docs))
    for i, _, text in docs:
        for name, line in (("MIT", "Released under the MIT License."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.")):
            if line in text:
                assert rows[i]["header_license"] == name


def test_whole_files_passages_and_wrapped_headers(spark):
    """Texts of the system's license files, where it has them, alone and in longer documents."""
    kept = {"Apache-2.0": "Apache-2.0", "BSD-3-Clause": "BSD", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}
    texts = {k: open(f"/usr/share/common-licenses/{f}", encoding="utf8").read() if os.path.exists(f"/usr/share/common-licenses/{f}") else FILES[k] for k, f in kept.items()}
    texts["MIT"] = FILES["MIT"].replace("<year> <copyright holders>", "2019 Some One")
    around = " ".join(f"{w} {i}" for i in range(4000) for w in ("plain", "words", "about", "the", "weather"))
    header = '# Copyright 2020\n#\n# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy\n'
    gpl = "/*\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */"
    rows = [(k, text) for k, text in texts.items()] + [("in " + k, around + "\n" + text + "\n" + around) for k, text in texts.items()] + [("apache", header), ("gpl", gpl), ("none", around)]
    rows += [(f"pad{i}", "the and of to in a plain page of words that is no license") for i in range(200)]
    frame = spark.createDataFrame([(i, k, x) for i, (k, x) in enumerate(rows)], "doc_id bigint, p string, text string")
    got = {r["path"]: r for r in scan_licenses(frame, F.concat(F.lit("/"), "p")).collect()}
    for k in texts:
        assert got[f"/{k}"]["file_license"] == k and got[f"/in {k}"]["file_license"] == k, (k, got[f"/{k}"], got[f"/in {k}"])
    assert got["/apache"]["header_license"] == "Apache-2.0" and got["/gpl"]["header_license"] == "GPL-3.0"
    assert got["/none"]["file_license"] is None and got["/none"]["header_license"] is None
