"""License scans: sparse TF-IDF cosine to templates, then inheritance down directories.

Headers are sentences of a text, whether its lines are broken or wrapped; files
are whole texts, or passages of a template's length in longer ones. Each is
compared with templates over its terms, whose weights come from document frequencies in all
texts. Documents without an own license take that of the nearest directory
above them that holds a license file.
"""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.decontaminate import tokens
from lodestream.llm.license_texts import TEXTS
from lodestream.llm.shared import materialise, ship
from lodestream.llm.shingles import chunks, text_buffers

# Usual notices of each license, a sentence each.
HEADERS = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU GPL v3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU GPL v2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license.", "Licensed under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under the CC0 1.0 Universal public domain dedication."],
    "Proprietary": ["All rights reserved."],
}
#: Whole license files. AGPL-3.0, CC-BY-SA-4.0 and CC-BY-NC-4.0 are known by their headers only.
FILES = TEXTS
#: Passages of a template's length start at each of so many shares of it.
HOPS = 16

HEADER_COSINE, FILE_COSINE = 0.8, 0.6
SCANNED = "id bigint, path string, header_license string, header_cosine double, file_license string, file_cosine double"


def _terms(text: str) -> list[int]:
    raw = np.frombuffer(text.encode(), np.uint8)
    return tokens(raw, np.array([0, len(raw)]))[1].tolist()


class Templates:
    """Templates as sparse weighted vectors, given the document frequency of their terms in ``n`` documents."""

    def __init__(self, headers=None, files=None):
        self.headers = [(k, Counter(_terms(t))) for k, texts in sorted((headers or HEADERS).items()) for t in texts]
        self.files = [(k, Counter(_terms(t))) for k, t in sorted((files or FILES).items())]
        self.vocabulary = np.array(sorted({t for _, c in self.headers + self.files for t in c}), np.uint64)

    def weigh(self, df: dict[int, int], n: int) -> None:
        self.idf = {int(t): math.log((1 + n) / (1 + df.get(int(t), 0))) + 1 for t in self.vocabulary}
        self.rare = math.log(1 + n) + 1  # of a term in no template: as of one in no document
        norm = lambda c, keep: math.sqrt(sum((x * self.idf[t]) ** 2 for t, x in c.items() if keep(t)))
        self.header_norms, self.file_norms = ([norm(c, lambda _: True) for _, c in part] for part in (self.headers, self.files))
        # A text that shares only other terms with a template has at most their share of
        # its norm as cosine; telling terms are added until that is below the threshold.
        self.telling: set[int] = set()
        parts = [(c, norm, (least * norm) ** 2) for part, norms, least in ((self.headers, self.header_norms, HEADER_COSINE), (self.files, self.file_norms, FILE_COSINE)) for (_, c), norm in zip(part, norms)]
        left = [norm**2 for _, norm, _ in parts]
        for term in sorted(self.idf, key=lambda t: (-self.idf[t], t)):
            # a hair below, as what is left is a running difference
            if all(x < least - 1e-9 * norm**2 for x, (_, norm, least) in zip(left, parts)):
                break
            self.telling.add(term)
            left = [x - (c.get(term, 0) * self.idf[term]) ** 2 for x, (c, *_) in zip(left, parts)]
        # by place in the vocabulary, the last for any other term
        self.squares = np.array([self.idf[int(t)] ** 2 for t in self.vocabulary] + [self.rare**2])
        self.products = np.array([[c.get(int(t), 0) * self.idf[int(t)] ** 2 / norm for t in self.vocabulary] + [0.0] for (_, c), norm in zip(self.files, self.file_norms)])
        self.lengths = [sum(c.values()) for _, c in self.files]

    def best_file(self, words: np.ndarray) -> tuple[str | None, float]:
        """The best match of a whole text; if there is none, that of a passage."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        at = np.where(self.vocabulary[at] == words, at, len(self.vocabulary))
        square = self.squares[at]
        _, first, n = np.unique(words, return_index=True, return_counts=True)
        own = math.sqrt((n.astype(float) ** 2 * square[first]).sum())
        dots = np.array([p[at].sum() for p in self.products])
        if (dots >= (FILE_COSINE - 1e-6) * own).any():
            found = self.best(Counter(words.tolist()), True)
            if found[0]:
                return found
        name, top = None, 0.0
        sums = np.r_[0, np.cumsum(square)]
        for k, (p, size) in enumerate(zip(self.products, self.lengths)):
            if size >= len(words):
                continue
            starts = np.unique(np.r_[np.arange(0, len(words) - size, max(1, size // HOPS)), len(words) - size])
            dot = np.r_[0, np.cumsum(p[at])]
            # a passage's norm is at least that of as many terms that differ
            bound = (dot[starts + size] - dot[starts]) / np.sqrt(sums[starts + size] - sums[starts])
            for i in starts[np.argsort(-bound, kind="stable")][: int((bound >= FILE_COSINE - 1e-6).sum())].tolist():
                if (dot[i + size] - dot[i]) / math.sqrt(sums[i + size] - sums[i]) < top - 1e-6:
                    break
                found = self.cosine(Counter(words[i : i + size].tolist()), k)
                if found >= FILE_COSINE and found > top:
                    name, top = self.files[k][0], found
        return name, top

    def cosine(self, counts: Counter, k: int) -> float:
        own = math.sqrt(sum((x * self.idf.get(t, self.rare)) ** 2 for t, x in counts.items()))
        return round(sum(x * counts[t] * self.idf[t] ** 2 for t, x in self.files[k][1].items() if t in counts) / own / self.file_norms[k], 12)

    def best(self, counts: Counter, files: bool) -> tuple[str | None, float]:
        """The template of largest cosine if that reaches the threshold; of equals the first by name."""
        own = math.sqrt(sum((x * self.idf.get(t, self.rare)) ** 2 for t, x in counts.items()))
        name, top = None, 0.0
        for (k, c), norm in zip(*((self.files, self.file_norms) if files else (self.headers, self.header_norms))):
            dot = sum(x * counts[t] * self.idf[t] ** 2 for t, x in c.items() if t in counts)
            if dot and round(dot / own / norm, 12) > top:
                name, top = k, round(dot / own / norm, 12)
        return (name, top) if top >= (FILE_COSINE if files else HEADER_COSINE) else (None, 0.0)


def sentence_starts(part: np.ndarray, wrapped: bool = False) -> np.ndarray:
    """Running number of the sentence at each byte: a line break ends one, and so does . ! or ? before white space.

    If lines are ``wrapped``, their breaks are white space.
    """
    ends = (part == 10) & (not wrapped)
    stops = np.isin(part, [33, 46, 63])
    if len(part) > 1:
        ends[1:] |= stops[:-1] & np.isin(part[1:], [32, 9, 10, 13])
    return np.cumsum(ends)


def frequencies(docs: DataFrame, templates: Templates, text_col: str = "text") -> tuple[dict[int, int], int]:
    """In how many documents each template term is, and the number of documents."""
    vocabulary = templates.vocabulary

    def count(batches):
        df, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            raw, offsets = text_buffers(batch.column("body"))
            for lo, hi in chunks(offsets):
                row, value, *_ = tokens(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                at = np.minimum(np.searchsorted(vocabulary, value), len(vocabulary) - 1)
                hit = vocabulary[at] == value
                seen = np.unique(row[hit] * len(vocabulary) + at[hit])
                df += np.bincount(seen % len(vocabulary), minlength=len(vocabulary))
            n += batch.num_rows
        yield pa.record_batch([pa.array([*range(len(df)), -1], pa.int32()), pa.array([*df.tolist(), n], pa.int64())], ["term", "n"])

    body = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    found = {r["term"]: r["n"] for r in body.mapInArrow(count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return {int(t): found.get(i, 0) for i, t in enumerate(vocabulary)}, found.get(-1, 0)


def match_texts(docs: DataFrame, path: Column, templates: Templates, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, path, header_license, header_cosine, file_license, file_cosine) of each row; null and 0 without a match."""
    telling = np.array(sorted(templates.telling), np.uint64)

    def match(batches):
        for batch in batches:
            raw, offsets = text_buffers(batch.column("body"))
            header, whole = [(None, 0.0)] * batch.num_rows, [(None, 0.0)] * batch.num_rows
            for lo, hi in chunks(offsets):
                part = raw[offsets[lo] : offsets[hi]]
                bounds = offsets[lo : hi + 1] - offsets[lo]
                row, value, place = tokens(part, bounds, places=True)
                if not len(value):
                    continue
                lines = np.r_[0, np.cumsum(part == 10)][place]
                broken = sentence_starts(part)[place]
                # in wrapped lines, one without a word ends a sentence
                joined = sentence_starts(part, True)[place] + np.cumsum(np.r_[0, np.diff(lines) > 1])
                at = np.minimum(np.searchsorted(telling, value), len(telling) - 1)
                for r in np.unique(row[telling[at] == value]).tolist():
                    a, b = np.searchsorted(row, [r, r + 1])
                    words, told = value[a:b], telling[at[a:b]] == value[a:b]
                    best = (None, 0.0)
                    for mine in (broken[a:b], joined[a:b]):
                        if best[0]:
                            break  # lines are joined only if none has a header by itself
                        for s in np.unique(mine[told]).tolist():
                            lo_s, hi_s = np.searchsorted(mine, [s, s + 1])
                            found = templates.best(Counter(words[lo_s:hi_s].tolist()), False)
                            best = found if found[1] > best[1] else best
                    header[lo + r] = best
                    whole[lo + r] = templates.best_file(words)
            cols = [pa.array(x, t) for x, t in zip([*zip(*header), *zip(*whole)], (pa.string(), pa.float64()) * 2)]
            yield pa.record_batch([batch.column("id"), batch.column("path"), *cols], ["id", "path", "header_license", "header_cosine", "file_license", "file_cosine"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), path.alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    return rows.mapInArrow(match, SCANNED)


def parent(path: Column) -> Column:
    """The directory of a path, "/" at the top; null for a null path."""
    return F.when(path.isNotNull(), F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(path, "^/+", ""), "/?[^/]*/*$", "")))


def inherit(scanned: DataFrame) -> DataFrame:
    """Adds ``license`` and ``origin`` (header, file, inherited or none).

    Only distinct directories are joined to their ancestors, so the rows of a
    large directory aren't multiplied by its depth. A directory with several
    license files has that of largest cosine, then first name. A null path
    inherits nothing.
    """
    rows = scanned.withColumn("__dir", parent(F.col("path")))
    held = (
        rows.where("file_license is not null and __dir is not null")
        .groupBy(F.col("__dir").alias("above"))
        .agg(F.min(F.struct(-F.col("file_cosine"), "file_license")).alias("s"))
        .select("above", F.col("s.file_license").alias("taken"))
    )
    parts = F.filter(F.split("__dir", "/"), lambda x: x != "")
    chain = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")).alias("above")))
    dirs = rows.where("header_license is null and file_license is null and __dir is not null").select("__dir").distinct()
    above = dirs.select("__dir", F.explode(chain).alias("c")).select("__dir", "c.depth", "c.above")
    nearest = above.join(held, "above").groupBy("__dir").agg(F.max(F.struct("depth", "taken")).alias("s")).select("__dir", F.col("s.taken").alias("taken"))
    out = rows.join(nearest, "__dir", "left")
    own = F.coalesce("file_license", "header_license")
    origin = F.when(F.col("file_license").isNotNull(), "file").when(F.col("header_license").isNotNull(), "header").when(F.col("taken").isNotNull(), "inherited").otherwise("none")
    return out.select(*scanned.columns, F.coalesce(own, "taken").alias("license"), origin.alias("origin"))


def scan_licenses(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", templates: Templates | None = None) -> DataFrame:
    """A row for each of ``docs``: id, path, the best header and file matches, license and origin.

    Null and empty texts match nothing but may inherit; repeated rows are kept;
    an empty table gives an empty one. Frequencies are over all rows.
    """
    ship(docs.sparkSession)
    templates = templates or Templates()
    templates.weigh(*frequencies(docs, templates, text_col))
    return inherit(materialise(match_texts(docs, path, templates, id_col, text_col), "licenses")).withColumnRenamed("id", id_col)
