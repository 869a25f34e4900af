"""Licence scans: headers and licence files against templates, then inheritance down the directories."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from prismlake.llm._shared import materialize, utf8_rows, words

# Notices as licensors publish them and titles of licence texts, by SPDX identifier.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0 Universal.", "The person who associated a work with this deed has dedicated the work to the public domain"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: Licences whose text holds another one's whole text and more.
HOLDS = {"BSD-3-Clause": "BSD-2-Clause"}
#: Cosine from which a passage is a notice, and share of a text's words from which the text is a licence file.
LEAST, FILE_SHARE = 0.75, 0.5


class Templates:
    """Notices as sparse vectors over words and pairs of words that follow each other."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES):
        self.names, rows = [], []
        for name, texts in templates.items():
            for t in texts:
                self.names.append(name)
                rows.append(self.terms(words(t.encode())))
        df = Counter(t for r in rows for t in r)
        self.idf = {t: math.log((len(rows) + 1) / n) + 0.1 for t, n in df.items()}
        #: A word outside all templates weighs as much as the rarest.
        self.other = math.log(len(rows) + 1) + 0.1
        self.postings: dict[object, list[tuple[int, float]]] = {}
        for i, r in enumerate(rows):
            w = {t: n * self.idf[t] for t, n in r.items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            for t, x in w.items():
                self.postings.setdefault(t, []).append((i, x / norm))
        self.size = [sum(n for t, n in r.items() if isinstance(t, bytes)) for r in rows]
        self.words = {t for t in df if isinstance(t, bytes)}

    @staticmethod
    def terms(own: list[bytes]) -> Counter:
        return Counter(own) + Counter(zip(own, own[1:], strict=False))

    def match(self, own: list[bytes]) -> tuple[float, int]:
        """The best cosine of a passage with a template, and that template."""
        total = np.zeros(len(self.names))
        square = 0.0
        for t, n in self.terms(own).items():
            w = n * self.idf.get(t, self.other if isinstance(t, bytes) else self.other / 2)
            square += w * w
            for i, x in self.postings.get(t, ()):
                total[i] += w * x
        best = int(total.argmax())
        return (float(total[best]) / math.sqrt(square) if square else 0.0), best

    def notices(self, text: bytes, least: float) -> list[tuple[str, float, int, int]]:
        """(licence, cosine, first line, words) of each notice in a whole text.

        Candidates are runs of lines whose words are mostly the templates'; a run is matched as a whole, line by line
        and in windows of consecutive lines of about a template's length. Of candidates that overlap the nearest counts.
        """
        out, run, start = [], [], 0
        lines = text.split(b"\n")
        for k, line in enumerate([*lines, b""]):
            own = words(line) if k < len(lines) else []
            if own and 2 * sum(w in self.words for w in own) >= len(own):
                if not run:
                    start = k
                run.append(own)
                continue
            if run:
                found = []
                for i, j in self.windows(run, least):
                    own = [w for x in run[i:j] for w in x]
                    c, best = self.match(own)
                    if c >= least:
                        found.append((-round(c, 9), i - j, i, j, len(own), best, c))
                taken = np.zeros(len(run), bool)
                for _, _, i, j, n, best, c in sorted(found):
                    if not taken[i:j].any():
                        taken[i:j] = True
                        out.append((self.names[best], c, start + i, n))
                run = []
        for more, less in HOLDS.items():
            if any(f[0] == more for f in out):
                out = [(more if f[0] == less else f[0], *f[1:]) for f in out]
        return out

    def windows(self, run: list[list[bytes]], least: float) -> set[tuple[int, int]]:
        """Ranges of lines of a run to be matched: each line, the whole, and windows as long as templates that may be in it.

        A template whose terms in the run weigh less than `least` of its length has no window that comes near it.
        """
        n = len(run)
        out = {(i, i + 1) for i in range(n)} | {(0, n)}
        if n < 3:
            return out
        weight = np.zeros(len(self.names))
        for t in self.terms([w for x in run for w in x]):
            for i, x in self.postings.get(t, ()):
                weight[i] += x * x
        ends = np.cumsum([len(x) for x in run])
        for size in {self.size[i] for i in np.flatnonzero(weight >= least * least - 1e-9).tolist()}:
            for i in range(n):
                j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size))
                out |= {(i, min(k, n)) for k in (j, j + 1, j + 2) if k > i}
        return out


def scan(files: DataFrame, path: Column, text: str = "text", least: float = LEAST) -> DataFrame:
    """(uid, doc_id, path, licence, cosine, line, is_file) of every file: the notice of greatest cosine in the whole text, or nulls.

    is_file: at least half of the words are notices, or the name is LICENSE, LICENCE, COPYING, NOTICE
    or UNLICENSE with or without an ending, so that the licence holds for its directory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates()
        for b in batches:
            rows = []
            for x in utf8_rows(b.column("text")):
                found = t.notices(x, least) if x else []
                best = max(found, key=lambda f: (round(f[1], 9), -f[2]), default=None)
                covered = sum(f[3] for f in found)
                rows.append((best[0], min(best[1], 1.0), best[2], 2 * covered * 1.0 >= len(words(x))) if best else (None, None, None, False))
            kinds = (pa.string(), pa.float64(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("uid", "doc_id", "path")), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["uid", "doc_id", "path", "licence", "cosine", "line", "is_file"])

    own = files.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), path.alias("path"), F.col(text).alias("text"))
    found = own.mapInArrow(run, "uid long, doc_id long, path string, licence string, cosine double, line int, is_file boolean")
    named = F.col("path").rlike(r"(?i)(^|/)(un)?(licen[sc]e|copying|notice)(\.[^/]*)?$")
    return found.withColumn("is_file", F.col("licence").isNotNull() & (F.col("is_file") | F.coalesce(named, F.lit(False))))


def licensed(files: DataFrame, path: Column, text: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, path, licence, cosine, line, how, from_dir) of every file; how: `own`, `inherited` or null.

    Notices are found in whole texts by sparse TF-IDF cosine with templates. A file without one takes
    the licence of the nearest directory above it that holds a licence file: files meet all their
    ancestor directories by equality of paths and the deepest wins. Of several licence files in a
    directory the one of greatest cosine counts, then the first by licence.

    Null or empty texts have no notice; a null path has no directory; repeated rows count each.
    """
    found = materialize(scan(files, path, text, least), "notices")
    dirs = found.where("is_file AND path IS NOT NULL").select(F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), "licence", "cosine")
    best = F.min_by("licence", F.struct((-F.round("cosine", 9)).alias("c"), "licence"))
    dirs = materialize(dirs.groupBy("dir").agg(best.alias("dir_licence")), "directories")
    bare = found.where("licence IS NULL AND path IS NOT NULL")
    parts = F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/")
    # each distinct directory once, with all its ancestors
    asked = bare.select(parts.alias("parts")).distinct()
    depth = F.explode(F.sequence(F.lit(0), F.size("parts")))
    ancestors = asked.withColumn("depth", depth).withColumn("dir", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/"))
    nearest = ancestors.join(dirs, "dir").groupBy("parts").agg(F.max_by(F.struct("dir", "dir_licence"), "depth").alias("near"))
    nearest = materialize(nearest.select(F.array_join("parts", "/").alias("own_dir"), F.col("near.dir").alias("from_dir"), F.col("near.dir_licence").alias("dir_licence")), "nearest")
    found = found.withColumn("own_dir", F.when(F.col("licence").isNull(), F.regexp_replace("path", "/?[^/]*$", "")))
    out = found.join(nearest, "own_dir", "left")
    how = F.when(F.col("licence").isNotNull(), F.lit("own")).when(F.col("dir_licence").isNotNull(), F.lit("inherited"))
    return out.select("doc_id", "path", F.coalesce("licence", "dir_licence").alias("licence"), "cosine", "line", how.alias("how"), "from_dir")


def op8_licence_scan(docs: DataFrame) -> DataFrame:
    """Licences of all documents, whose path is source/lang/doc_id."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return licensed(docs, path)
