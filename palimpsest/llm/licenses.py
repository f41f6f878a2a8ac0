"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import checkpoint, slices, texts

TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "This project is licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Licensed under the ISC License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "CC0 1.0 Universal Public Domain Dedication"),
    ("Proprietary", "All rights reserved. Proprietary and confidential. Unauthorized copying is prohibited"),
]
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation, either version {version} of the License, or (at your option) any later version."""
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
#: Standard headers, and licence files: their texts where they are short, else their titles with the version line.
TEMPLATES += [
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MIT", f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_WARRANTY}"""),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", f"{_BSD} {_BSD_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_NAMES}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_NAMES} {_BSD_AS_IS}"),
    *((f"{short}GPL-{version}.0", _GPL.format(kind=kind, version=version)) for short, kind, version in (("", "", 2), ("", "", 3), ("A", "Affero ", 3), ("L", "Lesser ", 3))),
    ("LGPL-2.1", _GPL.format(kind="Lesser ", version="2.1").replace("This program", "This library")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
]
#: A text without any of these parts (lower case) has no trigger.
PARTS = ("licen", "redistribut", "copyright", "spdx", "permission", "domain", "reserved", "proprietary", "form")
TRIGGER = re.compile(r"licen|redistribut|copyright|spdx|permission|public\W+domain|rights\W+reserved|proprietary|source\W+code\W+form", re.IGNORECASE)
TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
WORD = re.compile(r"[a-zA-Z0-9]+(?:\.[0-9]+)*")
NAMES = re.compile(r"(?i)^(licen[cs]e|copying|unlicense)(\.|$)")
THRESHOLD = 0.6


def terms(text: str) -> Counter:
    return Counter(TERM.findall(text.lower()))


class Matcher:
    """Cosine of TF-IDF vectors; terms outside the templates weigh like the rarest."""

    def __init__(self, templates, df: dict[str, int], total: int):
        self.rarest = math.log(total + 1) + 1
        self.idf = {t: math.log((total + 1) / (df.get(t, 0) + 1)) + 1 for _, x in templates for t in terms(x)}
        self.vectors = []
        for name, x in templates:
            v = {t: n * self.idf[t] for t, n in terms(x).items()}
            self.vectors.append((name, v, math.sqrt(sum(w * w for w in v.values())), sum(terms(x).values())))

    def best(self, segment: str) -> tuple[float, str]:
        v = {t: n * self.idf.get(t, self.rarest) for t, n in terms(segment).items()}
        norm = math.sqrt(sum(w * w for w in v.values()))
        if not norm:
            return 0.0, ""
        found = [(-sum(w * v[t] for t, w in x.items() if t in v) / (norm * size), name) for name, x, size, _ in self.vectors]
        score, name = min(found)
        return -score, name

    def windows(self, text: str, hits: list[tuple[int, int]]):
        """(score, license, start, end): for each template the best window of as many terms as it has that meets a hit, across and inside lines."""
        found = [(m.start(), m.end(), m[0].lower()) for m in WORD.finditer(text)]
        starts, ends, words = ([x[i] for x in found] for i in range(3))
        weights = [self.idf.get(t, self.rarest) for t in words]
        at = [(bisect_right(ends, s), bisect_left(starts, e)) for s, e in hits]
        for name, v, size, n in self.vectors:
            ranges = []
            for first, stop in at:
                lo, hi = max(0, first - n + 1), min(len(words), stop + n - 1)
                if ranges and lo < ranges[-1][1]:
                    ranges[-1][1] = max(hi, ranges[-1][1])
                elif lo < hi:
                    ranges.append([lo, hi])
            best = (0.0, 0, 0)
            for lo, hi in ranges:
                counts, dot, norm = {}, 0.0, 0.0
                for i in range(lo, hi):
                    t, w = words[i], weights[i]
                    c = counts[t] = counts.get(t, 0) + 1
                    norm += (2 * c - 1) * w * w
                    dot += v.get(t, 0.0) * w
                    low = max(lo, i - n + 1)
                    if i - n >= lo:
                        t, w = words[i - n], weights[i - n]
                        c = counts[t] = counts[t] - 1
                        norm -= (2 * c + 1) * w * w
                        dot -= v.get(t, 0.0) * w
                    if (i - low == n - 1 or i == hi - 1) and (score := dot / (size * math.sqrt(norm))) > best[0] + 1e-9:
                        best = (score, low, i)
            if best[0]:
                yield best[0], name, starts[best[1]], ends[best[2]]

    def scan(self, text: str) -> tuple[float, str, int, int]:
        """Best (score, license, start, end); equal scores go to the longer segment. Segments: lines and runs of lines with a trigger in each, the whole text, and windows around each trigger."""
        low = text.lower()
        if not any(t in low for t in PARTS) or not (hits := [m.span() for m in TRIGGER.finditer(text)]):
            return 0.0, "", 0, 0
        segments, run, at = [], None, 0
        for line in text.split("\n"):
            end = at + len(line)
            if TRIGGER.search(line):
                segments.append((at, end))
                run = (run[0] if run else at, end)
            elif run:
                segments.append(run)
                run = None
            at = end + 1
        if run:
            segments.append(run)
        segments.append((0, len(text)))
        best = (0.0, "", 0, 0)
        for s, e in dict.fromkeys(segments):
            score, name = self.best(text[s:e])
            if score > best[0] + 1e-12:
                best = (score, name, s, e)
        for found in self.windows(text, hits):
            more = found[0] - best[0]
            if more > 1e-9 or more > -1e-9 and found[3] - found[2] > best[3] - best[2]:
                best = found
        return best


def scan_licenses(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, path, text) -> doc_id, path, own_license, own_score, span_start, span_end, license, inherited_from.

    own_license is the template of greatest cosine to a segment of the whole text, if it reaches ``threshold``; ties go to
    the longer window, the lesser name and the first segment. A licence file (by its name, or one of which the segment is at least half)
    gives its licence to its directory: the best score, then the lesser name. A file without an own licence takes that of
    the nearest ancestor directory that has one. Null text is empty; a null path has no directory and inherits nothing;
    null ids and repeated rows stay; an empty table gives no rows; other columns are ignored.

    Document frequencies of the templates' terms are counted over all files (a bounded number of terms). Directories,
    not files, are joined with their ancestors, so a hot root brings a row for each of its directories only.
    """
    import pyarrow as pa

    spark = files.sparkSession
    vocabulary = sorted({t for _, x in templates for t in terms(x)})

    def count(batches):
        df, n, want = Counter(), 0, set(vocabulary)
        for b in (part for whole in batches for part in slices(whole)):
            for t in texts(b.column("text")):
                df.update(want.intersection(TERM.findall(t.lower())))
                n += 1
        names = ["", *df]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([n, *df.values()], pa.int64())], ["term", "n"])

    df = dict(map(tuple, files.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n")).collect()))
    matcher = Matcher(templates, df, df.pop("", 0))

    def match(batches):
        for b in (part for whole in batches for part in slices(whole)):
            rows = []
            for path, t in zip(b.column("path").to_pylist(), texts(b.column("text")), strict=True):
                score, name, s, e = matcher.scan(t)
                if score < threshold:
                    name = None
                file = bool(name) and (bool(path) and bool(NAMES.match(path.rsplit("/", 1)[-1])) or 2 * (e - s) >= len(t))
                rows.append((name, score, s, e, file))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("path"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "path", "own_license", "own_score", "span_start", "span_end", "file"])

    own = files.select(F.col("doc_id").cast("long").alias("doc_id"), "path", "text")
    own = own.mapInArrow(match, "doc_id long, path string, own_license string, own_score double, span_start long, span_end long, file boolean")
    own = checkpoint(own.withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)))
    given = own.where("file").groupBy(F.col("dir").alias("above")).agg(F.min(F.struct(-F.col("own_score"), F.col("own_license").alias("name"))).alias("_best"))
    given = given.select("above", F.col("_best.name").alias("given"))
    dirs = own.where("path is not null").select("dir").distinct()
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    near = dirs.select("dir", F.explode(above).alias("above")).join(given, "above")
    near = near.groupBy("dir").agg(F.max_by(F.struct("above", "given"), F.length("above")).alias("_near"))
    out = own.join(near, "dir", "left").withColumn("_near", F.when(F.col("path").isNotNull(), F.col("_near")))
    use = F.col("own_license").isNull()
    return out.select("doc_id", "path", "own_license", "own_score", "span_start", "span_end", F.coalesce("own_license", F.col("_near.given")).alias("license"), F.when(use, F.col("_near.above")).alias("inherited_from"))
