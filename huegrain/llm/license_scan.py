"""License scans: sparse TF-IDF cosine to notice templates, then inheritance from the nearest ancestor directory.

Every run of at most ``header_lines`` lines with words (comment marks are no words) is a header candidate; the whole text is one
more, which tells licence files. Document frequencies of all words are counted over all files. Candidates are first bounded: a
word that no template has weighs at least as much as one that all files have, and a text that reaches ``least`` has one of the
words that hold a template's weight. Both bounds come from the templates and lose nothing; the words of what is left are joined
to their frequencies. The score is 0 where no candidate can reach ``least``. Whether a whole text
is a licence file is asked more strictly: a word outside the templates weighs there as one that no file has, so that code under a
notice is none.
A file without a notice of its own takes that of the nearest directory above
it that holds a licence file, found by joining distinct directories, never files, to their ancestors.

Defined cases: null, empty and wordless texts have no own licence; ties go to the first template by name; a null path is
in no directory and inherits nothing; several licence files in a directory: best score, then first path; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_chunks, materialize

#: Public notices, as their licences recommend or as files usually carry them.
TEMPLATES = {
    "Apache-2.0": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license", "spdx-license-identifier apache-2.0"],
    "BSD-3-Clause": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "licensed under the bsd 3-clause license", "spdx-license-identifier bsd-3-clause"],
    "CC-BY-4.0": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "CC-BY-NC-4.0": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "CC-BY-SA-4.0": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"],
    "GPL-2.0": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "this work is licensed under the gnu general public license version 2", "spdx-license-identifier gpl-2.0"],
    "GPL-3.0": ["this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "spdx-license-identifier gpl-3.0"],
    "LGPL-2.1": ["this work is licensed under the gnu lesser general public license version 2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version", "spdx-license-identifier lgpl-2.1"],
    "LGPL-3.0": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", "this work is licensed under the gnu lesser general public license version 3", "spdx-license-identifier lgpl-3.0"],
    "MIT": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "spdx-license-identifier mit"],
    "MPL-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0", "spdx-license-identifier mpl-2.0"],
}
_WORD = re.compile(rb"[a-z0-9](?:[a-z0-9.+-]*[a-z0-9+])?")
_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"


class Matcher:
    """The templates' unit vectors and the search for the nearest one."""

    def __init__(self, templates: dict[str, list[str]], df: dict[bytes, int], n: int, least: float = 0.6):
        rows = [(name, Counter(_WORD.findall(t.encode()))) for name, ts in sorted(templates.items()) for t in ts]
        self._names, self._least = [name for name, _ in rows], least
        self._idf = {w: math.log((n + 2) / (df.get(w, 0) + 1)) + 1 for _, c in rows for w in c}
        # the weights of a word that all files have, that a single file has, and that none has
        self._low, self._high = math.log((n + 2) / (n + 1)) + 1, math.log((n + 2) / 2) + 1
        self._none = math.log(n + 2) + 1
        self._postings: dict[bytes, list[tuple[int, float]]] = {}
        self.telling: set[bytes] = set()
        for i, (_, c) in enumerate(rows):
            norm = math.sqrt(sum((tf * self._idf[w]) ** 2 for w, tf in c.items()))
            weights = {w: tf * self._idf[w] / norm for w, tf in c.items()}
            for w, x in weights.items():
                self._postings.setdefault(w, []).append((i, x))
            # texts that share only words with less than least ** 2 of the template's squares stay under least
            rest = 1.0
            for w in sorted(weights, key=lambda w: (-weights[w], w)):
                if rest < least * least - 1e-9:
                    break
                self.telling.add(w)
                rest -= weights[w] ** 2

    @staticmethod
    def vocabulary(templates: dict[str, list[str]]) -> set[bytes]:
        return {w for ts in templates.values() for t in ts for w in _WORD.findall(t.encode())}

    def candidate(self, found: Counter) -> tuple[float, float, dict] | None:
        """(least, most) that the cosine to the nearest template can be, and the parts of it; None where most is under ``least``."""
        known2, others2, others = 0.0, 0, []
        scores: dict[int, float] = {}
        for w, tf in found.items():
            if (idf := self._idf.get(w)) is None:
                others2 += tf * tf
                others.append({"word": w, "tf": tf})
                continue
            known2 += (tf * idf) ** 2
            for i, weight in self._postings[w]:
                scores[i] = scores.get(i, 0.0) + tf * idf * weight
        if not scores:
            return None
        i = min(scores, key=lambda j: (-round(scores[j], 9), j))
        most = scores[i] / math.sqrt(known2 + others2 * self._low**2)
        if most < self._least - 1e-6:
            return None
        return scores[i] / math.sqrt(known2 + others2 * self._high**2), most, {"name": self._names[i], "dot": scores[i], "known2": known2, "others": others}

    def candidates(self, text: bytes, header_lines: int, entire_least: float) -> list[dict]:
        """Runs of at most ``header_lines`` lines with words, and the whole text, that can be the best: none that another surely beats."""
        if self.telling.isdisjoint(_WORD.findall(text)):
            return []
        lines = [x for x in map(_WORD.findall, text.split(b"\n")) if x]
        found = []
        told = [not self.telling.isdisjoint(x) for x in lines]
        for a in range(len(lines)):
            if not any(told[a : a + header_lines]):
                continue
            run: Counter = Counter()
            for b in range(a, min(a + header_lines, len(lines))):
                run.update(lines[b])
                if (c := self.candidate(run)) is not None:
                    found.append(c)
        sure = max((c[0] for c in found), default=0.0)
        kept = [{**c[2], "whole": False} for c in found if c[1] >= sure - 1e-6]
        entire = self.candidate(Counter(w for x in lines for w in x))
        if entire is not None and (entire[1] >= sure - 1e-6 or entire[1] >= entire_least - 1e-6):
            strict = entire[2]["dot"] / math.sqrt(entire[2]["known2"] + sum(x["tf"] ** 2 for x in entire[2]["others"]) * self._none**2)
            kept.append({**entire[2], "whole": strict >= entire_least})
        return kept


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of all words, some hundred thousand words at a time."""

    def some(df: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(df), pa.binary()), pa.array(list(df.values()), pa.int64())], names=["word", "df"])

    df: Counter = Counter()
    for _, texts in doc_chunks(batches):
        for t in texts:
            df.update(set(_WORD.findall(t.lower())))
            if len(df) > 200_000:
                yield some(df)
                df = Counter()
    yield some(df)


_CANDIDATES = "array<struct<name:string,dot:double,known2:double,others:array<struct<word:binary,tf:int>>,whole:boolean>>"
_FOUND = pa.list_(pa.struct([("name", pa.string()), ("dot", pa.float64()), ("known2", pa.float64()), ("others", pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int32())]))), ("whole", pa.bool_())]))


def _scan(matcher: Matcher, header_lines: int, entire_least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in doc_chunks(batches):
            found = [matcher.candidates(t.lower(), header_lines, entire_least) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, _FOUND)], names=["id", "path", "found"])

    return run


def license_scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: dict[str, list[str]] | None = None, least: float = 0.6, entire_least: float = 0.9, header_lines: int = 8) -> DataFrame:
    """(id, path, license, score, how, from_path): how is header, file, inherited or none. A file named like a licence, or
    whose whole text is within ``entire_least`` of a template, is a licence file; other notices need ``least``."""
    templates = templates or TEMPLATES
    src = files.select(F.col(id_col).cast("long").alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("binary").alias("text"))
    counts = materialize(src.mapInArrow(_frequencies, "word binary, df long").groupBy("word").agg(F.sum("df").alias("df")), "words")
    n = src.count()
    known = counts.join(F.broadcast(src.sparkSession.createDataFrame([(bytearray(w),) for w in sorted(Matcher.vocabulary(templates))], "word binary")), "word").collect()  # the templates' words only
    matcher = Matcher(templates, {bytes(r.word): r.df for r in known}, n, least)
    found = src.mapInArrow(_scan(matcher, header_lines, entire_least), f"id long, path string, found {_CANDIDATES}")
    found = materialize(found.withColumn("row", F.monotonically_increasing_id()), "found")
    each = found.select("row", F.posexplode("found").alias("pos", "c")).select("row", "pos", "c.*")
    others = each.select("row", "pos", F.explode("others").alias("o")).join(counts, F.col("o.word") == F.col("word"))
    others = others.groupBy("row", "pos").agg(F.sum(F.pow(F.col("o.tf") * (F.log((F.lit(n) + 2) / (F.col("df") + 1)) + 1), 2.0)).alias("others2"))
    score = F.round(F.col("dot") / F.sqrt(F.col("known2") + F.coalesce("others2", F.lit(0.0))), 6)
    best = each.join(others, ["row", "pos"], "left").withColumn("score", score).groupBy("row").agg(F.max(F.struct("score", (-F.col("pos")).alias("p"), "name")).alias("b"), F.max("whole").alias("whole"))
    told = found.select("row", "id", "path").join(best, "row", "left")
    scanned = materialize(told.select("id", "path", F.when(F.col("b.score") >= least, F.col("b.name")).alias("own"), F.coalesce("b.score", F.lit(0.0)).alias("score"), F.coalesce("whole", F.lit(False)).alias("whole")), "scanned")
    parent = F.when(F.col("path").isNotNull(), F.regexp_replace("path", r"/?[^/]*$", ""))
    scanned = scanned.withColumn("dir", parent).withColumn("is_file", F.coalesce(F.col("own").isNotNull() & (F.col("whole") | F.col("path").rlike(_FILE)), F.lit(False)))
    held = scanned.filter("is_file and dir is not null").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "own")).alias("best"))
    held = held.select(F.col("dir").alias("up"), F.col("best.own").alias("inherited"), F.col("best.path").alias("from_path"))
    dirs = scanned.filter("own is null and dir is not null").select("dir").distinct()
    steps = F.split("dir", "/")
    above = dirs.select("dir", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))).alias("depth", "up"))
    nearest = above.join(held, "up").groupBy("dir").agg(F.max_by(F.struct("inherited", "from_path"), "depth").alias("near"))
    nearest = materialize(nearest.select("dir", "near.inherited", "near.from_path"), "inherited")
    out = scanned.join(nearest, "dir", "left")
    own = F.col("own").isNotNull()
    return out.select("id", "path", F.coalesce("own", "inherited").alias("license"), F.col("score"), F.when(own & F.col("is_file"), "file").when(own, "header").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("how"), F.when(own, F.col("path")).otherwise(F.col("from_path")).alias("from_path"))
