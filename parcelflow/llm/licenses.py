"""License scan: TF-IDF cosine of every line to license templates, then inheritance by directory.

Terms are runs of a-z and 0-9 after lowering A-Z. Inverse document frequencies count all scanned files; term
weights are whole numbers, so similarities do not depend on the order of sums. A file's own license is that of
its most similar line and template at or above the threshold, equal ones by template order. A license
file (``LICENSE``, ``COPYING``, ``NOTICE``, with any extension) gives its license to its directory; a file
without one of its own takes that of the nearest directory above it that has one.

Defined results: null and empty texts have no license of their own; a null path inherits nothing; several
license files in a directory: the most similar, then the license first by name; repeated rows are judged
each. No files give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from parcelflow.llm.arrow import with_arrow_columns
from parcelflow.session import cut

THRESHOLD = 0.6
#: License notices to look for: license, text.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by-4.0", "Licensed under Creative Commons Attribution CC BY 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("gpl-3.0", "Licensed under the GNU General Public License, version 3"),
    ("mit", "Released under the MIT License"),
    ("mpl-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0"),
    ("proprietary", "All rights reserved"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
_TERM = re.compile(rb"[a-z0-9]+")


def terms(line: str | bytes) -> list[bytes]:
    raw = line.encode("utf-8", "surrogatepass") if isinstance(line, str) else line
    return _TERM.findall(raw.lower())


def weight(files: int, frequency: int) -> int:
    """Whole-number weight of a term that ``frequency`` of ``files`` hold."""
    return math.floor(1000 * (1 + math.log((files + 1) / (frequency + 1))))


class Scanner:
    """Compares lines with templates, given the number of files and the frequencies of the templates' terms."""

    def __init__(self, templates, files: int, frequency: dict[bytes, int], threshold: float):
        self.names = [n for n, _ in templates]
        self.other = weight(files, 0)
        self.weight = {t: weight(files, frequency.get(t, 0)) for _, text in templates for t in terms(text)}
        self.vectors = [{t: n * self.weight[t] for t, n in Counter(terms(text)).items()} for _, text in templates]
        self.norms = [sum(x * x for x in v.values()) for v in self.vectors]
        self.threshold = threshold
        # a line without any of these terms stays below the threshold for every template:
        # its shared weight is at most that of the other, more frequent terms
        held = [0] * len(templates)
        self.needed = set(self.weight)
        for term in sorted(self.weight, key=lambda t: (self.weight[t], t)):
            more = [h + self.weight[term] ** 2 * (term in v) for h, v in zip(held, self.vectors)]
            if any(m >= (threshold - 1e-9) ** 2 * n for m, n in zip(more, self.norms)):
                break
            held = more
            self.needed.discard(term)

    def line(self, line: bytes) -> tuple[float, int] | None:
        """(similarity, -template number) of the best template, whatever the threshold."""
        counts = Counter(terms(line))
        norm = sum((n * self.weight.get(t, self.other)) ** 2 for t, n in counts.items())
        best = None
        for i, vector in enumerate(self.vectors):
            dot = sum(x * counts[t] * self.weight[t] for t, x in vector.items() if t in counts)
            if dot:
                found = (dot / math.sqrt(float(norm) * float(self.norms[i])), -i)
                best = found if best is None or found > best else best
        return best

    def text(self, text: str | None) -> tuple[str | None, float | None]:
        """License and similarity of the best line of a whole text at or above the threshold."""
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        if not any(t in raw for t in self.needed):
            return None, None
        lines = [x for x in raw.split(b"\n") if any(t in x for t in self.needed)]
        best = max((b for x in lines if (b := self.line(x)) is not None), default=None)
        if best is None or best[0] < self.threshold:
            return None, None
        return self.names[-best[1]], best[0]


def frequencies(files: DataFrame, text: str, templates=TEMPLATES) -> tuple[int, dict[bytes, int]]:
    """Number of files, and how many hold each term of the templates; counted over all files."""
    wanted = frozenset(t for _, body in templates for t in terms(body))
    body = files.select(F.col(text).cast("string").alias("text"))

    def count(batches):
        total, seen = 0, Counter()
        for batch in batches:
            total += batch.num_rows
            for value in batch.column(0):
                raw = (value.as_py() or "").encode("utf-8", "surrogatepass").lower()
                able = [t for t in wanted if t in raw]
                if able:
                    seen.update(wanted.intersection(_TERM.findall(raw)))
        yield pa.RecordBatch.from_pydict({"term": ["", *[t.decode() for t in seen]], "n": [total, *seen.values()]})

    rows = body.mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # the templates' terms
    found = {r.term.encode(): r.n for r in rows}
    return found.pop(b"", 0), found


def is_license_file(path: Column) -> Column:
    return F.coalesce(F.regexp_extract(path, r"([^/]*)$", 1).rlike(r"(?i)^(license|licence|copying|notice)(\.[^/]*)?$"), F.lit(False))


def directory(path: Column) -> Column:
    """The path up to its last slash, without it; empty for a file at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, id_column: str, path: str = "path", text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """id, path, license, similarity, origin (``own``, ``inherited``, ``none``) and granted_by, the directory inherited from."""
    total, frequency = frequencies(files, text, templates)
    scanner = Scanner(templates, total, frequency, threshold)
    narrow = files.select(F.col(id_column).alias("id"), F.col(path).alias("path"), F.col(text).cast("string").alias("text"))

    def make():
        def work(values):
            found = [scanner.text(v) for v in values]
            return [pa.array([n for n, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]

        return work

    own = with_arrow_columns(narrow, "text", [("own", T.StringType()), ("own_similarity", T.DoubleType())], make, ["id", "path"])
    own = cut(own.withColumn("dir", directory(F.col("path"))))
    best = F.struct(-F.col("own_similarity"), "own")
    grants = own.where(F.col("own").isNotNull() & is_license_file(F.col("path"))).groupBy(F.col("dir").alias("granted_by")).agg(
        F.min_by(F.struct("own", "own_similarity"), best).alias("grant"))
    # directories are resolved once each, whatever the number of their files
    parts = F.split("dir", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    steps = own.where("own is null and path is not null").select("dir").distinct().select("dir", F.explode(F.array_distinct(above)).alias("granted_by"))
    nearest = steps.join(grants, "granted_by").groupBy("dir").agg(F.max_by(F.struct("granted_by", "grant"), F.length("granted_by")).alias("from"))
    joined = own.join(nearest, "dir", "left")
    has = F.col("own").isNotNull()
    return joined.select(
        "id", "path", F.when(has, F.col("own")).otherwise(F.col("from.grant.own")).alias("license"),
        F.when(has, F.col("own_similarity")).otherwise(F.col("from.grant.own_similarity")).alias("similarity"),
        F.when(has, "own").when(F.col("from").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~has, F.col("from.granted_by")).alias("granted_by"))
