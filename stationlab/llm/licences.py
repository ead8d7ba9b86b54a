"""Licence scans: TF-IDF cosine of passages to licence templates, and inheritance down directories."""

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationlab.llm.common import broadcast_if_small, cut, encoded

# Usual notices, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms under the BSD 2-Clause License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This work is subject to the terms of the Mozilla Public License, version 2.0.",
}
THRESHOLD = 0.8
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[a-z]+)?$"
_TERM = re.compile(r"[^\W_](?:[\w.-]*[^\W_])?")


def terms(text: str) -> list[str]:
    """Lower-case words; dots and hyphens inside one belong to it."""
    return _TERM.findall(text.lower())


class Templates:
    """Unit TF-IDF vectors of the templates, and the terms without which no passage reaches the threshold."""

    def __init__(self, templates: dict[str, str], frequency: dict[str, int], n: int, threshold: float):
        self.n, self.frequency, self.threshold = n, frequency, threshold
        self.vectors = {name: self.vector(terms(text)) for name, text in sorted(templates.items())}
        self.keys: set[str] = set()
        for vector in self.vectors.values():
            # The lightest terms together are too little; one of the others must be there.
            rest = 0.0
            for t, w in sorted(vector.items(), key=lambda x: (x[1], x[0])):
                rest += w * w
                if math.sqrt(rest) >= threshold - 1e-9:
                    self.keys.add(t)
        self.pattern = re.compile("|".join(map(re.escape, sorted(self.keys))) or r"(?!)")

    def vector(self, words: list[str]) -> dict[str, float]:
        raw = {t: c * (math.log((self.n + 1) / (self.frequency.get(t, 0) + 1)) + 1) for t, c in Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {t: x / norm for t, x in raw.items()} if norm else {}

    def best(self, passage: str) -> tuple[float, str] | None:
        own = self.vector(terms(passage))
        found = [(sum(w * own.get(t, 0.0) for t, w in v.items()), name) for name, v in self.vectors.items()]
        top = min(((-s, name) for s, name in found), default=None)
        return (-top[0], top[1]) if top and -top[0] >= self.threshold - 1e-9 else None

    def scan(self, text: str) -> tuple[str | None, float | None, int | None]:
        """(name, cosine, line) of the best passage: each line, and each run of lines without a blank one.

        Ties go to the first template by name, then to the earlier line.
        """
        if not self.pattern.search(text.lower()):
            return None, None, None
        lines = text.split("\n")
        passages = [(i, x) for i, x in enumerate(lines)]
        start = 0
        for i, x in enumerate([*lines, ""]):
            if not x.strip():
                if i - start > 1:
                    passages.append((start, "\n".join(lines[start:i])))
                start = i + 1
        found = []
        for i, x in passages:
            if self.pattern.search(x.lower()) and (hit := self.best(x)):
                found.append((-hit[0], hit[1], i))
        if not found:
            return None, None, None
        cosine, name, line = min(found)
        return name, -cosine, line


def _frequencies(files: DataFrame, vocabulary: frozenset[str]) -> tuple[dict[str, int], int]:
    """In how many texts each template term is, and the number of texts; a row per task and term."""
    shape = re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, sorted(vocabulary, key=lambda t: (-len(t), t)))) + r")(?![^\W_])")

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            seen[""] += batch.num_rows
            for text in encoded(batch.column("text")):
                low = text.decode("utf-8", "replace").lower()
                rough = set(shape.findall(low))
                if rough:
                    seen.update(vocabulary.intersection(terms(low)) if len(low) < 1 << 20 else vocabulary.intersection(t.group() for t in _TERM.finditer(low)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"]
        )

    rows = files.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r.term: r.n for r in rows}
    return found, found.pop("", 0)


def scan(
    files: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, licence_file=None
) -> DataFrame:
    """Per row of ``files`` (path, text): path, own, cosine, line, licence, inherited_from.

    ``own`` is the template that some passage of the whole text reaches the threshold with;
    ``licence`` is that, or the one that holds in the nearest directory above.  A directory's
    licence is that of the licence files directly in it: the largest cosine, then the smaller
    path.  ``licence_file`` is the condition on the rows that makes one; by default the usual
    file names.  Other columns stay.  Null and empty texts have no own licence; a null path
    inherits nothing; repeated rows stay; no rows give no rows.
    """
    templates = TEMPLATES if templates is None else templates
    vocabulary = frozenset(t for x in templates.values() for t in terms(x))
    kept = [c for c in files.columns if c not in ("text", "path", "own", "cosine", "line", "licence", "inherited_from")]
    made = F.col("path").rlike(LICENCE_FILE) if licence_file is None else licence_file
    rows = files.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_made", F.coalesce(made, F.lit(False)))
    frequency, n = _frequencies(rows, vocabulary) if vocabulary else ({}, 0)
    shared = files.sparkSession.sparkContext.broadcast(Templates(templates, frequency, n, threshold))

    narrow = rows.select("text", F.struct("path", "_made", *kept).alias("_row"))

    def run(batches):
        model = shared.value
        for batch in batches:
            found = [model.scan(x.decode("utf-8", "replace")) for x in encoded(batch.column("text"))]
            own, cosine, line = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(own, pa.string()), pa.array(cosine, pa.float64()), pa.array(line, pa.int32())],
                names=["_row", "own", "cosine", "line"],
            )

    row_type = narrow.schema["_row"].dataType.simpleString()
    scanned = cut(narrow.mapInArrow(run, f"_row {row_type}, own string, cosine double, line int").select("_row.*", "own", "cosine", "line"))
    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    best = Window.partitionBy("_directory").orderBy(F.desc("cosine"), "path")
    made = (
        scanned.filter(F.col("_made") & F.col("own").isNotNull() & F.col("path").isNotNull())
        .withColumn("_directory", directory)
        .withColumn("_i", F.row_number().over(best))
        .filter("_i = 1")
        .select("_directory", F.col("own").alias("_own"))
    )
    # Path joins: every directory that holds files meets its ancestors, and the deepest with a licence wins.
    places = scanned.filter("path IS NOT NULL").select(directory.alias("_place")).distinct()
    steps = F.split(F.col("_place"), "/")
    above = F.transform(
        F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/")
    )
    nearest = (
        places.withColumn("_directory", F.explode(F.array_distinct(above)))
        .join(made, "_directory")
        .groupBy("_place")
        .agg(F.max_by(F.struct("_own", "_directory"), F.length("_directory")).alias("_near"))
    )
    nearest = broadcast_if_small(cut(nearest), 256)
    joined = scanned.withColumn("_place", directory).join(nearest, "_place", "left")
    takes = F.col("own").isNull() & F.col("path").isNotNull()
    return joined.select(
        "path", *kept, "own", "cosine", "line",
        F.when(takes, F.col("_near._own")).otherwise(F.col("own")).alias("licence"),
        F.when(takes, F.col("_near._directory")).alias("inherited_from"),
    )
