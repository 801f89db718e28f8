"""License scans: sparse TF-IDF cosine to templates, then directory inheritance.

Every line and sentence of a file that names licensing is compared with the
templates, which are notices, headings and identifier lines: its words, weighted by
TF-IDF, are joined with those of the templates, and the dot products are summed for
each pair. A file's own licenses are the best template of
each sentence at ``THRESHOLD`` or more. A file that is mostly license text, or
is named like one, is a license file and speaks for its directory; a file without
a license of its own takes that of its nearest ancestor directory.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortal.llm.common import cut

#: Usual notices of public licenses.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ],
    "MIT": [
        "Licensed under the MIT License.",
        "Released under the terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 3.",
    ],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released into the public domain under CC0 1.0 Universal."],
    "ISC": ["Licensed under the ISC License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved. No license is granted."],
}
#: The headings of license files, by license.
HEADINGS = {
    "Apache-2.0": "Apache License Version 2.0, January 2004",
    "MIT": "The MIT License (MIT)",
    "BSD-3-Clause": "BSD 3-Clause License",
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "MPL-2.0": "Mozilla Public License Version 2.0",
    "ISC": "ISC License",
}


def _templates() -> dict[str, list[str]]:
    """The notices, headings and identifier lines of every license."""
    tagged = {name: [f"SPDX-License-Identifier: {name}"] for name in TEMPLATES if name != "Proprietary"}
    return {name: [*notices, *([HEADINGS[name]] if name in HEADINGS else []), *tagged.get(name, [])] for name, notices in TEMPLATES.items()}


THRESHOLD = 0.6
#: The share of a file's words in license sentences from which on it is a license file.
FILE_SHARE = 0.5
_ABOUT = r"(?i)licen[cs]e|public domain|all rights reserved|permission is hereby|redistribution and use"
_NAMED = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.\-_].*)?$"
#: Possessive, so that a run of characters is read once however long it is.
_TERM = r"[A-Za-z0-9]++(?:[.][A-Za-z0-9]++)*+"


def _terms(text: str) -> list[str]:
    return re.findall(_TERM, text.lower())


def weights(templates: dict[str, list[str]] | None = None) -> tuple[list[tuple[str, int, str, float]], dict[str, float]]:
    """Rows (license, template, term, normalised weight), and the idf of each term; one more term, None, has that of unknown ones."""
    notices = [(name, k, Counter(_terms(t))) for name, ts in (templates or _templates()).items() for k, t in enumerate(ts)]
    seen = Counter(t for _, _, c in notices for t in c)
    idf = {t: math.log((1 + len(notices)) / (1 + n)) + 1 for t, n in seen.items()}
    rows = []
    for name, k, c in notices:
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        rows += [(name, k, t, n * idf[t] / norm) for t, n in c.items()]
    return rows, idf | {None: math.log(1 + len(notices)) + 1}


def _sentences(files: DataFrame) -> DataFrame:
    """(file, path, at, terms): the lines, and the sentences of wrapped paragraphs, that speak of licensing.

    A notice may be a line of its own or run over several, behind the signs of a comment.
    """
    unwrapped = F.regexp_replace("text", r"(?<!\n)\n[ \t]*+(?:(?:[*#;]+|//+|--)[ \t]*+)?(?=\S)", " ")
    parts = F.array_distinct(F.concat(F.split("text", r"\n+|(?<=[.!?])\s+"), F.split(unwrapped, r"\n+|(?<=[.!?])\s+")))
    rows = files.where(F.col("text").rlike(_ABOUT)).select("file", "path", F.posexplode(parts).alias("at", "sentence"))
    rows = rows.where(F.col("sentence").rlike(_ABOUT))
    return rows.select("file", "path", "at", F.regexp_extract_all(F.lower("sentence"), F.lit(_TERM), 0).alias("terms"))


def own_licenses(files: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(file, path, license, score, words): the best template of each sentence, by file and license."""
    spark: SparkSession = files.sparkSession
    rows, idf = weights(templates)
    known = spark.createDataFrame(rows, "license string, template int, term string, weight double")  # as large as the templates
    idfs = spark.createDataFrame([(t, w) for t, w in idf.items() if t], "term string, idf double")
    counted = (
        _sentences(files)
        .select("file", "path", "at", F.size("terms").alias("words"), F.explode("terms").alias("term"))
        .groupBy("file", "path", "at", "words", "term")
        .agg(F.count("*").alias("tf"))
        .join(F.broadcast(idfs), "term", "left")
        .withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(idf[None])))
    )
    key = ["file", "path", "at", "words"]
    norms = F.struct("term", "w")
    # A sentence's terms, gathered for its norm, are as many as its own words.
    whole = counted.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(norms).alias("terms"))
    met = whole.select(*key, "norm", F.inline("terms")).join(F.broadcast(known), "term")
    cosines = met.groupBy(*key, "license", "template").agg((F.sum(F.col("w") * F.col("weight") / F.col("norm"))).alias("cosine"))
    best = cosines.groupBy(*key).agg(F.max(F.struct(F.round("cosine", 6).alias("score"), F.col("license").alias("license"))).alias("best"))
    found = best.where(F.col("best.score") >= THRESHOLD)
    return found.groupBy("file", "path", F.col("best.license").alias("license")).agg(F.max("best.score").alias("score"), F.sum("words").alias("words"))


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(file, path, license, score, licenses, origin, origin_dir) for every row of ``files`` (file, path, text).

    origin is ``own``, ``inherited`` or ``none``; with several own licenses the one
    of the best score counts, then the last in name. In a directory with several
    license files the best score counts likewise.

    Null and empty texts have no license of their own. A null path counts as the
    root's. Rows with one (file, path) are one file. Texts are read whole. Other
    columns are not read; no rows give no rows.
    """
    files = files.select("file", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    own = cut(own_licenses(files, templates))
    ranked = own.groupBy("file", "path").agg(
        F.max(F.struct("score", "license")).alias("top"), F.array_sort(F.collect_set("license")).alias("licenses"), F.sum("words").alias("matched")
    )
    ranked = cut(ranked)
    sizes = files.select("file", "path", F.size(F.regexp_extract_all(F.lower("text"), F.lit(_TERM), 0)).alias("total"))
    held = sizes.alias("s").join(ranked.alias("r"), F.col("s.file").eqNullSafe(F.col("r.file")) & (F.col("s.path") == F.col("r.path")), "left")
    held = held.select("s.file", "s.path", "total", "top", "licenses", "matched", _directory(F.col("s.path")).alias("dir"))
    held = cut(held.distinct())
    named = F.regexp_extract("path", r"[^/]*$", 0).rlike(_NAMED)
    speaks = held.where(F.col("top").isNotNull() & (named | (F.col("matched") >= F.col("total") * FILE_SHARE)))
    ruled = cut(speaks.groupBy("dir").agg(F.max("top").alias("rule")))
    steps = F.transform(
        F.sequence(F.lit(0), F.size(F.split("dir", "/"))), lambda n: F.when(n == 0, F.lit("")).otherwise(F.array_join(F.slice(F.split("dir", "/"), F.lit(1), n), "/"))
    )
    above = held.where("top is null").select("dir").distinct().select("dir", F.posexplode(F.array_distinct(steps)).alias("depth", "up"))
    nearest = above.join(ruled.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max(F.struct("depth", "up", "rule")).alias("near"))
    nearest = cut(nearest)  # a directory with very many files can then be split in the join
    both = held.join(nearest, "dir", "left")
    origin = F.when(F.col("top").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    return both.select(
        "file",
        "path",
        F.coalesce("top.license", "near.rule.license").alias("license"),
        F.coalesce("top.score", "near.rule.score").alias("score"),
        F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"),
        origin.alias("origin"),
        F.when(F.col("top").isNull(), F.col("near.up")).alias("origin_dir"),
    )
