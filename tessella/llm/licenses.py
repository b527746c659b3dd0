"""Operator 5, licence scans in DataFrame functions only.

Lines of a file that hold a cue word, together and one by one, whole licence files and windows of
words that are laid over each cue word as the templates have it, whatever the line breaks, are
compared with licence templates by the cosine of TF-IDF vectors. Cue words come from the templates:
a text without one can't reach the least cosine with any. SPDX tags are read as they stand. A file
without a licence of its own takes that of the licence file in its nearest ancestor directory, by
joins on directory paths.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize

# Licence names and the notices they are recognised by.
TEMPLATES = [
    ("Apache-2.0", "licensed under the apache license version 2.0"),
    ("Apache-2.0", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license"),
    ("MIT", "released under the mit license"),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3"),
    ("GPL-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or any later version"),
    ("GPL-2.0", "licensed under the gnu general public license version 2"),
    ("LGPL-3.0", "licensed under the gnu lesser general public license version 3"),
    ("AGPL-3.0", "licensed under the gnu affero general public license version 3"),
    ("BSD-3-Clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("CC-BY-4.0", "licensed under cc by 4.0"),
    ("CC-BY-4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("CC-BY-SA-4.0", "licensed under cc by sa 4.0"),
    ("CC-BY-NC-4.0", "licensed under cc by nc 4.0"),
    ("CC0-1.0", "released into the public domain under cc0 1.0 universal"),
    ("Proprietary", "copyright all rights reserved"),
    ("Proprietary", "all rights reserved"),
    ("GPL-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or any later version"),
    ("LGPL-2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or any later version"),
    ("LGPL-3.0", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or any later version"),
    ("AGPL-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or any later version"),
    ("ISC", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("Zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("EPL-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0"),
    ("CC-BY-ND-4.0", "licensed under cc by nd 4.0"),
    # Titles of the full texts.
    ("BSL-1.0", "boost software license version 1.0"),
    ("Artistic-2.0", "the artistic license 2.0"),
    ("CDDL-1.0", "common development and distribution license version 1.0"),
    ("OFL-1.1", "sil open font license version 1.1"),
    ("EUPL-1.2", "european union public licence v 1.2"),
    ("Apache-2.0", "apache license version 2.0 january 2004"),
    ("GPL-3.0", "gnu general public license version 3 29 june 2007"),
    ("GPL-2.0", "gnu general public license version 2 june 1991"),
    ("LGPL-3.0", "gnu lesser general public license version 3 29 june 2007"),
    ("AGPL-3.0", "gnu affero general public license version 3 19 november 2007"),
    ("MPL-2.0", "mozilla public license version 2.0"),
    ("CC-BY-4.0", "creative commons attribution 4.0 international"),
    ("CC-BY-SA-4.0", "creative commons attribution sharealike 4.0 international"),
    ("CC-BY-NC-4.0", "creative commons attribution noncommercial 4.0 international"),
    ("CC0-1.0", "cc0 1.0 universal"),
]
# The repeated group is possessive: Java's matcher recurses on others, and a long text ends the process.
SPDX = r"(?i)spdx-license-identifier:\s*\(?([a-z0-9.+-]++(?:[ \t]++(?:and|or|with)[ \t]++[a-z0-9.+-]++)*+)"
BLOCK = 512  # words
FILE = r"(?i)^(licen[sc]e|copying|unlicense|notice)(\.[a-z]+)?$"
TOKENS = r"[^a-z0-9.]+|\.+(?=[^0-9]|$)|(?<![0-9])\.+"


def tokens(text):
    return F.filter(F.split(F.lower(text), TOKENS), lambda t: t != "")


def weigh(templates: list[tuple[str, str]], df: dict[str, int], total: int, least: float) -> tuple[dict[str, float], list[tuple], list[str]]:
    """IDF by word; (template, name, {word: share of the cosine}, words, cue words) of each; all cue words.

    The words of a template that are no cues have a squared weight below least ** 2 together, so by
    the inequality of Cauchy and Schwarz a text without its cues has a lower cosine than least.
    """
    idf = {w: math.log((1.0 + total) / (1.0 + df.get(w, 0))) + 1 for _, t in templates for w in t.split()}
    known, cues = [], set()
    for number, (name, text) in enumerate(templates):
        words = text.split()
        weight = {w: words.count(w) * idf[w] for w in set(words)}
        norm = math.sqrt(sum(x * x for x in weight.values()))
        rest, own = 1.0, []
        for w in sorted(weight, key=lambda w: (-weight[w], w)):
            if rest < least * least - 1e-9:
                break
            own.append(w)
            rest -= (weight[w] / norm) ** 2
        known.append((number, name, {w: weight[w] / norm for w in sorted(weight)}, words, own))
        cues |= set(own)
    return idf, known, sorted(cues)


def license_scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", least: float = 0.6, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per row of files: doc_id, license, score, basis (file, header, inherited, none), from_dir.

    IDF covers all files. A path begins with / and names a file; a null path stands in no directory,
    so it inherits nothing; null and empty texts have no licence of their own. An SPDX tag has score 1.
    Ties go to the higher score, then the licence that is first by name; of several licence files in a
    directory the best score holds. Repeated rows are judged each; columns that aren't named are ignored.
    """
    spark = files.sparkSession
    path = F.coalesce(F.col(path_col), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Document frequencies of the templates' words, as many rows as there are words; '' counts the files.
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    known = F.array_intersect(F.array_distinct(tokens(text)), F.array(*map(F.lit, vocabulary)))
    df = {r.term: r.df for r in files.select(F.explode(F.concat(known, F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
    total = df.pop("", 0)
    idf, weighed, cues = weigh(templates, df, total, least)
    cue = r"(?<![a-z0-9])(?:" + "|".join(c.replace(".", r"\.") for c in cues) + r")(?![a-z0-9])"
    rows = files.select(F.monotonically_increasing_id().alias("row_key"), F.col(id_col).cast("long").alias("the_id"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract(path, r"([^/]*)$", 1).rlike(FILE).alias("is_file"), text.alias("text"))
    marked = materialize(rows.select("row_key", "the_id", "dir", "is_file", F.when(F.lower("text").rlike(cue), F.col("text")).alias("text"), F.regexp_extract_all("text", F.lit(SPDX), F.lit(1)).alias("tags")), "license-marks")
    rare = math.log(1.0 + total) + 1
    words = spark.createDataFrame([(n, name, w, x, idf[w]) for n, name, unit, _, _ in weighed for w, x in unit.items()], "template int, name string, term string, unit double, idf double")
    # Units: the lines with a cue word one by one and together, and the whole of a licence file.
    hinted = marked.where("text is not null")
    units = hinted.select("row_key", F.when(F.col("is_file"), F.col("text")).alias("whole"), F.filter(F.split("text", "\n"), lambda x: F.lower(x).rlike(cue)).alias("lines"))
    lines = F.col("lines")
    units = units.select("row_key", F.posexplode(F.concat(lines, F.when(F.size(lines) > 1, F.array(F.array_join(lines, " "))).otherwise(F.array()), F.when(F.col("whole").isNotNull(), F.array("whole")).otherwise(F.array()))).alias("unit_no", "unit"))
    terms = units.select("row_key", "unit_no", F.explode(tokens(F.col("unit"))).alias("term")).groupBy("row_key", "unit_no", "term").agg(F.count("*").alias("tf"))
    frequent = F.broadcast(words.select("term", "idf").distinct())
    weighted = terms.join(frequent, "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(rare)))
    size = Window.partitionBy("row_key", "unit_no")
    weighted = weighted.withColumn("norm", F.sqrt(F.sum(F.col("x") ** 2).over(size)))
    cosines = weighted.where("idf is not null").join(F.broadcast(words.drop("idf")), "term").groupBy("row_key", "unit_no", "template").agg((F.sum(F.col("x") * F.col("unit")) / F.first("norm")).alias("score"), F.first("name").alias("name")).select("row_key", "name", "score")
    # Windows: a template laid over its cue word, as long as it is and a quarter longer. Each cue word
    # of a text takes `reach` words of either side with it, so the work grows with the text.
    reach = 2 * max(len(w) for _, _, _, w, _ in weighed)
    laid = []
    for n, name, unit, seq, own in weighed:
        more = -(-len(seq) // 4)
        for o, w in enumerate(seq):
            if w in own:
                laid += [(w, name, o, len(seq), {k: x * idf[k] for k, x in unit.items()}), (w, name, o + more // 2, len(seq) + more, {k: x * idf[k] for k, x in unit.items()})]
    laid = spark.createDataFrame(laid, "term string, name string, before int, size int, dots map<string,double>")
    # Words in blocks with as much on either side, so that what a text of cue words alone explodes into is bounded.
    split = hinted.select("row_key", tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    begin = lambda at: F.least(at, F.lit(reach))
    block = lambda at: F.struct(begin(at).alias("lead"), F.slice("w", at - begin(at) + 1, begin(at) + BLOCK + reach).alias("w"))
    split = split.select("row_key", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(BLOCK)), block)).alias("b")).select("row_key", "b.*")
    own = lambda s: (s["at"] >= F.col("lead")) & (s["at"] < F.col("lead") + BLOCK) & s["term"].isin(cues)
    spots = split.select("row_key", "w", F.filter(F.transform("w", lambda x, i: F.struct(i.alias("at"), x.alias("term"))), own).alias("spots"))
    idfs = F.create_map(*[F.lit(v) for w in vocabulary for v in (w, idf[w])])
    spots = spots.where(F.size("spots") > 0).withColumn("idfs", F.transform("w", lambda x: F.coalesce(F.element_at(idfs, x), F.lit(rare))))
    near = lambda c, s: F.slice(c, F.greatest(s["at"] - reach, F.lit(0)) + 1, F.least(s["at"], F.lit(reach)) + reach)
    around = spots.select("row_key", F.explode(F.array_distinct(F.transform("spots", lambda s: F.struct(s["term"].alias("term"), F.least(s["at"], F.lit(reach)).alias("at"), near("w", s).alias("near"), near("idfs", s).alias("idfs"))))).alias("s")).select("row_key", "s.*")
    start, stop = F.greatest(F.col("at") - F.col("before"), F.lit(0)), F.col("at") - F.col("before") + F.col("size")
    windows = around.join(F.broadcast(laid), "term").select("row_key", "name", "dots", F.slice("near", start + 1, stop - start).alias("win"), F.slice("idfs", start + 1, stop - start).alias("x"))
    total_of = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v)
    windows = windows.select("row_key", "name", "win", "x", total_of(F.transform("win", lambda v: F.coalesce(F.element_at("dots", v), F.lit(0.0)))).alias("dot"), total_of(F.transform("x", lambda v: v * v)).alias("floor"))
    # floor is at most the squared norm: it takes each repeat of a word by itself.
    windows = windows.where(F.col("dot") >= (least - 1e-9) * F.sqrt("floor"))
    each = F.transform(F.zip_with("win", "x", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda s: s["b"] * s["b"] * F.size(F.filter("win", lambda v: v == s["a"])))
    cosines = cosines.unionByName(windows.select("row_key", "name", (F.col("dot") / F.sqrt(total_of(each))).alias("score")))
    names = sorted({n for n, _ in templates})
    tag = F.explode("tags").alias("tag")
    tagged = marked.where(F.size("tags") > 0).select("row_key", tag).select("row_key", F.coalesce(F.element_at(F.create_map(*[F.lit(v) for n in names for v in (n.lower(), n)]), F.lower("tag")), F.col("tag")).alias("name"), F.lit(1.0).alias("score"))
    best = cosines.where(F.col("score") >= least).unionByName(tagged).groupBy("row_key").agg(F.min(F.struct((-F.round("score", 9)).alias("minus"), "name")).alias("best")).select("row_key", F.col("best.name").alias("license"), (-F.col("best.minus")).alias("score"))
    judged = materialize(marked.select("row_key", "the_id", "dir", "is_file").join(best, "row_key", "left"), "license-own")
    # Inheritance is worked out once per directory.
    declared = judged.where("is_file and license is not null").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("d")).select(F.col("dir").alias("up"), F.col("d.license").alias("up_license"), (-F.col("d.minus")).alias("up_score"))
    dirs = judged.where("dir <> ''").select("dir").distinct()
    parts = F.split("dir", "/")
    ups = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("up"))
    nearest = ups.join(declared, "up").groupBy("dir").agg(F.max(F.struct(F.length("up").alias("depth"), "up", "up_license", "up_score")).alias("u")).select("dir", "u.up", "u.up_license", "u.up_score")
    out = judged.join(nearest, "dir", "left")
    basis = F.when(F.col("license").isNotNull(), F.when(F.col("is_file"), "file").otherwise("header")).when(F.col("up_license").isNotNull(), "inherited").otherwise("none")
    return out.select(F.col("the_id").alias("doc_id"), F.coalesce("license", "up_license").alias("license"), F.coalesce("score", "up_score", F.lit(0.0)).alias("score"), basis.alias("basis"), F.when(basis == "inherited", F.col("up")).alias("from_dir"))
