"""License scans: Dice coefficient over word bigrams against licence templates.

Text is normalised to lower-case words. A document is looked at as a whole and line
by line, since a licence may be the file or a line of it. Two texts with a and b distinct
bigrams share at most min(a, b), so a Dice coefficient of t bounds b by t/(2-t) and (2-t)/t
times a: templates outside are never compared. Candidates come from an equi-join on the
bigram; a pair's shared bigrams are counted and turned into the coefficient. Everything is
a DataFrame function. Templates are a table; a few public ones are given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bigrams of all templates up to which they are broadcast (about 100 bytes each); more are joined by a shuffle.
SMALL = 200_000

#: Opening and notice lines by which public licences are named.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
     "later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def bigrams(text: Column) -> Column:
    """Distinct neighbouring words of a text; a single word is its own bigram, no word gives none.

    The words are bound to a variable, so they are made once and not for every bigram.
    """
    def pairs(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.array_distinct(F.when(F.size(w) < 2, w).otherwise(
            F.zip_with(F.slice(w, 1, n), F.slice(w, F.when(n > 0, 2).otherwise(1), n), lambda x, y: F.concat_ws(" ", x, y))))
    return F.element_at(F.transform(F.array(words(text)), pairs), 1)


def template_table(spark: SparkSession, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(TEMPLATES if templates is None else templates, "license string, text string")


def scan(docs: DataFrame, templates: DataFrame | None = None, least: float = 0.8, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """(doc_id, line, license, dice): parts of documents that match a template, with its best coefficient.

    line is the number of the line from 1, or 0 for the whole text, which is looked at if it has more than
    one line. Null and blank texts and templates match nothing. A template row given twice counts once;
    rows of one id are told apart by a hash of their text, so equal rows give one row.
    """
    spark = docs.sparkSession
    templates = template_table(spark) if templates is None else templates
    known = (templates.where("license IS NOT NULL AND text IS NOT NULL").select("license", "text").distinct()
             .select("license", F.xxhash64("license", "text").alias("template"), bigrams(F.col("text")).alias("own"))
             .select("license", "template", F.size("own").alias("b"), F.explode("own").alias("bigram")))
    low, high = least / (2 - least), (2 - least) / least
    sizes = known.agg(F.min("b").alias("least"), F.max("b").alias("most"), F.count("*").alias("rows")).first()
    if sizes["most"] is None:
        return spark.createDataFrame([], "doc_id long, line int, license string, dice double")
    if sizes["rows"] <= SMALL:
        known = F.broadcast(known)
    text = F.col(text_col).cast("string")
    cut = F.split("text", "\n")
    parts = F.concat(F.array(F.when(F.size(cut) > 1, F.col("text"))), cut)
    own = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
           .select("doc_id", "th", F.posexplode(parts).alias("line", "part")).where("trim(part) <> ''")
           # a generator, so that the filter below does not make the bigrams anew
           .select("doc_id", "th", "line", F.explode(F.array(bigrams(F.col("part")))).alias("own"))
           .withColumn("a", F.size("own"))
           .where((F.col("a") >= low * sizes["least"] - 1e-9) & (F.col("a") <= high * sizes["most"] + 1e-9)))
    shared = (own.select("doc_id", "th", "line", "a", F.explode("own").alias("bigram")).join(known, "bigram")
              .where((F.col("b") >= low * F.col("a") - 1e-9) & (F.col("b") <= high * F.col("a") + 1e-9))
              .groupBy("doc_id", "th", "line", "license", "template", "a", "b").agg(F.countDistinct("bigram").alias("n")))
    return (shared.withColumn("dice", F.round(2 * F.col("n") / (F.col("a") + F.col("b")), 6)).where(F.col("dice") >= least)
            .groupBy("doc_id", "th", "line", "license").agg(F.max("dice").alias("dice"))
            .select("doc_id", F.col("line").cast("int").alias("line"), "license", "dice"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line, and every whole text, of ``documents`` that matches a licence."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    rows = ", ".join("({}, {})".format(*("'" + x.replace("'", "''") + "'" for x in t)) for t in TEMPLATES)

    def found(text: str) -> str:
        return (f"list_filter(string_split(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), "
                "lambda w: w <> '')")

    grams = ("list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(list_zip(w[:-2], w[2:]), "
             "lambda p: p[1] || ' ' || p[2]) END)")
    return f"""WITH t AS MATERIALIZED (SELECT DISTINCT license, {found("text")} AS w FROM (VALUES {rows}) v(license, text)),
k AS MATERIALIZED (SELECT license, {grams} AS g FROM t),
l AS (SELECT doc_id, text AS whole, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
u AS (SELECT DISTINCT doc_id, md5(whole) AS h, line, part FROM (SELECT doc_id, whole, 0 AS line, whole AS part FROM l
  WHERE len(ls) > 1 UNION ALL SELECT doc_id, whole, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS part FROM l) x),
f AS MATERIALIZED (SELECT doc_id, h, line, {found("part")} AS w FROM u),
o AS MATERIALIZED (SELECT doc_id, h, line, {grams} AS g FROM f WHERE len(w) > 0),
d AS (SELECT doc_id, h, line, license, round(2.0 * len(list_intersect(o.g, k.g)) / (len(o.g) + len(k.g)), 6) AS dice
  FROM o JOIN k ON len(o.g) >= len(k.g) * 2.0 / 3 - 1e-9 AND len(o.g) <= len(k.g) * 1.5 + 1e-9)
SELECT doc_id, CAST(line AS INTEGER) AS line, license, max(dice) AS dice FROM d WHERE dice >= 0.8
GROUP BY doc_id, h, line, license"""


OP8_SQL = _sql()
