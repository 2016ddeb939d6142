"""License scan: Dice coefficient of word bigrams against license templates."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public license notices and grants, as their authors publish them.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the "
        "copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission.",
    ],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
        "in all copies or substantial portions of the Software.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
LEAST = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_bigrams(templates=None) -> list[tuple[str, list[str]]]:
    """(license, distinct word bigrams) of every template that has any."""
    out = []
    for name, texts in sorted((templates or TEMPLATES).items()):
        for text in texts:
            words = re.findall("[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))
            pairs = sorted({f"{a} {b}" for a, b in zip(words, words[1:])})
            if pairs:
                out.append((name, pairs))
    return out


def _units(text: Column) -> Column:
    """Lines, and blocks of several lines between lines without words, as words one space apart."""
    clean = F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9\n]+", " ")

    def both(t):
        blocks = F.filter(F.split(t, r"\n[ \n]*\n"), lambda b: b.contains("\n"))
        return F.concat(F.split(t, "\n"), F.transform(blocks, lambda b: F.regexp_replace(b, r"[ \n]+", " ")))

    # through one-element arrays, the text and then each unit are cleaned once
    return F.transform(F.flatten(F.transform(F.array(clean), both)), lambda u: F.trim(u))


def _bigrams(words: Column) -> Column:
    n = F.size(words) - 1
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def license_matches(docs: DataFrame, templates=None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, unit, license, dice): pieces of text that match a template.

    A piece is a line, or a block of several lines between lines without words. With a and b distinct word bigrams, Dice
    is 2 * shared / (a + b), so only templates with a / b between least / (2 - least) and its inverse are
    candidates; pieces whose bigrams hold too few of any template's are left out before that.
    """
    known = template_bigrams(templates)
    ratio = least / (2 - least)
    sizes = [len(p) for _, p in known] or [0]
    fewest, lowest, highest = min(sizes), ratio * min(sizes), max(sizes) / ratio
    every = sorted({p for _, pairs in known for p in pairs})
    units = docs.select(F.col(id_col).alias("id"), F.explode(_units(F.col(text_col))).alias("words"))
    # n words have at most n - 1 distinct bigrams
    spaces = F.length("words") - F.length(F.replace("words", F.lit(" ")))
    paired = units.where(spaces >= lowest).select("id", "words", F.explode(F.array(_bigrams(F.split("words", " ")))).alias("pairs"))
    hit = paired.select("id", "words", "pairs", F.explode(F.array(F.filter("pairs", lambda p: p.isin(every)))).alias("hits")).where(
        F.size("hits") >= least * fewest / 2
    )
    sized = hit.select("id", "words", F.size(F.array_distinct("pairs")).alias("n"), F.array_distinct("hits").alias("shared")).where(
        F.col("n").between(lowest, highest) & (F.size("shared") >= least * (F.col("n") + fewest) / 2)
    )
    table = F.array(*[
        F.struct(F.lit(name).alias("license"), F.lit(len(pairs)).alias("size"), F.array(*[F.lit(p) for p in pairs]).alias("pairs"))
        for name, pairs in known
    ]) if known else F.expr("cast(array() as array<struct<license:string,size:int,pairs:array<string>>>)")
    fits = F.filter(table, lambda t: (F.col("n") >= t["size"] * ratio) & (F.col("n") <= t["size"] / ratio))
    tested = sized.select("id", "words", "n", "shared", F.explode(fits).alias("t"))
    dice = 2.0 * F.size(F.array_intersect("shared", "t.pairs")) / (F.col("n") + F.col("t.size"))
    return tested.select("id", F.col("words").alias("unit"), "t.license", dice.alias("dice")).where(F.col("dice") >= least)


def license_scan(docs: DataFrame, templates=None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its best license and how many distinct (piece, license) pairs match.

    Defined results: ties go to the first license by name; null, empty or unlicensed texts have a null
    license, a null dice and 0 matches; rows that repeat an id get the result over all of them; a null id gets
    none; a long text is scanned whole, piece by piece.
    Returns doc_id (named ``id_col``), license, dice, n_matches.
    """
    found = license_matches(docs, templates, least, id_col, text_col).groupBy("id", "unit", "license").agg(F.max("dice").alias("dice"))
    best = found.groupBy("id").agg(
        F.min(F.struct((-F.col("dice")).alias("down"), "license")).alias("best"), F.count(F.lit(1)).alias("n_matches")
    )
    ids = docs.select(F.col(id_col).alias("key"))
    return ids.join(best, ids["key"] == best["id"], "left").select(
        F.col("key").alias(id_col), F.col("best.license").alias("license"), (-F.col("best.down")).alias("dice"),
        F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
    )
