"""License scan as an exact set-similarity join, in DataFrame functions alone.

Every text block that holds at least a given share of a template's distinct words is found. Template words are put in one
global order, rarest in all documents first. A document can hold enough of a template only if it has one of the first
m - c + 1 of its m words in that order (c: how many are needed), so a join on those few words finds every candidate.
Length and positional filters follow, and each remaining block is counted exactly.

Notices of two licences may share most of their words, so blocks of several templates can lie over one another. Each of them
is in the result; which give their label, the words that name a licence decide: a block with its template's naming words
in a row always does, another one only if no block over it has them or has a larger share.

What is broadcast are the templates' own words, whose number max_template_words bounds whatever the corpus.
"""

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.llm.text import plain_words, row_key, with_row

# The phrases of the contract, each with its label.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Notices of public licences, as they are written in practice: label, the words in a row that name the
# licence, and the notice.
TEMPLATES = (
    ("gpl", "gnu general public license", "This work is licensed under the GNU General Public License, version 3."),
    ("mit", "permission is hereby granted", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "apache license", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "gnu general public license", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "gnu lesser general public license", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl", "gnu affero general public license", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "source and binary forms", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("mpl-2", "mozilla public license", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("isc", "permission to use", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("cc-by", "attribution 4 0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "attribution sharealike 4 0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nd", "attribution noderivatives 4 0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc", "attribution noncommercial 4 0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-sa", "attribution noncommercial sharealike 4 0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nc-nd", "attribution noncommercial noderivatives 4 0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
)


def _words(text: str) -> list[str]:
    return "".join(c.lower() if c.isalnum() else " " for c in text).split()


def template_rows(templates, threshold: float, max_template_words: int = 5000) -> list[dict]:
    """Templates as their distinct words, their length, the naming words, and how many distinct words a block needs."""
    found = [{"template": i, "label": label, "name": f" {' '.join(_words(name))} ", "words": list(dict.fromkeys(_words(text))), "length": len(_words(text))} for i, (label, name, text) in enumerate(templates)]
    found = [t | {"need": ceil(round(threshold * len(t["words"]), 9))} for t in found if t["words"]]
    if (total := sum(len(t["words"]) for t in found)) > max_template_words:
        raise ValueError(f"{total} template words; max_template_words is {max_template_words}")
    return found


def _places(words, phrases: dict[str, str]) -> dict:
    """Phrase places of a word array. The joined text is searched first, so that few rows are split into places."""
    joined = F.array_join(words, " ")
    starts = [f"filter(sequence(0, size(_words) - {n}), i -> slice(_words, i + 1, {n}) = split('{p}', ' '))" for p, n in ((p, len(p.split())) for p in phrases)]
    found = [F.when(F.contains(joined, F.lit(p)), F.expr(s)).otherwise(F.expr("cast(array() as array<int>)")) for p, s in zip(phrases, starts, strict=True)]
    return {f"_at{i}": x for i, x in enumerate(found)}


def template_blocks(words: DataFrame, templates=TEMPLATES, threshold: float = 0.8, max_template_words: int = 5000) -> DataFrame:
    """Every block at the threshold of the rows words(_id, _hash, _words): _id, _hash, template, label, start, end (words,
    from 0), shared and size (distinct words of the template in the block and in all), named. Each once.

    A block of a template of n words is 2 n words long and blocks start every n words, so any n words in a row lie in
    one block. Repeated input rows count once. No templates give no rows.
    """
    spark = words.sparkSession
    chosen = template_rows(templates, threshold, max_template_words)
    if not chosen:
        return spark.createDataFrame([], "_id long, _hash long, template int, label string, start int, end int, shared int, size int, named boolean")
    lexicon = sorted({w for t in chosen for w in t["words"]})
    known = F.array_intersect("_words", F.lit(lexicon))
    least = min(t["need"] for t in chosen)
    # Global order: in how many documents a template word stands. At most max_template_words rows come back.
    rank = {w: (0, w) for w in lexicon} | {r["w"]: (r["n"], r["w"]) for r in words.select(F.explode(known).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    for t in chosen:
        t["words"].sort(key=rank.get)
    prefix = [(w, t["template"], i, t["words"], t["need"], t["length"], t["label"], t["name"]) for t in chosen for i, w in enumerate(t["words"][: len(t["words"]) - t["need"] + 1])]
    rare = sorted({x[0] for x in prefix})
    table = spark.createDataFrame(prefix, "w string, template int, place int, t_words array<string>, need int, length int, label string, name string")
    rows = words.withColumn("_known", known).filter((F.size("_known") >= least) & F.arrays_overlap("_known", F.lit(rare)))
    hits = rows.withColumn("w", F.explode(F.array_intersect("_known", F.lit(rare)))).join(F.broadcast(table), "w")
    # length filter, then positional filter: what can still follow the place of the shared word
    hits = hits.filter((F.size("_known") >= F.col("need")) & (F.size("t_words") - F.col("place") + F.size(F.array_intersect("_known", F.expr("slice(t_words, 1, place)"))) >= F.col("need")))
    # the first shared word of a template stands for the others: no pair is verified twice
    hits = hits.filter(F.expr("not arrays_overlap(_known, slice(t_words, 1, place))"))
    # no block has more of a template than its document
    hits = hits.filter(F.size(F.array_intersect("t_words", "_known")) >= F.col("need"))
    counted = F.expr("transform(sequence(0, greatest(size(_words) - length - 1, 0), length), i -> named_struct('start', i, 'shared', size(array_intersect(t_words, slice(_words, i + 1, 2 * length)))))")
    blocks = hits.withColumn("_b", F.explode(F.filter(counted, lambda b: b["shared"] >= F.col("need"))))
    named = F.expr("contains(concat(' ', array_join(slice(_words, _b.start + 1, 2 * length), ' '), ' '), name)")
    end = F.least(F.size("_words"), F.col("_b.start") + 2 * F.col("length"))
    return blocks.select("_id", "_hash", "template", "label", "_b.start", end.alias("end"), "_b.shared", F.size("t_words").alias("size"), named.alias("named")).distinct()


def template_labels(blocks: DataFrame, span: int) -> DataFrame:
    """Per document with a block: _id, _hash, _labels, _share (the largest one) and _blocks, all of its blocks as
    label#template@start:shared/size, by start and template. span: words of the longest block.

    Blocks that lie over one another share a stretch of `span` words, so each is compared with those of its two or three
    stretches: at most as many as templates have blocks there.
    """
    key = ["_id", "_hash"]
    stretched = blocks.withColumn("_s", F.explode(F.expr(f"sequence(start div {span}, greatest(end - 1, start) div {span})")))
    groups = stretched.groupBy(*key, "_s").agg(F.collect_list(F.struct("template", "label", "start", "end", "shared", "size", "named")).alias("_all")).filter("size(_all) > 1")
    loses = lambda x: ~x["named"] & F.exists("_all", lambda y: (y["label"] != x["label"]) & (y["start"] < x["end"]) & (x["start"] < y["end"]) & (y["named"] | (y["shared"] * x["size"] > x["shared"] * y["size"])))
    lost = groups.select(*key, F.explode(F.filter("_all", loses)).alias("_x")).select(*key, "_x.template", "_x.start").distinct().withColumn("_lost", F.lit(True))
    marked = blocks.join(lost.withColumnsRenamed({c: f"l{c}" for c in ("_id", "_hash", "template", "start")}), F.expr("_id <=> l_id and _hash = l_hash and template = ltemplate and start = lstart"), "left")
    written = F.concat("label", F.lit("#"), F.col("template").cast("string"), F.lit("@"), F.col("start").cast("string"), F.lit(":"), F.col("shared").cast("string"), F.lit("/"), F.col("size").cast("string"))
    whole = F.array_sort(F.collect_list(F.struct("start", "template", written.alias("w"))))
    return marked.groupBy(*key).agg(
        F.collect_set(F.when(F.col("_lost").isNull(), F.col("label"))).alias("_labels"), F.max(F.col("shared") / F.col("size")).alias("_share"), F.array_join(F.transform(whole, lambda x: x["w"]), ",").alias("_blocks")
    )


def license_scan(df: DataFrame, id_column: str = "doc_id", text: str = "text", templates=TEMPLATES, threshold: float = 0.8, phrases: dict[str, str] = PHRASES, max_template_words: int = 5000) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    And blocks: every block that holds enough of a template, as label#template@start:shared/size, comma-joined.
    n_base counts the places of the phrases; first_word and last_word are their smallest and largest start, null
    without any. labels adds to the phrases' labels those of the templates. score is 1 with a phrase, else the largest
    share of a template that a block holds if that reaches the threshold, else 0. A null or empty text has no words and
    no labels; a text of any length is read whole. Repeated rows give repeated results, an empty table none; other columns are not read.
    """
    source = df.select(*row_key(id_column, text), plain_words(F.col(text)).alias("_words"))
    span = 2 * max((t["length"] for t in template_rows(templates, threshold, max_template_words)), default=1)
    labelled = template_labels(template_blocks(source, templates, threshold, max_template_words), span)
    names = [f"_at{i}" for i in range(len(phrases))]
    base = source.withColumns(_places(F.col("_words"), phrases)).withColumn("_at", F.flatten(F.array(*names)))
    own = F.array_compact(F.array(*[F.when(F.size(n) > 0, F.lit(label)) for n, label in zip(names, phrases.values(), strict=True)]))
    base = base.select(
        "_id", "_hash", F.size("_words").cast("long").alias("n_words"), F.size("_at").cast("long").alias("n_base"),
        F.array_min("_at").cast("long").alias("first_word"), F.array_max("_at").cast("long").alias("last_word"), own.alias("_own"),
    )
    none = F.expr("cast(array() as array<string>)")
    return with_row(base, labelled).select(
        F.col("_id").alias(id_column), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("_own")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_own", F.coalesce("_labels", none))), ",").alias("labels"),
        F.when(F.size("_own") > 0, F.lit(1.0)).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"), F.coalesce("_blocks", F.lit("")).alias("blocks"),
    )
