"""License texts in whole documents by diagonal voting, with DataFrame functions alone.

Every document gives the hashes of all its runs of k words, one row each. They are joined to the runs of the templates; a match is a vote
for the diagonal (place in the document minus place in the template). Votes are added up by document, template and diagonal;
diagonals of a template that lie within ``SPREAD`` are taken together, which bridges a few words put in or left out; a span is verified
by the share of the template's different runs it holds and, for fixed phrases and short notices, by every run of the phrase on one diagonal. Of
spans on neighbouring diagonals the best one counts, so fragments before or after a copy do not hide it.

The templates are a fixed short list, so their runs are broadcast. Votes are added up before they are shuffled; a document is at most one group of its own matches.
Null text is empty and has no words. Rows with one doc_id are told apart by their place in the input. An empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3  # words in a run; the shortest phrase has as many
DRIFT = 8  # diagonals this far apart can be one copy of a template
SPREAD = 2 * DRIFT + 1  # of all diagonals of one copy
LEAST_SHARE = 0.6  # of a template's runs
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# phrases of the contract and their labels
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# short notices as they stand in documents and SPDX forms, and their labels; all words of one must stand in a row
NOTICES = {
    "under the gnu general public license": "gpl", "under the gnu lesser general public license": "lgpl", "under the mozilla public license": "mpl-2", "under the bsd license": "bsd",
    "all rights reserved": "all-rights-reserved", "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution sharealike": "cc-by-sa", "creative commons zero": "cc0",
    "spdx license identifier mit": "mit", "spdx license identifier apache 2 0": "apache-2", "spdx license identifier gpl": "gpl", "spdx license identifier bsd": "bsd", "spdx license identifier isc": "isc",
}
# well-known passages of public license texts, and the label each one gives
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "GNU General Public License version 2 or any later version"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work"),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced"),
]
MASK = 63  # places of a template told apart by one number
N_MASKS = 1 + max(len(re.findall(WORD, t.lower())) for t in [*PHRASES, *NOTICES, *(t for _, t in TEMPLATES)]) // MASK
END = 0  # key of the row that every document has besides its runs


def words(text: Column) -> Column:
    """Lower-cased words. Only A-Z matter: no other letter is part of a template, but for the Kelvin sign, which would become k."""
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit("K"), F.lit("é"))), F.lit(WORD), F.lit(0))


def run_hashes(own: Column) -> Column:
    """Hashes of all runs of K words, by place."""
    n = F.size(own) - K + 1
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(own, i + j) for j in range(K)]))
    return F.when(n > 0, each).otherwise(F.array().cast("array<long>"))


def template_runs(spark: SparkSession) -> DataFrame:
    """template, label, fixed, n_runs, at, key: every run of every template; the phrases of the contract come first."""
    texts = [*((label, True, text) for text, label in [*PHRASES.items(), *NOTICES.items()]), *((label, False, text) for label, text in TEMPLATES)]
    rows = [(i, *t) for i, t in enumerate(texts)]
    own = spark.createDataFrame(rows, "template int, label string, fixed boolean, text string").select("template", "label", "fixed", run_hashes(words(F.col("text"))).alias("runs"))
    return own.select("template", "label", "fixed", F.size("runs").alias("n_runs"), F.posexplode("runs").alias("at", "key"))


def votes(docs: DataFrame) -> DataFrame:
    """row, doc_id, template, diagonal: votes, first and last place, and the voting places of the template as bits; and for each document one row of template -1 whose diagonal is its number of words."""
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words(F.coalesce(F.col("text"), F.lit(""))).alias("own"))
    # the number of words follows the runs as a key of its own, so that documents are read once
    keyed = own.select("row", "doc_id", F.size("own").alias("n_words"), F.posexplode(F.concat(run_hashes(F.col("own")), F.array(F.lit(END).cast("long")))).alias("place", "key"))
    spark = docs.sparkSession
    runs = template_runs(spark).select("template", "at", "key")
    runs = runs.unionByName(spark.range(1).select(F.lit(-1).alias("template"), F.lit(0).alias("at"), F.lit(END).cast("long").alias("key")))
    found = keyed.join(F.broadcast(runs), "key")
    place = F.when(F.col("template") < 0, F.col("n_words")).otherwise(F.col("place"))
    return (
        found.select("row", "doc_id", "template", (place - F.col("at")).alias("diagonal"), "place", "at")
        .groupBy("row", "doc_id", "template", "diagonal")
        .agg(F.count("*").alias("votes"), F.min("place").alias("first"), F.max("place").alias("last"), *[F.bit_or(F.expr(f"IF(at DIV {MASK} = {k}, shiftleft(1L, at % {MASK}), 0L)")).alias(f"at_{k}") for k in range(N_MASKS)])
    )


def license_spans(docs: DataFrame) -> DataFrame:
    """row, doc_id, template, label, fixed, first, last (words), share of the template; and the rows of template -1 with the number of words as ``first``.

    A fixed phrase stands where all its runs vote for one diagonal.
    """
    spark = docs.sparkSession
    known = template_runs(spark).select("template", "label", "fixed", "n_runs").distinct()
    known = known.unionByName(spark.range(1).select(F.lit(-1).alias("template"), F.lit("").alias("label"), F.lit(True).alias("fixed"), F.lit(1).alias("n_runs")))
    cast = votes(docs).join(F.broadcast(known), "template")
    by_place = Window.partitionBy("row", "doc_id", "template").orderBy("diagonal")
    apart = F.col("fixed") | (F.col("diagonal") - F.lag("diagonal").over(by_place) > DRIFT)
    chained = cast.withColumn("chain", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(by_place))
    in_chain = Window.partitionBy("row", "doc_id", "template", "chain").orderBy("diagonal")
    # from each diagonal on, what the next ones hold of the template; a fixed phrase is a chain of its own
    copy = in_chain.rangeBetween(0, SPREAD)
    held = sum((F.bit_count(F.bit_or(f"at_{k}").over(copy)) for k in range(N_MASKS)), F.lit(0))
    begin, end = F.min("first").over(copy), F.max("last").over(copy)
    spans = chained.select("row", "doc_id", "template", "label", "fixed", "chain", "diagonal", begin.alias("begin"), end.alias("end"), (held / F.col("n_runs")).alias("share"))
    own = F.struct("share", F.col("begin") - F.col("end"), -F.col("diagonal"))
    best = F.max(own).over(in_chain.rangeBetween(-SPREAD, SPREAD)) == own
    first = F.when(F.col("template") < 0, F.col("diagonal")).otherwise(F.col("begin"))
    spans = spans.withColumn("best", best).filter("best")
    spans = spans.select("row", "doc_id", "template", "label", "fixed", first.alias("first"), (F.col("end") + K - 1).alias("last"), "share")
    return spans.filter(F.when(F.col("fixed"), F.col("share") == 1).otherwise(F.col("share") >= LEAST_SHARE))


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: places of the phrases, labels, and the best share of a template."""
    base = F.col("template").between(0, len(PHRASES) - 1)
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return (
        license_spans(docs)
        .groupBy("row", "doc_id")
        .agg(
            F.max(F.when(F.col("template") < 0, F.col("first"))).cast("long").alias("n_words"),
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
            labels(base).alias("base_labels"),
            labels(F.col("template") >= 0).alias("labels"),
            F.coalesce(F.max(F.when(F.col("template") >= 0, F.col("share"))), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
