"""License scan by diagonal voting, in DataFrame functions only.

A text's words are lower-cased runs of ASCII letters and digits and of anything beyond ASCII. The
hashes of all runs of ``GRAM`` words are held against those of the templates (fixed lists of notices and of whole license texts,
so what is broadcast is bounded), and the runs found are joined to the positions that they have in the templates, word by word. A match votes for the diagonal, its place in the text minus
its place in the template. Votes are aggregated by diagonal into runs of consecutive places, and runs on neighbouring diagonals are merged: from every run
the longest chain of later runs is followed that keeps the template's order and whose diagonals lie above the first one's by half of the template's words at most (so many words may
be inserted, in one place or in several; any may be missing). A merged span is verified by the share of the template's places that it covers. Of
spans that share words, such as variants of one notice, those of the best cover stay; but a span that matches ``WHOLE_TIMES`` as much, such as a whole text around a notice, stays too.

Base phrases are counted beside that, wherever their words stand consecutively. Texts are read once; what is kept of them, with the runs found, is
written to the checkpoint folder with a number for each row, so rows that share an id don't meet.

Defined cases: a null text is empty, has no word, no label and score 0. Repeated rows have the same result each. All votes are used, however often a line occurs. Ids may be of any type.
"""

from __future__ import annotations

import re
from itertools import product

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspan.llm.common import checkpointed
from litspan.llm.license_texts import WHOLE

GRAM = 3
DRIFT = 2  # words that may be inserted into a template at least; half of its words if that is more
COVER = 0.6
WHOLE_TIMES = 4
NEAR = 8  # of the SQL only: there, of spans that start at most so many words apart those of the best cover count
#: Phrases whose places are counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Public license notices, by label.
TEMPLATES = {
    "agpl": "this program is licensed under the gnu affero general public license version 3",
    "apache-2.0": "licensed under the apache license version 2.0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc": "licensed under cc by-nc 4.0",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "gpl-2": "this work is licensed under the gnu general public license version 2",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl": "this library is licensed under the gnu lesser general public license version 2.1",
    "mit": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v. 2.0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
#: Other wordings of the notices, by label, ``/`` and a name.
VARIANTS = {
    "agpl/free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "apache-2.0/terms": "licensed under the terms of the apache license version 2.0",
    "gpl-2/free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-2/terms": "licensed under the terms of the gnu general public license version 2",
    "gpl-3/free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-3/terms": "licensed under the terms of the gnu general public license version 3",
    "lgpl/free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
    "mit/terms": "released under the terms of the mit license",
}
#: The spellings of what Creative Commons licenses add to their attribution.
ADDED = {"nc": ("noncommercial", "non commercial"), "nd": ("noderivatives", "no derivatives", "noderivs", "no derivs"), "sa": ("sharealike", "share alike")}


def _commons() -> dict[str, str]:
    """The names of the six licenses in all spellings, and their short forms."""
    out = {}
    for kinds in ((), ("nc",), ("nc", "nd"), ("nc", "sa"), ("nd",), ("sa",)):
        label = "-".join(("cc-by", *kinds))
        out[f"{label}/short"] = f"licensed under cc {label[3:]} 4.0"
        for k, words in enumerate(product(*(ADDED[x] for x in kinds))):
            out[f"{label}/name{k}"] = " ".join(["creative commons attribution", *words, "4.0 international license"])
    return out


WORDINGS = TEMPLATES | VARIANTS | _commons() | WHOLE
_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    """The words of a template."""
    return re.findall(_WORD, text.translate(str.maketrans(_UPPER, _LOWER)))


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def normalised(text: Column) -> Column:
    """The words of a text, one blank between and around them; two blanks if it has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(lower, _GAP, " ")), F.lit(" "))


def drift_of(words: list[str]) -> int:
    """Words that may be inserted into a template."""
    return max(DRIFT, (len(words) + 1) // 2)


def gram_hash(words: list[str]) -> int:
    """The hash that xxhash64 gives to some words."""
    h = 42
    for word in words:
        h = xxhash.xxh64_intdigest(word.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def template_grams(spark, templates: dict[str, str] = WORDINGS, gram: int = GRAM) -> DataFrame:
    """Columns template (its key), place, size (grams of the template), drift, hash, words."""
    rows = []
    for label, text in templates.items():
        words = words_of(text)
        rows += [(label, i, len(words) - gram + 1, drift_of(words), gram_hash(words[i : i + gram]), words[i : i + gram]) for i in range(len(words) - gram + 1)]
    return spark.createDataFrame(rows, "template string, place int, size int, drift int, hash long, words array<string>")


def base_places(line: str, words: str) -> list[Column]:
    """Base columns from a normalised line: n_base, first_word, last_word, and the labels' array."""
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE.items():
        text, needle = F.col(line), f" {phrase} "
        found = text.contains(needle)
        counts.append(F.when(found, F.regexp_count(text, F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0))
        firsts.append(F.when(found, _blanks(F.substring(text, F.lit(1), F.locate(needle, text))) - 1))
        back = F.reverse(text)
        after = _blanks(F.substring(back, F.lit(1), F.locate(needle[::-1], back))) - 1
        lasts.append(F.when(found, F.col(words) - after - len(phrase.split())))
        labels.append(F.when(found, F.lit(label)))
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    return [
        total.cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*labels))).alias("base"),
    ]


def found_grams(docs: DataFrame, id_column: str, text_column: str, templates: dict[str, str]) -> DataFrame:
    """One pass over the texts: row (a number), id, n_words, the base columns, and ``hits``, the grams that some template has (pos, hash, words)."""
    known = sorted({gram_hash(w[i : i + GRAM]) for w in map(words_of, templates.values()) for i in range(len(w) - GRAM + 1)})
    hashed = f"xxhash64({', '.join(f'w[i + {k}]' for k in range(GRAM))})"
    places = f"CASE WHEN size(w) >= {GRAM} THEN filter(sequence(0, size(w) - {GRAM}), i -> {hashed} IN ({', '.join(f'{h}L' for h in known) or 'NULL'})) END"
    lines = docs.select(F.col(id_column).alias("id"), normalised(F.col(text_column)).alias("line"))
    counted = lines.withColumn("n", F.when(F.col("line") == "  ", 0).otherwise(_blanks(F.col("line")) - 1))
    based = counted.select("id", F.col("n").cast("long").alias("n_words"), *base_places("line", "n"), F.split(F.btrim("line"), " ").alias("w"))
    hits = f"coalesce(transform({places}, i -> named_struct('pos', i, 'hash', {hashed}, 'words', slice(w, i + 1, {GRAM}))), array())"
    return based.select(F.monotonically_increasing_id().alias("row"), "id", "n_words", "n_base", "first_word", "last_word", "base", F.expr(hits).alias("hits"))


def spans_of(rows: DataFrame, templates: dict[str, str]) -> DataFrame:
    """Verified spans of rows with ``hits``: row, label, first_word, n_words, cover."""
    grams = rows.where(F.size("hits") > 0).select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    votes = grams.join(F.broadcast(template_grams(rows.sparkSession, templates)), ["hash", "words"])
    votes = votes.withColumn("diagonal", F.col("pos") - F.col("place"))
    key = ["row", "template"]
    run = F.col("place") - F.row_number().over(Window.partitionBy(*key, "diagonal").orderBy("place"))
    runs = votes.withColumn("run", run).groupBy(*key, "diagonal", "run").agg(F.min("place").alias("lo"), F.max("place").alias("hi"), F.first("size").alias("size"), F.first("drift").alias("drift"))
    runs = runs.withColumns({"start": F.col("lo") + F.col("diagonal"), "stop": F.col("hi") + F.col("diagonal")})
    reach = max((len(w) - GRAM + 1 + drift_of(w) for w in map(words_of, templates.values())), default=1)
    after = Window.partitionBy(*key).orderBy("start").rangeBetween(0, reach)
    seen = runs.withColumn("seen", F.collect_list(F.struct(F.col("stop").alias("s_stop"), F.col("lo").alias("s_lo"), F.col("hi").alias("s_hi"), F.col("diagonal").alias("s_diagonal"))).over(after))
    later = seen.withColumn("later", F.expr("filter(array_sort(seen), s -> s.s_stop > stop AND s.s_hi > hi AND s.s_diagonal - diagonal <= drift)"))
    able = later.where(F.expr(f"(hi - lo + 1 + aggregate(later, 0, (n, s) -> n + s.s_hi - s.s_lo + 1)) / size >= {COVER}"))
    # chains by their last run: grams, minus the last position, the last place; a run adds the places beyond those that its chain has
    gain = "(s.s_hi - greatest(s.s_lo, b.hi + 1, 1 - b.back - s.s_diagonal) + 1)"
    grown = f"array_max(transform(chains, b -> named_struct('n', CASE WHEN {gain} > 0 THEN b.n + {gain} ELSE 0 END, 'back', -s.s_stop, 'hi', s.s_hi)))"
    chain = f"array_max(aggregate(later, array(named_struct('n', hi - lo + 1, 'back', -stop, 'hi', hi)), (chains, s) -> concat(chains, array({grown}))))"
    fits = able.withColumn("chain", F.expr(chain)).select("row", F.substring_index("template", "/", 1).alias("label"), F.col("start").alias("lo"), (-F.col("chain.back")).alias("hi"), (F.col("chain.n") / F.col("size")).alias("cover"), F.col("chain.n").alias("n"))
    # a span hides those of a smaller cover that share a word with it
    near = Window.partitionBy("row").orderBy("lo").rangeBetween(-reach - GRAM, reach + GRAM)
    rivals = fits.where(F.col("cover") >= COVER).withColumn("rivals", F.collect_set(F.struct("lo", "hi", "cover", "n")).over(near))
    best = rivals.where(F.expr(f"NOT exists(rivals, r -> r.cover > cover AND {WHOLE_TIMES} * r.n >= n AND r.lo <= hi + {GRAM - 1} AND lo <= r.hi + {GRAM - 1})"))
    return best.select("row", "label", F.col("lo").cast("long").alias("first_word"), (F.col("hi") - F.col("lo") + GRAM).cast("long").alias("n_words"), "cover")


def spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", templates: dict[str, str] = WORDINGS) -> DataFrame:
    """Verified template spans: the id, label, first_word, n_words, cover."""
    rows = checkpointed(found_grams(docs, id_column, text_column, templates))
    return spans_of(rows, templates).join(rows.select("row", F.col("id").alias(id_column)), "row").select(id_column, "label", "first_word", "n_words", "cover")


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", templates: dict[str, str] = WORDINGS) -> DataFrame:
    """One row for each document: n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is 1 with a base phrase, else the best cover of a verified span, else 0.
    """
    rows = checkpointed(found_grams(docs, id_column, text_column, templates))
    found = spans_of(rows, templates).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"))
    both = rows.drop("hits").join(found, "row", "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return both.select(
        F.col("id").alias(id_column), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
    )
