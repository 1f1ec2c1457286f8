"""Licence scan by a positional rare-token index. DataFrame functions only.

Each licence template, a whole notice or header, is stored as postings of its rarest words with their places in the template;
rarity is the inverse document frequency over the scanned documents. A document looks up the index words that it holds: every
place of such a word votes for the offset place in document - place in template, and a template counts where all its
index words agree on one offset and all its mandatory key phrases stand in the text. All of this happens within a row, so after the
pass that counts document frequencies there is no shuffle.

Null and empty texts have no words, no places, empty labels and score 0. Repeated rows are scanned alike; other columns
of the input stay, but those of the result replace columns of the same name. Words of equal document frequency are taken in the
order of the words. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, lower_az, once

#: Phrase -> label; every place where the phrase's words stand consecutively counts.
PHRASES: Mapping[str, str] = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


class Template(NamedTuple):
    """A licence text without what users fill in; keys are phrases, in words of the rule below, that have to stand in the document."""

    label: str
    text: str
    keys: tuple[str, ...]


# Notices and headers as the licences' stewards publish them, and short forms that are in use.
TEMPLATES: tuple[Template, ...] = (
    Template("gpl", "This work is licensed under the GNU General Public License version 3", ("gnu general public license",)),
    Template("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""", ("gnu general public license", "free software foundation")),
    Template("gpl", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""", ("gnu general public license", "free software foundation")),
    Template("lgpl", "This library is licensed under the GNU Lesser General Public License version 3", ("lesser general public license",)),
    Template("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""", ("lesser general public license", "free software foundation")),
    Template("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""", ("affero general public license",)),
    Template("apache", "Licensed under the Apache License, Version 2.0", ("apache license",)),
    Template("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
        License for the specific language governing permissions and limitations under the License.""", ("apache license", "without warranties or conditions of any kind")),
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", ("permission is hereby granted",)),
    Template("mit-grant", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
        sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
        ("permission is hereby granted", "shall be included in all copies or substantial portions of the software")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("source and binary forms",)),
    Template("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in
        binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
        provided with the distribution.""", ("source and binary forms", "redistributions in binary form")),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies.""", ("with or without fee is hereby granted",)),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License", ("mozilla public license",)),
    Template("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
        You can obtain one at https://mozilla.org/MPL/2.0/.""", ("mozilla public license",)),
    Template("boost", "Distributed under the Boost Software License, Version 1.0.", ("boost software license",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain.", ("unencumbered software",)),
    Template("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising
        from the use of this software. Permission is granted to anyone to use this software for any purpose""", ("permission is granted to anyone to use this software",)),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    Template("cc-by", "licensed under CC BY 4.0", ("cc by",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Template("cc-by-nc", "licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike",)),
    Template("all-rights-reserved", "All rights reserved", ("all rights reserved",)),
)
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD_RUNS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def template_words(t: Template) -> list[str]:
    return re.sub(SEPARATORS, " ", t.text.lower()).split()


def padded_words(text: Column) -> Column:
    """Lower-cased words, each between two blanks, so that neighbouring phrases never share a blank: " a  b ".

    Only A-Z matter, as all phrases are ASCII; lower() is the quick way, and the one non-ASCII character that it would
    turn into an ASCII word character, the Kelvin sign, takes the exact way.
    """
    words = F.concat(F.lit(" "), F.replace(F.trim(F.regexp_replace(text, SEPARATORS, " ")), F.lit(" "), F.lit("  ")), F.lit(" "))
    return F.when(text.contains("\u212a"), lower_az(words)).otherwise(F.lower(words))


def _padded(phrase: str) -> str:
    return " " + "  ".join(phrase.split()) + " "


def _starts(words: Column, phrase: str) -> Column:
    """All start places of a phrase in an array of words, overlapping ones too."""
    parts = phrase.split()

    def fits(_: Column, i: Column) -> Column:
        return reduce(and_, [F.coalesce(F.get(words, i + k) == part, F.lit(False)) for k, part in enumerate(parts)])

    marked = F.transform(words, lambda w, i: F.when(fits(w, i), i.cast("long")))
    return F.filter(marked, lambda i: i.isNotNull())


def rare_index(docs: DataFrame, templates: Sequence[Template], per_template: int) -> list[dict[str, list[int]]]:
    """For each template its rarest words and their places in it; ties by word.

    Frequencies cover all documents; their number is that of the templates' words, so they fit the driver.
    """
    vocabulary = sorted({w for t in templates for w in template_words(t) if not w.isdigit()})
    found = F.array_intersect(F.split(padded_words(F.col("text")), " +"), F.array(*[F.lit(w) for w in vocabulary]))
    df = {r["word"]: r["n"] for r in docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    out = []
    for t in templates:
        words = template_words(t)
        rare = sorted({w for w in words if not w.isdigit()}, key=lambda w: (df.get(w, 0), w))[:per_template]
        out.append({w: [i for i, x in enumerate(words) if x == w] for w in rare})
    return out


def license_scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Sequence[Template] = TEMPLATES, per_template: int = 3) -> DataFrame:
    """docs (text, ...) -> its columns with n_words, n_base, first_word, last_word, base_labels, labels, score.

    per_template: rare words of a template that the index holds, all of which have to agree on an offset. A document looks
    up all its index words, so one text may hold every template. score: 1 with a template, 0.6 with base phrases only, else 0.
    """
    index = rare_index(docs, templates, per_template)
    none = F.array().cast("array<long>")

    def named(flags: list[Column]) -> Column:
        return F.array_sort(F.array_distinct(F.filter(F.array(*flags), lambda x: x.isNotNull())))

    def agree(words: Column, postings: dict[str, list[int]]) -> Column:
        """Whether one offset has the votes of all index words of a template."""
        def offsets(word: str, places: list[int]) -> Column:
            at = F.filter(F.transform(words, lambda w, i: F.when(w == word, i)), lambda i: i.isNotNull())
            return once(at, lambda held: F.flatten(F.transform(F.array(*map(F.lit, places)), lambda p: F.transform(held, lambda i: i - p))))

        return F.size(reduce(F.array_intersect, [offsets(w, places) for w, places in postings.items()])) > 0

    def facts(text: Column) -> Column:
        has = [text.contains(_padded(p)) for p in phrases]
        looks = [reduce(and_, [text.contains(_padded(p)) for p in (*t.keys, *postings)]) for t, postings in zip(templates, index)]
        words = F.when(reduce(or_, has + looks), F.split(F.trim(text), " +"))

        def of(ws: Column) -> Column:
            starts = F.flatten(F.array(*[F.when(h, _starts(ws, p)).otherwise(none) for h, p in zip(has, phrases)]))
            base = named([F.when(h, F.lit(label)) for h, label in zip(has, phrases.values())])
            found = named([F.when(look, F.when(agree(ws, postings), F.lit(t.label))) for look, t, postings in zip(looks, templates, index)])
            return F.when(ws.isNotNull(), F.struct(starts.alias("starts"), base.alias("base"), found.alias("found")))

        return once(words, of)

    held = fresh(docs, "facts")[0]
    n_words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD_RUNS)), F.lit(0)).cast("long")
    out = docs.withColumn(held, once(F.coalesce(padded_words(F.col("text")), F.lit("")), facts))
    starts, base, found = (F.coalesce(F.col(f"{held}.{k}"), F.array().cast(f"array<{kind}>")) for k, kind in (("starts", "long"), ("base", "string"), ("found", "string")))
    return (
        out.withColumn("n_words", n_words).withColumn("n_base", F.size(starts).cast("long"))
        .withColumn("first_word", F.array_min(starts)).withColumn("last_word", F.array_max(starts))
        .withColumn("base_labels", F.array_join(base, ",")).withColumn("labels", F.array_join(F.array_sort(F.array_union(base, found)), ","))
        .withColumn("score", F.when(F.size(found) > 0, 1.0).when(F.size(base) > 0, 0.6).otherwise(0.0)).drop(held)
    )
