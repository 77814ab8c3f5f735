"""License scan by a positional index of rare tokens, in DataFrame expressions only.

Templates (licence notices, whole short licences, and exact phrases) are indexed by word
and position. A first pass counts in how many documents each licence word occurs; each
template is then looked up by its anchor, the word of highest IDF among its mandatory key
phrases (an exact phrase is its own key). As every key phrase must stand word for word, no
occurrence lacks the anchor, whatever else of it was changed. In the second pass each
anchor among a document's words proposes the place where its template would begin. The
proposal's own key phrase is verified there first, then the others, then the template's
postings are intersected with the document's words by relative position: a template word
counts if it stands within the template's shift of its place, so that inserted and left
out words do not lose what follows them. A notice needs MATCH of its words.

Everything after the count happens within a row, so nothing is shuffled or skewed, and
what reaches the driver is one count for each of the templates' words.

Defined cases: null text is empty; a text without words has n_words 0, null first_word
and last_word, empty label strings and score 0; overlapping places all count; repeated
rows each get their result; an empty table gives no rows; other columns pass through, and
columns named like the results are replaced by them.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH = 0.8
SHIFT = 4  # words by which a notice's words may stand off their places; a tenth of a longer template
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """exact: every word must match; else key phrases must, and MATCH of all words within shift of their places."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    exact: bool = False

    @property
    def words(self) -> list[str]:
        return words_of(self.text)

    @property
    def shift(self) -> int:
        return 0 if self.exact else max(SHIFT, len(self.words) // 10)

    @property
    def key_places(self) -> list[tuple[int, list[str]]]:
        """Where each mandatory phrase stands in the template."""
        if self.exact:
            return [(0, self.words)]
        found, total = [], self.words
        for key in self.keys:
            k = words_of(key)
            found.append((next(i for i in range(len(total)) if total[i : i + len(k)] == k), k))
        return found


def words_of(text: str) -> list[str]:
    lowered = text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return [w for w in re.split(_BREAK, lowered) if w]


# Phrases and notices with the labels they stand for.
PHRASES = (
    Template("mit", "under the mit license", exact=True),
    Template("apache-2", "apache license version 2", exact=True),
    Template("cc-by-nc", "cc by nc", exact=True),
)
NOTICES = (
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        ("permission is hereby granted", "free of charge"),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        ("redistribution and use", "binary forms"),
    ),
    Template(
        "apache-2",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE 2 0",
        ("in compliance with the license", "apache org licenses"),
    ),
    Template("gpl-3", "licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    Template("gpl-2", "licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    Template("lgpl-3", "licensed under the GNU Lesser General Public License, version 3", ("gnu lesser general public license", "version 3")),
    Template("agpl-3", "licensed under the GNU Affero General Public License, version 3", ("gnu affero general public license", "version 3")),
    Template("mpl-2", "subject to the terms of the Mozilla Public License, v 2 0", ("mozilla public license",)),
    Template("cc-by-sa", "licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
    Template("cc0", "dedicated to the public domain under CC0 1.0 Universal", ("public domain", "cc0")),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the"
        " Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,"
        " distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to"
        " the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions"
        " of the Software.",
        ("sublicense and or sell copies", "to deal in the software without restriction"),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are"
        " met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
        " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
        " documentation and/or other materials provided with the distribution.",
        ("must retain the above copyright notice", "must reproduce the above copyright notice"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the"
        " above copyright notice and this permission notice appear in all copies.",
        ("with or without fee is hereby granted",),
    ),
    Template(
        "zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute"
        " it freely, subject to the following restrictions: The origin of this software must not be misrepresented",
        ("alter it and redistribute it freely", "origin of this software"),
    ),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


def _words(text: str) -> Column:
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lowered, _BREAK), lambda w: w != "")


def document_counts(rows: DataFrame, text: str, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows each licence word occurs, over all rows; at most one count a word comes back."""
    held = rows.select(F.explode(F.array_intersect(_words(text), F.array(*map(F.lit, vocabulary)))).alias("w"))
    return {r.w: r.n for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}


def _anchor(template: Template, counts: dict[str, int]) -> tuple[int, list[str], int]:
    """(place, words) of the key phrase that holds the word of highest IDF, and that word's place in it."""
    return min(
        ((place, key, i) for place, key in template.key_places for i in range(len(key))),
        key=lambda x: (counts.get(x[1][x[2]], 0), x[0] + x[2]),
    )


def _at(words: Column, start: Column, wanted: list[str]) -> Column:
    """Whether the wanted words stand at start; a start before the text is none."""
    return F.when(start >= 0, F.slice(words, F.greatest(start, F.lit(0)) + 1, len(wanted)) == F.array(*map(F.lit, wanted))).otherwise(F.lit(False))


def _places(words: Column, hits: Column, template: Template, anchor: tuple[int, list[str], int]) -> Column:
    """Verified (start, score) of a template. hits: (i, w) of the row's anchor words. A notice may begin before the text (its start is then 0)."""
    place, key, nth = anchor
    total, shift = template.words, template.shift
    mine = F.filter(hits, lambda h: (h["w"] == key[nth]) & _at(words, h["i"] - nth, key))
    starts = F.transform(mine, lambda h: h["i"] - (place + nth))
    if template.exact:
        return F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(1.0).alias("score")))

    def holds(at: int, other: list[str]):
        return lambda s: F.exists(F.sequence(F.lit(at - shift), F.lit(at + shift)), lambda d: _at(words, s + d, other))

    for at, other in template.key_places:
        if at != place:
            starts = F.filter(starts, holds(at, other))
    listed = F.array(*map(F.lit, total))

    def there(s: Column, j: Column) -> Column:
        low = F.greatest(s + j - shift, F.lit(0))
        return F.array_contains(F.slice(words, low + 1, F.greatest(s + j + shift + 1 - low, F.lit(0))), F.get(listed, j))

    def score(s: Column) -> Column:
        return F.size(F.filter(F.sequence(F.lit(0), F.lit(len(total) - 1)), lambda j: there(s, j))) / F.lit(float(len(total)))

    scored = F.transform(starts, lambda s: F.struct(F.greatest(s, F.lit(0)).alias("start"), score(s).alias("score")))
    return F.filter(scored, lambda x: x["score"] >= MATCH)


def scan(rows: DataFrame, text: str = "text", phrases: tuple = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """rows with n_words, n_base, first_word, last_word, base_labels, labels, score and places (start and label of each)."""
    mine = {"n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"}
    rows = rows.drop(*(mine - {text}))
    vocabulary = sorted({w for t in (*phrases, *notices) for w in t.words})
    counts = document_counts(rows, text, vocabulary)
    anchors = {t: _anchor(t, counts) for t in (*phrases, *notices)}
    asked = sorted({key[nth] for _, key, nth in anchors.values()})
    hit = lambda w, i: F.when(w.isin(asked), F.struct(i.alias("i"), w.alias("w")))
    found = rows.withColumn("_words", _words(text)).withColumn(
        "_hits", F.filter(F.transform("_words", hit), lambda h: h.isNotNull())
    )
    words, hits = F.col("_words"), F.col("_hits")

    def labelled(templates: tuple) -> Column:
        def named(label: str):
            return lambda x: F.struct(x["start"].cast("long").alias("start"), F.lit(label).alias("label"), x["score"].alias("score"))

        each = [F.transform(_places(words, hits, t, anchors[t]), named(t.label)) for t in templates]
        empty = F.array().cast("array<struct<start:bigint,label:string,score:double>>")
        return F.when(F.size(hits) == 0, empty).otherwise(F.concat(*each))

    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    base, places = F.col("_base"), F.concat("_base", "_more")
    starts = F.transform(base, lambda x: x["start"])
    return (
        found.withColumns({"_base": labelled(phrases), "_more": labelled(notices), "n_words": F.size(words).cast("long")})
        .drop("_words", "_hits")
        .withColumns(
            {
                "n_base": F.size(base).cast("long"),
                "first_word": F.array_min(starts),
                "last_word": F.array_max(starts),
                "base_labels": joined(base),
                "labels": joined(places),
                "score": F.coalesce(F.array_max(F.transform(places, lambda x: x["score"])), F.lit(0.0)),
                "places": F.transform(places, lambda x: F.struct(x["start"], x["label"])),
            }
        )
        .drop("_base", "_more")
    )
