"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

A template of t words is looked for in windows of 2t words that start every t words, so every t consecutive words lie
inside one window. A window and a template that it holds whole share at least (t - s + 1) of (2t - s + 1) shingles of s
words; with single-row bands, as many as there are hash functions, they collide in some band with a probability of
1 - (1 - J)^bands, over 0.9999 for the shortest template and all bands. What collides is verified: the share of the
template's different shingles that the window has must reach the threshold.

Only a window that has one of the template's shingles can collide with it, so windows are formed only around such
shingles, and the result is the same. All of it is one expression over a row, in DataFrame functions only: a document is
never shuffled, and a hot source or a common license line stays where it is read. The templates are a fixed list.
"""

from __future__ import annotations

from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statements of public licenses, by identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted",
    "MIT": "Released under the MIT License",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "reserved": "All rights reserved",
}

# Parameters: words in a shingle (shorter templates are one shingle), bands of one row, containment.
SHINGLE, BANDS, CONTAINMENT = 5, 64, 0.8
SEPARATOR = r"[^\p{L}\p{N}]+"


@dataclass(frozen=True)
class Template:
    """A statement's words, cut into shingles."""

    name: str
    words: tuple[str, ...]

    @property
    def width(self) -> int:
        return min(SHINGLE, len(self.words))

    @property
    def shingles(self) -> list[str]:
        return sorted({" ".join(self.words[i : i + self.width]) for i in range(len(self.words) - self.width + 1)})


def template_words(text: str) -> tuple[str, ...]:
    return tuple("".join(c if c.isalnum() else " " for c in text.lower()).split())


def templates(texts: dict[str, str] | None = None) -> list[Template]:
    return [Template(name, template_words(text)) for name, text in (texts or TEMPLATES).items()]


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def signed_hash(text: str, seed: int = 42) -> int:
    """The same number as the engine's 64-bit hash of the text."""
    number = xxhash.xxh64_intdigest(text.encode(), seed)
    return number - 2**64 if number >= 2**63 else number


def shingle_at(words: Column, at: Column, width: int) -> Column:
    """Hash of the shingle of width words that starts at a place."""
    return F.xxhash64(F.array_join(F.slice(words, at + 1, width), " "))


def starts(first: Column, behind: Column) -> Column:
    """Whole numbers from first up to but without behind."""
    return F.when(behind > first, F.sequence(first, behind - 1)).otherwise(F.array().cast("array<int>"))


def found_in(words: Column, wanted: list[Template], containment: float, bands: int) -> Column:
    """Array of (license, first_word, containment) of every window that holds a template, for a word array."""
    return F.flatten(
        F.array(*[
            _by_width(words, [t for t in wanted if t.width == width], width, containment, bands)
            for width in sorted({t.width for t in wanted})
        ])
    )


def _by_width(words: Column, wanted: list[Template], width: int, containment: float, bands: int) -> Column:
    anchors = sorted({signed_hash(s) for t in wanted for s in t.shingles})
    places = F.filter(
        starts(F.lit(0), F.size(words) - width + 1), lambda i: shingle_at(words, i, width).isin(anchors)
    )

    def around(places: Column) -> Column:
        return F.flatten(F.array(*[_windows(words, places, t, containment, bands) for t in wanted]))

    # The array of one binds the places to a variable, so that they are looked up once for all templates.
    return F.flatten(F.transform(F.array(places), around))


def _windows(words: Column, places: Column, wanted: Template, containment: float, bands: int) -> Column:
    """Windows around places that collide with the template in a band and hold enough of its shingles."""
    stride, width = len(wanted.words), wanted.width
    own = [signed_hash(s) for s in wanted.shingles]
    near = F.filter(places, lambda i: shingle_at(words, i, width).isin(own))
    numbers = F.array_distinct(
        F.flatten(F.transform(near, lambda i: F.array(F.floor(i / stride), F.floor(i / stride) - 1)))
    )
    shingles = F.array(*[F.lit(h) for h in own])

    def window(number: Column) -> Column:
        first = (number * stride).cast("int")
        behind = F.least(first + 2 * stride, F.size(words)) - width + 1
        held = F.transform(starts(first, behind), lambda i: shingle_at(words, i, width))
        return F.struct(first.alias("first_word"), held.alias("held"))

    formed = F.transform(F.filter(numbers, lambda k: k >= 0), window)
    retrieved = F.filter(formed, lambda w: _collides(w["held"], shingles, bands))
    share = lambda w: F.size(F.array_intersect(w["held"], shingles)) / len(own)
    verified = F.filter(retrieved, lambda w: share(w) >= containment)
    return F.transform(
        verified,
        lambda w: F.struct(
            F.lit(wanted.name).alias("license"), w["first_word"].alias("first_word"), share(w).alias("containment")
        ),
    )


def _collides(window: Column, template: Column, bands: int) -> Column:
    """Whether the smallest hash of both is the same in some band."""

    def least(shingles: Column, band: Column) -> Column:
        return F.array_min(F.transform(shingles, lambda h: F.xxhash64(band, h)))

    return F.exists(F.sequence(F.lit(1), F.lit(bands)), lambda b: least(window, b) == least(template, b))


def licenses(
    docs: DataFrame,
    texts: dict[str, str] | None = None,
    containment: float = CONTAINMENT,
    bands: int = BANDS,
) -> DataFrame:
    """doc_id, license, containment, first_word and n_windows: one row per document and license found in its whole text.

    docs has rows (doc_id, text); texts are templates by identifier, the public ones unless given. A word is a lower-case
    run of letters and digits. containment is the largest share of the template's shingles in one window, first_word the
    start of the first window found. Null and empty texts hold nothing; repeated rows with one doc_id are one document, as
    are rows without an id; other columns are ignored; an empty table gives no rows.
    """
    wanted = templates(texts)
    bound = F.transform(F.array(words_of(F.col("text"))), lambda w: found_in(w, wanted, containment, bands))
    rows = docs.select("doc_id", F.explode(F.flatten(bound)).alias("f"))
    return rows.groupBy("doc_id", F.col("f.license").alias("license")).agg(
        F.max("f.containment").alias("containment"),
        F.min("f.first_word").alias("first_word"),
        F.count("*").alias("n_windows"),
    )


def oracle(texts: dict[str, str] | None = None, containment: float = CONTAINMENT) -> str:
    """DuckDB SQL for the same rows: every window of every text is held against every template, without hashing."""
    wanted = templates(texts)
    lists = ", ".join(
        f"('{t.name}', {len(t.words)}, {t.width}, [{', '.join(repr(s) for s in t.shingles)}])" for t in wanted
    )
    return f"""
        WITH template(license, t, s, shingles) AS (VALUES {lists}),
        split AS (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '{SEPARATOR}') AS w FROM documents),
        doc AS (SELECT doc_id, [x FOR x IN w IF x <> ''] AS w FROM split),
        place AS (SELECT doc_id, s, unnest(range(1, len(w) - s + 2)) AS i, w FROM doc, (SELECT DISTINCT s FROM template)
                  WHERE len(w) >= s),
        shingle AS (SELECT doc_id, s, i - 1 AS i, array_to_string(w[i:i + s - 1], ' ') AS g FROM place),
        hit AS (SELECT h.doc_id, x.license, x.t, h.i, h.g, h.s FROM shingle h JOIN
                (SELECT license, t, s, unnest(shingles) AS g FROM template) x ON x.g = h.g AND x.s = h.s),
        held AS (SELECT doc_id, license, k * t AS first_word, g FROM
                 (SELECT *, unnest([i // t, i // t - 1]) AS k FROM hit) WHERE k >= 0 AND i + s <= k * t + 2 * t),
        win AS (SELECT doc_id, license, first_word, count(DISTINCT g) AS n FROM held GROUP BY ALL),
        enough AS (SELECT doc_id, win.license, first_word, n / len(shingles) AS containment
                   FROM win JOIN template USING (license) WHERE n / len(shingles) >= {containment})
        SELECT doc_id, license, max(containment) AS containment, min(first_word)::INTEGER AS first_word, count(*) AS n_windows
        FROM enough GROUP BY doc_id, license
    """
