"""License scans: normalised units of a text against licence templates by the Dice coefficient of word bigrams.

Units are the lines, the paragraphs (runs of lines between blank ones) and the whole text; and, in what is left
without the units that matched, windows of words sized to each template, across lines and paragraphs.  A template
can reach the threshold only if the numbers of bigrams are alike, so units of other sizes are never compared with
it; and only units that hold enough bigrams of any template are compared at all.  Everything is a built-in
Spark expression within one row: no shuffle.

A window is as long as its template, or longer up to the size bound.  Only windows that begin or end with a run of the
template's bigrams are compared: another one of the same length has no more of them, repeats apart.
"""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm._common import once, spare

THRESHOLD = 0.8
#: A word in place of a matched unit.
GAP = "\u2060\u2060"

# Notices and short texts of public licences.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_NAMED = {"MIT": "the MIT License", "ISC": "the ISC License", "BSD-2-Clause": "the BSD 2-Clause License", "BSD-3-Clause": "the BSD 3-Clause License", "Apache-2.0": "the Apache License, Version 2.0", "MPL-2.0": "the Mozilla Public License, version 2.0", "GPL-2.0": "the GNU General Public License, version 2", "GPL-3.0": "the GNU General Public License, version 3", "LGPL-3.0": "the GNU Lesser General Public License, version 3", "AGPL-3.0": "the GNU Affero General Public License, version 3", "Unlicense": "the Unlicense", "CC0-1.0": "CC0 1.0", "CC-BY-4.0": "CC BY 4.0", "CC-BY-SA-4.0": "CC BY-SA 4.0", "CC-BY-NC-4.0": "CC BY-NC 4.0", "CC-BY-ND-4.0": "CC BY-ND 4.0"}
_FORMS = ("Licensed under {0}.", "Released under {0}.", "This work is licensed under {0}.", "This software is released under {0}.", "Distributed under {0}.")


def templates() -> list[tuple[str, str]]:
    """(licence, text): the notices of each named licence, the longer notices, and the full texts in licence_texts."""
    out = [(name, form.format(title)) for name, title in _NAMED.items() for form in _FORMS]
    out += [("MIT", _MIT), ("ISC", _ISC), ("BSD-2-Clause", _BSD2), ("Apache-2.0", _APACHE), ("MPL-2.0", _MPL), ("Unlicense", _UNLICENSE)]
    out += [(f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]
    return out + [(name, _GPL.format(kind, version)) for name, kind, version in (("GPL-2.0", "", 2), ("GPL-3.0", "", 3), ("LGPL-3.0", "Lesser ", 3), ("AGPL-3.0", "Affero ", 3))]


def normalised(text: str) -> list[str]:
    """The words of a template: lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    import re

    return [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.lower()) if w]


def bigrams(words: list[str]) -> list[str]:
    """The distinct pairs of neighbours, sorted."""
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


_SPLIT = r"'[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'"


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _words(text: str) -> str:
    """SQL of the normalised words of a text; only its first and last part can be empty."""
    return f"array_remove(split(lower({text}), {_SPLIT}), '')"


def _places(words: str, grams: list[str]) -> str:
    """SQL of the (p, g) of the bigrams among grams, from 1 on; most words begin none of them, so few pairs are spelled out."""
    pair = f"concat(`{words}`[i - 1], ' ', `{words}`[i])"
    heads = sorted({g.split(" ")[0] for g in grams})
    all_of = f"IF(size(`{words}`) >= 2, sequence(1, size(`{words}`) - 1), CAST(array() AS array<int>))"
    return f"transform(filter({all_of}, i -> `{words}`[i - 1] IN ({','.join(map(_text, heads))}) AND {pair} IN ({','.join(map(_text, grams))})), i -> struct(i AS p, {pair} AS g))"


def scan(docs: DataFrame, *, text_col: str = "text", known: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with ``licenses``: an array of (license, dice, unit), each unit's best templates that reach the threshold.

    dice is 2 |A and B| / (|A| + |B|) over the distinct word bigrams of unit and template; a unit of one word has
    none and matches nothing.  Of equal dice the license first by name counts.  Equal units of a text count once.
    Windows follow, as their normalised words: of those that overlap, the one that shares most bigrams counts.
    Null and empty texts have no units.  A column of docs named licenses is replaced, all others stay.
    """
    known = templates() if known is None else known
    made: dict[tuple[str, tuple[str, ...]], int] = {(name, tuple(g)): len(w) - 1 for name, text in known if (g := bigrams(w := normalised(text)))}
    if not made:
        return docs.withColumn("licenses", F.expr("CAST(array() AS array<struct<license: string, dice: double, unit: string>>)"))
    # least: the bigrams that a unit or window shares at least with a template that it matches
    table = [{"license": n, "n": len(g), "m": m, "least": math.ceil(threshold / (2 - threshold) * len(g) - 1e-6), "grams": list(g)} for (n, g), m in sorted(made.items())]
    known_sql = f"from_json({_text(json.dumps(table, ensure_ascii=True))}, 'array<struct<license: string, n: int, m: int, least: int, grams: array<string>>>')"
    sizes = [t["n"] for t in table]
    lo, hi = min(t["least"] for t in table), math.floor((2 - threshold) / threshold * max(sizes) + 1e-6)
    grams = sorted({g for _, gs in made for g in gs})
    line = "split(t, '\\\\n')"
    para = "split(t, '\\\\n[ \\\\t\\\\r]*\\\\n')"
    units = f"array_distinct(concat({line}, {para}, array(t)))"
    # a unit of w words has w - 1 bigrams at most, and at least as many bytes as words; sizes out of bounds fall here
    sized = f"filter({units}, u -> length(u) >= {2 * lo})"
    paired = "array_distinct(transform(sequence(1, size(w) - 1), i -> concat(w[i - 1], ' ', w[i])))"
    as_grams = f"transform({sized}, u -> transform(array({_words('u')}), w -> struct(u AS unit, IF(size(w) > {lo} AND size(w) >= 2, {paired}, CAST(array() AS array<string>)) AS g))[0])"
    held = f"size(filter(x.g, y -> y IN ({','.join(map(_text, grams))})))"
    near = f"filter({as_grams}, x -> size(x.g) >= {lo} AND size(x.g) <= {hi} AND {held} * 2 >= {threshold} * (size(x.g) + {min(sizes)}))"
    size_bound = f"filter({known_sql}, k -> 2 * least(k.n, size(x.g)) >= {threshold} * (k.n + size(x.g)))"
    scored = f"transform({size_bound}, k -> struct(-(2 * size(array_intersect(x.g, k.grams)) / (k.n + size(x.g))) AS d, k.license AS license))"
    best = f"transform({near}, x -> struct(x.unit AS unit, array_min({scored}) AS best))"
    result = f"transform(filter({best}, x -> x.best IS NOT NULL AND -x.best.d >= {threshold}), x -> struct(x.best.license AS license, CAST(-x.best.d AS DOUBLE) AS dice, x.unit AS unit))"
    whole: Column = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    tmp, rest, hits, able, found = spare(docs, "licenses_text_", "licenses_words_", "licenses_hits_", "licenses_able_", "licenses_found_")
    none = "CAST(array() AS array<struct<license: string, dice: double, unit: string>>)"
    df = once(docs.withColumn(tmp, whole), **{rest: F.expr(_words(f"`{tmp}`"))})
    df = once(df, **{hits: F.expr(_places(rest, grams))})
    # no unit or window has a template's bigram that its text lacks: texts that share too few with every template end here
    enough = f"exists(filter({known_sql}, k -> k.least <= size(o)), k -> size(array_intersect(k.grams, o)) >= k.least)"
    df = once(df, **{able: F.expr(f"transform(array(array_distinct(`{hits}`.g)), o -> {enough})[0]")})
    df = once(df, **{found: F.expr(f"IF(`{able}`, transform(array(`{tmp}`), t -> {result})[0], {none})")})
    # the words left: a matched unit gives way to a word that no template has
    left = f"aggregate(`{found}`, `{tmp}`, (t, x) -> replace(t, x.unit, ' {GAP} '))"
    df = once(df, **{rest: F.expr(f"IF(size(`{found}`) > 0, {_words(left)}, `{rest}`)")})
    df = once(df, **{hits: F.expr(f"IF(size(`{found}`) > 0, {_places(rest, grams)}, `{hits}`)")})
    more = f"transform({_windows(hits, rest, known_sql, threshold)}, x -> struct(x.license AS license, CAST(-x.d AS DOUBLE) AS dice, array_join(slice(`{rest}`, x.s, x.e - x.s + 2), ' ') AS unit))"
    return once(df, licenses=F.array_distinct(F.concat(found, F.expr(f"IF(`{able}`, {more}, {none})")))).drop(tmp, rest, hits, able, found)


#: Lengths of windows, in those of their template: texts that were added to are longer.
LENGTHS = (1.0, 1.15, 1.3, 1.45)


def _windows(hits: str, words: str, known_sql: str, threshold: float) -> str:
    """SQL of the windows that reach the threshold and do not overlap, each from bigram s to bigram e (from 1 on), out of
    the (p, g) of the bigrams that any template has.

    For each template, windows of LENGTHS begin or end with a run of its bigrams.  How many of its bigrams lie in a window
    is counted for all windows at once, by sorting their ends in among the places of the bigrams, so the work grows with the
    places and not with their square.  Windows are then taken by that count over the sizes of
    both, of equal ones the shortest, and only those that meet no window taken
    before are compared with the template."""
    last = f"size(`{words}`) - 1"
    # the shared bigrams are counted by hash first: only templates that have enough of them are looked through for each place
    able = f"transform(array(array_distinct(`{hits}`.g)), d -> filter({known_sql}, k -> size(d) >= k.least AND k.m <= {last} AND size(array_intersect(d, k.grams)) >= k.least))[0]"
    enough = f"transform({able}, k -> struct(k AS k, filter(`{hits}`, x -> array_contains(k.grams, x.g)) AS o))"
    heads = "filter(x.o.p, (p, i) -> i = 0 OR x.o[i - 1].p < p - 1)"
    tails = "filter(x.o.p, (p, i) -> i = size(x.o) - 1 OR x.o[i + 1].p > p + 1)"
    sizes = f"array_distinct(filter(transform(array({', '.join(f'{f}D' for f in LENGTHS)}), f -> CAST(ceil(x.k.m * f) AS INT)), n -> n <= {last}))"
    spans = f"array_distinct(flatten(transform({sizes}, n -> concat(transform(filter({heads}, s -> s + n - 1 <= {last}), s -> struct(s AS s, s + n - 1 AS e)), transform(filter({tails}, e -> e >= n), e -> struct(e - n + 1 AS s, e AS e))))))"

    def upto(bound: str, side: int) -> str:
        """For each window in order, how many places lie before its bound, the bound included where side is 1."""
        among = f"array_sort(concat(transform(x.o.p, p -> struct(p AS v, 0 AS t, -1 AS i)), transform(w, (y, i) -> struct(y.{bound} AS v, {side} AS t, i AS i))))"
        own = f"filter(transform({among}, (y, j) -> struct(y.i AS i, j AS j)), y -> y.i >= 0)"
        return f"transform(array_sort(transform({own}, (y, n) -> struct(y.i AS i, y.j - n AS c))), y -> y.c)"

    counted = f"transform(array(struct({upto('e', 1)} AS z, {upto('s', -1)} AS a)), u -> transform(w, (y, i) -> struct(-((u.z[i] - u.a[i]) / (x.k.n + y.e - y.s + 1)) AS q, y.e - y.s AS n, y.s AS s, y.e AS e, u.z[i] - u.a[i] AS c)))[0]"
    full = f"array_sort(filter(transform(array({spans}), w -> {counted})[0], y -> y.c >= x.k.least))"
    gram = f"array_distinct(transform(sequence(y.s, y.e), i -> concat(`{words}`[i - 1], ' ', `{words}`[i])))"
    shared = "transform(array(size(array_intersect(g, x.k.grams))), c -> struct(-c AS c, -(2 * c / (x.k.n + size(g))) AS d, x.k.license AS license, y.s AS s, y.e AS e))[0]"
    judged = f"transform(transform(array({gram}), g -> {shared}), r -> IF(-r.d >= {threshold}D, concat(a, array(r)), a))[0]"
    none = "CAST(array() AS array<struct<c: int, d: double, license: string, s: int, e: int>>)"
    taken = f"aggregate({full}, {none}, (a, y) -> IF(exists(a, v -> v.s <= y.e AND y.s <= v.e), a, {judged}))"
    found = f"flatten(transform({enough}, x -> {taken}))"
    kept = "aggregate(slice(f, 2, size(f)), slice(f, 1, 1), (a, w) -> IF(exists(a, v -> v.s <= w.e AND w.s <= v.e), a, concat(a, array(w))))"
    return f"transform(array(array_sort({found})), f -> {kept})[0]"
