"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment confirms them.

Templates and texts are cut into windows of a few fixed widths, texts at every half width and templates at every
word. Each of ``BANDS`` bands is one minimum, so two windows of similarity J meet in some band with
probability 1 - (1 - J) ** BANDS. A stated template lies in text windows of similarity 1/4 at least (its
half-width steps cut off no more), which meet in 9,999 of 10,000 cases in one window; longer ones in many.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import kernels as K

SHINGLE, BANDS, WIDTHS = 5, 32, (8, 32, 128)
#: Most rows of a template table: it goes to every task.
MOST_TEMPLATES = 10_000

#: Usual notices and short statements of public licenses (fixed values).
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "mit": "Released under the MIT License.",
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "bsd-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    # Notices that differ in a version only are cut to the words around it, so that one is not found in the other.
    "gpl-2.0": "GNU General Public License, version 2",
    "gpl-2.0-notice": "Free Software Foundation; either version 2 of the License",
    "lgpl": "terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "lgpl-2.1": "GNU Lesser General Public License, version 2.1",
    "lgpl-2.1-notice": "Free Software Foundation; either version 2.1 of the License",
    "lgpl-3.0": "GNU Lesser General Public License, version 3",
    "agpl": "terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "agpl-3.0": "GNU Affero General Public License, version 3",
    "gfdl": "copy, distribute and/or modify this document under the terms of the GNU Free Documentation License",
    "bsd": "Released under the BSD License.",
    "bsd-3-clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission"
    ),
    "bsd-disclaimer": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"
    ),
    "isc-notice": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies"
    ),
    "isc": "Licensed under the ISC License.",
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "zlib": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions"
    ),
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/"
    ),
    "epl-1.0": "made available under the terms of the Eclipse Public License v1.0",
    "cc0-1.0": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights",
    "cc0-1.0-short": "Licensed under CC0 1.0 Universal.",
    "cc-by-4.0-short": "Licensed under CC BY 4.0.",
    "cc-by-nd-4.0-short": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-4.0-short": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-4.0-short": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-sa-4.0-notice": "Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nd-4.0": "Creative Commons Attribution-NoDerivatives 4.0 International License",
    "cc-by-nc-4.0-notice": "Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-nc-sa-4.0": "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "cc-by-nc-nd-4.0": "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
}
#: Full texts of licenses, a file each.
TEMPLATES |= {f"{p.stem}-text": p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def _plain(data: np.ndarray) -> np.ndarray:
    """Lower case; every ASCII byte that is no letter or digit becomes a blank."""
    table = K.lower_ascii(np.arange(256, dtype=np.uint8))
    keep = [*range(48, 58), *range(97, 123), *range(128, 256)]
    mask = np.full(256, 32, np.uint8)
    mask[keep] = keep
    return mask[table][data]


def _shingles(texts: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(shingle prints in text order, first shingle of each text); texts of fewer than 5 words have none."""
    data = _plain(texts.data)
    start, end, first = K.words_of(data, texts.offsets)
    count = (np.diff(first) - SHINGLE + 1).clip(0)
    at = K.ragged(first[:-1], count)
    return K.span_prints(K.prefix_sums(K.word_prints(data, start, end)), at, at + SHINGLE), np.concatenate(([0], np.cumsum(count)))


def _windows(first: np.ndarray, width: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, text) of windows of ``width`` words at every ``step`` words, the last ones shorter."""
    size = np.diff(first)
    n = -(-size // step)
    text = np.repeat(np.arange(len(size)), n)
    begin = K.ragged(np.zeros(len(size), np.int64), n) * step + first[text]
    return begin, np.minimum(begin + width - SHINGLE + 1, first[text + 1]), text


def _factors() -> np.ndarray:
    return K.mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)) | np.uint64(1)


def _minima(shingles: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[np.ndarray]:
    """Per band the minimum of each window."""
    edges = np.column_stack((begin, end)).ravel()
    for factor in _factors():
        # The sentinel lets the last window end at the end of the array.
        yield np.minimum.reduceat(np.append(shingles * factor, np.uint64((1 << 64) - 1)), edges)[::2]


@dataclass
class Index:
    """The templates' names and shingle sets, and per window width the band keys of all their windows."""

    names: list[str]
    sets: list[np.ndarray]
    tables: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]

    def candidates(self, shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct (text, template) pairs of which some windows meet in a band."""
        pairs = [np.zeros((0, 2), np.int64)]
        for width, bands in self.tables.items():
            begin, end, text = _windows(first, width, width // 2)
            if not len(begin):
                continue
            for (quick, keys, owner), found in zip(bands, _minima(shingles, begin, end), strict=True):
                at = np.flatnonzero(quick[(found >> np.uint64(20)).astype(np.int64) & 0xFFFF])
                low, high = np.searchsorted(keys, found[at], "left"), np.searchsorted(keys, found[at], "right")
                pairs.append(np.column_stack((np.repeat(text[at], high - low), owner[K.ragged(low, high - low)])))
        return np.unique(np.concatenate(pairs), axis=0)


def build_index(names: list[str], texts: list[str]) -> Index:
    shingles, first = _shingles(K.Texts(pa.array(texts, pa.string())))
    size = np.diff(first)
    widths = np.array([max((w for w in WIDTHS if w <= n + SHINGLE - 1), default=WIDTHS[0]) for n in size])
    tables: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for width in sorted(set(widths[size > 0].tolist())):
        begin, end, owner = _windows(first, width, 1)
        use = (widths[owner] == width) & ((end - begin == width - SHINGLE + 1) | (begin == first[owner]))
        begin, end, owner = begin[use], end[use], owner[use]
        tables[width] = []
        for keys in _minima(shingles, begin, end):
            order = np.argsort(keys, kind="stable")
            quick = np.zeros(1 << 16, bool)
            quick[(keys >> np.uint64(20)).astype(np.int64) & 0xFFFF] = True
            tables[width].append((quick, keys[order], owner[order]))
    return Index(names, [np.unique(shingles[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)], tables)


def scan_licenses(docs: DataFrame, templates: DataFrame, carry: list[str], percent: int = 80) -> DataFrame:
    """``carry`` with license_id, n_shared, n_template, containment: one row per text and template found in it.

    A template is found if ``percent`` of its distinct 5-word shingles or more are shingles of the text. Words
    are runs of letters and digits (and anything beyond ASCII), in lower case. Null and empty texts, and
    templates under five words or without text, are found in nothing; of templates with one license_id each
    row counts by itself. Repeated documents are answered alike. ``templates`` (license_id, text) is checked
    to have at most ``MOST_TEMPLATES`` rows, as every task holds it.
    """
    given = templates.where("text is not null").select("license_id", "text").limit(MOST_TEMPLATES + 1).collect()
    if len(given) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    given.sort(key=lambda r: (r["license_id"] or "", r["text"]))
    index = build_index([r["license_id"] for r in given], [r["text"] for r in given])
    # Plain arrays: a broadcast is read back by module name, and workers need not have this package.
    shared = docs.sparkSession.sparkContext.broadcast((index.names, index.sets, index.tables))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), "license_id string, n_shared long, n_template long, containment double"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value)
        for batch in K.chunks(batches, "__text"):
            shingles, first = _shingles(K.Texts(batch.column("__text")))
            rows, names, hits, sizes = [], [], [], []
            for text, template in index.candidates(shingles, first).tolist():
                mine = index.sets[template]
                n = int(np.isin(mine, shingles[first[text] : first[text + 1]]).sum())
                if 100 * n >= percent * len(mine):
                    rows.append(text)
                    names.append(index.names[template])
                    hits.append(n)
                    sizes.append(len(mine))
            if rows:
                columns = [batch.column(c).take(pa.array(rows)) for c in carry]
                n, size = np.array(hits, np.int64), np.array(sizes, np.int64)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(n), pa.array(size), pa.array(n / size)], [*carry, "license_id", "n_shared", "n_template", "containment"])

    return docs.select(*carry, F.col("text").alias("__text")).mapInArrow(scan, schema)


def known_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "license_id string, text string")
