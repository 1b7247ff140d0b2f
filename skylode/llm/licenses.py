"""License scans: MinHash bands over overlapping windows find templates, exact containment verifies them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylode.llm.common import map_arrow, texts
from skylode.llm.license_texts import WHOLE

#: Short notices.
SHORT = {
    "gpl-3": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "apache-2": "Licensed under the Apache License, Version 2.0.",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "lgpl": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
TEMPLATES = SHORT | WHOLE
WORDS = 5
CONTAINMENT = 0.8
#: Most often that a window that holds a template may collide with it in no band.
MISS = 1e-4
SCHEMA = "doc_id long, license string, containment double, first_word long, n_matches long"
_EDGE = ".,;:!?()[]{}\"'«»“”‘’"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hash(token: str) -> int:
    """64 bits of a token, lower-cased, without punctuation at its edges; 0 if nothing is left."""
    import xxhash

    word = token.lower().strip(_EDGE)
    return (xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 7) | 1) if word else 0


class _Tokens(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        value = word_hash(token)
        if len(token) <= 64:
            self[token] = value
        return value


def shingles(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """A hash of each run of n words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ words[i : i + len(out)]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def bands_for(similarity: float, miss: float = MISS) -> int:
    """Bands of one row that make a pair of this Jaccard similarity collide with probability 1 - miss at least."""
    return 1 if similarity >= 1 else math.ceil(math.log(miss) / math.log(1 - similarity))


class Index:
    """The templates' bands, by size class.

    Templates of s+1 to 2s shingles (s a power of two) are sought in windows of
    3s shingles, one every s: wherever such a template starts, one window
    holds it whole. A window that holds the least allowed share has a known
    smallest Jaccard similarity with the template, which sets the number of bands.
    """

    def __init__(self, templates: dict[str, str], containment: float = CONTAINMENT, n: int = WORDS):
        self.names = list(templates)
        self.n, self.containment = n, containment
        tokens = _Tokens()
        self.sets = [np.unique(shingles(np.array([h for h in map(tokens.__getitem__, t.split()) if h], np.uint64), n)) for t in templates.values()]
        if any(not len(s) for s in self.sets):
            raise ValueError(f"a template needs {n} words at least")
        self.need = [math.ceil(containment * len(s) - 1e-9) for s in self.sets]
        self.classes: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            self.classes.setdefault(0 if len(s) == 1 else 1 << (len(s) - 1).bit_length() - 1, []).append(i)
        self.bands = {}
        for stride, own in self.classes.items():
            window = 3 * stride or 1
            self.bands[stride] = max(bands_for(self.need[i] / (window + len(self.sets[i]) - self.need[i])) for i in own)
        # For each band and class the templates by their smallest hash, and a table of the hashes' first 16 bits.
        self.lookup: dict[tuple[int, int], tuple[np.ndarray, dict[int, list[int]]]] = {}
        for stride, own in self.classes.items():
            for band in range(self.bands[stride]):
                by: dict[int, list[int]] = {}
                for i in own:
                    by.setdefault(int(self.hashed(self.sets[i], band).min()), []).append(i)
                table = np.zeros(1 << 16, bool)
                table[[v >> 48 for v in by]] = True
                self.lookup[stride, band] = table, by

    def width(self, template: int) -> int:
        """Shingles of the windows in which a template is sought."""
        n = len(self.sets[template])
        return 1 if n == 1 else 3 << (n - 1).bit_length() - 1

    @staticmethod
    def hashed(values: np.ndarray, band: int) -> np.ndarray:
        out = (values ^ np.uint64(0xD6E8FEB86659FD93 * (band + 1) % (1 << 64))) * _MIX
        out ^= out >> np.uint64(32)
        return out * _MIX

    def candidates(self, marks: np.ndarray) -> set[tuple[int, int, int]]:
        """(start, end, template) of windows that collide with a template in a band."""
        out = set()
        for band in range(max(self.bands.values(), default=0)):
            level, size = self.hashed(marks, band), 1
            for stride in sorted(self.classes):
                if band >= self.bands[stride]:
                    continue
                while size < stride:
                    if len(level) % 2:
                        level = np.append(level, np.uint64(2**64 - 1))
                    level, size = np.minimum(level[0::2], level[1::2]), 2 * size
                least = level
                if stride and len(level):
                    least = level.copy()
                    least[:-1] = np.minimum(least[:-1], level[1:])
                    least[:-2] = np.minimum(least[:-2], level[2:])
                table, by = self.lookup[stride, band]
                for at in np.flatnonzero(table[(least >> np.uint64(48)).astype(np.int64)]):
                    for template in by.get(int(least[at]), ()):
                        start = int(at) * (stride or 1)
                        out.add((start, start + (3 * stride or 1), template))
        return out


def find_licenses(index: Index, found: list[str]) -> list[tuple[int, str, float, int, int]]:
    """(text's place, license, containment, first word, number of matches) over a batch of texts."""
    tokens, n = _Tokens(), index.n
    each = [np.array([h for h in map(tokens.__getitem__, x.split()) if h], np.uint64) for x in found]
    # All texts' shingles in one row; a text's last n-1 places hold none.
    marks = [np.concatenate([shingles(w, n), np.arange(min(len(w), n - 1), dtype=np.uint64)]) for w in each]
    ends = np.cumsum([len(m) for m in marks]) if marks else np.zeros(0, int)
    row = np.concatenate(marks) if marks else np.zeros(0, np.uint64)
    spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for start, end, template in index.candidates(row):
        doc = int(np.searchsorted(ends, start, side="right"))
        while doc < len(ends) and (begin := int(ends[doc - 1]) if doc else 0) < end:  # a window may reach into the next text
            first, last = max(start, begin), min(end, int(ends[doc]) - (n - 1))
            if first < last:
                spans.setdefault((doc, template), []).append((first, last))
            doc += 1
    out = []
    for (doc, template), windows in sorted(spans.items()):
        own, best, hits = index.sets[template], 0.0, set()
        begin = int(ends[doc - 1]) if doc else 0
        for a, b in sorted(windows):
            inside = np.isin(row[a:b], own)
            share = len(np.unique(row[a:b][inside])) / len(own)
            if share + 1e-9 >= index.containment:
                hits.update((a + np.flatnonzero(inside)).tolist())
                best = max(best, share)
        if hits:
            places = sorted(hits)
            out.append((doc, index.names[template], best, places[0] - begin, occurrences(places, row[places].tolist(), index.need[template], index.width(template))))
    return out


def occurrences(places: list[int], values: list[int], need: int, width: int) -> int:
    """How often a template occurs, given where its shingles stand; one at least.

    Read from left to right, an occurrence ends where it has ``need`` different shingles and one of them comes again, or before a gap of over ``width``.
    """
    count, seen, last = 0, set(), places[0]
    for place, value in zip(places, values, strict=True):
        if (value in seen and len(seen) >= need) or place - last > width:
            count += len(seen) >= need
            seen = set()
        seen.add(value)
        last = place
    return max(count + (len(seen) >= need), 1)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT, words: int = WORDS) -> DataFrame:
    """Rows (doc_id, license, containment, first_word, n_matches): templates of which a window holds ``containment`` of the shingles.

    A window that holds a template to this degree meets it in no band with a probability of 1e-4 at most, so results may lack so many.
    ``n_matches`` counts :func:`occurrences`. ``first_word`` counts the words that punctuation doesn't make up alone.
    Null and empty texts match nothing; whole texts are read, however long.
    Repeated rows give repeated results, a null doc_id is kept, other columns are not read.
    """
    templates = TEMPLATES if templates is None else templates

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, containment, words)
        for batch in batches:
            rows = find_licenses(index, texts(batch))
            ids = batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
            columns = [pa.array([r[i] for r in rows], t) for i, t in ((1, pa.string()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, SCHEMA)
