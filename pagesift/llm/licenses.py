"""License scan by a positional index of rare template words.

The templates' words are indexed with their positions.  Word weights are
inverse document frequencies counted over the whole corpus.  A file looks up,
per template, its own highest-weighted licence words; the postings vote for
places where the template would start, so that words that stand in the
template's order relative to each other meet at one place.  A place that
enough rare words agree on is read word by word: the template's mandatory key
phrase must stand there, and most of its words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import OWN
from pagesift.session import ship_package

# Phrases whose every place is reported, by label.
BASE_PHRASES = {
    "cc-by": "cc by",
    "gpl": "general public license",
    "reserved": "all rights reserved",
}

# Well-known notices by label, as (mandatory key phrase, words).
TEMPLATES = {
    "agpl": ("affero general public license", "licensed under the gnu affero general public license"),
    "apache-2.0": ("apache license version 2 0", "licensed under the apache license version 2 0"),
    "apache-notice": (
        "unless required by applicable law",
        "unless required by applicable law or agreed to in writing software distributed under the license is "
        "distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    "bsd": (
        "redistribution and use in source and binary forms",
        "redistribution and use in source and binary forms with or without modification are permitted provided "
        "that the following conditions are met",
    ),
    "cc-by-nc": ("cc by nc", "cc by nc 4 0"),
    "cc-by-sa": ("cc by sa", "cc by sa 4 0"),
    "cc0": ("cc0 1 0 universal", "cc0 1 0 universal public domain dedication"),
    "gnu-gpl": ("gnu general public license", "licensed under the gnu general public license"),
    "gpl-notice": (
        "terms of the gnu general public license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is "
        "hereby granted",
    ),
    "lgpl": ("lesser general public license", "licensed under the gnu lesser general public license"),
    "mit": ("mit license", "licensed under the mit license"),
    "mit-text": (
        "permission is hereby granted free of charge",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files",
    ),
    "mpl-2.0": ("mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    "unlicense": ("released into the public domain", "this is free and unencumbered software released into the public domain"),
}

#: Every byte that is no letter, digit or part of a non-ASCII character becomes a blank.
_BLANKS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of the UTF-8 ``text`` with A-Z lower-cased; ``bytes.lower`` touches no other letter."""
    return text.lower().translate(_BLANKS).split()


def places(words: list[bytes], phrase: tuple[bytes, ...], start: int = 0, end: int | None = None) -> list[int]:
    """Every start in ``[start, end)`` where the words of ``phrase`` stand consecutively."""
    found, at, end = [], start, len(words) if end is None else min(end, len(words))
    try:
        while True:
            at = words.index(phrase[0], at, end)
            if tuple(words[at : at + len(phrase)]) == phrase:
                found.append(at)
            at += 1
    except ValueError:
        return found


class TemplateIndex:
    """Postings of the template words; ``weights`` are their inverse document frequencies."""

    def __init__(self, templates: dict[str, tuple[str, str]], weights: dict[bytes, float], rare_words: int, min_share: float):
        self.rare_words, self.min_share, self.weights = rare_words, min_share, weights
        self.templates = {k: (tuple(key.encode().split()), tuple(body.encode().split())) for k, (key, body) in templates.items()}
        self.postings: dict[bytes, list[tuple[str, int]]] = {}
        for label, (_, body) in self.templates.items():
            for i, w in enumerate(body):
                self.postings.setdefault(w, []).append((label, i))

    def labels(self, words: list[bytes], present: set[bytes]) -> dict[str, float]:
        """Verified labels with the share of the template's words that stand in place."""
        by_template: dict[str, list[bytes]] = {}
        for w in present:
            for label in {label for label, _ in self.postings.get(w, ())}:
                by_template.setdefault(label, []).append(w)
        wanted = {}
        for label, own in by_template.items():
            key, body = self.templates[label]
            if all(w in present for w in key) and len(own) >= self.min_share * len(set(body)):
                wanted[label] = sorted(own, key=lambda w: (-self.weights.get(w, 0.0), w))[: self.rare_words]
        if not wanted:
            return {}
        looked_up = {w for own in wanted.values() for w in own}
        at: dict[bytes, list[int]] = {w: [] for w in looked_up}
        for i, w in enumerate(words):
            if w in looked_up:
                at[w].append(i)
        found = {}
        for label, own in wanted.items():
            key, body = self.templates[label]
            votes: dict[int, set[bytes]] = {}
            for w in own:
                for posting, i in self.postings[w]:
                    if posting == label:
                        for place in at[w]:
                            votes.setdefault(place - i, set()).add(w)
            need = max(1, math.ceil(len(own) / 2))
            share = 0.0
            for start in votes:
                # neighbouring starts count too: a word may be missing or added between the rare ones
                near = set().union(*(votes.get(start + d, ()) for d in (-2, -1, 0, 1, 2)))
                if len(near) >= need:
                    low = max(0, start - 2)
                    if places(words, key, low, start + len(body) + 2):
                        there = Counter(words[low : start + len(body) + 2])
                        there &= Counter(body)
                        share = max(share, sum(there.values()) / len(body))
            if share >= self.min_share:
                found[label] = share
        return found


def _vocabulary(templates, phrases) -> frozenset[bytes]:
    texts = [body for _, body in templates.values()] + [key for key, _ in templates.values()] + list(phrases.values())
    return frozenset(w for t in texts for w in t.encode().split())


def word_weights(docs: DataFrame, text_col: str, vocabulary: frozenset[bytes]) -> dict[bytes, float]:
    """Inverse document frequency of each template word over all rows; one row per word reaches the driver."""
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            n[None] += b.num_rows
            for text in b.column(0):
                n.update(vocabulary.intersection(words_of(text.as_py() or b"")))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    text = docs.select(F.col(text_col).cast("binary").alias("text"))
    counts = {bytes(r.word) if r.word is not None else None: r.n for r in text.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = counts.pop(None, 0)
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, tuple[str, str]] = TEMPLATES,
    phrases: dict[str, str] = BASE_PHRASES,
    rare_words: int = 6,
    min_share: float = 0.7,
) -> DataFrame:
    """One row per document with its licence labels.

    ``n_words``, and for the base phrases the number of their places
    (``n_base``), the smallest and largest word position of a place (null if
    there is none) and the labels found; ``labels`` adds the verified
    templates.  Labels are distinct, sorted and joined by commas.  ``score`` is
    the best share of a verified template's words, at least 0.5 with a base
    label, else 0.  Null texts count as empty; null ids and repeated rows keep
    their row; an empty table gives no rows; other columns are not read.
    """
    ship_package(docs.sparkSession)
    vocabulary = _vocabulary(templates, phrases)
    index = TemplateIndex(templates, word_weights(docs, text_col, vocabulary), rare_words, min_share)
    base = {label: tuple(p.encode().split()) for label, p in phrases.items()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = words_of(text.as_py() or b"")
                present = set(vocabulary.intersection(words))
                hits = {label: places(words, p) for label, p in base.items() if present.issuperset(p)}
                hits = {label: at for label, at in hits.items() if at}
                every = [i for at in hits.values() for i in at]
                more = index.labels(words, present)
                score = max([0.0, *more.values(), *([0.5] if hits else [])])
                rows.append((doc, len(words), len(every), min(every, default=None), max(every, default=None),
                             ",".join(sorted(hits)), ",".join(sorted({*hits, *more})), score))
            columns = list(zip(*rows)) or [()] * 8
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias(f"{OWN}text"))
    return picked.mapInArrow(scan, RESULT)
