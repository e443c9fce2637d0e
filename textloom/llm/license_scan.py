"""License scans by a positional index of rare words.

Each template is a word sequence with mandatory key phrases. Its highest-IDF words (by document
counts over the whole corpus) are posted as (template, position). A file's own words look their
postings up; postings that agree on where the template would begin form a candidate, which is kept
if enough of the template's words stand at their places and every key phrase does, word by word.

The base phrases are templates too, with one anchor word and every word mandatory, so each of their
places is found exactly. Other templates add labels of the method.

Defined results: null text counts as empty (no words, no places, null positions, empty labels, score
0); repeated rows give repeated rows; only the key and text columns are read; an empty table gives
an empty table (all template words are then equally rare).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table, text_batches
from .license_texts import BODIES

# Base phrases and labels of the contract.
BASE_PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

#: (label, text, key phrases) of openings and short references; license_texts has whole bodies and notices.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    ("mit", "released under the mit license", ("mit license",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2 0",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license version 3",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "provided that the following conditions are met")),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc0", "dedicated to the public domain under the creative commons cc0 1 0 universal", ("creative commons cc0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
]

#: Words are runs outside ASCII other than digits and letters; A-Z count as a-z.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else ord(chr(b).lower()) if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[int, int], ...]  # where the mandatory phrases stand
    is_base: bool
    least: float  # share of words that must stand at their places

    @staticmethod
    def make(label: str, text: str, phrases: tuple[str, ...], is_base: bool, least: float) -> Template:
        words = tuple(words_of(text))
        keys = []
        for phrase in phrases:
            p = tuple(words_of(phrase))
            keys.append(next((i, i + len(p)) for i in range(len(words)) if words[i : i + len(p)] == p))
        return Template(label, words, tuple(keys), is_base, least)


def templates(least: float = 0.6) -> list[Template]:
    base = [Template.make(label, phrase, (phrase,), True, 1.0) for phrase, label in BASE_PHRASES]
    return base + [Template.make(label, text, phrases, False, least) for label, text, phrases in [*TEMPLATES, *BODIES]]


def word_documents(df: DataFrame, vocabulary: frozenset[bytes], text: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many documents each template word stands, and how many documents there are.

    Every task sends one row for each vocabulary word at most; the vocabulary is that of the templates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        docs = 0
        for _, texts in text_batches(batches, text):
            docs += len(texts)
            for t in texts:
                held.update(vocabulary.intersection(words_of(t)))
        rows = [*held.items(), (None, docs)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())], names=["word", "n"])

    found = {r["word"]: r["n"] for r in arrow_map(df.select(text), run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    docs = found.pop(None, 0)
    return {bytes(w): n for w, n in found.items()}, docs


class RareWordIndex:
    """word → [(template, position)] for the rarest words of each template."""

    def __init__(self, templates_: list[Template], counts: dict[bytes, int], docs: int, anchors: int = 4):
        self.templates = templates_
        idf = {w: math.log((docs + 1) / (counts.get(w, 0) + 1)) for t in templates_ for w in t.words}
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.anchors: list[int] = []
        for i, t in enumerate(templates_):
            order = sorted(set(t.words), key=lambda w: (-idf[w], w))
            chosen = set(order[: 1 if t.is_base else anchors])
            places = [p for p, w in enumerate(t.words) if w in chosen]
            self.anchors.append(len(places))
            for p in places:
                self.postings.setdefault(t.words[p], []).append((i, p))
        self.words = frozenset(self.postings)

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, first word, share of the template's words in place) of each verified place."""
        if self.words.isdisjoint(words):
            return []
        votes: Counter = Counter()
        for at, word in enumerate(words):
            if word in self.words:
                for i, p in self.postings[word]:
                    votes[i, at - p] += 1
        found = []
        for (i, start), n in votes.items():
            t = self.templates[i]
            if n * 2 < self.anchors[i] or start < 0 and t.is_base:
                continue
            if any(start + a < 0 or tuple(words[start + a : start + b]) != t.words[a:b] for a, b in t.keys):
                continue
            held = sum(1 for p, w in enumerate(t.words) if 0 <= start + p < len(words) and words[start + p] == w)
            if held >= t.least * len(t.words):
                found.append((i, start, held / len(t.words)))
        return found


SCHEMA = "n_words bigint, places array<struct<label:string,first_word:bigint,base:boolean,share:double>>"


def scan(df: DataFrame, templates_: list[Template], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, places): every verified place of every template, base or not, in word order."""
    df = df.select(key, text)
    counts, docs = word_documents(df, frozenset(w for t in templates_ for w in t.words), text)
    index = RareWordIndex(templates_, counts, docs)
    place = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("base", pa.bool_()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, text):
            n_words, places = [], []
            for t in texts:
                words = words_of(t)
                n_words.append(len(words))
                got = sorted((start, index.templates[i].label, index.templates[i].is_base, share) for i, start, share in index.scan(words))
                places.append([{"label": label, "first_word": start, "base": base, "share": share} for start, label, base, share in got])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(n_words, pa.int64()), pa.array(places, pa.list_(place))], names=[key, "n_words", "places"])

    return arrow_map(df, run, f"{key} {df.schema[key].dataType.simpleString()}, {SCHEMA}")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), templates())
    base = F.filter("places", lambda p: p["base"])
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["first_word"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )
