"""Language identification: words first, then ever shorter character n-grams.

The model holds, per language, log frequencies of words and of character n-grams of the words'
types and tokens. A document is scored word by word: a known word by its own log frequencies; an
unseen one by those of its longest known n-grams. The best total wins.

The model is fitted on a bounded sample of the labelled rows: about `docs_per_language` documents of
each language, picked by a hash of their key so that reruns agree (all of a language that has fewer),
of which each language keeps its `max_words` most frequent words and `max_grams` n-grams. Where the
limit falls among words about as frequent, a hash picks as many as there is room for. The model has a
column for each language; there may be some hundreds. Prediction reads every row whole.

Defined results: null text or text without a letter is `und` with score 0; so is every row where
nothing could be learned. Ties between languages go to the first by code point. Only key, text and
(for learning) label columns are read; repeated rows repeat; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table, text_batches

UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")
GRAM_SIZES = (5, 4, 3, 2, 1)
FLOOR = 1e-7  # frequency of what a language has never shown


def labelled(df: DataFrame, key: str, label: str) -> DataFrame:
    """Rows to learn from: a label, and a key whose CRC-32 is outside the held-out fifth."""
    return df.filter(F.col(label).isNotNull() & (F.crc32(F.col(key).cast("string").cast("binary")) % 5 != 0))


#: Hashes are compared as shares of this many values, so that a share of 1e-15 still picks rows.
WHOLE = 1 << 62
STEPS = 64  # frequency classes for each doubling


def _below(share: Column, hashed: Column) -> Column:
    """True for that share of hashes."""
    return (share >= 1) | (F.pmod(hashed, F.lit(WHOLE)) < (share * float(WHOLE)).cast("bigint"))


def _by_language(values: dict[str, float]) -> Column:
    """The value of the row's language; few languages, so a literal."""
    pairs = [F.lit(x) for lang, value in values.items() for x in (lang, float(value))]
    return F.element_at(F.create_map(*pairs), F.col("lang"))


def _top(df: DataFrame, what: str, most: int) -> list[tuple[str, str, float]]:
    """(lang, word or n-gram, share of the language's total) of about the `most` most frequent of each language.

    No language is sorted in one task: counts by frequency class (some thousands a language) say from
    which class on all are taken, and which share of the next class.
    """
    level = F.floor(F.log2("n") * STEPS)
    classes = df.groupBy("lang", level.alias("level")).agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()
    total: dict[str, float] = {}
    cut: dict[str, float] = {}
    share: dict[str, float] = {}
    held: dict[str, int] = {}
    for r in sorted(classes, key=lambda r: -r["level"]):
        lang = r["lang"]
        total[lang] = total.get(lang, 0) + r["n"]
        before = held.get(lang, 0)
        held[lang] = before + r["rows"]
        if before < most:
            cut[lang], share[lang] = r["level"], (most - before) / r["rows"]
    if not classes:
        return []
    kept = (level > _by_language(cut)) | (level == _by_language(cut)) & _below(_by_language(share), F.xxhash64(what))
    return [(r["lang"], r[what], r["n"] / total[r["lang"]]) for r in df.filter(kept).select("lang", what, "n").collect()]


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", docs_per_language: int = 5_000, max_words: int = 30_000, max_grams: int = 30_000) -> "Model":
    rows = labelled(df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).alias("lang")), "key", "lang")
    shares = {r["lang"]: docs_per_language / r["count"] for r in rows.groupBy("lang").count().collect()}
    if not shares:
        return Model.make([], [])
    sample = rows.filter(_below(_by_language(shares), F.xxhash64(F.col("key").cast("string"))))
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("word"))
    words = words.groupBy("lang", "word").agg(F.count("*").alias("n")).persist()
    try:
        padded = F.concat(F.lit("<"), "word", F.lit(">"))
        grams = F.flatten(F.array(*(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (k - 1), F.lit(1))), lambda i, k=k: F.substr(padded, i, F.lit(k))) for k in GRAM_SIZES)))
        # Tokens weigh by the square root of their word's count, so that frequent words do not drown the rest.
        gram = words.select("lang", F.explode(grams).alias("gram"), F.sqrt("n").alias("n")).groupBy("lang", "gram").agg(F.round(F.sum("n"), 6).alias("n"))  # rounded: sums in another order agree
        return Model.make(_top(words, "word", max_words), _top(gram, "gram", max_grams))
    finally:
        words.unpersist()


class Model:
    """Log frequencies, one row for each word or n-gram, one column for each language."""

    def __init__(self, langs: list[str], words: dict[str, int], word_rows: np.ndarray, grams: dict[str, int], gram_rows: np.ndarray):
        self.langs, self.words, self.word_rows, self.grams, self.gram_rows = langs, words, word_rows, grams, gram_rows
        self.reset()

    @staticmethod
    def make(words: list[tuple[str, str, float]], grams: list[tuple[str, str, float]]) -> "Model":
        """From (lang, word or n-gram, frequency)."""
        langs = sorted({lang for lang, _, _ in words})
        column = {lang: i for i, lang in enumerate(langs)}

        def matrix(rows) -> tuple[dict[str, int], np.ndarray]:
            index: dict[str, int] = {}
            for _, what, _ in rows:
                index.setdefault(what, len(index))
            f = np.zeros((len(index), len(langs)))
            for lang, what, share in rows:
                f[index[what], column[lang]] = share
            return index, np.log(f + FLOOR).astype(np.float32)

        return Model(langs, *matrix(words), *matrix(grams))

    def reset(self, most: int = 60_000) -> None:
        self.seen: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.langs)), np.float32)
        self.most = most

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("seen", "rows")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.reset()

    def word_score(self, word: str) -> np.ndarray:
        at = self.words.get(word)
        if at is not None:
            return self.word_rows[at]
        padded = f"<{word}>"
        for k in GRAM_SIZES:
            known = [g for i in range(len(padded) - k + 1) if (g := self.grams.get(padded[i : i + k])) is not None]
            if known:
                return self.gram_rows[known].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)

    def row(self, word: str) -> int:
        if len(self.rows) == len(self.seen):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[len(self.seen)] = self.word_score(word)
        self.seen[word] = at = len(self.seen)
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall(text.lower()) if text and self.langs else []
        if not any(c.isalpha() for w in words for c in w):
            return UNDETERMINED, 0.0
        if len(self.seen) > self.most:
            self.reset(self.most)
        get = self.seen.get
        at = [i if (i := get(w)) is not None else self.row(w) for w in words]
        total = self.rows[at].sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        # The words of a text are not independent evidence: their sum counts as its square root.
        odds = np.exp((total - total[best]) / math.sqrt(len(words)))
        return self.langs[best], float(1.0 / odds.sum())


def identify(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, lang_pred, score) of every row. The model's size is bounded by fit()'s parameters."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    columns = list(dict.fromkeys([key, text, *keep]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch, texts in text_batches(batches, text):
            said = [held.predict(t) for t in texts]
            names = list(dict.fromkeys([key, *keep]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())], names=[*names, "lang_pred", "score"]
            )
        held.reset()  # workers live on: what a task has cached would add up over the stages of a job

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in dict.fromkeys([key, *keep]))
    return arrow_map(df.select(*columns), run, f"{kinds}, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return identify(docs, fit(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
