"""Collection, vocabulary and crawl-log statistics, comparisons between index builds, list builders."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import report_change
from ..plans.shared import numbered
from .dedup import words

#: Noise categories of a vocabulary: name, condition on term and df. Matches are of whole terms.
YEAR = r"^(18[5-9][0-9]|19[0-9]{2}|20[0-3][0-9])$"
NUMBER = r"^[0-9]+([.][0-9]+)?$"


def noise(term="term", df="df") -> dict:
    t, n = F.col(term), F.col(df)
    return {
        "iso_date": t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
        "year": t.rlike(YEAR),
        "number_1_3": t.rlike(NUMBER) & (F.length(t) <= 3),
        "number_4_plus": t.rlike(NUMBER) & (F.length(t) > 3) & ~t.rlike(YEAR),
        "letters_and_digits": t.rlike(r"[0-9]") & t.rlike(r"\p{L}"),
        "df_1": n == 1,
        "df_2": n <= 2,
        "one_letter": t.rlike(r"^\p{L}$"),
    }


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def word_summary(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_words"), F.count("*").alias("distinct_words"))


def top_words(counts: DataFrame, top: int = 50) -> DataFrame:
    return counts.orderBy(F.desc("n"), "word").limit(top)


def totals(docs: DataFrame, size: str) -> DataFrame:
    return docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"))


def per_host(docs: DataFrame, host: str, size: str) -> DataFrame:
    return docs.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("documents"), F.sum(size).cast("bigint").alias("bytes")).orderBy(F.desc("documents"), "host")


def length_summary(lens: DataFrame, short: int = 100) -> DataFrame:
    n = F.col("n_tokens")
    return lens.agg(F.avg(n).alias("mean"), F.percentile(n, F.lit(0.5)).alias("median"), F.max(n).alias("max"), (F.avg((n < short).cast("double")) * 100).alias("short_pct"))


def vocabulary_summary(dictionary: DataFrame, top: int = 100) -> DataFrame:
    """Share of terms in one document, and of postings in the most frequent terms; the top is a bounded sort."""
    most = dictionary.orderBy(F.desc("df"), "term").limit(top).agg(F.sum("df").alias("top_postings"))
    every = dictionary.agg((F.avg((F.col("df") == 1).cast("double")) * 100).alias("single_pct"), F.sum("df").alias("postings"))
    return every.crossJoin(F.broadcast(most)).select("single_pct", (F.col("top_postings") / F.col("postings") * 100).alias("top_pct"))


def top_terms(dictionary: DataFrame, n_docs: int, top: int = 10) -> DataFrame:
    return dictionary.orderBy(F.desc("df"), "term").limit(top).select("term", "df", (F.col("df") / F.lit(n_docs) * 100).alias("docs_pct"))


def zipf(dictionary: DataFrame, points: int = 600) -> DataFrame:
    """(rank, df) at ranks spaced evenly on a log scale, ranks from a range sort."""
    ranked = numbered(dictionary.select("term", "df"), [F.desc("df"), "term"], "position")
    n = dictionary.count()
    if not n:
        return ranked.select(F.col("position").alias("rank"), "df")
    ranks = sorted({int(10 ** (math.log10(n) * i / (points - 1))) for i in range(points)})
    wanted = dictionary.sparkSession.createDataFrame([(r,) for r in ranks], "rank bigint")
    return ranked.withColumn("rank", F.col("position") + 1).join(F.broadcast(wanted), "rank").select("rank", "df")


def noise_table(dictionary: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row a category: terms, postings, bytes and their shares; categories overlap. One pass over the dictionary."""
    rows = dictionary.select("term", "df").join(sizes.select("term", (F.col("entry_bytes") + F.col("payload_bytes")).alias("bytes")), "term")
    tests = noise()
    sums = [F.sum("df").alias("all_postings"), F.sum("bytes").alias("all_bytes"), F.count("*").alias("all_terms")]
    for name, test in tests.items():
        sums += [F.sum(F.when(test, 1).otherwise(0)).alias(f"{name}_t"), F.sum(F.when(test, F.col("df")).otherwise(0)).alias(f"{name}_p"), F.sum(F.when(test, F.col("bytes")).otherwise(0)).alias(f"{name}_b")]
    one = rows.agg(*sums)
    entries = F.array(*(F.struct(F.lit(name).alias("category"), F.col(f"{name}_t").alias("terms"), F.col(f"{name}_p").alias("postings"), F.col(f"{name}_b").alias("bytes")) for name in tests))
    flat = one.select("all_terms", "all_postings", "all_bytes", F.explode(entries).alias("e")).select("all_terms", "all_postings", "all_bytes", "e.*")
    pct = lambda part, whole: F.round(F.coalesce(F.try_divide(100 * F.col(part), F.col(whole)), F.lit(0.0)), 6).alias(f"{part}_pct")
    return flat.select("category", "terms", "postings", "bytes", pct("terms", "all_terms"), pct("postings", "all_postings"), pct("bytes", "all_bytes"))


PAIRS = [("D", "A"), ("E", "C"), ("F", "B"), ("A", "uncleaned")]


def compare_builds(stats: DataFrame, pairs: list[tuple[str, str]] = PAIRS) -> DataFrame:
    """stats (policy, terms, postings, bytes, seconds) → the change of each number between two policies."""
    wanted = stats.sparkSession.createDataFrame(pairs, "policy string, base string")
    base = stats.select(F.col("policy").alias("base"), *(F.col(c).alias(f"b_{c}") for c in ("terms", "postings", "bytes", "seconds")))
    joined = F.broadcast(wanted).join(stats, "policy", "left").join(base, "base", "left")
    return joined.select("policy", "base", *(report_change(F.col(c), F.col(f"b_{c}")).alias(c) for c in ("terms", "postings", "bytes", "seconds")))


def outcomes(log: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Rows of each outcome, their share, and a total."""
    counted = log.rollup(outcome).agg(F.count("*").alias("n"))
    total = F.max("n").over(Window.partitionBy())  # over one row an outcome
    return counted.select(F.coalesce(outcome, F.lit("total")).alias("outcome"), "n", (F.col("n") / total).alias("share"))


def stopword_list(base: DataFrame, kept: DataFrame, fragments: DataFrame, extras: DataFrame) -> DataFrame:
    """(base − kept) ∪ fragments ∪ extras, without words that have an apostrophe."""
    plain = base.filter(~F.col("word").contains("'"))
    return plain.subtract(kept).union(fragments).union(extras).distinct().orderBy("word")


def lemma_list(counts: DataFrame, candidates: DataFrame, stop: list[str], protected: list[str], excluded: list[str], irregular: dict[str, str], least: int = 20) -> DataFrame:
    """(word, lemma) from word counts and candidates (word, noun, verb).

    Irregular words map as given. A lemma must be in the vocabulary, be longer than a letter and differ
    by a regular suffix; verbs are tried for words in -ing or -ed whose noun form is the word itself.
    """
    ok = (F.col("n") >= least) & F.col("word").rlike("^[a-z]+$") & ~F.col("word").isin(stop + protected + excluded) & ~F.col("word").endswith("ss")
    rows = counts.filter(ok).join(candidates, "word", "left")
    noun = F.coalesce("noun", "word")
    as_verb = (noun == F.col("word")) & F.col("word").rlike("(ing|ed)$")
    lemma = F.when(as_verb, F.coalesce("verb", "word")).otherwise(noun)
    w = F.col("word")
    cut = lambda k: F.substring(w, F.lit(1), F.greatest(F.length(w) - k, F.lit(0)))
    noun_forms = F.array(cut(1), cut(2), F.concat(cut(3), F.lit("y")), F.concat(cut(3), F.lit("f")), F.concat(cut(3), F.lit("fe")))
    verb_forms = F.array(cut(3), F.concat(cut(3), F.lit("e")), cut(2), cut(1), cut(4), F.concat(cut(3), F.lit("y")))
    rows = rows.withColumn("lemma", lemma).withColumn("regular", F.when(as_verb, F.array_contains(verb_forms, F.col("lemma"))).otherwise(F.array_contains(noun_forms, F.col("lemma"))))
    known = counts.select(F.col("word").alias("lemma"))
    found = rows.filter((F.col("lemma") != w) & (F.length("lemma") > 1) & F.col("regular") & ~w.isin(list(irregular))).join(known, "lemma", "left_semi").select("word", "lemma")
    if not irregular:
        return found
    fixed = counts.filter(ok & w.isin(list(irregular))).select("word", F.element_at(F.create_map(*(F.lit(x) for p in irregular.items() for x in p)), w).alias("lemma"))
    return found.unionByName(fixed)
