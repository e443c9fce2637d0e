"""Operators on inline rows: published examples, edge cases, invariants."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import codes, normalize, porter
from textloom.operators import cleaning, dedup, index, search
from textloom.plans import fixtures as fx
from textloom.plans.policy import POLICIES, Policy, load
from textloom.plans.shared import first_per, numbered
from textloom.sources import lists
from textloom.streaming import crawl_log


def test_porter_examples():
    assert {w: porter.stem(w) for w, _ in fx.STEMS} == dict(fx.STEMS)


def test_policy_file(tmp_path):
    (tmp_path / "stop.txt").write_text("# words\nthe\n\nof\n")
    (tmp_path / "p.conf").write_text("[n]\nLowercase = YES # comment\naccents = on\nstopwords = stop.txt\nreduction = stem\n")
    p = load(str(tmp_path / "p.conf"))
    assert (p.lowercase, p.accents, p.stopwords, p.reduction) == (True, True, ("the", "of"), "stem")
    (tmp_path / "bad.conf").write_text("[n]\nreduction = chop\n")
    with pytest.raises(ValueError):
        load(str(tmp_path / "bad.conf"))


def test_unknown_cleaning_rule():
    with pytest.raises(ValueError):
        cleaning.Rules.parse("colour = red")


NORMALISED = [("Arsenal's Atlético win", "arsenal s atlético win", "arsenal atletico win"), ("6th of May, 2010", "6th of may 2010", "2010-05-06"), ("1,234,567 fans", "1 234 567 fans", "1234567 fans"), ("scored 5.4", "scored 5 4", "scored 5.4"), ("O'Neil and the ball", "o neil and the ball", "oneil ball"), (None, "", "")]


def test_policies_a_and_b(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(NORMALISED)], "id int, text string")
    for at, name in ((1, "A"), (2, "B")):
        got = rows.select("id", F.array_join(normalize.terms(F.col("text"), POLICIES[name]), " ").alias("t")).orderBy("id").collect()
        assert [r["t"] for r in got] == [x[at] for x in NORMALISED]


MARKED = [("Čech Győr Șumudică Źrebak", ["cech", "gyor", "sumudica", "zrebak"]), ("ﬁnal ２０２０ Straße Ǆ", ["final", "2020", "straße", "dz"]), ("Ελλάδα Йод กำ", ["ελλαδα", "иод", "กา"]), ("Ťhe café", ["cafe"]), ("ﷺ", ["صلى الله عليه وسلم"]), ("plain", ["plain"])]


def test_accents_of_every_script(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(MARKED)], "id int, text string")
    for name in "BCEF":
        got = [r["t"] for r in rows.select("id", normalize.terms(F.col("text"), POLICIES[name]).alias("t")).orderBy("id").collect()]
        assert got == [[porter.stem(w) if name == "E" and w.isalpha() else w for w in want] for _, want in MARKED]


def test_entities_synonyms_and_stems(spark):
    rows = spark.createDataFrame([("Man City goalies scoring goals in the EPL",)], "text string")
    assert rows.select(normalize.terms(F.col("text"), POLICIES["E"])).first()[0] == ["manchester_city", "goali", "score", "goal", "premier_league"]


CORPUS = ["arsenal win goal goal", "arsenal news", "chelsea goal", "arsenal goal news news news"]
RANKED = {"arsenal goal": [(3, 0.369276), (0, 0.319625), (1, 0.271057), (2, 0.143677)], "news unknownword": [(3, 0.929320), (1, 0.923610)], "goal goal news": [(3, 0.941787), (1, 0.812698), (0, 0.121433), (2, 0.096542)], "unknownword": []}


def test_scores_and_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(i, "h", t) for i, t in enumerate(CORPUS)], "doc_id long, source string, text string")
    built = index.build(docs, POLICIES["A"])
    index.write(built, str(tmp_path / "ix"))
    asked = spark.createDataFrame(list(enumerate(RANKED)), "query_id long, text string")
    for ind in (built, index.read(spark, str(tmp_path / "ix"))):
        got = search.search(asked, ind, POLICIES["A"]).orderBy("query_id", "rank").collect()
        for i, want in enumerate(RANKED.values()):
            assert [(r["doc_id"], round(r["score"], 6)) for r in got if r["query_id"] == i] == want


def test_empty_documents_have_norm_one(spark):
    docs = spark.createDataFrame([(0, "h", None), (1, "h", ""), (2, "h", "a b")], "doc_id long, source string, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["norm"]) for r in index.build(docs, POLICIES["A"]).docs.collect()}
    assert got[0] == (0, 1.0) and got[1] == (0, 1.0) and got[2][0] == 2


def test_greedy_keeps_both_ends_of_a_chain(spark):
    a, b, c = 0b1, 0b1111, 0b1111111  # a-b and b-c within 3, a-c not
    values = spark.createDataFrame([(1, a), (2, b), (3, c), (4, a), (5, 0), (6, 0)], "doc_id long, value long")
    assert {r["doc_id"]: r["kept"] for r in dedup.keep_first(values).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True, 6: True}


def test_kept_documents_are_far_apart(spark, data):
    values = dedup.fingerprints(spark.read.parquet(f"{data}/documents.parquet"), "md5")
    kept = values.join(dedup.keep_first(values).filter("kept"), "doc_id").select("doc_id", "value")
    assert dedup.near_pairs(kept).isEmpty()


def test_numbering_and_running_totals(spark):
    rows = spark.createDataFrame([(x, x % 7) for x in range(500)], "x long, v long")
    placed = {r["x"]: r["p"] for r in numbered(rows, ["x"], "p").collect()}
    assert placed == {x: x for x in range(500)}
    total = {r["x"]: r["t"] for r in numbered(rows, ["x"], "t", "v").collect()}
    assert total[499] == sum(x % 7 for x in range(500)) and total[0] == 0 and total[3] == 6
    assert numbered(rows.filter("x < 0"), ["x"]).isEmpty()
    assert {r["v"]: r["x"] for r in first_per(rows, ["v"], "x").collect()} == {v: v for v in range(7)}


def test_varint_lengths(spark):
    got = spark.createDataFrame([(n,) for n in (0, 127, 128, 16383, 16384)], "n long").select(codes.varint_length(F.col("n"))).collect()
    assert [r[0] for r in got] == [1, 1, 2, 2, 3]


def test_repository(spark, tmp_path):
    for host, name, content in (("a", "x" * 64, b"Title\nbody \xff"), ("b", "y" * 64, b"two"), ("b", "short", b"no")):
        (tmp_path / host / name[:2]).mkdir(parents=True, exist_ok=True)
        (tmp_path / host / name[:2] / f"{name}.txt").write_bytes(content)
    got = lists.read_repository(spark, str(tmp_path)).collect()
    assert sorted((r["host"], r["text"]) for r in got) == [("a", "Title\nbody �"), ("b", "two")]


def test_log_round_trip_and_stream(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", "u", "stored") for m in (1, 2, 3, 15, 40)]
    log = spark.createDataFrame(rows, "ts string, url string, outcome string").withColumn("ts", F.to_timestamp("ts"))
    lists.append_log(log, str(tmp_path / "log"))
    lists.append_log(log.limit(0), str(tmp_path / "log"))
    schema = "ts timestamp, url string, outcome string"
    batch = sorted((str(r["start"]), r["n"]) for r in crawl_log.active_windows(log).collect())
    streamed = crawl_log.active_windows(crawl_log.stream(spark, str(tmp_path / "log"), schema))
    q = streamed.writeStream.outputMode("complete").format("memory").queryName("active").start()
    try:
        q.processAllAvailable()
        assert sorted((str(r["start"]), r["n"]) for r in spark.table("active").collect()) == batch == [("2024-01-01 00:00:00", 3), ("2024-01-01 00:10:00", 1), ("2024-01-01 00:40:00", 1)]
    finally:
        q.stop()
    assert crawl_log.first_seen(log).count() == 1


def test_names_policy_default_is_plain():
    assert Policy().names == "none"
