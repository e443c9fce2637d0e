"""Hash collisions, keys that are null or repeat, plain versions of each operator, and the contract columns of the queries."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from textloom.llm import bpe, html_extract, language_id, license_scan, lz_fingerprint, media_chunks, ngram_join, token_shards, url_rules
from textloom.llm.pretokenize import SliceCache


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


# ---- slice cache


def test_equal_hashes_do_not_exchange_ids():
    ranks = bpe.load_ranks(bpe.vocabulary_path())
    one = lambda s: bpe.merge_slice(s.encode(), ranks)
    cache = SliceCache(lambda pieces: [*map(one, pieces)])
    for n in (256, 512, 1024, 2048, 4096):
        a = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
        b = a.translate(str.maketrans("ab", "ba"))
        for order in ([a, b], [b, a], [a + b, b + a, "x" + a], [b], [a]):
            for _ in range(2):
                ids, count = cache.encode(order)
                assert [p.tolist() for p in np.split(ids, np.cumsum(count)[:-1])] == [one(t) for t in order]


def test_forced_collisions_and_small_caches(monkeypatch):
    """All hashes equal, and a cache that has to drop slices all the time: ids stay right."""
    pieces = lambda ps: [[ord(c) for c in p] + [len(p)] for p in ps]
    r = random.Random(8)
    batches = [[" ".join("".join(r.choice("abé日\0") for _ in range(r.randint(1, 12))) for _ in range(r.randint(0, 40))) for _ in range(6)] for _ in range(60)]
    want = [[x for p in bpe_slices(t) for x in pieces([p])[0]] for b in batches for t in b]
    for hashed in (False, True):
        cache = SliceCache(pieces, most_bits=7, most_pooled=400)
        if hashed:
            monkeypatch.setattr(SliceCache, "hashes", lambda self, cut: np.full(len(cut.begin), 7, np.uint32))
        got = []
        for b in batches:
            ids, count = cache.encode(b)
            got += [p.tolist() for p in np.split(ids, np.cumsum(count)[:-1])]
        assert got == want


def bpe_slices(text):
    import public_tokenizers
    import regex

    return regex.findall(public_tokenizers.PATTERN, text)


# ---- Re-Pair


def plain_repair(ids, doc_len, first, least):
    """The most frequent pair, one after the other: (length of the sequence, number of rules)."""
    docs = [d.tolist() for d in np.split(ids, np.cumsum(doc_len)[:-1])]
    rules = 0
    while True:
        count = Counter()
        for d in docs:
            i = 0
            while i + 1 < len(d):
                count[d[i], d[i + 1]] += 1
                i += 2 if i + 2 < len(d) and d[i] == d[i + 1] == d[i + 2] else 1
        if not count or max(count.values()) < least:
            return sum(map(len, docs)), rules
        pair = max(count, key=lambda p: (count[p], p))
        for k, d in enumerate(docs):
            out, i = [], 0
            while i < len(d):
                if tuple(d[i : i + 2]) == pair:
                    out.append(first + rules)
                    i += 2
                else:
                    out.append(d[i])
                    i += 1
            docs[k] = out
        rules += 1


def test_grammars_are_as_small_as_plain_repair():
    r = np.random.default_rng(3)
    phrases = [r.integers(0, 60, r.integers(2, 9)) for _ in range(40)]
    ids = np.concatenate([phrases[i] for i in r.zipf(1.4, 900) % 40])
    doc_len = np.array([len(ids) // 3, len(ids) // 3, len(ids) - 2 * (len(ids) // 3)])
    for least in (2, 4):
        length, rules = plain_repair(ids, doc_len, 60, least)
        seq, made, _, _ = token_shards.compress(ids, doc_len, 60, min_count=least)
        assert len(seq) + 3 * len(made) <= 1.05 * (length + 3 * rules)
        assert token_shards.Shard(token_shards.pack(ids, doc_len, 60)).all().tolist() == ids.tolist()


# ---- n-gram join and pipeline


def test_links_of_rows_without_a_key(spark):
    words = [f"w{i}" for i in range(80)]
    near = " ".join([*words[:40], "other", *words[41:]])
    for keys in ((None, 1), (0, 1), (None, None), (5, 5)):
        got = ngram_join.join(spark.createDataFrame([(keys[0], " ".join(words)), (keys[1], near)], "doc_id long, text string")).collect()
        assert [r["n_links"] for r in got] == [1, 1]
        assert {r["class_id"] for r in got} == {min((k for k in keys if k is not None), default=None)}


def test_stages_lose_no_different_texts(spark, data):
    r = random.Random(2)
    text = lambda: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(5)) for _ in range(60))
    rows = [(1, text(), "en", "s", 1), (1, text(), "en", "s", 1), (None, text(), "en", "s", 1), (None, text(), "en", "t", 1), (2, "!!", "en", "s", 2), (2, "!!", "en", "s", 2)]
    rows += [rows[0], (9, rows[0][1], "en", "s", 1), (None, rows[1][1], "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.near_duplicate_stage(spark, df, data).collect()
    assert sorted(map(str, kept)) == sorted(map(str, df.limit(6).collect()))
    mixed = pipeline.mixing_stage(spark, df.limit(4), data).collect()
    assert Counter(r["text"] for r in mixed).keys() <= {x[1] for x in rows[:4]} and max(Counter(r["text"] for r in mixed).values()) <= 2
    assert 4 <= len(mixed) <= 8


# ---- language


def test_scores_match_a_plain_scorer(docs, texts):
    model = language_id.fit(docs)
    for row in language_id.identify(docs.limit(80), model).collect():
        words = re.findall(r"[^\W\d_]+", texts[row["doc_id"]].lower())
        total = {lang: 0.0 for lang in model.langs}
        for w in words:
            if w in model.words:
                rows = [model.word_rows[model.words[w]]]
            else:
                grams = ([model.gram_rows[model.grams[g]] for i in range(len(w) + 3 - k) if (g := f"<{w}>"[i : i + k]) in model.grams] for k in (5, 4, 3, 2, 1))
                rows = next((g for g in grams if g), [np.zeros(len(model.langs))])
            for j, lang in enumerate(model.langs):
                total[lang] += sum(float(x[j]) for x in rows) / len(rows)
        best = max(sorted(total), key=total.get) if words else "und"
        assert row["lang_pred"] == best
        if words:
            odds = sum(math.exp((total[x] - total[best]) / math.sqrt(len(words))) for x in total)
            assert row["score"] == pytest.approx(1 / odds, abs=1e-3)


def test_rare_languages_are_learned(spark):
    rows = [(i, "common words in a common language here", "aa") for i in range(3000)] + [(i, "zvlast vzacna slova jine reci", "bb") for i in range(3000, 3008)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), docs_per_language=50)
    assert model.langs == ["aa", "bb"] and model.predict("vzacna slova")[0] == "bb"
    assert int(1e-14 * language_id.WHOLE) > 0  # a share that would round to none of a million


# ---- fingerprints


def plain_phrases(text):
    """LZ78 over symbols, phrases as tuples."""
    symbols = []
    for run in re.findall(r"\w+|[^\w\s]", text):
        symbols += [run] if len(run) <= 12 else [*run]
    known, phrase = set(), ()
    for s in symbols:
        phrase += (s,)
        if phrase not in known:
            known.add(phrase)
            phrase = ()
    return known


def test_phrases_are_those_of_a_plain_parse(texts):
    r = random.Random(1)
    for text in [*list(texts.values())[:80], "a" * 40, "x" * 13 + " y--z", "日本語" * 30, "".join(r.choice("ab -") for _ in range(500))]:
        assert len(lz_fingerprint.phrases(text)) == len(plain_phrases(text))
    a, b = texts[min(texts)], texts[max(texts)]
    shared = len(plain_phrases(a) & plain_phrases(b)) / len(plain_phrases(a) | plain_phrases(b))
    assert abs(lz_fingerprint.likeness(lz_fingerprint.fingerprint(a), lz_fingerprint.fingerprint(b)) - shared) < 0.2


def test_insertions_do_not_shift_unspaced_text():
    r = random.Random(4)
    text = "".join(chr(0x4E00 + r.randrange(800)) for _ in range(4000))
    for at in (0, 1, 1999):
        assert lz_fingerprint.likeness(*map(lz_fingerprint.fingerprint, (text, f"{text[:at]}一{text[at:]}"))) > 0.85


def test_neighbours_of_string_and_repeated_keys(spark):
    rows = [(None if i % 3 else f"k{i:03d}", f"text number {i} " * (i % 4)) for i in range(200)]
    got = lz_fingerprint.next_pairs(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    digests = Counter(r["edited_sha256"] for r in got)
    assert len(got) == 200
    named = sorted((k, t) for k, t in rows if k)
    want = Counter(hashlib.sha256(lz_fingerprint.edited(t, n).encode()).hexdigest() for (_, t), (_, n) in zip(named, named[1:]))
    assert all(digests[d] >= n for d, n in want.items())


# ---- HTML

STORY = "The harbour was quiet that morning, and the boats lay still in the mist. Nobody spoke until the bell had rung twice. "
PAGES = [
    (f"<html><body><div class=c3><a href=/>Home</a> <a href=/n>News</a></div><div class=x1><h1>Fog</h1><p>{STORY * 3}</p><p>{STORY * 4}</p></div><div class='cmt-thread'><div class=u><b>ann</b> <i>2 May</i> I do not agree with this at all.</div><div class=u><b>bob</b> <i>3 May</i> Great read, thank you.</div></div><div class=ft>&copy; 2020 by us.</div></body></html>", 3),
    ("<main>" + "".join(f"<p>{i}. {STORY}</p>" for i in range(90)) + "</main><footer>&copy; us</footer>", 90),
    (f"<head><title>t</title><meta charset=utf-8><p>{STORY}</p><p>{STORY}</p>", 2),
    (f"<body><nav><a href=/>x</a></nav><article><p>{STORY}</p><noscript><p>{STORY}</p></article>", 2),
]


def test_pages_written_by_hand():
    for (page, blocks), text in zip(PAGES, html_extract.extract_batch([p for p, _ in PAGES], html_extract.model())):
        assert len(text.split("\n\n")) == blocks and "©" not in text and "agree" not in text and STORY.strip() in text


# ---- licences


def test_places_match_a_plain_scan(docs, spark):
    chosen = license_scan.templates()
    bodies = [(10_000 + i, f"intro words {text} closing words") for i, (_, text, _) in enumerate(license_scan.BODIES)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(bodies, "doc_id long, text string"))
    counts, n = license_scan.word_documents(df, frozenset(w for t in chosen for w in t.words))
    anchors = []
    for t in chosen:
        order = sorted(set(t.words), key=lambda w: (-math.log((n + 1) / (counts.get(w, 0) + 1)), w))[: 1 if t.is_base else 4]
        anchors.append([p for p, w in enumerate(t.words) if w in order])
    got = {r["doc_id"]: r for r in license_scan.scan(df, chosen).collect()}
    for doc_id, text in df.collect():
        words, want = license_scan.words_of(text or ""), []
        for t, own in zip(chosen, anchors):
            for start in range(-len(t.words), len(words)):
                at = lambda p: words[start + p] if 0 <= start + p < len(words) else None  # noqa: B023, E731
                if 2 * sum(at(p) == t.words[p] for p in own) < len(own) or not any(at(p) == t.words[p] for p in own) or t.is_base and start < 0:
                    continue
                share = sum(at(p) == w for p, w in enumerate(t.words)) / len(t.words)
                if share >= t.least and all(all(at(p) == t.words[p] for p in range(a, b)) for a, b in t.keys):
                    want.append((start, t.label, t.is_base, round(share, 9)))
        assert sorted((p["first_word"], p["label"], p["base"], round(p["share"], 9)) for p in got[doc_id]["places"]) == sorted(want)
    for i, (label, _, _) in enumerate(license_scan.BODIES):
        assert label in {p["label"] for p in got[10_000 + i]["places"]}


# ---- URL rules


def test_filter_lists_against_every_rule():
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 4))) for _ in range(300)]
    w = lambda: r.choice(words)
    lines = ["! comment", "[Adblock]", "a##.ad", "", "||x.com^$script"]
    for _ in range(2500):
        pattern = r.choice([f"||{w()}.{w()}^", f"/{w()}/{w()}.", f"^{w()}^", f"{w()}-{w()}", f"|https://{w()}.{w()}/", f"/{w()}*{w()}|", f"||{w()}.*/{w()}^"])
        lines.append(r.choice(["", "@@"]) + pattern + r.choice(["", "", f"$domain={w()}.com|~x.{w()}.com"]))
    rules = [*(url_rules.host_rule(*x) for x in url_rules.HOST_RULES), *url_rules.parse(lines)]
    assert len(rules) == 2505
    index, tried = url_rules.RuleIndex(rules, {}), 0
    compiled = [(x, re.compile(x.regex, re.S if x.is_host_rule else re.S | re.I)) for x in rules]
    for _ in range(300):
        host = r.choice(["", "www.", "x."]) + w() + "." + r.choice(["com", "net", w()])
        path = r.choice(["", f"/{w()}/{w()}.{w()}", f"/{w()}-{w()}", f"/EN/{w().upper()}/", f"/en/{w()}{w()}"])
        fits = [x for x, c in compiled if (not x.only or url_rules.within(host, x.only)) and not url_rules.within(host, x.never) and c.search(host + path)]
        named = [x for x in fits if x.is_host_rule]
        best = max(named, key=lambda x: len(x.name), default=None)
        said = {x.verdict for x in fits}
        assert index.judge(host, path) == ((best.name, best.verdict) if best else (None, "allow" if "allow" in said or not said else "block"))
        tried += len(index.candidates(host + path))
    assert tried / 300 < 0.5 * len(rules)


# ---- the queries' own columns


def test_contract_columns(spark, data, texts):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    order = sorted(texts)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in license_scan.op4_license_scan(spark, data).collect():
        ws = word.findall(texts[r["doc_id"]].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        at = sorted((i, label) for phrase, label in license_scan.BASE_PHRASES for p in [phrase.split()] for i in range(len(ws)) if ws[i : i + len(p)] == p)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(ws), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and {x for _, x in at} <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    for r in media_chunks.op5_media_chunks(spark, data).collect():
        raw = texts[r["doc_id"]].encode()
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        media = media_chunks.wav(p)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media), hashlib.sha256(media).hexdigest())
    library, start, want = Tokenizer.from_file(token_shards.tokenizer_path()), 0, {}
    for k in order:
        ids = [*library.encode(texts[k], add_special_tokens=False).ids, 0]
        want[k] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_shards.op7_token_shards(spark, data).collect()} == want
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.vocabulary_path()), special_tokens={})
    for r in bpe.op10_bpe(spark, data).collect():
        ids = coder.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())
    said = lz_fingerprint.op6_lz_fingerprint(spark, data).collect()
    assert sorted(r["doc_id"] for r in said) == order and all(0 <= r[c] <= 1 for r in said for c in ("near_edited", "near_next"))
    judged = language_id.op9_language_id(spark, data).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in judged)


def test_hot_chunks_rebuild(spark):
    """One passage in most files, others their own."""
    passage = "".join(random.Random(5).choice("abcdefgh ") for _ in range(20_000))
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).otherwise(F.concat(F.lit(passage), F.col("id").cast("string"))).alias("text"))
    got = {r["doc_id"]: (r["n_bytes"], r["payload_sha256"]) for r in media_chunks.facts(*media_chunks.store(df)).collect()}
    for i in range(300):
        raw = (str(i) if i % 10 == 0 else f"{passage}{i}").encode()
        assert got[i] == (len(raw), hashlib.sha256(raw + bytes(-len(raw) % 64)).hexdigest())
