"""Each operator on small tables against plain versions: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import random
import re

import numpy as np
import pytest
from brute import Groups, base_licenses, blank, contaminated, languages, near_groups, plain, sha, substrings, targets, tokens
from pyspark.sql import functions as F

from rasterloom.llm import chat, common, components, decontam, embeddings, langid, licenses, lines, minhash, mixing, substring
from rasterloom.llm import tokens as tok

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{k}" for k in range(60)]


def words(rng, n, vocabulary=WORDS):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def corpus():
    """Documents with whole copies, shared passages, edits, nulls, empties, a very long text and odd characters."""
    rng = random.Random(7)
    big = [f"v{k}" for k in range(5000)]
    passage, long = words(rng, 70, big), words(rng, 9000, big)
    base = words(rng, 150, big).split()
    rows = [words(rng, rng.randint(1, 200), big) for _ in range(40)]
    rows += [rows[0], rows[0], rows[1] + "\n", None, "", "  \t\n", long, long + " tail", "é ü ñ ß ÀÉ x", "a"]
    rows += [f"{words(rng, 30, big)} {passage} {words(rng, k, big)}" for k in range(12)]
    for k in range(30):
        edited = list(base)
        for _ in range(k % 5):
            edited[rng.randrange(150)] = f"e{rng.randrange(10 ** 6)}"
        rows.append(" ".join(edited))
    rows.append(" ".join(["same"] * 400))
    return [(i, t, ("en", "de", None)[i % 3], ("b", "a", None, "c")[i % 4 if i % 5 else 0], len(t or "")) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def pairs():
    return [(r[0], r[1]) for r in corpus()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


#: Names that the operators use inside, as extra columns.
CLASH = ["doc", "sha", "seeds", "hash", "key", "draw", "size", "rank", "target", "units", "row", "hi", "lo", "logs", "letters", "_key", "_id", "component", "component_id", "position"]


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


def tuples(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


# --- 1: token output ---------------------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [0, 1, 7, 239, 240, 241, 5000])
@pytest.mark.parametrize("kind", ["zeros", "small", "tokens", "mixed", "escapes"])
def test_simple8b_round_trip(n, kind):
    rng = np.random.default_rng(n)
    draw = {"zeros": [0], "small": [0, 1], "tokens": [2, 300, 20000, 49407], "mixed": [0, 0, 0, 1, 7, 2 ** 33, 2 ** 59], "escapes": [5, 2 ** 60, 2 ** 61, 2 ** 63, 2 ** 64 - 1]}[kind]
    ids = rng.choice(np.array(draw, "u8"), n)
    packed = tok.simple8b_encode(ids)
    assert (tok.simple8b_decode(packed, n) == ids).all()
    if kind == "zeros" and n > 240:
        assert len(packed) == -(-n // 240)


def test_word_encoder_equals_tokenizer(tokenizer):
    import public_tokenizers
    texts = ["It's Don'T ÉTÉ'S ,, .x a.b <|endoftext|> c", "Σ ΣΑΣ İ K é, é. x́,y", "\x1c a b 12a3,4 …,x,… ½", "", "   ", "\x01 odd", "a b c ﬁ", "'s 't'll n't", "é, e.́"]
    rng = random.Random(1)
    alphabet = "aAbéÉñß'’.,!?;:-_/\\<|>()$%#&* \n\t\r ́Σς中文1½"
    texts += ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(300)]
    encoder = tok.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), max_words=50)
    for t in (*texts, *texts):  # the cache is emptied again and again
        assert encoder.encode([t])[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    assert [x.tolist() for x in encoder.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_tokens_equal_brute_force(docs, pairs, tokenizer, empty):
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    assert tuples(tok.token_digest(clashing(docs)), *names) == sorted(tokens(pairs, tokenizer), key=repr)
    assert tok.token_digest(empty).count() == 0


def test_tokens_of_repeated_rows(spark, tokenizer):
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (0, None)], "doc_id long, text string")
    found = sorted(tok.token_digest(twice).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.n_tokens) for r in found] == [(None, 2), (0, 1), (1, 3), (1, 3)] and found[-1].start == 6


# --- 2: substrings -------------------------------------------------------------------------------------------------

def test_substrings_equal_brute_force(docs, pairs, empty):
    names = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert tuples(substring.dedup_substrings(clashing(docs)), *names) == sorted(substrings(pairs), key=repr)
    assert substring.dedup_substrings(empty).count() == 0


@pytest.mark.parametrize("window", [2, 3, 5, 8])
def test_substrings_of_few_words(spark, window):
    rng = random.Random(window)
    rows = [(i, words(rng, rng.randint(0, 30), ["a", "b", "c"])) for i in range(25)]
    found = substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), window)
    assert tuples(found, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(substrings(rows, window), key=repr)


def test_substring_ties(spark):
    text = " ".join(WORDS)
    rows = [(5, text), (5, text), (None, text), (9, text), (9, "x " + text)]
    found = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [(0, 60, 60), (5, 60, 0), (5, 60, 0), (9, 60, 60), (9, 61, 60)]


def test_kept_text(spark):
    rows = [(1, " ".join(WORDS)), (2, "start " + " ".join(WORDS) + " end")]
    kept = {r.doc_id: r.kept for r in substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), texts=True).collect()}
    assert kept == {1: None, 2: "start end"}


def test_levels_double_and_lose_what_is_not_repeated(spark):
    """Passages of 20, 40 and 60 words that two documents share survive the levels up to their length."""
    assert substring.levels(50) == [13, 25, 50] and substring.levels(400) == [13, 25, 50, 100, 200, 400] and substring.levels(7) == [7]
    rng = random.Random(15)
    word = lambda n: " ".join(f"u{rng.randrange(10 ** 9)}" for _ in range(n))
    rows = []
    for n in (8, 20, 40, 60):
        shared = word(n)
        rows += [(len(rows), f"{word(60)} {shared} {word(60)}"), (len(rows) + 1, f"{word(70)} {shared} {word(50)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"doc": F.col("doc_id"), "tk": F.xxhash64("text")})
    found = substring.scan(docs, 50)
    left = {length: {r.doc for r in met.collect()} for length, met in substring.surviving(docs, found, 50)}
    assert set(left) == {13, 25} and {6, 7} <= left[25] <= left[13] and left[13] <= {2, 3, 4, 5, 6, 7} and left[25] <= {4, 5, 6, 7}
    removed = {r.doc_id: r.n_removed for r in substring.dedup_substrings(docs).collect()}
    assert removed == {k: 60 if k == 7 else 0 for k in range(8)}
    none = spark.createDataFrame([(1, word(80)), (2, word(80))], "doc_id long, text string").withColumns({"doc": F.col("doc_id"), "tk": F.xxhash64("text")})
    assert [n for n, _ in substring.surviving(none, substring.scan(none, 50), 50)] == [13]  # no candidate survives the first level


# --- 3: mixing -----------------------------------------------------------------------------------------------------

def test_mix_targets_and_takes(docs, pairs, empty):
    found = mixing.positions(clashing(docs)).collect()
    size = {r.doc_id: len(blank(dict(pairs)[r.doc_id])) for r in found}
    sizes = {}
    for r in found:
        sizes[r.source] = sizes.get(r.source, 0) + size[r.doc_id]
    expected = targets(sizes)
    for r in found:
        assert r.size == size[r.doc_id] and r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source])
        assert r.taken <= 3 * r.size and r.taken == r.size * len(r.positions) and list(r.positions) == sorted(r.positions)
        assert all(0 <= p <= 1 for p in r.positions)
    for s in sizes:
        largest = max(size[r.doc_id] for r in found if r.source == s)
        assert abs(sum(r.taken for r in found if r.source == s) - expected[s]) <= largest / 2 + 1e-6
    again = mixing.positions(docs).collect()
    assert {(r.doc_id, r.taken, tuple(r.positions)) for r in found} == {(r.doc_id, r.taken, tuple(r.positions)) for r in again}
    assert mixing.positions(empty).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {"a": 1, "b": 1, "c": 1, None: 97}, {"a": 100}, {"a": 0, "b": 50}, {f"s{k}": 1 + k * k for k in range(30)}])
def test_water_filling(spark, sizes):
    rows = [(s, n) for s, n in sizes.items()]
    found = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, size long"), (5, 2, 1), 3).collect()}
    assert found == pytest.approx(targets(sizes)) and sum(found.values()) == pytest.approx(sum(sizes.values()))


def test_time_inverts_the_integral(spark):
    schedule = ((0.0, 2.0), (0.5, 1.0), (0.7, 0.0), (1.0, 3.0))
    segments = mixing.demand_segments(schedule)
    t = spark.range(101).select((F.col("id") / 100).alias("u")).select("u", mixing.time_of(F.col("u"), segments).alias("t")).collect()
    grid = np.linspace(0, 1, 200_001)
    density = np.interp(grid, *zip(*schedule))
    area = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2)])
    for r in t[1:-1]:
        assert np.interp(r.t, grid, area / area[-1]) == pytest.approx(r.u, abs=1e-4)
    with pytest.raises(ValueError):
        mixing.demand_segments(((0.0, 1.0), (0.5, 1.0)))


def test_mixed_rows_are_whole_copies(docs):
    taken = {r.doc_id: len(r.positions) for r in mixing.positions(docs).collect()}
    docs = clashing(docs)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {i: n for i, n in taken.items() if n}
    assert mixed.distinct().exceptAll(docs).isEmpty()


# --- 4: licenses ---------------------------------------------------------------------------------------------------

LICENSED = ["Released under the MIT License.", "the mit  license, MIT-LICENSE mit license", "Licensed under the Apache License, Version 2.0.", "mit", "license mit",
            "GNU General Public License general public\nlicense", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this big software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
            None, "", "mité license", "word " * 3000 + "apache license"]


def test_licenses_equal_brute_force(spark):
    rows = list(enumerate(LICENSED)) + [(0, LICENSED[0]), (None, "mit license")]
    found = licenses.scan_licenses(clashing(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found), key=repr) == sorted(((i, *base_licenses(t, licenses.BASE)) for i, t in rows), key=repr)
    by = {r.doc_id: r for r in found}
    assert by[2].labels == "apache,apache-2.0" and by[6].labels == "gpl,gpl-3.0" and by[7].labels == "cc-by-nc-4.0" and by[8].labels == "mit-text" and 0.9 <= by[8].score < 1
    assert (by[3].labels, by[3].score, by[9].n_words, by[10].labels) == ("", 0.0, 0, "")
    assert all({*r.base_labels.split(",")} - {""} <= {*r.labels.split(",")} and 0 <= r.score <= 1 for r in found)


def test_spans_are_verified_in_order(spark):
    """Stutters, shuffled words and words put in are counted; long texts are found, in one document several times; SQL says the same."""
    import duckdb
    import pandas as pd
    from oracle import oracle_rows, rows

    from rasterloom.llm import oracles
    rng = random.Random(8)
    texts = dict((label, text) for text, label in (*licenses.NOTICES, *licenses.TEXTS))
    apache, mit, bsd = texts["apache-text"].split(), texts["mit-full"].split(), texts["bsd-3-full"].split()
    # Every pair of words stands in the stutter, though the text is twice as long; the mixed one has the words in blocks of another order.
    stutter = " ".join(w for a, b in zip(apache, apache[1:]) for w in (a, b))
    mixed = " ".join(w for k in (2, 0, 3, 1) for w in mit[k * 41:(k + 1) * 41])
    edited = lambda w, n: [rng.choice([[], ["new"], [x, "new"]]) if k in few else [x] for few in [set(rng.sample(range(len(w)), n))] for k, x in enumerate(w)]
    flat = lambda parts: " ".join(x for part in parts for x in part)
    made = [stutter, mixed, " ".join(apache), " ".join(mit).title(), "some words " + " ".join(bsd) + " and more", flat(edited(mit, 8)), flat(edited(mit, 40)), flat(edited(bsd, 12)),
            " ".join(mit + mit), " ".join(mit[:100]), "x " * 300 + " ".join(bsd) + " y " * 9 + " ".join(mit), " ".join(rng.choice(mit) for _ in range(2000)), "permission is " * 500]
    found = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).collect()}
    has = lambda k, label: label in found[k].labels.split(",")
    assert not has(0, "apache-text") and not has(1, "mit-full") and has(2, "apache-text") and found[2].score == 1
    assert has(3, "mit-full") and has(4, "bsd-3-full") and has(5, "mit-full") and not has(6, "mit-full") and has(7, "bsd-3-full") and has(8, "mit-full") and not has(9, "mit-full")
    assert has(10, "mit-full") and has(10, "bsd-3-full") and found[11].labels == found[12].labels == ""
    assert sorted(r.start for r in licenses.spans(spark.createDataFrame([(0, made[8])], "doc_id long, text string")).where("label = 'mit-full'").collect()) == [0, len(mit)]
    documents = pd.DataFrame([(k, t) for k, t in enumerate(made + [t for t in LICENSED if t is not None])], columns=["doc_id", "text"])
    con = duckdb.connect()
    con.register("documents", documents)
    assert rows(licenses.scan_licenses(spark.createDataFrame(documents))) == oracle_rows(con, oracles.LICENSES)


def test_custom_templates_and_letters(spark):
    """Only A-Z are lower-cased, quotes in a label do no harm, and a template of too many words is refused."""
    docs = spark.createDataFrame([(1, "the \u212Aey LICENSE"), (2, "The KEY license É"), (3, "the key license é")], "doc_id long, text string")
    found = {r.doc_id: r.labels for r in licenses.scan_licenses(docs, base=(("key license", "it's"),), notices=(("the key license é", "acute"),)).collect()}
    assert found == {1: "", 2: "it's", 3: "acute,it's"}
    with pytest.raises(Exception, match="too many different words"):
        licenses.scan_licenses(docs, notices=((" ".join(f"w{k}" for k in range(300)), "long"),)).collect()


def test_licenses_run_no_python(spark):
    plan = licenses.scan_licenses(spark.createDataFrame([(1, "mit license")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- 5: lines ------------------------------------------------------------------------------------------------------

def test_site_lines(spark):
    page = lambda k, more="": f"<html><nav><ul><li>Home</li><li>About us</li></ul></nav><p>Text {k}</p><script>var x = '<p>';</script><p>All  same</p>{more}</html>"
    rows = [(k, f"https://www.Site.example/{k}", page(k)) for k in range(10)] + [(20, "http://small.example/", page(20)), (21, None, page(21)), (22, "http://site.example/x", None), (22, "http://site.example/x", "")]
    rows += [(30 + k, "http://other.example/", page(30 + k, "<p>Only here</p>" * (k == 0))) for k in range(5)]
    found = lines.drop_site_lines(clashing(spark.createDataFrame(rows, "page_id long, url string, html string")).withColumn("lines", F.lit(1))).collect()
    by = {r.page_id: r for r in found}
    assert by[3].host == "site.example" and by[3].n_lines == 4 and by[3].kept == ["Text 3"] and by[20].n_dropped == 0 and by[21].host == ""
    assert by[30].kept == ["Text 30", "Only here"] and len(found) == len(rows) and by[22].n_lines == 0
    assert lines.drop_site_lines(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_site_lines_of_a_long_page(spark):
    """100,000 lines that three pages share, a line of their own every thousand and one that repeats: linear, in order, repeats kept."""
    import time
    own = lambda k: [f"own {k} {i}" if i % 1000 == 0 else "again and again " + str(k) if i % 1000 == 1 else f"shared {i}" for i in range(100_000)]
    rows = [(k, "http://long.example/", "<br>".join(own(k))) for k in range(3)] + [(9, "http://other.example/", "<p>shared 2</p>")]
    began = time.time()
    by = {r.page_id: r for r in lines.drop_site_lines(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert time.time() - began < 60
    assert all(by[k].kept == [x for x in own(k) if not x.startswith("shared")] and by[k].n_dropped == 99_800 for k in range(3)) and by[9].n_dropped == 0


# --- 6: language ---------------------------------------------------------------------------------------------------

def test_language_accuracy_on_held_out_rows(spark):
    import os
    data = "/root/testdata/sf0.01"
    if not os.path.exists(data):
        pytest.skip("no data")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    held = docs.withColumn("told", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    found = langid.identify(held.select("doc_id", "text", "lang", "told", "source"), F.lit(None).cast("string"), F.col("source"), F.col("told"))
    assert found.where("told IS NULL").agg(F.avg((F.col("language") == F.col("lang")).cast("int"))).first()[0] > 0.97
    assert found.where("kept").count() >= 0.99 * docs.count()
    pages = langid.identify_pages(spark.read.parquet(f"{data}/pages.parquet"))
    assert pages.agg(F.avg((F.col("language") == F.col("declared")).cast("int"))).first()[0] > 0.97


def test_language_evidence(spark):
    rng = random.Random(3)
    en, de = ["the", "and", "with", "that", "from"], ["der", "und", "nicht", "mit", "schön"]
    rows = [(k, words(rng, 30, en), "en", "a.example.uk") for k in range(20)] + [(20 + k, words(rng, 30, de), "de", "b.example.de") for k in range(20)]
    rows += [(100, None, "en", "x"), (101, "", None, None), (102, "123 !!", "de", "b.example.de"), (103, "x", None, "b.example.de"), (103, "x", None, "b.example.de"), (104, "the und", "de", "b.example.de"), (105, "the and with that from", "zz", None)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    found = {r.doc_id: r for r in langid.identify_documents(docs).collect()}
    assert all(found[k].language == "en" and found[k].kept for k in range(20)) and all(found[20 + k].language == "de" for k in range(20))
    assert all(found[k].language == "und" and not found[k].kept for k in (100, 101, 102)) and found[103].language == "de" and found[105].language == "en"
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(found) - {100, 101, 102} and kept.count() == 20 + 20 + 4
    nothing = spark.createDataFrame([(1, "abc", None, None)], "doc_id long, text string, lang string, source string")
    assert langid.identify_documents(nothing).first().language == "und" and langid.identify_documents(nothing.where("false")).count() == 0


def test_rare_and_many_languages_are_all_known(spark):
    """A language of three rows among 2,000 is known and found, and so is each of 80 languages."""
    rng = random.Random(4)
    en, fi = ["the", "and", "with", "that", "from"], ["ja", "että", "hyvä", "päivä", "kuusi"]
    rows = [(k, words(rng, 30, en), "en", "a") for k in range(2000)] + [(3000 + k, words(rng, 30, fi), "fi", "a") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    known, model = langid.fit(docs.select("text", F.col("lang").alias("label")), 50)
    assert known == ["en", "fi", "und"] and model.shape[1] == 3
    found = {r.doc_id: r.language for r in langid.identify_documents(docs).collect()}
    assert all(found[3000 + k] == "fi" for k in range(3)) and all(found[k] == "en" for k in range(2000))
    codes = [a + b for a in "abcdefgh" for b in "abcdefghij"]
    many = [(k, words(rng, 40, [code[0] * 2 + x + code[1] * 2 for x in "klmnopq"]), code, "a") for k, code in enumerate(codes)]
    assert {r.language: r.told for r in langid.identify_documents(spark.createDataFrame(many, "doc_id long, text string, lang string, source string").withColumn(
        "told", F.col("lang"))).collect()} == {c: c for c in codes}


def test_language_without_a_model_is_rejected(spark):
    """Texts of no fitted language and junk are und, though a posterior over the fitted ones alone would be near 1."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    strange = ["Tämä on suomenkielinen teksti, jota yksikään malli ei tunne, ja siksi sen pitäisi jäädä pois kokonaan.",
               "Это текст на русском языке, которого нет среди известных языков этой таблицы.", "qxzvk jwqpz xkcvq zzxqj vkwpq jxqzk wvqkz pxjqv kqzwx"]
    more = spark.createDataFrame([(-1 - k, t, None, "src0") for k, t in enumerate(strange)], docs.schema)
    found = {r.doc_id: r for r in langid.identify_documents(docs.unionByName(more)).collect()}
    assert all(found[-1 - k].language == found[-1 - k].text_language == "und" and not found[-1 - k].kept for k in range(3))
    assert sum(r.kept for d, r in found.items() if d >= 0) >= 0.99 * docs.count()


def test_languages_equal_brute_force(spark):
    """Text, declaration, host, domain and suffix together, each row without its own part in its host's share."""
    rng = random.Random(5)
    vocabulary = {"en": ["the", "and", "with", "that", "from"], "de": ["der", "und", "nicht", "mit", "schön"], "fr": ["les", "et", "avec", "été", "dans"]}
    hosts = {"en": ["a.one.uk", "b.one.uk", "x.org"], "de": ["c.two.de", "d.three.de", "x.org"], "fr": ["e.four.fr", "x.org"]}
    rows = []
    for k in range(120):
        lang = rng.choice(["en", "de", "fr"])
        text = " ".join(rng.choice(vocabulary[lang if rng.random() < 0.8 else rng.choice(["en", "de", "fr"])]) for _ in range(rng.randint(1, 8)))
        rows.append((k, text, rng.choice([None, lang, "en", "zz", lang + "-XX"]), rng.choice(hosts[lang]), lang if k % 2 else None))
    rows += [(200, None, "en", "a.one.uk", "en"), (201, "", None, "", None), (202, "123", "de", "c.two.de", None), (203, "ÀÉ <html lang='de'> Zx", None, "new.two.de", None), (204, "der " * 30_000, None, "new.uk", None)]
    rows.append(rows[5])
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, said string, address string, lang string")).withColumns({"letters": F.lit(1), "_host": F.lit("x"), "_o0": F.lit(2)})
    found = langid.identify(docs, F.col("said"), F.col("address"), F.col("lang")).collect()
    code = lambda said, text: (said or "").split("-")[0] or ("de" if "lang='de'" in (text or "") else None)
    expected = languages([(t, code(d, t), h, label) for _, t, d, h, label in rows], lambda seen: langid.background(np.array(seen)))
    by = {r[0]: e for r, e in zip(rows, expected)}
    assert len(found) == len(rows)
    for r in found:
        assert (r.language, r.text_language) == (by[r.doc_id][0], by[r.doc_id][2]) and r.confidence == pytest.approx(by[r.doc_id][1], rel=1e-4, abs=1e-9)
    assert any(r.language != r.text_language for r in found)


def test_pages_with_columns_of_any_name(spark):
    rows = [(1, "http://a.uk/", "<html lang='en-GB'><p>the and with that from</p></html>"), (2, None, None), (3, "http://b.de", ""), (4, "http://b.de", "<html lang=de>der und nicht mit schön")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("mine"), "markup": F.lit("mine"), "_declared": F.lit(1), "a.b": F.lit(2)})
    found = {r.page_id: r for r in langid.identify_pages(pages).collect()}
    assert (found[1].language, found[1].declared, found[1].text, found[1].markup, found[4].language) == ("en", "en", "mine", "mine", "de")
    assert not found[2].kept and not found[3].kept and langid.identify_pages(pages.where("false")).count() == 0


def test_language_query_takes_documents_and_pages(spark, data):
    found = langid.op6_language_id(spark, data).collect()
    docs, pages = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/pages.parquet")
    assert sorted(r.doc_id for r in found if r.page_id is None) == sorted(r.doc_id for r in docs.collect())
    assert sorted(r.page_id for r in found if r.page_id is not None) == sorted(r.page_id for r in pages.collect())
    assert all(r.doc_id == -1 - r.page_id for r in found if r.page_id is not None)
    langs = {r.doc_id: r.lang for r in docs.collect()}
    assert np.mean([r.language == langs[r.doc_id] for r in found if r.page_id is None and r.kept]) > 0.97
    assert np.mean([r.language == r.declared for r in found if r.page_id is not None]) > 0.9


def test_pieces_of_long_texts_score_as_whole(spark, monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 30)
    model = np.log(np.random.default_rng(1).dirichlet(np.ones(1 << langid.BITS), 3).T).astype("f4")
    docs = spark.createDataFrame([(0, "abc def" * 50), (1, ""), (2, None), (3, "xyz" * 999)], "doc_id long, text string")
    for r in langid.score(docs, ["a", "b", "und"], model).collect():
        place, _ = langid.trigrams([docs.where(f"doc_id = {r.doc_id}").first().text])
        assert np.allclose(r.logs, model[place[place >= 0]].sum(0, dtype="f8") * langid.WEIGHT, rtol=1e-5) and r.letters == (place >= 0).sum()


def test_addresses_of_pages_tell_by_host_domain_and_suffix(spark):
    """Pages of one word that fits both languages go with their host's, domain's or suffix's pages."""
    rng = random.Random(6)
    en, de = ["the", "and", "with", "that", "from"], ["der", "und", "nicht", "mit", "schön"]
    page = lambda lang, text: f"<html lang='{lang}'><script>x</script><p>{text}</p></html>"
    rows = [(k, f"https://www.{h}/p?{k}", page(lang, words(rng, 30, v))) for k, (h, lang, v) in enumerate(
        [("a.one.uk", "en", en), ("b.one.uk", "en", en), ("c.two.de", "de", de), ("d.two.de", "de", de)] * 20)]
    alike = "<p>the der and und</p>"
    rows += [(1000, "http://a.one.uk/", alike), (1001, "http://new.one.uk", alike), (1002, "https://x.new.uk/", alike),
             (2000, "http://c.two.de/", alike), (2001, "http://new.two.de", alike), (2002, "https://x.new.de/", alike)]
    found = {r.page_id: r for r in langid.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[k].language == found[k].declared for k in range(80))
    en_share = {k: found[k].confidence if found[k].language == "en" else 1 - found[k].confidence for k in range(1000, 2003) if k in found}
    assert all(en_share[1000 + k] > en_share[2000 + k] + 0.05 for k in range(3))


# --- 7: decontamination -------------------------------------------------------------------------------------------

def bench(spark, docs_rows):
    rng = random.Random(9)
    items = [(1, " ".join(plain(docs_rows[2][1])[:40])), (2, "Short item here"), (2, "short item again"), (3, ""), (4, None), (None, "null item " * 10), (5, words(rng, 20, ["a", "b"]))]
    return items, spark.createDataFrame(items, "item_id long, text string")


def test_decontamination_equals_brute_force(spark, pairs):
    rng = random.Random(4)
    items, table = bench(spark, pairs)
    rows = pairs + [(500 + k, words(rng, rng.randint(0, 60), ["a", "b", "short", "item", "here", "again"])) for k in range(60)] + [(700, "short, ITEM here"), (700, "short, ITEM here")]
    rows += [(800, words(rng, 300) + " short item here"), (801, " ".join(plain(pairs[2][1])[5:30]) + " " + words(rng, 20))]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    expected = sorted(contaminated(rows, [i for i in items if i[0] is not None]), key=repr)
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert tuples(decontam.decontaminate(docs, table), *names) == expected
    assert tuples(decontam.decontaminate(docs, table, chunk_words=10), *names) == expected  # several automata
    assert any(r[5] for r in expected) and any(r[2] and not r[5] for r in expected)
    kept = decontam.decontaminate(docs, table, keep=True)
    flagged = {r[0] for r in expected if r[5]}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - flagged
    again = decontam.decontaminate(kept.where("doc_id = 800"), table).first()
    assert again.n_hit == 0 and again.n_words == 300


def test_decontamination_without_benchmark(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(docs, none).where("n_hit > 0").isEmpty() and decontam.decontaminate(empty, none).count() == 0
    assert decontam.decontaminate(docs, none, keep=True).count() == docs.count()


def test_chunks_hold_one_automaton_of_known_size(spark):
    """Chunks come one by one; each takes a bounded number of bytes a word, also where all words differ."""
    import pickle
    rng = random.Random(1)
    for vocabulary in (50, 10 ** 6):
        items = [(k, " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(200))) for k in range(50)]
        assert len(pickle.dumps(decontam.Matcher(items, 13))) <= 80 * 10_000
    got = list(decontam.chunks(spark.createDataFrame(items, "item_id long, text string"), 13, 1000))
    assert len(got) == 10 and all(m.shortest == 13 for m in got)


def test_coverage_is_taken_as_given(spark):
    item = " ".join(f"i{k}" for k in range(13))
    docs = spark.createDataFrame([(n, item + " x" * (n - 13)) for n in (104, 105, 3250, 3251)], "doc_id long, text string")
    table = spark.createDataFrame([(1, item)], "item_id long, text string")
    for coverage, bound in ((0.125, 104), (0.004, 3250)):
        found = {r.doc_id: r.contaminated for r in decontam.decontaminate(docs, table, coverage=coverage).collect()}
        assert found == {n: n <= bound for n in found}


def test_cut_words():
    hit = np.array([False, True, True, False, True])
    assert decontam.cut_words("Ab, cd (ef) gh: ij!", hit) == "Ab, ) gh: !"
    assert decontam.cut_words("a b", np.array([True, True])) == ""
    assert decontam.cut_words("", np.zeros(0, bool)) == ""


# --- 8: embeddings ------------------------------------------------------------------------------------------------

def linked(rows, threshold=0.9):
    unit = []
    for _, v in rows:
        ok = v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)
        unit.append(np.array(v, "f8") / np.sqrt((np.array(v, "f8") ** 2).sum()) if ok else None)
    ids = [r[0] if r[0] is not None else 2 ** 63 - 1 for r in rows]
    groups, links = Groups(), [0] * len(rows)
    for a in range(len(rows)):
        groups.find(a)
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a], links[b] = links[a] + 1, links[b] + 1
                groups.join(a, b)
    least = {}
    for a in range(len(rows)):
        least[groups.find(a)] = min(least.get(groups.find(a), 2 ** 63), ids[a])
    return sorted(((rows[a][0], links[a], least[groups.find(a)], ids[a] == least[groups.find(a)]) for a in range(len(rows))), key=repr)


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(12, 16))
    x = np.concatenate([base[i % 12] + rng.normal(size=16) * rng.choice([0, 0.1, 0.3, 0.4]) for i in range(200)]).reshape(-1, 16).astype("f4")
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, []), (905, [1.0, 0.0]), (906, [3.0, 0.0]), (907, [1.0, 0.0, 0.0]), (None, rows[3][1]), (7, rows[7][1]), (908, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"label": F.lit(1), "links": F.lit(1), "raw": F.lit("x")})
    for chunk in (512, 8):
        assert tuples(embeddings.near_vectors(df, chunk=chunk), "vec_id", "n_links", "component_id", "kept") == linked(rows)
    assert embeddings.near_vectors(df.where("false")).count() == 0


@pytest.mark.parametrize("cosine", [0.9001, 0.95])
def test_embedding_recall(cosine):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 3000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b = cosine * a + np.sqrt(1 - cosine ** 2) * b / np.linalg.norm(b, axis=1)[:, None]
    meet = (embeddings.buckets_of(a, 10, 2)[:, :, :, None] == embeddings.buckets_of(b, 10, 2)[:, :, None, :]).any((1, 2, 3))
    assert meet.mean() > 0.998


# --- 9: chats -----------------------------------------------------------------------------------------------------

CHAT = [(1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "On Monday, Bob wrote:\n> Hello there\n> how  are you\nFine, thanks. The long report about turbines\nis ready to be read. Yes."),
        (1, 2, "user", "> Fine, thanks\n>> How are you?\nGreat"), (2, 0, "user", "> > hello there\n> The LONG report about\n> turbines is ready\n> to be read.\n> Great\nme too"), (2, 1, "assistant", None),
        (2, 2, None, ">nothing known\n"), (2, 3, "user", "> yes\nNo link\x01 at all"), (3, 0, "user", "Great"), (3, 0, "user", "Great"), (4, 0, "user", "> Fine, thanks.\n> The long report about turbines is\nWhich part? All of it! 好的。再见"),
        (4, 1, "assistant", "> all of it\n>> the long report about turbines is ready to be read. Yes\nSo be it.\n\nEnd"), (5, 0, "user", ">> So be it. End.\nthe circle is closed from here\n> And it ends where it began."),
        (6, 0, "user", "> the circle is closed from here\nAnd it ends where it began.")]


def quoting(data):
    """The given conversations, where every fourth message also quotes part of another one, wrapped anew."""
    rng = random.Random(12)
    import duckdb
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{data}/conversations.parquet' ORDER BY 1, 2").fetchall()
    made = []
    for k, (conv, turn, role, text) in enumerate(rows):
        if k % 4 == 3:
            other = rows[rng.randrange(max(0, k - 3), k) if k % 8 == 3 else rng.randrange(len(rows))][3] or ""
            sentences = re.split(r"(?<=[.!?])\s+", other)
            at = rng.randrange(len(sentences))
            quoted = " ".join(sentences[at:at + 3]).split()
            width = rng.randrange(2, 9)
            text = "\n".join("> " + " ".join(quoted[i:i + width]) for i in range(0, len(quoted), width)) + f"\n{text}"
        made.append((conv, turn, role, text))
    return made


def chat_oracles(rows_of, spark):
    import duckdb
    import pandas as pd
    from oracle import oracle_rows, rows
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows_of, columns=["conv_id", "turn", "role", "text"]))
    m = spark.createDataFrame(rows_of, "conv_id long, turn long, role string, text string")
    assert rows(chat.link_quotations(clashing(m))) == oracle_rows(con, chat.LINKED_SQL)
    found = rows(chat.conversations(clashing(m)))
    assert found == oracle_rows(con, chat.ORACLE_SQL)
    return m, found


def test_chat_equals_oracle(spark):
    m, _ = chat_oracles(CHAT, spark)
    by = {(r.conv_id, r.turn): r for r in chat.link_quotations(m).collect()}
    assert (by[1, 1].parent_turn, by[1, 2].parent_turn, by[2, 0].parent_conv, by[2, 0].parent_turn, by[2, 0].depth) == (0, 1, 1, 1, 2)
    assert by[2, 2].parent_turn is None and by[2, 3].parent_turn is None and by[2, 3].n_quoted == 1
    assert by[1, 1].text.startswith("Fine, thanks.") and by[2, 1].text == "" and by[1, 2].n_linked == 1 and by[4, 1].parent_conv == 4
    assert by[5, 0].parent_conv is None and (by[6, 0].parent_conv, by[6, 0].conversation) == (5, 5)  # a circle ends at its first message
    made = chat.conversations(m).collect()
    assert sum(r.n_messages for r in made) == sum(r.text != "" for r in chat.link_quotations(m).collect()) and any("<|user|>\nHello there" in r.chat for r in made)
    assert chat.link_quotations(m.where("false")).count() == 0 and chat.conversations(m.where("false")).count() == 0


def test_chat_of_given_messages_with_quotes(spark, data):
    """Over the given table with quotes put in: equal to SQL, and most quotes find a message."""
    m, _ = chat_oracles(quoting(data), spark)
    counts = chat.link_quotations(m).agg(F.sum("n_quoted"), F.sum("n_linked")).first()
    assert counts[0] > 40 and counts[1] > 0.6 * counts[0]


def test_conversations_do_not_depend_on_partitions(spark):
    """Parts of a long conversation are the same whatever the partitions, and hold its messages in order."""
    rows = [(1, k, "user", f"message {k}") for k in range(150)] + [(2, 0, None, "alone"), (None, None, "user", "no number")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    key, found = "spark.sql.shuffle.partitions", []
    before = spark.conf.get(key)
    for n in (1, 4, 17):
        spark.conf.set(key, n)
        found.append(sorted(map(tuple, chat.conversations(m).collect()), key=repr))
    spark.conf.set(key, before)
    assert found[0] == found[1] == found[2] and [r[2] for r in found[0] if r[0] == 1] == [64, 64, 22]
    long = [r for r in found[0] if r[0] == 1]
    assert "\n".join(r[-1] for r in sorted(long, key=lambda r: r[1])) == "\n".join(f"<|user|>\nmessage {k}\n<|end|>" for k in range(150))
    assert ("<|unknown|>\nalone\n<|end|>" in {r[-1] for r in found[0]}) and any(r[0] is None for r in found[0])


def test_conversations_order_whole_lines(spark):
    """Messages of one place that differ beyond the characters that ranges are told by, and repeated ones, are in the order of their whole text."""
    rows = [(1, 0, "user", "the same beginning " * 9 + str(k % 70)) for k in range(100)] + [(1, 1, "user", "x")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    made = sorted(chat.conversations(m).collect(), key=lambda r: r.part)
    assert "\n".join(r.chat for r in made) == "\n".join(f"<|{r[2]}|>\n{r[3]}\n<|end|>" for r in sorted(rows, key=lambda r: (r[1], f"{r[3]}\n")))


def test_chat_nulls_and_long_chains(spark):
    rows = [(None, None, None, "first line"), (None, 1, "user", "> first line\nnext"), (5, 0, "user", "line 0")] + [(5, k, "user", f"> line {k - 1}\nline {k}") for k in range(1, 40)]
    rows.append((6, 0, "user", "> line 3\n" * 20_000 + "a very long message. " * 20_000))
    by = {(r.conv_id, r.turn): r for r in chat.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert by[None, 1].depth == 1 and by[None, 1].conversation is None and by[5, 39].depth == 39 and by[5, 39].root_turn == 0 and by[6, 0].n_quoted == 1


def test_chat_links_across_conversations(spark):
    """Originals under a larger conv_id are found, circles end, and a frequent or short sentence alone links nothing across conversations."""
    rows = [(1, 0, "user", "> the only original\nsome answer"), (9, 0, "user", "the only original"),
            (2, 0, "user", "> the beta line of text\nthe alpha line of text"), (7, 0, "user", "> the alpha line of text\nthe beta line of text"), (8, 0, "user", "> the beta line of text\nat the end")]
    rows += [(100 + k, 0, "user", "Thanks for all of it\n\nok then" if k == 5 else f"Thanks for all of it\n\nmessage {k}\n\nok then") for k in range(12)]
    rows += [(200, 0, "user", "> Thanks for all of it\nwell"), (201, 0, "user", "> Thanks for all of it.\n> ok then\nwell"), (202, 0, "user", "ok then"), (202, 1, "user", "> ok then\nwell")]
    rows += [(300, 0, "user", "Yes"), (301, 0, "user", "> yes\nwell")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by = {(r.conv_id, r.turn): r for r in chat.link_quotations(m).collect()}
    assert (by[1, 0].parent_conv, by[1, 0].conversation, by[1, 0].depth) == (9, 9, 1)
    assert by[2, 0].parent_conv is None and (by[7, 0].parent_conv, by[7, 0].depth) == (2, 1) and (by[8, 0].conversation, by[8, 0].depth) == (2, 2)
    assert by[200, 0].parent_conv is None and by[200, 0].n_linked == 0
    assert by[201, 0].parent_conv == 105 and by[201, 0].n_linked == 2 and by[202, 1].parent_conv == 202 and by[301, 0].parent_conv is None
    loose = {(r.conv_id, r.turn): r for r in chat.link_quotations(m, least=3, rare=50).collect()}
    assert loose[200, 0].parent_conv == 100 and loose[301, 0].parent_conv == 300 and loose[1, 0].parent_conv == 9


@pytest.mark.parametrize("ring,tail", [(1, 3), (2, 0), (37, 50), (64, 1)])
def test_chat_circles_of_any_length_end(spark, ring, tail):
    me = lambda k: (k, 0, k)
    edges = [(me(k), me(k % ring)) for k in range(ring, ring + min(tail, 1))] + [(me(k), me(k - 1)) for k in range(ring + 1, ring + tail)]
    edges += [(me(k), me((k * 1 + 1) % ring)) for k in range(ring)] if ring > 1 else []
    kind = "struct<conv_id:long,turn:long,row:long>"
    found = {r.me[0]: r for r in chat.threads(spark.createDataFrame(edges, f"me {kind}, parent {kind}")).collect()}
    assert set(found) == set(range(1, ring + tail)) and all(r.root == me(0) for r in found.values())
    assert all(found[k].depth == (ring - k if k < ring else k - ring + 1) for k in found)


# --- 10: near-duplicates ------------------------------------------------------------------------------------------

def test_near_duplicates_equal_brute_force(docs, pairs, empty):
    found = minhash.near_duplicates(clashing(docs)).collect()
    expected = near_groups(pairs)
    assert {r.doc_id: r.component_id for r in found} == expected and all(r.kept == (r.component_id == r.doc_id) for r in found)
    kept = minhash.keep_firsts(clashing(docs))
    assert {r.doc_id for r in kept.collect()} == set(expected.values()) and kept.columns == clashing(docs).columns
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    """A large group of near copies, some too far from all: compared in blocks."""
    rng = random.Random(11)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(160):
        edited = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6])):
            edited[rng.randrange(120)] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(edited)))
    expected = near_groups(rows)
    assert len(set(expected.values())) > 10
    monkeypatch.setattr(minhash, "PAIRED", 8)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == expected


def test_near_duplicate_nulls_and_ties(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, None), (4, ""), (5, "a b"), (6, "a b"), (7, "a c")]
    found = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert found == sorted([(None, None, True), (None, None, True), (1, 1, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True), (6, 5, False), (7, 7, True)], key=repr)


def test_signature_agreement_is_the_weighted_jaccard():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 2 ** 63, 400).astype("u8")
    a, b = rng.random(400) * (rng.random(400) < 0.8), rng.random(400) * (rng.random(400) < 0.8)
    own = lambda w: (np.zeros(400, "i8")[w > 0], keys[w > 0], w[w > 0])
    k = 4096
    sa, sb = (minhash.signatures(o, r, 1, k, h)[0] for o, r, h in (own(a), own(b)))
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert (sa == sb).mean() == pytest.approx(truth, abs=4 * np.sqrt(truth * (1 - truth) / k)) and (sa != 0).all()


def test_near_duplicate_recall_by_similarity():
    """Pairs of edited texts meet in a band: nearly all of similarity 0.8 and more, few of 0.4 and less."""
    rng, texts = random.Random(21), []
    for k in range(600):
        base = [f"b{rng.randrange(10 ** 6)}" for _ in range(120)]
        edited = list(base)
        for _ in range(k % 12):
            edited[rng.randrange(120)] = f"x{rng.randrange(10 ** 6)}"
        texts += [" ".join(base), " ".join(edited)]
    owner, regions = minhash.elements(texts)
    keys = minhash.band_keys(minhash.signatures(owner, regions, len(texts), minhash.BANDS * minhash.ROWS), minhash.BANDS, minhash.ROWS)
    met = (keys[::2] == keys[1::2]).any(axis=1)
    units = [set(regions[owner == d].tolist()) for d in range(len(texts))]
    similar = np.array([len(a & b) / len(a | b) for a, b in zip(units[::2], units[1::2])])
    assert (similar >= 0.8).sum() > 100 and met[similar >= 0.8].mean() > 0.99 and met[(similar >= 0.7) & (similar < 0.8)].mean() > 0.9
    assert met[similar < 0.5].mean() < 0.5


def test_shared_units():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 80))) for _ in range(40)]
    out = rng.random(40) < 0.4
    expected = [[len(np.intersect1d(sets[i], sets[j])) for j in np.flatnonzero(~out)] for i in np.flatnonzero(out)]
    assert all((minhash.shared_units(sets, out, cells) == expected).all() for cells in (100, 10 ** 6))


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(500, 500)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    groups = Groups()
    for a, b in edges:
        groups.join(a, b)
    found = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: groups.find(x) for x in groups if x != 500}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shared_folder_is_the_session_s(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert sha(["a"], " ") and plain("A-b") == ["a", "b"]
