"""Collocations, SentencePiece and spelling variants against plain versions: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from oracle import connection, oracle_rows, rows
from pyspark.sql import functions as F

from rasterloom.llm import collocations, pieces, spelling

SCHEMA = "doc_id long, text string, lang string"
CLASH = ["word", "n", "near", "key", "phrase", "slice", "places", "length", "run", "id", "slip", "block", "ids", "words", "a", "l", "r", "score"]


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH})


# --- 11: collocations ----------------------------------------------------------------------------------------------

def plain_collocations(docs, least, most=2000, longest=5):
    total, f = Counter(), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    cand = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    dropped = set()
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if (lang, w[i:i + k]) in cand and 100 * a >= 100 * cand[lang, w[i:i + k]]:
                    dropped.add((lang, w[i:i + k]))
    out = defaultdict(list)
    for (lang, w), a in cand.items():
        if (lang, w) not in dropped:
            n = total[lang]
            score, _, left, right = min((1000 * a * n // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), left, right, n))
    found = []
    for lang, listed in out.items():
        for rank, (score, a, phrase, left, right, n) in enumerate(sorted(listed)[:most], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(found)


def phrases():
    rng = random.Random(11)
    words = ["the", "The", "of", "a", "New", "york", "é", "中", "x\x1cy", "\x00", "b"]
    docs = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "?!"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und"])) for i in range(120)]
    docs += [(None, None, None), (1, "", "en"), (1, " \t\n.,", "en"), docs[0], docs[0], (5, "new york city of the " * 3000, "en"), (6, "a a a a a a a a a a", "fr"), (7, "same same same", "")]
    return docs


@pytest.mark.parametrize("least, most", [(2, 2000), (5, 3), (100, 2000), (300, 2000)])
def test_collocations_equal_brute_force(spark, least, most):
    docs = phrases()
    found = collocations.collocations(clashing(spark.createDataFrame(docs, SCHEMA).repartition(3)), most=most, least=least)
    assert sorted(map(tuple, found.collect())) == plain_collocations(docs, least, most)


def test_collocations_do_not_depend_on_portions_or_buckets(spark):
    docs = phrases()
    for most_buckets, portion in ((1 << 16, 300), (1 << 20, 20_000)):
        found = collocations.collocations(spark.createDataFrame(docs, SCHEMA).repartition(2), least=4, most_buckets=most_buckets, portion=portion)
        assert sorted(map(tuple, found.collect())) == plain_collocations(docs, 4)
    with pytest.raises(ValueError):
        collocations.frequent_phrases(spark.createDataFrame(docs, SCHEMA), most_buckets=64)


def test_buckets_that_are_full_prune_nothing_and_lose_nothing():
    rows = [(lang or "und", (text or "").encode()) for _, text, lang in phrases()]
    stored = collocations._numbered(rows).to_pydict()
    held = collocations.Portion(*(stored[c][0] for c in ("ids", "words", "langs", "which")))
    hashes = held.windows.of(2)[held.starts(2)]
    batch = collocations._bucket_batch(hashes, 1 << 16, 3).to_pydict()
    counted = Counter()
    for number, places, counts in zip(batch["slice"], batch["places"], batch["counts"]):
        assert number == 0
        for p, c in zip(memoryview(places).cast("H").tolist(), counts):
            counted[p] = c
    assert counted == {p: min(c, 3) for p, c in Counter((hashes & collocations.np.uint64(0xFFFF)).tolist()).items()}


def test_collocations_of_no_rows(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, "en"), (2, "...", None)], SCHEMA)).count() == 0


def test_scores_pass_64_bits(spark):
    score = collocations._score("a", "n", "l", "r")
    big = spark.createDataFrame([(10 ** 15 + 1, 10 ** 16 + 3, 10 ** 15 + 7, 2 * 10 ** 15 + 9)], "a long, n long, l long, r long").select(score.alias("s")).first()[0]
    assert big == 1000 * (10 ** 15 + 1) * (10 ** 16 + 3) // ((10 ** 15 + 7) * (2 * 10 ** 15 + 9))


def test_collocations_equal_sql(spark, data):
    sql = collocations.ORACLE_SQL.replace(">= 100 GROUP", ">= 100").replace("HAVING count(*) >= 100", "HAVING count(*) >= 5")
    from rasterloom.llm import common
    assert rows(collocations.collocations(common.table(spark, data, "documents"), least=5)) == oracle_rows(connection(data), sql)


# --- 12: SentencePiece ---------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def model():
    import public_tokenizers
    import sentencepiece
    path = public_tokenizers.path("piece_bpe_32k.model")
    return path, sentencepiece.SentencePieceProcessor(model_file=path)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd_texts():
    rng = random.Random(12)
    alphabet = "aAbeé ▁▁   \n\t.th中🙂\x00<>0x1"
    texts = ["", None, " ", "  ", "   a  b ", "▁a", "a▁▁b", " ▁ ", "\n a", "<s> </s> <0x41> <unk>", "\x00", "ﬁ Å", "�", "word " * 4000, "x" * 30000, "a ", "a "]
    return texts + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(300)]


def test_marked_words_hold_alone(model):
    path, library = model
    assert pieces.parts_words(path)
    mark = library.piece_to_id(pieces.MARK)
    for text in odd_texts():
        ids = [i for w in pieces.marked_words(text or "") for i in (library.encode(w) if w else [mark])]
        assert ids == library.encode(text or "")


@pytest.mark.parametrize("block", [pieces.BLOCK, 300])
def test_pieces_equal_the_library(spark, model, block):
    path, library = model
    docs = [(i % 310, t, "en") for i, t in enumerate(odd_texts())] + [(None, "a b", None)]
    found = pieces.encode(clashing(spark.createDataFrame(docs, SCHEMA).repartition(2)), path, block)
    want = [(i, library.encode(t or "")) for i, t, _ in docs]
    assert sorted(((r.doc_id, list(r.ids)) for r in found.collect()), key=repr) == sorted(want, key=repr)
    digest = [(i, len(x), sha(",".join(map(str, x))), sha(library.decode(x))) for i, x in want]
    assert sorted(map(tuple, pieces.piece_digest(spark.createDataFrame(docs, SCHEMA), path).collect()), key=repr) == sorted(digest, key=repr)


def test_each_word_is_segmented_once(spark, model):
    path, library = model
    docs = spark.createDataFrame([(i, "the same words again " * 20, "en") for i in range(40)], SCHEMA).repartition(4)
    blocks = pieces._blocks(docs, path, 4)
    packs = blocks.select("block", F.explode("packs").alias("pack")).select("block", "pack.part", "pack.words")
    assert blocks.count() == 4 and packs.count() == sum(len(r.packs) for r in blocks.collect())
    parts = defaultdict(set)
    for r in packs.collect():
        for w in pieces.unpacked(r.words).split(pieces.BREAK):
            parts[w].add(r.part)
    assert set(parts) == {b"the", b"same", b"words", b"again", b""} and all(len(p) == 1 for p in parts.values())


def test_a_vocabulary_whose_pieces_cross(spark, model, monkeypatch):
    path, library = model
    monkeypatch.setattr(pieces, "parts_words", lambda path: False)
    texts = [(1, "a b  c"), (2, ""), (3, None), (4, " ")]
    cut = pieces._block(0, [(i, t or "") for i, t in texts], 2, lambda t: [t] if t else [])
    assert sum(cut["sizes"].to_pylist()[0]) == 2


def test_pieces_of_no_rows(spark, model):
    assert pieces.piece_digest(spark.createDataFrame([], SCHEMA), model[0]).count() == 0
    only_empty = pieces.piece_digest(spark.createDataFrame([(1, None, ""), (2, "", "")], SCHEMA), model[0]).collect()
    assert sorted(map(tuple, only_empty)) == [(1, 0, sha(""), sha("")), (2, 0, sha(""), sha(""))]


# --- 13: spelling variants -----------------------------------------------------------------------------------------

def plain_words(docs, one_in=31):
    n = Counter()
    for i, text, _ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(n):
    form, out = {}, []
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda v: (-n[v], v))
            if n[best] >= 10 * n[w]:
                form[w] = best
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=repr)


def spelled():
    rng = random.Random(13)
    docs = []
    bases = ["running", "Running", "aaaaaaa", "abababab", "straßenbahn", "Überfluss", "überfluss", "naïveté", "mississippi", "multiplied×x", "recieve÷it"]
    for i in range(400):
        words = []
        for _ in range(12):
            w = rng.choice(bases[:3] if rng.random() < 0.6 else bases)
            if rng.random() < 0.25:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("abeé") + w[at:], w[:at] + rng.choice("abeé") + w[at + 1:]])
            words.append(w)
        docs.append((i, rng.choice([" ", "-", "1"]).join(words), "en"))
    docs += [(None, "running running Überfluss", None), (3, None, None), (4, "", None), docs[0], docs[0], (5, "running" * 5000 + " " + "running " * 3000, None), (6, "short œuvres 中文", None)]
    return docs


def test_words_equal_brute_force(spark):
    docs = spelled()
    for one_in in (31, 2):
        found = spelling.spelled_words(clashing(spark.createDataFrame(docs, SCHEMA).repartition(3)), one_in=one_in)
        assert {r.word: r.n for r in found.collect()} == plain_words(docs, one_in)


def test_variants_equal_brute_force(spark):
    docs = spelled()
    found = spelling.spelling_variants(clashing(spark.createDataFrame(docs, SCHEMA).repartition(3)))
    want = plain_variants(plain_words(docs))
    assert sorted(map(tuple, found.collect()), key=repr) == want
    assert any(r[1] for r in want)


def test_pairs_come_once_and_roots_go_far(spark):
    n = {"aaaaaaa": 10 ** 5, "aaaaaab": 10 ** 4, "aaaaaabb": 10 ** 3, "aaaaabbb": 100, "aaaabbbb": 10, "baaaaaaa": 10, "abaaaaa": 7, "ÿaaaaaa": 7}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    found = [(r.word, r.near) for r in spelling.near_pairs(words).collect()]
    assert len(found) == len(set(found)) and sorted(found) == sorted((a, b) for a in n for b in n if one_apart(a, b))
    chain = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(19)], "word string, form string")
    assert {(r.word, r.root) for r in spelling.roots(chain).collect()} == {(f"w{k}", "w19") for k in range(19)}


def test_variants_of_no_rows(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(spark.createDataFrame([], SCHEMA), ratio=1)
