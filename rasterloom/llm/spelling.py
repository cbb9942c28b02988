"""Spelling variants of words, by a join on single deletions.

Every word emits itself and its distinct single deletions. Two words one edit
apart share exactly one of these keys: the shorter word itself, or what both
have left without the replaced letter. So words are joined on equal keys, the
pairs verified, and each word's forms summed up. A key has few words whatever
the corpus: itself and what one of 90 letters put in at one of its places
makes, so a join of a key's words is bounded by the alphabet, and no key is hot.
Joins deal out both sides by key: words grow with the corpus, and a small file
of words makes some ten keys of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _without(word: Column, at: Column) -> Column:
    """word without its code point number ``at`` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def spelled_words(docs: DataFrame, least_length: int = 7, least_count: int = 2, one_in: int = 31) -> DataFrame:
    """word and n, its occurrences, of the words of ``docs(doc_id, text)``.

    Words are maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), of which
    A-Z are lower-cased. Where the crc32 of ``doc_id:run`` is divisible by
    ``one_in``, the run loses its code point number crc32 % length, as a slip
    would. Words of fewer than least_length code points or of fewer than
    least_count occurrences go. A null text has no words; a null doc_id is
    written as nothing before the colon. Rows that repeat count again; other
    columns are not read. Counts are combined before they are shuffled.
    """
    # A run of letters is matched whole or, where it is too short, not at all.
    runs = F.regexp_extract_all("text", F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least_length},}}"), F.lit(0))
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    run = run.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    slip = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    run = run.select("run", slip.alias("slip"))
    word = F.when(F.col("slip") % one_in == 0, _without(F.col("run"), (F.col("slip") % F.length("run")).cast("int"))).otherwise(F.col("run"))
    return (run.select(word.alias("word")).where(F.length("word") >= least_length)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count))


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: each ordered pair of ``words(word, n)`` exactly one inserted, deleted or replaced code point apart."""
    places = F.sequence(F.lit(0), F.length("word") - 1)
    keys = F.array_union(F.array("word"), F.transform(places, lambda i: _without(F.col("word"), i)))
    keyed = words.select("word", "n", F.explode(keys).alias("key"))
    other = keyed.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "key")
    return (keyed.join(common.dealt(other), "key").where((F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1))
            .select("word", "n", "near", "near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of ``forms(word, form)``, which have no circle: from each word along the forms to the last.

    Each round joins a word's last form so far with that one's, so the reach
    doubles: a chain of 18 links, which counts that grow tenfold cannot pass,
    takes five rounds.
    """
    found = common.written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = common.written(found.join(common.dealt(ahead), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        found = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return found


def spelling_variants(docs: DataFrame, ratio: int = 10, **rules) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of ``docs`` (see spelled_words for the words and ``rules``).

    A word's form is its near word of largest n (ties: smallest by code
    points) if that n is ``ratio`` times the word's n at least, else null;
    form_n is the form's n. root is the last of its forms, else the word.
    An empty table, or one without words, gives no row.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than the word, so ratio is 2 at least")
    words = common.written(spelled_words(docs, **rules), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form"))).alias("best")
    nearest = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    known = words.join(common.dealt(nearest), "word", "left")
    strong = -F.col("best.minus") >= ratio * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                         F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.minus")).alias("form_n"))
    known = common.written(known, "forms")
    return (known.join(common.dealt(roots(known.where("form IS NOT NULL"))), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(common.table(spark, sf_dir, "documents"))


#: crc32 by a table of 256 numbers that is computed bit by bit; pairs by place and rest (replaced) and by one deletion.
ORACLE_SQL = r"""
WITH crcs AS (SELECT list_transform(range(256), lambda b: list_reduce([b] || list_transform(range(8), lambda x: 0::BIGINT),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT run, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM counted, crcs),
spelled AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
shorter AS (SELECT DISTINCT word, n, rest FROM cuts),
pairs AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION ALL SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON s.rest = w.word
    UNION ALL SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON s.rest = w.word),
best AS (SELECT word, count(*) AS n_near, min({'minus': -near_n, 'form': near}) AS b FROM (SELECT DISTINCT * FROM pairs) GROUP BY word),
known AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.minus >= 10 * w.n THEN b.form END AS form,
    CASE WHEN -b.minus >= 10 * w.n THEN -b.minus END AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root, 0 AS step FROM known UNION ALL
    SELECT walk.word, known.form, step + 1 FROM walk JOIN known ON walk.root = known.word WHERE known.form IS NOT NULL)
SELECT known.word, form, last.root, n, n_near, form_n FROM known JOIN (SELECT word, max_by(root, step) AS root FROM walk GROUP BY word) last USING (word)
""".replace("WITH crcs", "WITH RECURSIVE crcs")
