"""Collocations: frequent phrases of up to five words, by hashed bucket counts and Apriori pruning.

First the words of each few megabytes of text are numbered, and these portions
written. Then there is one pass over them for each length k. A task hashes a
portion's windows all at once and, in one sweep,

- counts the phrases of k words that are left: both their parts of k - 1 words
  are frequent (Apriori), and their bucket holds enough,
- hashes the windows of k + 1 words, both parts of which are left, into buckets
  and counts these for the next pass.

What a task sends on is summed up before: phrases with their counts, and
buckets as sparse slices (places, counts up to the threshold). Slices of one
number are added up in a stream; what comes to the driver, and goes from there
to the tasks, is one bit a bucket, of buckets in proportion to the texts up to
``most_buckets``. Buckets only spare work: a phrase's count is exact, from its
own words, and beyond ``most_buckets`` the same phrases result.

Everything is told apart by language: equal phrases of two languages are two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .hashing import Windows
from .packing import BREAK, numbers, packed, planes, unpacked

#: In UTF-8 no byte is 0xFF, so it can stand for the end of a piece.
END = BREAK
#: For bytes.translate: ASCII upper case to lower, what ends a piece to END.
PIECES = bytes(255 if c in b".,;:!?\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Buckets a slice, so that a place takes two bytes.
SLICE = 1 << 16
#: Bytes of text that a task holds at once.
PORTION = 6_000_000

PORTION_SCHEMA = "ids binary, words binary, langs array<string>, which binary"
PART_SCHEMA = "lang string, phrase string, n long, slice int, places binary, counts binary"


class _Words(dict):
    """Numbers a language's words when they are first asked for; ``known`` has the words of all languages by number."""

    def __init__(self, lang: str, known: list):
        super().__init__({END: 0})
        self.lang, self.known = lang, known

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.known)
        self.known.append((self.lang, word))
        return n


def _numbered(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
    """A portion of rows (lang, text): its words' numbers, 0 at the end of each piece, and all different words of each language."""
    known: list = [("", END)]
    words: dict[str, _Words] = {}
    ids = []
    for lang, text in rows:
        if lang not in words:
            words[lang] = _Words(lang, known)
        found = text.translate(PIECES).replace(END, b" \xff ").split()
        found.append(END)
        ids.append(np.fromiter(map(words[lang].__getitem__, found), "i4", len(found)))
    langs = list(words)
    order = {lang: i for i, lang in enumerate(langs)}
    return pa.RecordBatch.from_pydict({
        "ids": pa.array([planes(np.concatenate(ids))], pa.binary()), "words": pa.array([packed(BREAK.join([w for _, w in known[1:]]))], pa.binary()),
        "langs": pa.array([langs], pa.list_(pa.string())), "which": pa.array([planes(np.array([order[lang] for lang, _ in known[1:]], "u4"))], pa.binary())})


class Portion:
    """The numbered words of some texts, and the hashes of their windows."""

    def __init__(self, ids: bytes, words: bytes, langs: list[str], which: bytes):
        self.ids = numbers(ids)
        which = numbers(which).tolist()
        self.known = [("", END), *((langs[i], w) for i, w in zip(which, unpacked(words).split(BREAK)))]
        salts = [lang.encode("utf-8") + END for lang in langs]
        hashes = [0, *(xxhash.xxh3_64_intdigest(salts[i] + w) for i, (_, w) in zip(which, self.known[1:]))]
        self.windows = Windows(np.array(hashes, "u8")[self.ids])
        ends = np.flatnonzero(self.ids == 0)
        #: Words from each place to its piece's end.
        self.left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(self.ids))

    def starts(self, length: int) -> np.ndarray:
        """Which of the places start a window inside a piece; as many as windows.of(length) has."""
        return self.left[:max(0, len(self.ids) - length + 1)] >= length

    def phrases(self, starts: np.ndarray, length: int):
        """lang, phrase (UTF-8) and count of the different windows that start there, told apart by their words."""
        rank = self.ids[starts]
        for j in range(1, length):
            key = rank * len(self.known) + self.ids[starts + j]
            rank = np.unique(key, return_inverse=True)[1]
        _, first, count = np.unique(rank, return_index=True, return_counts=True)
        words = self.ids[starts[first][:, None] + np.arange(length)].tolist()
        known = self.known
        return [known[w[0]][0] for w in words], [b" ".join([known[i][1] for i in w]) for w in words], count

    def totals(self):
        """lang and number of words."""
        each = np.bincount(self.ids, minlength=len(self.known))
        sums: dict[str, int] = {}
        for (lang, _), n in zip(self.known[1:], each[1:].tolist()):
            sums[lang] = sums.get(lang, 0) + n
        return sums


class Bits:
    """One bit a bucket, at a power of two of buckets."""

    def __init__(self, packed: np.ndarray):
        self.packed, self.mask = packed, np.uint64(8 * len(packed) - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes & self.mask
        return (self.packed[place >> np.uint64(3)] >> (place & np.uint64(7)).astype("u1")) & 1 != 0


def _written_portions(texts: DataFrame, most: int) -> DataFrame:
    """Portions of about ``most`` bytes, but whole texts."""
    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                rows.append((lang, text))
                size += len(text)
                if size >= most:
                    yield _numbered(rows)
                    rows, size = [], 0
        if rows:
            yield _numbered(rows)

    return common.written(texts.mapInArrow(run, PORTION_SCHEMA), "portions")


def _portions(batches):
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("ids", "words", "langs", "which"))):
            yield Portion(*row)


def _phrase_batch(langs, phrases, counts) -> pa.RecordBatch:
    n = len(langs)
    texts = pa.array(phrases, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), texts, pa.array(counts, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())],
        ["lang", "phrase", "n", "slice", "places", "counts"])


def _bucket_batch(hashes: np.ndarray, buckets: int, least: int, weight: int = 1) -> pa.RecordBatch:
    """How often each bucket is hit, up to least, slice by slice."""
    bucket, count = np.unique((hashes & np.uint64(buckets - 1)).astype("u4"), return_counts=True)
    count = np.minimum(count * weight, least).astype(np.min_scalar_type(least))
    number = (bucket // SLICE).astype("i4")
    begin = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(number)]]) if len(number) else np.zeros(1, "i8")
    places = (bucket % SLICE).astype("u2")
    spans = list(zip(begin[:-1].tolist(), begin[1:].tolist()))
    k = len(spans)
    return pa.RecordBatch.from_arrays(
        [pa.nulls(k, pa.string()), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64()), pa.array(number[begin[:-1]], pa.int32()),
         pa.array([places[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([count[a:b].tobytes() for a, b in spans], pa.binary())],
        ["lang", "phrase", "n", "slice", "places", "counts"])


def _gathered(parts: DataFrame, buckets: int, least: int) -> Bits:
    """The bits of the buckets that hold ``least`` in all slices together.

    Slices are added up one after another in the order of their numbers, so a
    task holds one; the driver gets a bit a bucket.
    """
    kind = np.min_scalar_type(least)

    def run(batches):
        now, held = None, np.zeros(SLICE, "i8")

        def told():
            return pa.RecordBatch.from_pydict({"slice": pa.array([now], pa.int32()), "bits": pa.array([np.packbits(held >= least, bitorder="little").tobytes()], pa.binary())})

        for batch in batches:
            for number, places, counts in zip(batch["slice"].to_pylist(), batch["places"].to_pylist(), batch["counts"].to_pylist()):
                if number != now:
                    if now is not None:
                        yield told()
                    now = number
                    held[:] = 0
                held[np.frombuffer(places, "u2")] += np.frombuffer(counts, kind)
        if now is not None:
            yield told()

    slices = parts.where("slice IS NOT NULL").select("slice", "places", "counts")
    packed = np.zeros(buckets // 8, "u1")
    summed = slices.repartition(common.partitions(parts.sparkSession), "slice").sortWithinPartitions("slice").mapInArrow(run, "slice int, bits binary")
    for row in summed.collect():
        packed[row["slice"] * (SLICE // 8):(row["slice"] + 1) * (SLICE // 8)] = np.frombuffer(row["bits"], "u1")
    return Bits(packed)


def _pass(portions: DataFrame, length: int, longest: int, buckets: int, least: int, known: Bits | None, full: Bits | None) -> DataFrame:
    """What the tasks of one pass send on: phrases of ``length`` words, buckets of one word more, words in all (first pass)."""
    sent = portions.sparkSession.sparkContext.broadcast((known, full))

    def run(batches):
        known, full = sent.value
        for held in _portions(batches):
            left = held.starts(length)
            if length > 1:
                parts = known.has(held.windows.of(length - 1))
                left &= parts[:len(left)] & parts[1:len(left) + 1]
                left[left] = full.has(held.windows.of(length)[left])
            else:
                totals = held.totals()
                yield _phrase_batch(list(totals), [None] * len(totals), list(totals.values()))
            starts = np.flatnonzero(left)
            if len(starts):
                yield _phrase_batch(*held.phrases(starts, length))
            if length < longest:
                after = held.starts(length + 1)
                after &= left[:len(after)] & left[1:len(after) + 1]
                yield _bucket_batch(held.windows.of(length + 1)[after], buckets, least)

    return common.written(portions.mapInArrow(run, PART_SCHEMA), "phrases")


def _frequent_bits(frequent: DataFrame, length: int, buckets: int, least: int) -> Bits:
    """The bits of the buckets of frequent phrases of so many words."""
    def run(batches):
        for batch in batches:
            stored = _numbered(list(zip(batch["lang"].to_pylist(), batch["text"].to_pylist())))
            for held in _portions([stored]):
                yield _bucket_batch(held.windows.of(length)[held.starts(length)], buckets, least, least)

    return _gathered(frequent.select("lang", F.col("phrase").cast("binary").alias("text")).mapInArrow(run, PART_SCHEMA), buckets, least)


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, most_buckets: int = 1 << 30, portion: int = PORTION) -> DataFrame:
    """lang, phrase, length, f: all phrases of up to ``longest`` words with f >= least, and each language's words in all (phrase null, length 0).

    ``docs(text, lang)``: A-Z are lower-cased, ``.,;:!?`` and line breaks (0x0A
    to 0x0D) part pieces, spaces and tabs part words; a phrase lies in one
    piece, its occurrences may overlap. A null text is empty, a null lang is
    ``und``. Rows that repeat count again; other columns are not read. An empty
    table gives no row. ``portion`` is the bytes of text that a task holds at once;
    neither it nor ``most_buckets`` (a power of two) changes a result.
    """
    if most_buckets < SLICE or most_buckets & (most_buckets - 1):
        raise ValueError(f"most_buckets must be a power of two of {SLICE} at least")
    spark = docs.sparkSession
    common.small_batches(spark)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = min(most_buckets, max(SLICE, 1 << (int(size) // 128).bit_length()))
    portions = _written_portions(texts, portion)
    known = full = found = None
    for length in range(1, longest + 1):
        parts = _pass(portions, length, longest, buckets, least, known, full)
        counted = parts.where("slice IS NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        counted = common.written(counted.where(f"phrase IS NULL OR f >= {int(least)}")
                                 .select("lang", "phrase", F.when(F.col("phrase").isNull(), 0).otherwise(length).alias("length"), "f"), "frequent")
        found = counted if found is None else found.union(counted)
        frequent = counted.where("phrase IS NOT NULL")
        if length == longest or frequent.isEmpty():
            return found
        known, full = _frequent_bits(frequent, length, buckets, least), _gathered(parts, buckets, least)
    return found


def _score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 a n / (l r)), exact for up to 3e17 words a language."""
    return F.expr(f"(1000BD * {a} * CAST({n} AS DECIMAL(19,0))) div (CAST({left} AS DECIMAL(19,0)) * {right})")


def collocations(docs: DataFrame, most: int = 2000, **rules) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``most`` phrases of two words or more by score.

    a is a phrase's count. A cut after its first k words gives l and r, the
    counts of both parts, and floor(1000 a n / (l r)), n being the language's
    words; the cut of the lowest score holds, ties go to the smallest k. A
    phrase that stands in a longer frequent one as often goes. Ties of score go
    by a, then by the phrase's bytes. ``rules`` and rows: see frequent_phrases.
    """
    found = frequent_phrases(docs, **rules)
    totals = common.small(found.where("length = 0").select("lang", F.col("f").alias("n")), 100_000)
    words = F.split("phrase", " ", -1)
    candidates = found.where("length > 1").select("lang", "phrase", "length", F.col("f").alias("a"), words.alias("words"))
    # A phrase between a shorter and a longer one of equal count has that count too, so one word more is enough.
    inside = candidates.where("length > 2").select("lang", "a", F.explode(F.array(
        F.array_join(F.slice("words", 1, F.col("length") - 1), " "), F.array_join(F.slice("words", 2, F.col("length") - 1), " "))).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(inside, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a")
    cuts = kept.select("lang", "phrase", "length", "a", "words", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
                       F.array_join(F.slice("words", F.col("k") + 1, F.col("length") - F.col("k")), " ").alias("rest"))
    part = lambda name, count: found.where("length > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    cuts = cuts.withColumn("score", _score("a", "n", "l", "r"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut"))
    best = best.select("lang", "phrase", *(f"cut.{c}" for c in ("a", "l", "r", "n", "score")))
    # Two rounds, so that no task orders a whole language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(256))).orderBy(*order)
    first = best.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM listed GROUP BY lang),
lengths AS (SELECT unnest(range(1, 6)) AS k),
placed AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM listed, lengths WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM placed GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT lang, k AS m, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1),
inner_parts AS (SELECT lang, a, m, array_to_string(w[i:j], ' ') AS phrase FROM (SELECT *, unnest(range(i + 1, m + 1)) AS j FROM (SELECT *, unnest(range(1, m)) AS i FROM cand)) WHERE j - i + 1 < m),
dropped AS (SELECT DISTINCT c.lang, c.phrase FROM cand c JOIN inner_parts p ON c.lang = p.lang AND c.phrase = p.phrase AND 100 * p.a >= 100 * c.a),
cut AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:m], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)),
scored AS (SELECT c.lang, c.phrase, a, c.k, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cut c JOIN f x ON c.lang = x.lang AND c.x = x.phrase JOIN f y ON c.lang = y.lang AND c.y = y.phrase JOIN totals t ON c.lang = t.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored ANTI JOIN dropped USING (lang, phrase)),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best WHERE nth = 1)
SELECT * FROM ranked WHERE rank <= 2000
"""
