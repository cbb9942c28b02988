"""Substring dedup by level-wise doubling.

Windows of words that repeat across documents are sought at a short length
first. Only those that are repeated there are extended to twice that length, and
so on until the wanted length is reached or no candidate survives; documents
without a repeated window leave at each level.

A level's windows need not all be shuffled: of the short windows inside each
wanted one, the one of smallest hash is enough, as equal wanted windows have the
same. None is lost, and every wanted window that survives all levels is
compared in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .hashing import OTHER_BASE, Windows, portions, sliding, starts_inside, word_hashes

EMPTY_SHA = hashlib.sha256(b"").hexdigest()
#: Words of a window below which no level goes.
SHORTEST = 12


def levels(window: int, shortest: int = SHORTEST) -> list[int]:
    """The levels' lengths, each at most twice the one before: 13, 25, 50."""
    found = [window]
    while found[0] >= 2 * shortest:
        found.insert(0, -(-found[0] // 2))
    return found


def _least(words: np.ndarray, window: int, length: int) -> np.ndarray:
    """The smallest hash of the windows of ``length`` words inside each wanted one."""
    hashes = Windows(words).of(length)
    return sliding(np.minimum, hashes, window - length + 1) if len(words) >= window else hashes[:0]


def scan(docs: DataFrame, window: int) -> DataFrame:
    """doc, tk, doc_id, n_words, sha and seeds: the words' digest and the wanted windows' smallest ones of the first level."""
    length = levels(window)[0]

    def run(frames):
        for frame in frames:
            texts = frame["text"].tolist()
            for i, j in portions(texts):
                words, bounds = word_hashes(texts[i:j])
                least = _least(words, window, length)
                lists = [np.unique(least[a:max(a, b - window + 1)]).view("i8") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                shas = [hashlib.sha256(b" ".join(common.blank_words(t))).hexdigest() for t in texts[i:j]]
                part = frame.iloc[i:j]
                yield pd.DataFrame({"doc": part["doc"], "tk": part["tk"], "doc_id": part["doc_id"], "n_words": np.diff(bounds), "sha": shas, "seeds": lists})

    return docs.select("doc", "tk", "doc_id", "text").mapInPandas(
        run, "doc long, tk long, doc_id long, n_words long, sha string, seeds array<long>")


def repeated(found: DataFrame, *key: str) -> DataFrame:
    """Rows of found whose key stands in another document too, with lo, the first of these.

    Keys of more than a thousandth of these rows, which are a thousand at most, are
    joined by broadcast, so that no task gets all rows of a frequent one.
    """
    keys = found.groupBy(*key).agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    keys = common.written(keys.select(*key, "lo", "n"), "substring-keys")
    frequent = F.col("n") * 1000 > (keys.agg(F.sum("n")).first()[0] or 0)
    hot, rest = F.broadcast(keys.where(frequent).drop("n")), keys.where(~frequent).drop("n")
    return found.join(hot, list(key)).unionByName(found.join(hot.select(*key), list(key), "left_anti").join(rest, list(key)))


def with_repeated(texts: DataFrame, found: DataFrame) -> DataFrame:
    """doc, tk, text and seeds of the texts that have seeds (``found``: doc, tk, seeds) of another document too, and these."""
    own = (repeated(found.select("doc", "tk", F.explode("seeds").alias("seed")), "seed")
           .groupBy("doc", "tk").agg(F.collect_set("seed").alias("seeds")))
    return texts.select("doc", "tk", "text").join(own, ["doc", "tk"]).dropDuplicates(["doc", "tk"])


def longer(met: DataFrame, window: int, length: int, twice: int) -> DataFrame:
    """doc, tk and seeds: the smallest windows of ``twice`` the length in the wanted windows whose smallest of ``length`` is repeated."""

    def run(frames):
        for frame in frames:
            texts, lists = frame["text"].tolist(), frame["seeds"].tolist()
            for i, j in portions(texts):
                words, bounds = word_hashes(texts[i:j])
                least, next_least, found = _least(words, window, length), _least(words, window, twice), []
                for k in range(i, j):
                    a, b = bounds[k - i], max(bounds[k - i], bounds[k - i + 1] - window + 1)
                    found.append(np.unique(next_least[a:b][np.isin(least[a:b], np.asarray(lists[k], "i8").view("u8"))]).view("i8"))
                yield frame.iloc[i:j][["doc", "tk"]].assign(seeds=found)

    return met.select("doc", "tk", "text", "seeds").mapInPandas(run, "doc long, tk long, seeds array<long>")


def surviving(docs: DataFrame, found: DataFrame, window: int) -> Iterator[tuple[int, DataFrame]]:
    """Each level's length and the texts that have a window repeated there, with the seeds of those; ends early if none survives."""
    steps = levels(window)
    met = common.written(with_repeated(docs, found), "substring-texts")
    yield steps[0], met
    for length, twice in zip(steps, steps[1:-1]):
        if met.isEmpty():
            return
        seeds = common.written(longer(met, window, length, twice), "substring-seeds")
        met = common.written(with_repeated(met, seeds), "substring-texts")
        yield twice, met


def wanted_windows(met: DataFrame, window: int, length: int) -> DataFrame:
    """doc, tk, places and their hashes h1 and h2 (96 bits together) of the wanted windows whose smallest one of ``length`` is repeated."""

    def run(frames):
        for frame in frames:
            texts, lists = frame["text"].tolist(), frame["seeds"].tolist()
            for i, j in portions(texts):
                words, bounds = word_hashes(texts[i:j])
                least, first = _least(words, window, length), Windows(words).of(window)
                second = (Windows(word_hashes(texts[i:j], base=OTHER_BASE)[0]).of(window) >> np.uint64(32)).astype("u4")
                places, h1, h2 = [], [], []
                for k in range(i, j):
                    a, b = bounds[k - i], max(bounds[k - i], bounds[k - i + 1] - window + 1)
                    at = np.flatnonzero(np.isin(least[a:b], np.asarray(lists[k], "i8").view("u8")))
                    places.append(at.astype("i4"))
                    h1.append(first[a + at].view("i8"))
                    h2.append(second[a + at].view("i4"))
                yield frame.iloc[i:j][["doc", "tk"]].assign(places=places, h1=h1, h2=h2)

    return met.select("doc", "tk", "text", "seeds").mapInPandas(run, "doc long, tk long, places array<int>, h1 array<long>, h2 array<int>")


def cut(met: DataFrame, window: int, texts_too: bool) -> DataFrame:
    """doc, sha, n_removed and kept_sha256 (and the kept text) of ``met`` (doc, text and the places of its hit windows)."""

    def run(frames):
        for frame in frames:
            rows = []
            for doc, text, hits in zip(frame["doc"], frame["text"], frame["hits"]):
                plain = common.blank_words(text)
                step, at = np.zeros(len(plain) + 1, "i8"), np.asarray(hits, "i8")
                np.add.at(step, at, 1)
                np.add.at(step, at + window, -1)
                gone = np.cumsum(step[:-1]) > 0
                kept = b" ".join(w for w, g in zip(plain, gone.tolist()) if not g)
                rows.append((doc, hashlib.sha256(b" ".join(plain)).hexdigest(), int(gone.sum()),
                             hashlib.sha256(kept).hexdigest(), kept.decode("utf-8") if texts_too else None))
            yield pd.DataFrame(rows, columns=["doc", "sha", "n_removed", "kept_sha256", "kept"])

    return met.select("doc", "text", "hits").mapInPandas(
        run, "doc long, sha string, n_removed long, kept_sha256 string, kept string")


def dedup_substrings(docs: DataFrame, window: int = 50, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each of ``docs(doc_id, text)`` (with ``texts``, kept too).

    A word is removed if a window around it also starts in a document of
    smaller doc_id. Whole copies of one text are settled by its digest, and only
    the first goes on. Windows are told apart by 96 bits of two hashes.

    A null text has no words; a null doc_id counts as larger than all. Rows of
    equal doc_id do not remove from each other. Texts shorter than the window
    keep all words. ``kept`` is null where nothing is removed.
    """
    common.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumns({"doc": F.coalesce("doc_id", F.lit((1 << 63) - 1)), "tk": F.xxhash64("text")})
    found = common.written(scan(docs, window), "substring-scan")
    firsts = found.where(F.col("n_words") >= window).groupBy("sha").agg(F.min(F.struct("doc", "tk")).alias("top"), F.first("seeds").alias("seeds"))
    firsts = common.written(firsts.select("sha", "top.doc", "top.tk", "seeds"), "substring-firsts")
    for length, met in surviving(docs, firsts, window):  # the last one has what survives all levels but the wanted length's
        pass
    candidates = common.written(wanted_windows(met, window, length), "substring-windows")
    each = candidates.select("doc", "tk", F.explode(F.arrays_zip("places", "h1", "h2")).alias("w")).select("doc", "tk", "w.*")
    hits = (repeated(each, "h1", "h2").where("doc > lo")
            .groupBy("doc", "tk").agg(F.collect_list("places").alias("hits")))
    done = (cut(met.select("doc", "tk", "text").join(hits, ["doc", "tk"]), window, texts)
            .dropDuplicates(["doc", "sha"]))
    copy = F.col("doc") > F.col("lo")
    return (found.select("doc_id", "doc", "n_words", "sha")
            .join(firsts.select("sha", F.col("doc").alias("lo")), "sha", "left")
            .join(done, ["doc", "sha"], "left")
            .select("doc_id", "n_words",
                    F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
                    F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
                    *([F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept")] if texts else [])))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(common.table(spark, sf_dir, "documents"))
