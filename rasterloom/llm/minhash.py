"""Near-duplicate documents by DartMinHash.

A document is a weighted set: its five-word shingles, each as heavy as it is
often there. Every unit of an element's weight is a region into which hashed
darts are thrown: they arrive along the rank axis as a Poisson process whose
hashes depend on the region alone, so that documents agree on them. A document
looks at the darts up to a rank that gives it enough of them, however large it
is, and keeps the earliest dart at each coordinate. Two documents agree at a
coordinate with the probability of their weighted Jaccard similarity.

Bands of coordinates are joined; pairs are then verified in full. A bucket is
not expanded into all its pairs: its documents are first compared with one of
them, in several rounds, and only documents that are still in different groups
are compared one by one.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components
from .hashing import Windows, mixed, portions, starts_inside, word_hashes

SHINGLE, BANDS, ROWS = 5, 32, 7
#: Characters of a portion of texts, and rows of a batch: a worker keeps the most that it ever held beside its executor's heap.
PORTION, BATCH = 250_000, 250
#: Odd steps between a region's darts, and what parts the draws of one dart (fixed values).
DART_STEP, DRAW_COORDINATE, DRAW_HEIGHT = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


def elements(texts: list[str | None], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Document number and hash of each unit of weight: a shingle and which of its occurrences it is.

    Shingles never cross a text. A text of fewer words, but not none, is one
    shingle. Sorted by document, then hash.
    """
    words, bounds = word_hashes(texts)
    counts = np.diff(bounds)
    windows = Windows(words)
    inside = np.flatnonzero(starts_inside(bounds, width, len(words)))
    owner = np.searchsorted(bounds, inside, side="right") - 1
    hashes = windows.of(width)[inside]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.array([windows.of(int(counts[d]))[bounds[d]] for d in short], "u8")
        owner, hashes = np.concatenate([owner, short]), np.concatenate([hashes, extra])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    if len(owner):
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])])
        at = np.flatnonzero(new)
        nth = np.arange(len(owner)) - np.repeat(at, np.diff(np.append(at, len(owner))))
        hashes = mixed(hashes + nth.astype("u8") * DART_STEP)
    return owner, hashes


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits >> np.uint64(11)).astype("f8") + 0.5) / float(1 << 53)


def signatures(owner: np.ndarray, regions: np.ndarray, n: int, k: int, heights: np.ndarray | None = None) -> np.ndarray:
    """(n, k) dart hashes; rows without weight stay 0.

    ``regions`` are hashes of unit regions of elements. ``heights`` says how
    much of each belongs to the document, for weights that are not whole: a
    dart above it does not count.
    """
    found = np.zeros((n, k), "u8")
    weight = np.bincount(owner, heights, minlength=n).astype("f8") if len(owner) else np.zeros(n)
    todo = np.flatnonzero(weight > 0)
    wanted = k * (math.log(k) + 3.0)
    while len(todo):
        row = np.full(n, -1)
        row[todo] = np.arange(len(todo))
        mine = np.flatnonzero(row[owner] >= 0)
        own, key = row[owner[mine]], regions[mine]
        height = None if heights is None else heights[mine]
        limit = (wanted / weight[todo])[own]
        rank, slots, ranks, darts = np.zeros(len(mine)), [], [], []
        while len(key):
            key = key + DART_STEP
            bits = mixed(key)
            rank = rank - np.log(_uniform(bits))
            alive = rank <= limit
            own, key, rank, limit, bits = own[alive], key[alive], rank[alive], limit[alive], bits[alive]
            use = slice(None)
            if height is not None:
                height = height[alive]
                use = _uniform(mixed(bits ^ DRAW_HEIGHT)) < height
            slots.append(own[use] * k + (mixed(bits ^ DRAW_COORDINATE) % np.uint64(k)).astype("i8")[use])
            ranks.append(rank[use])
            darts.append(bits[use])
        slot, ranked, dart = np.concatenate(slots), np.concatenate(ranks), np.concatenate(darts)
        first = np.full(len(todo) * k, np.inf)
        np.minimum.at(first, slot, ranked)
        won = ranked == first[slot]
        grid = np.zeros(len(todo) * k, "u8")
        grid[slot[won]] = dart[won]
        full = np.isfinite(first).reshape(-1, k).all(axis=1)
        found[todo[full]] = grid.reshape(-1, k)[full]
        todo, wanted = todo[~full], wanted * 2
    return found


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) hashes of each band's number and coordinates."""
    parts = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype="u8"), parts.shape[:2]).copy()
    for r in range(rows):
        key = mixed(key * DART_STEP + parts[:, :, r])
    return key


def scan(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, doc, sha (of its words; null without any) and band keys of each document."""

    def run(frames):
        for frame in frames:
            texts = frame["text"].tolist()
            # A text has about as many darts, however short it is; both bound a portion's memory.
            for i, j in portions(texts, PORTION, 1_600):
                owner, regions = elements(texts[i:j])
                keys = band_keys(signatures(owner, regions, j - i, bands * rows), bands, rows).view("i8")
                lists = [common.blank_words(t) for t in texts[i:j]]
                part = frame.iloc[i:j]
                yield pd.DataFrame({"doc_id": part["doc_id"], "doc": part["doc"],
                                    "sha": [hashlib.sha256(b" ".join(w)).hexdigest() if w else None for w in lists],
                                    "bands": [k if w else None for w, k in zip(lists, keys)]})

    return docs.select("doc_id", "doc", "text").mapInPandas(run, "doc_id long, doc long, sha string, bands array<long>")


def shingle_sets(met: DataFrame) -> DataFrame:
    """doc and sorted unit hashes of ``met(doc, text)``."""

    def run(frames):
        for frame in frames:
            texts = frame["text"].tolist()
            for i, j in portions(texts, PORTION):
                owner, regions = elements(texts[i:j])
                order = np.lexsort((regions, owner))
                cuts = np.searchsorted(owner, np.arange(j - i + 1))
                regions = regions[order].view("i8")
                yield pd.DataFrame({"doc": frame["doc"].iloc[i:j], "units": [regions[a:b] for a, b in zip(cuts[:-1], cuts[1:])]})

    return met.select("doc", "text").mapInPandas(run, "doc long, units array<long>")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a, b and similar of each of the pairs (a, b): whether their weighted Jaccard similarity reaches the threshold."""

    def run(frames):
        for frame in frames:
            similar = []
            for x, y in zip(frame["x"], frame["y"]):
                common_units = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                similar.append(common_units >= threshold * (len(x) + len(y) - common_units) - 1e-9)
            yield pd.DataFrame({"a": frame["a"], "b": frame["b"], "similar": similar})

    return (pairs.join(sets.select(F.col("doc").alias("a"), F.col("units").alias("x")), "a")
            .join(sets.select(F.col("doc").alias("b"), F.col("units").alias("y")), "b")
            .select("a", "b", "x", "y").mapInPandas(run, "a long, b long, similar boolean"))


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def links(buckets: DataFrame, sets: DataFrame, threshold: float, rounds: int = 2) -> DataFrame:
    """Edges (a, b) that join all documents that similar pairs within buckets join.

    ``buckets`` has key, doc and copies. Each round compares the documents of a
    bucket that are not in its largest group with one document of that group,
    another one each round; a bucket within one group is done. What is still
    apart then is compared in full: in small buckets pair by pair, without the
    pairs known already, in large ones block by block.
    """
    tried, groups = None, None
    for k in range(rounds):
        here = _grouped(buckets, groups)
        if k == 0:  # each document is a group of its own yet
            one = here.groupBy("key").agg(F.min(F.struct(-F.col("copies"), F.col("doc").alias("grp"), "doc")).alias("top"))
        else:
            here = here.join(_apart(here), "key")
            one = (here.groupBy("key", "grp")
                   .agg(F.sum("copies").alias("n"), F.min(F.struct(F.xxhash64(F.lit(k), "doc"), "doc"))["doc"].alias("doc"))
                   .groupBy("key").agg(F.max(F.struct("n", "grp", "doc")).alias("top")))
        one = one.select("key", F.col("top.grp").alias("top_grp"), F.col("top.doc").alias("top_doc"))
        pairs = _pairs(here.join(one, "key").where("grp != top_grp"), "doc", "top_doc")
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        now = common.written(verified(pairs, sets, threshold), "verified")
        tried = now if tried is None else tried.union(now)
        groups = components(tried.where("similar"))
    here = _grouped(buckets, groups)
    sizes = (here.groupBy("key", "grp").agg(F.count("*").alias("n")).groupBy("key")
             .agg(F.sum("n").alias("n"), F.max(F.struct("n", "grp")).alias("top")).where("top.n < n")
             .select("key", "n", F.col("top.grp").alias("top_grp"), (F.col("n") - F.col("top.n")).alias("n_apart")))
    left = common.written(here.join(sizes, "key"), "apart")
    small = left.where(F.col("n") <= PAIRED).select("key", "doc", "grp")
    other = small.select("key", F.col("doc").alias("doc2"), F.col("grp").alias("grp2"))
    pairs = _pairs(small.join(other, "key").where("doc < doc2 and grp != grp2"), "doc", "doc2")
    paired = verified(pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti"), sets, threshold)
    blocked = block_links(left.where(F.col("n") > PAIRED), sets, threshold)
    found = tried.union(paired).where("similar").select("a", "b").union(blocked)
    return common.written(found, "links")


#: Documents of a bucket up to which those apart are compared pair by pair, and of a side of a block beyond it.
PAIRED, BLOCK = 64, 512


def _grouped(buckets: DataFrame, groups: DataFrame | None) -> DataFrame:
    if groups is None:
        return buckets.withColumn("grp", F.col("doc"))
    return (buckets.join(groups.withColumnRenamed("id", "doc"), "doc", "left")
            .withColumn("grp", F.coalesce("component", "doc")).drop("component"))


def _apart(here: DataFrame) -> DataFrame:
    """The keys of buckets in more than one group."""
    return here.groupBy("key").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi").select("key")


def block_links(left: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Edges between groups of large buckets, from ``left`` (key, doc, grp, n, top_grp, n_apart).

    The documents outside a bucket's largest group are dealt into chunks, and so
    are all its documents; each pair of chunks is a block that one task compares.
    Only an edge for each two groups that are linked leaves it.
    """
    draw = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    chunked = (left.withColumn("outer", F.ceil(F.col("n_apart") / BLOCK).cast("int")).withColumn("inner", F.ceil(F.col("n") / BLOCK).cast("int")))
    outside = (chunked.where("grp != top_grp")
               .select("key", "doc", "grp", F.lit(True).alias("out"), draw("outer").alias("i"), F.explode(F.sequence(F.lit(0), F.col("inner") - 1)).alias("j")))
    every = chunked.select("key", "doc", "grp", F.lit(False).alias("out"), F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("i"), draw("inner").alias("j"))
    rows = outside.union(every).join(sets, "doc")
    dealt = rows.repartition(common.partitions(left.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(frames):
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            keys = frame[["key", "i", "j"]].to_numpy()
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
            held = frame.iloc[edges[-1]:]
            for x, y in zip(edges[:-1], edges[1:]):
                yield compare(frame.iloc[x:y])
        if held is not None and len(held):
            yield compare(held)

    def compare(block):
        out = block["out"].to_numpy()
        doc, grp = block["doc"].to_numpy(), block["grp"].to_numpy()
        shared = shared_units(block["units"].tolist(), out)
        size = np.array([len(u) for u in block["units"]])
        s, m = np.flatnonzero(out), np.flatnonzero(~out)
        near = shared >= threshold * (size[s][:, None] + size[m][None, :] - shared) - 1e-9
        near &= grp[s][:, None] != grp[m][None, :]
        a, b = np.nonzero(near)
        return pd.DataFrame({"a": doc[s[a]], "b": doc[m[b]], "ga": grp[s[a]], "gb": grp[m[b]]}).drop_duplicates(["ga", "gb"])[["a", "b"]]

    return dealt.select("key", "i", "j", "out", "doc", "grp", "units").mapInPandas(run, "a long, b long")


def shared_units(units: list[np.ndarray], out: np.ndarray, cells: int = 2_000_000) -> np.ndarray:
    """How many units each set with ``out`` shares with each without it, as a product of 0/1 matrices, a slice of columns at a time."""
    owner = np.repeat(np.arange(len(units)), [len(u) for u in units])
    _, column, count = np.unique(np.concatenate(units), return_inverse=True, return_counts=True)
    use = count[column] > 1
    owner, column = owner[use], column[use]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], np.cumsum(np.diff(column[order], prepend=column[order][:1]) != 0)
    total = np.zeros((int(out.sum()), int((~out).sum())), "f4")
    step = max(1, cells // max(1, len(units)))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [first, first + step])
        grid = np.zeros((len(units), step), "f4")
        grid[owner[a:b], column[a:b] - first] = 1
        total += grid[out] @ grid[~out].T
    return total


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, component_id, n_copies and kept of each of ``docs(doc_id, text)``.

    Documents are near-duplicates from a weighted Jaccard similarity of
    ``threshold`` of their five-word shingles on. ``component_id`` is the
    smallest doc_id that links reach, ``kept`` is true for one row of it alone,
    and ``n_copies`` is the number of rows with exactly these words. Whole
    copies are one class from the start; only its first document is compared.

    Documents without words (null or empty texts) and rows of null doc_id link
    with nothing and are kept. Rows of equal doc_id stand for one document:
    they are kept or go together.
    """
    common.small_batches(docs.sparkSession, BATCH)
    last = F.lit((1 << 63) - 1)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("doc", F.coalesce("doc_id", last))
    found = scan(docs, bands, rows).withColumn("sha", F.when(F.col("doc_id").isNotNull(), F.col("sha")))
    found = common.written(found, "minhash-bands")
    classes = common.written(found.where("sha is not null").groupBy("sha").agg(
        F.min("doc").alias("first"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "minhash-classes")
    keyed = classes.select(F.col("first").alias("doc"), "copies", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("key")
    buckets = common.written(keyed.join(shared, "key"), "minhash-buckets")
    members = common.written(buckets.select("doc").distinct(), "minhash-members")
    sets = common.written(shingle_sets(docs.select("doc", "text").join(members, "doc")).dropDuplicates(["doc"]), "minhash-sets")
    groups = components(links(buckets, sets, threshold))
    named = classes.join(groups.withColumnRenamed("id", "first"), "first", "left").select(
        "sha", "copies", "first", F.coalesce("component", "first").alias("component"))
    joined = found.drop("bands").join(named, "sha", "left")
    return joined.select("doc_id", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("copies", F.lit(1)).alias("n_copies"),
                         (F.col("doc") == F.coalesce("component", "doc")).alias("kept"))


def keep_firsts(docs: DataFrame, **how) -> DataFrame:
    """The documents, all columns, with the first of each group of near-duplicates alone."""
    gone = near_duplicates(docs, **how).where("not kept").select(F.col("doc_id").alias("_id")).distinct()
    gone = common.written(gone, "minhash-gone")
    return docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti")


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
