"""Embedding near-dedup by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard
transform; its hash is the signed axis it then lies closest to. A table joins
``per_table`` such hashes; with multiprobe a vector also lies in the buckets in
which one of the hashes is the second closest axis instead. All pairs of a
bucket are verified by cosine inside the task that has it: a large bucket is
dealt into blocks of pairs of chunks, and only sums and the edges of a spanning
tree leave a block, never its pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components
from .hashing import mixed

TABLES, PER_TABLE, CHUNK = 10, 2, 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def buckets_of(vectors: np.ndarray, tables: int, per_table: int) -> np.ndarray:
    """(n, tables, 1 + per_table) bucket hashes: a vector's own and its probes'."""
    n, d = vectors.shape
    size = max(2, 1 << (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = vectors
    signs = np.random.default_rng(20_240_229 + size).choice([-1.0, 1.0], (tables, per_table, 3, size))
    out = np.zeros((n, tables, 1 + per_table), "u8")
    for t in range(tables):
        best = np.zeros((n, per_table), "u8")
        second = np.zeros((n, per_table), "u8")
        for k in range(per_table):
            y = padded
            for r in range(3):
                y = hadamard(y * signs[t, k, r])
            two = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            tops = np.take_along_axis(y, two, 1)
            swap = np.abs(tops[:, 0]) < np.abs(tops[:, 1])
            codes = (2 * two + (tops < 0)).astype("u8")
            codes[swap] = codes[swap][:, ::-1]
            best[:, k], second[:, k] = codes[:, 0], codes[:, 1]
        for p in range(1 + per_table):
            codes = best.copy()
            if p:
                codes[:, p - 1] = second[:, p - 1]
            key = np.full(n, (d << 16) + t + 1, "u8")
            for k in range(per_table):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + codes[:, k])
            out[:, t, p] = key
    return out


def unit_rows(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "f8").reshape(len(raw), -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def scan(vectors: DataFrame) -> DataFrame:
    """vec_id, id, digest and raw (float64 bytes scaled by a power of two); the last two null for what links with nothing."""

    def run(frames):
        for frame in frames:
            digests, raws = [], []
            for v in frame["embedding"]:
                x = None if v is None else np.array([np.nan if c is None else c for c in v], "f8")
                if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                    digests.append(None)
                    raws.append(None)
                    continue
                x = np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) + 0.0
                raws.append(x.tobytes())
                digests.append(hashlib.blake2b(raws[-1], digest_size=16).hexdigest())
            yield pd.DataFrame({"vec_id": frame["vec_id"], "id": frame["id"], "digest": digests, "raw": raws})

    return vectors.select("vec_id", "id", "embedding").mapInPandas(run, "vec_id long, id long, digest string, raw binary")


def placed(classes: DataFrame, tables: int, per_table: int) -> DataFrame:
    """bucket, id, copies and raw, one row for each different bucket of a class of equal vectors."""

    def run(frames):
        for frame in frames:
            for width, part in frame.groupby(frame["raw"].map(len)):
                keys = buckets_of(unit_rows(part["raw"].tolist()), tables, per_table).reshape(len(part), -1)
                at = np.repeat(np.arange(len(part)), keys.shape[1])
                yield pd.DataFrame({"bucket": keys.reshape(-1).view("i8"), "id": part["id"].to_numpy()[at],
                                    "copies": part["copies"].to_numpy()[at], "raw": part["raw"].to_numpy()[at]})

    return classes.select("id", "copies", "raw").mapInPandas(run, "bucket long, id long, copies long, raw binary")


def _linked(cross: bool, ids: np.ndarray, side: np.ndarray, x: np.ndarray, threshold: float):
    """Places of a block's vectors that have a link, which of these are near, and the smallest id that each reaches in the block."""
    near = x @ x.T >= threshold
    near.ravel()[::len(x) + 1] = False
    if not near.any():
        return None
    if cross:
        near &= side[:, None] != side[None, :]
    if len(np.unique(ids)) < len(ids):  # a vector's probes fell into one bucket: its first row stands for it
        _, once = np.unique(ids, return_index=True)
        first = np.zeros(len(ids), bool)
        first[once] = True
        near &= first[:, None] & first[None, :]
    at = np.flatnonzero(near.any(axis=1))
    if not len(at):
        return None
    near, label = near[np.ix_(at, at)], ids[at]
    while True:
        least = np.minimum(label, np.where(near, label[None, :], np.iinfo("i8").max).min(axis=1))
        if (least == label).all():
            return at, near, label
        label = least


def _links_here(bucket: int, near: np.ndarray, copies: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The links of each of a block's linked vectors, counting the pairs that meet in this bucket first of all.

    ``own`` has the vectors' buckets; the first is the smallest that two share
    in the first table in which they share any.
    """
    a, b = np.nonzero(np.triu(near))
    links = np.zeros(len(near), "i8")
    for i in range(0, len(a), 50_000):
        u, v = a[i:i + 50_000], b[i:i + 50_000]
        met = own[u][:, :, :, None] == own[v][:, :, None, :]
        first = met.any(axis=(2, 3)).argmax(axis=1)
        rows = np.arange(len(u))
        shared = np.where(met[rows, first].any(axis=2), own[u, first], np.uint64(2 ** 64 - 1)).min(axis=1)
        mine = shared == np.uint64(bucket & (2 ** 64 - 1))
        np.add.at(links, u[mine], copies[v[mine]])
        np.add.at(links, v[mine], copies[u[mine]])
    return links


def compared(blocks: DataFrame, threshold: float, tables: int, per_table: int) -> DataFrame:
    """id, links and to from ``blocks`` (bucket, lo, hi, chunk, id, copies, raw), whose rows of a block stand together."""

    def run(frames):
        held = None
        for frame in frames:
            frame = frame if held is None or not len(held) else pd.concat([held, frame], ignore_index=True)
            keys = frame[["bucket", "lo", "hi"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            edges = [0, *cuts.tolist()]
            held = frame.iloc[edges[-1]:]
            yield from done(frame, edges)
        if held is not None and len(held):
            yield from done(held, [0, len(held)])

    def done(frame, edges):
        ids, copies, chunk = (frame[c].to_numpy() for c in ("id", "copies", "chunk"))
        buckets, lo, hi, raw = frame["bucket"].tolist(), frame["lo"].tolist(), frame["hi"].tolist(), frame["raw"].to_numpy()
        # Vectors of one length are turned to numbers together; a bucket has no others.
        lengths, place, units, found = np.array([len(r) for r in raw[:edges[-1]]], "i8"), np.zeros(len(raw), "i8"), {}, []
        for length in np.unique(lengths):
            mine = np.flatnonzero(lengths == length)
            units[int(length)], place[mine] = unit_rows(raw[mine].tolist()), np.arange(len(mine))
        for i, j in zip(edges[:-1], edges[1:]):
            if j - i > 1:
                got = _linked(lo[i] != hi[i], ids[i:j], chunk[i:j], units[int(lengths[i])][place[i:j]], threshold)
                if got is not None:
                    found.append((buckets[i], i + got[0], *got[1:]))
        # The buckets of all linked vectors are found together, those of one length at a time.
        rows = np.unique(np.concatenate([at for _, at, _, _ in found])) if found else np.empty(0, "i8")
        own = np.zeros((len(rows), tables, 1 + per_table), "u8")
        for length, x in units.items():
            mine = np.flatnonzero(lengths[rows] == length)
            if len(mine):
                own[mine] = buckets_of(x[place[rows[mine]]], tables, per_table)
        made = []
        for bucket, at, near, label in found:
            links = _links_here(bucket, near, copies[at], own[np.searchsorted(rows, at)])
            made.append(pd.DataFrame({"id": ids[at], "links": links, "to": label}))
        if made:
            yield pd.concat(made)

    return (blocks.select("bucket", "lo", "hi", "chunk", "id", "copies", "raw")
            .mapInPandas(run, "id long, links long, to long"))


def near_vectors(vectors: DataFrame, threshold: float = 0.9, tables: int = TABLES, per_table: int = PER_TABLE,
                 chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id and kept of each of ``vectors(vec_id, embedding)``.

    Pairs link from a cosine of ``threshold`` on, in double precision; n_links
    counts a vector's direct links, component_id is the smallest vec_id that
    links reach, and kept says whether it is the vector's own. Rows of equal
    vectors are one class that is compared once and whose rows all link.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, and vectors only with those of their own length. A null
    vec_id counts as larger than all. Of rows of equal vec_id each is kept.
    """
    common.small_batches(vectors.sparkSession, 2000)
    last = F.lit((1 << 63) - 1)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("id", F.coalesce("vec_id", last))
    found = common.written(scan(vectors), "vectors")
    classes = common.written(found.where("digest is not null").groupBy("digest").agg(
        F.min("id").alias("id"), F.count("*").alias("copies"), F.first("raw").alias("raw")), "vector-classes")
    members = placed(classes, tables, per_table)
    large = (members.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > chunk)
             .select("bucket", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")))
    large = common.written(large, "large-buckets")
    dealt = (members.join(large, "bucket", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
             .withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other")))
    blocks = (dealt.repartition(common.partitions(vectors.sparkSession), "bucket", "lo", "hi")
              .sortWithinPartitions("bucket", "lo", "hi"))
    near = common.written(compared(blocks, threshold, tables, per_table), "vector-links")
    links = near.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(near.select(F.col("id").alias("a"), F.col("to").alias("b")))
    named = (classes.select("digest", "id", "copies").join(links, "id", "left").join(groups, "id", "left")
             .select("digest", F.coalesce("component", "id").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n")))
    return (found.drop("raw").join(named, "digest", "left")
            .select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "id").alias("component_id"),
                    (F.col("id") == F.coalesce("component", "id")).alias("kept")))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(common.table(spark, sf_dir, "embeddings"))
