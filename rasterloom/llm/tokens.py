"""Token ids as word-aligned Simple-8b blocks.

A 64-bit word holds a 4-bit selector and 60 bits of payload. The selector says
how many ids the word packs and how wide each is; small ids come many to a
word. Selector 0 is the escape: the word after it is one raw 64-bit id that no
width holds. Selector 15 is a run of 240 zeros.

The file format is a Parquet table with one row per block of whole documents
(about ``block_ids`` ids). Beside the packed words a row holds what lets a
reader decode it alone and without a loop over ids: the document ids, the ids
per document, the number of ids, and the number of ids of its shard before it.
Shards are ranges of doc_id, or, for documents that are stored in the order in
which they are to be read, runs of rows of their files. Their names sort as they
follow each other.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Ids per word and bits per id by selector.
COUNT = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 240])
WIDTH = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0])

#: Shards up to which their starts are broadcast, some 200 bytes each.
MOST_BROADCAST = 100_000

#: Selectors 1 to 15 from the fewest ids a word to the most.
BY_COUNT = np.array(sorted(range(1, 16), key=lambda s: COUNT[s]), "u1")

BLOCK_SCHEMA = ("shard string, block int, shard_ids long, n_ids long, "
                "doc_ids array<long>, doc_lens array<int>, words binary")


def _window_max(bits: np.ndarray, n: int) -> dict[int, np.ndarray]:
    """For each count of COUNT, the largest of so many bit lengths from each place on."""
    found, grown, size = {1: bits[:n]}, bits, 1
    doubled = {1: bits}
    while size < 128:
        grown = np.maximum(grown[:-size], grown[size:])
        size *= 2
        doubled[size] = grown
    for c in sorted(set(COUNT.tolist()) - {1}):
        p = 1 << (c.bit_length() - 1)
        base = doubled[p]
        found[c] = np.maximum(base[:n], base[c - p:c - p + n]) if c > p else base[:n]
    return found


def simple8b_encode(ids: np.ndarray) -> np.ndarray:
    """ids (uint64, none negative) packed; the last word is filled up with zeros."""
    n = len(ids)
    if not n:
        return np.empty(0, "u8")
    ids = np.ascontiguousarray(ids, "u8")
    padded = np.concatenate([ids, np.zeros(256, "u8")])
    # frexp of a float64 gives the bit length; above 2**53 rounding may add one, so those are done by shifts.
    bits = np.frexp(padded.astype("f8"))[1].astype("u1")
    if ids.max() >= 1 << 50:
        for i in np.flatnonzero(ids >= 1 << 50):
            bits[i] = int(ids[i]).bit_length()
    most = _window_max(bits, n)
    # From the fewest to the most ids a word, the last that fits is kept.
    rank = np.zeros(n, "u1")
    for r, s in enumerate(BY_COUNT):
        fits = most[int(COUNT[s])] <= WIDTH[s]
        np.maximum(rank, fits.view("u1") * np.uint8(r), out=rank)
    choice = np.where(bits[:n] > 60, 0, BY_COUNT[rank])
    step = COUNT[choice].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts)
    chosen = choice[starts]
    slots = np.where(chosen == 0, 2, 1)
    place = np.cumsum(slots) - slots
    words = np.zeros(int(slots.sum()), "u8")
    for s in range(16):
        mine = np.flatnonzero(chosen == s)
        if not len(mine):
            continue
        if s == 0:
            words[place[mine] + 1] = ids[starts[mine]]
        else:
            first, packed = starts[mine], np.full(len(mine), s << 60, "u8")
            for k in range(COUNT[s] if s < 15 else 0):
                packed |= padded[first + k] << np.uint64(k * WIDTH[s])
            words[place[mine]] = packed
    return words


def simple8b_decode(words: np.ndarray, n: int) -> np.ndarray:
    """The first n ids of the packed words."""
    out = np.zeros(n + 256, "u8")
    selector = (words >> np.uint64(60)).astype("i8")
    raw = np.zeros(len(words), bool)
    # A word after an escape is raw whatever its top bits; escapes are rare, so walk them.
    last = -2
    for i in np.flatnonzero(selector == 0):
        if i != last + 1:
            last = i
            raw[i + 1] = True
    # A raw word whose own top bits are 0 was skipped above; all others of selector 0 are escapes.
    keep = np.flatnonzero(~raw)
    chosen = selector[keep]
    start = np.cumsum(COUNT[chosen]) - COUNT[chosen]
    for s in range(15):
        mine = np.flatnonzero(chosen == s)
        if not len(mine):
            continue
        if s == 0:
            out[start[mine]] = words[keep[mine] + 1]
        else:
            shift = (np.arange(COUNT[s]) * WIDTH[s]).astype("u8")
            ids = (words[keep[mine]][:, None] >> shift) & np.uint64((1 << int(WIDTH[s])) - 1)
            where = start[mine][:, None] + np.arange(COUNT[s])
            out[np.minimum(where, n + 255)] = ids
    return out[:n]


class _Numbered(dict):
    """Numbers each key when it is first asked for, and notes it in ``new``."""

    def __init__(self, *args):
        super().__init__(*args)
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number


class WordEncoder:
    """Encodes texts as the tokenizer does, each different word once.

    The pre-tokenizer drops white space and never joins across it, so a text's
    ids are its words' ids in a row. ASCII letters are lower-cased first, as the
    normaliser does, and common punctuation is parted from a letter before it,
    where the pre-tokenizer parts them too. Texts with what could be a special
    token or the separator are encoded whole. At ``max_words`` words or ``max_chars``
    characters of them the later half of the words is forgotten, and all if that is not enough.
    """

    SEPARATOR = "\x01"
    PARTED = re.compile(r"(?<=[a-zà-öø-ÿ])(?=[.,!?;:%$#&*|()])")

    def __init__(self, path: str, max_words: int = 600_000, max_chars: int = 16_000_000):
        # Spark deals out the cores; the library's own threads would each hold memory of their own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.max_words, self.max_chars = Tokenizer.from_file(path), max_words, max_chars
        mark = self.tokenizer.encode(self.SEPARATOR, add_special_tokens=False).ids
        assert len(mark) == 1, "the separator must be one token"
        self.mark = mark[0]
        self.clear()

    def clear(self) -> None:
        self.index = _Numbered({"": 0})
        self.flat, self.off, self.chars = array("I"), array("i", [0, 0]), 0

    def shrink(self) -> None:
        """Forgets the later half of the words: those that came first are the frequent ones."""
        kept = len(self.index) // 2
        self.index = _Numbered(islice(self.index.items(), kept))
        del self.off[kept + 1:], self.flat[self.off[-1]:]
        self.chars = sum(map(len, self.index))
        if self.chars > self.max_chars // 2:
            self.clear()

    def learn(self) -> None:
        """Encodes the words that the index has numbered since the last call, in their order."""
        words, self.index.new = self.index.new, []
        self.chars += sum(map(len, words))
        parts = [words[i:i + 2000] for i in range(0, len(words), 2000)]
        texts = [f" {self.SEPARATOR} ".join(part) for part in parts]
        for part, got in zip(parts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(got.ids, "u4")
            cuts = np.flatnonzero(ids == self.mark)
            assert len(cuts) == len(part) - 1
            ends = np.append(cuts, len(ids)) - np.arange(len(part))
            self.off.frombytes((ends + self.off[-1]).astype("i4").tobytes())
            self.flat.frombytes(np.delete(ids, cuts).tobytes())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.index) > self.max_words or self.chars > self.max_chars:
            self.shrink()
        split: list[list[str] | None] = []
        for text in texts:
            if "<|" in text or self.SEPARATOR in text:
                split.append(None)
                continue
            lower = text.encode("utf-8").lower().decode("utf-8").replace("\n", " ")
            split.append(self.PARTED.sub(" ", lower).split(" "))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(filter(None, split))), "i4")
        self.learn()
        off, flat = np.frombuffer(self.off, "i4"), np.frombuffer(self.flat, "u4")
        first, length = off[at], off[at + 1] - off[at]
        ends = np.cumsum(length, dtype="i4")
        ids = flat[np.repeat(first - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0, dtype="i4")]
        ends = np.concatenate([[0], ends])
        found, used = [], 0
        for text, words in zip(texts, split):
            if words is None:
                found.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "u4"))
            else:
                found.append(ids[ends[used]:ends[used + len(words)]])
                used += len(words)
        return found


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _portions(texts: list[str | None], most: int = 2_000_000):
    """Places of texts, in order, of about so many characters together."""
    part, size = [], 0
    for i, text in enumerate(texts):
        part.append(i)
        size += len(text or "")
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def is_stored(docs: DataFrame) -> bool:
    """Whether the documents come straight from files, whose names and rows say how they follow each other."""
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
        return True
    except AnalysisException:
        return False


def encode_blocks(docs: DataFrame, tokenizer_path: str, end_id: int = 2, block_ids: int = 65_536, stored: bool = False) -> DataFrame:
    """Blocks of the file format for ``docs(doc_id, text)``, shard by shard in doc_id order.

    Only the texts are shuffled, once, by ranges of doc_id; rows of equal
    doc_id stand in text order. With ``stored`` nothing is shuffled: the
    documents keep the order in which their files hold them, files by the
    number of their part, then by name.

    A null text is encoded as an empty one and gives its end id alone; a null
    doc_id comes first, or with ``stored`` where it stands. Other columns are
    ignored. No documents give no blocks.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    doc_id, text = F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    number = lambda c: F.lpad(c.cast("string"), 10, "0")
    if stored:
        name, row = (docs.metadataColumn("_metadata")[c] for c in ("file_name", "row_index"))
        part = F.coalesce(F.regexp_extract(name, r"part-(\d{1,10})", 1), F.lit(""))
        ranged = docs.select(doc_id, text, F.concat(number(part), F.lit("-"), name, F.lit("-")).alias("shard"), row.alias("row"))
    else:
        ranged = (docs.select(doc_id, text).withColumn("tie", F.xxhash64("text"))
                  .repartitionByRange(common.partitions(spark), "doc_id", "tie")
                  .sortWithinPartitions("doc_id", "tie", "text")
                  .select("doc_id", "text", number(F.spark_partition_id()).alias("shard"), F.lit(None).cast("long").alias("row")))

    def run(batches):
        encoder = _encoder(tokenizer_path)
        file, last, shard, block, before = None, None, "", 0, 0
        keys, lens, parts, held = [], [], [], 0

        def flush():
            nonlocal block, before, keys, lens, parts, held
            words = simple8b_encode(np.concatenate(parts))
            row = pa.RecordBatch.from_arrays([
                pa.array([shard], pa.string()), pa.array([block], pa.int32()), pa.array([before], pa.int64()),
                pa.array([held], pa.int64()), pa.array([keys], pa.list_(pa.int64())),
                pa.array([lens], pa.list_(pa.int32())), pa.array([words.tobytes()], pa.binary())],
                ["shard", "block", "shard_ids", "n_ids", "doc_ids", "doc_lens", "words"])
            block, before = block + 1, before + held
            keys, lens, parts, held = [], [], [], 0
            return row

        for batch in batches:
            doc_ids, texts, files, rows = (c.to_pylist() for c in batch.columns)
            for portion in _portions(texts):
                for i, ids in zip(portion, encoder.encode([texts[i] or "" for i in portion])):
                    if files[i] != file or (rows[i] is not None and rows[i] != last + 1):  # a new run of rows
                        if keys:
                            yield flush()
                        file, block, before = files[i], 0, 0
                        shard = file if rows[i] is None else f"{file}{rows[i]:015d}"
                    last = rows[i]
                    parts.append(np.append(ids, end_id).astype("u8"))
                    keys.append(doc_ids[i])
                    lens.append(len(ids) + 1)
                    held += len(ids) + 1
                    if held >= block_ids:
                        yield flush()
        if keys:
            yield flush()

    return ranged.mapInArrow(run, BLOCK_SCHEMA)


def with_starts(blocks: DataFrame) -> DataFrame:
    """Blocks with ``first``: the ids of all shards and blocks before.

    One row per shard is summed up in order in one task; a shard is a whole
    reduce partition or run of a file, so that a petabyte has some 10**6 of them.
    They are broadcast if they are few.
    """
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = common.written(totals.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("shard_first")), "starts")
    return (blocks.join(common.small(starts, MOST_BROADCAST), "shard")
            .withColumn("first", F.col("shard_first") + F.col("shard_ids")).drop("shard_first"))


def digest(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard and block of each document, from the decoded blocks."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = simple8b_decode(np.frombuffer(row["words"], "u8"), row["n_ids"]).astype("<u4")
                lens = np.array(row["doc_lens"], "i8")
                ends = np.cumsum(lens)
                raw = memoryview(ids.tobytes())
                crcs = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lens.tolist())]
                k = len(lens)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + ends - lens, pa.int64()),
                    pa.array(lens, pa.int64()), pa.array(crcs, pa.int64()),
                    pa.array([row["shard"]] * k, pa.string()), pa.array([row["block"]] * k, pa.int32())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "block"])

    return (blocks.select("shard", "block", "first", "n_ids", "doc_ids", "doc_lens", "words")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string, block int"))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, stored: bool = False) -> None:
    """Writes the documents' ids at path, in the file format."""
    encode_blocks(docs, tokenizer_path, end_id, stored=stored).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The blocks at path, with ``first``."""
    return with_starts(spark.read.schema(BLOCK_SCHEMA).parquet(path))


def token_digest(docs: DataFrame, stored: bool = False) -> DataFrame:
    """Encodes, writes, reads back and digests the documents with the contract's vocabulary."""
    import public_tokenizers
    spark = docs.sparkSession
    path = common.fresh_path(spark, "tokens")
    write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), stored=stored)
    return digest(read_tokens(spark, path))


def op1_token_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(common.table(spark, sf_dir, "documents"))
