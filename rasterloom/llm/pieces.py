"""SentencePiece ids and texts, by a table of the distinct marked words.

The library writes each space as a marker and puts one before the text. Where
no piece of the vocabulary has a marker behind another character, no piece and
no merge crosses the place before a word's marker: a text's ids are its marked
words' ids (a marked word: markers, then what follows up to the next one), one
after the other. So

1. texts are cut to blocks of some megabytes, whose words are numbered; a
   block's different words are dealt to parts by a hash of the word, packed,
   and each text is kept as the numbers of its words;
2. parts hold the distinct words: each is segmented once by the library, and
   the ids go back, packed by block;
3. blocks join the ids back by the words' numbers, text by text.

What is shuffled is each block's different words and their ids, compressed,
and never the texts; the numbers by position are written dealt by block and
stay where they are. With a vocabulary for which
that does not hold a text is one word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .packing import BREAK, numbers, packed, planes, unpacked

MARK = "▁"
#: Characters of a block, and distinct words that a task holds at once.
BLOCK = 12_000_000
MOST_WORDS = 1_000_000

BLOCK_SCHEMA = "block long, doc_ids array<long>, sizes array<int>, places binary, packs array<struct<part int, words binary>>"


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def parts_words(path: str) -> bool:
    """Whether no piece crosses from a character to a marker, spaces stay as they are and one marker goes before."""
    model = _model(path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
    kept = MARK.join("abc") + MARK + MARK
    shown = "".join(model.encode(kept.replace(MARK, " "), out_type=str))
    return shown == MARK + kept and MARK in pieces and not any(MARK in p.lstrip(MARK) for p in pieces) and not any(map(model.is_unused, range(len(pieces))))


def marked_words(text: str) -> list[str]:
    """The marked words of a text, each without its first marker; none of an empty text.

    A word is, but for a first marker, the text that the library would be given
    for it alone.
    """
    if not text:
        return []
    words = text.replace(MARK, " ").split(" ")
    # Spaces in a row leave empty words: they are markers of the word behind them.
    if "" not in words:
        return words
    joined, run = [], 0
    for word in words[:-1]:
        if word:
            joined.append(" " * run + word)
            run = 0
        else:
            run += 1
    joined.append(" " * run + words[-1])
    return joined


class _Numbered(dict):
    """Numbers words as they come."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _block(number: int, rows: list, parts: int, cut) -> pa.RecordBatch:
    found = _Numbered()
    places, sizes = [], []
    for _, text in rows:
        words = cut(text)
        places.append(np.fromiter(map(found.__getitem__, words), "u4", len(words)))
        sizes.append(len(words))
    words = [w.encode("utf-8") for w in found]
    part = np.array([xxhash.xxh32_intdigest(w) for w in words], "u4") % np.uint32(parts) if words else np.empty(0, "u4")
    order = np.argsort(part, kind="stable")
    renumbered = np.empty(len(words), "u4")
    renumbered[order] = np.arange(len(words), dtype="u4")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    order = order.tolist()
    packs = [{"part": p, "words": packed(BREAK.join([words[i] for i in order[a:b]]))} for p, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())) if b > a]
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.array([[i for i, _ in rows]], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())),
         pa.array([planes(renumbered[np.concatenate(places)])], pa.binary()), pa.array([packs], pa.list_(pa.struct([("part", pa.int32()), ("words", pa.binary())])))],
        ["block", "doc_ids", "sizes", "places", "packs"])


def _blocks(docs: DataFrame, path: str, parts: int, most: int = BLOCK) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext
        cut = marked_words if parts_words(path) else (lambda t: [t] if t else [])
        rows, size, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                rows.append((doc_id, text))
                size += len(text) + 1
                if size >= most:
                    yield _block(number, rows, parts, cut)
                    rows, size, number = [], 0, number + 1
        if rows:
            yield _block(number, rows, parts, cut)

    return common.written_by(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, BLOCK_SCHEMA), "blocks", "block")


def _segmented(packs: DataFrame, path: str) -> DataFrame:
    """block, part, ids, sizes: the ids of each pack's words, part by part."""
    def run(batches):
        model, alone = _model(path), parts_words(path)
        mark = model.piece_to_id(MARK)
        now, table = None, {}
        for batch in batches:
            for block, part, words in zip(batch["block"].to_pylist(), batch["part"].to_pylist(), batch["words"].to_pylist()):
                if part != now or len(table) > MOST_WORDS:
                    now, table = part, {}
                words = unpacked(words).split(BREAK)
                new = [w for w in words if w not in table]
                for word, ids in zip(new, model.encode([w.decode("utf-8") for w in new], num_threads=1)):
                    table[word] = np.array(ids, "u4")
                if alone and b"" in table:  # a marker alone, which the library does not put before an empty text
                    table[b""] = np.array([mark], "u4")
                ids = [table[w] for w in words]
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([block], pa.int64()), "part": pa.array([part], pa.int32()),
                    "ids": pa.array([planes(np.concatenate(ids))], pa.binary()),
                    "sizes": pa.array([planes(np.array([len(x) for x in ids]))], pa.binary())})

    dealt = packs.repartition(common.partitions(packs.sparkSession), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "block long, part int, ids binary, sizes binary")


def _joined(blocks: DataFrame, segmented: DataFrame) -> DataFrame:
    """doc_id and ids of each text: a block's packs and its positions meet."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("part")
        ids = [numbers(x) for x in right["ids"].to_pylist()]
        sizes = [numbers(x) for x in right["sizes"].to_pylist()]
        ids = np.concatenate([*ids, np.empty(0, "i8")]).astype("i4")
        sizes = np.concatenate([*sizes, np.empty(0, "i8")])
        first = np.cumsum(sizes) - sizes
        texts, doc_ids = [], []
        for docs, lens, places in zip(left["doc_ids"].to_pylist(), left["sizes"].to_pylist(), left["places"].to_pylist()):
            places = numbers(places)
            at = 0
            for doc_id, n in zip(docs, lens):
                mine = places[at:at + n]
                at += n
                count = sizes[mine]
                shift = np.cumsum(count) - count
                texts.append(ids[np.arange(count.sum()) + np.repeat(first[mine] - shift, count)])
                doc_ids.append(doc_id)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype("i4")
        values = pa.array(np.concatenate([*texts, np.empty(0, "i4")]), pa.int32())
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)})

    return (blocks.select("block", "doc_ids", "sizes", "places").groupBy("block")
            .cogroup(segmented.groupBy("block")).applyInArrow(run, "doc_id long, ids array<int>"))


def encode(docs: DataFrame, path: str, block: int = BLOCK) -> DataFrame:
    """doc_id and ids of each row of ``docs(doc_id, text)``: what the library's encode gives, without begin and end.

    A null or empty text has no ids; rows that repeat, and null doc_ids, give a
    row each; other columns are not read; an empty table gives no row. A text
    of any length is whole in one block, and blocks are of about ``block`` characters.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    blocks = _blocks(docs, path, common.partitions(spark), block)
    packs = blocks.select("block", F.explode("packs").alias("pack")).select("block", "pack.part", "pack.words")
    return _joined(blocks, _segmented(packs, path))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and text of ``encoded(doc_id, ids)``: what the library's decode gives for each row's ids; null ids are none."""
    common.small_batches(encoded.sparkSession)

    def run(batches):
        model = _model(path)
        for batch in batches:
            ids = [x or [] for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.list_(pa.int32())), pa.array([model.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def piece_digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of ``docs``; see encode."""
    both = decode(encode(docs, path), path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return piece_digest(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
