"""Benchmark decontamination with a generalised suffix automaton.

The automaton is built over the words of the normalised test items. Each
document's words stream through it, and at each word the automaton knows the
longest run of words that ends there and stands in some item. Runs of at least
a window's length are hit. Only stretches all of whose short word grams stand in
some item are streamed: nothing else can hold a window.

Documents take no shuffle: they stay where they are read. A large benchmark is
cut into chunks of items, whose automata are built, broadcast and streamed one
after another, so that neither the driver nor a Python worker holds more than
one of them.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .hashing import Windows, portions, starts_inside, word_hashes

#: Words of the grams that a stretch is told by, at most; items that hold less have shorter ones.
GRAM = 5


class Automaton:
    """Generalised suffix automaton under construction, over items of word numbers.

    A state is a number; ``go[state]`` maps a word's number to the next state,
    ``link`` is the state of its longest suffix that stands in more places, and
    ``size`` the longest run that it stands for.
    """

    def __init__(self):
        self.go: list[dict[int, int]] = [{}]
        self.link, self.size = array("i", [-1]), array("i", [0])

    def add(self, words: list[int]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _new(self, size: int, go: dict[int, int], link: int) -> int:
        self.go.append(go)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A copy of q for the runs of p followed by w, which stand in more places than q's longer ones."""
        copy = self._new(self.size[p] + 1, dict(self.go[q]), self.link[q])
        self.link[q] = copy
        while p != -1 and self.go[p].get(w) == q:
            self.go[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        q = self.go[last].get(w)
        if q is not None:  # an earlier item has this run
            return q if self.size[q] == self.size[last] + 1 else self._split(last, w, q)
        state, p = self._new(self.size[last] + 1, {}, 0), last
        while p != -1 and w not in self.go[p]:
            self.go[p][w] = state
            p = self.link[p]
        if p != -1:
            q = self.go[p][w]
            self.link[state] = q if self.size[q] == self.size[p] + 1 else self._split(p, w, q)
        return state


class Lists:
    """Sorted lists of numbers by key, flat."""

    def __init__(self, sets: dict[int, set[int]]):
        self.keys = array("i", sorted(sets))
        self.ends, self.values = array("i", [0]), array("q")
        for key in self.keys:
            self.values.extend(sorted(sets[key]))
            self.ends.append(len(self.values))

    def get(self, key: int) -> array:
        at = bisect_left(self.keys, key)
        return self.values[self.ends[at]:self.ends[at + 1]] if at < len(self.keys) and self.keys[at] == key else array("q")


class Matcher:
    """A finished automaton in flat arrays, 60 to 75 bytes a word of its items as it is broadcast (see the test), and what it needs to match documents.

    ``edges`` has state * words + word of each transition in order. For each
    state that stands for runs of exactly ``window`` words, ``items_of`` has the
    items that hold that run; ``short_of`` has the shorter items that end at a
    state, and ``short_up`` the nearest such state from each one up its links.
    """

    def __init__(self, items: list[tuple[int, str]], window: int):
        self.window = window
        listed = [(item, words) for item, text in items if (words := common.plain_words(text))]
        self.shortest = min((min(len(words), window) for _, words in listed), default=window)
        self.gram = min(self.shortest, GRAM)
        known = sorted({w for _, words in listed for w in words})
        hashes, _ = word_hashes([b" ".join(known).decode("utf-8")], common.PLAIN_BYTES)
        order = np.argsort(hashes)
        self.hashes, self.words = hashes[order], [known[k] for k in order.tolist()]
        number = {w: k for k, w in enumerate(self.words)}
        hashes, bounds = word_hashes([b" ".join(words).decode("utf-8") for _, words in listed], common.PLAIN_BYTES)
        self.grams = np.unique(Windows(hashes).of(self.gram)[starts_inside(bounds, self.gram, len(hashes))])
        numbered = [(item, [number[w] for w in words]) for item, words in listed]
        automaton = Automaton()
        for _, words in numbered:
            automaton.add(words)
        self.link, self.size = automaton.link, automaton.size
        pairs = sorted((state * len(known) + w, to) for state, go in enumerate(automaton.go) for w, to in go.items())
        self.edges, self.to = array("q", (k for k, _ in pairs)), array("i", (t for _, t in pairs))
        del automaton, pairs
        items_of, short_of = defaultdict(set), defaultdict(set)
        for item, words in numbered:
            for i, (state, _) in enumerate(self.stream(words)):
                if i + 1 >= window:
                    items_of[self._ancestor(state)].add(item)
                elif i + 1 == len(words):
                    short_of[state].add(item)
        self.items_of, self.short_of = Lists(items_of), Lists(short_of)
        self.short_up = None
        if short_of:
            self.short_up = array("i", [-1]) * len(self.size)
            for state in np.argsort(np.frombuffer(self.size, "i4"), kind="stable").tolist()[1:]:
                self.short_up[state] = state if state in short_of else self.short_up[self.link[state]]

    def _ancestor(self, state: int) -> int:
        """The state of the last ``window`` words of a run of ``state`` that has as many."""
        while self.size[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _next(self, state: int, w: int) -> int:
        key = state * len(self.words) + w
        at = bisect_left(self.edges, key)
        return self.to[at] if at < len(self.edges) and self.edges[at] == key else 0

    def stream(self, words):
        """After each word's number (-1: unknown): the state, and the length of the longest matching run that ends there."""
        link, size, state, length = self.link, self.size, 0, 0
        for w in words:
            to = self._next(state, w) if w >= 0 else 0
            while state and not to:
                state = link[state]
                length = size[state]
                to = self._next(state, w) if w >= 0 else 0
            state = to
            length = length + 1 if state else 0
            yield state, length

    def match(self, texts: list[str | None]) -> tuple[list[int], dict[int, tuple[list[tuple[int, int]], set[int]]]]:
        """The number of words of each text; and spans [from, to) of hit words and items with an occurring window, by place of the text."""
        counts, found = [], {}
        for i, j in portions(texts):
            hashes, bounds = word_hashes(texts[i:j], common.PLAIN_BYTES)
            counts += np.diff(bounds).tolist()
            if not len(self.grams) or not len(hashes):
                continue
            here = Windows(hashes).of(self.gram)
            known = starts_inside(bounds, self.gram, len(hashes)) & (self.grams[np.minimum(np.searchsorted(self.grams, here), len(self.grams) - 1)] == here)
            for k in np.unique(np.searchsorted(bounds, np.flatnonzero(known), side="right") - 1).tolist():
                a, b = int(bounds[k]), int(bounds[k + 1])
                got = self._stretches(texts[i + k], hashes[a:b], known[a:b])
                if got[0]:
                    found[i + k] = got
        return counts, found

    def _stretches(self, text: str, hashes: np.ndarray, known: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], known, [0]])))
        begins, ends = edges[::2], edges[1::2] + self.gram - 1
        long = ends - begins >= self.shortest
        words, spans, items = None, [], set()
        for begin, end in zip(begins[long].tolist(), ends[long].tolist()):
            words = words or common.plain_words(text)
            at = np.minimum(np.searchsorted(self.hashes, hashes[begin:end]), len(self.words) - 1).tolist()
            # Equal hashes are not enough: the words are compared.
            self._judge(begin, [k if self.words[k] == w else -1 for k, w in zip(at, words[begin:end])], spans, items)
        return spans, items

    def _judge(self, begin: int, numbers: list[int], spans: list, items: set) -> None:
        for at, (state, length) in enumerate(self.stream(numbers), begin + 1):
            if length >= self.window:
                spans.append((at - length, at))
                items.update(self.items_of.get(self._ancestor(state)))
            short = -1 if self.short_up is None else self.short_up[state]
            while short != -1:
                if self.size[short] <= length:
                    spans.append((at - self.size[short], at))
                    items.update(self.short_of.get(short))
                short = self.short_up[self.link[short]]


def covered(spans: list[tuple[int, int]], n: int) -> np.ndarray:
    """Which of n words are inside a span."""
    if not spans:
        return np.zeros(n, bool)
    step = np.zeros(n + 1, "i8")
    begin, end = np.array(spans).T
    np.add.at(step, begin, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


def chunks(benchmark: DataFrame, window: int, chunk_words: int) -> Iterator[Matcher]:
    """Automata of the items, one after another, each over about ``chunk_words`` words or one item.

    Items come to the driver one at a time. Rows of null item or without words
    have no window.
    """
    part, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null").distinct()
    for item, text in rows.toLocalIterator():
        words = len(common.plain_words(text))
        if part and size + words > chunk_words:
            yield Matcher(part, window)
            part, size = [], 0
        part.append((item, text))
        size += words
    yield Matcher(part, window)


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def cut_words(text: str, hit: np.ndarray) -> str:
    """The text without its hit words and what stands between two of them; other text stays as it is."""
    raw, out, kept_to, removing = text.encode("utf-8"), [], 0, False
    for k, m in enumerate(_WORD.finditer(raw)):
        if hit[k] and not removing:
            out.append(raw[kept_to:m.start()])
            removing = True
        elif not hit[k] and removing:
            kept_to, removing = last_end, False  # noqa: F821
        last_end = m.end()  # noqa: F841
    out.append(raw[last_end if removing else kept_to:] if hit.any() else raw)
    return b"".join(out).decode("utf-8", "ignore")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, coverage: float = 0.05,
                  chunk_words: int = 400_000, keep: bool = False) -> DataFrame:
    """Judges ``docs(doc_id, text)`` against ``benchmark(item_id, text)``.

    A window is ``window`` consecutive words of an item, or the whole of a
    shorter item. Words inside any occurrence of a window are hit; a document
    is contaminated if words are hit and they are at least ``coverage`` of it.
    Returns doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for
    each row, in place; with ``keep``, all columns of the documents instead,
    without the contaminated ones, and with hit spans cut from the rest (and
    n_chars counted anew, where there is one).

    Each chunk of the benchmark after the first takes one more pass over the
    documents, which are written with what was found in between.

    A null or empty text has no words. No benchmark hits nothing. Repeated rows
    are judged one by one; items that share an id are one item.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    share = Fraction(str(coverage))
    # The documents' own columns go along under other names, as theirs may be any.
    others = [c for c in docs.columns if c != "text"] if keep else []
    back = {f"_o{i}": c for i, c in enumerate(others)}
    text = F.col("text").cast("string").alias("text")
    flat = lambda n: F.array().cast("array<long>").alias(n)
    given = (docs.select(text, *(F.col(c).alias(o) for o, c in back.items()), flat("_spans"), flat("_items")) if keep else
             docs.select(text, F.col("doc_id").cast("long").alias("doc_id"), flat("_spans"), flat("_items")))

    def judged(shared, texts, spans, items):
        """n_words, hit words and items of each text, with what earlier passes found."""
        counts, found = shared.value.match(texts)
        for k, n in enumerate(counts):
            more, which = found.get(k, ((), ()))
            yield n, [*zip(spans[k][::2], spans[k][1::2]), *more], {*items[k], *which}

    def adding(shared):
        import pyarrow as pa

        def run(batches):
            for batch in batches:
                at = {name: batch.column(name) for name in batch.schema.names}
                made = list(judged(shared, *(at[c].to_pylist() for c in ("text", "_spans", "_items"))))
                at["_spans"] = pa.array([[x for span in spans for x in span] for _, spans, _ in made], pa.list_(pa.int64()))
                at["_items"] = pa.array([sorted(items) for _, _, items in made], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(list(at.values()), list(at))
        return run

    def rate(n_hit: int, n: int) -> bool:
        return n_hit > 0 and share.denominator * n_hit >= share.numerator * n

    def digesting(shared):
        def run(frames):
            for frame in frames:
                rows = []
                for doc_id, (n, spans, items) in zip(frame["doc_id"], judged(shared, *(frame[c].tolist() for c in ("text", "_spans", "_items")))):
                    n_hit = int(covered(spans, n).sum())
                    listed = ",".join(sorted(map(str, items)))
                    rows.append((doc_id, n, n_hit, len(items), hashlib.sha256(listed.encode()).hexdigest(), rate(n_hit, n)))
                yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
        return run

    def cleaning(shared):
        import pyarrow as pa

        def run(batches):
            for batch in batches:
                texts, stay, kept = batch.column("text").to_pylist(), [], []
                for own, (n, spans, _) in zip(texts, judged(shared, texts, *(batch.column(c).to_pylist() for c in ("_spans", "_items")))):
                    hit = covered(spans, n)
                    n_hit = int(hit.sum())
                    stay.append(not rate(n_hit, n))
                    kept.append(cut_words(own, hit) if n_hit and stay[-1] else own)
                columns = [pa.array(kept, pa.string()), *(batch.column(o) for o in back)]
                mask = pa.array(stay, pa.bool_())
                yield pa.RecordBatch.from_arrays([c.filter(mask) for c in columns], ["text", *back])
        return run

    matchers = chunks(benchmark, window, chunk_words)
    matcher = next(matchers)
    for following in matchers:
        shared = spark.sparkContext.broadcast(matcher)
        given = common.written(given.mapInArrow(adding(shared), given.schema), "decontaminated")
        shared.destroy()
        matcher = following
    shared = spark.sparkContext.broadcast(matcher)
    if not keep:
        return given.mapInPandas(digesting(shared), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    kept = given.mapInArrow(cleaning(shared), given.drop("_spans", "_items").schema).select("text", *common.named(back)).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
