"""Language ID by Bayesian evidence fusion.

A text's letters give a likelihood for each language (byte trigrams, naive
Bayes). To it are added the likelihood of the declared language, as reliable as
it proves over all documents, and a prior of the address: the share of each
language at a host, smoothed by that of its domain, which is smoothed by that of
the address suffix, and that by all documents'. All shares are sums grouped over
all documents. One class more, und, stands for all that has no model: its
letters come one by one, as often as in all languages together.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .hashing import portions

#: log2 of the trigram table, labelled rows that a language's model is fitted on (about), languages beyond which is refused.
BITS, LABELLED, MOST_LANGUAGES = 15, 4_000, 1_000
#: Trigrams of the background that a language's own are smoothed with; the background's part that is even over the table.
BACKGROUND, EVEN = 0.1 * (1 << BITS), 0.1
#: The class of what has no model; as a label or declaration it says nothing.
UNKNOWN = "und"
#: Numbers of the model that are gathered at once.
PIECE = 1 << 24
#: Different hashes that rows are drawn by.
UNITS = 1 << 40
#: A byte trigram is little news after its neighbours; its log-likelihoods count so much.
WEIGHT = 0.35
#: Rows of the parent's share that a host's, domain's or suffix's share is smoothed with; counts that the reliability starts from.
SMOOTHING, AGREE, DISAGREE = 5.0, 8.0, 1.0

#: For bytes.translate: ASCII letters lower-cased, other ASCII to a space, the rest as it is.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: What identify() adds.
RESULT = ("language", "confidence", "text_language", "declared", "kept")
#: Markup that declares a language (fixed value).
MARKUP = r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})"


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Table places of the texts' byte trigrams (-1: only spaces), and where each text's begin."""
    raw = [b" " + (t or "").encode("utf-8").translate(LETTERS) + b"  " for t in texts]
    x = np.frombuffer(b"".join(raw), "u1").astype("u4")
    gram = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:] if len(x) > 2 else np.empty(0, "u4")
    place = ((gram * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype("i4")
    place[x[1:-1] == 32] = -1
    ends = np.cumsum([len(r) for r in raw])
    return np.append(place, [-1, -1]), np.concatenate([[0], ends])


def language_code(c: Column) -> Column:
    """The primary subtag, lower-cased: en for en-GB; null for none."""
    return F.nullif(F.lower(F.regexp_extract(c, r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1)), F.lit(""))


def background(bytes_seen: np.ndarray) -> np.ndarray:
    """Each table place's share if bytes come one by one, as often as in ``bytes_seen``; a trigram's middle is no space."""
    seen = bytes_seen + 1e-3
    edge, middle = seen / seen.sum(), np.where(np.arange(256) == 32, 0.0, seen)
    pairs = np.outer(middle / middle.sum(), edge).ravel()
    share = np.zeros(1 << BITS)
    for first in range(256):
        gram = (np.uint32(first) << np.uint32(16)) | np.arange(1 << 16, dtype="u4")
        share += np.bincount((gram * np.uint32(2654435761)) >> np.uint32(32 - BITS), pairs * edge[first], 1 << BITS)
    return (1 - EVEN) * share + EVEN / (1 << BITS)


def fit(labelled: DataFrame, bound: int = LABELLED) -> tuple[list[str], np.ndarray]:
    """Languages and (2 ** BITS, languages) log-likelihoods from ``labelled(text, label)``; the last is UNKNOWN.

    All labels are languages, however few their rows. About ``bound`` rows of each are used, drawn by
    a hash of the text, and at least those of the least hash. Their trigram counts are summed up by
    language on the executors; what comes to the driver is as large as the model.
    """
    hashed = labelled.where(f"label is not null and text is not null and label != '{UNKNOWN}'").withColumn(
        "hash", F.pmod(F.xxhash64("text"), F.lit(UNITS)))
    found = hashed.groupBy("label").agg(F.count("*").alias("n"), F.min("hash").alias("least")).orderBy("label").collect()
    if not found:
        return [], np.zeros((1 << BITS, 0), "f4")
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"{len(found)} languages: their models would be too large to broadcast")
    most = [(k, r["label"], max(r["least"], int(min(1.0, bound / r["n"]) * UNITS))) for k, r in enumerate(found)]
    limits = labelled.sparkSession.createDataFrame(most, "k int, label string, most long")
    drawn = hashed.join(F.broadcast(limits), "label").where("hash <= most").select("k", "text")

    def count(frames):
        for frame in frames:
            for k, part in frame.groupby("k"):
                texts = part["text"].tolist()
                place, _ = trigrams(texts)
                letters = np.frombuffer("".join(f"{t} " for t in texts).encode("utf-8").translate(LETTERS), "u1")
                n = np.concatenate([np.bincount(place[place >= 0], minlength=1 << BITS), np.bincount(letters, minlength=256)])
                at = np.flatnonzero(n)
                yield pd.DataFrame({"k": k, "place": at, "n": n[at]})

    # Places beyond the trigrams' are bytes.
    table = drawn.mapInPandas(count, "k int, place int, n long").groupBy("k", "place").agg(F.sum("n").alias("n")).toPandas()
    trigram = table["place"] < 1 << BITS
    letters = table[~trigram].groupby("place")["n"].sum()
    even = background(np.bincount(letters.index - (1 << BITS), letters, 256))
    grid = np.repeat((even * BACKGROUND)[:, None], len(found) + 1, axis=1)
    grid[table["place"][trigram], table["k"][trigram]] += table["n"][trigram]
    return [*(r["label"] for r in found), UNKNOWN], (np.log(grid) - np.log(grid.sum(axis=0))).astype("f4")


def score(docs: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """All columns of docs but text, with letters (trigrams counted), logs and shares (one a language; shares sum to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(np.vstack([model, np.zeros((1, len(languages)), "f4")]))
    others = [c for c in docs.columns if c != "text"]
    step = max(1, PIECE // len(languages))

    def run(frames):
        for frame in frames:
            texts = frame["text"].tolist()
            for i, j in portions(texts, 1_000_000):
                place, begins = trigrams(texts[i:j])
                logs = np.zeros((j - i, len(languages)))
                for at in range(0, len(place), step):  # pieces, as a trigram has a row of the model
                    inside = slice(np.searchsorted(begins[:-1], at, "right") - 1, np.searchsorted(begins[:-1], at + step))
                    cuts = np.maximum(begins[:-1][inside] - at, 0)
                    logs[inside] += np.add.reduceat(shared.value[place[at:at + step]], cuts, axis=0, dtype="f8") * WEIGHT
                counted = np.add.reduceat(place >= 0, begins[:-1], dtype="i8")
                shares = np.exp(logs - logs.max(axis=1, keepdims=True))
                shares /= shares.sum(axis=1, keepdims=True)
                part = frame.iloc[i:j]
                yield part[others].assign(letters=counted, logs=list(logs), shares=list(shares))

    schema = docs.select(*others, F.lit(0).cast("long").alias("letters"), F.array(F.lit(0.0)).alias("logs"), F.array(F.lit(0.0)).alias("shares")).schema
    return docs.select("text", *others).mapInPandas(run, schema)


def identify(docs: DataFrame, declared: Column, address: Column, label: Column, *, text: str | Column = "text", drop: str = "text",
             languages: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """language, confidence, text_language, declared and kept of each row, beside the columns of docs without ``drop``.

    ``text`` is judged; ``declared`` is a language code, where none is given the
    text's markup is asked; ``address`` is a host or URL; ``label`` is what the
    text model is fitted on, null for rows that are judged only. A row is kept if it has letters, its language is
    known and wanted (``languages``, default any) and its posterior is at least
    ``least``.

    A text whose letters go together as in no known language is und and rejected.
    So is a null or empty text, which has no letters. Null and
    unknown declarations and addresses are no evidence beyond all documents'
    own shares. Without a labelled row no language is known and all rows are
    und. Rows are judged one by one, repeated or not. Columns of
    docs that are named as these five are replaced.
    """
    common.small_batches(docs.sparkSession)
    bare = F.regexp_replace(F.lower(F.coalesce(address, F.lit(""))), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, r"^(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1)
    text = (F.col(text) if isinstance(text, str) else text).cast("string")
    known, model = fit(docs.select(text.alias("text"), language_code(label).alias("label")))
    # The documents' own columns go along under other names, as theirs may be any.
    back = {f"_o{i}": c for i, c in enumerate(c for c in docs.columns if c not in (drop, *RESULT))}
    others = [*back, "_declared"]
    said = F.nullif(F.coalesce(language_code(declared), declared_by(text)), F.lit(UNKNOWN))
    given = docs.select(text.alias("text"), *(F.col(f"`{c}`").alias(o) for o, c in back.items()), said.alias("_declared"), host.alias("_host"))
    if not known:
        return given.select(*common.named(back), F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("confidence"),
                            F.lit(UNKNOWN).alias("text_language"), F.col("_declared").alias("declared"), F.lit(False).alias("kept"))
    scored = common.written(score(given, known, model), "language-scores")
    # All that is said of each language is an array, so that expressions do not grow with the number of languages.
    n, names = len(known), F.array(*map(F.lit, known))
    likeliest = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    totals = lambda c: F.array(*(F.sum(F.col(c)[k]) for k in range(n))).alias("sums")
    lettered = F.col("letters") > 0
    scored = scored.withColumn("text_language", F.when(lettered, likeliest("logs")).otherwise(F.lit(UNKNOWN))).withColumn(
        "_said", F.when(F.col("_declared").isin(known), F.col("_declared")).otherwise(F.when(F.col("_declared").isNull(), F.lit("")).otherwise(F.lit("?"))))
    counted = scored.where(lettered)

    # How often each declaration goes with each language: at most (languages + 2) * languages sums.
    seen = {r["_said"]: r["sums"] for r in counted.groupBy("_said").agg(totals("shares")).collect()}
    said_logs = {said: [] for said in [*known, "?"]}
    for k in range(n):
        weights = {said: (seen[said][k] if said in seen else 0.0) + (AGREE if said == known[k] else DISAGREE) for said in said_logs}
        whole = sum(weights.values())
        for said, weight in weights.items():
            said_logs[said].append(math.log(weight / whole))
    said_logs[""] = [0.0] * n
    told_by = docs.sparkSession.createDataFrame(list(said_logs.items()), "_said string, _told array<double>")

    # Shares by host, domain and suffix; each level sums the one below.
    parts = F.split("_host", r"\.")
    domain = F.when(F.size(parts) >= 2, F.concat_ws(".", F.slice(parts, F.size(parts) - 1, 2))).otherwise(F.lit(""))
    suffix = F.when(F.size(parts) >= 2, F.element_at(parts, -1)).otherwise(F.lit(""))
    hosts = counted.groupBy("_host").agg(totals("shares"), F.count("*").cast("double").alias("_n"))
    hosts = common.written(hosts.withColumn("_domain", domain).withColumn("_suffix", suffix), "language-hosts")
    up = lambda key: hosts.groupBy(key).agg(totals("sums"), F.sum("_n").alias("_n"))
    smoothed = lambda above: F.zip_with("sums", above, lambda s, a: (s + SMOOTHING * a) / (F.col("_n") + SMOOTHING))
    everything = hosts.agg(totals("sums"), F.sum("_n").alias("_n")).first()
    whole = (everything["_n"] or 0.0) + n
    prior = F.array(*(F.lit(((s or 0.0) + 1.0) / whole) for s in everything["sums"]))
    suffixes = up("_suffix").select("_suffix", smoothed(prior).alias("_above"))
    domains = (up("_domain").withColumn("_suffix", F.element_at(F.split("_domain", r"\."), -1))
               .join(suffixes, "_suffix").select("_domain", smoothed(F.col("_above")).alias("_above")))
    # A host's own share is smoothed row by row below, without the row itself.
    hosts = common.written(hosts.join(domains, "_domain").select(
        "_host", F.col("_n").alias("_hn"), F.col("sums").alias("_h"), "_above"), "language-priors")
    own = F.when(lettered, F.lit(1.0)).otherwise(F.lit(0.0))
    rows = F.coalesce("_hn", F.lit(0.0)) - own + SMOOTHING
    others_here = F.zip_with(F.coalesce("_h", F.array_repeat(F.lit(0.0), n)), "shares", lambda h, p: h - own * p)
    share = F.zip_with(others_here, F.coalesce("_above", prior), lambda h, a: (h + SMOOTHING * a) / rows)
    told = F.zip_with("logs", "_told", lambda x, y: x + y)
    sums = F.zip_with(told, share, lambda x, s: x + F.log(F.greatest(s, F.lit(1e-9))))
    joined = scored.join(hosts, "_host", "left").join(F.broadcast(told_by), "_said").select(*others, "letters", "text_language", sums.alias("_sums"))
    # The posterior of the likeliest: its part, exp(0), of all.
    best = 1 / F.aggregate("_sums", F.lit(0.0), lambda total, x: total + F.exp(x - F.array_max("_sums")))
    judged = joined.select(*others, "letters", "text_language", likeliest("_sums").alias("_name"), best.alias("_best"))
    wanted = (F.col("_name") != UNKNOWN) & (F.col("_name").isin(languages) if languages is not None else F.lit(True))
    return judged.select(*common.named(back), F.when(lettered, F.col("_name")).otherwise(F.lit(UNKNOWN)).alias("language"),
                         F.when(lettered, F.col("_best")).otherwise(F.lit(0.0)).alias("confidence"), "text_language",
                         F.col("_declared").alias("declared"), (lettered & wanted & (F.col("_best") >= least)).alias("kept"))


def declared_by(markup: Column) -> Column:
    """The language code that a text's markup declares; null for none."""
    return language_code(F.nullif(F.regexp_extract(markup, MARKUP, 1), F.lit("")))


def without_markup(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>", " "), r"<[^>]*>", " ")


def identify_documents(docs: DataFrame, declared: Column | None = None, **how) -> DataFrame:
    """Of ``docs(text, lang, source)``: lang is what the model is fitted on and no evidence beyond that, source the address; without ``declared`` only markup declares."""
    return identify(docs, F.lit(None).cast("string") if declared is None else declared, F.col("source"), F.col("lang"), **how)


def identify_pages(pages: DataFrame, **how) -> DataFrame:
    """Of ``pages(url, html)``, without html: the language is declared by the markup, on which the model is fitted too; the address is the URL; tags are not text.

    Null and empty pages have no letters and are und.
    """
    markup = declared_by(F.col("html").cast("string"))
    return identify(pages, markup, F.col("url").cast("string"), markup, text=without_markup(F.col("html").cast("string")), drop="html", **how)


def keep_identified(docs: DataFrame, **how) -> DataFrame:
    """The documents, all columns, without those whose language is rejected; these are told by doc_id and a hash of the text.

    Null and empty texts are rejected; of repeated rows all go or stay. Here lang is a declaration too, as
    reliable as it proves, for a filter is to spare short texts that half consist of a key or number.
    """
    keyed = docs.select("doc_id", "text", "lang", "source", F.xxhash64("text").alias("_key"))
    out = common.written(identify_documents(keyed, F.col("lang"), **how).where("not kept").select(
        F.col("doc_id").alias("_id"), F.col("_key").alias("_key2")).distinct(), "language-rejects")
    return docs.join(out, docs["doc_id"].eqNullSafe(out["_id"]) & (F.xxhash64(docs["text"]) == out["_key2"]), "left_anti")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages, with one model and one set of address shares.

    The model is fitted on the documents' lang, which is no evidence beyond that; pages have no
    label, and bring declarations by markup and hosts, domains and suffixes. A page has its page_id
    and as doc_id, which no document has, -1 - page_id.
    """
    docs, pages = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "pages")
    null = F.lit(None)
    html = F.col("html")
    both = docs.select("doc_id", null.cast("long").alias("page_id"), "text", null.cast("string").alias("said"), F.col("source").alias("address"), "lang").unionByName(
        pages.select((-1 - F.col("page_id")).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), without_markup(html).alias("text"),
                     declared_by(html).alias("said"), F.col("url").alias("address"), null.cast("string").alias("lang")))
    return identify(both, F.col("said"), F.col("address"), F.col("lang")).select("doc_id", "page_id", "language", "confidence", "text_language", "declared", "kept")
