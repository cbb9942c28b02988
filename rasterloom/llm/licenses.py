"""License scans by diagonal voting, in DataFrame functions only.

Every rolling gram of words of a document is hashed and joined to the places of
the templates' grams (two words of a phrase, three of a notice or license). A
match, compared word by word, votes for the diagonal (document place less
template place) on which template and document run side by side. Votes are
gathered by diagonal, and neighbouring diagonals are merged (a word too many or
too few moves a text to the next one).

A merged span is then verified in order: its document words, where a word that
no matched gram covers counts as another one, are compared with the template's
as two strings with a character for each word. Their edit distance may be a
tenth of the template's words, so that stutters, shuffled words and words put in
all count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Phrases whose every consecutive occurrence counts, with their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Well-known notices and their labels.
NOTICES = (
    ("released under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction", "mit-text"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-text"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation", "gpl-text"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
)
#: Whole license texts and file headers, without the lines that name holders and years.
TEXTS = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
     "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
     "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
     "furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be "
     "included in all copies or substantial portions of the software the software is provided as is without warranty of any kind "
     "express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
     "noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability "
     "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or "
     "other dealings in the software", "mit-full"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
     "that the above copyright notice and this permission notice appear in all copies the software is provided as is and the "
     "author disclaims all warranties with regard to this software including all implied warranties of merchantability and "
     "fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages "
     "whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action "
     "arising out of or in connection with the use or performance of this software", "isc-full"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following "
     "conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the "
     "following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and "
     "the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of "
     "the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
     "software without specific prior written permission this software is provided by the copyright holders and contributors as "
     "is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness "
     "for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct "
     "indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods "
     "or services loss of use data or profits or business interruption however caused and on any theory of liability whether in "
     "contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even "
     "if advised of the possibility of such damage", "bsd-3-full"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
     "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed "
     "to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of "
     "any kind either express or implied see the license for the specific language governing permissions and limitations under "
     "the license", "apache-header"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
     "published by the free software foundation either version 3 of the license or at your option any later version this program "
     "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
     "merchantability or fitness for a particular purpose see the gnu general public license for more details", "gpl-header"),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile "
     "sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non "
     "commercial and by any means", "unlicense-text"),
)
#: Words of a gram: of a phrase, and of a notice or text. Different words that a template may have, each a character.
PHRASE_GRAM, GRAM, MOST_WORDS = 2, 3, 250
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; lower(), which is faster, does the same to ASCII alone."""
    text = F.coalesce(text, F.lit(""))
    plain = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.regexp_extract_all(plain, F.lit(common.PLAIN_WORD), F.lit(0))


def grams_of(words: Column) -> Column:
    """Structs (w0, w1, w2) of the words from each place on; spaces stand after the last word, at whose place only they are."""
    ended = F.concat(words, F.array(*[F.lit(" ")] * 3))
    return F.arrays_zip(*(F.slice(ended, F.lit(1 + k), F.size(words) + 1).alias(f"w{k}") for k in range(3)))


def templates(spark: SparkSession, base=BASE, notices=NOTICES + TEXTS) -> DataFrame:
    """t, label, is_base, gram, words, codes (a character for each word) and n_grams of each template: a fixed list."""
    quoted = lambda c: "'" + c.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(f"({i}, {quoted(text)}, {quoted(label)}, {str(i < len(base)).lower()})" for i, (text, label) in enumerate((*base, *notices)))
    listed = spark.sql(f"SELECT * FROM VALUES {rows} AS v(t, text, label, is_base)").withColumn("words", words_of(F.col("text")))
    listed = listed.withColumn("gram", F.when(F.col("is_base"), PHRASE_GRAM).otherwise(GRAM)).withColumn("known", F.array_distinct("words"))
    # The character 1 is for all words that are not the template's.
    code = lambda w: F.char(F.array_position("known", w) + 1)
    known = F.when(F.size("known") <= MOST_WORDS, F.col("words")).otherwise(F.raise_error(F.lit("a template has too many different words")))
    return listed.select("t", "label", "is_base", "gram", known.alias("words"), F.array_join(F.transform("words", code), "").alias("codes"),
                         (F.size("words") - F.col("gram") + 1).alias("n_grams"))


def places(listed: DataFrame) -> DataFrame:
    """hash (of w0 and w1), t, t_at, w0, w1 and w2 (null for phrases) of each gram of the templates; t -1 is what ends each document."""
    placed = (listed.select("t", "is_base", "n_grams", F.posexplode(grams_of(F.col("words"))).alias("t_at", "g")).where("t_at < n_grams")
              .select("t", "t_at", "g.w0", "g.w1", F.when(~F.col("is_base"), F.col("g.w2")).alias("w2")))
    end = listed.sparkSession.sql("SELECT -1 AS t, 0 AS t_at, ' ' AS w0, ' ' AS w1, CAST(NULL AS STRING) AS w2")
    return placed.unionByName(end).select(F.xxhash64("w0", "w1").alias("hash"), "t", "t_at", *(F.col(f"w{k}").alias(f"t{k}") for k in range(3)))


def spans(docs: DataFrame, merge: int = 2, coverage: float = 0.9, **given) -> DataFrame:
    """row, doc_id, t, label, is_base, start, distance and score of each verified span, and a row of t -1 at each document's end."""
    listed = templates(docs.sparkSession, **given)
    exploded = (docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                            words_of(F.col("text").cast("string")).alias("words")).select("row", "doc_id", grams_of(F.col("words")).alias("grams"))
                .select("row", "doc_id", F.posexplode("grams").alias("at", "g"))
                .select("row", "doc_id", "at", "g.w0", "g.w1", "g.w2", F.xxhash64("g.w0", "g.w1").alias("hash")))
    matched = (exploded.join(F.broadcast(places(listed)), "hash").where("w0 = t0 AND w1 = t1 AND (t2 IS NULL OR w2 = t2)")
               .select("row", "doc_id", "t", "t_at", (F.col("at") - F.col("t_at")).alias("diagonal")))
    # A diagonal meets each place of a template once at most.
    votes = matched.repartition("row").groupBy("row", "doc_id", "t", "diagonal").agg(F.collect_list("t_at").alias("places"))
    votes = votes.join(F.broadcast(listed.select("t", "is_base")), "t", "left")
    along = Window.partitionBy("row", "t").orderBy("diagonal")
    single = F.coalesce("is_base", F.lit(True))
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > F.when(single, 0).otherwise(merge), F.lit(True))
    merged = (votes.withColumn("new", apart.cast("int")).withColumn("span", F.sum("new").over(along))
              .groupBy("row", "doc_id", "t", "span").agg(F.min("diagonal").alias("start"), F.collect_list(F.struct("diagonal", "places")).alias("votes"))
              .join(F.broadcast(listed.drop("words")), "t", "left"))
    # Edits that a template may have, each of which takes away as many grams as hold a word.
    edits = F.when(F.col("is_base"), 0).otherwise(F.floor(F.length("codes") * (1 - coverage) + 1e-9))
    enough = F.size(F.array_distinct(F.flatten("votes.places"))) >= F.col("n_grams") - F.col("gram") * F.col("edits")
    found = merged.withColumn("edits", edits).where(F.col("is_base").isNull() | enough)
    covered = F.transform("votes", lambda v: F.flatten(F.transform(v["places"], lambda p: F.transform(F.sequence(F.lit(0), F.col("gram") - 1), lambda k: F.struct(
        (v["diagonal"] + p + k).alias("at"), F.substring("codes", p + k + 1, F.lit(1)).alias("code"))))))
    found = found.withColumn("covered", F.array_sort(F.array_distinct(F.flatten(covered))))
    gap = lambda x, i: F.when(i == 0, 0).otherwise(x["at"] - F.get("covered", F.greatest(i - 1, F.lit(0)))["at"] - 1).cast("int")
    text = F.array_join(F.transform("covered", lambda x, i: F.concat(F.repeat(F.lit("\x01"), gap(x, i)), x["code"])), "")
    found = found.withColumn("distance", F.when(F.col("is_base").isNotNull(), F.levenshtein(text, "codes"))).where("is_base IS NULL OR distance <= edits")
    return found.select("row", "doc_id", "t", "label", "is_base", "start", "distance", (1 - F.col("distance") / F.length("codes")).alias("score"))


def scan_licenses(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row of ``docs(doc_id, text)``.

    Base phrases count at every place where their words stand consecutively;
    ``labels`` also has those of notices and texts that a span has in order but for a share of
    1 - ``coverage`` of their words, and ``score`` is the best span's, 1 less that share (1 for a
    base phrase, 0 for none). A null text is an empty one and gives a row of
    zeros; repeated rows and rows of null or equal doc_id each give a row.
    """
    base = F.coalesce("is_base", F.lit(False))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (spans(docs, **how).groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("t") < 0, F.col("start"))).cast("long").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        listed(F.when(base, F.col("label"))).alias("base_labels"),
        listed("label").alias("labels"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score")).drop("row"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(common.table(spark, sf_dir, "documents"))
