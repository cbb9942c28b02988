"""Chat formatting by quotation linking.

A line's leading > marks are its quote level. Lines of one level that follow each
other make up a passage: at level 0 the message's own text, above it a quote of
another's. A passage is cut into its sentences, whatever its line breaks, for a
quote may be wrapped anew or be a part of its original. Each quoted sentence is
normalised, hashed and joined to the first message that has it as its own, first
within the conversation, else in any other, whatever its number. Across
conversations one sentence must be long enough and one that few of them have, or
stand beside another in one passage and one original.

A message replies to the one that most of its outermost quotes come from. Following replies up gives each
message its thread; sorted by thread and depth, and without quotes, the messages
make up the conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: The leading quote marks of a line, and a line that only announces a quote.
MARKS = r"^(?:[ \t]*>)+[ \t]?"
ANNOUNCES = r"(?i)^(?:on\b.*\bwrote|.*\bschrieb|le\b.*\ba écrit|.*\bescribió)[ \t]*:[ \t]*$"
#: Where a sentence or paragraph ends; what is no letter or digit.
ENDS = r"([.!?])[ \t\n]+|([。！？])|\n[ \t]*\n"
BETWEEN = r"[^\p{L}\p{N}]+"
#: What parts passages, a passage's level from its text, and sentences; taken out of texts before.
NEXT, AFTER_LEVEL, END = "\x01", "\x02", "\x03"

#: Across conversations a quote counts from so many letters, digits and spaces between words on, and a single sentence if at most so many conversations have it.
LEAST, RARE = 16, 3
#: Characters of a message that bounds of ranges have; messages of equal place that begin with the same ones are in one range.
RANGE_CHARACTERS = 64


def lines_of(text: Column) -> Column:
    """Structs (level, line) of a text: the number of leading quote marks, and the rest; lines that announce a quote are empty."""
    clean = F.translate(F.coalesce(text, F.lit("")), NEXT + AFTER_LEVEL + END, "   ")
    return F.transform(F.split(clean, r"\r\n|\r|\n"), lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, r"^((?:[ \t]*>)*)", 1), r"[^>]", "")).alias("level"),
        F.when(x.rlike(ANNOUNCES), F.lit("")).otherwise(F.regexp_replace(x, MARKS, "")).alias("line")))


def normalised(sentence: Column) -> Column:
    """Lower-case words with single spaces between them."""
    return F.trim(F.regexp_replace(F.lower(sentence), BETWEEN, " "))


def passages_of(lines: Column) -> Column:
    """Strings level AFTER_LEVEL text of the passages of ``lines``, a column of its own."""
    same = lambda x, i: (i > 0) & (F.get(lines, F.greatest(i - 1, F.lit(0)))["level"] == x["level"])
    return F.filter(F.split(F.array_join(F.transform(lines, lambda x, i: F.concat(
        F.when(same(x, i), F.lit("\n")).otherwise(F.concat(F.lit(NEXT), x["level"].cast("string"), F.lit(AFTER_LEVEL))), x["line"])), ""), NEXT), lambda p: p != "")


def sentences_of(passages: Column) -> Column:
    """Structs (level, key, long, pair, pair_long) of the sentences that have a word, in order.

    long is a sentence's length. pair and pair_long are of the sentence and the next one of its passage, null at its end.
    """
    def hashed(name, *parts):
        return F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(name), *parts).alias("h2"))

    def keyed(level, plain):
        return F.transform(plain, lambda t, i: F.struct(
            level.alias("level"), hashed("quote", t).alias("key"), F.length(t).alias("long"),
            F.when(i + 1 < F.size(plain), hashed("pair", t, F.get(plain, i + 1))).alias("pair"), (F.length(t) + F.length(F.get(plain, i + 1))).alias("pair_long")))

    def cut(p):
        parts = F.split(F.regexp_replace(F.substring_index(p, AFTER_LEVEL, -1), ENDS, "$1$2" + END), END)
        # An array of one, so that what is asked for at each sentence is made once.
        once = F.array(F.filter(F.transform(parts, normalised), lambda t: t != ""))
        return F.flatten(F.transform(once, lambda plain: keyed(F.substring_index(p, AFTER_LEVEL, 1).cast("int"), plain)))

    return F.flatten(F.transform(passages, cut))


def own_text(lines: Column) -> Column:
    """The lines at level 0 joined again, without those that announce a quote."""
    return F.regexp_replace(F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["line"]), "\n"), r"^[ \t\n]+|[ \t\n]+$", "")


def quotations(split: DataFrame, least: int = LEAST, rare: int = RARE) -> DataFrame:
    """me, level and original of each quoted sentence: the first message that has it as its own.

    ``split`` has row, conv_id, turn and sentences. In the sentence's own conversation an
    original comes before its quote. One of another conversation may have any
    number: it is the first one, or the last where the first is the quote's own. There it takes
    the sentence and one beside it in the passage, in this order in one passage of the original, or else
    a sentence that at most ``rare`` conversations have; either of ``least`` characters. Originals are brought down to one for
    each sentence and conversation, and two for each sentence, before they are joined,
    so that a sentence that stands in very many messages makes no more pairs than
    it is quoted.
    """
    me = F.struct("conv_id", "turn", "row")
    of_level = lambda wanted: split.select(me.alias("me"), F.filter("sentences", wanted).alias("sentences"))
    own = (of_level(lambda x: x["level"] == 0).select("me", F.explode(F.concat("sentences.key", "sentences.pair")).alias("key")).where("key is not null"))
    key = lambda name, at: F.struct(F.col(f"x.{name}").alias("key"), at.alias("at"), F.lit(name == "pair").alias("pair"),
                                    (F.col("x.long" if name == "key" else "x.pair_long") >= least).alias("far"))
    at = F.col("at")
    # A pair speaks for both of its sentences, of which the second is the next of the message's quoted ones.
    quoted = (of_level(lambda x: x["level"] > 0).select("me", F.posexplode("sentences").alias("at", "x"))
              .select("me", "x.level", F.explode(F.array(key("key", at), key("pair", at), key("pair", at + 1))).alias("k"))
              .select("me", "level", "k.*").where("key is not null"))
    inside = own.groupBy("me.conv_id", "key").agg(F.min("me").alias("near"))
    anywhere = inside.groupBy("key").agg(F.min("near").alias("first"), F.max("near").alias("last"), F.count("*").alias("n"))
    met = (quoted.withColumn("conv_id", F.col("me.conv_id")).join(inside, ["conv_id", "key"], "left").join(anywhere, "key", "left"))
    elsewhere = lambda c: F.when(F.col("far") & (F.col(c)["conv_id"] != F.col("conv_id")), F.col(c))
    found = met.withColumn("other", F.coalesce(elsewhere("first"), elsewhere("last"))).groupBy("me", "at", "level").agg(
        F.min(F.when(~F.col("pair") & (F.col("near") < F.col("me")), F.col("near"))).alias("near"),
        F.min(F.when(F.col("pair"), F.col("other"))).alias("passage"), F.min(F.when(~F.col("pair") & (F.col("n") <= rare), F.col("other"))).alias("rare"))
    return found.select("me", "level", F.coalesce("near", "passage", "rare").alias("original"))


def replies(quoted: DataFrame) -> DataFrame:
    """me and parent: the message that most sentences of the lowest level with a known original come from, the latest of equals."""
    votes = quoted.where("original is not null").groupBy("me", "level", "original").agg(F.count("*").alias("n"))
    # Lowest level first, then most sentences, then the latest message.
    return votes.groupBy("me").agg(F.max(F.struct(-F.col("level"), F.col("n"), F.col("original"))).alias("top")).select(
        "me", F.col("top.original").alias("parent"))


def circles(parents: DataFrame) -> DataFrame:
    """me: the first message of each circle of replies, of ``parents`` whose ancestors never end. Steps up double, with the least on the way."""
    up = common.written(parents.select("me", F.col("parent").alias("at"), F.col("parent").alias("least")), "circles")
    while True:
        above = up.select(F.col("me").alias("at"), F.col("at").alias("at2"), F.col("least").alias("least2"))
        up = common.written(up.join(above, "at").select("me", F.col("at2").alias("at"), F.least("least", "least2").alias("least"),
                                                        (F.col("least2") < F.col("least")).alias("lower")), "circles")
        if up.where("lower").isEmpty():  # nowhere less above, so nowhere less at all
            return up.where("least = me").select("me")
        up = up.drop("lower")


def threads(parents: DataFrame) -> DataFrame:
    """me, parent, root and depth of each reply, by doubling the steps up. In a circle of replies the first message replies to none."""
    up = common.written(parents.select("me", "parent", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "replies")
    before = None
    while True:
        above = up.select(F.col("me").alias("root"), F.col("root").alias("root2"), F.col("depth").alias("depth2"))
        moved = common.written(up.join(above, "root", "left").select(
            "me", "parent", F.coalesce("root2", "root").alias("root"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"),
            F.col("root2").isNotNull().alias("open")), "replies")
        left = moved.where("open").count()
        if not left:
            return moved.drop("open")
        if left == before:  # chains that end get fewer with every doubling: these lead into circles
            return threads(parents.join(circles(moved.where("open").select("me", "parent")), "me", "left_anti"))
        before, up = left, moved.drop("open")


def link_quotations(messages: DataFrame, least: int = LEAST, rare: int = RARE) -> DataFrame:
    """Each of ``messages(conv_id, turn, role, text)``: its conversation, place in it, parent, and text without quotes.

    conversation and root_turn are those of the thread's first message, depth
    the number of replies up to it; parent_conv and parent_turn are null
    where nothing known is quoted. n_quoted and n_linked count quoted sentences and
    those with a known original.

    A null text is an empty one. Null conv_ids are one conversation, and null
    turns come first in it. Repeated rows are separate messages; a quote of
    them is linked to the first. In its own conversation an original comes before its
    quote in the order of turn; conversations have no order (see quotations).
    Of messages that reply to each other in a circle the first has no parent.
    Across conversations a quote has ``least`` letters, digits and spaces, and a
    sentence without one beside it is one that at most ``rare`` conversations have.
    """
    split = messages.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("conv_id").cast("long"), F.lit(-(1 << 63))).alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"), F.col("conv_id").cast("long").alias("own_conv"),
        F.col("turn").cast("long").alias("own_turn"), F.col("role").cast("string").alias("role"), lines_of(F.col("text").cast("string")).alias("lines"))
    split = split.withColumn("passages", passages_of(F.col("lines"))).withColumn("sentences", sentences_of(F.col("passages")))
    split = common.written(split.withColumn("text", own_text(F.col("lines"))).drop("lines", "passages"), "messages")
    quoted = common.written(quotations(split, least, rare), "quotations")
    counts = quoted.groupBy("me").agg(F.count("*").alias("n_quoted"), F.count("original").alias("n_linked"))
    linked = threads(replies(quoted)).join(counts, "me", "full").select(
        F.col("me.row").alias("row"), "parent", "root", "depth", "n_quoted", "n_linked")
    null_again = lambda c: F.nullif(c, F.lit(-(1 << 63)))
    return (split.join(linked, "row", "left").select(
        F.col("own_conv").alias("conv_id"), F.col("own_turn").alias("turn"), "role", "text",
        F.when(F.col("root").isNull(), F.col("own_conv")).otherwise(null_again(F.col("root.conv_id"))).alias("conversation"),
        F.when(F.col("root").isNull(), F.col("own_turn")).otherwise(null_again(F.col("root.turn"))).alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        null_again(F.col("parent.conv_id")).alias("parent_conv"), null_again(F.col("parent.turn")).alias("parent_turn"),
        F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked")))


def conversations(messages: DataFrame, most: int = 64, least: int = LEAST, rare: int = RARE) -> DataFrame:
    """conversation, part, n_messages, n_replies, n_quoted, n_linked and chat: messages without quotes in reply order, as role-marked text.

    Messages follow each other by root_turn, depth, conv_id, turn, role and text;
    those without text of their own are left out, as are conversations that have no others. Each part has the next
    ``most`` messages of its conversation, from 0 on, wherever partitions end:
    ranges of all messages are numbered in place, and the ranges of a
    conversation, of which there are no more than partitions, are added up.
    A null role is unknown. Null conv_ids are one conversation.
    """
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>"))
    order = ["conversation", "root_turn", "depth", "conv_id", "turn", "line"]
    # Ranges are told by a sample of keys that the driver sorts, so they part lines by their first characters; inside them whole lines are sorted.
    bounds = [*order[:-1], F.substring("line", 1, RANGE_CHARACTERS)]
    linked = common.written(link_quotations(messages, least, rare).where("text != ''").withColumn("line", line).drop("role", "text"), "linked-messages")
    ranged = (linked.repartitionByRange(common.partitions(messages.sparkSession), *bounds).sortWithinPartitions(*order)
              .withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    ranged = common.written(ranged.withColumn("_key", F.coalesce("conversation", F.lit(-(1 << 63)))), "ranged-messages")
    here = ranged.groupBy("_key", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    here = here.select("_key", "range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    told = ranged.join(here, ["_key", "range"]).withColumn("nth", F.col("at") + F.col("shift"))
    parts = told.groupBy("_key", F.expr(f"nth div {most}").alias("part")).agg(
        F.first("conversation").alias("conversation"), F.count("*").alias("n_messages"), F.count("parent_turn").alias("n_replies"),
        F.sum("n_quoted").alias("n_quoted"), F.sum("n_linked").alias("n_linked"), F.array_sort(F.collect_list(F.struct("nth", "line"))).alias("lines"))
    return parts.select("conversation", "part", "n_messages", "n_replies", "n_quoted", "n_linked", F.array_join("lines.line", "\n").alias("chat"))


def op9_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(common.table(spark, sf_dir, "conversations"))


#: Each message as link_quotations() gives it. Null conv_ids, turns and roles are not in the given tables; the query is compared on those.
LINKED_SQL = rf"""
WITH RECURSIVE split AS (
  SELECT row_number() OVER () AS r, conv_id, turn, role,
    string_split(replace(replace(translate(coalesce(text, ''), chr(1) || chr(2) || chr(3), '   '), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS lines
  FROM conversations),
listed AS (SELECT r, conv_id, turn, i, lines[i] AS raw FROM split, unnest(range(1, len(lines) + 1)) AS t(i)),
marked AS (
  SELECT *, len(regexp_replace(regexp_extract(raw, '^(?:[ 	]*>)*'), '[^>]', '', 'g')) AS level,
    CASE WHEN regexp_matches(raw, '{ANNOUNCES}') THEN '' ELSE regexp_replace(raw, '^(?:[ 	]*>)+[ 	]?', '') END AS line FROM listed),
changed AS (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY r ORDER BY i) THEN 0 ELSE 1 END AS new FROM marked),
passages AS (SELECT r, conv_id, turn, level, passage, string_agg(line, chr(10) ORDER BY i) AS text
  FROM (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i) AS passage FROM changed) GROUP BY ALL),
parts AS (SELECT *, string_split(regexp_replace(text, '{ENDS}', '' || chr(3), 'g'), chr(3)) AS cuts FROM passages),
sentences AS (SELECT r, conv_id, turn, level, passage, k, trim(regexp_replace(lower(cuts[k]), '{BETWEEN}', ' ', 'g')) AS key
  FROM parts, unnest(range(1, len(cuts) + 1)) AS t(k)),
plain AS (SELECT *, lead(key) OVER w AS after, lag(key) OVER w AS before FROM sentences WHERE key <> '' WINDOW w AS (PARTITION BY r, passage ORDER BY k)),
own AS (SELECT r, conv_id, turn, key, NULL::VARCHAR AS after FROM plain WHERE level = 0 UNION ALL SELECT r, conv_id, turn, key, after FROM plain WHERE level = 0 AND after IS NOT NULL),
inside AS (SELECT conv_id, key, after, min((conv_id, turn, r)) AS near FROM own GROUP BY ALL),
anywhere AS (SELECT key, after, min(near) AS first, max(near) AS last, count(*) AS n FROM inside GROUP BY ALL),
quoted AS (SELECT * FROM plain WHERE level > 0),
asked AS (SELECT r, passage, k, conv_id, turn, level, key, NULL::VARCHAR AS after, len(key) AS long FROM quoted
  UNION ALL SELECT r, passage, k, conv_id, turn, level, key, after, len(key) + len(after) FROM quoted WHERE after IS NOT NULL
  UNION ALL SELECT r, passage, k, conv_id, turn, level, before, key, len(key) + len(before) FROM quoted WHERE before IS NOT NULL),
met AS (SELECT a.*, CASE WHEN a.after IS NULL AND near < (a.conv_id, a.turn, a.r) THEN near END AS near,
    CASE WHEN long >= {LEAST} AND (a.after IS NOT NULL OR n <= {RARE}) THEN CASE WHEN first[1] <> a.conv_id THEN first WHEN last[1] <> a.conv_id THEN last END END AS far
  FROM asked a LEFT JOIN inside i ON i.conv_id = a.conv_id AND i.key = a.key AND i.after IS NOT DISTINCT FROM a.after
  LEFT JOIN anywhere e ON e.key = a.key AND e.after IS NOT DISTINCT FROM a.after),
found AS (SELECT r, level, coalesce(min(near), min(far) FILTER (after IS NOT NULL), min(far) FILTER (after IS NULL)) AS original FROM met GROUP BY r, passage, k, level),
counts AS (SELECT r, count(*) AS n_quoted, count(original) AS n_linked FROM found GROUP BY r),
votes AS (SELECT r, level, original, count(*) AS n FROM found WHERE original IS NOT NULL GROUP BY ALL),
parents AS (SELECT r, arg_max(original, (-level, n, original)) AS parent FROM votes GROUP BY r),
numbered AS (SELECT s.r, s.conv_id, s.turn, o.r AS up FROM split s LEFT JOIN parents p USING (r) LEFT JOIN split o ON (o.conv_id, o.turn, o.r) = p.parent),
above AS (SELECT r, up AS a FROM numbered WHERE up IS NOT NULL UNION SELECT x.r, n.up FROM above x JOIN numbered n ON n.r = x.a WHERE n.up IS NOT NULL),
circle AS (SELECT r FROM above WHERE r = a),
broken AS (SELECT x.r FROM above x JOIN circle c ON c.r = x.r JOIN numbered n ON n.r = x.r JOIN numbered m ON m.r = x.a
  GROUP BY x.r HAVING any_value((n.conv_id, n.turn, n.r)) = min((m.conv_id, m.turn, m.r))),
freed AS (SELECT r, CASE WHEN r IN (SELECT r FROM broken) THEN NULL ELSE up END AS up FROM numbered),
climb AS (
  SELECT r, r AS root, 0 AS depth FROM freed WHERE up IS NULL
  UNION ALL SELECT n.r, c.root, c.depth + 1 FROM freed n JOIN climb c ON n.up = c.r),
texts AS (SELECT r, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^[ \t\n]+|[ \t\n]+$', '', 'g') AS text FROM marked WHERE level = 0 GROUP BY r)
SELECT s.conv_id, s.turn, s.role, t.conv_id AS conversation, t.turn AS root_turn, c.depth::BIGINT AS depth,
  o.conv_id AS parent_conv, o.turn AS parent_turn, coalesce(n_quoted, 0)::BIGINT AS n_quoted, coalesce(n_linked, 0)::BIGINT AS n_linked, coalesce(text, '') AS text
FROM split s JOIN climb c USING (r) JOIN split t ON t.r = c.root JOIN freed n ON n.r = s.r LEFT JOIN split o ON o.r = n.up
LEFT JOIN counts USING (r) LEFT JOIN texts ON texts.r = s.r
"""
ORACLE_SQL = f"""
WITH linked AS ({LINKED_SQL}),
said AS (SELECT *, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || text || chr(10) || '<|end|>' AS line FROM linked WHERE text <> ''),
placed AS (SELECT *, (row_number() OVER (PARTITION BY conversation ORDER BY root_turn, depth, conv_id, turn, line) - 1) // 64 AS part FROM said)
SELECT conversation, part, count(*) AS n_messages, count(parent_turn) AS n_replies, sum(n_quoted)::BIGINT AS n_quoted, sum(n_linked)::BIGINT AS n_linked,
  string_agg(line, chr(10) ORDER BY root_turn, depth, conv_id, turn, line) AS chat FROM placed GROUP BY conversation, part
"""
