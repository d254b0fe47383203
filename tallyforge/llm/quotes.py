"""Quotation linking with DataFrame functions: quoted passages of messages meet the originals.

A line that begins with `>` marks is quoted, at the level of their number. A passage is a run of lines
of one level without a blank line. Three kinds of units are hashed after normalising: the passage with
its lines joined, the sentences of the joined passage, and the lines; so a passage meets its original
although the quoting client wrapped it anew or left a part out. Units of quoted passages join units of
earlier messages' own passages; the latest earlier message counts. The message replied to comes from
the passages of the lowest level; deeper ones are looked for before that message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, let, table

MARKS = r"^(?:\s{0,3}>)+"
#: A line that introduces a quotation ("On ... X wrote:") is no part of the message, if a quoted line follows, blank ones apart.
INTRO = r"(?i)^\s*(?:on|le|am|el)\b.*\b(?:wrote|écrit|schrieb|escribió)\b.*:\s*$"
#: Turns of a conversation are searched in spans of so many, so that one conversation may be many tasks.
SPAN = 4096
MESSAGE = ["conv_id", "turn", "text_hash"]


def normal(text: Column) -> Column:
    """Lower case, words only, one space between."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}]+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """messages(text, ...) with `lines`, array of (level, body), level 0 for own lines, and `passages`, array of (level, lines), both without introductions.

    An own line is an introduction if it reads as one and quoted lines follow, at once or after blank ones. A null text is one empty line
    and has no passage; blank lines end passages; other columns pass through, but for those of these two names.
    """
    lines = F.transform(
        F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"\r?\n"),
        lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), r"\s", "")).alias("level"), F.trim(F.regexp_replace(x, MARKS, "")).alias("body")),
    )

    def begins(line: Column, i: Column) -> Column:
        own, before = F.get(line, i), F.get(line, i - 1)
        return (i == 0) | (own["level"] != before["level"]) | ((own["body"] == "") != (before["body"] == ""))

    def runs(line: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(line) - 1), lambda i: begins(line, i))
        run = lambda at: lambda s, k: F.slice(line, s + 1, F.coalesce(F.get(at, k + 1), F.size(line)) - s)
        return let(first, lambda at: F.transform(at, run(at)))

    def told(every: Column) -> Column:
        """The runs, introductions left out."""
        first = lambda k: F.get(F.get(every, k), F.lit(0))
        quoted = lambda k: F.coalesce(first(k)["level"] > 0, F.lit(False))
        follows = lambda k: quoted(k + 1) | (quoted(k + 2) & (first(k + 1)["body"] == ""))
        last = lambda r: F.element_at(r, -1)
        return F.transform(every, lambda r, k: F.when((last(r)["level"] == 0) & last(r)["body"].rlike(INTRO) & follows(k), F.slice(r, 1, F.size(r) - 1)).otherwise(r))

    passage = lambda r: F.struct(F.get(r, F.lit(0))["level"].alias("level"), F.transform(r, lambda x: x["body"]).alias("lines"))
    held = messages.withColumn("lines", let(let(lines, runs), told))
    passages = F.filter(F.transform(F.filter("lines", lambda r: F.size(r) > 0), passage), lambda p: F.get(p["lines"], F.lit(0)) != "")
    return held.withColumn("passages", passages).withColumn("lines", F.flatten("lines"))


def units(keyed: DataFrame) -> DataFrame:
    """conv_id, turn, text_hash, at, level, n_lines, kind, hash, n of each unit of keyed(passages, ...); units without a letter or digit are none."""
    each = keyed.select(*MESSAGE, F.posexplode("passages").alias("at", "p")).select(*MESSAGE, "at", "p.level", "p.lines")
    kind = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), x.alias("text"))
    whole = F.array_join("lines", " ")
    every = F.concat(F.transform(F.array(whole), kind("passage")), F.transform(F.split(whole, r"(?<=[.!?])\s+"), kind("sentence")), F.transform("lines", kind("line")))
    each = each.select(*MESSAGE, "at", "level", F.size("lines").alias("n_lines"), F.explode(every).alias("u")).select("*", normal(F.col("u.text")).alias("norm"))
    return each.where("norm <> ''").select(*MESSAGE, "at", "level", "n_lines", "u.kind", F.xxhash64("norm").alias("hash"), F.length("norm").alias("n"))


def latest(asks: DataFrame, own: DataFrame) -> DataFrame:
    """asks(conv_id, hash, before, ...) with `source`: the latest turn below `before` in own(conv_id, hash, turn) with the hash; asks without one go.

    Both are swept once in the order of turns, by spans of turns; what a span gets from those before it is one value.
    """
    key = ["conv_id", "hash"]
    met = asks.withColumn("own", F.lit(None).cast("bigint"))
    met = met.unionByName(own.select(*key, F.col("turn").alias("before"), F.col("turn").alias("own")), allowMissingColumns=True)
    met = met.withColumn("span", F.floor(F.col("before") / SPAN))
    tops = met.groupBy(*key, "span").agg(F.max("own").alias("top"))
    carried = tops.select(*key, "span", F.max("top").over(Window.partitionBy(*key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    within = Window.partitionBy(*key, "span").orderBy("before").rangeBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("here", F.max("own").over(within)).where("own is null").join(carried, [*key, "span"])
    return met.withColumn("source", F.coalesce("here", "carried")).where("source is not null").drop("own", "span", "here", "carried")


def sources(met: DataFrame) -> DataFrame:
    """conv_id, turn, text_hash, level, source, chars: of each level the message that most characters come from, the latest of equal ones."""
    by = met.groupBy(*MESSAGE, "level", "at", "source", "kind").agg(F.sum("n").alias("n"))
    by = by.groupBy(*MESSAGE, "level", "at", "source").agg(F.max("n").alias("n")).groupBy(*MESSAGE, "level", "source").agg(F.sum("n").alias("chars"))
    return by.groupBy(*MESSAGE, "level").agg(F.max(F.struct("chars", "source")).alias("best")).select(*MESSAGE, "level", "best.source", "best.chars")


def threads(replies: DataFrame) -> DataFrame:
    """conv_id, turn, thread (the first message of its chain of replies), depth (steps to it) of replies(conv_id, turn, up), up < turn; steps double each round."""
    state = checkpointed(replies.groupBy("conv_id", "turn").agg(F.max("up").alias("top")).withColumn("depth", F.lit(1)))
    while True:
        on = state.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"))
        longer = state.join(on, ["conv_id", "top"], "left")
        longer = longer.select("conv_id", "turn", F.coalesce("next", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved"))
        state = checkpointed(longer)
        if not state.where("moved").head(1):
            return state.select("conv_id", "turn", F.col("top").alias("thread"), "depth")
        state = state.drop("moved")


def placed(rows: DataFrame) -> DataFrame:
    """rows with `position`: the place in the conversation, thread by thread, by turn; ranges of rows are counted apart and summed."""
    order = ["conv_id", "thread", "turn", "text_hash"]
    numbered = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("number", F.monotonically_increasing_id()))
    part = F.shiftright("number", 33)
    parts = numbered.groupBy("conv_id", part.alias("part")).agg(F.min("number").alias("low"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("conv_id").alias("c_"), F.col("part").alias("p_"), "low", F.coalesce(before, F.lit(0)).alias("before"))
    out = numbered.join(parts, numbered["conv_id"].eqNullSafe(parts["c_"]) & (part == parts["p_"]), "left")
    return out.withColumn("position", F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.col("before") + F.col("number") - F.col("low"))).drop("number", "c_", "p_", "low", "before")


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply_to, thread, depth, position, depth_quoted, n_quoted, n_linked, links, body of each row of messages(conv_id, turn, role, text).

    body: the message without quoted lines and the lines right before them that introduce them. reply_to: the earlier turn that most of the quoted
    characters of the lowest linked level come from, else null. links: (level, source, chars), by level; a level above the lowest is
    looked for before reply_to first. thread: the turn at the beginning of its chain of replies, depth: steps to it; position: place in
    the conversation, threads by their first turn, each by turn, so that every message comes after the one it answers. n_quoted: quoted
    lines; n_linked: those in passages of which a part is found in an earlier message; depth_quoted: the deepest level.
    Null and empty texts have an empty body; repeated rows are kept; null conversations and turns are kept without links and position;
    quoted lines without letters or digits link to nothing; other columns are dropped; an empty table gives no rows.
    """
    rows = parsed(messages.select("conv_id", "turn", "role", "text")).withColumn("text_hash", F.xxhash64("text"))
    keyed = rows.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    each = units(keyed.select(*MESSAGE, "passages"))
    quoted = each.where("level > 0").distinct()
    own = each.where("level = 0").select("conv_id", "turn", "hash").distinct()
    # only hashes that are quoted at all take part
    own = own.join(quoted.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    met = checkpointed(latest(quoted.withColumn("before", F.col("turn")), own))
    first = sources(met)
    reply = first.groupBy(*MESSAGE).agg(F.min_by("source", "level").alias("reply_to"), F.min("level").alias("lowest"))
    deeper = quoted.join(reply, MESSAGE).where("level > lowest").withColumn("before", F.col("reply_to"))
    again = sources(latest(deeper.drop("reply_to", "lowest"), own)).withColumnsRenamed({"source": "source_", "chars": "chars_"})
    both = first.join(again, [*MESSAGE, "level"], "left").select(*MESSAGE, "level", F.coalesce("source_", "source").alias("source"), F.coalesce("chars_", "chars").alias("chars"))
    links = both.groupBy(*MESSAGE).agg(F.array_sort(F.collect_list(F.struct("level", "source", "chars"))).alias("links"))
    lines = met.groupBy(*MESSAGE, "at").agg(F.first("n_lines").alias("m")).groupBy(*MESSAGE).agg(F.sum("m").alias("n_linked"))
    found = checkpointed(links.join(reply.drop("lowest"), MESSAGE).join(lines, MESSAGE))
    chains = threads(found.select("conv_id", "turn", F.col("reply_to").alias("up")))
    chains = chains.withColumnsRenamed({"conv_id": "c_", "turn": "t_"})
    found = found.withColumnsRenamed({"conv_id": "c_", "turn": "t_", "text_hash": "h_"})
    own_lines = F.filter("lines", lambda x: x["level"] == 0)
    plain = rows.select(
        "conv_id", "turn", "role", "text_hash", F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0)).alias("depth_quoted"),
        F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("bigint").alias("n_quoted"), F.trim(F.array_join(F.transform(own_lines, lambda x: x["body"]), "\n")).alias("body"),
    )
    out = plain.join(found, (plain["conv_id"] == found["c_"]) & (plain["turn"] == found["t_"]) & (plain["text_hash"] == found["h_"]), "left").drop("c_", "t_", "h_")
    out = out.join(chains, (out["conv_id"] == chains["c_"]) & (out["turn"] == chains["t_"]), "left").drop("c_", "t_").withColumn("thread", F.coalesce("thread", "turn"))
    none = F.array().cast("array<struct<level:int,source:bigint,chars:bigint>>")
    return placed(out).select(
        "conv_id", "turn", "role", "reply_to", "thread", F.coalesce("depth", F.lit(0)).alias("depth"), "position", "depth_quoted", "n_quoted",
        F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), F.coalesce("links", none).alias("links"), "body",
    )


def op2_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "conversations"))
