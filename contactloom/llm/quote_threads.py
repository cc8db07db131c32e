"""Reply-ordered conversations by quotation linking.

Lines that start with quote marks are parsed into levels.  The passages that a message says itself and those that it quotes at each level
are normalised and hashed: every line, and every paragraph as one passage however its lines are broken.  Quoted passages are joined to
the latest earlier message of the conversation that said them.  A message answers the latest message that it quotes at its lowest
level of those found, else the one before it.  So a conversation is a tree of replies; it is put together depth first, so that interleaved
threads come out one after another, and its messages are formatted without the quotes.

Everything is DataFrame functions.  No conversation is gathered into one row or task: what needs an order inside a conversation is
computed inside the partitions of a sort by range, and from one row for each of these.  Messages of which each answers the one before are one
segment; only segments are put in order, by a walk round the tree whose steps are doubled until they reach its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import carried, dealt
from ..plans.lineage import cut

#: Parts in which the messages that say a passage meet its quotes.
SALTS = 16
_MARKS = r"^(?:[\x20\t]*>)+"
#: The line by which mail programs introduce a quote.
_SAID = r"(?i)^[\x20\t]*.+\b(?:wrote|writes|said|schrieb|a écrit|escribió)[\x20\t]*:[\x20\t]*$"
_SPACE = r"[\x20\x09-\x0D\x01\x02]+"


def quote_level(line: Column) -> Column:
    """How many quote marks a line starts with."""
    return F.regexp_count(F.regexp_extract(line, f"({_MARKS})", 1), F.lit(">"))


def normalised(line: Column) -> Column:
    """A line without quote marks, in lower case, its white space single."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, _MARKS, "")), _SPACE, " "))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _introduces(lines: Column, line: Column, i: Column) -> Column:
    """Whether a line introduces the quote that follows it."""
    return line.rlike(_SAID) & F.coalesce(F.get(lines, i + 1).rlike(_MARKS), F.lit(False))


def own_text(text: Column) -> Column:
    """A message without its quotes and the lines that introduce them."""
    lines = _lines(text)
    own = F.filter(lines, lambda line, i: ~line.rlike(_MARKS) & ~_introduces(lines, line, i))
    return F.regexp_replace(F.array_join(own, "\n"), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def passages(messages: DataFrame, text: str) -> DataFrame:
    """`messages` with (level, hash) instead of `text`, a row for each distinct passage; level 0 is what the message says itself.

    A passage is a line that is not blank, or the lines of one level that follow each other without a blank one; the line that
    introduces a quote is none.
    """
    others = [c for c in messages.columns if c != text]
    lines = messages.select(*others, _lines(F.col(text)).alias("_l"))
    levelled = lines.select(
        *others,
        F.transform("_l", lambda line, i: F.struct(quote_level(line).alias("level"), F.when(_introduces(F.col("_l"), line, i), "").otherwise(normalised(line)).alias("said"))).alias("_l"),
    )
    # A paragraph starts where the level changes or after a blank line; one string holds all of them, parted by marks.
    before = lambda i: F.get(F.col("_l"), i - 1)
    starts = lambda x, i: (i == 0) | (before(i)["level"] != x["level"]) | (before(i)["said"] == "")
    marked = lambda x, i: F.when(starts(x, i), F.concat(F.lit("\x01"), x["level"].cast("string"), F.lit("\x02"), x["said"])).otherwise(x["said"])
    whole = F.array_join(F.transform(F.col("_l"), lambda x, i: F.when(x["said"] != "", marked(x, i)).otherwise("\x01")), " ")
    parts = F.filter(F.transform(F.split(whole, "\x01"), lambda p: F.trim(p)), lambda p: p != "")
    paragraphs = F.transform(parts, lambda p: F.struct(F.substring_index(p, "\x02", 1).cast("int").alias("level"), F.substring_index(p, "\x02", -1).alias("said")))
    both = F.array_union(F.filter("_l", lambda x: x["said"] != ""), paragraphs)
    hashed = levelled.select(*others, F.explode(F.transform(both, lambda x: F.struct(x["level"].alias("level"), F.sha2(x["said"], 256).alias("hash")))).alias("_p"))
    return hashed.select(*others, F.col("_p.level").alias("level"), F.col("_p.hash").alias("hash")).distinct()


def quoted_sources(spoken: DataFrame) -> DataFrame:
    """(c, t, source): for each message that quotes earlier ones the one that it answers; `spoken` is (c, t, level, hash)."""
    quotes = spoken.where("level > 0").groupBy("c", "t", "hash").agg(F.min("level").alias("level"))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("qs")
    wanted = quotes.select(F.col("c").alias("qc"), F.col("hash").alias("qh")).distinct().select("qc", "qh", salts)
    said = spoken.where("level = 0").select("c", "t", "hash", F.pmod(F.xxhash64("t"), F.lit(SALTS)).alias("salt"))
    on = F.col("c").eqNullSafe(F.col("qc")) & (F.col("hash") == F.col("qh")) & (F.col("salt") == F.col("qs"))
    said = said.join(wanted, on, "left_semi").select("c", "t", "hash", F.col("t").alias("said"), F.lit(None).cast("int").alias("level"))
    rows = said.unionByName(quotes.select("c", "t", "hash", F.lit(None).cast("long").alias("said"), "level"))
    rows = dealt(rows.groupBy("c", "hash", "t").agg(F.max("said").alias("said"), F.min("level").alias("level")), ["c", "hash"], "t")
    earlier = Window.partitionBy("block", "c", "hash").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    rows = carried(rows, ["c", "hash"], past=(F.max("said"), F.max("past"))).withColumn("source", F.greatest("past", F.max("said").over(earlier)))
    found = rows.where("level is not null and source is not null")
    # The lowest level first, then the latest message.
    return found.groupBy("c", "t").agg(F.max(F.struct(-F.col("level"), F.col("source").alias("source")))["source"].alias("source"))


def _doubled(steps: DataFrame, key: list[str]) -> DataFrame:
    """(key, total, last): from rows (key, next, length), next a struct of the key's columns, null at an end, the lengths of all steps from
    each row to the end, its own included, and the key of the end.  After n rounds a row has looked 2^n steps ahead."""
    me = F.struct(*key)
    state = cut(steps.select(*key, F.col("next"), F.col("length").cast("long").alias("total"), F.coalesce("next", me).alias("last")))
    while not state.where("next is not null").isEmpty():
        there = state.select(me.alias("at"), F.col("next").alias("onward"), F.col("total").alias("more"), F.col("last").alias("end"))
        moving = state.where("next is not null").join(there, F.col("next") == F.col("at"))
        moved = moving.select(*key, F.col("onward").alias("next"), (F.col("total") + F.col("more")).alias("total"), F.col("end").alias("last"))
        state = cut(state.where("next is null").unionByName(moved))
    return state.select(*key, "total", "last")


def ordered_segments(segments: DataFrame) -> DataFrame:
    """(c, s, position, branch, place, depth) of segments (c, s, length, parent, weak): s names a segment in its conversation, parent the segment
    whose last message its first one answers, null for a root.

    Of the segments that answer one message those that are not weak come first, then the earlier ones.  position counts all messages
    that come before in a walk depth first; branch is the segment where its main line starts, which goes on with the first answer to
    each last message; place counts messages from there and depth from the root.
    """
    order = dealt(segments, ["c", "parent"], "weak", "s")
    rows = carried(order, ["c", "parent"], before=(F.max(F.struct("weak", "s")), F.max("before")))
    own = Window.partitionBy("block", "c", "parent").orderBy("weak", "s")
    rows = cut(rows.withColumn("left", F.coalesce(F.lag("s").over(own), F.col("before.s"))).select("c", "s", "length", "parent", "left"))
    onward = rows.where("left is not null").select("c", F.col("left").alias("s"), F.col("s").alias("right"))
    inward = rows.where("left is null and parent is not null").select("c", F.col("parent").alias("s"), F.col("s").alias("first"))
    near = rows.join(onward, ["c", "s"], "left").join(inward, ["c", "s"], "left")
    # Each segment is gone into and out of; into the first answer, out to the next one beside it or out of the one above.
    to = lambda s, out: F.when(s.isNotNull(), F.struct(F.col("c").alias("c"), s.alias("s"), F.lit(out).alias("out")))
    into = near.select("c", "s", F.lit(False).alias("out"), F.coalesce(to(F.col("first"), False), to(F.col("s"), True)).alias("next"), "length")
    out = near.select("c", "s", F.lit(True).alias("out"), F.coalesce(to(F.col("right"), False), to(F.col("parent"), True)).alias("next"), F.lit(0).cast("long").alias("length"))
    ahead = _doubled(into.unionByName(out), ["c", "s", "out"]).where("not out").select("c", "s", F.col("total").alias("ahead"))
    whole = rows.groupBy("c").agg(F.sum("length").alias("whole"))
    up = lambda s: F.when(s.isNotNull(), F.struct(F.col("c").alias("c"), s.alias("s")))
    lengths = rows.select("c", F.col("s").alias("parent"), F.col("length").alias("above"))
    linked = rows.join(lengths, ["c", "parent"], "left").select("c", "s", "parent", "left", F.coalesce("above", F.lit(0)).alias("length"))
    main = F.when(F.col("left").isNull(), F.col("parent"))
    line = _doubled(linked.select("c", "s", up(main).alias("next"), F.when(main.isNull(), 0).otherwise(F.col("length")).alias("length")), ["c", "s"])
    deep = _doubled(linked.select("c", "s", up(F.col("parent")).alias("next"), "length"), ["c", "s"])
    found = ahead.join(line.select("c", "s", F.col("last.s").alias("branch"), F.col("total").alias("place")), ["c", "s"]).join(deep.select("c", "s", F.col("total").alias("depth")), ["c", "s"])
    return found.join(whole, "c").select("c", "s", (F.col("whole") - F.col("ahead")).alias("position"), "branch", "place", "depth")


def link_replies(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(c, t, parent, quoted, branch, place, depth, position), a row for each distinct turn of each conversation.

    parent is the turn it answers: of the messages that last said, before it, a passage which this one quotes, the latest of those
    quoted at the lowest level; without any, the turn before; null for the first turn.  quoted is true where a quote made
    the link.  position is the turn's place in the tree of replies, from 0, depth first: a message, then each of its answers with all
    that follows from it, those that quote it before those that only come after it, and earlier ones first.  A message's first
    answer in this order goes on with its branch, each other one starts a branch, named by its turn; place counts a branch's turns
    from 0, depth the replies from the first turn.  Messages that share a turn count as one.  Null turns come before all
    others, quote nothing, are quoted by none and have no place in the tree; a null conversation is one like any other.
    """
    m = messages.select(F.col(f"`{conversation}`").alias("c"), F.col(f"`{turn}`").cast("long").alias("t"), F.col(f"`{text}`").alias("x"))
    links = quoted_sources(cut(passages(m.where("t is not null"), "x")))
    links = links.select(F.col("c").alias("lc"), F.col("t").alias("lt"), "source")
    turns = m.select("c", "t").distinct().join(links, F.col("c").eqNullSafe(F.col("lc")) & (F.col("t") == F.col("lt")), "left").select("c", "t", "source")
    rows = dealt(turns, ["c"], "t")
    inside = Window.partitionBy("block", "c").orderBy("t")
    rows = carried(rows, ["c"], last=(F.max("t"), F.max("last")), base=(F.count(F.lit(1)), F.sum("base")))
    rows = rows.withColumn("previous", F.coalesce(F.lag("t").over(inside), "last")).withColumn("index", F.coalesce("base", F.lit(0)) + F.row_number().over(inside) - 1)
    rows = cut(rows.withColumn("parent", F.coalesce("source", "previous")).drop("last", "base"))
    # A segment ends where a message that is not the next one answers; the next one then starts a segment as well.
    ends = rows.where("parent <> previous").select(F.col("c").alias("ec"), F.col("parent").alias("et")).distinct().withColumn("answered", F.lit(True))
    rows = rows.join(ends, F.col("c").eqNullSafe(F.col("ec")) & (F.col("previous") == F.col("et")), "left").drop("ec", "et")
    starts = F.col("t").isNotNull() & (F.col("previous").isNull() | (F.col("parent") != F.col("previous")) | F.col("answered").isNotNull())
    rows = rows.withColumn("start", F.when(starts, F.struct(F.col("t").alias("t"), F.col("index").alias("i"))))
    rows = carried(rows, ["c"], began=(F.max("start"), F.max("began")))
    rows = cut(rows.withColumn("start", F.coalesce(F.max("start").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "began")))
    # Conversations by a number that is not null, so that segments are joined by plain keys.
    number = F.struct(F.col("c").isNull().alias("none"), F.coalesce("c", F.lit(0).cast(dict(rows.dtypes)["c"])).alias("id"))
    known = rows.where("t is not null").select(number.alias("c"), F.col("start.t").alias("s"), "t", "parent", F.col("source").isNotNull().alias("quoted"))
    segments = known.groupBy("c", "s").agg(F.count(F.lit(1)).alias("length"), F.max("t").alias("e"), F.max(F.when(F.col("t") == F.col("s"), F.col("parent"))).alias("answers"), F.max(F.when(F.col("t") == F.col("s"), ~F.col("quoted"))).alias("weak"))
    last = segments.select("c", F.col("e").alias("answers"), F.col("s").alias("parent"))
    placed = ordered_segments(segments.join(last, ["c", "answers"], "left").select("c", "s", "length", "parent", "weak"))
    placed = placed.select(F.col("c").alias("sc"), F.col("s").alias("ss"), "position", "branch", "place", "depth")
    joined = rows.withColumn("n", number).join(placed, (F.col("n") == F.col("sc")) & (F.col("start.t") == F.col("ss")), "left")
    on = lambda name: (F.col(name) + F.col("index") - F.col("start.i")).cast("long").alias(name)
    return joined.select("c", "t", "parent", F.col("source").isNotNull().alias("quoted"), "branch", on("place"), on("depth"), on("position"))


def reply_order(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, turn, role, parent_turn, by_quote, branch, place, depth, position, body, formatted), a row for each message.

    Ordered by position, a conversation is its tree of replies depth first, as link_replies() says: each message comes after the one that
    it answers, and a thread is not torn by another one.  body is the text without quotes; formatted is it between role marks.  A null
    text is empty, a null role `user`.  Messages that share a turn share its place; those of a null turn have none.  An empty
    table gives an empty one; other columns are left out.
    """
    placed = link_replies(messages, conversation, turn, text)
    m = messages.select(
        F.col(f"`{conversation}`").alias("mc"), F.col(f"`{turn}`").cast("long").alias("mt"), F.coalesce(F.col(f"`{role}`"), F.lit("user")).alias("role"), own_text(F.col(f"`{text}`")).alias("body")
    )
    joined = m.join(placed, F.col("mc").eqNullSafe(F.col("c")) & F.col("mt").eqNullSafe(F.col("t")))
    formatted = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("body"), F.lit("\n<|end|>\n"))
    return joined.select(
        F.col("mc").alias(conversation), F.col("mt").alias(turn), "role", F.col("parent").alias("parent_turn"), F.col("quoted").alias("by_quote"),
        "branch", "place", "depth", "position", "body", formatted.alias("formatted"),
    )


def conversations(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """reply_order()'s messages, sorted: conversations by range, and inside each by position, so that writing them gives reply-ordered files."""
    placed = reply_order(messages, conversation, turn, role, text)
    return placed.repartitionByRange(conversation, "position").sortWithinPartitions(conversation, "position")
