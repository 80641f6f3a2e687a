"""Quotation linking for chats and mail, with DataFrame functions only.

Each line has a quote level, the number of `>` marks at its start. Quoted lines are normalised (lower case, white space as
one space) and hashed, and joined to the lines of level 0 that earlier messages of the conversation say: the source of a
quoted line is the latest earlier message with that line. A message replies to the message that most of its
level-1 lines come from (on a tie, the latest); where none of these is known, as their source is lost or they were changed, the next
level counts, whose source stands above it in the same thread. Its thread is the message at the root of its chain of replies. Conversations come back without
quotes and without the lines that announce them, sorted by (conv_id, thread, place): place is where a message stands in its thread if
each one is followed by its replies, with all that answers them, in the order of their turns.

The source is found by windows over (conversation, line, block of SPAN turns) and over the blocks' last sources, never by pairing what is
said with what is quoted, so a line said and quoted thousands of times costs a row for each. Roots are found by
pointer jumping, in rounds that grow with the logarithm of the longest chain, and so are places: the walk around a thread's tree is
a list, on which each message counts the messages behind it. Replies to one message are numbered by ranges, so any number may answer it.

Defined cases: a null text is empty; rows with a null conv_id or turn link with nothing and are threads of their own;
rows of equal conv_id and turn are one message to link to, and each comes back with its own text and quotes counted
together. An empty table gives none. Texts of any length are split into their lines in one expression. Extra columns pass through in `row`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siltstone.llm.shared import Stored, stored
from siltstone.operators.numbering import numbered

SPAN = 1024
_MARKS = r"^(?:[ \t]{0,3}+>)++"
#: Ends of lines that announce a quotation.
ANNOUNCE = r"(?i)(?:wrote|writes|said|schrieb|escribió|a écrit) ?:\s*$"


def level(line: Column) -> Column:
    """Number of quote marks at the start of a line."""
    marks = F.regexp_extract(line, _MARKS, 0)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def said(line: Column) -> Column:
    """The line without its marks, normalised."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, _MARKS, "")), r"\s+", " "))


def without_quotes(text: Column) -> Column:
    """The lines of level 0 that announce no quotation, blank ends cut off."""
    parsed = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("x"), level(x).alias("k")))
    kept = lambda a: F.filter(a, lambda e, i: (e["k"] == 0) & ~(e["x"].rlike(ANNOUNCE) & (F.coalesce(F.get(a, i + 1)["k"], F.lit(0)) > 0)))
    own = F.element_at(F.transform(F.array(parsed), lambda a: F.array_join(F.transform(kept(a), lambda e: e["x"]), "\n")), 1)
    return F.when(text.contains(">"), F.trim(F.regexp_replace(own, r"^\n+|\n+$", ""))).otherwise(text)


def sources(messages: DataFrame) -> DataFrame:
    """conv_id, turn, k (level), source (turn or null) for each quoted line of messages (conv_id, turn, text)."""
    quoting = messages.where(F.col("text").contains(">")).select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("x")).select("conv_id", "turn", level(F.col("x")).alias("k"), said(F.col("x")).alias("s"))
    quoted = stored(quoting.where("k > 0 and s <> ''").select("conv_id", "turn", "k", F.xxhash64("s").alias("h")))
    wanted = quoted.select("conv_id", "h").distinct()
    lines = messages.select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("x")).where(level(F.col("x")) == 0)
    spoken = lines.select("conv_id", "turn", F.xxhash64(said(F.col("x"))).alias("h")).join(wanted, ["conv_id", "h"], "left_semi").distinct()
    both = quoted.select("conv_id", "h", "turn", "k").unionByName(spoken.withColumn("k", F.lit(0)).select("conv_id", "h", "turn", "k"))
    both = stored(both.withColumn("block", F.floor(F.col("turn") / SPAN)))
    key = ["conv_id", "h"]
    blocks = both.where("k = 0").groupBy(*key, "block").agg(F.max("turn").alias("last"))
    asked = both.groupBy(*key, "block").agg(F.lit(1).alias("one")).join(blocks, [*key, "block"], "left")
    carried = asked.select(*key, "block", F.last("last", ignorenulls=True).over(W.partitionBy(*key).orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    # Within a turn, what it quotes comes before what it says: a message is not its own source.
    inner = F.last(F.when(F.col("k") == 0, F.col("turn")), ignorenulls=True).over(W.partitionBy(*key, "block").orderBy("turn", F.desc("k")).rowsBetween(W.unboundedPreceding, -1))
    near = both.withColumn("near", F.when(inner < F.col("turn"), inner)).where("k > 0")
    return near.join(carried, [*key, "block"]).select("conv_id", "turn", "k", F.coalesce("near", "carried").alias("source"))


def roots(replies: DataFrame) -> DataFrame:
    """conv_id, turn, thread for each message of replies (conv_id, turn, reply_to)."""
    now = Stored(replies.select("conv_id", "turn", F.col("reply_to").alias("up")))
    while True:
        above = now.df.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("top"))
        nxt = Stored(now.df.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
        moved = nxt.df.where("moved").limit(1).count()
        now.drop()
        now = nxt
        if not moved:
            return now.df.select("conv_id", "turn", F.col("up").alias("thread"))


def places(replies: DataFrame) -> DataFrame:
    """conv_id, turn, behind for each message of replies (conv_id, turn, reply_to) and what they reply to: the messages of the thread from it on, itself included."""
    key = ["conv_id", "turn"]
    answers = replies.where("reply_to is not null").select("conv_id", F.col("reply_to").alias("up"), "turn")
    kids = stored(numbered(stored(answers), ["turn"], ["conv_id", "up"], name="i", keep=stored))
    nodes = stored(kids.select(*key).unionByName(kids.select("conv_id", F.col("up").alias("turn"))).distinct())
    first = kids.where("i = 0").select("conv_id", F.col("up").alias("turn"), F.col("turn").alias("child"))
    beside = kids.select("conv_id", "up", (F.col("i") - 1).alias("i"), F.col("turn").alias("sibling"))
    above = kids.join(beside, ["conv_id", "up", "i"], "left").select(*key, "up", "sibling")
    # The walk comes to a message (out = 0) and leaves it when all that answers it is done (out = 1).
    come = nodes.join(first, key, "left").select(*key, F.lit(0).alias("out"), F.coalesce("child", "turn").alias("to"), F.col("child").isNull().cast("int").alias("to_out"), F.lit(1).cast("long").alias("behind"))
    leave = nodes.join(above, key, "left").select(*key, F.lit(1).alias("out"), F.coalesce("sibling", "up").alias("to"), F.when(F.col("sibling").isNotNull(), 0).when(F.col("up").isNotNull(), 1).alias("to_out"), F.lit(0).cast("long").alias("behind"))
    now = Stored(come.unionByName(leave))
    while True:
        ahead = now.df.select("conv_id", F.col("turn").alias("to"), F.col("out").alias("to_out"), F.col("to").alias("next"), F.col("to_out").alias("next_out"), F.col("behind").alias("more"))
        step = now.df.join(ahead, ["conv_id", "to", "to_out"], "left")
        nxt = Stored(step.select(*key, "out", F.col("next").alias("to"), F.col("next_out").alias("to_out"), (F.col("behind") + F.coalesce("more", F.lit(0))).alias("behind")))
        on = nxt.df.where("to is not null").limit(1).count()
        now.drop()
        now = nxt
        if not on:
            return now.df.where("out = 0").select(*key, "behind")


def link_quotes(messages: DataFrame) -> DataFrame:
    """row (all columns), conv_id, turn, n_quoted, n_linked, reply_to, thread, place and clean for each row of messages."""
    base = messages.select(F.struct("*").alias("row")).select("row", F.col("row.conv_id").cast("long").alias("conv_id"), F.col("row.turn").cast("long").alias("turn"), F.coalesce(F.col("row.text").cast("string"), F.lit("")).alias("text"))
    found = stored(sources(base.where("conv_id is not null and turn is not null").select("conv_id", "turn", "text")))
    votes = found.where("source is not null").groupBy("conv_id", "turn", "k", "source").agg(F.count(F.lit(1)).alias("n"))
    reply = stored(votes.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("k")).alias("outer"), "n", "source")).alias("best")).select("conv_id", "turn", F.col("best.source").alias("reply_to")))
    counts = found.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_quoted"), F.count("source").alias("n_linked"))
    links = stored(counts.join(reply, ["conv_id", "turn"], "left").join(roots(reply), ["conv_id", "turn"], "left"))
    zero = F.lit(0).cast("long")
    behind = places(reply)
    whole = behind.select("conv_id", F.col("turn").alias("thread"), F.col("behind").alias("whole"))
    joined = base.join(links, ["conv_id", "turn"], "left").withColumn("thread", F.coalesce("thread", "turn"))
    joined = joined.join(behind, ["conv_id", "turn"], "left").join(whole, ["conv_id", "thread"], "left")
    place = F.coalesce(F.col("whole") - F.col("behind"), zero)
    return joined.select("row", "conv_id", "turn", F.coalesce("n_quoted", zero).alias("n_quoted"), F.coalesce("n_linked", zero).alias("n_linked"), "reply_to", "thread", place.alias("place"), without_quotes(F.col("text")).alias("clean"))


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, thread, place, turn, role, reply_to, n_quoted, n_linked and text (without quotes); its order is (conv_id, thread, place, turn)."""
    m = link_quotes(messages)
    return m.select("conv_id", "thread", "place", "turn", F.col("row.role").cast("string").alias("role"), "reply_to", "n_quoted", "n_linked", F.col("clean").alias("text")).orderBy("conv_id", "thread", "place", "turn")
