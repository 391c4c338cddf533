"""Quotation linking: conversations in reply order, without the quotes they repeat.

Lines that start with ``>`` marks are quoted, as deep as they have marks. Consecutive lines of
one depth are a passage. Passages and their lines are hashed in a normal form (lower case,
single blanks) and joined to the latest earlier message of the conversation that holds the
same passage or line as its own; a passage goes back to the message that most of it points
to. A message replies to the message that its shallowest linked passage comes from; one that
quotes nothing known replies to the turn before it.

DataFrame functions only. Passages are cut inside the row; only hashes are joined, and only
those of the originals that some message of the conversation quotes. Earlier-message lookups
are running maxima that are split over shards of the turn, so one conversation may hold any
share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneloom.operators.ranks import prefix_aggregates
from tuneloom.session import stage_table

_MARKS = r"^([ \t]*>)+"
_PASSAGE, _DEPTH, _LINE = "\u0001", "\u0002", "\u0003"


def _depth(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), "[^>]", ""))


def _body(line: Column) -> Column:
    return F.regexp_replace(line, _MARKS + r"[ \t]?", "")


def normal_form(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n\x0B\f]+", " "))


def passages(text: Column) -> Column:
    """array<struct<depth, text>> of a message: runs of lines of one depth, in order.

    A line "… wrote:" right before a quote introduces it and belongs to no passage.
    """
    clean = F.translate(F.coalesce(text, F.lit("")), f"{_PASSAGE}{_DEPTH}{_LINE}\r", "")
    lines = F.transform(F.split(clean, "\n"), lambda x: F.struct(
        _depth(x).alias("depth"), _body(x).alias("body")))
    # neighbours come from a shifted copy: looking them up by place would cut all lines again
    after = F.slice(F.transform(lines, lambda x: x["depth"]), 2, 1 << 30)
    lines = F.filter(F.zip_with(lines, after, lambda x, n: F.struct(
        x["depth"].alias("depth"), x["body"].alias("body"),
        ((x["depth"] == 0) & (F.coalesce(n, F.lit(0)) > 0) & x["body"].rlike(r"wrote:\s*$"))
        .alias("leads"))), lambda x: ~x["leads"])
    before = F.concat(F.array(F.lit(-1)), F.transform(lines, lambda x: x["depth"]))
    marked = F.zip_with(lines, before, lambda x, b: F.concat(
        F.when(x["depth"] == b, F.lit(_LINE)).otherwise(
            F.concat(F.lit(_PASSAGE), x["depth"].cast("string"), F.lit(_DEPTH))), x["body"]))
    marked = F.filter(marked, lambda x: x.isNotNull())
    parts = F.slice(F.split(F.array_join(marked, ""), _PASSAGE), 2, 1 << 30)
    return F.transform(parts, lambda p: F.struct(
        F.substring_index(p, _DEPTH, 1).cast("int").alias("depth"),
        F.translate(F.substring_index(p, _DEPTH, -1), _LINE, "\n").alias("text")))


def _pieces(passage: Column) -> Column:
    """Hashes of a passage as a whole and of its lines, in normal form; blank ones left out."""
    every = F.array_append(F.split(passage, "\n"), passage)
    normal = F.filter(F.transform(every, normal_form), lambda x: x != "")
    return F.array_distinct(F.transform(normal, lambda x: F.md5(x)))


def link_quotes(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, own_text, position, reply_to, quotes, linked`` of every message.

    ``own_text`` is the message without quoted lines and the lines that introduce them, blank
    ends trimmed. ``position`` counts the messages of earlier turns; messages of one turn share
    it, so a reply never stands before what it answers. ``reply_to`` is a turn, null for the
    first. ``quotes`` counts quoted passages with any text, ``linked`` those whose original is
    known. Null and empty texts quote nothing; messages with a null conversation or turn have
    null position and reply, and link to nothing. Repeated rows stay rows.
    """
    rows = messages.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role",
                           passages(F.col("text")).alias("parts"))
    rows = stage_table(rows, "passages")
    own = F.filter("parts", lambda p: p["depth"] == 0)
    own_text = F.trim(F.array_join(F.transform(own, lambda p: p["text"]), "\n"), F.lit(" \n\t"))
    quoted = F.filter("parts", lambda p: (p["depth"] > 0) & (normal_form(p["text"]) != ""))

    placed = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quotes = (placed.select("conv_id", "turn", F.explode(quoted).alias("q"))
              .select("conv_id", "turn", F.col("q.depth").alias("depth"),
                      F.md5(normal_form(F.col("q.text"))).alias("passage"),
                      F.explode(_pieces(F.col("q.text"))).alias("piece")).distinct())
    quotes = stage_table(quotes, "quotes")
    wanted = stage_table(quotes.select("conv_id", "piece").distinct(), "quoted-pieces")
    whole = F.array(own_text)
    originals = (placed.select("conv_id", "turn", F.explode(F.concat(
        F.transform(own, lambda p: p["text"]), whole)).alias("text"))
        .select("conv_id", "turn", F.explode(_pieces(F.col("text"))).alias("piece")))
    originals = originals.join(wanted, ["conv_id", "piece"], "left_semi").distinct()
    # a message's quotes come before its own words, so it never quotes itself
    events = (quotes.select("conv_id", "piece", (F.col("turn") * 2).alias("order"),
                            F.lit(None).cast("bigint").alias("held")).distinct()
              .unionByName(originals.select("conv_id", "piece", (F.col("turn") * 2 + 1)
                                            .alias("order"), F.col("turn").alias("held"))))
    events = stage_table(events, "quote-events")
    known = prefix_aggregates(events, ["conv_id", "piece"], "order",
                              {"source": ("max", F.col("held"))}, inclusive=False)
    known = stage_table(known.where("held IS NULL AND source IS NOT NULL").select(
        "conv_id", "piece", F.shiftright("order", 1).alias("turn"), "source"), "sources")
    votes = (quotes.join(known, ["conv_id", "turn", "piece"])
             .groupBy("conv_id", "turn", "depth", "passage", "source")
             .agg(F.count("*").alias("votes")))
    linked = (votes.groupBy("conv_id", "turn", "depth", "passage")
              .agg(F.max(F.struct("votes", "source")).alias("best")))
    replies = (linked.groupBy("conv_id", "turn").agg(
        F.count("*").alias("linked"),
        F.min(F.struct("depth", (-F.col("best.votes")).alias("v"),
                       (-F.col("best.source")).alias("s"))).alias("at"))
        .select("conv_id", "turn", "linked", (-F.col("at.s")).alias("quoted_turn")))
    replies = stage_table(replies, "replies")

    turns = stage_table(placed.groupBy("conv_id", "turn").agg(F.count("*").alias("n")), "turns")
    turns = prefix_aggregates(turns, ["conv_id"], "turn",
                              {"position": ("sum", F.col("n")), "previous": ("max", F.col("turn"))},
                              inclusive=False)
    turns = stage_table(turns.join(replies, ["conv_id", "turn"], "left").select(
        F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"),
        F.coalesce("position", F.lit(0)).cast("bigint").alias("position"),
        F.coalesce("quoted_turn", "previous").alias("reply_to"),
        F.coalesce("linked", F.lit(0)).alias("linked")), "reply-turns")
    many = F.size(F.array_distinct(F.transform(quoted, lambda p: F.struct(
        p["depth"], normal_form(p["text"])))))
    out = rows.select("conv_id", "turn", "role", own_text.alias("own_text"),
                      many.cast("bigint").alias("quotes"))
    return (out.join(turns, (F.col("conv_id") == F.col("_conv")) & (F.col("turn") == F.col("_turn")),
                     "left")
            .select("conv_id", "turn", "role", "own_text", "position", "reply_to", "quotes",
                    F.coalesce("linked", F.lit(0)).cast("bigint").alias("linked")))
