"""Chat formatting as prefix trees: conversations that begin alike share their turns, written once depth-first.

Each turn is ``<s>role<|>text</s>``; control strings inside roles and texts get a backslash after their first
character, which reading back removes. All conversations are sorted by the digests of their prefixes, so a node of
the forest belongs to the first conversation that passes it, and (that conversation, depth) is depth-first order.
The written text is one line of code points; a node has its place there, position ids that go on from its parent's,
and the places of its ancestors, which are what it may attend to besides itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replaylens.session import written

# Strings that steer common chat templates, by their first character and the rest.
CONTROL = r"([<\[])%s(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|\|)"
TURN = r"(?s)<s>(.*?)<\|>(.*?)</s>"
LEARNT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL % "", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL % r"\\", "$1$2$3")


def _prefix_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for segments in batch.segments:
            so_far, nodes = hashlib.sha256(), []
            for s in segments:
                raw = s.encode("utf-8", "replace")
                so_far.update(len(raw).to_bytes(8, "little") + raw)
                nodes.append(so_far.hexdigest()[:32])
            out.append(nodes)
        yield batch.assign(nodes=out)


def conversation_paths(conversations: DataFrame) -> DataFrame:
    """conv (a number in the order of the prefixes), conv_id, segments and nodes of every conversation, written once.

    Turns are ordered by turn, then role and text; null roles and texts count as empty, and repeated rows are turns
    of their own. A conversation is one value, like a text; rows with a null conv_id are one conversation.
    """
    turns = conversations.select("conv_id", F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    segment = lambda t: F.concat(F.lit("<s>"), escape(t.role), F.lit("<|>"), escape(t.text), F.lit("</s>"))
    laid = turns.select("conv_id", F.transform("turns", segment).alias("segments"))
    kind = laid.schema["conv_id"].dataType.simpleString()
    laid = laid.mapInPandas(_prefix_digests, f"conv_id {kind}, segments array<string>, nodes array<string>")
    return written(laid.orderBy("nodes", "conv_id").withColumn("conv", F.monotonically_increasing_id()), "paths")


def _merged(spans: Column) -> Column:
    """Neighbouring spans that touch as one."""
    def add(found: Column, x: Column) -> Column:
        last = F.element_at(found, -1)
        longer = F.concat(F.slice(found, 1, F.size(found) - 1),
                          F.array(F.struct(last.start.alias("start"), x.end.alias("end"))))
        return F.when((F.size(found) > 0) & (F.try_element_at(found, F.lit(-1)).end == x.start), longer).otherwise(
            F.concat(found, F.array(x)))
    return F.aggregate(spans, F.lit([]).cast("array<struct<start: bigint, end: bigint>>"), add)


def prefix_trees(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trees, members) of all conversations (conv_id, turn, role, text; other columns are ignored).

    trees: a row for each distinct beginning of a conversation: node, start and end (places in the written text),
    position (position id of its first code point), depth, segment, loss_from and loss_to (where in the segment the
    text to learn is; null if none), attends (merged spans of its ancestors). Sorted by start, the segments are the
    written text. members: conv_id and spans (one for each turn, start and end), a row for each conversation.
    """
    paths = conversation_paths(conversations)
    turns = paths.select("conv", F.posexplode(F.arrays_zip("nodes", "segments")).alias("depth", "t"))
    turns = turns.select("conv", "depth", F.col("t.nodes").alias("node"), F.col("t.segments").alias("segment"))
    first = turns.groupBy("node").agg(F.min(F.struct("conv", "depth", "segment")).alias("f")).select("node", "f.*")
    # Running totals within the ranges of conversations that the sort made, and over the ranges.
    first = first.withColumns({"block": F.shiftright("conv", 33), "n": F.length("segment").cast("long")})
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = first.groupBy("block").agg(F.sum("n").alias("n")).select(  # a row for each of the sort's partitions
        "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("block").orderBy("conv", "depth")
    places = first.withColumn("upto", F.sum("n").over(inside)).join(F.broadcast(blocks), "block")
    head = F.locate("<|>", "segment") + 2
    learnt = F.startswith("segment", F.lit(f"<s>{LEARNT}<|>"))
    nodes = written(places.select(
        "node", "conv", "depth", (F.col("earlier") + F.col("upto") - F.col("n")).alias("start"),
        (F.col("earlier") + F.col("upto")).alias("end"), "segment", F.when(learnt, head.cast("long")).alias("loss_from"),
        F.when(learnt, F.col("n") - 4).alias("loss_to")), "nodes")
    way = turns.select("conv", "depth", "node").join(nodes.select("node", "start", "end"), "node")
    spans = way.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("depth", "start", "end"))).alias("s"))
    spans = written(spans.select("conv", F.transform("s", lambda x: F.struct(
        x.start.alias("start"), x.end.alias("end"))).alias("spans")), "spans")
    above = F.slice("spans", F.lit(1), F.col("depth"))
    length = F.aggregate(above, F.lit(0).cast("long"), lambda n, x: n + x.end - x.start)
    trees = nodes.join(spans, "conv").select(
        "node", "start", "end", length.alias("position"), "depth", "segment", "loss_from", "loss_to",
        _merged(above).alias("attends"))
    members = paths.select("conv", "conv_id").join(spans, "conv").select("conv_id", "spans")
    return trees, members


def read_back(trees: DataFrame, members: DataFrame) -> DataFrame:
    """conv_id, formatted (its segments along its spans), roles, texts and learnt (arrays, unescaped) from the output."""
    parts = members.select("conv_id", F.posexplode("spans").alias("at", "span")).select("conv_id", "at", "span.start")
    learnt = F.substring(F.col("segment"), F.col("loss_from") + 1, F.col("loss_to") - F.col("loss_from"))
    parts = parts.join(trees.select("start", "segment", unescape(learnt).alias("learnt")), "start")
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "segment", "learnt"))).alias("p"))
    whole = whole.select("conv_id", F.array_join(F.col("p.segment"), "").alias("formatted"),
                         F.filter("p.learnt", lambda x: x.isNotNull()).alias("learnt"))
    found = {name: F.transform(F.regexp_extract_all("formatted", F.lit(TURN), F.lit(i)), unescape)
             for i, name in ((1, "roles"), (2, "texts"))}
    return whole.select("conv_id", "formatted", found["roles"].alias("roles"), found["texts"].alias("texts"), "learnt")


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all taken from what was written."""
    back = read_back(*prefix_trees(conversations))
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    loss = F.array_join("learnt", "")
    return back.select("conv_id", F.size("texts").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
