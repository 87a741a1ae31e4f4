"""Suffix-array dedup: removes every byte that lies in a 100-byte string which also starts earlier in the corpus.

1. Winnowing picks anchors: in any 100 bytes the 32-byte window with the least hash. Equal strings pick equal
   anchors at equal places, so all occurrences of a string meet at one anchor, and only some three in a hundred
   places are shuffled. An occurrence is its anchor with the bytes around it that a 100-byte string with it can reach.
2. Of occurrences that are equal with their surroundings all but the first are repeats as a whole. Anchors with one
   occurrence are done. What is left, the places where copies begin to differ, goes on.
3. Surroundings are sorted by anchor and cut into shards. A shard sorts its suffixes by Larsson-Sadakane refinement to
   depth 100: eight bytes first, then doubled depths, only within groups that are still open. Suffixes that stay together
   have 100 bytes in common, which is all that the common prefixes are needed for; in each run all but the first are repeats.
4. An anchor may lie in several shards. Each gives the first place of every different string there as a sorted table, cut
   into ranges by a hash of the string. All tables of a range meet in one task, where two by two the strings of one are
   looked up in the other by binary search; of two places the later one is a repeat. A string has one place a shard there,
   and the number of ranges follows from the number of strings, so that a task holds a bounded part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replaylens.session import written

from .shingles import mix

LENGTH, GRAM = 100, 32
#: Bytes of surroundings in a shard, of strings in a range, and of rows that a task holds before it passes them on.
SHARD, RANGE, HELD = 1 << 20, 8 << 20, 4 << 20
_BASE = 0x9E3779B97F4A7C15
_NONE = -(1 << 62)  # stands for a null doc_id


class Powers:
    """Powers of the rolling hash's base and of its inverse, as many as were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                    steps = np.full(size, base, dtype=np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.cumprod(steps))
        return self.up[:n], self.down[:n]


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) over each run of ``width`` values."""
    have = 1
    while 2 * have <= width:
        values, have = best(values[:-have], values[have:]), 2 * have
    return best(values[:len(values) - (width - have)], values[width - have:]) if width > have else values


def anchors(data: np.ndarray, ends: np.ndarray, powers: Powers, length: int = LENGTH,
            gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of texts that stand one after the other in ``data`` and end at ``ends``.

    Every ``length`` bytes of a text have an anchor: each window of ``gram`` bytes among them with the least hash.
    """
    grams, width = len(data) - gram + 1, length - gram + 1
    if grams < width:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    up, down = powers.of(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        hashes = mix((sums[gram:] - sums[:-gram]) * down[:grams])
    least = _sliding(hashes, width, np.minimum)
    step = np.zeros(len(data) + 1, dtype=np.int32)  # windows that run over a text's end don't count
    inner = ends[:-1]
    np.add.at(step, np.maximum(inner - length + 1, 0), 1)
    np.add.at(step, inner, -1)
    least[np.cumsum(step)[:len(least)] > 0] = 0
    pad = np.zeros(width - 1, dtype=np.uint64)
    most = _sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    at = np.flatnonzero((most == hashes) & (most > 0))
    return at, hashes[at]


def _joined(start: np.ndarray, end: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each owner that meet or overlap as one; input in any order."""
    if not len(start):
        return start, end, owner
    order = np.lexsort((start, owner))
    start, end, owner = start[order], end[order], owner[order]
    reach = end.copy()
    new = np.ones(len(start), dtype=bool)
    base = owner.astype(np.int64) * (1 << 40)  # so that the running maximum starts anew with each owner
    reach = np.maximum.accumulate(end + base) - base
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return start[first], reach[last], owner[first]


def text_tag(raw: bytes) -> int:
    """31 bits that tell apart different texts under one doc_id, as Spark's xxhash64 has them."""
    return xxhash.xxh64_intdigest(raw, seed=42) & ((1 << 31) - 1)


def _occurrences(length: int, gram: int):
    """Rows (anchor, around, doc_id, tag_at, upto) of texts: upto 0 for an occurrence, else a span known as repeat."""
    side = length - gram

    def chunk(texts: list[tuple[int, int, bytes]], powers: Powers) -> pd.DataFrame:
        ids, tags, raws = zip(*texts)
        sizes = np.array([len(r) for r in raws])
        ends = np.cumsum(sizes)
        data = b"".join(raws)
        at, hashes = anchors(np.frombuffer(data, dtype=np.uint8), ends, powers, length, gram)
        row = np.searchsorted(ends, at, side="right")
        begin = (ends - sizes)[row]
        low, high = np.maximum(begin, at - side), np.minimum(ends[row], at + length)
        digest = xxhash.xxh3_64_intdigest
        around = np.array([digest(data[a:b], seed=c) for a, b, c in zip(low.tolist(), high.tolist(), (at - low).tolist())],
                          dtype=np.uint64)
        doc, tag, pos = np.array(ids)[row], np.array(tags)[row], at - begin
        order = np.lexsort((pos, tag, doc, around, hashes))
        again = np.zeros(len(at), dtype=bool)  # not the first with these surroundings here
        h, a = hashes[order], around[order]
        again[order[1:]] = (h[1:] == h[:-1]) & (a[1:] == a[:-1])
        start, end, owner = _joined((low - begin)[again], (high - begin)[again], row[again])
        first = ~again
        pack = lambda tag, at: (tag.astype(np.int64) << 32) | at
        spread = np.arange(len(start), dtype=np.uint64) + np.uint64(texts[0][1] << 20)
        return pd.DataFrame({
            "anchor": np.concatenate([hashes[first], mix(spread)]).view(np.int64),
            "around": np.concatenate([around[first].view(np.int64), np.zeros(len(start), dtype=np.int64)]),
            "doc_id": np.concatenate([doc[first], np.array(ids, dtype=np.int64)[owner]]),
            "tag_at": np.concatenate([pack(tag[first], pos[first]), pack(np.array(tags, dtype=np.int64)[owner], start)]),
            "upto": np.concatenate([np.zeros(first.sum(), dtype=np.int64), end])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, seen = Powers(), {}
        for batch in batches:
            held, size = [], 0
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"]):
                raw = text.encode()
                if len(raw) < length:
                    continue
                tag = text_tag(raw)
                key = hashlib.blake2b(raw, digest_size=16).digest()
                if seen.get(key, doc_id + 1) <= doc_id:
                    continue  # a copy, found by its digest, or the same document again
                seen[key] = doc_id
                if len(seen) > 100_000:
                    seen.clear()
                held.append((doc_id, tag, raw))
                size += len(raw)
                if size > 1 << 20:
                    yield chunk(held, powers)
                    held, size = [], 0
            if held:
                yield chunk(held, powers)
    return run


def suffix_classes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A number for each start in ``data`` that equal strings of ``length`` bytes share and that sorts like them.

    Larsson-Sadakane: ranks of doubled depth come from two ranks of the depth before; places whose rank is already
    theirs alone keep it and are not sorted again. ``length`` is at least 8.
    """
    n = len(data)
    padded = np.zeros(n + 8, dtype=np.uint64)
    padded[:n] = data
    keys = np.zeros(n, dtype=np.uint64)
    for j in range(8):
        keys = (keys << np.uint64(8)) | padded[j:j + n]
    order, base = np.arange(n, dtype=np.int32), np.zeros(n, dtype=np.int32)  # open places, and where their group begins
    rank, depth = np.zeros(n, dtype=np.int32), 8
    while True:
        by = np.argsort(keys)
        keys, order = keys[by], order[by]  # groups keep their places: the key begins with the rank
        new = np.ones(len(keys) + 1, dtype=bool)
        new[1:-1] = keys[1:] != keys[:-1]
        at = np.flatnonzero(new)
        sizes = np.diff(at)
        # A group's rank is the place of its first suffix: that of the old group and what stands before in it.
        begin = base[by][at[:-1]]
        old = np.ones(len(begin), dtype=bool)
        old[1:] = begin[1:] != begin[:-1]
        first = np.maximum.accumulate(np.where(old, at[:-1], 0))
        rank[order] = ranks = np.repeat((begin + at[:-1] - first).astype(np.int32), sizes)
        if depth >= length:
            return rank[starts]
        still = np.repeat(sizes > 1, sizes)
        order, base = order[still], ranks[still]
        if not len(order):
            return rank[starts]
        further = min(depth, length - depth)
        ahead = np.zeros(n + further, dtype=np.uint64)
        ahead[:n - further] = rank[further:].astype(np.uint64) + np.uint64(1)
        keys = (base.astype(np.uint64) << np.uint64(32)) | ahead[order]
        depth += further


_SPANS = "doc_id long, tag long, start long, end long"
#: Spans of repeats, or (part not null) a range of a sorted table: strings one after the other, and their places.
_FOUND = f"{_SPANS}, part long, strings binary, places binary"


def _shard_repeats(rows: list[tuple], length: int, ranges: int) -> pd.DataFrame:
    """Rows of _FOUND for surroundings (doc_id, tag, low, bytes, open): open ones have an anchor that is elsewhere too."""
    rows.sort(key=lambda r: r[:3])
    sizes = np.array([len(r[3]) for r in rows])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    data = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint8)
    counts = sizes - length + 1
    row = np.repeat(np.arange(len(rows)), counts)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    same = suffix_classes(data, begins[row] + inside, length)
    texts = [r[:2] for r in rows]
    number = np.cumsum([0] + [x != y for x, y in zip(texts, texts[1:])])  # of the text, in order
    place = (number[row] << 40) | (np.array([r[2] for r in rows])[row] + inside)
    order = np.lexsort((place, same))
    same, place = same[order], place[order]
    new = np.ones(len(same), dtype=bool)
    new[1:] = same[1:] != same[:-1]
    first = place[new]
    again = place[place != first[np.cumsum(new) - 1]]
    start, end, owner = _joined(again & ((1 << 40) - 1), (again & ((1 << 40) - 1)) + length, again >> 40)
    of = np.flatnonzero(np.diff(number, prepend=-1))
    ids, tags = (np.array([rows[o][c] for o in of.tolist()], dtype=np.int64) for c in (0, 1))
    # A string around an open anchor may stand in another shard too. It may also be around further anchors.
    wide = np.logical_or.reduceat(np.array([r[4] for r in rows], dtype=bool)[row[order]], np.flatnonzero(new))
    heads, first = order[new][wide], first[wide]
    spans = pd.DataFrame({"doc_id": ids[owner], "tag": tags[owner], "start": start, "end": end})
    strings = np.lib.stride_tricks.sliding_window_view(data, length)[begins[row[heads]] + inside[heads]]
    places = np.stack([ids[first >> 40], tags[first >> 40], first & ((1 << 40) - 1)], axis=1)
    hashes = np.zeros(len(strings), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(length):
            hashes = hashes * np.uint64(_BASE) + strings[:, j]
        part = (mix(hashes) % np.uint64(ranges)).astype(np.int64)
    by = np.argsort(part, kind="stable")  # strings stay sorted within a range
    parts, cuts = np.unique(part[by], return_index=True)
    tables = pd.DataFrame({"part": parts, "strings": [strings[x].tobytes() for x in np.split(by, cuts[1:])][:len(parts)],
                           "places": [places[x].tobytes() for x in np.split(by, cuts[1:])][:len(parts)]})
    names = [c.split()[0] for c in _FOUND.split(", ")]
    whole = {c: "Int64" for c in ("doc_id", "tag", "start", "end", "part")}
    return pd.concat([spans.reindex(columns=names).astype(whole), tables.reindex(columns=names).astype(whole)])


def _in_shards(length: int, shard: int, ranges: int):
    """Shards of rows that are sorted by anchor. An anchor that a shard holds whole is no other shard's business."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, last = [], 0, None  # held: [kinds, rows] of one anchor after the other

        def repeats() -> pd.DataFrame:
            return _shard_repeats([(*r, len(rows) != kinds) for kinds, rows in held for r in rows], length, ranges)
        for batch in batches:
            for anchor, kinds, *row in zip(*(batch[c] for c in ("anchor", "kinds", "doc_id", "tag", "low", "around"))):
                if size > shard and (anchor != last or size > 2 * shard):
                    yield repeats()
                    held, size, last = [], 0, None
                if anchor != last:
                    held.append((kinds, []))
                held[-1][1].append(tuple(row))
                size += len(row[3])
                last = anchor
        if held:
            yield repeats()
    return run


def _two_merged(one: tuple, other: tuple) -> tuple[tuple, np.ndarray]:
    """A table (sorted strings, places) of two, each string with its earlier place, and the later places of strings in both."""
    (x, p), (y, q) = (one, other) if len(one[0]) >= len(other[0]) else (other, one)
    at = np.searchsorted(x, y)
    both = x[np.minimum(at, len(x) - 1)] == y
    mine, theirs = p[at[both]], q[both]
    sooner, same = np.zeros(len(mine), dtype=bool), np.ones(len(mine), dtype=bool)
    for c in range(3):
        sooner |= same & (theirs[:, c] < mine[:, c])
        same &= theirs[:, c] == mine[:, c]
    later = np.where(sooner[:, None], mine, theirs)[~same]  # shards of different anchors may give the same place
    p = p.copy()
    p[at[both]] = np.where(sooner[:, None], theirs, mine)
    return (np.insert(x, at[~both], y[~both]), np.insert(p, at[~both], q[~both], axis=0)), later


def _merged(length: int):
    """Repeats among the tables of each range; rows come sorted by range."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, part = [], None  # tables, each less than half as long as the one before

        def shrunk(all_: bool) -> Iterator[pd.DataFrame]:
            while len(held) > 1 and (all_ or 2 * len(held[-1][0]) >= len(held[-2][0])):
                table, later = _two_merged(held.pop(), held.pop())
                held.append(table)
                yield pd.DataFrame(later, columns=["doc_id", "tag", "start"]).assign(end=later[:, 2] + length)
        for batch in batches:
            for now, strings, places in zip(batch["part"].tolist(), batch["strings"], batch["places"]):
                if now != part:
                    yield from shrunk(True)
                    held.clear()
                    part = now
                held.append((np.frombuffer(strings, dtype=f"S{length}"),  # of equal length, so zeros at the end are no matter
                             np.frombuffer(places, dtype=np.int64).reshape(-1, 3)))
                yield from shrunk(False)
        yield from shrunk(True)
    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD,
                   merged: int = RANGE) -> DataFrame:
    """(doc_id, tag, start, end) byte spans of ``docs`` (doc_id long without nulls, text without nulls) that repeat
    an earlier string of ``length`` bytes. Spans of a document may overlap or touch."""
    side = length - gram
    rows = docs.select("doc_id", "text").mapInPandas(
        _occurrences(length, gram), "anchor long, around long, doc_id long, tag_at long, upto long")
    by_anchor = Window.partitionBy("anchor")
    same = Window.partitionBy("anchor", "around").orderBy("doc_id", "tag_at")
    rows = rows.repartition("anchor").withColumn("nth", F.rank().over(same)).withColumn(
        "kinds", F.sum((F.col("nth") == 1).cast("int")).over(by_anchor))
    rows = rows.where("upto > 0 or nth > 1 or kinds > 1").withColumns({
        "tag": F.shiftright("tag_at", 32), "at": F.col("tag_at").bitwiseAND((1 << 32) - 1)})
    rows = written(rows.drop("tag_at", "around"), "occurrences")
    whole = rows.where("upto > 0 or nth > 1").select(
        "doc_id", "tag", F.when(F.col("upto") > 0, F.col("at")).otherwise(F.greatest(F.col("at") - side, F.lit(0))).alias(
            "start"), F.when(F.col("upto") > 0, F.col("upto")).otherwise(F.col("at") + length).alias("end"))

    names = ["anchor", "kinds", "doc_id", "tag", "low", "around"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, size = [], 0
            for doc_id, tag, text, places in zip(*(batch[c] for c in ("doc_id", "tag", "text", "places"))):
                raw = text.encode()
                if text_tag(raw) != tag:
                    continue
                for p in places:
                    low = max(0, p["at"] - side)
                    out.append((p["anchor"], p["kinds"], doc_id, tag, low, raw[low:p["at"] + length]))
                    size += len(out[-1][-1])
                if size > HELD:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
            yield pd.DataFrame(out, columns=names)
    open_ = rows.where("upto = 0 and nth = 1").groupBy("doc_id", "tag").agg(
        F.collect_set(F.struct("anchor", "kinds", "at")).alias("places"))  # no more than a document's anchors
    around = open_.join(docs.select("doc_id", "text").distinct(), "doc_id").mapInPandas(
        cut, "anchor long, kinds long, doc_id long, tag long, low long, around binary")
    around = written(around, "surroundings")
    order = ["anchor", "around", "doc_id", "tag", "low"]
    in_several = around.where(F.col("kinds") > shard // (length + side)).count()  # but for few at the edges of tasks
    ranges = 1 + in_several * (side + 1) * length // merged
    found = written(around.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(
        _in_shards(length, shard, ranges), _FOUND), "shards")
    tables = found.where("part is not null").select("part", "strings", "places")
    across = tables.repartition("part").sortWithinPartitions("part").mapInPandas(_merged(length), _SPANS)
    return whole.unionAll(found.where("part is null").select(*across.columns)).unionAll(across)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD,
                   merged: int = RANGE) -> DataFrame:
    """``docs`` with kept binary (the bytes that stay), n_bytes, n_removed and n_spans long; row for row.

    A string starts earlier in a document with a smaller doc_id or further left in the same one. Null texts count as
    empty and null ids come first. Rows with the same id and text are one document and get the same result; different
    texts under one id count as one after the other. A document that copies an earlier one goes whole, if it has
    ``length`` bytes. Further columns stay, other than ones named like the new ones.
    """
    rows = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)),
                             "__text": F.coalesce("text", F.lit(""))})
    plain = rows.select(F.col("__id").alias("doc_id"), F.col("__text").alias("text"))
    digests = plain.where(F.octet_length("text") >= length).select("doc_id", F.unhex(F.sha2("text", 256)).alias(
        "digest"), _tag("text").alias("tag"))
    first = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("k")).where("k > 1")
    copies = digests.join(first, "digest").where("doc_id > first").select(
        "doc_id", "tag", F.lit(0).cast("long").alias("start"), F.lit(1 << 40).alias("end"))
    spans = repeated_spans(plain, length, gram, shard, merged).unionAll(copies)
    spans = spans.groupBy(F.col("doc_id").alias("__of")).agg(
        F.collect_list(F.struct("tag", "start", "end")).alias("__spans"))
    rows = rows.join(spans, F.col("__id") == F.col("__of"), "left")

    @F.pandas_udf("struct<kept: binary, n_bytes: long, n_removed: long, n_spans: long>")
    def keep(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, found in zip(text, spans):
            raw = t.encode()
            tag = text_tag(raw) if found is not None else None
            mine = [s for s in found if s["tag"] == tag] if found is not None else []
            if not mine:
                out.append((raw, len(raw), 0, 0))
                continue
            gone = np.zeros(len(raw) + 1, dtype=np.int32)
            for s in mine:
                gone[min(s["start"], len(raw))] += 1
                gone[min(s["end"], len(raw))] -= 1
            gone = np.cumsum(gone[:-1]) > 0
            n = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
            data = np.frombuffer(raw, dtype=np.uint8)
            out.append((data[~gone].tobytes() if n else raw, len(raw), int(gone.sum()), n))
        return pd.DataFrame(out, columns=["kept", "n_bytes", "n_removed", "n_spans"])
    return rows.withColumn("__kept", keep("__text", "__spans")).withColumns(
        {c: F.col(f"__kept.{c}") for c in ("kept", "n_bytes", "n_removed", "n_spans")}).drop(
        "__id", "__text", "__of", "__spans", "__kept")


def whole_characters(kept: Column) -> Column:
    """Bytes as text. Where a removed run cut a character, its remaining bytes are left out."""
    @F.pandas_udf("string")
    def decode(kept: pd.Series) -> pd.Series:
        return pd.Series([bytes(k).decode("utf-8", "ignore") if k is not None else None for k in kept], dtype=object)
    return decode(kept)


def _tag(name: str) -> Column:
    return F.xxhash64(name).bitwiseAND((1 << 31) - 1)
