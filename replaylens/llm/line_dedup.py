"""Removal of lines that many documents share, with two Bloom filters.

A first pass sends one 64-bit hash for each distinct line of a document to the part of the filters that it falls into:
a hash that the once-seen filter already has goes into the twice-seen filter. Lines outside the twice-seen filter occur
in one document only, so a second pass shuffles nothing but the suspected repeats, by 128-bit digests that are counted
in each task first. The count confirms the repeats exactly, and finds a line's first occurrence. A third pass drops
lines beside the scan; texts are not shuffled, unless there are more repeats than may be broadcast.

The filters' size follows the number of lines up to ``MAX_BITS``. Beyond some 10^9 lines they fill up, more lines become
suspects, and the shuffle grows towards that of all digests; results stay the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replaylens.session import written

BITS_PER_LINE, MAX_BITS = 16, 1 << 30
PART = 1 << 12  # 64-bit words in a part of the filters
FLUSH = 1 << 20  # hashes or digests that a task gathers before it sends them
MAX_BROADCAST = 1 << 20  # repeated lines, 32 MB
_MARKS = 4  # bits of a word that a hash sets


def words_of(hashes: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The filter word of each hash, and the bits that it sets there."""
    at = (hashes >> np.uint64(24)) % np.uint64(n_words)
    marks = np.zeros(len(hashes), dtype=np.uint64)
    for j in range(_MARKS):
        marks |= np.uint64(1) << ((hashes >> np.uint64(6 * j)) & np.uint64(63))
    return at.astype(np.int64), marks


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at, marks = words_of(hashes, len(bits))
    return (bits[at] & marks) == marks


def keys_of(text: bytes | None, least_chars: int) -> list[bytes]:
    """The key of each line: ASCII white space stripped at both ends, A-Z lower-cased; b"" where too short to count."""
    keys = [line.strip() for line in (text or b"").lower().split(b"\n")]  # bytes: ASCII only, exactly those characters
    if least_chars > 1:
        keys = [k if len(k.decode("utf-8", "replace")) >= least_chars else b"" for k in keys]
    return keys


def _digests(keys) -> np.ndarray:
    """(n, 2) words of the 128-bit digests; the first word also serves as the filters' hash."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype="<u8").reshape(-1, 2)


def _by_part(hashes: np.ndarray, n_words: int) -> pa.RecordBatch:
    """Distinct hashes by part of the filters; those that a task met more than once apart."""
    found, n = np.unique(hashes, return_counts=True)
    part = words_of(found, n_words)[0] // PART
    order = np.argsort(part, kind="stable")
    found, n, part = found[order], n[order], part[order]
    parts, start = np.unique(part, return_index=True)
    groups = list(zip(np.split(found, start[1:]), np.split(n, start[1:])))
    return pa.RecordBatch.from_pydict({
        "part": pa.array(parts, pa.int32()), "hashes": pa.array([h.tobytes() for h, _ in groups], pa.binary()),
        "again": pa.array([h[c > 1].tobytes() for h, c in groups], pa.binary())})


def seen_twice(lines: DataFrame, n_words: int, least_chars: int = 1) -> DataFrame:
    """(part, bits) of the filter of hashes that more than one row of ``lines`` (text binary) may have."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                keys = set(keys_of(text, least_chars))
                keys.discard(b"")
                if keys:
                    held.append(_digests(keys)[:, 0])
                    size += len(keys)
                if size >= FLUSH:
                    yield _by_part(np.concatenate(held), n_words)
                    held, size = [], 0
        if held:
            yield _by_part(np.concatenate(held), n_words)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, once, twice = None, None, None
        out = lambda: pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "bits": pa.array([twice.tobytes()], pa.binary())})
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    if part is not None:
                        yield out()
                    part = row["part"]
                    once, twice = (np.zeros(min(PART, n_words - part * PART), dtype=np.uint64) for _ in range(2))
                hashes, again = (np.frombuffer(row[c], dtype=np.uint64) for c in ("hashes", "again"))
                at, marks = words_of(hashes, n_words)
                at -= part * PART
                known = (once[at] & marks) == marks
                np.bitwise_or.at(twice, at[known], marks[known])
                np.bitwise_or.at(once, at, marks)
                at, marks = words_of(again, n_words)
                np.bitwise_or.at(twice, at - part * PART, marks)
        if part is not None:
            yield out()
    sent = lines.select("text").mapInArrow(send, "part int, hashes binary, again binary")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(fill, "part int, bits binary")


class Repeats:
    """Repeated lines, with their first occurrences or None: digests in order, looked up for many lines at once."""

    def __init__(self, keys: list[bytes], first: list | None = None):
        words = np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 2)
        order = np.lexsort((words[:, 1], words[:, 0]))
        self.high, self.low = words[order, 0], words[order, 1]
        self.first = first and [first[i] for i in order]
        self.deep = int(np.unique(self.high, return_counts=True)[1].max()) if len(keys) else 0

    def find(self, digests: np.ndarray) -> np.ndarray:
        """The place of each digest, -1 where it is not repeated."""
        found = np.full(len(digests), -1)
        start = np.searchsorted(self.high, digests[:, 0])
        for step in range(self.deep):
            at = np.minimum(start + step, len(self.high) - 1)
            same = (self.high[at] == digests[:, 0]) & (self.low[at] == digests[:, 1])
            found[same] = at[same]
        return found

    def dropped(self, doc_id, keys: list[bytes]) -> np.ndarray:
        """Which lines of a document go."""
        counted = np.array([bool(k) for k in keys])
        found = np.where(counted, self.find(_digests(keys)), -1)
        drop = found >= 0
        if self.first:
            for i in np.flatnonzero(drop):
                drop[i] = tuple(self.first[found[i]]) != (doc_id, i)
        return drop


def _kept(text: bytes | None, drop: np.ndarray) -> bytes:
    if not drop.any():
        return text or b""
    return b"\n".join([line for line, gone in zip((text or b"").split(b"\n"), drop) if not gone])


def _result(docs: list, texts: list, drops: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(docs, pa.int64()), "kept": pa.array([_kept(t, d) for t, d in zip(texts, drops)], pa.binary()),
        "n_lines": pa.array([len(d) for d in drops], pa.int64()),
        "n_dropped": pa.array([int(d.sum()) for d in drops], pa.int64())})


_RESULT = "doc_id long, kept binary, n_lines long, n_dropped long"


def _drop_beside_scan(rows: DataFrame, repeats: DataFrame, least_chars: int, keep_first: bool) -> DataFrame:
    """Lines looked up in a broadcast of all repeats, whose number the caller has checked."""
    table = repeats.toArrow()
    first = list(zip(table["doc"].to_pylist(), table["line"].to_pylist())) if keep_first else None
    known = rows.sparkSession.sparkContext.broadcast(Repeats(table["key"].to_pylist(), first))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            drops = [known.value.dropped(doc, keys_of(text, least_chars)) for doc, text in zip(docs, texts)]
            yield _result(docs, texts, drops)
    return rows.mapInArrow(drop, _RESULT)


def _drop_joined(rows: DataFrame, repeats: DataFrame, suspected, least_chars: int, keep_first: bool) -> DataFrame:
    """Repeats joined to the suspects, and the list of each text to its documents; texts without suspects don't move."""
    def suspects_of(text):
        keys = [k for k in set(keys_of(text, least_chars)) if k]
        digests = _digests(keys)
        return digests[holds(suspected.value, digests[:, 0])]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in set(batch.column("text").to_pylist()):
                keys = [d.tobytes() for d in suspects_of(text)]
                if keys:
                    yield pa.RecordBatch.from_pydict({
                        "digest": pa.array([xxhash.xxh3_128_digest(text)] * len(keys), pa.binary()),
                        "key": pa.array(keys, pa.binary())})

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [xxhash.xxh3_128_digest(t) if len(suspects_of(t)) else None
                       for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())],
                                             ["doc_id", "text", "digest"])

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts, drops = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), []
            for doc, text, found in zip(docs, texts, batch.column("found").to_pylist()):
                first = [(f["doc"], f["line"]) for f in found or ()] if keep_first else None
                drops.append(Repeats([f["key"] for f in found or ()], first).dropped(doc, keys_of(text, least_chars)))
            yield _result(docs, texts, drops)
    listed = rows.select("text").mapInArrow(pairs, "digest binary, key binary").distinct().join(
        repeats, "key").groupBy("digest").agg(F.collect_list(F.struct("key", "doc", "line")).alias("found"))
    tagged = rows.mapInArrow(tag, "doc_id long, text binary, digest binary")
    moved = tagged.where("digest is not null").join(listed, "digest", "left").select("doc_id", "text", "found")
    still = tagged.where("digest is null").select("doc_id", "text", F.lit(None).cast(
        listed.schema["found"].dataType).alias("found"))
    return moved.unionByName(still).mapInArrow(drop, _RESULT)


def drop_repeated_lines(docs: DataFrame, least_documents: int = 10, least_chars: int = 1, keep_first: bool = False,
                        max_bits: int = MAX_BITS, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, kept, n_lines, n_dropped for each row of ``docs`` (doc_id integer, text; other columns are not read).

    Texts are split at newlines; a null or empty text is one empty line. Lines are the same when they agree after
    stripping ASCII white space and lower-casing A-Z. A line of at least ``least_chars`` characters (code points, and
    never an empty one) that occurs in ``least_documents`` documents or more is dropped everywhere, however often it
    stands in one document; the others stay as they are, joined by newlines. With ``keep_first``, its first occurrence
    by (doc_id, line) stays. Each row is a document of its own, repeated rows and rows with one doc_id too; a null
    doc_id is kept as it is and comes first, and rows that share the first doc_id may each keep a line there.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    newlines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    n_lines = docs.agg(F.sum(newlines.cast("long"))).first()[0] or 0
    n_words = 1 << max(6, min(n_lines * BITS_PER_LINE, max_bits).bit_length() - 6)
    bits = np.zeros(n_words, dtype=np.uint64)
    for r in seen_twice(rows, n_words, least_chars).toLocalIterator():  # max_bits, in parts of 32 KB
        bits[r.part * PART:r.part * PART + len(r.bits) // 8] = np.frombuffer(r.bits, dtype=np.uint64)
    sc = docs.sparkSession.sparkContext
    suspected = sc.broadcast(bits)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, list] = {}
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                keys = {k: i for i, k in reversed(list(enumerate(keys_of(text, least_chars))))}  # each key's first line
                keys.pop(b"", None)
                digests, lines = _digests(keys), list(keys.values())
                for at in np.flatnonzero(holds(suspected.value, digests[:, 0])).tolist():
                    first = (doc is not None, doc, lines[at])
                    entry = counts.setdefault(digests[at].tobytes(), [0, first])
                    entry[0] += 1
                    entry[1] = min(entry[1], first)
                if len(counts) >= FLUSH:
                    yield counted(counts)
                    counts = {}
        if counts:
            yield counted(counts)

    def counted(counts: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "key": pa.array(list(counts), pa.binary()), "n": pa.array([n for n, _ in counts.values()], pa.int64()),
            "doc": pa.array([first[1] for _, first in counts.values()], pa.int64()),
            "line": pa.array([first[2] for _, first in counts.values()], pa.int64())})
    seen = rows.mapInArrow(suspects, "key binary, n long, doc long, line long")
    first = F.min(F.struct("doc", "line")) if keep_first else F.lit(None).cast("struct<doc:long,line:long>")
    confirmed = seen.groupBy("key").agg(F.sum("n").alias("n"), first.alias("first")).where(
        F.col("n") >= least_documents)
    repeats = written(confirmed.select("key", "first.doc", "first.line"), "repeated")
    if repeats.count() <= max_broadcast:
        result = _drop_beside_scan(rows, repeats, least_chars, keep_first)
    else:
        result = _drop_joined(rows, repeats, suspected, least_chars, keep_first)
    return result.select("doc_id", F.col("kept").cast("string").alias("kept"), "n_lines", "n_dropped")


def oracle_sql(least_documents: int = 10) -> str:
    """Every line counted and dropped by joins."""
    upper = "".join(map(chr, range(65, 91)))
    space = " || ".join(f"chr({i})" for i in (32, 9, 10, 11, 12, 13))
    return f"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select r, i, line, translate(trim(line, {space}), '{upper}', '{upper.lower()}') as key
      from (select r, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as i from d)),
repeated as (select key from (select distinct r, key from l where key <> '') group by 1
             having count(*) >= {least_documents}),
k as (select r, count(*) as n_lines, count(repeated.key) as n_dropped,
             coalesce(string_agg(line, chr(10) order by i) filter (where repeated.key is null), '') as kept
      from l left join repeated using (key) group by 1)
select doc_id, n_lines, n_dropped, sha256(kept) as kept_sha256 from k join d using (r)"""
