"""Packing of token pieces into sequences: cutting stock by column generation over the histogram of lengths.

Documents are tokenised once. A document is cut into full sequences and one rest; rests are rounded up to a step.
Only the histogram of rounded lengths (at most capacity / step counts) reaches the driver, where a linear program
chooses how often each pattern of lengths is used: columns are priced by a knapsack over the duals. The program's
solution is rounded down, what remains is packed first-fit, and the executors hand the patterns' places to the
pieces by their rank among those of the same length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from replaylens.session import written

from .bpe import byte_symbols

CAPACITY, STEP = 1024, 8
#: Pieces that one task ranks.
RANKED = 200_000
REMEMBERED = 3 << 18
# Fixed value: how this public vocabulary cuts text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE_AFTER_SPACE = re.compile(r"\s ")


class ByteTokens:
    """Ids of a byte-level BPE file whose ids follow its merges. Words are remembered, up to a bound."""

    def __init__(self, text: str, end: int = 0):
        self.text, self.end = text, end
        data = json.loads(text)
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in s): i for s, i in data["model"]["vocab"].items() if s not in special}
        if data["pre_tokenizer"]["type"] != "ByteLevel" or data["normalizer"] is not None:
            raise ValueError("not a byte-level BPE file")
        self.encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.seen: dict[str, bytes] = {}

    def __reduce__(self):
        return ByteTokens, (self.text, self.end)

    @classmethod
    def load(cls, path: str) -> ByteTokens:
        with open(path, encoding="utf-8") as file:
            return cls(file.read())

    def plain(self, text: str) -> bytes:
        return np.array(self.encoding.encode(text, allowed_special="all"), dtype="<u4").tobytes()

    def after_space(self, word: str) -> bytes:
        found = self.plain(" " + word)
        if len(word) < 64:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[word] = found
        return found

    def ids(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids of a text (null: empty), then the end id.

        No token goes on over a space that follows a character other than a space, so such places cut the text.
        """
        text = text or ""
        if _SPACE_AFTER_SPACE.search(text):
            found = self.plain(text)
        else:
            first, *rest = text.split(" ")
            known, after = self.seen.get, self.after_space
            found = self.plain(first) + b"".join([k if (k := known(w)) is not None else after(w) for w in rest])
        return found + self.end.to_bytes(4, "little")


def token_pieces(docs: DataFrame, tokens: ByteTokens, capacity: int = CAPACITY) -> DataFrame:
    """Full pieces and one rest of each document: doc_id, start, length, ids_crc32, doc_tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(tokens)  # a file of fixed size
    width = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = memoryview(shared.value.ids(text))
                for at in range(0, len(ids), width):
                    part = ids[at:at + width]
                    row.append(i)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(ids) // 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int32())),
                 *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable pattern of sizes that fits, and its value."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    useful = np.flatnonzero(prices > 0)
    price, size = prices[useful], sizes[useful]
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        n = np.searchsorted(size, room, side="right")
        if n:
            with_one = price[:n] + value[room - size[:n]]
            i = int(with_one.argmax())
            if with_one[i] > value[room] + 1e-12:
                value[room], choice[room] = with_one[i], useful[i]
    pattern, room = np.zeros(len(sizes), dtype=int), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(value[capacity]), pattern


def cutting_patterns(counts: dict[int, int], capacity: int, rounds: int = 4000) -> list[tuple[dict[int, int], int]]:
    """Patterns ({size: how many}) with how often each is used, so that every piece has exactly one place.

    Column generation starts from patterns of one size; each round the knapsack prices a column, and the ratio test
    chooses which pattern it replaces. ``rounds`` ends it early with a solution that is still whole.
    """
    sizes = np.array(sorted(c for c in counts if counts[c] > 0), dtype=int)
    if not len(sizes):
        return []
    demand = np.array([counts[c] for c in sizes.tolist()], dtype=float)
    patterns = np.diag(capacity // sizes)
    inverse = np.diag(1.0 / (capacity // sizes))
    for _ in range(rounds):
        value, pattern = best_pattern(inverse.sum(axis=0), sizes, capacity)
        if value <= 1 + 1e-9:
            break
        entering = inverse @ pattern
        use = inverse @ demand
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(entering > 1e-9, np.maximum(use, 0) / entering, np.inf)
        leaving = int(ratio.argmin())
        patterns[:, leaving] = pattern
        row = inverse[leaving] / entering[leaving]
        inverse = inverse - np.outer(entering, row)
        inverse[leaving] = row
    use = np.floor(np.linalg.solve(patterns.astype(float), demand) + 1e-6)
    left = [counts[c] for c in sizes.tolist()]
    plan = []
    for p, n in zip(patterns.T.tolist(), use.tolist()):
        n = min([int(n), *(have // a for have, a in zip(left, p) if a)])
        if n > 0:
            plan.append(({c: a for c, a in zip(sizes.tolist(), p) if a}, n))
            left = [have - n * a for have, a in zip(left, p)]
    # What rounding leaves is few pieces: the fullest sequence that can be made of them, as often as it can be.
    while any(left):
        room, p = capacity, [0] * len(left)
        for i in range(len(left) - 1, -1, -1):
            p[i] = min(left[i], room // int(sizes[i]))
            room -= p[i] * int(sizes[i])
        n = min(have // a for have, a in zip(left, p) if a)
        plan.append(({c: a for c, a in zip(sizes.tolist(), p) if a}, n))
        left = [have - n * a for have, a in zip(left, p)]
    return plan


def pack(docs: DataFrame, tokens: ByteTokens, capacity: int = CAPACITY, step: int = STEP,
         ranked: int = RANKED) -> DataFrame:
    """Places of all token pieces of ``docs`` (doc_id, text) in sequences of at most ``capacity`` tokens.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Sequences hold pieces without gaps
    from offset 0. Null text counts as empty: a document of the end id alone. Repeated rows are documents of their
    own; null ids are kept; other columns are ignored; no documents give no rows.
    """
    pieces = written(token_pieces(docs, tokens, capacity), "pieces")
    size = F.ceil(F.col("length") / step).cast("int")
    lengths = {r.size: r.n for r in pieces.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()}
    full = capacity // step
    plan = [({full: 1}, lengths[full])] if lengths.get(full) else []
    plan += cutting_patterns({c: n for c, n in lengths.items() if c != full}, full)
    # For each size: the ranks at which its patterns begin, and each pattern's first sequence and number of places.
    first, places = 0, {}
    for pattern, times in plan:
        for c, a in pattern.items():
            ranks, *_ = found = places.setdefault(c, ([0], [], []))
            ranks.append(ranks[-1] + a * times)
            found[1].append(first)
            found[2].append(a)
        first += times
    places = {c: tuple(np.array(x, dtype=np.int64) for x in found) for c, found in places.items()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sequence, slot = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            for c, at in b.groupby("size").indices.items():
                ranks, starts, each = places[c]
                rank = b["rank"].to_numpy()[at]
                p = np.searchsorted(ranks, rank, side="right") - 1
                within = rank - ranks[p]
                sequence[at] = starts[p] + within // each[p]
                slot[at] = within % each[p]
            yield b.drop(columns=["rank"]).assign(sequence_id=sequence, slot=slot)

    # The rank is the number of pieces in earlier blocks of the same size plus the rank in the block; blocks are
    # hashed, so that neither a common length nor a long document is ranked in one task.
    blocks = max(1, -(-sum(lengths.values()) // ranked))
    by = ["size", "block"]
    pieces = pieces.withColumns({"size": size, "block": F.pmod(F.xxhash64("doc_id", "start"), F.lit(blocks))})
    before = Window.partitionBy("size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = pieces.groupBy(*by).agg(F.count("*").alias("n")).select(
        *by, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    within = Window.partitionBy(*by).orderBy("doc_id", "start", "ids_crc32")
    rows = pieces.withColumn("at", F.row_number().over(within)).join(earlier, by)
    rows = rows.select(*[c for c in pieces.columns if c != "block"], (F.col("at") - 1 + F.col("earlier")).alias("rank"))
    schema = StructType([*(f for f in rows.schema if f.name != "rank"), StructField("sequence_id", LongType()),
                         StructField("slot", LongType())])
    rows = rows.mapInPandas(place, schema)
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "slot").rowsBetween(
        Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset")
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset)
