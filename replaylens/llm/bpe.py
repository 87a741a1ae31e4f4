"""BPE encoding and decoding with a public vocabulary, inside Arrow batches.

A word is a doubly linked list of symbols and a priority queue of (merge rank, place). The lowest rank is merged
first; entries whose symbols have changed since are stale and skipped. Texts are cut at single spaces, which no
token crosses, and a worker remembers the ids of pieces it has seen (a bounded number), so the queue runs once for
most words. Decoding looks ids up and joins the vocabulary's strings.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

#: Pieces and words that a worker remembers, about 200 bytes each.
REMEMBERED = 3 << 18


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def merge_symbols(symbols: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """Merge neighbours by rank (leftmost first among equals) until no pair of neighbours has one.

    ``merges`` has (rank, merged symbol) by ``left << 32 | right``. A merged symbol takes its left part's place.
    """
    n = len(symbols)
    rank_of = merges.get
    queue = [(found, i) for i in range(n - 1) if (found := rank_of(symbols[i] << 32 | symbols[i + 1]))]
    if not queue:
        return symbols
    heapq.heapify(queue)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    symbols.append(-1)
    while queue:
        found, i = heapq.heappop(queue)
        j = after[i]
        if symbols[i] < 0 or rank_of(symbols[i] << 32 | symbols[j]) != found:
            continue  # stale: one of the two has been merged since
        symbols[i] = new = found[1]
        symbols[j] = -2
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if found := rank_of(new << 32 | symbols[k]):
                heapq.heappush(queue, (found, i))
        if (h := before[i]) >= 0 and (found := rank_of(symbols[h] << 32 | new)):
            heapq.heappush(queue, (found, h))
    return [s for s in symbols if s >= 0]


class Vocabulary:
    """Vocabulary, merges and word pattern of a tokenizer file with word ends, as text so that it can be shipped.

    The file must normalise by NFC, white space and lower case, and split by one pattern into byte-level words.
    """

    def __init__(self, text: str):
        self.text = text
        data = json.loads(text)
        model = data["model"]
        kinds = [x["type"] for x in data["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or data["decoder"] is not None:
            raise ValueError("not a lower-case word BPE file")
        ids: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"]
        signs = byte_symbols()
        self.inner, self.last = [ids[s] for s in signs], [ids[s + end] for s in signs]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {ids[a] << 32 | ids[b]: (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.pattern = regex.compile(data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len)[::-1])) + ")")
        strings = {i: s for s, i in (ids | self.special).items()}
        self.strings = pa.array([strings.get(i, "") for i in range(max(strings) + 1)])
        self.seen: dict[str, bytes] = {}

    def __reduce__(self):
        return Vocabulary, (self.text,)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            return cls(file.read())

    def word(self, word: str) -> bytes:
        raw = word.encode("utf-8", "replace")
        ids = merge_symbols([*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]], self.merges)
        return array("i", ids).tobytes()

    def piece(self, piece: str) -> bytes:
        """Ids of a stretch without special tokens. A word alone has the same ids as it has within a piece."""
        text = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()  # no final form of sigma
        words = self.pattern.findall(text)
        seen = self.seen
        if len(seen) >= REMEMBERED:
            seen.clear()
        for w in words:
            if w not in seen:
                seen[w] = self.word(w)
        found = b"".join([seen[w] for w in words])
        if len(piece) < 64:
            seen[piece] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        if "<|" in text and len(parts := self.specials.split(text)) > 1:
            return b"".join([array("i", [self.special[p]]).tobytes() if p in self.special
                             else self.encode_plain(p) for p in parts])
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> bytes:
        known, piece = self.seen.get, self.piece
        return b"".join([found if (found := known(p)) is not None else piece(p) for p in text.split(" ")])


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and ids array<int> of every text; null and empty texts have no ids. Rows are kept one for one."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(found) + 1, dtype=np.int32)
            np.cumsum([len(f) // 4 for f in found], out=offsets[1:])
            ids = pa.array(np.frombuffer(b"".join(found), dtype="<i4"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, ids)],
                                             names=["doc_id", "ids"])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, "
                                                         "ids array<int>")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``encoded`` (doc_id, ids) with decoded string: the vocabulary's strings one space apart.

    Null ids count as none. Ids that the vocabulary lacks raise an error.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pc.coalesce(batch.column(1), pa.scalar([], batch.column(1).type))
            strings = shared.value.strings.take(ids.flatten())
            offsets = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False), out=offsets[1:])
            text = pc.binary_join(pa.ListArray.from_arrays(offsets, strings), " ")
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, text], names=["doc_id", "ids", "decoded"])
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
