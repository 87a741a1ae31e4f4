"""N-gram Jaccard join: documents whose sets of word shingles are alike, found by T-occurrence search.

A set of n shingles that is alike another has at least T = ceil(threshold * n) of them in common, so T of its
inverted lists hold the other one. As in DivideSkip the lists are divided: the longest are left aside, and a
candidate must occur on enough of the short ones, which are merged and counted; the long lists are then only
probed for candidates, by binary search in the candidate's sorted set.

Equal sets are one class before anything is compared. Shingles of more than a fixed share of all documents come last
in the order that says which lists are short. A first search offers each class only the least and the greatest class
of its lists; those it shares most lists with are its leaders. Classes with one leader, such as the copies of a text
with ever more edits, are compared in blocks, where common shingles are counted by a matrix product, but for those that
are tied by the leader itself. The second, whole search finds the links between classes of different leaders that are
not connected yet. It cuts lists by blocks of classes: two blocks meet once for each list that both are on, the counts of
their pairs are a matrix in the task, and only classes with a partner on enough lists are compared by their whole sets,
so that a group of near copies is never spelled out in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replaylens.session import written

from .components import connected_components, stars
from .shingles import WordHashes, shingle_hashes

WORDS, PERCENT = 4, 85
#: A shingle on more than one in so many documents has a long list. At most mean set size times this many have.
COMMON = 2000
#: Hashes that a task counts at a time.
COUNTED = 4_000_000
#: Classes, and hashes, in a block of classes that are compared with each other.
BLOCK, BLOCK_HASHES = 256, 1 << 16
#: What the whole search knows of a class on a list.
MEMBER = ("class", "n", "group", "leader", "upper")


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def _class_of(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def _repeated(hashes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that occur ``least`` times or more (at least twice), and how often. Sorts in place: most occur once, and get no copy."""
    hashes.sort()
    apart = max(2, int(np.ceil(least))) - 1
    found = np.unique(hashes[:-apart][hashes[apart:] == hashes[:-apart]])
    return found, np.searchsorted(hashes, found, side="right") - np.searchsorted(hashes, found)


def needed(n: int, percent: int) -> int:
    """T: how many shingles of a set of n anything alike has too."""
    return -(-percent * n // 100)


def spare(n: int) -> int:
    """How many more than one of the short lists a candidate must be on."""
    return n // 20


def shingle_classes(docs: DataFrame, words: int, common: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class, n) of each document (class null without words), and (shingle, docs) of frequent shingles.

    One pass. A shingle on more than 1/common of all documents is so in some task's share; tasks report theirs, and
    the sums decide. The sums may miss shares where it was rare; the order needs no more than that.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        known, held, size, n_docs = WordHashes(), [], 0, 0

        def frequent() -> pd.DataFrame:
            values = np.concatenate(held)
            held.clear()
            values, counts = _repeated(values, n_docs / common)
            return pd.DataFrame({"kind": 1, "class": _signed(values), "n": counts})
        for batch in batches:
            sets = [shingle_hashes(t, words, known) for t in batch["text"]]
            yield pd.DataFrame({"kind": 0, "doc_id": batch["doc_id"], "n": [len(s) for s in sets],
                                "class": pd.array([_class_of(s) if len(s) else None for s in sets], dtype="Int64")})
            held += sets
            n_docs += len(sets)
            size += sum(map(len, sets))
            if size > COUNTED:
                yield frequent()
                size, n_docs = 0, 0
        if held:
            yield frequent()

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in run(batches):
            yield out.reindex(columns=["kind", "doc_id", "class", "n"]).astype({"doc_id": "Int64"})
    found = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        whole, "kind int, doc_id long, class long, n long"), "classes")
    classes = found.where("kind = 0").select("doc_id", "class", "n")
    total = classes.count()
    often = found.where("kind = 1").groupBy(F.col("class").alias("shingle")).agg(F.sum("n").alias("docs"))
    return classes, often.where(F.col("docs") * common > total)


def short_lists(docs: DataFrame, often: np.ndarray, words: int, percent: int) -> DataFrame:
    """(shingle, class, n): each class on its short lists. A task writes a class once; others may write it again."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, seen = WordHashes(), set()
        for batch in batches:
            keys, classes, sizes = [], [], []
            for text in batch["text"]:
                hashes = shingle_hashes(text, words, known)
                if not len(hashes) or (c := _class_of(hashes)) in seen:
                    continue
                seen.add(c)
                n = len(hashes)
                if len(often):
                    late = often[np.minimum(np.searchsorted(often, hashes), len(often) - 1)] == hashes
                    hashes = np.concatenate([hashes[~late], hashes[late]])
                keys.append(hashes[:n - needed(n, percent) + 1 + spare(n)])
                classes.append(c)
                sizes.append(n)
            lengths = [len(k) for k in keys]
            yield pd.DataFrame({"shingle": _signed(np.concatenate([np.zeros(0, np.uint64), *keys])),
                                "class": np.repeat(np.array(classes, dtype=np.int64), lengths),
                                "n": np.repeat(np.array(sizes, dtype=np.int64), lengths)})
    return docs.select("text").mapInPandas(run, "shingle long, class long, n long")


def _enough(shared: Column, n: Column, other: Column) -> Column:
    return shared > F.floor(F.least(n, other) / 20)


def _near_in_size(n: Column, other: Column, percent: int) -> Column:
    return 100 * F.least(n, other) >= percent * F.greatest(n, other)


def probe(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are alike, with jaccard double.

    The smaller set's hashes are looked up by binary search in the larger one, in whole, so that the count is exact.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for a, b, x, y in zip(batch["a"], batch["b"], batch["x"], batch["y"]):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                union = len(x) + len(y) - common
                if 100 * common >= percent * union:
                    out.append((a, b, common / union))
            yield pd.DataFrame(out, columns=["a", "b", "jaccard"])
    left = sets.select(F.col("class").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("class").alias("b"), F.col("hashes").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInPandas(run, "a long, b long, jaccard double")


def _common_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many hashes each of x and each of y have in common."""
    shared = np.intersect1d(np.concatenate(x), np.concatenate(y))
    counts = np.zeros((len(x), len(y)), dtype=np.float32)

    def marks(sets: list[np.ndarray], part: np.ndarray) -> np.ndarray:
        out = np.zeros((len(sets), len(part)), dtype=np.float32)
        for i, s in enumerate(sets):
            s = s[np.searchsorted(s, part[0]):np.searchsorted(s, part[-1], side="right")]
            at = np.searchsorted(part, s)
            out[i, at[part[at] == s]] = 1
        return out
    for lo in range(0, len(shared), 1 << 13):
        part = shared[lo:lo + (1 << 13)]
        counts += marks(x, part) @ marks(y, part).T
    return counts.astype(np.int64)


def block_links(members: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK,
                hashes: int = BLOCK_HASHES) -> DataFrame:
    """Stars (a, b) of all links between ``members`` (leader, class, tied) with the same leader.

    Tied classes are linked to the leader, so blocks of them alone aren't compared.
    """
    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def one() -> pd.DataFrame:
            return pd.DataFrame({"leader": [held[0][0]], "block": [held[0][1]], "tied": [all(h[2] for h in held)],
                                 "classes": [[h[1] for h in held]], "sizes": [[len(h[3]) // 8 for h in held]],
                                 "hashes": [b"".join(h[3] for h in held)]})
        for batch in batches:
            for row in zip(*(batch[c] for c in ("leader", "class", "tied", "hashes"))):
                if held and (row[0] != held[0][0] or len(held) >= block or size + len(row[3]) // 8 > hashes):
                    yield one()
                    held, size = [], 0
                held.append(row)
                size += len(row[3]) // 8
        if held:
            yield one()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                (nx, x), (ny, y) = ((np.asarray(row[f"sizes_{s}"]), np.split(
                    np.frombuffer(row[f"hashes_{s}"], dtype=np.uint64), np.cumsum(row[f"sizes_{s}"])[:-1])) for s in "xy")
                common = _common_counts(x, y)
                linked = 100 * common >= percent * (nx[:, None] + ny[None, :] - common)
                if row["block_x"] == row["block_y"]:
                    np.fill_diagonal(linked, False)
                out += stars(linked, np.asarray(row["classes_x"]), np.asarray(row["classes_y"]))
            yield pd.DataFrame(out, columns=["a", "b"])
    several = members.groupBy("leader").agg(F.count("*").alias("k"), F.min("tied").alias("all_tied"))
    several = several.where("k > 1 and not all_tied").select("leader")
    rows = members.join(several, "leader").join(sets, "class").select("leader", "class", "tied", "hashes")
    rows = rows.repartitionByRange("leader", "tied", "class").sortWithinPartitions("leader", "tied", "class")
    table = written(rows.mapInPandas(blocks, "leader long, block long, tied boolean, classes array<long>, "
                                             "sizes array<long>, hashes binary"), "blocks")
    ends = table.select("leader", "block", "tied")
    pairs = ends.alias("x").join(ends.alias("y"), "leader").where(
        "x.block <= y.block and not (x.tied and y.tied)").select(
        F.col("x.block").alias("block_x"), F.col("y.block").alias("block_y"))
    side = lambda s: table.select(*(F.col(c).alias(f"{c}_{s}") for c in ("block", "classes", "sizes", "hashes")))
    both = pairs.repartition("block_x", "block_y").join(side("x"), "block_x").join(side("y"), "block_y")
    return both.mapInPandas(compare, "a long, b long")


def class_blocks(placed: DataFrame, block: int = BLOCK, hashes: int = BLOCK_HASHES) -> DataFrame:
    """(class, block): classes in the order of their leaders' leaders, so that near copies lie in few blocks."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, held, size = None, 0, 0
        for batch in batches:
            names = []
            for c, n in zip(batch["class"].tolist(), batch["n"].tolist()):
                if name is None or held >= block or size + n > hashes:
                    name, held, size = c, 0, 0
                held, size = held + 1, size + n
                names.append(name)
            yield pd.DataFrame({"class": batch["class"], "block": np.array(names, dtype=np.int64)})
    order = ["root", "leader", "class"]
    rows = placed.select(*order, "n").distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    return written(rows.mapInPandas(run, "class long, block long"), "class-blocks")


def _merged_lists(total: tuple | None, rows: pd.DataFrame) -> tuple:
    """Members of both blocks (a column each) and on how many lists each pair is, with ``rows`` (a list each) added."""
    sides, marks = [], []
    for s in "xy":
        members = np.stack([np.concatenate(rows[f"{c}_{s}"].tolist()) for c in MEMBER])
        _, first, at = np.unique(members[0], return_index=True, return_inverse=True)
        mark = np.zeros((len(first), len(rows)), dtype=np.float32)
        mark[at, np.repeat(np.arange(len(rows)), [len(c) for c in rows[f"class_{s}"]])] = 1
        sides.append(members[:, first])
        marks.append(mark)
    found = (*sides, marks[0] @ marks[1].T)
    if total is None:
        return found
    x, y = (np.unique(np.concatenate([total[i], found[i]], axis=1), axis=1) for i in (0, 1))
    counts = np.zeros((x.shape[1], y.shape[1]), dtype=np.float32)
    for a, b, k in (total, found):
        counts[np.ix_(np.searchsorted(x[0], a[0]), np.searchsorted(y[0], b[0]))] += k
    return x, y, counts


def block_candidates(placed: DataFrame, percent: int, block: int = BLOCK, hashes: int = BLOCK_HASHES) -> DataFrame:
    """(block_x, block_y, side, class): classes of two blocks with a partner in the other that is on enough lists.

    ``placed`` has a row for each class on a list: shingle, root and the columns MEMBER. A list is cut by blocks, and
    two blocks meet once for each list that both are on; the counts of all their pairs are kept in the task.
    Pairs of one group (connected already), leader or upper (compared already) don't count.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def chosen(key: tuple, total: tuple) -> pd.DataFrame:
            x, y, counts = total
            (a, n, *one), (b, m, *other) = x[:, :, None], y[:, None, :]
            good = (counts > np.minimum(n, m) // 20) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            for p, q in zip(one, other):
                good &= p != q
            if key[0] == key[1]:
                good &= a < b
            xs, ys = x[0][good.any(axis=1)], y[0][good.any(axis=0)]
            return pd.DataFrame({"block_x": key[0], "block_y": key[1], "class": np.concatenate([xs, ys]),
                                 "side": np.repeat([0, 1], [len(xs), len(ys)])})
        key, total = None, None
        for batch in batches:
            out = []
            ends = batch[["block_x", "block_y"]].to_numpy()
            cuts = [0, *(np.flatnonzero((ends[1:] != ends[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo < hi:
                    if (now := tuple(ends[lo].tolist())) != key:
                        if total is not None:
                            out.append(chosen(key, total))
                        key, total = now, None
                    for at in range(lo, hi, 4096):
                        total = _merged_lists(total, batch.iloc[at:min(at + 4096, hi)])
            if out:
                yield pd.concat(out)
        if total is not None:
            yield chosen(key, total)
    several = ("group", "leader", "upper")
    lists = written(placed.join(class_blocks(placed, block, hashes), "class").groupBy("shingle", "block").agg(
        F.sort_array(F.collect_list(F.struct(*MEMBER))).alias("members"),  # at most ``block``
        *(f(c).alias(f"{c}_{end}") for c in several for f, end in ((F.min, "lo"), (F.max, "hi")))), "block-lists")
    x, y = lists.alias("x"), lists.alias("y")
    meet = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.block") <= F.col("y.block"))
    for c in several:
        meet &= F.least(f"x.{c}_lo", f"y.{c}_lo") < F.greatest(f"x.{c}_hi", f"y.{c}_hi")
    both = x.join(y, meet).select(
        F.col("x.block").alias("block_x"), F.col("y.block").alias("block_y"),
        *(F.col(f"{s}.members.{c}").alias(f"{c}_{s}") for s in "xy" for c in MEMBER))
    return both.repartition("block_x", "block_y").sortWithinPartitions("block_x", "block_y").mapInPandas(
        run, "block_x long, block_y long, class long, side int")


def decided(candidates: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Stars (a, b) of the links between the two sides of each pair of blocks, by their whole sets."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def links(held: list[tuple]) -> list[tuple[int, int]]:
            (a, x), (b, y) = (([h[1] for h in held if h[0] == s], [np.frombuffer(h[2], dtype=np.uint64) for h in held
                                                                  if h[0] == s]) for s in (0, 1))
            a, b, n, m = np.array(a), np.array(b), np.array([*map(len, x)]), np.array([*map(len, y)])
            common = _common_counts(x, y)
            linked = (100 * common >= percent * (n[:, None] + m[None, :] - common)) & (a[:, None] != b[None, :])
            return stars(linked, a, b)
        key, held = None, []
        for batch in batches:
            out = []
            for bx, by, *row in zip(*(batch[c] for c in ("block_x", "block_y", "side", "class", "hashes"))):
                if (bx, by) != key:
                    out += links(held) if held else []
                    key, held = (bx, by), []
                held.append(row)
            yield pd.DataFrame(out, columns=["a", "b"])
        yield pd.DataFrame(links(held) if held else [], columns=["a", "b"])
    rows = candidates.join(sets, "class").repartition("block_x", "block_y").sortWithinPartitions("block_x", "block_y")
    return rows.mapInPandas(run, "a long, b long")


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT,
                       common: int = COMMON) -> DataFrame:
    """doc_id, n_shingles, component_id for each document of ``docs`` (doc_id integer, text; others are ignored).

    Two documents link when 100 * intersection >= percent * union of their shingle sets; component_id is the least
    doc_id reachable. Null and empty texts and texts without words have no shingles and link with nothing. Rows are
    kept one for one; rows that share a doc_id are one document in the links and components, whichever of its texts
    links. A null doc_id has a null component unless linked. No documents give no rows.
    """
    classes, frequent = shingle_classes(docs, words, common)
    often = np.sort(np.array([r.shingle for r in frequent.select("shingle").collect()], dtype=np.int64).view(np.uint64))
    # One shuffle by shingle serves the distinct rows and the ends of each list.
    per_list = Window.partitionBy("shingle")
    end = F.struct("class", "n")
    lists = short_lists(docs, often, words, percent).repartition("shingle").distinct().select(
        "*", F.min(end).over(per_list).alias("least"), F.max(end).over(per_list).alias("greatest"))
    shared = written(lists.where("least.class < greatest.class"), "shared-lists")  # most lists have one class only
    # A class can only be alike another if enough of its short lists are shared at all.
    active = shared.groupBy("class", "n").agg(F.count("*").alias("k")).where(
        F.col("k") > F.floor(percent * F.col("n") / 2000)).select("class", "n")
    keys = classes.join(active.select("class"), "class").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    sets = written(_sets_of(docs, keys, words), "sets")

    # First search: the ends of each list.
    ends = F.explode(F.array("least", "greatest")).alias("end")
    stars_ = shared.select("class", "n", ends).where("class <> end.class").groupBy("class", "n", "end").agg(
        F.count("*").alias("k"))
    stars_ = stars_.where(_enough(F.col("k"), F.col("n"), F.col("end.n"))
                        & _near_in_size(F.col("n"), F.col("end.n"), percent))
    best = F.max(F.struct("k", F.col("end.class").alias("to"), "n"))
    stars_ = written(stars_.groupBy("class", (F.col("end.class") < F.col("class")).alias("down")).agg(
        best.alias("best")).select("class", "down", F.col("best.to").alias("to")), "stars")
    first = written(probe(stars_.select(F.col("class").alias("a"), F.col("to").alias("b")), sets, percent).select(
        "a", "b"), "links")
    # Each class has a leader among lesser and one among greater classes; itself where there is none.
    led = [stars_.where(side).select("class", F.col("to").alias(name)) for side, name in (
        ("down", "leader"), ("not down", "upper"))]
    leaders = active.select("class").join(led[0], "class", "left").join(led[1], "class", "left").select(
        "class", F.coalesce("leader", "class").alias("leader"), F.coalesce("upper", "class").alias("upper"))
    links = first
    for name in ("leader", "upper"):
        members = leaders.select(F.col(name).alias("leader"), "class").join(
            first.select(F.col("a").alias("class"), F.col("b").alias("leader"), F.lit(True).alias("_t")),
            ["class", "leader"], "left").select(
            "leader", "class", F.coalesce("_t", F.col("class") == F.col("leader")).alias("tied"))
        links = links.unionAll(block_links(members, sets, percent))
    twice = classes.where("doc_id is not null").groupBy("doc_id").agg(
        F.min("class").alias("a"), F.max("class").alias("b"), F.count_distinct("class").alias("k")).where("k > 1")
    same = classes.join(twice.select("doc_id", "a"), "doc_id").select("a", F.col("class").alias("b"))
    links = written(links.unionAll(same.where("b is not null")), "links")
    known = connected_components(links)

    # Second search: all pairs on the lists that are not connected yet, block by block.
    ahead = leaders.select(F.col("class").alias("leader"), F.col("leader").alias("root"))
    placed = shared.select("shingle", "class", "n").join(leaders.join(ahead, "leader"), "class").join(
        known.withColumnRenamed("node", "class"), "class", "left")
    placed = placed.withColumn("group", F.coalesce("component", "class")).select("shingle", "root", *MEMBER)
    mixed = placed.groupBy("shingle").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi")
    placed = written(placed.join(mixed.select("shingle"), "shingle"), "placed")
    more = decided(block_candidates(placed, percent), sets, percent)
    known = connected_components(known.unionAll(more))  # a row a class now, so its rounds are few and their joins short
    of_class = classes.join(known.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "root", F.coalesce("component", "class"))
    least = of_class.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return of_class.join(least, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def _sets_of(docs: DataFrame, keys: DataFrame, words: int) -> DataFrame:
    """(class, hashes) of the classes in ``keys`` (class, doc_id), from their documents' texts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            sets = [shingle_hashes(t, words, known) for t in batch["text"]]
            found = pd.DataFrame({"class": batch["class"], "hashes": [s.tobytes() for s in sets]})
            yield found[[len(s) > 0 and _class_of(s) == c for s, c in zip(sets, batch["class"])]]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.join(keys.withColumnRenamed("doc_id", "key"), F.col("doc_id").eqNullSafe(F.col("key")))
    return rows.select("class", "text").mapInPandas(run, "class long, hashes binary").dropDuplicates(["class"])


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` without all but one document of each component: the one with the least doc_id.

    Of rows that share that doc_id the first by text stays. Documents without words and those without an id stay.
    """
    columns = docs.columns
    found = jaccard_components(docs, words, percent).where("n_shingles > 0 and doc_id is not null")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    again = found.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    single = kept.join(again, "doc_id", "left_anti")
    first = kept.join(again, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", *[
        F.col(c) for c in columns if c not in ("doc_id", "text")])).alias("row"))
    return single.select(*columns).unionByName(first.select("doc_id", "row.*").select(*columns))
