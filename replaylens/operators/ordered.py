"""Skew-safe ordered operators.

A session is one ordered series, and one session may hold a third of all rows.
No operator here sorts a whole session in one task. Each series is cut into
blocks, the wide rows are windowed per ``(session, block)``, and what one block
needs from its neighbours travels in one of two small forms:

* a halo: the last (or first) few rows of a block, copied to the next block;
* a carry: one summary row per block, scanned in block order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import written

BLOCK = "_block"
BLOCK_ROWS = 65_536
TIME_BLOCK_ROWS = 1 << 20
ORDER_BLOCKS = 256
SAMPLES = 64
SORTED_AT_ONCE = 1 << 20


def index_block(idx: str | Column, rows: int = BLOCK_ROWS) -> Column:
    """Block number of a 0-based frame index."""
    return F.floor((F.col(idx) if isinstance(idx, str) else idx) / rows)


def time_block(t: str, seconds: float | None) -> str | Column:
    """Time blocks of fixed length, or by quantiles (see ``add_block``) if None.

    A recording ticks some 15 times a second, so an hour is a known 54 000 frames:
    fixed blocks then save the pass that looks for long series.
    """
    return t if seconds is None else F.floor(F.col(t) / seconds)


def add_block(df: DataFrame, keys: list[str], block: str | Column,
              rows: int | None = None, sized_by: DataFrame | None = None) -> DataFrame:
    """Add the block column: an expression, or blocks of a numeric column by its quantiles.

    Given a column name, a series of more than about ``rows`` rows is cut at splitters
    taken from a sample of it, so that blocks hold about ``rows`` rows each however its
    times are spread: pauses, bursts and a clock that jumps once leave no block empty or
    crowded. All other series are one block and need no carry (``_long`` is false). The
    splitters come in a table with about one entry per ``rows`` rows of data (100 billion
    rows give some 100 000 entries, 1 MB), which is why it may be broadcast. Series are
    sampled from ``sized_by`` where that is cheaper to read than ``df``.
    """
    if isinstance(block, Column):
        return df.withColumn(BLOCK, block)
    splits = splitters(df if sized_by is None else sized_by, keys, block, rows or TIME_BLOCK_ROWS)
    return (df.join(F.broadcast(splits), keys, "left")
            .withColumn(BLOCK, F.coalesce(reached("_splits", "_leaps", F.col(block)), F.lit(0)).cast("long"))
            .withColumn("_long", F.col("_splits").isNotNull())
            .drop("_splits", "_leaps"))


def splitters(df: DataFrame, keys: list[str], column: str, rows: int) -> DataFrame:
    """(keys, _splits, _leaps) of each series longer than about ``rows`` rows: where to cut it.

    A row is in the sample by a hash of its key and value, the same one on every retry.
    ``SAMPLES`` sampled rows make a block, so block sizes stray by some 1/8 of their mean,
    and a series that yields no more than that is left whole. Only samples are shuffled.
    """
    per_block = min(SAMPLES, rows)
    picked = df.select(*keys, F.col(column).alias("_at")).where(
        F.col("_at").isNotNull() & (F.pmod(F.xxhash64(*keys, "_at"), F.lit(rows)) < per_block))
    order = Window.partitionBy(*keys).orderBy("_at")
    numbered = picked.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") % per_block == 0)
    splits = numbered.groupBy(*keys).agg(F.array_sort(F.collect_set("_at")).alias("_splits"))
    # A search halves what is left: it leaps by falling powers of two.
    depth = F.floor(F.log2(F.size("_splits").cast("double"))).cast("int")
    leaps = F.transform(F.sequence(depth, F.lit(0), F.lit(-1)), lambda i: F.pow(F.lit(2), i).cast("int"))
    return splits.withColumn("_leaps", leaps)


def reached(splits: str, leaps: str, value: Column) -> Column:
    """How many of the ascending splitters are below the value, by binary search; null without splitters."""
    def leap(at: Column, by: Column) -> Column:
        ahead = F.coalesce(F.get(F.col(splits), at + by - 1) < value, F.lit(False))
        return F.when(ahead, at + by).otherwise(at)
    return F.aggregate(leaps, F.lit(0), leap)


def with_halo(df: DataFrame, idx: str = "frame_idx", rows: int = BLOCK_ROWS,
              before: int = 0, after: int = 0) -> DataFrame:
    """Assign index blocks; copy edge rows to the neighbour that needs them.

    ``before`` rows ahead of each block and ``after`` rows behind it become
    visible inside the block. Keep only ``_own`` rows after windowing.
    """
    if max(before, after) >= rows:
        raise ValueError(f"a halo of {max(before, after)} rows needs blocks longer than {rows}")
    block, offset = index_block(idx, rows), F.pmod(F.col(idx), F.lit(rows))
    targets = F.array_compact(F.array(
        block,
        F.when(offset >= rows - before, block + 1),
        F.when(offset < after, block - 1)))
    return (df.withColumn("_home", block)
              .withColumn(BLOCK, F.explode(targets))
              .withColumn("_own", F.col(BLOCK) == F.col("_home"))
              .drop("_home"))


def own_rows(df: DataFrame) -> DataFrame:
    """Drop halo copies again."""
    return df.where("_own").drop("_own", BLOCK)


def within(keys: list[str], *order) -> WindowSpec:
    """Window over one block of a series."""
    return Window.partitionBy(*keys, BLOCK).orderBy(*order)


_COMBINE = {
    "last": lambda c: F.last(c, ignorenulls=True),
    "first": lambda c: F.first(c, ignorenulls=True),
    "sum": F.sum, "max": F.max, "min": F.min,
}


def carry(blocked: DataFrame, keys: list[str],
          spec: dict[str, tuple[Column, str]], later: bool = False) -> DataFrame:
    """One row per block with a summary of all earlier (or later) blocks.

    ``spec`` maps a name to (aggregate within a block, how to combine blocks:
    last, first, sum, max or min). Rows are reduced map-side before the shuffle;
    the window runs over block rows only. Series of one block are left out.
    """
    if "_long" in blocked.columns:
        blocked = blocked.where("_long")
    per_block = blocked.groupBy(*keys, BLOCK).agg(
        *[agg.alias(name) for name, (agg, _) in spec.items()])
    # Frames that grow from the start cost one step per row; frames that shrink to the
    # end are recomputed for every row. "Later" is therefore read in falling order.
    span = (Window.partitionBy(*keys).orderBy(F.desc(BLOCK) if later else F.asc(BLOCK))
            .rowsBetween(Window.unboundedPreceding, -1))
    turned = {"first": "last", "last": "first"} if later else {}
    return per_block.select(*keys, BLOCK, *[
        _COMBINE[turned.get(how, how)](F.col(name)).over(span).alias(name) for name, (_, how) in spec.items()])


def attach(blocked: DataFrame, keys: list[str], *tables: DataFrame) -> DataFrame:
    """Join carries to the rows of their blocks.

    Quantile blocks number about one per TIME_BLOCK_ROWS rows of data, so their
    carries are broadcast and the rows are shuffled only once, for the window. With
    other blocks Spark chooses; a sorted join shares the window's partitioning.
    """
    bounded = "_long" in blocked.columns
    for table in tables:
        blocked = blocked.join(F.broadcast(table) if bounded else table, [*keys, BLOCK], "left")
    return blocked.drop("_long")


def with_previous(df: DataFrame, keys: list[str], order: list[str], block: str | Column,
                  cols: list[str], seen: dict[str, Column] | None = None,
                  rows: int | None = None) -> DataFrame:
    """Add ``prev``: the previous row's ``cols`` in the series, across block edges.

    ``seen`` adds flags telling whether a condition held on any earlier row. Works
    for rows with gaps, where a halo cannot be found by arithmetic.
    """
    blocked = add_block(df, keys, block, rows).withColumn("_cur", F.struct(*cols))
    flags = {name: F.coalesce(cond.cast("int"), F.lit(0)) for name, cond in (seen or {}).items()}
    spec = {"_carry": (F.max_by("_cur", F.struct(*order)), "last")}
    spec.update({f"_c_{name}": (F.max(flag), "max") for name, flag in flags.items()})
    w = within(keys, *order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = (attach(blocked, keys, carry(blocked, keys, spec))
           .withColumn("prev", F.coalesce(F.lag("_cur").over(w), F.col("_carry"))))
    for name, flag in flags.items():
        out = out.withColumn(name, F.greatest(
            F.coalesce(F.max(flag).over(before), F.lit(0)), F.coalesce(f"_c_{name}", F.lit(0))) > 0)
    return out.drop("_cur", "_carry", BLOCK, *[f"_c_{name}" for name in flags])


def number_rows(df: DataFrame, keys: list[str], order: list[str], block: str | Column,
                name: str = "frame_idx", rows: int | None = None) -> DataFrame:
    """Dense 0-based row number per key, without sorting a key in one task."""
    blocked = add_block(df, keys, block, rows)
    base = carry(blocked, keys, {"_base": (F.count(F.lit(1)), "sum")})
    return (attach(blocked, keys, base)
            .withColumn(name, (F.coalesce("_base", F.lit(0)) - 1
                               + F.row_number().over(within(keys, *order))).cast("long"))
            .drop("_base", BLOCK))


def order_blocks(df: DataFrame, key: str, blocks: int = ORDER_BLOCKS) -> DataFrame:
    """Cut rows into ordered blocks by a unique ``key``.

    The splitters are the ``blocks - 1`` keys with the smallest hash, so
    their number is fixed, every retry picks the same ones, and nothing has to be
    counted first.
    """
    splitters = (df.select(F.col(key).alias("_k"))
                 .orderBy(F.xxhash64("_k"), "_k").limit(blocks - 1)
                 .agg(F.sort_array(F.collect_list("_k")).alias("_s"))
                 .select(F.struct(*_two_levels("_s", blocks)).alias("_s")))

    def reached(ladder):
        return F.size(F.filter(ladder, lambda s: s <= F.col(key)))
    step = _ladder_step(blocks)
    return (df.withColumn("_splitters", splitters.scalar())
            .withColumn("_top", reached(F.col("_splitters.top")))
            .withColumn(BLOCK, F.col("_top") * step + F.coalesce(
                F.greatest(reached(F.get("_splitters.low", F.col("_top"))), F.lit(0)), F.lit(0)))
            .drop("_splitters", "_top"))


def _ladder_step(blocks: int) -> int:
    return max(2, round(blocks ** 0.5))


def _two_levels(sorted_array: str, blocks: int) -> list[Column]:
    """Every step-th splitter, and the splitters in between: two short searches per row."""
    step = _ladder_step(blocks)
    n = F.size(sorted_array)
    tops = F.filter(F.sequence(F.lit(step), F.lit(blocks + step), F.lit(step)), lambda i: i <= n)
    starts = F.sequence(F.lit(1), F.lit(blocks), F.lit(step))
    return [F.transform(tops, lambda i: F.element_at(sorted_array, i)).alias("top"),
            F.transform(starts, lambda i: F.slice(sorted_array, i, step - 1)).alias("low")]


def running_total(df: DataFrame, key: str, value: str, name: str = "before",
                  blocks: int = ORDER_BLOCKS) -> DataFrame:
    """Sum of ``value`` over all rows before this one in the order of a unique ``key``."""
    blocked = order_blocks(df, key, blocks)
    # Whole numbers are added as such: doubles would lose units above 2**53.
    wide = "double" if df.schema[value].dataType.simpleString() in ("float", "double") else "bigint"
    # At most `blocks` sums: one small array, read as a scalar.
    totals = (blocked.groupBy(BLOCK).agg(F.sum(value).cast(wide).alias("_in"))
              .agg(F.collect_list(F.struct(BLOCK, "_in")).alias("_sums"))
              .select(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.aggregate(
                  F.filter("_sums", lambda s: s[BLOCK] < b),
                  F.lit(0).cast(wide), lambda acc, s: acc + s["_in"])).alias("_base")))
    inside = Window.partitionBy(BLOCK).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    kind = df.schema[value].dataType
    return (blocked.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .withColumn("_bases", totals.scalar())
            .withColumn(name, (F.col(name) + F.get("_bases", BLOCK)).cast(kind))
            .drop(BLOCK, "_bases"))


def hashed_rank(df: DataFrame, digest: Column, ties: list[str], name: str = "rank",
                digits: int = 4) -> DataFrame:
    """0-based rank in the order of a hex digest.

    A digest is uniform, so its leading digits are even blocks; block offsets
    come from at most ``16**digits`` counts.
    """
    blocked = (df.withColumn("_digest", digest)
               .withColumn(BLOCK, F.conv(F.substring("_digest", 1, digits), 16, 10).cast("int")))
    base = (blocked.groupBy(BLOCK).agg(F.count(F.lit(1)).alias("_in"))
            .select(BLOCK, F.sum("_in").over(
                Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)).alias("_base")))
    inside = Window.partitionBy(BLOCK).orderBy("_digest", *ties)
    return (blocked.join(F.broadcast(base), BLOCK)
            .withColumn(name, (F.coalesce("_base", F.lit(0)) + F.row_number().over(inside) - 1).cast("long"))
            .drop(BLOCK, "_base", "_digest"))


def _cell(value: Column) -> Column:
    """Monotone cell of a number: about 0.1 % wide at any magnitude."""
    size = F.floor(F.log1p(F.abs(value) * 1e6) * 1000).cast("long")
    return F.when(value < 0, -size).otherwise(size)


def order_statistics(df: DataFrame, keys: list[str], value: str,
                     ranks: dict[str, Column]) -> DataFrame:
    """Exact order statistics per group: the value at given 0-based ranks.

    ``ranks`` maps a name to an expression over ``n``, the group's row count.
    Values are counted into cells first, and only cells that hold a wanted rank are sorted.
    Where such a cell has more than ``SORTED_AT_ONCE`` distinct values, they are counted into
    parts of its range, and only the part that holds the rank is sorted. So neither a hot group nor values
    close together reach one task whole. The counts are written once, as several steps read them.
    """
    counted = written(df.where(F.col(value).isNotNull())
                      .groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
                      .withColumn("_cell", _cell(F.col("_v"))), "counted")
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    cells = (counted.groupBy(*keys, "_cell").agg(F.sum("_c").alias("_c"), F.count(F.lit(1)).alias("_values"))
             .withColumn("n", F.sum("_c").over(group))
             .withColumn("_off", F.coalesce(F.sum("_c").over(
                 group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    wanted = written(cells.withColumn("_want", F.explode(F.array(*[
                         F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank"))
                         for name, rank in ranks.items()])))
                     .where((F.col("_want.rank") >= F.col("_off"))
                            & (F.col("_want.rank") < F.col("_off") + F.col("_c")))
                     .select(*keys, "_cell", "_off", "n", "_values", "_want.name", "_want.rank"), "ranks")
    held = counted.join(wanted.drop("_values"), [*keys, "_cell"])
    if (wanted.agg(F.max("_values")).first()[0] or 0) > SORTED_AT_ONCE:
        held = _narrowed(held, [*keys, "name"])
    inside = Window.partitionBy(*keys, "name").orderBy("_v")
    return (held.withColumn("_upto", F.col("_off") + F.sum("_c").over(inside))
            .where((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("_c")))
            .groupBy(*keys).agg(F.max("n").alias("n"), *[
                F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in ranks]))


def _narrowed(rows: DataFrame, by: list[str], parts: int = 4096) -> DataFrame:
    """Of each cell's values, only the part of its range that holds the wanted rank.

    Steady values, such as the gaps of one frame rate, share a cell; without this step they
    would all be sorted together.
    """
    ends = rows.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    part = F.when(F.col("_hi") > F.col("_lo"), F.least(
        F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * parts), F.lit(parts - 1)))
    rows = rows.join(ends, by).withColumn("_part", F.coalesce(part, F.lit(0)).cast("long")).drop("_lo", "_hi")
    upto = F.col("_off") + F.sum("_in").over(Window.partitionBy(*by).orderBy("_part"))
    found = (rows.groupBy(*by, "_part", "rank", "_off").agg(F.sum("_c").alias("_in")).withColumn("_upto", upto)
             .where((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("_in")))
             .select(*by, "_part", (F.col("_upto") - F.col("_in")).alias("_from")))
    return rows.join(found, [*by, "_part"]).withColumn("_off", F.col("_from")).drop("_part", "_from")


def even_positions(n: Column, k: int) -> Column:
    """Up to ``k`` evenly spaced positions of ``0 .. n-1``, truncated to integers."""
    take = F.least(F.lit(k), n)
    step = (n - 1) / F.greatest(take - 1, F.lit(1))
    picks = F.transform(F.sequence(F.lit(0), take - 1),
                        lambda j: F.when(j == take - 1, n - 1).otherwise(F.floor(j * step)).cast("long"))
    return F.when(n == 1, F.array(F.lit(0).cast("long"))).when(n > 1, F.array_distinct(picks))
