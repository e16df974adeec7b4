"""Chronological and hashed splits, folds, and their audits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from matchloom.operators import metrics


def stable_hash(key: Column, seed: int | None = 42) -> Column:
    """A number in [0, 2^60) from the SHA-1 of key and seed (of the key alone if None); null for a null key."""
    text = key.cast("string")
    digest = F.sha1(text if seed is None else F.concat(text, F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def hash_unit(key: Column, seed: int = 42) -> Column:
    """A number in [0, 1) that depends on the key and seed only."""
    return F.pmod(stable_hash(key, seed), F.lit(1 << 30)) / float(1 << 30)


def hashed_split(df: DataFrame, key: str, train: float = 0.8, seed: int = 42, membership: DataFrame | None = None) -> DataFrame:
    """``split`` by an earlier membership (key, split) where it has the key, else by hash."""
    fresh = F.when(hash_unit(F.col(key), seed) < train, "train").otherwise("test")
    if membership is None:
        return df.withColumn("split", fresh)
    old = membership.groupBy(key).agg(F.min("split").alias("_old"))
    return df.join(old, key, "left").withColumn("split", F.coalesce("_old", fresh)).drop("_old")


def exact_split(df: DataFrame, key: str, train: float = 0.8, seed: int = 42) -> DataFrame:
    """``split`` that cuts the rows, in the order of their key's hash, after exactly int(train x rows); null keys come first."""
    placed = numbered(df, stable_hash(F.coalesce(F.col(key).cast("string"), F.lit("")), seed), "_n")
    whole = F.broadcast(df.agg(F.floor(F.count("*") * F.lit(train)).alias("_cut")))  # one row
    return placed.crossJoin(whole).withColumn("split", F.when(F.col("_n") < F.col("_cut"), "train").otherwise("test")).select(*df.columns, "split")


def boundary_year(df: DataFrame, year: str, key: str, ratio: float = 0.2) -> DataFrame:
    """The first year of the test block: of all but the earliest year, that whose keys from there on are nearest to
    ``ratio`` of all; the latest such year at ties. A key counts once, in its first year. One row a year reaches the windows."""
    firsts = df.where(F.col(year).isNotNull()).groupBy(key).agg(F.min(year).alias(year))
    n = firsts.groupBy(year).agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc(year)).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    marked = n.select(F.col(year).alias("y"), F.sum("n").over(w).alias("cum"), F.sum("n").over(whole).alias("total"), F.min(year).over(whole).alias("first"))
    return marked.where("y > first").agg(F.min_by("y", F.struct(F.abs(F.col("cum") - ratio * F.col("total")), -F.col("y"))).alias("test_from_year"))


def chrono_split(df: DataFrame, year: str, key: str = "match_key", test_from: int | None = None, ratio: float = 0.2) -> DataFrame:
    """Rows with ``split``: train before the boundary year, test from it on; rows without a year go. A split without rows is an error."""
    if test_from is None:
        test_from = boundary_year(df, year, key, ratio).first()[0]
        if test_from is None:
            raise ValueError("the rows have fewer than two years")
    else:
        years = df.agg(F.min(year).alias("lo"), F.max(year).alias("hi")).first()
        if years.lo is None or not years.lo < test_from <= years.hi:
            raise ValueError(f"years {years.lo} to {years.hi} leave a split empty at {test_from}")
    return df.where(F.col(year).isNotNull()).withColumn("split", F.when(F.col(year) >= test_from, "test").otherwise("train"))


def fit_and_validation(df: DataFrame, year: str, validation_year: int) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(year) < validation_year), df.where(F.col(year) == validation_year)


def folds(df: DataFrame, group: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``fold`` 0..k-1, the same for all rows of a group."""
    return df.withColumn("fold", F.pmod(stable_hash(F.col(group), seed), F.lit(k)).cast("int"))


#: A group of over a mean fold's rows divided by this is heavy; so at most ``k`` times as many groups are.
HEAVY = 100


def balanced_folds(df: DataFrame, group: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``fold`` 0..k-1, the same for all rows of a group, with folds of like size however the groups' sizes are skewed.

    Heavy groups, largest first, each go to the fold with the fewest rows (of equals the first): a bounded summary, placed on
    the driver. The light ones fill the room that is left, in the order of their hash, by running sums over parts, so
    that a fold misses its share by less than a light group's rows. Null is a group of its own.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    sizes = df.groupBy(name.alias("_g")).agg(F.count("*").alias("n"))
    total = df.count()
    light = sizes.where(F.col("n") * (HEAVY * k) <= total)
    loads, placed = [0] * k, []
    for r in sizes.where(F.col("n") * (HEAVY * k) > total).orderBy(F.desc("n"), "_g").collect():  # at most HEAVY x k
        fold = loads.index(min(loads))
        loads[fold] += r.n
        placed.append((r["_g"], fold))
    room = [max(0.0, total / k - x) for x in loads]
    rest = total - sum(loads)
    ends = [sum(room[: i + 1]) * rest / (sum(room) or 1.0) for i in range(k)]
    run = metrics.running(light.withColumn("h", stable_hash(F.col("_g"), seed)), (), "h", ["n"])
    fold = F.lit(k - 1)
    for i in range(k - 2, -1, -1):
        fold = F.when(F.col("before_n") + F.col("n") / 2 < ends[i], i).otherwise(fold)
    every = run.select("_g", fold.cast("int").alias("fold"))
    if placed:
        every = every.unionByName(df.sparkSession.createDataFrame(placed, "_g string, fold int"))
    return df.withColumn("_g", name).join(every, "_g").drop("_g")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by the hash of their key: the same rows on any partitioning."""
    return df.orderBy(stable_hash(F.col(key), seed), key).limit(n)


def numbered(df: DataFrame, order: Column, name: str, bits: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with a gapless number from 0, in each group of ``by`` (no nulls), in the order of ``order``, a ``stable_hash``,
    and then of the whole row.

    Hashes are even, so their leading ``bits`` deal the rows to parts of like size; a part sorts itself and starts where
    the ones before it end. Only one count a part meets in one place, whatever the number of rows.
    """
    ranked = df.withColumns({"_h": order, "_g": F.shiftright(order, 60 - bits)})
    sizes = ranked.groupBy(*by, "_g").agg(F.count("*").alias("_c"))
    earlier = Window.partitionBy(*by).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "_g", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_s"))
    inside = ranked.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_g").orderBy("_h", *df.columns)) - 1)
    return inside.join(F.broadcast(starts), [*by, "_g"]).withColumn(name, F.col("_s") + F.col("_i")).select(*df.columns, name)


def shuffled_labels(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """Each row with the label of the row that stands at its place in another random order, over all rows at once.

    The order is of key and label, so rows of one key are dealt apart; null keys have places of their own.
    """
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    places = numbered(df, stable_hash(text, seed), "_n")
    dealt = numbered(df.select(key, label), stable_hash(text, seed + 1), "_n").select("_n", F.col(label).alias("_l"))
    return places.join(dealt, "_n").withColumn(label, F.col("_l")).drop("_n", "_l")


#: A block of places holds up to so many values of all rows that meet in it; a hash's so many leading bits are counted.
BLOCK_CELLS, LEADING = 1 << 19, 14


def permuted(df: DataFrame, key: str, columns: Sequence[str], repeats: int, seed: int = 42, name: str = "donor", block: int | None = None) -> DataFrame:
    """``df`` once for each ``repeat``, with the struct ``name`` of another row's ``columns``: in each repeat, a permutation of
    the rows as ``shuffled_labels`` deals them with seed + repeat.

    A row's place under seed s and the next repeat's donor places are the same. Counts by the leading bits of the hashes tell
    which block of ``block`` places a row's place lies in (or, at a border, which two), so that all orders' rows of a block
    meet in one task by one shuffle, are sorted there and lie side by side. ``df`` is read twice, so hand in a table.
    Where very many rows share a hash, orders are numbered and joined instead.
    """
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    block = block or max(1 << 13, BLOCK_CELLS // (len(df.columns) + len(columns)))
    every = df.withColumn("_seed", F.explode(F.sequence(F.lit(0), F.lit(repeats))))
    order = stable_hash(F.concat(text, F.lit("|"), (F.col("_seed") + seed).cast("string")), None)
    hashed = every.withColumn("_h", order).withColumn("_lead", F.col("_seed") * (1 << LEADING) + F.shiftright("_h", 60 - LEADING).cast("int"))
    sizes = hashed.groupBy("_lead").agg(F.count("*").alias("n")).toArrow().to_pandas().sort_values("_lead")  # at most 2^LEADING a seed
    if len(sizes) and sizes["n"].max() > block:
        return _permuted_by_join(every, df.columns, order, columns, repeats, name)
    start = sizes.groupby(sizes["_lead"] // (1 << LEADING))["n"].cumsum() - sizes["n"]
    total = int(sizes["n"].sum()) // (repeats + 1)
    sizes = sizes.assign(_start=start, _first=start // block, _last=(start + sizes["n"] - 1) // block).drop(columns="n")
    starts = df.sparkSession.createDataFrame(pa.Table.from_pandas(sizes, preserve_index=False))
    both = F.when(F.col("_first") == F.col("_last"), F.array("_first")).otherwise(F.array("_first", "_last"))  # n is at most ``block``
    met = hashed.join(F.broadcast(starts), "_lead").select("_lead", "_h", "_start", F.explode(both).alias("_block"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(df.columns)))
    own, given = [f"_c{i}" for i in range(len(df.columns))], [f"_c{df.columns.index(c)}" for c in columns]

    def deal(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lead, h, starts = (table.column(c).to_numpy() for c in ("_lead", "_h", "_start"))
        at = np.lexsort((h, lead))
        if ((np.diff(h[at]) == 0) & (np.diff(lead[at]) == 0)).any():
            at = pc.sort_indices(table, [(c, "ascending") for c in ("_lead", "_h", *own)], null_placement="at_start").to_numpy()
        first = np.flatnonzero(np.append(True, np.diff(lead[at]) != 0))  # all rows of a lead are here
        inside = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        place, low = starts[at] + inside, table.column("_block")[0].as_py() * block
        n = min(block, total - low)
        orders = at[(place >= low) & (place < low + n)].reshape(repeats + 1, n).astype(np.int64)
        takers, givers = pa.array(orders[:-1].ravel()), pa.array(orders[1:].ravel())
        taken, donors = table.select(own).take(takers), table.select(given).take(givers)
        repeat = pa.array(np.repeat(np.arange(repeats, dtype=np.int32), n))
        return pa.table([*taken.columns, repeat, *donors.columns], names=[*own, "_repeat", *(f"_d{i}" for i in range(len(given)))])

    kinds = [*(df.schema[c].dataType for c in df.columns), IntegerType(), *(df.schema[c].dataType for c in columns)]
    names = [*own, "_repeat", *(f"_d{i}" for i in range(len(given)))]
    dealt = met.groupBy("_block").applyInArrow(deal, StructType([StructField(n, k) for n, k in zip(names, kinds)]))
    donor = F.struct(*(F.col(f"_d{i}").alias(c) for i, c in enumerate(columns)))
    return dealt.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(df.columns)), F.col("_repeat").alias("repeat"), donor.alias(name))


def _permuted_by_join(every: DataFrame, kept: Sequence[str], order: Column, columns: Sequence[str], repeats: int, name: str) -> DataFrame:
    """``permuted`` for any hashes: places are numbered by seed, and a seed's rows joined to the next one's."""
    placed = numbered(every, order, "_n", by=["_seed"])
    takers = placed.where(F.col("_seed") < repeats).withColumn("repeat", F.col("_seed"))
    givers = placed.where(F.col("_seed") > 0).select((F.col("_seed") - 1).alias("repeat"), "_n", F.struct(*columns).alias(name))
    return takers.join(givers, ["repeat", "_n"]).select(*kept, "repeat", name)


def overlap(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The number of keys in both."""
    return a.select(*keys).intersect(b.select(*keys)).agg(F.count("*").alias("overlap"))


def split_summary(df: DataFrame, split: str, key: str, year: str, label: str) -> DataFrame:
    """Rows, keys, years and label mean of each split, and its rows by year as a map."""
    years = df.groupBy(split, year).agg(F.count("*").alias("n"))
    by_year = years.groupBy(split).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(year, "n")))).alias("rows_by_year"))  # years only
    base = df.groupBy(split).agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys"), F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.avg(label).alias("label_mean"))
    return base.join(by_year, split)
