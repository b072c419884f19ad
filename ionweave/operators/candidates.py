"""Library candidates of each query: a charge equi-join with a precursor m/z window, bucketed.

Each library row falls into one bucket of (charge, m/z); a query is repeated for the two or three
buckets its window meets. The equi-join on (charge, bucket) bounds the pairs to near neighbours and
spreads over the cluster; the exact window is a residual predicate. Only ids and m/z travel here;
peaks are joined later, by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_window(query_mz: Column, library_mz: Column, charge: Column, tolerance: float, mode: str) -> Column:
    if mode == "Da":
        return F.abs(query_mz - library_mz) * charge <= tolerance
    if mode == "ppm":
        return F.abs(query_mz - library_mz) / library_mz * 1e6 <= tolerance
    raise ValueError(f"unknown tolerance mode {mode!r}")


def buckets(tolerance: float, mode: str) -> tuple:
    """(buckets a query's window meets, bucket of a library spectrum) as functions of m/z; both read ``charge``."""
    if mode == "Da":
        low, high = (lambda q: q - tolerance / F.col("charge")), (lambda q: q + tolerance / F.col("charge"))
        bucket = lambda mz: F.floor(mz * F.col("charge") / max(tolerance, 1e-9))
    elif mode == "ppm":
        share = tolerance * 1e-6
        low, high = (lambda q: q / (1 + share)), (lambda q: q / (1 - share))
        bucket = lambda mz: F.floor(F.log(mz) / max(share, 1e-12))
    else:
        raise ValueError(f"unknown tolerance mode {mode!r}")
    # one bucket more at either end guards against rounding; the exact window decides
    return lambda mz: F.sequence(bucket(low(mz)) - 1, bucket(high(mz)) + 1), bucket


def precursor_pairs(queries: DataFrame, library: DataFrame, tolerance: float, mode: str) -> DataFrame:
    """``(query_id, library_id, charge)`` of all pairs of equal charge in the window.

    Both sides have ``id, precursor_mz, precursor_charge``.
    """
    q = queries.select(F.col("id").alias("query_id"), F.col("precursor_mz").alias("q_mz"), F.col("precursor_charge").alias("charge"))
    lib = library.select(F.col("id").alias("library_id"), F.col("precursor_mz").alias("l_mz"), F.col("precursor_charge").alias("charge"))
    met, bucket = buckets(tolerance, mode)
    spread = q.withColumn("bucket", F.explode(met(F.col("q_mz"))))
    filed = lib.withColumn("bucket", bucket(F.col("l_mz")))
    pairs = spread.join(filed, ["charge", "bucket"]).where(in_window(F.col("q_mz"), F.col("l_mz"), F.col("charge"), tolerance, mode))
    return pairs.select("query_id", "library_id", "charge")


def level_pairs(queries: DataFrame, library: DataFrame, tolerance: float, mode: str) -> DataFrame:
    """``(charge, q_mz, l_mz, n)``: how many pairs of different ids in the window have these m/z; no row of a pair is made.

    Rows go by distinct m/z, each once a side, and pairs of equal ids are taken off, from a join on the ids.
    """
    q, lib = (df.select("id", F.col("precursor_mz").alias("mz"), F.col("precursor_charge").alias("charge")).where("id is not null") for df in (queries, library))
    many = lambda df: df.groupBy("charge", "mz").agg(F.count("*").alias("n"))
    side = lambda df: df.select(F.struct("mz", "n").alias("id"), F.col("mz").alias("precursor_mz"), F.col("charge").alias("precursor_charge"))
    met = precursor_pairs(side(many(q)), side(many(lib)), tolerance, mode)
    all_of = met.select("charge", F.col("query_id.mz").alias("q_mz"), F.col("library_id.mz").alias("l_mz"), (F.col("query_id.n") * F.col("library_id.n")).alias("n"))
    own = q.toDF("id", "q_mz", "charge").join(lib.toDF("id", "l_mz", "charge"), ["id", "charge"]).where(in_window(F.col("q_mz"), F.col("l_mz"), F.col("charge"), tolerance, mode))
    own = own.groupBy("charge", "q_mz", "l_mz").agg((-F.count("*")).alias("n"))
    return all_of.unionByName(own).groupBy("charge", "q_mz", "l_mz").agg(F.sum("n").alias("n")).where("n > 0")


LIST = 1000  # values of a list


def with_each(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``left`` joined with ``right(*keys, value)``, for keys with many rows on both sides: lists of about ``LIST`` rows of both travel
    and meet, so that a pair costs one step in a list. Pairs of lists are dealt evenly to all tasks, by key and list of values: what
    a task gives repeats few values for many rows, so that columnar files stay small however large the tables.
    """
    tasks = 4 * left.sparkSession.sparkContext.defaultParallelism

    def in_lists(df: DataFrame, columns: list[str], name: str, most) -> DataFrame:
        sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
        sizes = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("_n").alias("_all")))).select(*keys, F.ceil(F.col("_n") / most).alias("_lots"))
        return df.join(sizes, keys).groupBy(*keys, F.pmod(F.xxhash64(*columns), "_lots").alias(f"{name}_lot")).agg(F.collect_list(F.struct(*columns)).alias(name))

    few = F.least(F.lit(LIST), F.ceil(F.col("_all") / tasks))  # small tables too are work for all tasks
    lists = in_lists(right, [value], "_values", F.lit(LIST)).withColumn("_values", F.transform("_values", lambda x: x[value]))
    # whole eights stay, what is over meets in lists of its own: repeats of eights begin at whole bytes in files, where codecs find them
    n, over = F.size("_values"), F.size("_values") % 8
    eights = F.array(F.struct(F.col("_values_lot").alias("lot"), F.slice("_values", 1, n - over).alias("v")), F.struct((-1 - F.floor(F.col("_values_lot") / (LIST // 8))).alias("lot"), F.slice("_values", n - over + 1, over).alias("v")))
    lists = lists.select(*keys, F.explode(eights).alias("_part")).where(F.size("_part.v") > 0)
    lists = lists.groupBy(*keys, F.col("_part.lot").alias("_values_lot")).agg(F.flatten(F.collect_list("_part.v")).alias("_values"))
    met = in_lists(left, left.columns, "_rows", few).join(lists, keys)
    order = [*keys, "_values_lot", "_rows_lot"]
    each = met.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select(F.explode("_rows").alias("_row"), "_values")
    each = each.select("_row.*", "_values").coalesce(tasks)  # moves nothing: a row is read once, not once a pair
    return each.withColumn(value, F.explode("_values")).select(*left.columns, value)


def restrict(pairs: DataFrame, neighbours: DataFrame, indexed_charges: DataFrame) -> DataFrame:
    """Pairs that are nearest neighbours too, for charges that have an index; other charges keep all pairs."""
    indexed = pairs.join(indexed_charges, "charge", "left_semi").join(neighbours, ["query_id", "library_id"], "left_semi")
    return indexed.unionByName(pairs.join(indexed_charges, "charge", "left_anti"))


def library_counts(library: DataFrame, least: int | None = None) -> DataFrame:
    """``(charge, n)`` of library spectra; with ``least``, only charges of as many."""
    n = library.groupBy(F.col("precursor_charge").alias("charge")).agg(F.count("*").alias("n"))
    return n if least is None else n.where(F.col("n") >= least)
