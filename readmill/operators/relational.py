"""Joins by prefix, upserts and incremental selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by_prefix(names: DataFrame, files: DataFrame, name: str, file: str, sep: str = "", longest: bool = False) -> DataFrame:
    """Each name with the first file, in order, that starts with it; with longest, each file with its longest name.

    An equi-join on the prefix: every file offers its prefixes of the lengths that names have, so
    nothing is compared pair by pair.
    """
    lengths = names.agg(F.collect_set(F.length(name)).alias("_l"))  # as many as there are lengths
    offered = files.join(F.broadcast(lengths)).select(*files.columns, F.explode(F.transform(F.filter("_l", lambda n: (n <= F.length(file)) & (F.substring(file, n + 1, F.lit(len(sep))) == sep if sep else F.lit(True))), lambda n: F.substring(file, F.lit(1), n))).alias("_p"))
    both = names.join(offered, names[name] == F.col("_p")).drop("_p")
    w = Window.partitionBy(file).orderBy(F.desc(F.length(name))) if longest else Window.partitionBy(name).orderBy(file)
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*(c.desc() for c in order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows in place of those of the same key, the last of new's if there are several."""
    n = new.withColumn("_o", F.monotonically_increasing_id())
    return old.join(new, keys, "left_anti").unionByName(last_wins(n, keys, [F.col("_o")]).drop("_o").select(*old.columns))


def not_done(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(done, keys, "left_anti")


def first_mates(files: DataFrame, path: str, mate: Column) -> DataFrame:
    """Files with their second mate's path where it exists; second mates themselves go."""
    second = files.select(F.col(path).alias("mate"))
    paired = files.withColumn("_m", mate).join(second, (F.col("_m") == F.col("mate")) & (F.col("_m") != F.col(path)), "left").drop("_m")
    return paired.join(paired.where("mate is not null").select(F.col("mate").alias(path)), path, "left_anti")
