"""What the jobs share: config files, logs, and the given tables as reads, references and a tree of taxa."""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readmill.functions import sequences as S

log = logging.getLogger("readmill.jobs")


def config(name: str, path: str | None = None) -> dict:
    """The job's own config file, with the values of another in place of its own."""
    found = json.loads((Path(__file__).parent / f"{name}.json").read_text())
    more = json.loads(Path(path).read_text()) if path else {}
    if unknown := set(more) - set(found):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return found | more


def session(name: str) -> SparkSession:
    """For command lines only; jobs take a session."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    return SparkSession.builder.appName(name).getOrCreate()


def there(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet table lies at the path."""
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def references(benchmark: DataFrame) -> DataFrame:
    """(taxid, seq): benchmark items as genomes, dealt to the nations; items without a text or an id are left out."""
    return benchmark.where("item_id is not null and text is not null").select((F.col("item_id") % 25 + 100).cast("bigint").alias("taxid"), S.pseudo_bases(F.col("text")).alias("seq"))


def taxonomy(nation: DataFrame, region: DataFrame) -> DataFrame:
    """(taxid, parent, rank, name): a root, regions as genera below it, nations as species below them."""
    of = lambda taxid, parent, rank, name: (taxid.cast("bigint").alias("taxid"), parent.cast("bigint").alias("parent"), F.lit(rank).alias("rank"), name.alias("name"))
    root = nation.sparkSession.range(1).select(*of(F.lit(1), F.lit(None), "no rank", F.lit("root")))
    genera = region.select(*of(F.col("r_regionkey") + 10, F.lit(1), "genus", F.col("r_name")))
    return root.unionByName(genera).unionByName(nation.select(*of(F.col("n_nationkey") + 100, F.col("n_regionkey") + 10, "species", F.col("n_name"))))
