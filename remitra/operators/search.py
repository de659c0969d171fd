"""Names that hold a text, from an index of their character n-grams.

Every name is listed under its n-grams of one to three characters, lower-cased.
A text of up to three characters is an n-gram itself; a longer one is held by
names that are listed under all its trigrams, which are then looked at. Lists are
stored by a hash of the n-gram, names by a hash of the name, so a search reads the
folders of its n-grams and those of the names found.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LONGEST = 3
#: Folders of lists and of names.
FOLDERS = 64


def _grams(text: Column) -> Column:
    def of(n: int) -> Column:
        last = F.length(text) - (n - 1)
        found = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda k: F.substring(text, k, F.lit(n)))
        return F.when(last >= 1, found).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(of, range(1, LONGEST + 1))))


def _folder(of: Column) -> Column:
    return F.pmod(of, F.lit(FOLDERS)).cast("int")


def write_index(names: DataFrame, path: str) -> None:
    """Store ``names`` (nm and more) with their lists under ``path``; names that are NULL are left out.

    Lists are dealt by n-gram and name together, so a frequent n-gram is written by several tasks.
    """
    rows = names.filter("nm IS NOT NULL").withColumn("id", F.xxhash64("nm")).withColumn("place", _folder(F.col("id")))
    rows.repartition("place").sortWithinPartitions("place", "id").write.partitionBy("place").parquet(f"{path}/names")
    lists = rows.select(F.explode(_grams(F.lower("nm"))).alias("gram"), "id", "place").withColumn("list", _folder(F.xxhash64("gram")))
    dealt = lists.repartitionByRange("list", "gram", "id").sortWithinPartitions("list", "gram", "id")
    dealt.write.partitionBy("list").parquet(f"{path}/lists")


def search(spark: SparkSession, path: str, text: str) -> DataFrame:
    """Stored names that hold ``text``, whatever the case; all of them for an empty text."""
    names, wanted = spark.read.parquet(f"{path}/names"), text.lower()
    if not wanted:
        return names.drop("id", "place")
    grams = sorted({wanted[k : k + LONGEST] for k in range(max(1, len(wanted) - LONGEST + 1))})
    folders = reduce(or_, [F.col("list") == _folder(F.xxhash64(F.lit(g))) for g in grams])
    listed = spark.read.parquet(f"{path}/lists").filter(folders & F.col("gram").isin(grams))
    # Names of one hash count together; looking at the names sorts them out.
    found = listed.groupBy("place", "id").agg(F.count("*").alias("_hits")).filter(F.col("_hits") >= len(grams)).drop("_hits")
    return names.join(found, ["place", "id"]).filter(F.contains(F.lower("nm"), F.lit(wanted))).drop("id", "place")
