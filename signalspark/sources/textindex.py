"""An inverted index of log bodies: positional postings in Parquet, laid out so that a search reads the terms it asks for.

Postings lie in folders by shard, a hash of the term, and by batch, sorted by term; so a query opens the shards of its terms,
and inside them Parquet skips the row groups of others. Each batch keeps how many records each of its terms has, so that
relevance needs no postings of other terms and no pass over the logs. Writing a batch again replaces it.
"""

from __future__ import annotations

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.functions.columns import WORD, words, words_of
from signalspark.sources.store import day_of

POSTINGS = "Term string, Id long, Day date, Positions array<int>, Shard int, Batch string"
FREQUENCIES = "Term string, Records long, Shard int, Batch string"
TOTALS = "Records long, Batch string"


class TextIndex:
    def __init__(self, spark: SparkSession, path: str, shards: int = 64):
        """``shards``, folders for the terms, is the same for all batches of an index."""
        self.spark, self.path, self.shards = spark, path.rstrip("/"), shards

    def shard_of(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.shards)).cast("int")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def _write(self, name: str, rows: DataFrame, *by: str) -> None:
        rows.write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/{name}")

    def add(self, records: DataFrame, batch: str) -> None:
        """Indexes log records (Id, BodyValue, TimeUnixNano) under the name of a batch. A null body has no terms, but counts."""
        times = [F.col(c) for c in ("TimeUnixNano", "ObservedTimeUnixNano") if c in records.columns]
        placed = records.select("Id", day_of(F.coalesce(*times) if times else F.lit(0)).alias("Day"), F.posexplode(words(F.col("BodyValue"))).alias("Position", "Term"))
        postings = placed.groupBy("Term", "Id", "Day").agg(F.array_sort(F.collect_list("Position")).alias("Positions")).withColumns({"Shard": self.shard_of(F.col("Term")), "Batch": F.lit(batch)})
        self._write("postings", postings.hint("rebalance", "Shard", "Batch").sortWithinPartitions("Shard", "Batch", "Term", "Day", "Id"), "Shard", "Batch")
        mine = self._read("postings", POSTINGS).where(F.col("Batch") == batch)
        counts = mine.groupBy("Shard", "Batch", "Term").agg(F.count("*").alias("Records"))
        self._write("frequencies", counts.select("Term", "Records", "Shard", "Batch").hint("rebalance", "Shard", "Batch").sortWithinPartitions("Shard", "Batch", "Term"), "Shard", "Batch")
        self._write("totals", records.agg(F.count("*").alias("Records")).withColumn("Batch", F.lit(batch)), "Batch")

    def _of(self, df: DataFrame, terms: list[str]) -> DataFrame:
        """The rows of some terms; their shards are found first, so that only these folders are read."""
        one = self.spark.createDataFrame([(x,) for x in terms], "t string")
        shards = sorted({r[0] for r in one.select(self.shard_of(F.col("t"))).collect()})
        return df.where(F.col("Shard").isin(shards) & F.col("Term").isin(terms))

    def search(self, query: str, shortest: int = 3) -> DataFrame:
        """``Id``, ``Day`` and ``Score`` of the records that have any word of the query, of ``shortest`` characters or more: the sum over
        the words of frequency times the squared log10(records / records with the word)."""
        wanted = words_of(query, shortest)
        found = self._of(self._read("postings", POSTINGS), wanted)
        has = self._of(self._read("frequencies", FREQUENCIES), wanted).groupBy("Term").agg(F.sum("Records").alias("has"))
        n = self._read("totals", TOTALS).agg(F.sum("Records").alias("n")).scalar()
        weight = F.size("Positions") * F.pow(F.log10(n / F.col("has")), F.lit(2))
        return found.join(has, "Term").withColumn("w", weight).groupBy("Id", "Day").agg(F.sum("w").alias("Score"))

    def phrase(self, phrase: str) -> DataFrame:
        """``Id``, ``Day`` and ``Places`` (word numbers at which the phrase begins) of the records whose words hold the phrase's in a row.
        A word's postings are moved back by its place in the phrase; where all places meet, the phrase begins."""
        wanted = regex.findall(WORD, phrase.lower())
        if not wanted:
            raise ValueError("the phrase has no word")
        places = self.spark.createDataFrame(list(enumerate(wanted)), "place int, Term string")
        found = self._of(self._read("postings", POSTINGS), sorted(set(wanted))).join(F.broadcast(places), "Term")  # one row for each word of the phrase
        starts = found.select("Id", "Day", "place", F.explode("Positions").alias("at")).withColumn("start", F.col("at") - F.col("place"))
        whole = starts.groupBy("Id", "Day", "start").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted))
        return whole.groupBy("Id", "Day").agg(F.array_sort(F.collect_list("start")).alias("Places"))


def matching(records: DataFrame, found: DataFrame) -> DataFrame:
    """The log records of a search's result, with its other columns."""
    return records.join(found.drop("Day"), "Id")
