"""Exact dedup against a persistent digest index, bucketed and sorted by digest.

New rows are reduced to one row per digest (map-side first, so a group of copies of any size
costs one row per task), joined to the index by a sort-merge anti-join, and the digests that
are new are appended. The index lives at a path, so later runs open it again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, scratch_dir, staged, unused

COLUMNS = "digest BINARY, keep_id BIGINT, keep_row BIGINT, group_size BIGINT, run STRING"


def digests(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, row (number of the input row, or the column of that name), digest, n_points; text
    is read once.

    The digest is SHA-256 of the text without ``[\\x20\\x09-\\x0D]``; null counts as empty.
    """
    number = F.col(row) if row else F.monotonically_increasing_id()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), number.alias("row"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        "row",
        F.unhex(F.sha2(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", ""), 256)).alias("digest"),
        F.char_length(text).alias("n_points"),
    )


class DigestIndex:
    """A table of known digests at ``path``: one row each, clustered and sorted by digest."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({COLUMNS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, found: DataFrame, run: str) -> None:
        """Add the digests of ``found`` (see :func:`digests`) that the index lacks."""
        best = F.max(F.struct("n_points", (-F.col("doc_id")).alias("d"), (-F.col("row")).alias("r"))).alias("best")
        # Written first: Spark would move the anti-join below the sums, and all copies with it.
        groups = staged(found.groupBy("digest").agg(best, F.count(F.lit(1)).alias("group_size")), "digest-groups")
        known = self.table().select("digest").hint("merge")
        new = groups.join(known, "digest", "left_anti").select("digest", (-F.col("best.d")).alias("keep_id"), (-F.col("best.r")).alias("keep_row"), "group_size", F.lit(run).alias("run"))
        new.write.mode("append").insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def dedup(docs: DataFrame, index: DigestIndex, row: str | None = None) -> DataFrame:
    """Every row of ``docs`` with its keeper; the index gains the new digests.

    Columns: doc_id, row, keep_id, group_size, kept, digest. A row is kept if its digest is
    new to the index and of its equals it has the most code points, then the smallest doc_id,
    then (repeated rows) the smallest row number. Null texts count as empty; a null doc_id
    loses against any other; texts of any length are hashed whole; an empty table gives an
    empty result. ``row`` names a column that numbers the rows, if there is one.
    """
    run = uuid.uuid4().hex
    found = staged(digests(docs, row), "digests")
    index.append(found, run)
    known = index.table()
    total = known.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    joined = attach(found, known, "digest", "group_size", total, "k", ("doc_id", "row"))
    kept = (F.col("k.run") == run) & (F.col("k.keep_row") == F.col("row"))
    return joined.select("doc_id", "row", F.col("k.keep_id").alias("keep_id"), F.col("k.group_size").alias("group_size"), kept.alias("kept"), "digest")


def fresh_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the shared folder."""
    return DigestIndex(spark, f"{scratch_dir(spark).rstrip('/')}/digest-index-{uuid.uuid4().hex}")


def keep_first(docs: DataFrame, index: DigestIndex, written: bool = False) -> DataFrame:
    """The rows of ``docs`` that :func:`dedup` keeps, with all their columns, whatever their names.

    The rows are numbered once, in a written table: numbers of a second reading could differ. Say
    ``written`` if ``docs`` reads a written table as it is, which has the same numbers each time.
    """
    number, kept = unused(docs, "__row", "__kept")
    numbered = docs.withColumn(number, F.monotonically_increasing_id())
    numbered = numbered if written else staged(numbered, "numbered")
    stays = dedup(numbered, index, number).where("kept").select(F.col("row").alias(kept))
    return numbered.join(stays, numbered[number] == stays[kept], "left_semi").drop(number)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup(docs, fresh_index(spark)).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM t
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id)
"""
