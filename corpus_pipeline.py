"""A corpus from raw documents: good ones, one of each near-duplicate group, without benchmark text, mixed, sharded.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``docs``.

Rows that are equal in all columns cannot be told apart, so a stage decides how many of them go on. Null ids, texts and
sources, empty tables and further columns are kept as the operators define it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barvault.llm import decontaminate, mixing, quality, sharding, simhash
from barvault.llm.support import free_name, quoted, row_key, table, values_of
from barvault.session import materialise

KEY, TEXT, SOURCE = "doc_id", "text", "source"

# The classifier's fit, the fingerprints and the knapsack are not expressible in SQL.
ORACLE_SQL = None


def _apply(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """``docs`` after decisions (row_id, rows, copies): of ``rows`` equal rows, ``copies`` go on."""
    own, base, fold = free_name(docs, "row_id"), free_name(docs, "copies"), free_name(docs, "fold")
    columns = [F.col(quoted(c)) for c in docs.columns]
    decided = decisions.where("copies > 0").select(F.col("row_id").alias(own), "rows", F.col("copies").alias(base))
    decided = materialise(decided)
    each = decided.select(own, F.floor(F.col(base) / F.col("rows")).cast("int").alias(base)).where(F.col(base) > 0)
    marked = docs.withColumn(own, row_key(*values_of(docs)))
    kept = marked.join(each, own).select(*columns, F.explode(F.array_repeat(F.lit(0), F.col(base))).alias(base))
    kept = kept.select(*columns)
    rest = decided.select(own, (F.col(base) % F.col("rows")).cast("int").alias(base)).where(F.col(base) > 0)
    if rest.isEmpty():
        return kept
    # Some of equal rows. The wrapped key makes Spark fold them within tasks before they are shuffled once more, so that
    # a row repeated very often is few rows there.
    alike = marked.join(rest, own).groupBy(F.struct(own, base).alias(fold)).agg(F.first(F.struct(*columns)).alias(own))
    again = alike.select(f"{own}.*", F.explode(F.array_repeat(F.lit(0), F.col(f"{fold}.{base}"))).alias(fold))
    return kept.union(again.select(*columns))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier selects.

    Null and empty texts weigh as 1 does; ties of the ranking go by doc_id, null last; equal rows share their fate as far
    as the number selected allows; without labels all stay. An empty table stays empty.
    """
    chosen = quality.resample(docs, table(spark, sf_dir, "labels"), KEY, TEXT, identity=values_of(docs))
    counts = chosen.groupBy("row_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if("selected").alias("copies"))
    return _apply(docs, counts)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near fingerprints: the one with the least doc_id, null last.

    Of equal rows one stays. Documents without words, null texts included, are one group. An empty table stays empty.
    """
    found = simhash.near_duplicates(docs, KEY, TEXT, identity=values_of(docs))
    sizes = found.groupBy("group", "row_id", KEY).agg(F.count(F.lit(1)).alias("rows"))
    first = F.struct(F.col(KEY).isNull().alias("unnamed"), KEY, "row_id", "rows")
    least = sizes.groupBy("group").agg(F.min(first).alias("first"))
    return _apply(docs, least.select("first.row_id", "first.rows", F.lit(1).alias("copies")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no span with a benchmark item; null and empty texts share none, equal rows go together.

    Without benchmark items all stay. An empty table stays empty.
    """
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), KEY, TEXT, identity=values_of(docs))
    counts = found.where("n_hit = 0").groupBy("row_id").agg(F.count(F.lit(1)).alias("rows"))
    return _apply(docs, counts.withColumn("copies", F.col("rows")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; documents without words, null texts included, go.

    Null sources are one source, ties among documents go by the operator's seeded order. An empty table stays empty.
    """
    taken = mixing.mix_sources(docs, KEY, TEXT, SOURCE, identity=values_of(docs)).where("taken > 0")
    counts = taken.groupBy("row_id").agg(F.sum(F.col("taken") / F.col("size")).cast("bigint").alias("copies"))
    rows = docs.groupBy(row_key(*values_of(docs)).alias("row_id")).agg(F.count(F.lit(1)).alias("rows"))
    return _apply(docs, rows.join(counts, "row_id"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard; all copies of one share it. A null doc_id is placed by its text."""
    return sharding.assign_shards(docs, KEY, TEXT)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_one_of_group),
    ("benchmark decontamination", drop_contaminated),
    ("mixing to target weights", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
