"""The tables of the memory store, made from the tables of a data folder, and where the same comes from in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remembra.functions.scoring import default_importance
from remembra.schemas import DEFAULT_IMPORTANCE, TYPES

#: The time at which the queries look at the store, and the first row's time.
AS_OF, START = "2024-06-01 00:00:00", "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files_of(spark: SparkSession, sf_dir: str, *names: str) -> tuple[tuple[str, int, int], ...]:
    """The files of tables with their lengths and times, by which what was made of them is known to be theirs still."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    out = []
    for name in names:
        at = path(f"{sf_dir}/{name}.parquet")
        out += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]
    return tuple(sorted(out))


def moment(text: str = AS_OF):
    """A timestamp in UTC, whatever the session's zone."""
    return F.to_timestamp(F.lit(f"{text}+00:00"), "yyyy-MM-dd HH:mm:ssXXX")


def _micros(base: str, seconds):
    return F.timestamp_micros(F.unix_micros(moment(base)) + seconds * 1_000_000)


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and labels as memories: times, types and counts follow from the doc_id."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    number = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("doc_id") % len(TYPES) + 1).cast("int"))
    created = F.col("doc_id") % 720 * 3600
    importance = default_importance(F.col("type")) + F.when(F.col("quality") == 1, 0.1).otherwise(0.0) - F.when(F.col("toxic") == 1, 0.2).otherwise(0.0)
    return (
        docs.withColumn("type", kind)
        .withColumn("importance", F.greatest(F.lit(0.0), F.least(F.lit(1.0), importance)))
        .select(
            F.col("doc_id").alias("id"),
            F.col("text").alias("content"),
            F.when(number % 2 == 0, F.concat(F.lit("projects/"), F.col("source"))).otherwise(F.col("source")).alias("namespace"),
            "type",
            "importance",
            "source",
            F.array("lang", "source").alias("tags"),
            _micros(START, created).alias("created_at"),
            _micros(START, created + F.col("doc_id") * 7 % 90 * 86400).alias("accessed_at"),
            (F.col("doc_id") % 20).cast("long").alias("access_count"),
        )
    )


def case_sql(table_: dict[str, float], default: float) -> str:
    return "CASE type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table_.items()) + f" ELSE {default}::DOUBLE END"


#: DuckDB: the CTE `memories`, to be followed by a comma or a SELECT.
MEMORIES_SQL = f"""WITH typed AS (
 SELECT d.*, list_extract([{", ".join(f"'{t}'" for t in TYPES)}], (d.doc_id % {len(TYPES)} + 1)::INT) AS type, l.quality, l.toxic
 FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id),
memories AS (
 SELECT doc_id AS id, text AS content,
  CASE WHEN TRY_CAST(regexp_extract(source, '[0-9]+') AS INT) % 2 = 0 THEN 'projects/' || source ELSE source END AS namespace,
  type,
  greatest(0::DOUBLE, least(1::DOUBLE, {case_sql(DEFAULT_IMPORTANCE, 0.5)} + CASE WHEN quality = 1 THEN 0.1::DOUBLE ELSE 0::DOUBLE END - CASE WHEN toxic = 1 THEN 0.2::DOUBLE ELSE 0::DOUBLE END)) AS importance,
  source, [lang, source] AS tags,
  TIMESTAMP '{START}' + to_seconds(doc_id % 720 * 3600) AS created_at,
  TIMESTAMP '{START}' + to_seconds(doc_id % 720 * 3600 + doc_id * 7 % 90 * 86400) AS accessed_at,
  (doc_id % 20)::BIGINT AS access_count
 FROM typed)"""
#: DuckDB: days from a timestamp column to AS_OF.
DAYS_SQL = f"((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us({{}})) / 86400000000::DOUBLE)"
