"""The corpus pipeline: five stages over whole documents, each written as Parquet and read again as the next one's input.

1. quality: documents that the quality classifier rejects go (score below 0.3; random-indexing vectors of all documents, labels of the training split).
2. toxicity: documents that the pattern grammar rejects go (score of 0.7 or more).
3. near_duplicates: of each group of near-duplicates (five-word shingles, similarity 0.8), the document of the smallest id stays.
4. decontamination: documents that hold a window of eight consecutive words of any benchmark item go.
5. tokens: the rest is encoded by the SentencePiece merge table.

All stages but the last return the columns they got, whatever their names. Stages decide row by row: texts alone decide in stages 1, 2 and 4, so rows with null or repeated ids are judged like others there. In stage 3 a row
with a null id counts as one of the largest id, and of rows that are equal in id and text one stays, that of the smallest hash of its other columns. Null and empty texts are never near-duplicates
but of rows with the same id, hold no window of a benchmark item and give the end id alone. Texts are read whole, however long. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemill.llm import common, decontam, neardup, quality, spiece, toxicity


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.ship(spark)
    return quality.good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.ship(spark)
    return toxicity.harmless(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.ship(spark)
    ids = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    if ids.isEmpty():
        found = common.stored(neardup.near_duplicates(docs, width=5, percent=80), "near-duplicates")
        return common.without(docs, found.where("NOT kept").select("doc_id"), "doc_id")
    # Ids that are null or repeat name no row: then id and text together do, in the order of the ids.
    key, text = common.free("_key", docs.columns), F.md5(F.coalesce("text", F.lit("")))
    number = F.concat(F.lit("0"), F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")) if docs.schema["doc_id"].dataType.typeName() in ("long", "integer", "short", "byte") else F.concat(F.lit("0"), F.col("doc_id").cast("string"), F.lit(" "))
    keyed = docs.withColumn(key, F.concat(F.coalesce(number, F.lit("1")), text))
    found = common.stored(neardup.near_duplicates(keyed, width=5, percent=80, id_col=key), "near-duplicates")
    left = common.without(keyed, found.where("NOT kept").select(key), key)
    again = common.free("_again", docs.columns)
    twice = common.stored(found.where("kept").groupBy(key).count().where("count > 1").select(F.col(key).alias(again)), "repeated")
    repeated = left.join(twice, F.col(key) == F.col(again), "left_semi")
    one = repeated.groupBy(key).agg(F.min_by(F.struct(*[common.quoted(c) for c in docs.columns]), F.xxhash64(*[common.quoted(c) for c in docs.columns])).alias("row")).select("row.*")
    return common.without(left, twice, key).select(*[common.quoted(c) for c in docs.columns]).unionByName(one)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.ship(spark)
    key = common.free("_key", docs.columns)
    keyed = docs.withColumn(key, F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    found = decontam.decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key, min_items=1)
    return common.without(keyed, found.where("contaminated").select(key), key).drop(key)


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.ship(spark)
    return spiece.encode(docs, spiece.default_model(), decoded=False)


STAGES = [
    ("quality", _quality),
    ("toxicity", _toxicity),
    ("near_duplicates", _near_duplicates),
    ("decontamination", _decontamination),
    ("tokens", _tokens),
]

#: Trained scores, a similarity join and a tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
        common.drop(before)
    return docs
