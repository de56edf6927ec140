"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing and packing.

Each stage takes what its predecessor kept, as written to Parquet and read again,
and works on all of it. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import langid, mixing, naming, nearcopies, packing
from quarry.llm.common import materialise, placed
from quarry.llm.queries import END_ID, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of rows that a Python worker gets at once. Spark's own bound is 10,000 rows, however long their texts.
BATCH_BYTES = 4 << 20
#: SQL for run()'s rows: model training, components and token ids can't be expressed in it.
ORACLE_SQL = None


def _bound_batches(spark: SparkSession) -> None:
    """Bound what goes to Python workers by bytes, unless the session already does. It holds for frames that run later, so it stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that language identification rejects: null texts, texts without
    letters, and texts that no learned language explains. Rows repeat as they do in `docs`; a row
    without lang or doc_id is judged like any other; extra columns are left out; an empty table gives none."""
    _bound_batches(spark)
    model = langid.fit(docs)
    if not model.langs:
        # Without one labelled text nothing can be judged; only texts without letters are rejected.
        return langid.identify(docs, model, COLUMNS).filter(F.col("text").rlike(r"\p{L}")).select(COLUMNS)
    return langid.identify(docs, model, COLUMNS).filter("not rejected").select(COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, keep the one with the largest doc_id.

    A null text equals an empty one; a null doc_id is the smallest, and of rows equal in text and
    doc_id the last in file order stays. Extra columns are left out; an empty table gives none.
    """
    _bound_batches(spark)
    return _without(docs, lambda rows: naming.groups(rows, row="row_").filter("not kept").select("rid"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more, keep the one with the smallest doc_id (a null one only among nulls).

    Similarity is that of sets of five-word shingles; a text of fewer words is one shingle, and null
    and empty texts are alike. Of rows that share the smallest doc_id the first in file order
    stays. Extra columns are left out; an empty table gives none.
    """

    def others(rows: DataFrame) -> DataFrame:
        found = nearcopies.components(rows, "row_")
        members = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
        members = materialise(members.join(rows.select("row_", "doc_id"), F.col("node") == F.col("row_")).select("root", "row_", "doc_id"), "near-copies")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_")).alias("first")
        stays = materialise(members.groupBy("root").agg(first).select("root", F.col("first.row_").alias("stays")), "near-firsts")
        return members.join(stays, "root").filter("row_ <> stays").select(F.col("row_").alias("rid"))

    _bound_batches(spark)
    return _without(docs, others)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources' words meet their targets.

    Null sources are one source; null and empty texts have no words and about one copy; repeated
    rows are mixed one by one. Extra columns are left out; an empty table gives none.
    """
    rows = placed(docs.select(COLUMNS), "row_")
    copies = materialise(mixing.mix(rows, row="row_").filter("copies > 0").select(F.col("row").alias("rid"), "copies"), "mix-copies")
    # Copies are as many as documents, so they are never broadcast: the plan is the same at every size.
    joined = rows.join(copies.hint("merge"), F.col("row_") == F.col("rid"))
    return joined.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_")).drop("copy_")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, with their token ids as a checksum.

    A null or empty text is the end id alone; a null doc_id stays null; repeated rows are packed one
    by one. Extra columns are left out; an empty table gives none.
    """
    _bound_batches(spark)
    pieces = packing.pack(docs, vocabulary(), end_id=END_ID)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def _without(docs: DataFrame, choose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All rows but those that `choose` names, of which there are few: Spark broadcasts their
    numbers while they are within its size limit and merges beyond it. A row's number is its place
    in the files, so both scans agree on it."""
    rows = placed(docs.select(COLUMNS), "row_")
    dropped = materialise(choose(rows), "dropped-rows")
    return rows.join(dropped, F.col("row_") == F.col("rid"), "left_anti").select(COLUMNS)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`; what a stage returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
