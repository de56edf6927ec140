"""The registered queries `opN_<name>` and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, langid, mixing, naming, packing, records, sharding, simhash, topk, warc
from .common import materialise

END_ID = 2
HARD_TEXT = r"\### Assistant: </turn> ok"


def vocabulary() -> str:
    """The tokenizer that the queries fix; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(_table(spark, sf_dir, "pages"))
    return read.filter("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    model = langid.fit(docs, ~held_out)
    return langid.identify(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)], "conv_id long, turn long, role string, text string")
    return chat.read_back(materialise(chat.format_turns(turns.unionByName(hard)), "chat"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = {"text_sha256": F.sha2(F.coalesce("text", F.lit("")), 256)}
    return naming.groups(_table(spark, sf_dir, "documents"), keep=keep).drop("rid")


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.pmod("vec_id", F.lit(100)) == 0, 10)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharding.assign(sized, ["source", "lang", "size"], "doc_id", 16, keep=["size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.round_trip(_table(spark, sf_dir, "documents"), vocabulary(), end_id=END_ID)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), vocabulary(), end_id=END_ID)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_language_id": op2_language_id,
        "op3_simhash": op3_simhash,
        "op4_chat_format": op4_chat_format,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_topk_search": op6_topk_search,
        "op7_mixing": op7_mixing,
        "op8_hilbert_shards": op8_hilbert_shards,
        "op9_token_records": op9_token_records,
        "op10_packing": op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": """
            WITH p AS (
                SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages
            ), g AS (
                SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY body) ELSE page_id END AS best FROM p
            )
            SELECT page_id, n AS payload_bytes, sha1(body) AS payload_digest,
                   CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN page_id <> best THEN best END AS refers_to
            FROM g
        """,
        "op4_chat_format": r"""
            WITH t AS (
                SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
                UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
            ), f AS (
                SELECT *, '<|turn|>' || role || chr(10)
                       || replace(replace(text, '\', '\\'), '<|', '\<|') || '<|end|>' || chr(10) AS formatted
                FROM t
            )
            SELECT conv_id, count(*) AS n_turns,
                   sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
                   coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
                   sum(length(formatted))::BIGINT AS formatted_chars
            FROM f GROUP BY conv_id
        """,
        "op5_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
        """,
        "op6_topk_search": """
            WITH v AS (
                SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
                WHERE embedding IS NOT NULL
                  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
            ), s AS (
                SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
                FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.r <> c.r AND len(q.v) = len(c.v)
            ), r AS (
                SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank FROM s
            )
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
        """,
    }
