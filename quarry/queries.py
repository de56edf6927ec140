"""Registered queries: statements of the dialect over the driver's tables, and the SQL that checks them.

Each query runs through the parser, binder and compiler. The checking SQL spells out what
the dialect implies: NULL is the largest value, integer sums are bigint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.query import build
from .plans.binder import bind
from .plans.parser import parse

#: name: (statement, checking SQL or None where the statement itself serves)
STATEMENTS: dict[str, tuple[str, str | None]] = {
    "q1_scan_agg": ("SELECT COUNT(*), SUM(l_orderkey) FROM lineitem", "SELECT COUNT(*) AS count, SUM(l_orderkey)::BIGINT AS sum_l_orderkey FROM lineitem"),
    "q2_time_window": (
        "SELECT COUNT(*), SUM(user_id) FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-08'",
        "SELECT COUNT(*) AS count, SUM(user_id)::BIGINT AS sum_user_id FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-08'",
    ),
    "q3_filter_agg": (
        "SELECT COUNT(*), SUM(user_id) FROM events WHERE event_type = 'click'",
        "SELECT COUNT(*) AS count, SUM(user_id)::BIGINT AS sum_user_id FROM events WHERE event_type = 'click'",
    ),
    "q4_low_card_group": (
        "SELECT l_returnflag, l_linestatus, COUNT(*), SUM(l_orderkey) FROM lineitem GROUP BY l_returnflag, l_linestatus ORDER BY COUNT(*) DESC, l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS count, SUM(l_orderkey)::BIGINT AS sum_l_orderkey FROM lineitem GROUP BY ALL",
    ),
    "q5_high_card_group": (
        "SELECT user_id, COUNT(*) FROM events WHERE event_type = 'view' GROUP BY user_id ORDER BY COUNT(*) DESC, user_id LIMIT 50",
        "SELECT user_id, COUNT(*) AS count FROM events WHERE event_type = 'view' GROUP BY user_id ORDER BY count DESC, user_id LIMIT 50",
    ),
    "q6_filter_group_topn": (
        "SELECT event_type, user_id, COUNT(*), SUM(event_id), AVG(event_id) FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND event_type IN ('click', 'view', 'purchase') AND value > 0 GROUP BY event_type, user_id ORDER BY COUNT(*) DESC, event_type, user_id LIMIT 20",
        "SELECT event_type, user_id, COUNT(*) AS count, SUM(event_id)::BIGINT AS sum_event_id, AVG(event_id) AS avg_event_id FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND event_type IN ('click', 'view', 'purchase') AND value > 0 GROUP BY ALL ORDER BY count DESC, event_type, user_id LIMIT 20",
    ),
    "q7_string_in": ("SELECT COUNT(*) FROM events WHERE event_type IN ('purchase', 'signup')", "SELECT COUNT(*) AS count FROM events WHERE event_type IN ('purchase', 'signup')"),
    "q8_narrow": ("SELECT event_id, ts, event_type FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 20", None),
    "q8_wide": ("SELECT * FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 20", None),
    **{
        f"f_cmp_{name}": (f"SELECT COUNT(*) FROM lineitem WHERE l_linenumber {op} 3", f"SELECT COUNT(*) AS count FROM lineitem WHERE l_linenumber {op} 3")
        for name, op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="))
    },
    "f_lit_left": ("SELECT COUNT(*) FROM lineitem WHERE 3 < l_linenumber", "SELECT COUNT(*) AS count FROM lineitem WHERE 3 < l_linenumber"),
    "f_fraction_on_int": ("SELECT COUNT(*) FROM lineitem WHERE l_linenumber > 1.5", "SELECT COUNT(*) AS count FROM lineitem WHERE l_linenumber > 1.5::DOUBLE"),
    "f_double": ("SELECT COUNT(*) FROM lineitem WHERE l_discount >= 0.05", "SELECT COUNT(*) AS count FROM lineitem WHERE l_discount >= 0.05::DOUBLE"),
    "f_string_range": ("SELECT COUNT(*) FROM customer WHERE c_mktsegment > 'B' AND c_mktsegment <= 'H'", "SELECT COUNT(*) AS count FROM customer WHERE c_mktsegment > 'B' AND c_mktsegment <= 'H'"),
    "f_negative": ("SELECT COUNT(*) FROM customer WHERE c_acctbal < -100", "SELECT COUNT(*) AS count FROM customer WHERE c_acctbal < -100"),
    "f_epoch_ms": ("SELECT COUNT(*) FROM events WHERE ts >= 1704672000000", "SELECT COUNT(*) AS count FROM events WHERE ts >= TIMESTAMP '2024-01-08'"),
    "f_col_col": ("SELECT COUNT(*) FROM lineitem WHERE l_partkey > l_suppkey", "SELECT COUNT(*) AS count FROM lineitem WHERE l_partkey > l_suppkey"),
    "f_and_or_not": (
        "SELECT event_id FROM events WHERE NOT (event_type = 'click') AND (user_id < 10 OR value > 90) AND NOT event_type = 'view'",
        None,
    ),
    "f_is_null": ("SELECT COUNT(*) FROM documents WHERE lang IS NULL", "SELECT COUNT(*) AS count FROM documents WHERE lang IS NULL"),
    "f_is_not_null": ("SELECT COUNT(*) FROM documents WHERE lang IS NOT NULL", "SELECT COUNT(*) AS count FROM documents WHERE lang IS NOT NULL"),
    "f_in": ("SELECT event_id FROM events WHERE user_id IN (1, 2, 3, NULL)", None),
    "f_not_in": ("SELECT event_id FROM events WHERE user_id NOT IN (1, 2, 3)", None),
    "f_not_in_null": ("SELECT event_id FROM events WHERE user_id NOT IN (1, NULL)", None),
    "f_between": ("SELECT event_id, value FROM events WHERE value BETWEEN 10 AND 20", None),
    "f_not_between": ("SELECT event_id, value FROM events WHERE value NOT BETWEEN 10 AND 90", None),
    "f_const_false": ("SELECT event_id FROM events WHERE FALSE", None),
    "f_const_true": ("SELECT COUNT(*) FROM events WHERE TRUE OR event_id = 1", "SELECT COUNT(*) AS count FROM events"),
    "f_null_predicate": ("SELECT event_id FROM events WHERE event_id > NULL", None),
    "agg_five": (
        "SELECT COUNT(*), COUNT(l_quantity), SUM(l_linenumber), AVG(l_linenumber), MIN(l_quantity), MAX(l_quantity) FROM lineitem",
        "SELECT COUNT(*) AS count, COUNT(l_quantity) AS count_l_quantity, SUM(l_linenumber)::BIGINT AS sum_l_linenumber, AVG(l_linenumber) AS avg_l_linenumber, MIN(l_quantity) AS min_l_quantity, MAX(l_quantity) AS max_l_quantity FROM lineitem",
    ),
    "agg_min_max_str": ("SELECT MIN(c_name), MAX(c_mktsegment) FROM customer", "SELECT MIN(c_name) AS min_c_name, MAX(c_mktsegment) AS max_c_mktsegment FROM customer"),
    "agg_min_max_int32": ("SELECT MIN(p_size), MAX(p_size) FROM part", "SELECT MIN(p_size) AS min_p_size, MAX(p_size) AS max_p_size FROM part"),
    "agg_min_max_ts": ("SELECT MIN(ts), MAX(ts) FROM events", "SELECT MIN(ts) AS min_ts, MAX(ts) AS max_ts FROM events"),
    "agg_min_max_double": ("SELECT MIN(o_totalprice), MAX(o_totalprice) FROM orders", "SELECT MIN(o_totalprice) AS min_o_totalprice, MAX(o_totalprice) AS max_o_totalprice FROM orders"),
    "agg_empty_scalar": (
        "SELECT COUNT(*), COUNT(value), SUM(user_id), AVG(value), MIN(ts) FROM events WHERE event_id < 0",
        "SELECT COUNT(*) AS count, COUNT(value) AS count_value, SUM(user_id)::BIGINT AS sum_user_id, AVG(value) AS avg_value, MIN(ts) AS min_ts FROM events WHERE event_id < 0",
    ),
    "agg_empty_group": (
        "SELECT event_type, COUNT(*), MAX(ts) FROM events WHERE event_id < 0 GROUP BY event_type",
        "SELECT event_type, COUNT(*) AS count, MAX(ts) AS max_ts FROM events WHERE event_id < 0 GROUP BY event_type",
    ),
    "agg_group_int32": (
        "SELECT n_regionkey, COUNT(*), MIN(n_name) FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, COUNT(*) AS count, MIN(n_name) AS min_n_name FROM nation GROUP BY n_regionkey",
    ),
    "agg_keys_only": ("SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority", None),
    "sort_hidden_col": ("SELECT event_id FROM events ORDER BY user_id DESC, event_id LIMIT 25", None),
    "topn_ties": ("SELECT c_custkey, c_nationkey FROM customer ORDER BY c_nationkey, c_custkey DESC LIMIT 40", None),
    "limit_zero": ("SELECT event_id FROM events LIMIT 0", None),
    "select_all": ("SELECT ALL r_regionkey, r_name FROM region", "SELECT r_regionkey, r_name FROM region"),
    "star_and_column": ("SELECT *, r_name FROM region", "SELECT r_regionkey, r_name, r_name AS r_name_2 FROM region"),
    "alias_plain": ("SELECT n_name AS nation_name, n_regionkey region FROM nation WHERE n_regionkey >= 2", None),
    "alias_order": (
        "SELECT l_returnflag AS flag, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag ORDER BY n DESC, flag LIMIT 2",
        "SELECT l_returnflag AS flag, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag ORDER BY n DESC, flag LIMIT 2",
    ),
    "dup_output_names": (
        "SELECT COUNT(*), COUNT(*), SUM(user_id), SUM(event_id) AS sum_user_id FROM events",
        "SELECT COUNT(*) AS count, COUNT(*) AS count_2, SUM(user_id)::BIGINT AS sum_user_id, SUM(event_id)::BIGINT AS sum_user_id_2 FROM events",
    ),
    "f_lit_lit": ("SELECT COUNT(*) FROM events WHERE 2 > 1 AND 'a' <> 'b' AND NOT 1.5 >= 2", "SELECT COUNT(*) AS count FROM events WHERE 2 > 1 AND 'a' <> 'b' AND NOT 1.5 >= 2"),
    "f_lit_lit_false": ("SELECT event_id FROM events WHERE 2 < 1 OR TIMESTAMP '2024-01-02' < TIMESTAMP '2024-01-01'", "SELECT event_id FROM events WHERE 2 < 1"),
    "limit_beyond": ("SELECT event_id FROM events WHERE event_type = 'click' LIMIT 1000000", "SELECT event_id FROM events WHERE event_type = 'click'"),
    "quoted_names": ('SELECT "event_type" AS "Type -- ""x""", "user_id" FROM "events" WHERE "event_type" <> \'it\'\'s\' ORDER BY event_id LIMIT 9;', 'SELECT event_type AS "Type -- ""x""", user_id FROM events ORDER BY event_id LIMIT 9'),
}


def statement(sql: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """A query callable; no footer is read, and the schema comes from Spark's own reader."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tree = parse(sql)
        df = spark.read.parquet(f"{sf_dir}/{tree.table}.parquet")
        if prepare is not None:
            df = prepare(df)
        return build(df, bind(tree, df.schema))

    return run


def _some_nulls(df: DataFrame) -> DataFrame:
    """The driver's tables have no NULLs, so some values become NULL."""
    return df.withColumn("event_type", F.nullif("event_type", F.lit("click"))).withColumn("value", F.when(F.col("user_id") % 7 != 0, F.col("value")))


_NULLS = "(SELECT * REPLACE (NULLIF(event_type, 'click') AS event_type, CASE WHEN user_id % 7 <> 0 THEN value END AS value) FROM events)"
#: Over events with NULLs; {t} stands for the table.
WITH_NULLS: dict[str, tuple[str, str]] = {
    "null_group_key": ("SELECT event_type, COUNT(*), COUNT(value), MIN(value) FROM {t} GROUP BY event_type", "SELECT event_type, COUNT(*) AS count, COUNT(value) AS count_value, MIN(value) AS min_value FROM {t} GROUP BY event_type"),
    "null_comparison": ("SELECT event_id FROM {t} WHERE NOT (event_type = 'view') OR value > 50", "SELECT event_id FROM {t} WHERE NOT (event_type = 'view') OR value > 50"),
    "null_in": ("SELECT event_id FROM {t} WHERE event_type NOT IN ('view')", "SELECT event_id FROM {t} WHERE event_type NOT IN ('view')"),
    "sort_nulls_last": ("SELECT event_id, event_type, value FROM {t} ORDER BY event_type, value, event_id LIMIT 2000", "SELECT event_id, event_type, value FROM {t} ORDER BY event_type ASC NULLS LAST, value ASC NULLS LAST, event_id LIMIT 2000"),
    "sort_nulls_first": ("SELECT event_id, event_type, value FROM {t} ORDER BY event_type DESC, value DESC, event_id LIMIT 2000", "SELECT event_id, event_type, value FROM {t} ORDER BY event_type DESC NULLS FIRST, value DESC NULLS FIRST, event_id LIMIT 2000"),
}


def _more_types(df: DataFrame) -> DataFrame:
    """The driver's tables have no booleans and no float32."""
    even = F.when(F.col("user_id") % 5 != 0, F.col("user_id") % 2 == 0)
    return df.withColumn("even", even).withColumn("small", F.col("value").cast("float"))


_TYPES = "(SELECT *, CASE WHEN user_id % 5 <> 0 THEN user_id % 2 = 0 END AS even, value::FLOAT AS small FROM events)"
#: Over events with a boolean column that has NULLs and a float32 column.
WITH_TYPES: dict[str, tuple[str, str]] = {
    "f_bool_column": ("SELECT event_id FROM {t} WHERE even", "SELECT event_id FROM {t} WHERE even"),
    "f_not_bool_column": ("SELECT event_id FROM {t} WHERE NOT even OR event_id < 5", "SELECT event_id FROM {t} WHERE NOT even OR event_id < 5"),
    "f_bool_compare": ("SELECT COUNT(*) FROM {t} WHERE even <> FALSE", "SELECT COUNT(*) AS count FROM {t} WHERE even <> FALSE"),
    **{
        f"f_float32_{name}": (f"SELECT event_id FROM {{t}} WHERE small {op} 50.25", f"SELECT event_id FROM {{t}} WHERE small::DOUBLE {op} 50.25::DOUBLE")
        for name, op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="))
    },
    "f_float32_between": ("SELECT event_id, small FROM {t} WHERE small BETWEEN 10 AND 20.5", "SELECT event_id, small FROM {t} WHERE small::DOUBLE BETWEEN 10::DOUBLE AND 20.5::DOUBLE"),
    "agg_min_max_bool": ("SELECT MIN(even), MAX(even), COUNT(even) FROM {t}", "SELECT MIN(even) AS min_even, MAX(even) AS max_even, COUNT(even) AS count_even FROM {t}"),
    "agg_group_bool": ("SELECT even, COUNT(*), MAX(small) FROM {t} GROUP BY even", "SELECT even, COUNT(*) AS count, MAX(small) AS max_small FROM {t} GROUP BY even"),
}


def _laid(spark: SparkSession, sf_dir: str, by: str):
    """An engine over events written anew in eight files by ranges of a column, with several row groups each where they are large."""
    from .engine import Engine
    from .session import scratch

    folder = scratch(spark, "layout")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    laid = events.repartitionByRange(8, by, "event_id").sortWithinPartitions(by, "event_id")
    laid.write.option("parquet.block.size", 16384).option("parquet.page.size", 4096).parquet(f"{folder}/events.parquet")
    return Engine(spark, folder)


def catalog_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the catalog says of events.ts, from the footers of a table laid out by ts and of one laid out by user."""
    rows = []
    for by in ("ts", "user_id"):
        table = _laid(spark, sf_dir, by).catalog["events"]
        rows.append((by, table.rows, table.group_count >= 8, table.clustering("ts")[0]))
    schema = T.StructType([T.StructField("laid_by", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("many_groups", T.BooleanType()), T.StructField("clustered", T.BooleanType())])
    return spark.createDataFrame(rows, schema)


def catalog_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.catalog import Catalog

    low, high = Catalog(spark, sf_dir)["events"].time_range_ms("ts")
    return spark.createDataFrame([(low, high)], "min_ts_ms long, max_ts_ms long")


def _window(spark: SparkSession, sf_dir: str, scan: str) -> DataFrame:
    """q2 over a table laid out by ts, with whether files and row groups were left out by their footers."""
    from .engine import Options

    engine = _laid(spark, sf_dir, "ts")
    q = engine.bind(STATEMENTS["q2_time_window"][0])
    kept = engine.kept(q, engine.catalog["events"])
    out = engine.frame(q, Options(scan=scan))
    return out.withColumn("files_skipped", F.lit(0 < len(kept.files) < 8)).withColumn("groups_skipped", F.lit(0 < kept.count < kept.total))


def skipping_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window(spark, sf_dir, "auto")


def rowgroup_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window(spark, sf_dir, "rowgroup")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import surface_queries

    out = surface_queries.QUERIES | {name: statement(sql) for name, (sql, _) in STATEMENTS.items()}
    out |= {name: statement(sql.format(t="events"), _some_nulls) for name, (sql, _) in WITH_NULLS.items()}
    out |= {name: statement(sql.format(t="events"), _more_types) for name, (sql, _) in WITH_TYPES.items()}
    return out | {"cat_clustering": catalog_clustering, "cat_ts_range": catalog_time_range, "scan_zone_map": skipping_scan_query, "scan_row_groups": rowgroup_scan_query}


def oracle_sql() -> dict[str, str]:
    from . import surface_queries

    out = surface_queries.oracle_sql() | {name: check or sql for name, (sql, check) in STATEMENTS.items()}
    out |= {name: check.format(t=_NULLS) for name, (_, check) in WITH_NULLS.items()}
    out |= {name: check.format(t=_TYPES) for name, (_, check) in WITH_TYPES.items()}
    window = f"SELECT *, TRUE AS files_skipped, TRUE AS groups_skipped FROM ({STATEMENTS['q2_time_window'][1]})"
    return out | {
        "cat_clustering": "SELECT 'ts' AS laid_by, COUNT(*) AS rows, TRUE AS many_groups, TRUE AS clustered FROM events UNION ALL SELECT 'user_id', COUNT(*), TRUE, FALSE FROM events",
        "cat_ts_range": "SELECT epoch_us(MIN(ts)) // 1000 AS min_ts_ms, epoch_us(MAX(ts)) // 1000 AS max_ts_ms FROM events",
        "scan_zone_map": window,
        "scan_row_groups": window,
    }
