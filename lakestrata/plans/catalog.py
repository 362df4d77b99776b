"""Registered queries: each operator over whole test tables, with its ANSI SQL twin.

Queries that write use a fresh folder under the session's shared scratch folder and read back what
they stored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestrata.functions.columns import trailing_id, year_of
from lakestrata.functions.plans import estimated_bytes
from lakestrata.layout import BRONZE, GOLD, RAW, SILVER, Layout
from lakestrata.operators.dated import rows_on_day, without_day
from lakestrata.operators.latest import latest_per_key, latest_per_key_agg
from lakestrata.operators.merge import NEWEST_WINS, merge_all
from lakestrata.operators.shape import (
    count_by,
    duplicate_keys,
    explode_bridge,
    id_range,
    ingest_stamp,
    rename_projection,
)
from lakestrata.operators.upsert import merge_into, upsert
from lakestrata.plans import config
from lakestrata.plans.lakehouse import (
    SNAPSHOT,
    Lakehouse,
    append_snapshot,
    delete_day,
    replace_snapshot,
)
from lakestrata.plans.sql import LATEST_SQL, execute_query, run_sql, run_sql_file, share_view
from lakestrata.session import scratch_dir
from lakestrata.sources import fs
from lakestrata.sources.files import (
    CORRUPT,
    infer_schema,
    read_files,
    read_json_checked,
    read_stream,
)
from lakestrata.sources.json_array import write_json_array
from lakestrata.sources.landing import batch_number, land_batch
from lakestrata.sources.tables import Table
from lakestrata.streaming.cdc import start_cdc, start_latest
from lakestrata.streaming.state import start_latest_with_state

Query = Callable[[SparkSession, str], DataFrame]

# Events land in so many batches, by a hash of their type.
TYPE_BATCHES = 6

DAY = "2024-10-04"
NEXT_DAY = "2024-10-05"
AS_OF = "2024-10-04T10:00:00"
SCHEMA = "shop"
EVENT = ["event_id", "ts", "user_id", "event_type", "value", "props"]
ORDER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(run: Query) -> Query:
        _QUERIES[name] = run
        if sql is not None:
            _ORACLES[name] = sql
        return run

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _scratch(spark: SparkSession) -> Lakehouse:
    return Lakehouse(spark, Layout(scratch_dir(spark)))


def _as_read(df: DataFrame, like: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that went through text, in the types they had."""
    return df.select(*[F.col(c).cast(like.schema[c].dataType).alias(c) for c in columns])


def _sql_file(spark: SparkSession, house: Lakehouse, name: str, text: str) -> str:
    path = f"{house.layout.root}/sql/{name}.sql"
    fs.write_text(spark, path, text)
    return path


# Sources and sinks

_ORDERS_SQL = f"SELECT {', '.join(ORDER)} FROM orders"


@_query("raw_batch_load", _ORDERS_SQL)
def _raw_batch_load(spark, sf_dir):
    house, orders = _scratch(spark), _read(spark, sf_dir, "orders")
    house.save(orders, RAW, SCHEMA, "orders", "json")
    return _as_read(house.load(RAW, SCHEMA, "orders", "json"), orders, ORDER)


@_query("raw_csv_load", _ORDERS_SQL)
def _raw_csv_load(spark, sf_dir):
    house, orders = _scratch(spark), _read(spark, sf_dir, "orders").select(*ORDER)
    house.save(orders, RAW, SCHEMA, "orders", "csv", header="true")
    return _as_read(house.load(RAW, SCHEMA, "orders", "csv"), orders, ORDER)


@_query("raw_parquet_load", _ORDERS_SQL)
def _raw_parquet_load(spark, sf_dir):
    house = _scratch(spark)
    house.save(_read(spark, sf_dir, "orders"), RAW, SCHEMA, "orders", "parquet")
    return house.load(RAW, SCHEMA, "orders", "parquet").select(*ORDER)


@_query("raw_orc_load", _ORDERS_SQL)
def _raw_orc_load(spark, sf_dir):
    house = _scratch(spark)
    house.save(_read(spark, sf_dir, "orders"), RAW, SCHEMA, "orders", "orc")
    return house.load(RAW, SCHEMA, "orders", "orc").select(*ORDER)


@_query("raw_text_load", "SELECT props AS value FROM events")
def _raw_text_load(spark, sf_dir):
    house = _scratch(spark)
    house.save(_read(spark, sf_dir, "events").select("props"), RAW, SCHEMA, "props", "text")
    return house.load(RAW, SCHEMA, "props", "text")


@_query("landing_json_array", _ORDERS_SQL)
def _landing_json_array(spark, sf_dir):
    house, orders = _scratch(spark), _read(spark, sf_dir, "orders").select(*ORDER)
    path = house.layout.path(RAW, SCHEMA, "orders")
    land_batch(orders, path, DAY, array_lines=True)
    return read_files(spark, path, "json", orders.schema)


_NOTE = '} , ] "{[ \\'


@_query(
    "landing_long_array",
    """
    SELECT 'stored' AS kind, concat_ws(' ', o_orderkey, o_orderstatus, o_orderpriority) AS record
    FROM orders WHERE o_orderstatus IS DISTINCT FROM 'P'
    UNION ALL
    SELECT 'rejected', '{"o_orderkey":' || o_orderkey || ',"note":oops "} , ] {["}' FROM orders WHERE o_orderstatus = 'P'
    """,
)
def _landing_long_array(spark, sf_dir):
    """All orders in one file that is one array on one line, their notes full of what borders look like.

    Elements of status P are no JSON. One file is written by one task; it is read by as many as it has parts.
    """
    house, orders = _scratch(spark), _read(spark, sf_dir, "orders")
    record = F.to_json(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority", F.lit(_NOTE).alias("note")))
    broken = F.concat(F.lit('{"o_orderkey":'), "o_orderkey", F.lit(',"note":oops "} , ] {["}'))
    element = F.when(F.col("o_orderstatus") == "P", broken).otherwise(record)
    path = house.layout.path(RAW, SCHEMA, "orders")
    write_json_array(orders.select(element), f"{path}/{DAY}_001.json")
    columns = "o_orderkey bigint, o_orderstatus string, o_orderpriority string, note string"
    house.bronze_full_load(SCHEMA, "orders", columns=columns, long_arrays=True)
    kept = F.concat_ws(" ", "o_orderkey", "o_orderstatus", "o_orderpriority").alias("record")
    good = house.load(BRONZE, SCHEMA, "orders").filter(F.col("note") == _NOTE).select(F.lit("stored").alias("kind"), kept)
    bad = house.rejects(SCHEMA, "orders").read().filter("record <> '0'")
    return good.unionByName(bad.select(F.lit("rejected").alias("kind"), "record"))


@_query("bronze_full_load", _ORDERS_SQL)
def _bronze_full_load(spark, sf_dir):
    house, orders = _scratch(spark), _read(spark, sf_dir, "orders")
    land_batch(orders, house.layout.path(RAW, SCHEMA, "orders"), DAY)
    house.bronze_full_load(SCHEMA, "orders")
    return _as_read(house.load(BRONZE, SCHEMA, "orders"), orders, ORDER)


@_query("schema_replace", "SELECT p_partkey, p_name, p_retailprice FROM part")
def _schema_replace(spark, sf_dir):
    house, part = _scratch(spark), _read(spark, sf_dir, "part")
    house.save(part, SILVER, SCHEMA, "part")
    house.save(part.select("p_partkey", "p_name", "p_retailprice"), SILVER, SCHEMA, "part")
    return house.load(SILVER, SCHEMA, "part")


# Batches by the length of a text, those without one among them: a bounded number for any values.
LENGTH_BATCHES = 6


def _by_length(df: DataFrame, column: str, batch: int) -> DataFrame:
    return df.filter(F.coalesce(F.length(column) % LENGTH_BATCHES, F.lit(0)) == batch)


@_query(
    "landing_numbered_batches",
    f"""
    SELECT CAST(b AS INTEGER) AS batch_no, o_orderstatus, count(o_orderkey) AS n
    FROM range(1, {LENGTH_BATCHES} + 1) AS t(b)
    JOIN orders ON coalesce(length(o_orderpriority) % {LENGTH_BATCHES}, 0) = b - 1
    GROUP BY 1, 2
    """,
)
def _landing_numbered_batches(spark, sf_dir):
    """All orders in numbered batches of one day; the statuses they arrive with, none included."""
    house, orders = _scratch(spark), _read(spark, sf_dir, "orders")
    for batch in range(LENGTH_BATCHES):
        house.land(_by_length(orders, "o_orderpriority", batch), SCHEMA, "orders", AS_OF)
    path = house.layout.path(RAW, SCHEMA, "orders")
    raw = read_files(spark, path, "json", "o_orderkey bigint, o_orderstatus string")
    return raw.groupBy(batch_number().alias("batch_no"), "o_orderstatus").agg(F.count("o_orderkey").alias("n"))


@_query(
    "landing_validate", "SELECT event_type = 'error' AS rejected, count(*) AS n FROM events GROUP BY 1"
)
def _landing_validate(spark, sf_dir):
    """Error events land as text that is no JSON object; the read tells both kinds apart."""
    path, events = scratch_dir(spark), _read(spark, sf_dir, "events")
    columns = events.select("event_id", "event_type", "props")
    record = F.to_json(F.struct("*"))
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("!"), record)).otherwise(record)
    columns.select(line.alias("value")).write.text(f"{path}/events.json")
    rejected = F.col(CORRUPT).isNotNull()
    checked = read_json_checked(spark, path, columns.schema)
    return checked.groupBy(rejected.alias("rejected")).agg(F.count(F.lit(1)).alias("n"))


@_query("preview_top_n", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 1000")
def _preview_top_n(spark, sf_dir):
    """The first thousand rows of a stored table."""
    house = _scratch(spark)
    house.save(_read(spark, sf_dir, "events"), GOLD, SCHEMA, "events")
    events = house.load(GOLD, SCHEMA, "events").select("event_id", "event_type")
    return events.orderBy("event_id").limit(1000)


# Projections and SQL transforms

_RENAME_SQL = (
    "SELECT c_custkey AS id_customer, c_name AS customer_name, c_mktsegment AS segment FROM {}"
)


@_query("silver_rename_projection", _RENAME_SQL.format("customer"))
def _silver_rename_projection(spark, sf_dir):
    names = {"c_custkey": "id_customer", "c_name": "customer_name", "c_mktsegment": "segment"}
    return rename_projection(_read(spark, sf_dir, "customer"), names)


@_query(
    "silver_rename_nested",
    """
    SELECT c_custkey AS id_customer, c_name AS name, c_mktsegment AS segment FROM customer
    """,
)
def _silver_rename_nested(spark, sf_dir):
    """A struct passes through under a new name; an array that is not listed goes."""
    house, customer = _scratch(spark), _read(spark, sf_dir, "customer")
    detail = F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    nested = customer.select("c_custkey", detail.alias("origin"), F.array("c_name").alias("links"))
    house.save(nested, BRONZE, SCHEMA, "customer")
    names = {"c_custkey": "id_customer", "origin": "detail"}
    renamed = rename_projection(house.load(BRONZE, SCHEMA, "customer"), names)
    return renamed.select("id_customer", "detail.name", "detail.segment")


@_query("sql_file_transform", _RENAME_SQL.format("customer"))
def _sql_file_transform(spark, sf_dir):
    house = _scratch(spark)
    house.save(_read(spark, sf_dir, "customer"), BRONZE, SCHEMA, "customer")
    house.register(BRONZE, SCHEMA, "customer")
    path = _sql_file(spark, house, "customer", _RENAME_SQL.format("bronze_shop_customer"))
    return run_sql_file(spark, path)


@_query("execute_query", _RENAME_SQL.format("customer"))
def _execute_query(spark, sf_dir):
    _read(spark, sf_dir, "customer").createOrReplaceTempView("shop_customer")
    return execute_query(spark, _RENAME_SQL.format("shop_customer"))


@_query("global_view_query", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def _global_view_query(spark, sf_dir):
    """A view registered here and read from another session of the application."""
    name = share_view(_read(spark, sf_dir, "orders"), "view_orders")
    return spark.newSession().sql(f"SELECT o_orderkey, o_custkey, o_orderstatus FROM {name}")


@_query(
    "id_range_extract",
    """
    SELECT o_orderkey, o_custkey FROM orders
    WHERE o_orderkey BETWEEN (SELECT max(o_orderkey) // 4 FROM orders)
                         AND (SELECT max(o_orderkey) // 2 FROM orders)
    """,
)
def _id_range_extract(spark, sf_dir):
    """The second quarter of the id space; the bounds reach the scan as pushed filters."""
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    top = orders.agg(F.max("o_orderkey")).first()[0]
    return id_range(orders, "o_orderkey", top // 4, top // 2)


@_query("ingest_stamp", f"SELECT o_orderkey, o_custkey, '{AS_OF}' AS updated_at FROM orders")
def _ingest_stamp(spark, sf_dir):
    return ingest_stamp(_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), AS_OF)


@_query(
    "url_trailing_id", r"SELECT page_id, regexp_extract(url, '/(\d+)$', 1) AS trailing_id FROM pages"
)
def _url_trailing_id(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", trailing_id("url").alias("trailing_id"))


def _with_links(lineitem: DataFrame) -> DataFrame:
    """Each line item with the URLs of its order, part and supplier, the last one without an id."""
    urls = F.array(
        F.concat(F.lit("https://h/api/order/"), F.col("l_orderkey")),
        F.concat(F.lit("https://h/api/part/"), F.col("l_partkey")),
        F.concat(F.lit("https://h/api/supplier/"), F.col("l_suppkey"), F.lit("/")),
    )
    return lineitem.select("l_orderkey", "l_linenumber", urls.alias("links"))


_BRIDGE_SQL = """
    SELECT l_orderkey AS id_order, l_linenumber AS line, CAST(l_orderkey AS VARCHAR) AS id_ref
    FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, '' FROM lineitem
"""


@_query("silver_explode_bridge", _BRIDGE_SQL)
def _silver_explode_bridge(spark, sf_dir):
    items = _with_links(_read(spark, sf_dir, "lineitem"))
    kept = {"l_linenumber": "line"}
    return explode_bridge(items, "l_orderkey", "links", "id_order", "id_ref", kept)


@_query("silver_rebuild", _BRIDGE_SQL)
def _silver_rebuild(spark, sf_dir):
    """The same bridge by a SQL file with a common table expression, rebuilding a silver table."""
    house = _scratch(spark)
    house.save(_with_links(_read(spark, sf_dir, "lineitem")), BRONZE, SCHEMA, "items")
    path = _sql_file(
        spark,
        house,
        "item_ref",
        r"""
        WITH refs AS (SELECT l_orderkey, l_linenumber, EXPLODE(links) AS link FROM shop_items)
        SELECT l_orderkey AS id_order, l_linenumber AS line,
               REGEXP_EXTRACT(link, r'/(\d+)$') AS id_ref
        FROM refs
        """,
    )
    house.to_silver(path, SCHEMA, "items")
    return house.load(SILVER, SCHEMA, "item_ref")


# Latest row per key

_LATEST_ORACLE = """
    SELECT event_id, ts, user_id, event_type, value, props FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
"""


@_query("latest_per_key", _LATEST_ORACLE)
def _latest_per_key(spark, sf_dir):
    events = _read(spark, sf_dir, "events")
    return latest_per_key(events, "user_id", "ts", "event_id").select(*EVENT)


@_query("latest_per_key_max_by", _LATEST_ORACLE)
def _latest_per_key_max_by(spark, sf_dir):
    events = _read(spark, sf_dir, "events")
    return latest_per_key_agg(events, "user_id", "ts", "event_id").select(*EVENT)


@_query("parameterised_sql", _LATEST_ORACLE)
def _parameterised_sql(spark, sf_dir):
    args = {"key": "user_id", "ts": "ts", "tie": "event_id"}
    return run_sql(spark, LATEST_SQL, args, rows=_read(spark, sf_dir, "events")).select(*EVENT)


@_query(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def _duplicate_keys(spark, sf_dir):
    return duplicate_keys(_read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


# Upsert and merge

USER_DAY = ["user_id", "day"]


def _by_day(events: DataFrame) -> DataFrame:
    return events.withColumn("day", F.to_date("ts"))


@_query(
    "cdc_upsert",
    """
    WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events),
    b AS (
        SELECT * FROM e WHERE event_type <> 'purchase'
        QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY ts DESC, event_id DESC) = 1
    ),
    d AS (
        SELECT * FROM e WHERE event_type = 'purchase'
        QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY ts DESC, event_id DESC) = 1
    )
    SELECT event_id, ts, user_id, day, event_type FROM d
    UNION ALL
    SELECT event_id, ts, user_id, day, event_type FROM b
    WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.user_id = b.user_id AND d.day = b.day)
    """,
)
def _cdc_upsert(spark, sf_dir):
    """Keyed by user and day: all other events first, then purchases, which win as the last batch."""
    events, table = _by_day(_read(spark, sf_dir, "events")), Table(spark, scratch_dir(spark))
    purchase = F.col("event_type") == "purchase"
    for batch in (events.filter(~purchase), events.filter(purchase)):
        upsert(table, batch, USER_DAY, "ts", tie_breakers="event_id")
    return table.read().select("event_id", "ts", "user_id", "day", "event_type")


@_query(
    "cdc_upsert_ties",
    """
    SELECT user_id, day, max(event_id) AS event_id
    FROM (
        SELECT user_id, CAST(ts AS DATE) AS day, event_id FROM events
        QUALIFY rank() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) DESC) = 1
    )
    GROUP BY user_id, day
    """,
)
def _cdc_upsert_ties(spark, sf_dir):
    """Ordered by day alone, so that stamps tie: whichever batch comes last, the tie-breaker decides."""
    events = _by_day(_read(spark, sf_dir, "events")).select("user_id", "day", "event_id")
    odd, tables = F.col("event_id") % 2 == 1, []
    for batches in ((events.filter(odd), events.filter(~odd)), (events.filter(~odd), events.filter(odd))):
        tables.append(Table(spark, scratch_dir(spark)))
        for batch in batches:
            upsert(tables[-1], batch, "user_id", "day", NEWEST_WINS, "event_id")
    return tables[0].read().intersect(tables[1].read())


@_query("cdc_upsert_newest_wins", _LATEST_ORACLE)
def _cdc_upsert_newest_wins(spark, sf_dir):
    """Two batches that overlap in time: whichever comes last, the newest rows stay."""
    events, table = _read(spark, sf_dir, "events"), Table(spark, scratch_dir(spark))
    purchase = F.col("event_type") == "purchase"
    for batch in (events.filter(purchase), events.filter(~purchase)):
        upsert(table, batch, "user_id", "ts", NEWEST_WINS, "event_id")
    return table.read().select(*EVENT)


def _reviewed(customer: DataFrame) -> DataFrame:
    """Negative balances relabelled, and one new key for each of them."""
    negative = customer.filter("c_acctbal < 0")
    new_key = F.col("c_custkey") + F.lit(NEW_KEYS)
    return negative.select("c_custkey", F.lit("REVIEW").alias("c_mktsegment")).unionByName(
        negative.select(new_key.alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"))
    )


NEW_KEYS = 10**12


@_query(
    "silver_merge_condition",
    f"""
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'REVIEW' ELSE c_mktsegment END AS c_mktsegment
    FROM customer
    UNION ALL SELECT c_custkey + {NEW_KEYS}, 'NEW' FROM customer WHERE c_acctbal < 0
    """,
)
def _silver_merge_condition(spark, sf_dir):
    house, customer = _scratch(spark), _read(spark, sf_dir, "customer")
    path = _sql_file(spark, house, "customer", "SELECT c_custkey, c_mktsegment FROM shop_customer")
    for bronze in (customer, _reviewed(customer)):
        house.save(bronze, BRONZE, SCHEMA, "customer")
        house.to_silver(path, SCHEMA, "customer", "t.c_custkey = s.c_custkey")
    return house.load(SILVER, SCHEMA, "customer")


@_query(
    "merge_any_condition",
    f"""
    SELECT c_custkey, CASE WHEN c_acctbal < 0 AND c_mktsegment <> 'BUILDING' THEN 'REVIEW'
                           ELSE c_mktsegment END AS c_mktsegment
    FROM customer
    UNION ALL
    SELECT c_custkey, 'REVIEW' FROM customer WHERE c_acctbal < 0 AND c_mktsegment = 'BUILDING'
    UNION ALL SELECT c_custkey + {NEW_KEYS}, 'NEW' FROM customer WHERE c_acctbal < 0
    """,
)
def _merge_any_condition(spark, sf_dir):
    """Equality and one more predicate; a source row that fails it counts as not matched."""
    customer = _read(spark, sf_dir, "customer")
    target = customer.select("c_custkey", "c_mktsegment")
    condition = "t.c_custkey = s.c_custkey AND t.c_mktsegment <> 'BUILDING'"
    return merge_all(target, _reviewed(customer), condition=condition)


@_query(
    "merge_condition_over_joined_source",
    """
    SELECT c_custkey, CASE WHEN p_brand IS NULL THEN c_mktsegment ELSE p_brand END AS c_mktsegment
    FROM customer LEFT JOIN (
        SELECT p.p_partkey, max(p.p_brand) AS p_brand
        FROM part p JOIN region r ON p.p_size > r.r_regionkey * 10 GROUP BY 1
    ) ON c_custkey = p_partkey AND c_mktsegment = 'BUILDING'
    UNION ALL
    SELECT p.p_partkey, max(p.p_brand)
    FROM part p JOIN region r ON p.p_size > r.r_regionkey * 10
    WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = p_partkey AND c_mktsegment = 'BUILDING')
    GROUP BY 1
    """,
)
def _merge_condition_over_joined_source(spark, sf_dir):
    """A range join within the source is no part of the merge condition, which has an equality."""
    customer, part, region = (_read(spark, sf_dir, t) for t in ("customer", "part", "region"))
    larger = F.col("p_size") > F.col("r_regionkey") * 10
    source = part.join(F.broadcast(region), larger).groupBy(F.col("p_partkey").alias("c_custkey"))
    source = source.agg(F.max("p_brand").alias("c_mktsegment"))
    condition = "t.c_custkey = s.c_custkey AND t.c_mktsegment = 'BUILDING'"
    return merge_all(customer.select("c_custkey", "c_mktsegment"), source, condition=condition)


@_query(
    "silver_merge_predicate",
    """
    SELECT c_custkey, c_acctbal + CASE WHEN c_acctbal < 0 THEN 10000 ELSE 0 END AS c_acctbal
    FROM customer
    UNION ALL SELECT c_custkey, c_acctbal - 1 FROM customer WHERE c_acctbal >= 0
    """,
)
def _silver_merge_predicate(spark, sf_dir):
    """A stored merge on an equality and more: raised balances update, lowered ones are inserted."""
    house, customer = _scratch(spark), _read(spark, sf_dir, "customer")
    path = _sql_file(spark, house, "customer", "SELECT c_custkey, c_acctbal FROM shop_customer")
    moved = F.when(F.col("c_acctbal") < 0, F.col("c_acctbal") + 10000).otherwise(F.col("c_acctbal") - 1)
    condition = "t.c_custkey = s.c_custkey AND s.c_acctbal > t.c_acctbal"
    for bronze in (customer, customer.withColumn("c_acctbal", moved)):
        house.save(bronze, BRONZE, SCHEMA, "customer")
        house.to_silver(path, SCHEMA, "customer", condition)
    return house.load(SILVER, SCHEMA, "customer")


@_query(
    "merge_by_interval",
    """
    WITH periods AS (
        SELECT DISTINCT -year(o_orderdate) AS id, make_date(year(o_orderdate), 4, 1) AS day_from,
               make_date(year(o_orderdate), 6, 30) AS day_to, 'SECOND QUARTER' AS label
        FROM orders
        UNION ALL SELECT DISTINCT 0, make_date(year(o_orderdate) - 100, 1, 1), make_date(year(o_orderdate) - 100, 12, 31), 'OLD'
        FROM orders
    ), days AS (
        SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day_from, CAST(o_orderdate AS DATE) AS day_to, o_orderstatus AS label
        FROM orders
    )
    SELECT coalesce(p.id, d.id) AS id, coalesce(p.day_from, d.day_from) AS day_from, coalesce(p.day_to, d.day_to) AS day_to,
           coalesce(p.label, d.label) AS label
    FROM days d LEFT JOIN periods p ON d.day_from BETWEEN p.day_from AND p.day_to
    UNION ALL
    SELECT * FROM periods p WHERE NOT EXISTS (SELECT 1 FROM days d WHERE d.day_from BETWEEN p.day_from AND p.day_to)
    """,
)
def _merge_by_interval(spark, sf_dir):
    """Each order of a second quarter becomes that period's row; periods without orders are inserted."""
    orders, table = _read(spark, sf_dir, "orders"), Table(spark, scratch_dir(spark))
    day = F.col("o_orderdate").cast("date")
    table.overwrite(orders.select(
        F.col("o_orderkey").alias("id"), day.alias("day_from"), day.alias("day_to"), F.col("o_orderstatus").alias("label")
    ))
    years = orders.select(F.year("o_orderdate").alias("y")).distinct()
    periods = years.selectExpr(
        "-CAST(y AS BIGINT) AS id", "make_date(y, 4, 1) AS day_from", "make_date(y, 6, 30) AS day_to", "'SECOND QUARTER' AS label"
    ).unionByName(years.selectExpr(
        "0L AS id", "make_date(y - 100, 1, 1) AS day_from", "make_date(y - 100, 12, 31) AS day_to", "'OLD' AS label"
    ))
    merge_into(table, periods, condition="t.day_from BETWEEN s.day_from AND s.day_to")
    return table.read()


@_query(
    "merge_by_alternatives",
    f"""
    WITH changes AS (
        SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey + {NEW_KEYS} END AS c_custkey,
               CASE WHEN c_custkey % 2 = 0 THEN 'renamed ' || c_name ELSE c_name END AS c_name,
               CASE WHEN c_custkey % 2 = 0 THEN 'BY KEY' ELSE 'BY NAME' END AS c_mktsegment
        FROM customer WHERE c_acctbal < 0
        UNION ALL SELECT c_custkey + 2 * {NEW_KEYS}, 'new ' || c_name, 'NEW' FROM customer WHERE c_acctbal >= 9000
    )
    SELECT coalesce(s.c_custkey, t.c_custkey) AS c_custkey, coalesce(s.c_name, t.c_name) AS c_name,
           coalesce(s.c_mktsegment, t.c_mktsegment) AS c_mktsegment
    FROM customer t
    LEFT JOIN changes s ON CASE WHEN s.c_mktsegment = 'BY NAME' THEN s.c_custkey - {NEW_KEYS} ELSE s.c_custkey END = t.c_custkey
    UNION ALL SELECT * FROM changes WHERE c_mktsegment = 'NEW'
    """,
)
def _merge_by_alternatives(spark, sf_dir):
    """Customers are known by key or by name: half of the changes carry a new key, the others a new name."""
    customer, table = _read(spark, sf_dir, "customer"), Table(spark, scratch_dir(spark))
    table.overwrite(customer.select("c_custkey", "c_name", "c_mktsegment"))
    even = F.col("c_custkey") % 2 == 0
    changed = customer.filter("c_acctbal < 0").select(
        F.when(even, F.col("c_custkey")).otherwise(F.col("c_custkey") + NEW_KEYS).alias("c_custkey"),
        F.when(even, F.concat(F.lit("renamed "), "c_name")).otherwise(F.col("c_name")).alias("c_name"),
        F.when(even, "BY KEY").otherwise("BY NAME").alias("c_mktsegment"),
    )
    new = customer.filter("c_acctbal >= 9000").select(
        (F.col("c_custkey") + 2 * NEW_KEYS).alias("c_custkey"),
        F.concat(F.lit("new "), "c_name").alias("c_name"),
        F.lit("NEW").alias("c_mktsegment"),
    )
    merge_into(table, changed.unionByName(new), condition="t.c_custkey = s.c_custkey OR t.c_name = s.c_name")
    return table.read()


@_query(
    "merge_widened_keys",
    """
    SELECT n_nationkey::BIGINT AS n_nationkey, upper(n_name) AS n_name FROM nation
    UNION ALL SELECT n_nationkey + 4294967296, upper(n_name) FROM nation
    """,
)
def _merge_widened_keys(spark, sf_dir):
    """An int target and bigint keys, half of them beyond int: inserted, never wrapped onto others."""
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    long = nation.select(F.col("n_nationkey").cast("bigint"), F.upper("n_name").alias("n_name"))
    beyond = long.withColumn("n_nationkey", F.col("n_nationkey") + 2**32)
    return merge_all(nation, long.unionByName(beyond), on="n_nationkey", widen=True)


@_query(
    "silver_incremental",
    f"""
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'REVIEW' ELSE c_mktsegment END AS c_mktsegment,
           CASE WHEN c_acctbal < 0 THEN 1 ELSE 2 END AS stamp
    FROM customer
    UNION ALL SELECT c_custkey + {10**12}, 'NEW', 1 FROM customer WHERE c_acctbal < 0
    """,
)
def _silver_incremental(spark, sf_dir):
    """Silver reads the buckets written since it last read, also where a later batch has older stamps."""
    house, customer = _scratch(spark), _read(spark, sf_dir, "customer")
    text = "SELECT c_custkey, c_mktsegment, stamp FROM shop_customer"
    path = _sql_file(spark, house, "customer", text)
    first = customer.select("c_custkey", "c_mktsegment", F.lit(2).alias("stamp"))
    for batch in (first, _reviewed(customer).withColumn("stamp", F.lit(1))):
        house.upsert(batch, SCHEMA, "customer", "c_custkey", "stamp", buckets=16)
        for _ in range(2):
            house.to_silver(path, SCHEMA, "customer", "t.c_custkey = s.c_custkey", incremental=True)
    return house.load(SILVER, SCHEMA, "customer")


_ORDER_DAY = "1996-01-02"


@_query(
    "silver_incremental_groups",
    f"""
    SELECT id_customer, count(*) AS n_orders, count(DISTINCT status) AS n_statuses, max(o_totalprice) AS top
    FROM (
        SELECT *, CASE WHEN o_orderstatus = 'P' THEN o_custkey + 1 ELSE o_custkey END AS id_customer,
               CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS status
        FROM orders WHERE CAST(o_orderdate AS DATE) IS DISTINCT FROM DATE '{_ORDER_DAY}'
    ) GROUP BY 1
    """,
)
def _silver_incremental_groups(spark, sf_dir):
    """Distinct counts by customer, kept up to date: some orders move to another customer, those of a day are deleted."""
    house, orders = _scratch(spark), _read(spark, sf_dir, "orders").select(*ORDER)
    text = """
        SELECT o_custkey AS id_customer, COUNT(*) AS n_orders, COUNT(DISTINCT o_orderstatus) AS n_statuses,
               MAX(o_totalprice) AS top
        FROM shop_orders GROUP BY o_custkey
    """
    path = _sql_file(spark, house, "customer_orders", text)
    moved = orders.filter("o_orderstatus = 'P'")
    moved = moved.withColumns({"o_orderstatus": F.lit("F"), "o_custkey": F.col("o_custkey") + 1})
    for batch in (orders, moved, None):
        if batch is None:
            delete_day(house.table(BRONZE, SCHEMA, "orders"), "o_orderdate", _ORDER_DAY)
        else:
            house.upsert(batch, SCHEMA, "orders", "o_orderkey", "o_orderdate", buckets=16)
        house.to_silver_groups(path, SCHEMA, "orders", {"id_customer": "o_custkey"}, buckets=8)
    return house.load(SILVER, SCHEMA, "customer_orders")


@_query(
    "merge_repeated_target_keys",
    """
    SELECT l_orderkey AS id_order, CASE WHEN o_orderkey IS NULL THEN l_linestatus ELSE 'DONE' END AS status
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'F'
    UNION ALL
    SELECT o_orderkey, 'DONE' FROM orders
    WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
    """,
)
def _merge_repeated_target_keys(spark, sf_dir):
    """A finished order updates each of its line items, or is inserted when it has none."""
    item, orders = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "orders")
    table = Table(spark, scratch_dir(spark))
    stored = rename_projection(item, {"l_orderkey": "id_order", "l_linestatus": "status"})
    table.overwrite(stored, bucket_by=["id_order"])
    finished = orders.filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("id_order"), F.lit("DONE").alias("status")
    )
    merge_into(table, finished, on="id_order")
    return table.read()


# Streaming


def _land_by_type(house: Lakehouse, events: DataFrame, parts: range = range(TYPE_BATCHES)) -> None:
    """Whatever their types, null included, events land in one of a fixed number of batches."""
    for part in parts:
        batch = events.filter(F.pmod(F.xxhash64("event_type"), F.lit(TYPE_BATCHES)) == part)
        land_batch(batch, house.layout.path(RAW, SCHEMA, "events"), DAY)


@_query("cdc_stream_available_now", _LATEST_ORACLE)
def _cdc_stream_available_now(spark, sf_dir):
    house, events = _scratch(spark), _read(spark, sf_dir, "events")
    _land_by_type(house, events)
    house.bronze_cdc(
        SCHEMA, "events", "user_id", "ts", policy=NEWEST_WINS, tie_breakers="event_id"
    )
    return _as_read(house.load(BRONZE, SCHEMA, "events"), events, EVENT)


_LAST_BATCH_ORACLE = f"""
    SELECT event_id, ts, user_id, CAST(ts AS DATE) AS day, event_type FROM events
    QUALIFY row_number() OVER (
        PARTITION BY user_id, CAST(ts AS DATE)
        ORDER BY coalesce(length(event_type) % {LENGTH_BATCHES}, 0) DESC, ts DESC, event_id DESC
    ) = 1
"""


# Bytes of events for which each batch has one more file, and bronze one more bucket.
FILE_BYTES = 128 * 1024 * 1024


def _last_batch_wins(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    house, events = _scratch(spark), _by_day(_read(spark, sf_dir, "events"))
    # A key's rows of a batch in one file, as many files as the events need. Keys are hashed as they are read again, so
    # that a file's keys lie in one bucket of bronze and a merge for each file rewrites that bucket alone.
    files = Table.buckets_for(estimated_bytes(events), FILE_BYTES)
    keys = [F.col(c).cast("string") if c == "day" else F.col(c) for c in USER_DAY]
    for batch in range(LENGTH_BATCHES):
        rows = _by_length(events, "event_type", batch).repartition(files, *keys)
        land_batch(rows, house.layout.path(RAW, SCHEMA, "events"), DAY)
    house.bronze_cdc(SCHEMA, "events", USER_DAY, "ts", tie_breakers="event_id", buckets=files, **options)
    columns = ["event_id", "ts", "user_id", "day", "event_type"]
    return _as_read(house.load(BRONZE, SCHEMA, "events"), events, columns)


@_query("cdc_stream_last_batch_wins", _LAST_BATCH_ORACLE)
def _cdc_stream_last_batch_wins(spark, sf_dir):
    """Batches land in an order that differs from that of time; one merge ends as if they had come one by one."""
    return _last_batch_wins(spark, sf_dir)


@_query("cdc_stream_one_file_per_trigger", _LAST_BATCH_ORACLE)
def _cdc_stream_one_file_per_trigger(spark, sf_dir):
    """The same with a merge for each file."""
    return _last_batch_wins(spark, sf_dir, max_files_per_trigger=1)


@_query(
    "bronze_cdc_rejects",
    """
    SELECT 'stored' AS kind, event_type || ' ' || event_id AS record FROM events WHERE event_type <> 'error'
    UNION ALL
    SELECT 'rejected', '!{"event_id":' || event_id || ',"event_type":"error"}' FROM events
    WHERE event_type = 'error'
    """,
)
def _bronze_cdc_rejects(spark, sf_dir):
    """Two runs over lines of which some are no JSON: these end beside the bronze table, as they were."""
    house, events = _scratch(spark), _read(spark, sf_dir, "events").select("event_id", "event_type")
    record = F.to_json(F.struct("event_id", "event_type"))
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("!"), record)).otherwise(record)
    for half in (0, 1):
        part = events.filter(F.col("event_id") % 2 == half).select(line.alias("value"))
        part.write.text(f"{house.layout.path(RAW, SCHEMA, 'events')}/{DAY}_{half + 1:03d}.json")
        house.bronze_cdc(SCHEMA, "events", "event_id", "event_type")
    stored = F.concat_ws(" ", "event_type", "event_id").alias("record")
    good = house.load(BRONZE, SCHEMA, "events").select(F.lit("stored").alias("kind"), stored)
    bad = house.rejects(SCHEMA, "events").read().select(F.lit("rejected").alias("kind"), "record")
    return good.unionByName(bad)


@_query(
    "cdc_stream_new_column",
    """
    SELECT event_id, user_id, event_type, CASE WHEN odd THEN props END AS props, event_type AS kind,
           CASE WHEN odd THEN user_id END AS source
    FROM (
        SELECT *, coalesce(event_id % 2 = 1, FALSE) AS odd FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
    )
    """,
)
def _cdc_stream_new_column(spark, sf_dir):
    """The second run's files have one more column and one more nested field; rows of the first keep NULLs there."""
    house, events = _scratch(spark), _read(spark, sf_dir, "events")
    path, odd = house.layout.path(RAW, SCHEMA, "events"), F.coalesce(F.col("event_id") % 2 == 1, F.lit(False))
    kind = F.col("event_type").alias("kind")
    early = events.filter(~odd).drop("props").withColumn("origin", F.struct(kind))
    late = events.filter(odd).withColumn("origin", F.struct(kind, F.col("user_id").alias("source")))
    for batch in (early, late):
        land_batch(batch, path, DAY)
        house.bronze_cdc(SCHEMA, "events", "user_id", "ts", policy=NEWEST_WINS, tie_breakers="event_id")
    stored = house.load(BRONZE, SCHEMA, "events")
    return stored.select("event_id", "user_id", "event_type", "props", "origin.kind", "origin.source")


@_query("cdc_stream_rerun", _LATEST_ORACLE)
def _cdc_stream_rerun(spark, sf_dir):
    """Three runs on one checkpoint: some files, no new file, the other files."""
    house, events = _scratch(spark), _read(spark, sf_dir, "events")
    for landed in (range(1, TYPE_BATCHES), range(0), range(1)):
        _land_by_type(house, events, landed)
        house.bronze_cdc(
            SCHEMA, "events", "user_id", "ts", policy=NEWEST_WINS, tie_breakers="event_id"
        )
    return _as_read(house.load(BRONZE, SCHEMA, "events"), events, EVENT)


@_query("stream_inferred_schema", _LATEST_ORACLE)
def _stream_inferred_schema(spark, sf_dir):
    house, events = _scratch(spark), _read(spark, sf_dir, "events")
    _land_by_type(house, events)
    raw, table = house.layout.path(RAW, SCHEMA, "events"), house.table(BRONZE, SCHEMA, "events")
    schema = infer_schema(spark, raw, "json")
    checkpoint = house.layout.checkpoint(SCHEMA, "events")
    start_cdc(
        spark, raw, table, checkpoint, "user_id", "ts", schema, policy=NEWEST_WINS,
        tie_breakers="event_id",
    ).awaitTermination()
    return _as_read(table.read(), events, EVENT)


@_query("stream_max_by", _LATEST_ORACLE)
def _stream_max_by(spark, sf_dir):
    house, events = _scratch(spark), _read(spark, sf_dir, "events")
    house.save(events, RAW, SCHEMA, "events", "parquet")
    raw = house.layout.path(RAW, SCHEMA, "events")
    stream = read_stream(spark, raw, "parquet", events.schema, max_files_per_trigger=None)
    table, checkpoint = house.table(BRONZE, SCHEMA, "events"), house.layout.checkpoint(SCHEMA, "latest")
    start_latest(stream, table, checkpoint, "user_id", "ts", "event_id").awaitTermination()
    return table.read().select(*EVENT)


@_query("stream_latest_state", _LATEST_ORACLE)
def _stream_latest_state(spark, sf_dir):
    """Two runs whose state holds each key's age and digest for a while, never its row."""
    house, events = _scratch(spark), _read(spark, sf_dir, "events")
    raw, table = house.layout.path(RAW, SCHEMA, "events"), house.table(BRONZE, SCHEMA, "events")
    odd = F.col("event_id") % 2 == 1
    for batch in (events.filter(odd), events.filter(~F.coalesce(odd, F.lit(False)))):
        house.save(batch, RAW, SCHEMA, "events", "parquet", mode="append")
        stream = read_stream(spark, raw, "parquet", events.schema, max_files_per_trigger=None)
        checkpoint = house.layout.checkpoint(SCHEMA, "state")
        start_latest_with_state(stream, table, checkpoint, "user_id", "ts", "event_id", ttl="7 days").awaitTermination()
    return table.read().select(*EVENT)


# Gold


def _orders_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their date as text such as ``December 2, 1996``."""
    day = F.date_format("o_orderdate", "MMMM d, yyyy")
    return _read(spark, sf_dir, "orders").withColumn("order_day", day)


_YEARS_SQL = """
    SELECT YEAR(TO_DATE(order_day, 'MMMM d, yyyy')) AS order_year, COUNT(*) AS n_orders
    FROM shop_orders
    GROUP BY YEAR(TO_DATE(order_day, 'MMMM d, yyyy'))
"""
_YEARS_ORACLE = """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year, count(*) AS n_orders
    FROM orders GROUP BY 1
"""


@_query("gold_count_by_year", _YEARS_ORACLE)
def _gold_count_by_year(spark, sf_dir):
    house = _scratch(spark)
    path = _sql_file(spark, house, "orders_by_year", _YEARS_SQL)
    return run_sql_file(spark, path, {"shop_orders": _orders_in_words(spark, sf_dir)})


@_query(
    "tolerant_date_parse",
    """
    SELECT CASE WHEN o_orderstatus <> 'P' THEN CAST(year(o_orderdate) AS INTEGER) END AS order_year,
           count(*) AS n_orders
    FROM orders GROUP BY 1
    """,
)
def _tolerant_date_parse(spark, sf_dir):
    """Orders of status P carry text that is no date and end in the NULL year."""
    orders = _orders_in_words(spark, sf_dir)
    text = F.when(F.col("o_orderstatus") == "P", "some day").otherwise(F.col("order_day"))
    return count_by(orders, "n_orders", order_year=year_of(text, tolerant=True))


_FINISHED_ORACLE = """
    SELECT o_custkey AS id_customer, count(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS n_finished
    FROM orders GROUP BY 1
"""


@_query("gold_count_by_key", _FINISHED_ORACLE)
def _gold_count_by_key(spark, sf_dir):
    finished = F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))
    orders = _read(spark, sf_dir, "orders")
    return count_by(orders, "n_finished", finished, id_customer=F.col("o_custkey"))


@_query("gold_new_table", _FINISHED_ORACLE)
def _gold_new_table(spark, sf_dir):
    """A second run with ``new_table`` leaves nothing of the first, other day."""
    house = _scratch(spark)
    house.save(_read(spark, sf_dir, "orders"), SILVER, SCHEMA, "orders")
    path = _sql_file(
        spark,
        house,
        "finished_by_customer",
        """
        SELECT o_custkey AS id_customer,
               COUNT(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS n_finished
        FROM shop_orders GROUP BY o_custkey
        """,
    )
    for day in (DAY, NEXT_DAY):
        house.to_gold(path, SCHEMA, "orders", day, new_table=True)
    return house.load(GOLD, SCHEMA, "finished_by_customer").drop(SNAPSHOT)


def _by_status(orders: DataFrame) -> DataFrame:
    return count_by(orders, "n", o_orderstatus=F.col("o_orderstatus"))


@_query(
    "gold_snapshot_replace",
    f"""
    SELECT CAST(d AS DATE) AS snapshot_date, o_orderstatus, count(*) AS n
    FROM orders, (VALUES ('{DAY}'), ('{NEXT_DAY}')) v(d) GROUP BY 1, 2
    """,
)
def _gold_snapshot_replace(spark, sf_dir):
    """A run over half-arrived orders, its rerun over all of them, and the next day's run."""
    orders, table = _read(spark, sf_dir, "orders"), Table(spark, scratch_dir(spark))
    replace_snapshot(table, _by_status(orders.filter("o_orderpriority < '3'")), DAY)
    replace_snapshot(table, _by_status(orders), DAY)
    replace_snapshot(table, _by_status(orders), NEXT_DAY)
    return table.read()


@_query(
    "gold_snapshot_append",
    """
    SELECT o_orderstatus, n
    FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1), range(2)
    """,
)
def _gold_snapshot_append(spark, sf_dir):
    orders, table = _read(spark, sf_dir, "orders"), Table(spark, scratch_dir(spark))
    for _ in range(2):
        append_snapshot(table, _by_status(orders), DAY)
    return table.read().drop(SNAPSHOT)


@_query(
    "gold_incremental_counts",
    f"""
    WITH closed AS (
        SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS status,
               o_totalprice + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS price
        FROM orders
    )
    SELECT CAST(d AS DATE) AS snapshot_date, CAST(year(o_orderdate) AS INTEGER) AS order_year, s AS status, count(o_orderkey) AS n,
           max(p) AS top, min(o_orderdate) AS first_day
    FROM (
        SELECT '{DAY}' AS d, o_orderkey, o_orderdate, o_orderstatus AS s, o_totalprice AS p FROM orders
        UNION ALL SELECT '{NEXT_DAY}', o_orderkey, o_orderdate, status, price FROM closed
    ) GROUP BY ALL
    """,
)
def _gold_incremental_counts(spark, sf_dir):
    """Two days' snapshots from partial aggregates: the second run reads the buckets that a second batch changed."""
    house, orders = _scratch(spark), _read(spark, sf_dir, "orders")
    silver = house.table(SILVER, SCHEMA, "orders")
    closed = orders.filter("o_orderstatus = 'P'").withColumn("o_orderstatus", F.lit("F"))
    closed = closed.withColumn("o_totalprice", F.col("o_totalprice") + 1)
    groups = {"order_year": "year(o_orderdate)", "status": "o_orderstatus"}
    measures = {"n": ("count", "o_orderkey"), "top": ("max", "o_totalprice"), "first_day": ("min", "o_orderdate")}
    for batch, day in ((orders, DAY), (closed, NEXT_DAY)):
        merge_into(silver, batch.select(*ORDER), on="o_orderkey", buckets=16)
        house.to_gold_parts(SCHEMA, "orders", "orders_by_year", groups, measures, day)
    return house.load(GOLD, SCHEMA, "orders_by_year")


EVENT_DAY = "2024-01-10"


@_query(
    "delete_by_date",
    f"SELECT event_id, user_id FROM events WHERE CAST(ts AS DATE) <> DATE '{EVENT_DAY}'",
)
def _delete_by_date(spark, sf_dir):
    events = _read(spark, sf_dir, "events")
    return without_day(events, "ts", EVENT_DAY).select("event_id", "user_id")


@_query(
    "delete_by_date_stored",
    f"SELECT event_id, user_id FROM events WHERE CAST(ts AS DATE) <> DATE '{EVENT_DAY}'",
)
def _delete_by_date_stored(spark, sf_dir):
    house = _scratch(spark)
    house.save(_read(spark, sf_dir, "events"), GOLD, SCHEMA, "events")
    house.delete_day(SCHEMA, "events", "ts", EVENT_DAY)
    return house.load(GOLD, SCHEMA, "events").select("event_id", "user_id")


@_query(
    "delete_by_date_files",
    f"SELECT event_id, user_id FROM events WHERE CAST(ts AS DATE) NOT IN (DATE '{EVENT_DAY}', DATE '2024-01-12')",
)
def _delete_by_date_files(spark, sf_dir):
    """Two days go from a plain table of many files in order of time: the files without them stay as they are."""
    house, events = _scratch(spark), _read(spark, sf_dir, "events")
    house.save(events.repartitionByRange(16, "ts"), GOLD, SCHEMA, "events")
    for day in (EVENT_DAY, "2024-01-12"):
        house.delete_day(SCHEMA, "events", "ts", day)
    return house.load(GOLD, SCHEMA, "events").select("event_id", "user_id")


@_query(
    "delete_by_date_count",
    f"SELECT count(*) AS n_deleted FROM events WHERE CAST(ts AS DATE) = DATE '{EVENT_DAY}'",
)
def _delete_by_date_count(spark, sf_dir):
    hit = rows_on_day(_read(spark, sf_dir, "events"), "ts", EVENT_DAY)
    return hit.agg(F.count(F.lit(1)).alias("n_deleted"))


# All layers

_WORKFLOW = {
    "bronze": [
        {
            "full_load": False,
            "tablename_load": "orders",
            "tablename_save": "orders",
            "schema": SCHEMA,
            "id_field": "o_orderkey",
            "timestamp_field": "updated_at",
        }
    ],
    "silver": [
        {
            "schema": SCHEMA,
            "tablename_load": "orders",
            "tablename_save": "order_day",
            "merge_condition": "t.id_order = s.id_order",
        },
        {
            "schema": SCHEMA,
            "tablename_load": "orders",
            "tablename_save": "order_link",
            "merge_condition": False,
        },
    ],
    "gold": [
        {
            "tablename_load": "order_day",
            "tablename_save": "orders_by_year",
            "schema": SCHEMA,
            "date_field": "loaded_at",
            "new_table": False,
            "date": DAY,
            "as_of": AS_OF,
        },
        {
            "tablename_load": "order_link",
            "tablename_save": "orders_by_customer",
            "schema": SCHEMA,
            "date_field": "loaded_at",
            "new_table": False,
            "date": DAY,
            "as_of": AS_OF,
        },
    ],
}
_WORKFLOW_SQL = {
    "order_day": """
        SELECT o_orderkey AS id_order, order_day, updated_at AS changed_at FROM shop_orders
    """,
    "order_link": r"""
        WITH links AS (SELECT o_orderkey, EXPLODE(customers) AS link FROM shop_orders)
        SELECT o_orderkey AS id_order, REGEXP_EXTRACT(link, r'/(\d+)$') AS id_customer FROM links
    """,
    "orders_by_year": """
        SELECT YEAR(TO_DATE(order_day, 'MMMM d, yyyy')) AS order_year, COUNT(*) AS n_orders,
               CURRENT_TIMESTAMP() AS loaded_at
        FROM shop_order_day GROUP BY YEAR(TO_DATE(order_day, 'MMMM d, yyyy'))
    """,
    "orders_by_customer": """
        SELECT id_customer, COUNT(id_order) AS n_orders, CURRENT_TIMESTAMP() AS loaded_at
        FROM shop_order_link GROUP BY id_customer
    """,
}


def _run_all_layers(spark: SparkSession, sf_dir: str) -> Lakehouse:
    """Land orders twice, the first time with their status still open, and run every layer."""
    house, orders = _scratch(spark), _orders_in_words(spark, sf_dir)
    customer = F.concat(F.lit("https://h/api/customer/"), F.col("o_custkey"))
    full = orders.withColumn("customers", F.array(customer)).drop("o_orderdate")
    early = full.withColumn("order_day", F.lit("January 1, 1970"))
    house.land(early, SCHEMA, "orders", "2024-10-04T08:00:00")
    house.land(full, SCHEMA, "orders", AS_OF)
    for name, text in _WORKFLOW_SQL.items():
        _sql_file(spark, house, name, text)
    sql_dir = f"{house.layout.root}/sql"
    house.run_bronze(config.parse(config.BronzeEntry, _WORKFLOW["bronze"]))
    house.run_silver(config.parse(config.SilverEntry, _WORKFLOW["silver"]), sql_dir)
    house.run_gold(config.parse(config.GoldEntry, _WORKFLOW["gold"]), sql_dir)
    return house


@_query(
    "medallion_end_to_end",
    f"""
    SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year, count(*) AS n_orders,
           '{AS_OF}' AS loaded_at, DATE '{DAY}' AS snapshot_date
    FROM orders GROUP BY 1
    """,
)
def medallion_end_to_end(spark, sf_dir):
    house = _run_all_layers(spark, sf_dir)
    stamp = F.date_format("loaded_at", "yyyy-MM-dd'T'HH:mm:ss").alias("loaded_at")
    return house.load(GOLD, SCHEMA, "orders_by_year").select("order_year", "n_orders", stamp, SNAPSHOT)


@_query(
    "medallion_bridge_counts",
    "SELECT CAST(o_custkey AS VARCHAR) AS id_customer, count(*) AS n_orders FROM orders GROUP BY 1",
)
def _medallion_bridge_counts(spark, sf_dir):
    house = _run_all_layers(spark, sf_dir)
    return house.load(GOLD, SCHEMA, "orders_by_customer").select("id_customer", "n_orders")
