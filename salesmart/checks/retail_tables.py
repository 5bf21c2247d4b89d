"""The shared test tables seen as a retailer's extract.

Suppliers are the stores, parts the products, order lines the sales. The mapping
is fixed in FIXTURES.md; every expression has a twin in ``oracle``.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass
from datetime import date
from functools import reduce
from threading import RLock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.functions.columns import age_band
from salesmart.model import RawTables, Star
from salesmart.operators.quality import clean
from salesmart.plans.etl import conform, keyed, run_etl
from salesmart.sources.shared import settle, shared_folder
from salesmart.sources.tables import read_raw

AS_OF = date(2001, 11, 4)
SALES_ORDER = ["product_id", "store_id", "sale_date", "revenue"]

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def prepare(spark: SparkSession) -> None:
    """Give a local check session that names no shared folder one of its own; clusters must name theirs."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None and context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="salesmart-"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(
        "s_suppkey as store_id",
        "s_name as store_name",
        "n_name as city",
        "r_name as region",
        "case s_suppkey % 3 when 0 then 'branch' when 1 then 'mall' else 'online' end as store_type",
        "date_add(date'1990-01-01', cast(s_suppkey % 3650 as int)) as opening_date",
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = table(spark, sf_dir, "part").withColumn("price", F.expr("cast(p_retailprice as decimal(12,2))"))
    return priced.selectExpr(
        "p_partkey as product_id",
        "p_name as product_name",
        "p_type as category",
        "p_brand as brand",
        "price",
        "cast(price * cast(40 + p_partkey % 31 as decimal(4,0)) * cast(0.01 as decimal(3,2)) as decimal(12,2)) as cost",
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .selectExpr(
            "c_custkey as customer_id",
            "c_name as customer_name",
            "case c_custkey % 2 when 0 then 'F' else 'M' end as gender",
            "cast(18 + c_custkey % 58 as int) as age",
            "concat('customer', c_custkey, '@example.com') as email",
            "n_name as city",
        )
        .withColumn("age_group", age_band(F.col("age")))
        .select("customer_id", "customer_name", "gender", "age", "age_group", "email", "city")
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    revenue = "cast(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2))) as decimal(12,2)) as revenue"
    sold = lines.selectExpr("l_orderkey", "l_linenumber", "l_shipdate", "l_suppkey", "l_partkey", "l_quantity", revenue)
    return (
        sold.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn(
            "cost",
            F.expr(
                "cast(revenue * cast(40 + l_partkey % 31 as decimal(4,0)) * cast(0.01 as decimal(3,2)) as decimal(12,2))"
            ),
        )
        .selectExpr(
            "l_orderkey * 10 + l_linenumber as sale_id",
            "l_shipdate as sale_date",
            "l_suppkey as store_id",
            "l_partkey as product_id",
            "o_custkey as customer_id",
            "cast(l_quantity as int) as quantity",
            "revenue",
            "cost",
            "cast(revenue - cost as decimal(12,2)) as profit",
        )
    )


_extracts: dict[tuple[str, str], str] = {}
_stored: dict[tuple[str, str], Stored] = {}
_lock = RLock()


def _session_key(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    return spark.sparkContext.applicationId, str(sf_dir)


def raw_tables(spark: SparkSession, sf_dir: str) -> RawTables:
    """The extract: the four files that the ETL starts from.

    Written once in a session, so that the checks and the load all read plain files
    and none repeats the join of lines to orders.
    """
    prepare(spark)
    key, folder = _session_key(spark, sf_dir), shared_folder(spark)
    mapped = {"stores": stores, "products": products, "customers": customers, "sales": sales}
    with _lock:
        if key not in _extracts:
            path = f"{folder}/extract-{len(_extracts)}"
            for name, build in mapped.items():
                build(spark, sf_dir).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
            _extracts[key] = path
        return read_raw(spark, _extracts[key])


def dirty_tables(spark: SparkSession, sf_dir: str) -> RawTables:
    """The same extract, all of it, with faults that each check has to find."""
    raw = raw_tables(spark, sf_dir)
    copies = raw.stores.where("region = 'ASIA'").withColumn("store_name", F.concat("store_name", F.lit(" copy")))
    return RawTables(
        raw.stores.unionByName(copies),
        raw.products,
        raw.customers.withColumn("city", F.expr("case when customer_id % 50 = 0 then null else city end")),
        raw.sales.selectExpr(
            "sale_id",
            "case when sale_id % 101 = 0 then null when sale_id % 103 = 0 then 'no date' "
            "when sale_id % 4 = 1 then date_format(sale_date, 'MM/dd/yyyy') when sale_id % 4 = 2 then date_format(sale_date, 'dd.MM.yyyy') "
            "when sale_id % 4 = 3 then date_format(sale_date, 'yyyyMMdd') else cast(cast(sale_date as date) as string) end as sale_date",
            "case when sale_id % 131 = 0 then -1 else store_id end as store_id",
            "case when sale_id % 137 = 0 then null else product_id end as product_id",
            "customer_id",
            "case when sale_id % 113 = 0 then 0 else quantity end as quantity",
            "case when sale_id % 107 = 0 then -revenue when sale_id % 109 = 0 then null else revenue end as revenue",
            "cost",
            "cast(case when sale_id % 127 = 0 then revenue + 1 else profit end as decimal(12,2)) as profit",
        ),
    )


@dataclass(frozen=True)
class Stored:
    """What the warehouse holds for one folder of test tables."""

    star: Star
    levels: DataFrame
    central: DataFrame


def inventory_levels(star: Star) -> DataFrame:
    """A stock row for each pair of store and product that sold 15 pieces or more."""
    return (
        star.fact.groupBy("store_id", "product_id")
        .agg(F.sum("quantity").alias("units"), F.max("date").alias("last_sale"))
        .where("units >= 15")
        .selectExpr(
            "store_id",
            "product_id",
            "cast((7 * store_id + 13 * product_id) % 60 as int) as current_quantity",
            "cast(5 + product_id % 10 as int) as min_quantity",
            "cast(case when product_id % 4 = 0 then 0 else 60 + product_id % 90 end as int) as max_quantity",
            "cast(product_id % 40 as int) as reorder_point",
            "cast(last_sale as timestamp_ntz) as last_updated",
        )
    )


def central_inventory(star: Star) -> DataFrame:
    """Central stock of everything but the promotion articles."""
    return star.dim_product.where("category <> 'PROMO'").selectExpr(
        "product_id", "cast(17 * product_id % 500 as int) as current_stock"
    )


def stored(spark: SparkSession, sf_dir: str) -> Stored:
    """The warehouse for ``sf_dir``: loaded once in a session by the ETL job, then read.

    Reports run on the loaded star, as they do for any user of the library.
    """
    prepare(spark)
    key = _session_key(spark, sf_dir)
    with _lock:
        if key not in _stored:
            star = run_etl(raw_tables(spark, sf_dir), f"{shared_folder(spark)}/star-{len(_stored)}", SALES_ORDER, reread=True)
            _stored[key] = Stored(
                star, settle(inventory_levels(star), "inventory_levels"), central_inventory(star)
            )
        return _stored[key]


def conformed(spark: SparkSession, sf_dir: str) -> Star:
    """The star as the conform step returns it, not yet written by month."""
    return conform(clean(raw_tables(spark, sf_dir), SALES_ORDER), unique_sales=True)


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as notification_id",
        "case when user_id % 3 = 0 then null else user_id end as user_id",
        "case when event_id % 4 = 0 then null else event_id % 10 end as store_id",
        "event_type as type",
        "concat('Event ', event_type) as title",
        "props as message",
        "case event_type when 'error' then 'critical' when 'purchase' then 'warning' else 'info' end as severity",
        "event_id % 2 = 0 as is_read",
        "ts as created_at",
    )


def read_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases count as seen; the receipts arrive twice."""
    seen = table(spark, sf_dir, "events").where("event_type = 'purchase'").selectExpr("event_id as notification_id")
    return reduce(DataFrame.unionByName, (seen, seen))


def users(dim_store: DataFrame) -> DataFrame:
    """A manager per store and the admin, as rows of the users table."""
    created = "cast(date_add(date'2020-01-01', cast(store_id % 365 as int)) as timestamp_ntz)"
    managers = dim_store.selectExpr(
        "store_id + 1 as user_id",
        "concat('store_', store_id) as username",
        "'store_manager' as role",
        "store_id",
        f"{created} as created_at",
        f"case when store_id % 2 = 0 then {created} + interval 90 minutes end as last_login",
        "store_id % 5 <> 0 as is_active",
    )
    admin = dim_store.sparkSession.range(1).selectExpr(
        "id as user_id",
        "'admin' as username",
        "'admin' as role",
        "cast(null as bigint) as store_id",
        "timestamp_ntz'2019-12-31 08:00:00' as created_at",
        "cast(null as timestamp_ntz) as last_login",
        "true as is_active",
    )
    return managers.unionByName(admin)


def dirty_star(spark: SparkSession, sf_dir: str) -> Star:
    """A star from the faulty extract, before the reference check."""
    return keyed(clean(dirty_tables(spark, sf_dir), SALES_ORDER))
