"""Data quality: profiles, rules and the score."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmart.functions.columns import percent
from salesmart.model import RawTables, Star
from salesmart.operators.dedupe import duplicate_count, keep_first, keep_first_sorted_apart
from salesmart.operators.keys import TOLD_WORDS, keep_keys
from salesmart.operators.quantile import approximate_quantiles, exact_quantiles
from salesmart.sources.shared import discard, settle

# The three rules in the order they are applied, with their report names.
RULES = (
    ("removed_negative_revenue", "revenue > 0"),
    ("removed_zero_quantity", "quantity > 0"),
    ("removed_invalid_profit", "profit <= revenue"),
)


def null_profile(df: DataFrame, table: str) -> DataFrame:
    """One row per column: nulls and their share of the rows, in one pass."""
    counted = df.agg(
        F.count("*").alias("_rows"),
        *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns),
    )
    return counted.unpivot("_rows", list(df.columns), "column_name", "nulls").select(
        F.lit(table).alias("table_name"),
        "column_name",
        "nulls",
        F.coalesce(percent(F.col("nulls"), F.col("_rows")), F.lit(0.0)).alias("null_pct"),
    )


def null_profiles(raw: RawTables) -> DataFrame:
    return reduce(DataFrame.unionByName, (null_profile(df, name) for name, _, df in raw.items()))


def duplicate_counts(raw: RawTables, names: Sequence[str] = ("stores", "products", "customers", "sales")) -> DataFrame:
    """One row per named table: duplicates of its primary key."""
    return reduce(
        DataFrame.unionByName,
        (
            duplicate_count(df, key).select(
                F.lit(name).alias("table_name"), F.lit(key).alias("key_column"), "duplicates"
            )
            for name, key, df in raw.items()
            if name in names
        ),
    )


def _fences(sales: DataFrame, column: str, exact: bool) -> Column:
    """Quartiles and the limits 1.5 interquartile ranges beyond them, as one scalar."""
    quantiles = exact_quantiles if exact else approximate_quantiles
    iqr = F.col("q3") - F.col("q1")
    limits = quantiles(sales, column, {"q1": 0.25, "q3": 0.75}).select(
        "q1", "q3", (F.col("q1") - 1.5 * iqr).alias("lower_bound"), (F.col("q3") + 1.5 * iqr).alias("upper_bound")
    )
    return limits.select(F.struct(*limits.columns)).scalar()


def _outlier_counts(column: str, fences: Column) -> list[Column]:
    value = F.col(column).cast("double")
    outside = (value < fences["lower_bound"]) | (value > fences["upper_bound"])
    share = F.coalesce(percent(F.count_if(outside), F.count("*")), F.lit(0.0))
    return [F.count_if(outside).alias("outliers"), share.alias("outlier_pct")]


def outlier_summary(sales: DataFrame, column: str = "revenue", exact: bool = True) -> DataFrame:
    """One row: quartiles, the 1.5 IQR fences, and how many rows lie outside."""
    fences = _fences(sales, column, exact)
    return sales.agg(*_outlier_counts(column, fences)).select(
        *(fences[name].alias(name) for name in ("q1", "q3", "lower_bound", "upper_bound")),
        "outliers",
        "outlier_pct",
    )


# Tried in this order after ISO text; of day and month with slashes the month comes first.
DATE_FORMATS = ("M/d/yyyy", "yyyy/M/d", "d.M.yyyy", "yyyyMMdd", "MMM d, yyyy", "d MMM yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss")


def with_parsed_date(sales: DataFrame, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Text dates become timestamps by the first format that fits; what none reads becomes null."""
    if dict(sales.dtypes)["sale_date"] != "string":
        return sales
    text = F.trim("sale_date")
    tried = (F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats)
    return sales.withColumn("sale_date", F.coalesce(text.try_cast("timestamp_ntz"), *tried))


def drop_invalid_dates(sales: DataFrame) -> DataFrame:
    return with_parsed_date(sales).where(F.col("sale_date").isNotNull())


def missing_ids(sales: DataFrame) -> DataFrame:
    """One row: sales without an id, which can be no facts, among all."""
    return sales.agg(F.count_if(F.col("sale_id").isNull()).alias("missing_ids"), F.count("*").alias("sales"))


def date_summary(sales: DataFrame) -> DataFrame:
    """One row: rows with and without a usable date."""
    bad = F.col("sale_date").isNull()
    return with_parsed_date(sales).agg(
        F.count_if(bad).alias("invalid_dates"), F.count_if(~bad).alias("valid_dates")
    )


def with_reject_reason(sales: DataFrame) -> DataFrame:
    """Name the first rule a row breaks, null for a good row; a null value breaks the rule."""
    reason = F.lit(None).cast("string")
    for name, rule in reversed(RULES):
        reason = F.when(F.coalesce(F.expr(rule), F.lit(False)), reason).otherwise(F.lit(name))
    return sales.withColumn("reject_reason", reason)


def apply_business_rules(sales: DataFrame) -> DataFrame:
    return with_reject_reason(sales).where("reject_reason is null").drop("reject_reason")


def _rule_counts(among: Column) -> list[Column]:
    reason = F.col("reject_reason")
    return [
        *(F.count_if(among & (reason == name)).alias(name) for name, _ in RULES),
        F.count_if(among & reason.isNotNull()).alias("total_removed"),
        F.count_if(among & reason.isNull()).alias("rows_kept"),
    ]


def rule_summary(sales: DataFrame) -> DataFrame:
    """One row: rows removed by each rule, each row charged to the first it breaks."""
    return with_reject_reason(sales).agg(*_rule_counts(F.lit(True)))


def _sales_findings(sales: DataFrame, exact: bool) -> DataFrame:
    """Outliers, dates and rules in one pass: (check_name, item, value). The rules count
    rows with a valid date only, as they are applied after the dates."""
    dated = F.col("sale_date").isNotNull()
    found = with_reject_reason(with_parsed_date(sales)).agg(
        *_outlier_counts("revenue", _fences(sales, "revenue", exact)),
        F.count_if(~dated).alias("invalid_dates"),
        *_rule_counts(dated),
    )
    checks = {
        "outliers": ["outliers", "outlier_pct"],
        "data_types": ["invalid_dates"],
        "business_rules": [name for name, _ in RULES] + ["total_removed"],
    }
    items = [item for group in checks.values() for item in group]
    check = F.coalesce(*(F.when(F.col("item").isin(group), name) for name, group in checks.items()))
    doubles = found.select(*(F.col(item).cast("double").alias(item) for item in items))
    return doubles.unpivot([], items, "item", "value").withColumn("check_name", check)


def quality_report(
    raw: RawTables, sales_order: Sequence[str] | None = None, exact: bool = True
) -> DataFrame:
    """Every check in one long table (check_name, table_name, item, value).

    Nulls and duplicates are counted on the raw tables; outliers, dates and rules
    on the deduplicated sales. Their few columns that these checks read are stored once,
    and deleted when the report, a small stored table itself, is made. How many duplicates
    the sales had follows from the numbers of rows.
    """
    first = keep_first(raw.sales, "sale_id", sales_order)
    sales = settle(first.select("sale_date", "revenue", "quantity", "profit"), "deduplicated_sales")
    report = settle(_report(raw, sales, exact), "quality_report")
    discard(sales)
    return report


def _report(raw: RawTables, sales: DataFrame, exact: bool) -> DataFrame:
    nulls = null_profiles(raw).where("nulls > 0").select(
        F.lit("missing_values").alias("check_name"),
        "table_name",
        F.col("column_name").alias("item"),
        F.col("nulls").cast("double").alias("value"),
    )
    all_rows, first_rows = (df.agg(F.count("*").alias(n)) for df, n in ((raw.sales, "rows"), (sales, "first")))
    beyond = all_rows.withColumn("duplicates", F.col("rows") - first_rows.scalar()).select(
        F.lit("sales").alias("table_name"), F.lit("sale_id").alias("key_column"), "duplicates"
    )
    duplicates = duplicate_counts(raw, ("stores", "products", "customers")).unionByName(beyond).select(
        F.lit("duplicates").alias("check_name"),
        "table_name",
        F.col("key_column").alias("item"),
        F.col("duplicates").cast("double").alias("value"),
    )
    findings = _sales_findings(sales, exact).withColumn("table_name", F.lit("sales"))
    return nulls.unionByName(duplicates).unionByName(findings)


def quality_score(report: DataFrame) -> DataFrame:
    """One row: 100 less the penalties, never below 0.

    Fixed values: the weights and caps of the penalties.
    """
    found = F.sum("value")
    excess = F.sum(F.when(F.col("item") == "outlier_pct", F.col("value"))) - 5
    removed = F.sum(F.when(F.col("item") == "total_removed", F.col("value")))
    check = F.col("check_name")
    penalty = (
        F.when(check == "missing_values", F.least(F.lit(20.0), found * 0.1))
        .when(check == "duplicates", F.least(F.lit(15.0), found * 0.1))
        .when(check == "outliers", F.greatest(F.lit(0.0), F.least(F.lit(10.0), excess * 0.5)))
        .when(check == "business_rules", F.least(F.lit(15.0), removed * 0.01))
        .otherwise(0.0)
    )
    return (
        report.groupBy("check_name", "table_name")
        .agg(penalty.alias("penalty"))
        .agg(F.greatest(F.lit(0.0), 100 - F.coalesce(F.sum("penalty"), F.lit(0.0))).alias("quality_score"))
    )


def clean(raw: RawTables, sales_order: Sequence[str] | None = None, reread: bool = False) -> RawTables:
    """Deduplicate every table, then drop sales with a bad date or a broken rule.

    ``reread`` says that sales are cheap to read several times, as Parquet is and workbooks aren't.
    """
    sales = (keep_first_sorted_apart if reread else keep_first)(raw.sales, "sale_id", sales_order)
    return RawTables(
        keep_first(raw.stores, "store_id"),
        keep_first(raw.products, "product_id"),
        keep_first(raw.customers, "customer_id"),
        sales.transform(drop_invalid_dates).transform(apply_business_rules),
    )


REFERENCES = ("store", "product", "customer", "date")
BROADCAST_KEYS = 64 * TOLD_WORDS  # what that many words of bits hold


def _keys(star: Star, name: str) -> tuple[DataFrame, str]:
    """The keys of a dimension. Those of the dates are broadcast: the calendar bounds
    them. For the others the planner broadcasts what it knows or measures to be small,
    and otherwise sort-merges with skewed keys split. ``keep_valid_references`` counts them."""
    key = f"{name}_id"
    keys = getattr(star, f"dim_{name}").select(key)
    return (F.broadcast(keys) if name == "date" else keys), key


def keep_valid_references(fact: DataFrame, star: Star, names: Sequence[str] = REFERENCES) -> DataFrame:
    """Semi joins with the named dimensions; a null key has no match.

    Keys go to every executor as words of bits, so that the fact, which is far larger, needn't be shuffled.
    """
    for name in names:
        keys, key = _keys(star, name)
        fact = fact.join(keys, key, "left_semi") if name == "date" else keep_keys(fact, keys, key, BROADCAST_KEYS)
    return fact


def rejected_references(fact: DataFrame, star: Star) -> DataFrame:
    """Rows whose keys do not all exist, with the first dimension that lacks one."""
    found = {name: f"_has_{name}" for name in REFERENCES}
    missing = F.lit(None).cast("string")
    for name in reversed(REFERENCES):
        missing = F.when(F.col(found[name]).isNull(), name).otherwise(missing)
    for name in REFERENCES:
        keys, key = _keys(star, name)
        fact = fact.join(keys.withColumn(found[name], F.lit(True)), key, "left")
    return fact.withColumn("missing", missing).where("missing is not null").drop(*found.values())
