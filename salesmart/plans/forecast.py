"""Monthly history and forecasts, for one series or for many at once.

``by`` names the columns that tell series apart, such as ``("store_id",)``. The
fact is reduced to one row per series and month before anything else, so a series
is at most a few hundred rows; the number of series is not limited.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesmart.functions import likelihood, likelihood_many, series, trend
from salesmart.functions.columns import month_name, period_label
from salesmart.functions.series import months_needed
from salesmart.model import SalesFilter, Scope, Star
from salesmart.operators.sales import select_sales, select_totals
from salesmart.sources.shared import settle

LEAST_MONTHS = 3
TASKS_PER_CORE = 4

# the fits travel to the workers with the task, installed there or not
for _fits in (series, likelihood, likelihood_many, trend):
    cloudpickle.register_pickle_by_value(_fits)


def monthly_history(
    star: Star, flt: SalesFilter, scope: Scope, by: Sequence[str] = ()
) -> DataFrame:
    select = select_totals if set(by) <= {"store_id", "product_id"} else select_sales
    return (
        select(star, flt, scope)
        .groupBy(*by, "year", "month")
        .agg(F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"))
        .withColumn("month_name", month_name(F.col("month")))
    )


def history_or_fallback(star: Star, flt: SalesFilter, scope: Scope) -> DataFrame:
    """The filtered history; with under three months, everything the caller may see.

    The choice needs the number of months, so the history (one row per month) is
    stored, counted and then read again instead of being computed twice.
    """
    for chosen in (flt, SalesFilter(all_dates=True)):
        history = settle(monthly_history(star, chosen, scope), "monthly_history")
        if history.limit(LEAST_MONTHS).count() == LEAST_MONTHS:
            return history
    raise ValueError(f"a forecast needs {LEAST_MONTHS} months with sales, and there are fewer")


def with_period(history: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number the observed months of a series 0, 1, 2 …; missing months leave no gap."""
    order = W.partitionBy(*by).orderBy("year", "month")
    return history.withColumn("period", F.row_number().over(order) - 1)


def linear_trend(history: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line and R² of revenue and profit, one row per series.

    Series with fewer than three months are left out; ``skipped_series`` lists them.
    """
    def fit(measure: str) -> list:
        y = F.col(measure).cast("double")
        return [
            f(y, F.col("period")).alias(f"{measure}_{name}")
            for name, f in (("slope", F.regr_slope), ("intercept", F.regr_intercept), ("r2", F.regr_r2))
        ]

    return (
        with_period(history, by)
        .groupBy(*by)
        .agg(
            F.count("*").alias("months"),
            F.max(F.make_date("year", "month", F.lit(1))).alias("last_month"),
            *fit("revenue"),
            *fit("profit"),
        )
        .where(F.col("months") >= LEAST_MONTHS)
    )


def future_months(trend: DataFrame, ahead: int) -> DataFrame:
    """The ``ahead`` month starts after the last observed month of each series."""
    return trend.select("*", F.explode(F.sequence(F.lit(1), F.lit(ahead))).alias("step")).withColumn(
        "date", F.add_months("last_month", F.col("step"))
    )


def skipped_series(
    history: DataFrame, by: Sequence[str] = (), model: str = "linear", arima_order: str = "1,1,1"
) -> DataFrame:
    """The series that a forecast leaves out: their keys, ``months`` and the ``reason``."""
    needed = months_needed(parse_order(arima_order)) if model.lower() == "arima" else 0
    months = F.col("months")
    reason = F.when(months < LEAST_MONTHS, f"fewer than {LEAST_MONTHS} months").when(months < needed, f"the order needs {needed} months")
    return history.groupBy(*by).agg(F.count("*").alias("months")).withColumn("reason", reason).where("reason is not null")


def _labelled(forecast: DataFrame, language: str) -> DataFrame:
    return forecast.withColumn("month_name", month_name(F.col("month"), language)).withColumn(
        "is_forecast", F.lit(True)
    )


def linear_forecast(
    history: DataFrame, ahead: int = 6, by: Sequence[str] = (), language: str = "en"
) -> DataFrame:
    period = F.col("months") - 1 + F.col("step")
    values = future_months(linear_trend(history, by), ahead).select(
        *by,
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        *(
            (F.col(f"{m}_intercept") + F.col(f"{m}_slope") * period).alias(m)
            for m in ("revenue", "profit")
        ),
    )
    return _labelled(values, language)


Paths = list[tuple[np.ndarray, str]]  # of each series its path and what was fitted


def _one_by_one(fit: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, str]]) -> Callable[[np.ndarray, np.ndarray], Paths]:
    return lambda months, values: [fit(m, y) for m, y in zip(months, values)]


def _forecast_by_fit(
    history: DataFrame,
    ahead: int,
    by: Sequence[str],
    language: str,
    fit: Callable[[np.ndarray, np.ndarray], Paths],
    least: int = LEAST_MONTHS,
) -> DataFrame:
    """Run ``fit(months, values)`` on series of one length, a series in each row of its two arrays.

    ``fitted`` tells what was fitted to revenue and to profit. Series of fewer than
    ``least`` months have no rows; ``skipped_series`` lists them.
    """
    by = list(by)

    def series_of(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        at, revenue, profit = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("_at", "_revenue", "_profit"))
        lengths = pc.list_value_length(batch.column("_at")).to_numpy(zero_copy_only=False)
        begin = np.cumsum(lengths) - lengths
        rows, years, paths, told = [], [], ([], []), []
        for n in sorted(set(lengths[lengths >= least])):
            chosen = np.flatnonzero(lengths == n)
            places = begin[chosen][:, None] + np.arange(n)
            months = at[places]
            found = fit(np.vstack([months, months]), np.vstack([revenue[places], profit[places]]))
            for k, row in enumerate(chosen):
                both = found[k], found[k + len(chosen)]
                rows.append(row)
                years.append(months[k, -1] + np.arange(1, ahead + 1))
                told.append(both[0][1] if both[0][1] == both[1][1] else "; ".join(t for _, t in both))
                for path, (values, _) in zip(paths, both):
                    path.append(values)
        if not rows or not ahead:
            return None
        month = np.concatenate(years)
        columns = [batch.column(c).take(pa.array(np.repeat(rows, ahead))) for c in by]
        columns += [pa.array(x, pa.int64()) for x in (month // 12, month % 12 + 1)]
        columns += [pa.array(np.concatenate(path), pa.float64()) for path in paths]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.repeat(told, ahead).tolist(), pa.string())], names)

    kinds = dict(history.dtypes)
    names = [*by, "year", "month", "revenue", "profit", "fitted"]
    made = dict.fromkeys(("year", "month"), "bigint") | dict.fromkeys(("revenue", "profit"), "double") | {"fitted": "string"}
    at = (F.col("year") * 12 + F.col("month") - 1).cast("bigint")
    rows = history.select(*by, F.struct(at.alias("at"), *(F.col(m).cast("double").alias(m) for m in ("revenue", "profit"))).alias("_month"))
    if by:
        # a fixed number of tasks: the rows are few, but each series takes time to fit, less beside many others
        spark = rows.sparkSession
        tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
        rows = rows.repartition(tasks, *by)
    # one row per series, so that a task has many to fit at once
    series_rows = rows.groupBy(*by).agg(F.sort_array(F.collect_list("_month")).alias("_months")).select(
        *by, *(F.col(f"_months.{m}").alias(f"_{m}") for m in ("at", "revenue", "profit"))
    )
    found = series_rows.mapInArrow(
        lambda batches: filter(None.__ne__, map(series_of, batches)), ", ".join(f"{c} {made.get(c) or kinds[c]}" for c in names)
    )
    return _labelled(found.withColumns({c: F.col(c).cast(kinds[c]) for c in ("year", "month")}), language)


def arima_forecast(
    history: DataFrame,
    order: tuple[int, int, int] = (1, 1, 1),
    ahead: int = 6,
    by: Sequence[str] = (),
    language: str = "en",
    method: str = "likelihood",
) -> DataFrame:
    """By exact likelihood, or with ``method="conditional"`` by the least sum of squared one-step errors."""
    fits = {
        "likelihood": lambda _, y: likelihood_many.likelihood_paths(y, order, ahead),
        "conditional": _one_by_one(lambda _, y: series.arima_path(y, order, ahead)),
    }
    return _forecast_by_fit(history, ahead, by, language, fits[method], max(LEAST_MONTHS, months_needed(order)))


def seasonal_forecast(
    history: DataFrame,
    ahead: int = 6,
    by: Sequence[str] = (),
    language: str = "en",
    harmonics: int = 3,
    changepoints: int = trend.PLACES,
    prior: float = trend.PRIOR,
) -> DataFrame:
    """A line that may bend at up to ``changepoints`` months, with yearly waves; the smaller ``prior``, the fewer bends."""
    path = trend.trend_path
    return _forecast_by_fit(history, ahead, by, language, _one_by_one(lambda m, y: path(m, y, ahead, harmonics, changepoints, prior)))


def parse_order(text: str) -> tuple[int, int, int]:
    """ARIMA order from text such as "1,1,1"."""
    try:
        p, d, q = (int(part) for part in text.split(","))
        if min(p, d, q) < 0:
            raise ValueError(text)
    except ValueError:
        raise ValueError(f"{text!r} is no ARIMA order: three whole numbers such as 1,1,1") from None
    return p, d, q


def forecast(
    history: DataFrame,
    model: str = "linear",
    ahead: int = 6,
    arima_order: str = "1,1,1",
    by: Sequence[str] = (),
    language: str = "en",
) -> DataFrame:
    """Forecast rows by the named model; an unknown name means linear."""
    match model.lower():
        case "arima":
            return arima_forecast(history, parse_order(arima_order), ahead, by, language)
        case "prophet" | "seasonal":
            return seasonal_forecast(history, ahead, by, language)
        case _:
            return linear_forecast(history, ahead, by, language)


def with_history(history: DataFrame, forecasted: DataFrame) -> DataFrame:
    """History and forecast in one table, with a label such as 1997-05."""
    past = history.withColumns({m: F.col(m).cast("double") for m in ("revenue", "profit")})
    return (
        past.unionByName(forecasted, allowMissingColumns=True)
        .withColumn("is_forecast", F.coalesce("is_forecast", F.lit(False)))
        .withColumn("label", period_label(F.col("year"), F.col("month")))
    )


def sales_forecast(
    star: Star,
    flt: SalesFilter,
    scope: Scope,
    ahead: int = 6,
    model: str = "linear",
    arima_order: str = "1,1,1",
    language: str = "en",
) -> DataFrame:
    """The whole forecast report for one filter: history, then ``ahead`` months."""
    history = history_or_fallback(star, flt, scope)
    return with_history(history, forecast(history, model, ahead, arima_order, language=language))
