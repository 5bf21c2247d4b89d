"""The value objects passed between the modules."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class RawTables:
    """The four tables of one extract, before or after cleaning."""

    stores: DataFrame
    products: DataFrame
    customers: DataFrame
    sales: DataFrame

    # (table, primary key), in the order the checks report them
    KEYS = (
        ("stores", "store_id"),
        ("products", "product_id"),
        ("customers", "customer_id"),
        ("sales", "sale_id"),
    )

    def items(self) -> list[tuple[str, str, DataFrame]]:
        return [(name, key, getattr(self, name)) for name, key in self.KEYS]


@dataclass(frozen=True)
class Star:
    """The conformed tables.

    Every foreign key of the fact exists in its dimension; ``conform`` sees to it. Where
    ``sale_id`` is known to be unique and never null, as after the load, ``unique_sales``
    says so, and counting sales needs no ids. The load then also keeps two small tables:
    ``daily`` has the sums of each date, store and product, which reports over those read
    instead of the sales, and ``sold`` the categories that each store has sold. Otherwise transactions are counted with
    an exact distinct count (one more shuffle of the ids). ``audience_daily`` and ``audience_monthly``
    hold who bought: customers as bits of 64 to a word (``operators.audience``).
    """

    fact: DataFrame
    dim_date: DataFrame
    dim_store: DataFrame
    dim_product: DataFrame
    dim_customer: DataFrame
    unique_sales: bool = False
    daily: DataFrame | None = None
    sold: DataFrame | None = None
    audience_daily: DataFrame | None = None
    audience_monthly: DataFrame | None = None


@dataclass(frozen=True)
class Scope:
    """Who asks. Everyone but an admin sees one store, or nothing without one."""

    role: str
    store_id: int | None = None
    user_id: int | None = None

    @property
    def is_admin(self) -> bool:
        return self.role == "admin"


ADMIN = Scope("admin")


def _parts(value: str | Iterable | None) -> tuple:
    if not value:
        return ()
    return tuple(value.split(",")) if isinstance(value, str) else tuple(value)


@dataclass(frozen=True)
class SalesFilter:
    """Report filter; lists may be given as sequences or comma-separated text.

    ``date_end=None`` means today. Both ends are inclusive. An empty list does
    not restrict. ``all_dates`` drops the date restriction altogether.
    """

    date_start: date = date(2023, 1, 1)
    date_end: date | None = None
    stores: str | Iterable = ()
    categories: str | Iterable = ()
    regions: str | Iterable = ()
    all_dates: bool = False

    def __post_init__(self):
        object.__setattr__(self, "stores", tuple(int(s) for s in _parts(self.stores)))
        object.__setattr__(self, "categories", _parts(self.categories))
        object.__setattr__(self, "regions", _parts(self.regions))

    @classmethod
    def trailing_years(cls, as_of: date, years: int = 1, **lists) -> SalesFilter:
        """The dashboard's default range (one year; two for forecasts)."""
        try:
            start = as_of.replace(year=as_of.year - years)
        except ValueError:  # 29 February rolls over to 1 March
            start = date(as_of.year - years, 3, 1)
        return cls(start, as_of, **lists)
