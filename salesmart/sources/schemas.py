"""Explicit schemas; nothing is inferred when reading."""

from __future__ import annotations

# What the ETL reads.
STORES = "store_id bigint, store_name string, city string, region string, store_type string, opening_date date"
PRODUCTS = "product_id bigint, product_name string, category string, brand string, price decimal(12,2), cost decimal(12,2)"
CUSTOMERS = "customer_id bigint, customer_name string, gender string, age int, age_group string, email string, city string"
SALES = (
    "sale_id bigint, sale_date timestamp_ntz, store_id bigint, product_id bigint, customer_id bigint, "
    "quantity int, revenue decimal(12,2), cost decimal(12,2), profit decimal(12,2)"
)
RAW = {"stores": STORES, "products": PRODUCTS, "customers": CUSTOMERS, "sales": SALES}

# What the warehouse holds. ``date``, ``year`` and ``month`` ride along in the fact:
# the date for row-group skipping, year and month as the partition columns.
DIM_DATE = (
    "date_id int, date date, day int, month int, quarter int, year int, month_name string, "
    "quarter_name string, day_of_week string, is_weekend boolean, is_holiday boolean"
)
DIM_STORE = STORES
DIM_PRODUCT = PRODUCTS
DIM_CUSTOMER = "customer_id bigint, customer_name string, gender string, age int, age_group string, city string"
FACT_COLUMNS = [
    "sale_id", "date_id", "store_id", "product_id", "customer_id",
    "quantity", "revenue", "cost", "profit",
]
FACT = (
    "sale_id bigint, date_id int, store_id bigint, product_id bigint, customer_id bigint, quantity int, "
    "revenue decimal(12,2), cost decimal(12,2), profit decimal(12,2), date date, year int, month int"
)
DAILY = (
    "date date, store_id bigint, product_id bigint, quantity bigint, revenue decimal(22,2), cost decimal(22,2), "
    "profit decimal(22,2), sales bigint, priced bigint, year int, month int"
)
SOLD = "store_id bigint, category string"
AUDIENCE_DAILY = (
    "date date, store_id bigint, category string, age_group string, gender string, word bigint, members bigint, "
    "revenue decimal(32,2), priced bigint, year int, month int"
)
AUDIENCE_MONTHLY = (
    "store_id bigint, category string, age_group string, gender string, word bigint, members bigint, "
    "revenue decimal(32,2), priced bigint, year int, month int"
)
WAREHOUSE = {
    "dim_date": DIM_DATE,
    "dim_store": DIM_STORE,
    "dim_product": DIM_PRODUCT,
    "dim_customer": DIM_CUSTOMER,
    "fact": FACT,
    "daily": DAILY,
    "sold": SOLD,
    "audience_daily": AUDIENCE_DAILY,
    "audience_monthly": AUDIENCE_MONTHLY,
}

INVENTORY_LEVELS = (
    "store_id bigint, product_id bigint, current_quantity int, min_quantity int, max_quantity int, "
    "reorder_point int, last_updated timestamp_ntz"
)
CENTRAL_INVENTORY = "product_id bigint, current_stock int"
