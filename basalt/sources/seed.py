"""A seeded fixture of a small shop in normalised tables, made by Spark from row numbers alone.

Every value is a function of the seed and the row's id, so any number of rows is made in parallel
and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CITIES = (("Lisbon", "Portugal"), ("Porto", "Portugal"), ("Turin", "Italy"), ("Bari", "Italy"), ("Graz", "Austria"), ("Linz", "Austria"))


def _draw(seed: int, what: str, n: int) -> Column:
    """0 to n - 1 by the row's id."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), F.col("id")), F.lit(n))


def shop(spark: SparkSession, customers: int = 120, products: int = 30, orders: int = 1000, seed: int = 42) -> dict[str, DataFrame]:
    """customers, addresses, products, orders, order_items, address_changes and returns."""
    place = lambda k, i: F.element_at(F.array(*[F.lit(c[i]) for c in CITIES]), (k + 1).cast("int"))
    c = spark.range(1, customers + 1)
    home = _draw(seed, "city", len(CITIES))
    moved = F.pmod(home + 1 + _draw(seed, "to", len(CITIES) - 1), F.lit(len(CITIES)))
    mover = _draw(seed, "mover", 12) == 0
    now = F.when(mover, moved).otherwise(home)
    out = {
        "customers": c.select(F.col("id").alias("customer_id"), F.format_string("Customer %04d", "id").alias("full_name"), F.format_string("c%04d@example.org", "id").alias("email"), F.date_add(F.lit("2023-01-01").cast("date"), _draw(seed, "since", 365).cast("int")).alias("created_at")),
        "addresses": c.select(F.col("id").alias("address_id"), F.col("id").alias("customer_id"), place(now, 0).alias("city"), place(now, 1).alias("country"), F.lit(True).alias("is_default")),
        "address_changes": c.filter(mover).select(F.col("id").alias("change_id"), F.col("id").alias("customer_id"), place(home, 0).alias("old_city"), place(home, 1).alias("old_country"), place(moved, 0).alias("new_city"), place(moved, 1).alias("new_country"), F.date_add(F.lit("2024-01-01").cast("date"), _draw(seed, "when", 700).cast("int")).alias("changed_on")),
        "products": spark.range(1, products + 1).select(F.col("id").alias("product_id"), F.format_string("SKU-%03d", "id").alias("sku"), F.concat(F.lit("Product "), F.col("id").cast("string")).alias("name"), F.concat(F.lit("category "), (F.col("id") % 6).cast("string")).alias("category"), (F.lit(100) + _draw(seed, "price", 9900)).cast("decimal(12,0)").alias("cents")),
    }
    o = spark.range(1, orders + 1).withColumns({"customer_id": 1 + _draw(seed, "who", customers), "order_date": F.date_add(F.lit("2024-01-01").cast("date"), _draw(seed, "day", 731).cast("int"))})
    state = _draw(seed, "state", 20)
    o = o.withColumn("status", F.when(state == 0, "cancelled").when(state == 1, "returned").when(state < 4, "shipped").otherwise("delivered"))
    out["orders"] = o.select(F.col("id").alias("order_id"), "customer_id", "order_date", "status")
    lines = o.select("id", "status", "order_date", F.explode(F.sequence(F.lit(1), (1 + _draw(seed, "lines", 6)).cast("int"))).alias("line_no")).withColumn("order_id", F.col("id")).withColumn("id", F.col("order_id") * 10 + F.col("line_no"))
    lines = lines.withColumns({"product_id": 1 + _draw(seed, "what", products), "quantity": 1 + _draw(seed, "many", 12), "discount_pct": (_draw(seed, "off", 26) / 100).cast("decimal(4,2)")})
    price = out["products"].select("product_id", (F.col("cents") / 100).cast("decimal(12,2)").alias("unit_price"))
    items = lines.join(price, "product_id")
    out["order_items"] = items.select("order_id", "line_no", "product_id", "quantity", "unit_price", "discount_pct")
    net = F.round(F.col("quantity").cast("decimal(6,0)") * F.col("unit_price") * (1 - F.col("discount_pct")), 2)
    back = 1 + F.pmod(F.xxhash64(F.lit(seed), F.lit("back"), F.col("id")), F.col("quantity"))
    out["returns"] = items.filter("status = 'returned'").withColumn("back", back).select(F.col("id").alias("return_id"), "order_id", "line_no", F.date_add("order_date", (3 + _draw(seed, "after", 12)).cast("int")).alias("return_date"), F.col("back").alias("quantity"), F.round(net * F.col("back").cast("decimal(6,0)") / F.col("quantity").cast("decimal(6,0)"), 2).cast("decimal(14,2)").alias("refund_amount"))
    return out
