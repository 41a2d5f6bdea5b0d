"""Price lookup and cost roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeline import PART, carried, in_parts


#: Prices of an image by model and resolution; the first model has one price.
PRICES = {
    "nano-banana": {"512": 0.039, "1K": 0.039, "2K": 0.039, "4K": 0.039},
    "nano-banana-pro": {"512": 0.134, "1K": 0.134, "2K": 0.134, "4K": 0.24},
    "nano-banana-2": {"512": 0.045, "1K": 0.067, "2K": 0.101, "4K": 0.151},
}


def unit_price(model: str, resolution: str) -> Column:
    """Price of one image; null for a model or resolution without one."""
    out = F.lit(None).cast("double")
    for name, by in PRICES.items():
        for size, price in by.items():
            out = F.when((F.col(model) == name) & (F.col(resolution) == size), price).otherwise(out)
    return F.when(F.col(model) == "nano-banana", PRICES["nano-banana"]["1K"]).otherwise(out)


def price_unit(price_type: str) -> Column:
    return F.when(F.col(price_type) == "per-run", "image").when(F.col(price_type).isNotNull(), "second")


def cost_quantities(nodes: DataFrame) -> DataFrame:
    """The nodes that cost, with provider, model_id, quantity and unit.

    ``nodes``: type, provider and model_id of a chosen model, model and resolution of the older kind,
    is_configured, target_count. Image nodes count once, video nodes once if a model is chosen, split
    grids as often as they are configured to make images.
    """
    kind, chosen = F.col("type"), F.col("model_id").isNotNull()
    grid = (kind == "splitGrid") & F.coalesce("is_configured", F.lit(False)) & (F.col("target_count") > 0)
    quantity = F.when(kind == "nanoBanana", 1).when((kind == "generateVideo") & chosen, 1).when(grid, F.col("target_count"))
    own = chosen & ~grid
    out = nodes.withColumns({
        "quantity": quantity.cast("long"), "provider": F.when(own, F.col("provider")).otherwise("gemini"), "model_id": F.when(own, F.col("model_id")).otherwise(F.col("model")),
        "resolution": F.when(F.col("model") == "nano-banana", "1K").otherwise(F.col("resolution")), "unit": F.when(kind == "generateVideo", "video").otherwise("image"),
    })
    return out.where("quantity is not null")


def price_lookup(items: DataFrame, prices: DataFrame, fixed: DataFrame, model: str = "model", resolution: str = "resolution") -> DataFrame:
    """unit_price from the price table by model, else from the fixed table by model and resolution, else null."""
    out = items.join(prices.select(model, F.col("price").alias("_p")), model, "left")
    out = out.join(fixed.select(model, resolution, F.col("price").alias("_f")), [model, resolution], "left")
    return out.withColumn("unit_price", F.coalesce("_p", "_f")).drop("_p", "_f")


def cost_breakdown(items: DataFrame, keys: list[str], ord_: str, quantity: str = "quantity", price: str = "unit_price") -> DataFrame:
    """Count, first unit price and subtotal of each key; the subtotal is null where the first price is, later nulls add nothing."""
    first = F.min_by(F.struct(F.col(price).alias("p")), F.col(ord_))["p"]
    total = F.sum(F.coalesce(F.col(quantity) * F.col(price), F.lit(0.0)))
    return items.groupBy(*keys).agg(F.sum(quantity).alias("n"), first.alias("unit_price"), F.when(first.isNotNull(), total).alias("subtotal"))


def cost_total(breakdown: DataFrame) -> DataFrame:
    return breakdown.agg(F.coalesce(F.sum("subtotal"), F.lit(0.0)).alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.coalesce(F.sum(F.when(F.col("subtotal").isNull(), F.col("n"))), F.lit(0)).alias("unknown"))


def cost_by_provider(items: DataFrame, provider: str, known: list[str], quantity: str = "quantity") -> DataFrame:
    """Providers outside the known list: number of entries and of items."""
    return other_items(items, provider, known).groupBy(provider).agg(F.count("*").alias("entries"), F.sum(quantity).alias("n"))


def other_items(items: DataFrame, provider: str, known: list[str]) -> DataFrame:
    """The items themselves, a row each, of providers outside the known list."""
    return items.where(~F.col(provider).isin(*known))


def any_other_provider(nodes: DataFrame, key: str, provider: str, known: list[str]) -> DataFrame:
    return nodes.groupBy(key).agg(F.bool_or(F.coalesce(~F.col(provider).isin(*known), F.lit(False))).alias("any_other"))


def running_cost(charges: DataFrame, key: str, ord_: list[str], amount: str, reset: str | None = None, long: bool = False) -> DataFrame:
    """Cost so far within each key; a reset row starts again from nothing.

    ``long``: for few keys with many rows, which are summed in parts (``timeline.in_parts``); a part adds what those
    since the last reset before it come to, until its own first reset.
    """
    rows, groups = (in_parts(charges, [key], ord_), [key, PART]) if long else (charges, [key])
    w = Window.partitionBy(*groups).orderBy(*ord_).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumns({"_reset": F.coalesce(F.col(reset), F.lit(False)) if reset else F.lit(False)})
    marked = marked.withColumn("_epoch", F.sum(F.col("_reset").cast("int")).over(w))
    inner = Window.partitionBy(*groups, "_epoch").orderBy(*ord_).rowsBetween(Window.unboundedPreceding, 0)
    done = marked.withColumn("incurred", F.sum(F.when(F.col("_reset"), 0.0).otherwise(F.col(amount))).over(inner))
    if long:
        facts = {"_resets": F.max("_epoch"), "_tail": F.max_by(F.coalesce("incurred", F.lit(0.0)), F.struct(*ord_))}
        since = lambda w: F.aggregate(F.collect_list(F.struct("_resets", "_tail")).over(w), F.lit(0.0), lambda a, x: F.when(x["_resets"] > 0, x["_tail"]).otherwise(a + x["_tail"]))
        done = carried(done, [key], facts, {"_since": since})
        done = done.withColumn("incurred", F.when((F.col("_epoch") == 0) & (F.coalesce("_since", F.lit(0.0)) != 0), F.coalesce("incurred", F.lit(0.0)) + F.col("_since")).otherwise(F.col("incurred"))).drop("_since", PART)
    return done.drop("_reset", "_epoch")
