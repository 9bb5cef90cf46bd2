"""Features of daily price-change targets: own history, competitors' changes and prices, category context.

Shocks are averaged per day before they meet targets, and the range of days becomes an equality by exploding each
shock over the days it can reach: the joins are plain hash or merge joins on product, city, pack and date.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quayside.functions.columns import changed
from quayside.settings import Settings
from quayside.sources.contract import OFFER

ROW = [*OFFER, "date"]
PACK = ["unit", "quantity", "pack_count"]
WINDOWS = (1, 3, 7, 14)


@dataclass(frozen=True)
class Variant:
    """Which rows and which links of products count."""

    matching: str = "confidence"
    exclude_promotions: bool = False
    max_age_days: int | None = None

    def __post_init__(self) -> None:
        if self.matching not in ("confidence", "barcode"):
            raise ValueError("matching must be confidence or barcode")
        if self.max_age_days is not None and (type(self.max_age_days) is not int or self.max_age_days < 0):
            raise ValueError("max_age_days must be a non-negative integer")


def feature_base(panel: DataFrame, cfg: Settings) -> DataFrame:
    family = F.col("retailer_id")
    if cfg.feed_groups:
        pairs = F.create_map(*[F.lit(x) for kv in cfg.feed_groups.items() for x in kv])
        family = F.coalesce(F.try_element_at(pairs, "retailer_id"), family)
    keep = [*ROW, "canonical_product_id", "city_id", "category_id", "barcodes", *PACK, "price", "previous_price", "log_return", "state_age_days", "is_promotion", "previous_promotion", "previous_match_eligible", "previous_canonical", "lag_return", "lag_state_age", "lag_date"]
    rows = panel.filter("match_eligible and outcome_eligible")
    return rows.select(*keep, family.alias("feed_family"), F.coalesce("lag_promotion", F.lit(False)).alias("lag_promotion"))


def _variant(df: DataFrame, v: Variant) -> DataFrame:
    df = df.filter("previous_match_eligible and canonical_product_id = previous_canonical")
    if v.max_age_days is not None:
        df = df.filter((F.col("state_age_days") <= v.max_age_days) & (F.col("lag_state_age") <= v.max_age_days))
    return df.filter("not is_promotion and not previous_promotion") if v.exclude_promotions else df


def targets(base: DataFrame, v: Variant = Variant()) -> DataFrame:
    return _variant(base, v).filter(F.col("lag_date") == F.date_sub("date", 1))


def shocks(base: DataFrame, v: Variant = Variant()) -> DataFrame:
    return _variant(base, v).filter(changed(F.col("log_return")))


def _reach(df: DataFrame, n: int) -> DataFrame:
    """Each row once for each of the ``n`` following days: lag_days and target_date."""
    return df.withColumn("lag_days", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("target_date", F.expr("date_add(source_date, lag_days)"))


def peer_daily_source(t: DataFrame, s: DataFrame, cfg: Settings, v: Variant = Variant()) -> DataFrame:
    """For each target: retailers of other families that changed the same product and pack nearby in time, by day."""
    keys = ["canonical_product_id", "city_id", *PACK]
    left = t.filter("quantity > 0 and pack_count > 0").select(*ROW, *keys, F.col("feed_family").alias("own_family"), F.col("barcodes").alias("own_barcodes"))
    source = s.select(*keys, F.col("feed_family"), F.col("retailer_id").alias("source_retailer"), F.col("date").alias("source_date"), "log_return", "barcodes")
    n = max(cfg.exposure_days, 14)
    if v.matching == "barcode":  # the condition is per source offer, so shocks meet targets one by one
        pairs = left.join(_reach(source, n).withColumnRenamed("target_date", "date"), [*keys, "date"])
        pairs = pairs.filter("own_family <> feed_family").filter(F.arrays_overlap("own_barcodes", "barcodes"))
        return pairs.groupBy(*ROW, "source_retailer", "source_date", "lag_days").agg(F.avg("log_return").alias("mark"))
    pairs = _daily_pairs(left, source, keys, n)
    return pairs.groupBy(*ROW, "source_retailer", "source_date", "lag_days").agg((F.sum("marks") / F.sum("n")).alias("mark"))


def _daily_pairs(left: DataFrame, source: DataFrame, keys: list[str], n: int) -> DataFrame:
    daily = source.groupBy(*keys, "feed_family", "source_retailer", "source_date").agg(F.sum("log_return").alias("marks"), F.count(F.lit(1)).alias("n"))
    return left.join(_reach(daily, n).withColumnRenamed("target_date", "date"), [*keys, "date"]).filter("own_family <> feed_family")


def peer_summary(t: DataFrame, s: DataFrame, cfg: Settings, v: Variant = Variant()) -> DataFrame:
    """What ``assemble`` takes of the peers, a row for each target with any.

    A target has one product, city and pack, so the groups contain the keys of the join: pairs of targets and shocks,
    by far the most rows, stay in the partitions where they meet, and one row a target leaves.
    """
    keys = ["canonical_product_id", "city_id", *PACK]
    if v.matching == "barcode":
        by, pairs = ROW, peer_daily_source(t, s, cfg, v)
    else:
        left = t.filter("quantity > 0 and pack_count > 0").select(*ROW, *keys, F.col("feed_family").alias("own_family"))
        source = s.select(*keys, "feed_family", F.col("retailer_id").alias("source_retailer"), F.col("date").alias("source_date"), "log_return")
        by = [*ROW, *keys]
        pairs = _daily_pairs(left, source, keys, max(cfg.exposure_days, 14)).groupBy(*by, "source_retailer", "source_date", "lag_days").agg((F.sum("marks") / F.sum("n")).alias("mark"))
    near = F.col("lag_days") <= cfg.exposure_days
    each = pairs.groupBy(*by, "source_retailer").agg(
        F.count_if(near).alias("active_days"), F.avg(F.when(near, F.col("mark"))).alias("mean_mark"), F.sum(F.when(near, F.exp(-F.col("lag_days")))).alias("decayed_count"),
        *[F.count_if(F.col("lag_days") <= n).alias(f"active_{n}d") for n in WINDOWS],
    )
    return each.groupBy(*by).agg(
        F.sum("active_days").alias("peer_active_days"), F.avg("mean_mark").alias("peer_mark"), F.sum("decayed_count").alias("peer_decay"),
        *[F.sum(f"active_{n}d").alias(f"peer_active_{n}d") for n in WINDOWS],
    ).drop(*keys)


def retailer_exposures(peers: DataFrame, cfg: Settings) -> DataFrame:
    near = peers.filter(F.col("lag_days") <= cfg.exposure_days)
    return near.groupBy(*ROW, "source_retailer").agg(F.count(F.lit(1)).alias("active_days"), F.avg("mark").alias("mean_mark"), F.sum(F.exp(-F.col("lag_days"))).alias("decayed_count"), F.avg("lag_days").alias("mean_lag_days"))


def daily_peer_prices(base: DataFrame) -> DataFrame:
    by = ["date", "canonical_product_id", "city_id", "feed_family", *PACK]
    return base.filter("price > 0").groupBy(*by).agg(F.min("price").alias("minimum_price"), F.avg("price").alias("mean_price"), F.count(F.lit(1)).alias("offers"))


def competitor_context(t: DataFrame, prices: DataFrame) -> DataFrame:
    keys = ["canonical_product_id", "city_id", *PACK]
    left = t.select(*ROW, *keys, F.col("feed_family").alias("own_family"))
    day_after = prices.withColumn("date", F.date_add("date", 1))
    pairs = left.join(day_after, ["date", *keys]).filter("own_family <> feed_family")
    return pairs.groupBy(*ROW, *keys).agg(F.min("minimum_price").alias("cheapest_peer_price"), (F.sum(F.col("mean_price") * F.col("offers")) / F.sum("offers")).alias("mean_peer_price"), F.count(F.lit(1)).alias("peer_families")).drop(*keys)  # grouped where the rows met


def own_history(t: DataFrame) -> DataFrame:
    offer = Window.partitionBy(*OFFER)
    before = offer.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    by_day = offer.orderBy(F.unix_date("date"))
    hit = changed(F.col("log_return"))
    rates = {f"own_change_rate_{n}d": F.avg(hit.cast("double")).over(by_day.rangeBetween(-n, -1)) for n in (7, 30, 90)}
    return t.select(*ROW, F.datediff("date", F.max(F.when(hit, F.col("date"))).over(before)).alias("days_since_own_change"), *[c.alias(k) for k, c in rates.items()])


def group_activity(s: DataFrame) -> DataFrame:
    """Shocks of several stores of a retailer for one product and pack on a day count once."""
    return s.select("date", "retailer_id", "feed_family", "city_id", "category_id", "canonical_product_id", *PACK).distinct()


def category_activity(groups: DataFrame) -> DataFrame:
    return groups.groupBy("date", "city_id", "category_id").agg(F.count(F.lit(1)).alias("n"))


def product_context(t: DataFrame, groups: DataFrame, cfg: Settings) -> DataFrame:
    """Recent activity in the same product: of the own retailer in other cities, and of anyone in the own city and category."""
    near = _reach(groups.withColumnRenamed("date", "source_date"), cfg.exposure_days)
    side = near.select(F.col("target_date").alias("date"), "canonical_product_id", F.col("retailer_id").alias("r"), F.col("city_id").alias("c"), F.col("category_id").alias("k"), F.col("unit").alias("u"), F.col("quantity").alias("q"), F.col("pack_count").alias("m"))
    pairs = t.select(*ROW, "canonical_product_id", "city_id", "category_id", *PACK).join(side, ["date", "canonical_product_id"])
    same_pack = F.col("u").eqNullSafe(F.col("unit")) & F.col("q").eqNullSafe(F.col("quantity")) & F.col("m").eqNullSafe(F.col("pack_count"))
    return pairs.groupBy(*ROW, "canonical_product_id").agg(
        F.count_if((F.col("c") != F.col("city_id")) & (F.col("r") == F.col("retailer_id")) & same_pack).alias("cross_city_count"),
        F.count_if((F.col("c") == F.col("city_id")) & (F.col("k") == F.col("category_id"))).alias("same_product_count"),
    ).drop("canonical_product_id")  # grouped where the rows met


def rolling_activity(activity: DataFrame, cfg: Settings) -> DataFrame:
    """Sums over the days before, by city and category; the city's total is over named categories."""
    near = _reach(activity.withColumnRenamed("date", "source_date"), cfg.exposure_days).filter("category_id is not null")
    by_category = near.groupBy(F.col("target_date").alias("date"), "city_id", "category_id").agg(F.sum("n").alias("category_n"))
    return by_category


def contextual_exposures(t: DataFrame, product: DataFrame, rolling: DataFrame) -> DataFrame:
    city = rolling.groupBy("date", "city_id").agg(F.sum("category_n").alias("city_n"))
    df = t.select(*ROW, "city_id", "category_id").join(product, ROW, "left").join(rolling, ["date", "city_id", "category_id"], "left").join(city, ["date", "city_id"], "left")
    own = F.coalesce("category_n", F.lit(0))
    return df.select(
        *ROW, F.coalesce("cross_city_count", F.lit(0)).alias("cross_city_count"),
        F.greatest(own - F.coalesce("same_product_count", F.lit(0)), F.lit(0)).alias("category_count"),
        F.when(F.col("category_id").isNull(), 0).otherwise(F.coalesce("city_n", F.lit(0)) - own).alias("cross_category_count"),
    )


def assemble(t: DataFrame, peers: DataFrame, competitor: DataFrame, history: DataFrame, context: DataFrame) -> DataFrame:
    df = t.join(peers, ROW, "left").join(competitor, ROW, "left").join(history, ROW, "left").join(context, ROW, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    gap = lambda c: F.when((F.col("previous_price") > 0) & (F.col(c) > 0), F.log(F.col("previous_price") / F.col(c))).otherwise(0.0)
    return df.select(
        *ROW, "canonical_product_id", "city_id", "category_id", changed(F.col("log_return")).cast("int").alias("changed"), F.col("log_return").alias("magnitude"),
        "lag_promotion", F.coalesce("lag_return", F.lit(0.0)).alias("lag_return"), "lag_state_age", (F.dayofweek("date") - 1).alias("day_of_week"),
        zero("peer_active_days"), F.coalesce("peer_mark", F.lit(0.0)).alias("peer_mark"), F.coalesce("peer_decay", F.lit(0.0)).alias("peer_decay"),
        *[zero(f"peer_active_{n}d") for n in WINDOWS], F.coalesce("days_since_own_change", F.lit(3650)).alias("days_since_own_change"),
        *[F.coalesce(f"own_change_rate_{n}d", F.lit(0.0)).alias(f"own_change_rate_{n}d") for n in (7, 30, 90)],
        gap("cheapest_peer_price").alias("cheapest_peer_log_gap"), gap("mean_peer_price").alias("mean_peer_log_gap"),
        F.coalesce((F.col("previous_price") <= F.col("cheapest_peer_price")).cast("int"), F.lit(0)).alias("was_cheapest"),
        F.coalesce("peer_families", F.lit(0)).alias("priced_peer_families"), zero("cross_city_count"), zero("category_count"), zero("cross_category_count"),
    )


def build_features(panel: DataFrame, cfg: Settings, v: Variant = Variant()) -> DataFrame:
    return features_of(feature_base(panel, cfg), cfg, v)


def features_of(base: DataFrame, cfg: Settings, v: Variant = Variant()) -> DataFrame:
    """``base`` is read many times; a stored table saves most of the work and of the plan."""
    t, s = targets(base, v), shocks(base, v)
    groups = group_activity(s)
    rolling = rolling_activity(category_activity(groups), cfg)
    return assemble(t, peer_summary(t, s, cfg, v), competitor_context(t, daily_peer_prices(base)), own_history(t), contextual_exposures(t, product_context(t, groups, cfg), rolling))
