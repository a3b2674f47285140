"""Usage metering: measured quantities with provenance, prices, costs, statistics, budgets and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed as X

#: Bands that the values of a key are cut into to find a place among them.
BANDS_OF_VALUES = 10_000

#: Provenance as a number, so that the worst is the greatest.
ACTUAL, ESTIMATED, UNKNOWN = 0, 1, 2


def provenance(code: Column) -> Column:
    return F.when(code == ACTUAL, "actual").when(code == ESTIMATED, "estimated").otherwise("unknown")


def round6(c: Column) -> Column:
    """Six places, halves up."""
    return F.floor(c * 1e6 + 0.5) / 1e6


def prices(spark: SparkSession, rows=X.PRICES) -> DataFrame:
    return spark.createDataFrame(rows, "provider string, model string, currency string, input_per_million double, output_per_million double")


def normalize_usage(events: DataFrame) -> DataFrame:
    """Adds input/output/total tokens with provenance codes (in_src, out_src, total_src), and the defaults.

    Reported tokens are actual; else the estimated pair; else unknown. A total needs both parts. agent falls back to the
    provider, request_count to 1; numbers that are not finite count as null.
    """
    finite = lambda c: F.when(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")), None).otherwise(F.col(c).cast("double"))
    ri, ro, ei, eo = (finite(c) for c in ("reported_input", "reported_output", "estimated_input", "estimated_output"))
    reported = ri.isNotNull() | ro.isNotNull()
    value = lambda r, e: F.when(reported, r).otherwise(e)
    src = lambda v: F.when(v.isNull(), UNKNOWN).when(reported, ACTUAL).otherwise(ESTIMATED)
    i, o = value(ri, ei), value(ro, eo)
    return events.withColumns({
        "agent": F.coalesce("agent", "provider"), "request_count": F.coalesce(finite("request_count").cast("long"), F.lit(1).cast("long")), "latency_ms": finite("latency_ms"),
        "input_tokens": i, "output_tokens": o, "total_tokens": i + o, "in_src": src(i), "out_src": src(o), "total_src": src(i + o),
    })


def price_usage(usage: DataFrame, price_table: DataFrame) -> DataFrame:
    """usage with currency and prices; null where a model has no price. Spark broadcasts prices where they are small."""
    return usage.join(price_table, ["provider", "model"], "left")


def compute_cost(priced: DataFrame) -> DataFrame:
    """Adds cost, cost_src and cost_note: the first rule that leaves the cost unknown gives the note."""
    note = (
        F.when(F.col("currency").isNull(), "no price for this model").when(F.col("total_tokens").isNull(), "token total unknown")
        .when(F.col("input_tokens").isNull() | F.col("output_tokens").isNull(), "token split unknown").when(F.col("input_per_million").isNull() | F.col("output_per_million").isNull(), "price unknown")
    )
    amount = round6(F.col("input_tokens") / 1e6 * F.col("input_per_million") + F.col("output_tokens") / 1e6 * F.col("output_per_million"))
    return priced.withColumns({"cost": F.when(note.isNull(), amount), "cost_src": F.when(note.isNull(), F.greatest(F.col("total_src"), F.lit(ESTIMATED))).otherwise(UNKNOWN), "cost_note": note})


def sum_quantity(value: str, src: str, out: str) -> list[Column]:
    """Aggregates: the sum of known values (null when none is) and the worst provenance among them."""
    known = F.col(value).isNotNull()
    return [F.sum(value).alias(out), F.coalesce(F.max(F.when(known, F.col(src))), F.lit(UNKNOWN)).alias(f"{out}_src")]


def sum_cost(amount: str = "cost", src: str = "cost_src", currency: str = "currency") -> list[Column]:
    """Aggregates: cost only where all known amounts share one currency, rounded to 6 places; and its provenance."""
    known = F.col(amount).isNotNull()
    lo, hi = F.min(F.when(known, F.col(currency))), F.max(F.when(known, F.col(currency)))
    return [F.when(lo == hi, round6(F.sum(amount))).alias("cost"), F.when(lo == hi, F.max(F.when(known, F.col(src)))).otherwise(UNKNOWN).alias("cost_src"), F.when(lo == hi, lo).alias("currency")]


def usage_statistics(usage: DataFrame) -> DataFrame:
    """Events, requests, tokens, cost and latency over all, by provider and by day, in one pass of grouping sets."""
    u = usage.withColumn("day", F.to_date("occurred_at"))
    aggs = [F.count("*").alias("events"), F.sum("request_count").alias("requests")]
    for c, s in (("input_tokens", "in_src"), ("output_tokens", "out_src"), ("total_tokens", "total_src")):
        aggs += sum_quantity(c, s, c)
    aggs += sum_cost()
    aggs += [F.count("latency_ms").alias("latency_samples"), F.floor(F.avg("latency_ms") + 0.5).cast("long").alias("latency_avg"), F.max("latency_ms").alias("latency_max")]
    grouped = u.groupingSets([[], [F.col("provider")], [F.col("day")]], F.col("provider"), F.col("day")).agg(F.grouping_id().alias("gid"), *aggs)
    return grouped.withColumn("scope", F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, "provider").otherwise("day")).drop("gid")


def latency_stats(events: DataFrame, key: str, value: str) -> DataFrame:
    """samples, avg (rounded half up), max and p95 = the sorted value number floor((n-1) * 0.95), from 0.

    Counts by distinct value come first. A key's values are cut into bands of equal width between its least and greatest; the
    band that holds the wanted place is found from the bands' counts, and only that band's values are put in order.
    """
    hist = events.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    facts = hist.groupBy(key).agg(F.sum("c").alias("samples"), F.floor(F.sum(F.col(value) * F.col("c")) / F.sum("c") + 0.5).cast("long").alias("avg"), F.min(value).alias("least"), F.max(value).alias("max"))
    width = (F.col("max") - F.col("least")) / BANDS_OF_VALUES
    band = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("least")) / width), F.lit(BANDS_OF_VALUES - 1))).otherwise(F.lit(0).cast("long"))
    facts = facts.withColumn("__k", F.col(key)).drop(key)
    placed = hist.join(facts, F.col(key).eqNullSafe(F.col("__k"))).select(key, value, "c", "samples", "avg", "max", F.floor((F.col("samples") - 1) * 0.95).alias("at"), band.alias("band"))
    before = Window.partitionBy(key).orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = placed.groupBy(key, "band").agg(F.sum("c").alias("n"), F.max("at").alias("at"))
    wanted = bands.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where("before <= at and at < before + n").select(F.col(key).alias("__k"), F.col("band").alias("__b"), "before")
    inside = placed.join(wanted, F.col(key).eqNullSafe(F.col("__k")) & (F.col("band") == F.col("__b")))
    run = inside.withColumn("cum", F.col("before") + F.sum("c").over(Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    return run.where("cum > at").groupBy(key).agg(F.max("samples").alias("samples"), F.max("avg").alias("avg"), F.max("max").alias("max"), F.min(value).alias("p95"))


SCOPES = {"provider": "provider", "agent": "agent", "session": "session_id", "task": "task_id", "user": "user_id"}


def scope_consumption(usage: DataFrame, scopes: DataFrame) -> DataFrame:
    """scope_kind, scope_value, tokens, cost of the configured scopes (scope_kind, scope_value) only."""
    kinds = {k: c for k, c in SCOPES.items() if c in usage.columns}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("scope_kind"), F.col(c).cast("string").alias("scope_value")) for k, c in kinds.items()]))
    each = usage.select("total_tokens", "cost", pairs.alias("s")).select("total_tokens", "cost", "s.*")
    wanted = each.join(scopes.select("scope_kind", "scope_value").distinct(), ["scope_kind", "scope_value"], "left_semi")
    return wanted.groupBy("scope_kind", "scope_value").agg(F.sum("total_tokens").alias("tokens"), round6(F.sum("cost")).alias("cost"))


def budget_status(usage: DataFrame, budgets: DataFrame) -> DataFrame:
    """budgets (scope_kind, scope_value, token_limit, cost_limit) with what was consumed, in numbers and percent."""
    used = scope_consumption(usage, budgets)
    out = budgets.join(used, ["scope_kind", "scope_value"], "left")
    tokens, cost = F.coalesce("tokens", F.lit(0.0)), F.coalesce("cost", F.lit(0.0))
    pct = lambda a, b: F.when(F.col(b) > 0, F.round(a / F.col(b) * 100, 2))
    return out.select("scope_kind", "scope_value", "token_limit", "cost_limit", tokens.alias("tokens"), cost.alias("cost"), pct(tokens, "token_limit").alias("token_percent"), pct(cost, "cost_limit").alias("cost_percent"))


def check_limits(usage: DataFrame, limits: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (request_id, scope_kind, scope_value, projected_tokens, projected_cost) -> allowed and the reason if not.

    Denied when what was consumed and is projected would exceed a limit; reaching it is allowed, and no limit allows all.
    """
    status = budget_status(usage, limits)
    j = requests.join(status, ["scope_kind", "scope_value"], "left")
    over_t = F.coalesce(F.col("tokens") + F.col("projected_tokens") > F.col("token_limit"), F.lit(False))
    over_c = F.coalesce(F.col("cost") + F.col("projected_cost") > F.col("cost_limit"), F.lit(False))
    return j.select("request_id", (~(over_t | over_c)).alias("allowed"), F.when(over_t, "tokens").when(over_c, "cost").alias("reason"))


def order_usage(usage: DataFrame) -> DataFrame:
    return usage.orderBy("occurred_at", "id")


def extract_usage(responses: DataFrame) -> DataFrame:
    """responses (id, body as JSON) -> id, content, input/output/total tokens; both missing: null; one missing: 0 for it."""
    shape = "choices array<struct<message: struct<content: string>>>, usage struct<prompt_tokens: double, completion_tokens: double>"
    parsed = responses.select("id", F.from_json("body", shape).alias("r"))
    i, o = F.col("r.usage.prompt_tokens").cast("long"), F.col("r.usage.completion_tokens").cast("long")
    none = i.isNull() & o.isNull()
    zero = lambda c: F.when(none, None).otherwise(F.coalesce(c, F.lit(0).cast("long")))
    return parsed.select("id", F.coalesce(F.try_element_at(F.col("r.choices"), F.lit(1))["message"]["content"], F.lit("")).alias("content"), zero(i).alias("input_tokens"), zero(o).alias("output_tokens"), (zero(i) + zero(o)).alias("total_tokens"))
