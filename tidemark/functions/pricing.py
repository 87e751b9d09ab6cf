"""Model prices: tables with overrides, cost estimates, age notes, and curated files.

A price file is JSON: {"generated_at": ..., "entries": {model: {provider, input, output,
cache_read, cache_write}}}, in dollars a token.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STALE_DAYS = 30
#: What cost_basis says of an estimate.
ESTIMATED = "estimated_from_bundled_pricing_table"
#: Rows of a price table that may be broadcast.
MOST_BROADCAST = 100_000
_RATES = ("input", "output", "cache_read", "cache_write")
_SCHEMA = "model string, " + ", ".join(f"{r} double" for r in _RATES)

# Providers whose own prices are kept, and prefixes of models that others resell.
PROVIDERS = ("anthropic", "openai", "gemini", "vertex_ai-language-models", "xai", "deepseek", "mistral")
RESELLERS = (
    "azure/", "azure_ai/", "bedrock/", "bedrock_converse/", "vertex_ai/", "vertex_ai_beta/", "databricks/", "anyscale/", "together_ai/",
    "fireworks_ai/", "openrouter/", "groq/", "perplexity/", "cerebras/", "sagemaker/", "sagemaker_chat/", "watsonx/", "replicate/",
    "cloudflare/", "friendliai/", "nvidia_nim/", "deepinfra/", "nscale/", "novita/",
)


def price_table(spark: SparkSession, rows: dict[str, dict]) -> DataFrame:
    """Rows of prices a token from {model: {input, output, cache_read?, cache_write?}}."""
    rate = lambda r, k: None if r.get(k) is None else float(r[k])
    return spark.createDataFrame([(m, *(rate(r, k) for k in _RATES)) for m, r in sorted(rows.items())], _SCHEMA)


def load_prices(path: str | None) -> tuple[dict[str, dict], str | None]:
    """(entries by model, generated_at) of a file; a missing or broken file is an empty table, an entry without both rates is skipped."""
    try:
        with open(path or "", encoding="utf-8") as file:
            found = json.load(file)
    except (OSError, ValueError):
        return {}, None
    if not isinstance(found, dict):
        return {}, None
    entries = found.get("entries") if isinstance(found.get("entries"), dict) else {}
    return {m: e for m, e in entries.items() if isinstance(e, dict) and {"input", "output"} <= e.keys()}, found.get("generated_at")


def load_overlaid(path: str | None, override: str | None = None) -> tuple[dict[str, dict], str | None]:
    """A file's entries with those of an override in their place, model by model; the newer time of the two holds."""
    (entries, made), (own, own_made) = load_prices(path), load_prices(override)
    return entries | own, max(filter(None, (made, own_made)), default=None)


def overlaid(table: DataFrame, override: DataFrame) -> DataFrame:
    """A table with whole rows replaced or added by model."""
    return table.join(override, "model", "left_anti").unionByName(override)


def curate(listing: DataFrame, providers: tuple[str, ...] = PROVIDERS, resellers: tuple[str, ...] = RESELLERS) -> DataFrame:
    """Of a price listing the models of some providers, without resellers, with both rates."""
    keep = F.col("provider").isin(*providers) & F.col("input").isNotNull() & F.col("output").isNotNull()
    for prefix in resellers:
        keep = keep & ~F.col("model").startswith(prefix)
    return listing.where(keep).orderBy("model")


def read_listing(spark: SparkSession, text: str) -> DataFrame:
    """Rows (model, provider, rates) of a public listing: a JSON object of models with their costs a token."""
    kind = "struct<litellm_provider:string,input_cost_per_token:double,output_cost_per_token:double,cache_read_input_token_cost:double,cache_creation_input_token_cost:double>"
    # Entry by entry, so that one odd entry loses itself only.
    found = spark.createDataFrame([(m, json.dumps(e)) for m, e in json.loads(text).items() if isinstance(e, dict)], "model string, e string").select("model", F.from_json("e", kind).alias("e"))
    costs = {"input": "input_cost_per_token", "output": "output_cost_per_token", "cache_read": "cache_read_input_token_cost", "cache_write": "cache_creation_input_token_cost"}
    return found.select("model", F.col("e.litellm_provider").alias("provider"), *[F.col(f"e.{cost}").alias(rate) for rate, cost in costs.items()])


def write_prices(listing: DataFrame, path: str, now: datetime | None = None) -> int:
    """Write the curated listing as a price file; returns its number of models."""
    rows = {r["model"]: {k: v for k, v in r.asDict().items() if k != "model"} for r in curate(listing).collect()}
    made = (now or datetime.now(timezone.utc)).isoformat().replace("+00:00", "Z")
    with open(path, "w", encoding="utf-8") as file:
        json.dump({"generated_at": made, "entries": rows}, file, indent=1)
    return len(rows)


def cost_of(entries: dict[str, dict], model: str | None, tokens_in: int | None, tokens_out: int | None, cache_read: int | None = None, cache_write: int | None = None) -> float | None:
    """Dollars of one call by the rates of exactly that model; None without a price or any token count."""
    rates = entries.get(model or "")
    if rates is None or (tokens_in is None and tokens_out is None):
        return None
    counted = zip((tokens_in, tokens_out, cache_read, cache_write), _RATES, strict=True)
    return float(sum(n * rates[r] for n, r in counted if n and rates.get(r) is not None))


def estimate(events: DataFrame, prices: DataFrame, cache_read: Column | None = None, cache_write: Column | None = None) -> DataFrame:
    """Add estimated_usd, as cost_of does; the table is broadcast if it is counted to be small."""
    few = prices.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    held = events.join(F.broadcast(prices) if few else prices, "model", "left")
    zero = F.lit(0)
    extra = lambda tokens, rate: F.lit(0.0) if tokens is None else F.coalesce(tokens * F.col(rate), F.lit(0.0))
    total = F.coalesce("tokens_in", zero) * F.col("input") + F.coalesce("tokens_out", zero) * F.col("output") + extra(cache_read, "cache_read") + extra(cache_write, "cache_write")
    counted = F.col("tokens_in").isNotNull() | F.col("tokens_out").isNotNull()
    return held.withColumn("estimated_usd", F.when(counted, total)).drop(*_RATES)


def age_days(generated_at: str | None, now: datetime | None = None) -> int | None:
    try:
        made = datetime.fromisoformat((generated_at or "").replace("Z", "+00:00"))
    except ValueError:
        return None
    return ((now or datetime.now(timezone.utc)) - (made if made.tzinfo else made.replace(tzinfo=timezone.utc))).days


def age_note(generated_at: str | None, now: datetime | None = None) -> str | None:
    """A line about the table's age, with advice once it is stale."""
    age = age_days(generated_at, now)
    if age is None:
        return None
    note = f"pricing table generated {generated_at} ({age} day(s) old)"
    return note + f"; over {STALE_DAYS} days old, update it" * (age > STALE_DAYS)


def projected_monthly(cost: float, calls: int, calls_per_day: int = 1000) -> float | None:
    """Dollars a month at a daily number of calls, from the cost of those seen."""
    return None if calls <= 0 or calls_per_day <= 0 else cost / calls * calls_per_day * 30
