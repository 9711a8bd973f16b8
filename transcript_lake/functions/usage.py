"""Token and cost expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSES = ["input", "output", "cache_write_5m", "cache_write_1h", "cache_read", "reasoning"]

# Fixed values of the cost model.
TIER_TOKENS = 200_000
ONE_HOUR_WRITE_FACTOR = 2.0
DEFAULT_CACHE_WRITE_FACTOR = 1.25
DEFAULT_CACHE_READ_FACTOR = 0.1
WARNING_SHARE = 0.8


def zero(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)).cast("long")


def total_tokens() -> Column:
    """Sum of the six token classes."""
    out = zero(CLASSES[0])
    for c in CLASSES[1:]:
        out = out + zero(c)
    return out


def context_tokens() -> Column:
    """What the model had to read: input and all cache classes."""
    return zero("input") + zero("cache_read") + zero("cache_write_5m") + zero("cache_write_1h")


def cache_creation_count(flat: Column, five: Column, hour: Column) -> Column:
    """The flat count unless it is 0, else the sum of the detailed ones."""
    return F.when(F.coalesce(flat, F.lit(0)) != 0, flat).otherwise(zero(five) + zero(hour))


def cache_creation_split(flat: Column, detail: Column) -> tuple[Column, Column]:
    """(5 minutes, 1 hour): the detail if there is one, else the flat count as 5 minutes. The precedence differs from cache_creation_count on purpose."""
    five = F.when(detail.isNotNull(), zero(detail["ephemeral_5m_input_tokens"])).otherwise(zero(flat))
    return five, F.when(detail.isNotNull(), zero(detail["ephemeral_1h_input_tokens"])).otherwise(F.lit(0).cast("long"))


def tiered_cost(tokens: Column, base: Column, above: Column) -> Column:
    """tokens at base, and those beyond TIER_TOKENS at above where a rate above is given."""
    over = F.greatest(tokens - TIER_TOKENS, F.lit(0))
    return F.when(above.isNotNull() & (tokens > TIER_TOKENS), F.lit(TIER_TOKENS) * base + over * above).otherwise(tokens * base)


def raw_cost(rates: Column) -> Column:
    """Cost of the classes at a struct of per-token rates (fields as of pricing.RATES)."""
    rate = lambda name: F.coalesce(rates[name], F.lit(0.0))
    return (
        tiered_cost(zero("input"), rate("input"), rates["input_above"])
        + tiered_cost(zero("output") + zero("reasoning"), rate("output"), rates["output_above"])
        + tiered_cost(zero("cache_write_5m"), rate("cache_write"), rates["cache_write_above"])
        + zero("cache_write_1h") * rate("input") * ONE_HOUR_WRITE_FACTOR
        + tiered_cost(zero("cache_read"), rate("cache_read"), rates["cache_read_above"])
    )


def entry_cost(native: Column, rates: Column, mode: str = "auto") -> Column:
    """The log's own cost wherever there is one, 0 included, in every mode; in mode display nothing is computed."""
    if mode not in ("auto", "calculate", "display"):
        raise ValueError(f"unknown cost mode {mode!r}")
    own = F.lit(0.0) if mode == "display" else F.when(rates.isNotNull(), raw_cost(rates)).otherwise(F.lit(0.0))
    return F.coalesce(native, own)


def missing_model(native: Column, rates: Column, mode: str = "auto") -> Column:
    """The model's name where tokens had to be priced and no price was found."""
    if mode == "display":
        return F.lit(None).cast("string")
    return F.when(native.isNull() & rates.isNull() & (total_tokens() > 0), F.col("model"))


def limit_status(current: Column, projected: Column, limit: Column | int) -> Column:
    """ok, warning (over 80 percent) or exceeds; the projection decides where there is one."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    value = F.when(F.coalesce(projected, F.lit(0)) > 0, projected).otherwise(current)
    return F.when(limit <= 0, "ok").when(value > limit, "exceeds").when(value > limit * WARNING_SHARE, "warning").otherwise("ok")


def normal_key(name: Column) -> Column:
    return F.translate(name, ".@", "--")


def key_pattern(key: Column) -> Column:
    """Matches values that hold key as a whole name: no letter or digit beside it, nor, after a digit, the start of a further
    version number; an eight-digit date is none."""
    quoted = F.regexp_replace(key, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    version = F.when(key.rlike("[0-9]$"), F.lit(r"(?![-.](?!\d{8}(?![0-9A-Za-z]))\d)")).otherwise(F.lit(""))
    return F.concat(F.lit("(^|[^A-Za-z0-9])"), quoted, F.lit("($|"), version, F.lit("[^A-Za-z0-9])"))


def holds_key(value: Column, key: Column) -> Column:
    return (F.length(key) > 0) & F.regexp_like(value, key_pattern(key))


def names_match(model: Column, key: Column) -> Column:
    """Either name holds the other, as they stand or with dots and at-signs read as hyphens."""
    a, b = normal_key(model), normal_key(key)
    return holds_key(model, key) | holds_key(key, model) | holds_key(a, b) | holds_key(b, a)
