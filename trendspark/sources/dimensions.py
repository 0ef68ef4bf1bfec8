"""Literal dimensions (O-SRC9 model prices, README cost ranges)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from trendspark.operators.common import literal_dim

# Model price list, USD per 1M tokens (input, output), with labels.
MODEL_PRICES = [
    ("openai", "gpt-5", "5.00", "15.00", "GPT-5 (Next generation, highest capability)"),
    ("openai", "gpt-4o", "2.50", "10.00", "GPT-4o (Most capable, higher cost)"),
    ("openai", "gpt-4o-mini", "0.150", "0.600", "GPT-4o Mini (Balanced performance and cost)"),
    ("openai", "o1-preview", "15.00", "60.00", "O1 Preview (Advanced reasoning, highest cost)"),
    ("openai", "o1-mini", "3.00", "12.00", "O1 Mini (Fast reasoning, moderate cost)"),
    ("openai", "o1", "15.00", "60.00", "O1 (Advanced reasoning)"),
    ("openai", "gpt-4-turbo", "10.00", "30.00", "GPT-4 Turbo (Previous generation, powerful)"),
    ("openai", "gpt-4-turbo-preview", "10.00", "30.00", "GPT-4 Turbo Preview"),
    ("openai", "gpt-4-0125-preview", "10.00", "30.00", "GPT-4 0125 Preview"),
    ("openai", "gpt-4-1106-preview", "10.00", "30.00", "GPT-4 1106 Preview"),
    ("openai", "gpt-4", "30.00", "60.00", "GPT-4 (Legacy, slower)"),
    ("openai", "gpt-4-0613", "30.00", "60.00", "GPT-4 0613"),
    ("openai", "gpt-3.5-turbo", "0.50", "1.50", "GPT-3.5 Turbo (Fastest, lowest cost)"),
    ("openai", "gpt-3.5-turbo-0125", "0.50", "1.50", "GPT-3.5 Turbo 0125"),
    ("openai", "gpt-3.5-turbo-1106", "1.00", "2.00", "GPT-3.5 Turbo 1106"),
    ("claude", "claude-3-5-sonnet-20241022", "3.00", "15.00", "Claude 3.5 Sonnet (Latest)"),
    ("claude", "claude-3-5-haiku-20241022", "0.80", "4.00", "Claude 3.5 Haiku (Fast)"),
    ("claude", "claude-3-opus-20240229", "15.00", "75.00", "Claude 3 Opus"),
    ("claude", "claude-3-sonnet-20240229", "3.00", "15.00", "Claude 3 Sonnet"),
    ("claude", "claude-3-haiku-20240307", "0.25", "1.25", "Claude 3 Haiku"),
]

PRICE_SCHEMA = "provider string, model string, input_per_m decimal(10,4), output_per_m decimal(10,4), label string"

# Published per-article cost ranges (USD, min, max) by model.
COST_RANGES = [
    ("GPT-4o Mini", "0.003", "0.01"), ("GPT-5", "0.10", "0.30"), ("O1 Mini", "0.06", "0.18"),
    ("GPT-4o", "0.05", "0.15"), ("O1 Preview", "0.30", "0.90"), ("Claude 3 Haiku", "0.005", "0.025"),
    ("Claude 3.5 Haiku", "0.02", "0.08"), ("Claude 3.5 Sonnet", "0.04", "0.20"), ("Claude 3 Sonnet", "0.04", "0.20"),
    ("Claude 3 Opus", "0.20", "1.00"), ("GPT-4 Turbo", "0.10", "0.30"), ("GPT-3.5 Turbo", "0.01", "0.03"),
]
ARTICLES_PER_DAY = [120, 240]


def model_prices(spark: SparkSession) -> DataFrame:
    rows = [(p, m, Decimal(i), Decimal(o), lab) for p, m, i, o, lab in MODEL_PRICES]
    return literal_dim(spark, rows, PRICE_SCHEMA)


def cost_ranges(spark: SparkSession) -> DataFrame:
    rows = [(m, Decimal(lo), Decimal(hi)) for m, lo, hi in COST_RANGES]
    return literal_dim(spark, rows, "model string, min_cost decimal(10,4), max_cost decimal(10,4)")
