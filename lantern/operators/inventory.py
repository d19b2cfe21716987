"""Inventory, health and coverage of a corpus; the ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inventory(records: DataFrame, key: str, content: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, distinct ids, and rows with and without content, by the given columns or over all."""
    has = F.coalesce(F.trim(content) != "", F.lit(False))
    return records.groupBy(*by).agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_ids"), F.count_if(has).alias("with_content"), F.count_if(~has).alias("without_content"))


def histogram(records: DataFrame, kind: str, subtype: str) -> DataFrame:
    return records.groupBy(kind, F.coalesce(F.col(subtype), F.lit("")).alias(subtype)).agg(F.count("*").alias("n"))


def health(records: DataFrame, kind: str, required: Sequence[str]) -> DataFrame:
    """One row (present, missing, status)."""
    wanted = F.array(*[F.lit(x) for x in required])
    row = records.agg(F.array_sort(F.collect_set(kind)).alias("present"))
    row = row.withColumn("missing", F.array_sort(F.array_except(wanted, "present")))
    return row.withColumn("status", F.when(F.size("missing") == 0, "ok").when(F.size("present") == 0, "empty").otherwise("incomplete"))


def coverage(records: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """How many rows have each column, neither null nor empty."""
    filled = lambda c: F.count_if(F.coalesce(F.col(c).cast("string") != "", F.lit(False))).alias(f"has_{c}")
    return records.groupBy(*by).agg(F.count("*").alias("total"), *[filled(c) for c in columns])


def root_cause(candidates: Column, filtered: Column, selected: Column, errors: Column) -> Column:
    """Why a search has no result."""
    return F.when(errors > 0, "backend_error").when(selected > 0, "results").when(candidates == 0, "no_candidates").when(filtered == 0, "all_filtered").otherwise("selection_empty")


def balances(ledger: DataFrame, account: str, amount: str) -> DataFrame:
    return ledger.groupBy(account).agg(F.sum(amount).alias("balance"))


def profiles_with_balances(profiles: DataFrame, ledger: DataFrame, account: str, amount: str) -> DataFrame:
    """All accounts of either side; a missing balance is 0."""
    own = balances(ledger, account, amount)
    known = profiles.withColumn("has_profile", F.lit(True))
    return known.join(own, account, "full_outer").withColumn("has_profile", F.coalesce("has_profile", F.lit(False))).withColumn("balance", F.coalesce("balance", F.lit(0)))
