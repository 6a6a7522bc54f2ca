"""Underwriting: behaviour of a packet, affordability, reconciliation, completeness, identity status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vettra.functions import fixed, scalars


def behaviour(docs: DataFrame) -> DataFrame:
    """Timing features of each packet from (packet_id, created, submitted)."""
    hours = (scalars.micros(F.min("submitted")) - scalars.micros(F.max("created"))) / F.lit(3_600_000_000)
    two = F.count("created") >= 2
    return docs.groupBy("packet_id").agg(
        F.coalesce(F.greatest(F.lit(0.0), hours), F.lit(0.0)).alias("velocity_hours"),
        F.when(two, scalars.floor_days(F.max("created"), F.min("created"))).otherwise(0).cast("long").alias("gap_days"),
        (two & (F.date_trunc("minute", F.min("created")) == F.date_trunc("minute", F.max("created")))).alias("same_minute"),
        F.coalesce(F.bool_and(F.col("created") <= F.col("submitted")), F.lit(True)).alias("all_before"),
        F.count(F.lit(1)).alias("doc_count"),
    )


def affordability(df: DataFrame, amount: Column, net_monthly: Column, months: Column, existing: Column | None = None) -> DataFrame:
    """emi, max_eligible, foir and verdict; no verdict but INFO without an amount."""
    existing = F.lit(0.0) if existing is None else existing
    instalment = scalars.emi(amount, months)
    foir = F.try_divide(existing + instalment, net_monthly)
    verdict = F.when(foir.isNull(), "INFO").when(foir <= fixed.FOIR_CAP, "ELIGIBLE").when(foir <= fixed.FOIR_REFER, "REFER").otherwise("DECLINE")
    spare = F.greatest(F.lit(0.0), fixed.FOIR_CAP * net_monthly - existing)
    return df.withColumns({"emi": instalment, "max_eligible": scalars.max_principal(spare, months), "foir": foir, "verdict": verdict})


def reconcile(df: DataFrame, slip: Column, bank: Column) -> DataFrame:
    """Slip against bank within 15 %, bank credits from 55 to 105 % of the stated amount."""
    gap = F.abs(slip - bank) / F.greatest(slip, bank)
    near = F.when((slip == 0) | (bank == 0), "unknown").when(gap <= 0.15, "consistent").otherwise("inconsistent")
    share = F.try_divide(bank, slip)
    return df.withColumns({"slip_bank": near, "bank_gross": F.when((share >= 0.55) & (share <= 1.05), "plausible").otherwise("implausible")})


def slots(purpose: str) -> list[tuple[str, bool, int]]:
    """(slot, required, place) of a purpose."""
    required, optional = fixed.PROFILES[purpose]
    return [(s, True, i) for i, s in enumerate(required)] + [(s, False, len(required) + i) for i, s in enumerate(optional)]


def missing_slots(packets: DataFrame, present: DataFrame, purpose: str) -> DataFrame:
    """Required slots that a packet lacks, with their place; each is a LOW finding."""
    wanted = F.array(*(F.struct(F.lit(s).alias("slot"), F.lit(i).alias("place")) for s, needed, i in slots(purpose) if needed))
    rows = packets.select("packet_id", F.explode(wanted).alias("w")).select("packet_id", "w.slot", "w.place")
    return rows.join(present.select("packet_id", "slot").distinct(), ["packet_id", "slot"], "left_anti")


def identity_status(docs: DataFrame, name: Column, pan_valid: Column, aadhaar_valid: Column, is_address: Column) -> DataFrame:
    """identity_ok, address_ok, distinct normalized names and whether they agree."""
    names = F.array_sort(F.collect_set(scalars.norm_name(name)))
    return docs.groupBy("packet_id").agg(F.bool_or(pan_valid | aadhaar_valid).alias("identity_ok"), F.bool_or(is_address).alias("address_ok"), F.array_join(names, "|").alias("names"), (F.size(names) <= 1).alias("names_agree"))
