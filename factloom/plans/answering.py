"""Plans -> lookups -> contexts -> observations, for all questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.defaults import TOP_K
from factloom.operators.context import context_text, observations
from factloom.operators.nearest import nearest_batch
from factloom.operators.records import embed_text
from factloom.operators.targets import dispatch_rows, lookup_requests


def plan_lookups(plans: DataFrame) -> DataFrame:
    """Lookups of every job of every plan, with a ``request_id`` each."""
    jobs = dispatch_rows(plans, keep=["targets"]).where(F.col("table").isNotNull())
    lookups = lookup_requests(
        jobs.select("run_id", F.col("worker").alias("agent"), "table", "targets")
    )
    return lookups.withColumn("request_id", F.concat_ws("/", "run_id", "agent", "seq"))


def answer_lookups(lookups: DataFrame, index: DataFrame, k: int = TOP_K, **embedding) -> DataFrame:
    """Lookups with their ``results`` and ``observation``."""
    asked = lookups.where(F.col("status") == "ok").select(
        "request_id", F.col("table").alias("heading"), "query"
    )
    requests = embed_text(asked, text_col="query", **embedding)
    found = nearest_batch(requests, index, k, payload=["document"])
    return observations(lookups, context_text(found, requests))
