"""The rule ladder on a stream of drafts: stateless, so it is the batch plan on an unbounded table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import policy


def triage(drafts: DataFrame) -> DataFrame:
    spark = drafts.sparkSession
    return policy.route(drafts, policy.taxonomy(spark), policy.default_config(spark))
