"""Expectations.

``fail`` rules stop the job on the first violating row (``raise_error`` inside the
filter, evaluated in the same scan); ``drop`` rules remove violating rows, a NULL predicate
counting as a violation; ``warn`` rules keep rows. Violations of every rule are counted
with ``DataFrame.observe`` in the same pass, so no extra job is run for metrics. Rows are counted also
when nobody asks for it: the planner moves no filter below a count, so the rules read the columns
they name, while a filter that moves below them computes the whole chain of their formulas once per rule.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    predicate: str  # SQL boolean expression
    action: str = "drop"  # fail | drop | warn

    def sql(self) -> str:
        return f"COALESCE(({self.predicate}), false)"

    def column(self) -> Column:
        return F.expr(self.sql())


def apply_rules(df: DataFrame, rules: list[Rule], observation: Observation | None = None) -> DataFrame:
    """Filter ``df`` by its rules. Violation counts land in ``observation`` after an action."""
    counts = [F.expr(f"count_if(NOT {r.sql()})").alias(r.name) for r in rules] if observation is not None else []
    df = df.observe(observation or f"rules-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"), *counts)
    conds = [f"(CASE WHEN {r.sql()} THEN true ELSE CAST(raise_error('expectation failed: {r.name}') AS BOOLEAN) END)"
             for r in rules if r.action == "fail"]
    conds += [r.sql() for r in rules if r.action == "drop"]
    return df.filter(" AND ".join(conds)) if conds else df


def counts_of(observation: Observation, rules: list[Rule]) -> dict[str, int]:
    """What ``apply_rules`` counted, after the action. An input that the planner finds to be empty is
    never scanned and has no counts to give: all are 0."""
    try:
        return observation.get
    except Py4JJavaError:
        return dict.fromkeys(["rows", *[r.name for r in rules]], 0)
