"""Row validation of message feeds (V01): rule columns -> valid / quarantine split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.config import TASK_TYPES

NON_NEGATIVE = ("AccountId", "PersonId", "OccurredTimeTicks", "no_of_records",
                "total_no_of_records", "current_step", "total_no_of_steps")
REQUIRED = ("AccountId", "ModelId", "PersonId", "DefinitionId", "OccurredTime",
            "OccurredTimeTicks", "task_type", "score", "prediction_time", "no_of_records",
            "total_no_of_records", "current_step", "current_step_percentage",
            "total_no_of_steps", "auc", "f1", "precission", "recall", "accuracy")
UNIT_INTERVAL = ("score", "auc", "f1", "precission", "recall", "accuracy")


def rule_columns(schema: T.StructType) -> list[Column]:
    """One nullable text per broken rule (NULL when the rule holds)."""
    names = set(schema.fieldNames())
    rules: list[Column] = []

    def add(cond: Column, reason: str) -> None:
        rules.append(F.when(cond, F.lit(reason)))

    for c in REQUIRED:
        if c in names:
            add(F.col(c).isNull(), f"{c}:missing")
    for c in NON_NEGATIVE:
        if c in names:
            add(F.col(c) < 0, f"{c}:negative")
    if "DefinitionId" in names:
        add(F.length("DefinitionId") < 1, "DefinitionId:empty")
    if "task_type" in names:
        add(~F.col("task_type").isin(*TASK_TYPES), "task_type:unknown")
    for c in UNIT_INTERVAL:
        if c in names:
            add((F.col(c) < 0) | (F.col(c) > 1), f"{c}:out_of_range")
    return rules


def validate(df: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """Adds ``reasons ARRAY<STRING>`` (empty when valid) and ``valid BOOLEAN``."""
    rules = rule_columns(schema or df.schema)
    reasons = F.filter(F.array(*rules), lambda x: x.isNotNull()) if rules else F.array()
    return df.withColumn("reasons", reasons.cast("array<string>")).withColumn(
        "valid", F.size("reasons") == 0)


def parse_and_validate(raw: DataFrame, schema: T.StructType, value_col: str = "value"
                       ) -> DataFrame:
    """from_json (permissive) then the rules; unparseable text is quarantined as ``json``."""
    from eventide.functions.messages import from_message

    # The parse goes through a one-element explode (a Generate node): a filter on the parsed
    # fields cannot be pushed below it, so each text is parsed once instead of once per rule.
    parsed = raw.select(F.col(value_col).alias("_raw"), F.explode(F.array(
        from_message(F.col(value_col), schema))).alias("_m"))
    flat = parsed.select("_raw", *[F.col(f"_m.{f.name}").alias(f.name) for f in schema.fields],
                         F.col("_m").isNull().alias("_bad_json"))
    v = validate(flat, schema)
    return v.withColumn("reasons", F.when(F.col("_bad_json"), F.array(F.lit("json")))
                        .otherwise(F.col("reasons"))).withColumn(
        "valid", F.size("reasons") == 0).drop("_bad_json")
