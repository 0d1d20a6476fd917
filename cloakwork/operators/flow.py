"""The two-step flow around a language model: mask the question, restore the answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.operators.demask import restored_rows
from cloakwork.operators.mask import mask_table, token_rows
from cloakwork.sources.rules import Rule

FLOW_ERROR = "A request needs an input to mask, or a session and an answer to restore"


def first_step(requests: DataFrame, new_session: str, rules: list[Rule] | None = None) -> tuple[DataFrame, DataFrame]:
    """Requests without a session: masked input for the model, and the token rows to store."""
    fresh = requests.filter(F.col("session_id").isNull()).select("request_id", "user_input", F.col(new_session).alias("_new"))
    masked = mask_table(fresh, "user_input", session="_new", rules=rules)
    none = F.lit(None).cast("string")
    answers = masked.select(
        "request_id", F.col("masked_text").alias("masked_input"), "session_id",
        none.alias("demasked_response"), none.alias("error"),
    )
    return answers, token_rows(masked, "session_id")


def second_step(requests: DataFrame, vault: DataFrame) -> DataFrame:
    """Requests with a session: the restored answer; an empty answer is an error."""
    known = requests.filter(F.col("session_id").isNotNull())
    usable = F.coalesce(F.col("llm_response"), F.lit("")) != ""
    asked = known.withColumn("_usable", usable).withColumn("_answer", F.when(usable, F.col("llm_response")))
    return restored_rows(asked, vault, "session_id", "_answer").select(
        "request_id",
        F.when(F.col("_usable"), F.lit("")).alias("masked_input"),
        "session_id",
        F.col("original_text").alias("demasked_response"),
        F.when(~F.col("_usable"), F.lit(FLOW_ERROR)).alias("error"),
    )


def run_flow(
    requests: DataFrame, vault: DataFrame, new_session: str, rules: list[Rule] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Both steps on one table of requests: the answers, and the token rows to store for the second step to come."""
    answers, rows = first_step(requests, new_session, rules)
    return answers.unionByName(second_step(requests, vault)), rows
