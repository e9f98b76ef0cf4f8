"""Calls of a chat service to their end: what the answers to a request's calls, one after the other, come to.

The calls are a fold over the answers in order, within the row of the request. A request makes five calls at most, three
of them retries and one with a smaller answer size, so its answers are five slots, which partial aggregation fills before
anything is shuffled; further answers of the record are never asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as t
from foliant.plans.compiling import ANSWER_TOKENS, FALLBACK_TOKENS, RETRIES

#: The first call, retries, and the call with the smaller answer size.
MOST_CALLS = 1 + RETRIES + 1

# The message where an answer has none, what comes before that of the smaller call, and the codes of errors.
NO_MESSAGE, FALLBACK_FAILED = "Groq API error (%d)", "Fallback failed: "
BUSY, BAD = "TOO_MANY_REQUESTS", "BAD_REQUEST"


def error_message(status: Column, body: Column) -> Column:
    return t.json_or(body, "$.error.message", F.format_string(NO_MESSAGE, status))


def slots(answers: DataFrame, request: str, call: str, status: str, body: str) -> DataFrame:
    """request and `answers`, the answers to its first calls as far as there is no gap. Of answers to one call the least counts."""
    each = [F.min(F.when(F.col(call) == k, F.struct(F.col(status).alias("status"), F.col(body).alias("body")))).alias(f"__{k}") for k in range(1, MOST_CALLS + 1)]
    held = answers.where(F.col(call).between(1, MOST_CALLS)).groupBy(request).agg(*each)
    row = F.array(*[f"__{k}" for k in range(1, MOST_CALLS + 1)])
    gap = F.array_position(F.transform(row, lambda x: x.isNull()), True)
    return held.select(request, F.when(gap > 0, F.slice(row, 1, (gap - 1).cast("int"))).otherwise(row).alias("answers"))


def step(acc: Column, answer: Column) -> Column:
    """The state after an answer: calling (with the attempt), fallback, done or error."""
    status, body = answer["status"], answer["body"]
    calling, falling = acc["state"] == "calling", acc["state"] == "fallback"
    fine = F.coalesce(status.between(200, 299), F.lit(False))
    message = error_message(status, body)
    retry = calling & ~fine & (status == 429) & (acc["attempt"] <= RETRIES)
    smaller = calling & ~fine & ~retry & t.is_token_limit(message) & (acc["attempt"] == 1)
    over = ~calling & ~falling
    state = F.when(over, acc["state"]).when(fine, "done").when(F.coalesce(retry, F.lit(False)), "calling").when(F.coalesce(smaller, F.lit(False)), "fallback").otherwise("error")
    failed = (state == "error") & ~over
    said = F.when(falling, F.concat(F.lit(FALLBACK_FAILED), F.coalesce(body, F.lit("")))).otherwise(message)
    wait = F.when(~over & (state == "calling"), F.greatest(t.retry_after(message), F.lit(t.LEAST_RETRY_SECONDS)).cast("long")).otherwise(F.lit(0).cast("long"))
    done = (state == "done") & ~over
    return F.struct(
        state.alias("state"),
        (acc["attempt"] + F.when(~over & (state == "calling"), 1).otherwise(0)).alias("attempt"),
        (acc["calls"] + F.when(over, 0).otherwise(1)).alias("calls"),
        (acc["waited"] + wait).alias("waited"),
        F.when(state == "fallback", FALLBACK_TOKENS).otherwise(acc["max_tokens"]).alias("max_tokens"),
        F.when(done, t.json_or(body, "$.choices[0].message.content", F.lit(""))).otherwise(acc["content"]).alias("content"),
        F.when(done, F.nullif(F.get_json_object(body, "$.model"), F.lit(""))).otherwise(acc["model"]).alias("model"),
        F.when(failed, F.when(falling | (status != 429), BAD).otherwise(BUSY)).otherwise(acc["code"]).alias("code"),
        F.when(failed, said).otherwise(acc["message"]).alias("message"),
    )


def ended(requests: DataFrame, request: str, model: str, answers: DataFrame, call: str, status: str, body: str) -> DataFrame:
    """Each request's state, calls, waited (seconds), max_tokens, content, model, code and message.

    state: done, error, or waiting where the record ends before the calls do. Requests without any answer have made no
    call yet. Requests are joined on their key, which both sides are shuffled by; a repeated request has the same end.
    """
    held = slots(answers, request, call, status, body).withColumnRenamed(request, "__request")
    none = F.lit(None).cast("string")
    start = F.struct(
        F.lit("calling").alias("state"), F.lit(1).alias("attempt"), F.lit(0).alias("calls"), F.lit(0).cast("long").alias("waited"), F.lit(ANSWER_TOKENS).alias("max_tokens"),
        none.alias("content"), none.alias("model"), none.alias("code"), none.alias("message"),
    )
    rows = requests.join(held, requests[request] == held["__request"], "left")
    got = F.coalesce(F.col("answers"), F.array().cast(held.schema["answers"].dataType))
    rows = rows.select(request, model, F.aggregate(got, start, step).alias("__end"))
    end = F.col("__end")
    state = F.when(end["state"].isin("calling", "fallback"), "waiting").otherwise(end["state"])
    return rows.select(
        request, state.alias("state"), end["calls"].alias("calls"), end["waited"].alias("waited"), end["max_tokens"].alias("max_tokens"), end["content"].alias("content"),
        F.when(state == "done", F.coalesce(end["model"], F.col(model))).alias("model"), end["code"].alias("code"), end["message"].alias("message"),
    )
