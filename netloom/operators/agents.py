"""Rounds of a model over rows that are not done: ask, parse, score, reflect, keep the best.

The model is a seam: a function that gets a list of asked rows inside a task and
returns a reply for each.  All else is columns.  Each round asks pending rows only
and is written before anything reads it, so that a lost executor costs a re-read
of earlier rounds and never asks the model again for them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from netloom.plans.shared import materialize, quoted

#: Rows that a model gets at once.
ASKED = 64
# What says that there is nothing to mend.
PRAISE = ("all correct", "all good", "no issues", "correctly identified", "looks correct", "no changes needed", "nothing to change", "well identified", "accurate", "no corrections needed")


@dataclass(frozen=True)
class Reply:
    """What a model gave for one row: a text, or why there is none, and the tokens it took."""

    text: str | None
    tokens: int = 0
    error: str | None = None


#: Gets dicts of ``prompt``, ``round`` and ``request`` (the row); returns a reply for each, in order.
Model = Callable[[list[dict[str, Any]]], Iterable[Reply]]


def one_by_one(answer: Callable[[dict[str, Any]], tuple[str, int]], attempts: int = 1) -> Model:
    """A model from a function of one row that gives a text and tokens or raises.

    A row is asked again after an error or an empty text, up to ``attempts``
    times; the last error stands where none succeeds.
    """

    def model(asked: list[dict[str, Any]]) -> Iterator[Reply]:
        for row in asked:
            reply = Reply(None, 0, "no answer")
            for _ in range(attempts):
                try:
                    text, tokens = answer(row)
                except Exception as failure:  # noqa: BLE001
                    reply = Reply(None, 0, str(failure))
                    continue
                reply = Reply(text, tokens)
                if text:
                    break
            yield reply

    return model


def ask(rows: DataFrame, prompt: Column, model: Model, nth: int, name: str) -> DataFrame:
    """``rows``, which have a column ``request``, with the ``reply`` to ``prompt``, written so that the model is asked once.

    The model gets ``ASKED`` rows at once.  Only prompts and requests go to Python and only replies come back;
    prompts, which often repeat a text of the state, are not written.
    """

    def answers(prompts: pa.Array, requests: pa.Array) -> pa.Array:
        replies: list[Reply] = []
        for start in range(0, len(prompts), ASKED):
            asked = [{"prompt": p, "round": nth, "request": r} for p, r in zip(prompts.slice(start, ASKED).to_pylist(), requests.slice(start, ASKED).to_pylist())]
            replies += model(asked)
            if len(replies) != start + len(asked):
                raise ValueError(f"the model gave {len(replies) - start} replies for {len(asked)} rows")
        fields = {"text": pa.string(), "tokens": pa.int64(), "error": pa.string()}
        return pa.StructArray.from_arrays([pa.array([getattr(r, f) for r in replies], kind) for f, kind in fields.items()], list(fields))

    # A model may answer otherwise each time.
    reply = F.arrow_udf(answers, _reply_type()).asNondeterministic()
    return materialize(rows.withColumn("reply", reply(prompt, F.col("request"))), name)


def _reply_type() -> StructType:
    return StructType.fromDDL("text string, tokens bigint, error string")


def _requests(rows: DataFrame, state: str) -> DataFrame:
    """Rows as one struct beside a state, so that no column of theirs is in the way."""
    return rows.select(F.struct(*[F.col(quoted(c)) for c in rows.columns]).alias("request"), F.expr(state).alias("state"))


def _lookup(table: dict[str, float], key: Column, default: float) -> Column:
    if not table:
        return F.lit(float(default))
    known = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(known, key), F.lit(float(default)))


def weighted_score(metrics: Column, weights: dict[str, float]) -> Column:
    """Mean of the metrics of a map by weight, 1 where a metric has none; 0 without metrics."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("weight"))

    def add(acc: Column, e: Column) -> Column:
        w = _lookup(weights, e["key"], 1.0)
        return F.struct((acc["sum"] + e["value"] * w).alias("sum"), (acc["weight"] + w).alias("weight"))

    return F.aggregate(F.map_entries(metrics), start, add, lambda acc: F.when(acc["weight"] > 0, acc["sum"] / acc["weight"]).otherwise(0.0))


@dataclass(frozen=True)
class Stage:
    """One kind of agent.

    ``prompt``, ``feedback`` and what ``evaluate`` gives may name ``request`` and
    ``state`` (``errors, output, metrics, passed, failed, feedback`` of the round
    before); ``parse`` turns a reply's text into an output text, null where there is none,
    ``evaluate`` an output into a map of metrics; ``feedback`` sees the columns
    ``output``, ``metrics`` and ``failed`` of this round.
    """

    name: str
    prompt: Column
    parse: Callable[[Column], Column]
    evaluate: Callable[[Column], Column]
    rounds: int = 3
    passing: float = 0.9
    viable: float = 0.5
    weights: dict[str, float] = field(default_factory=dict)
    targets: dict[str, float] = field(default_factory=dict)
    target: float = 0.8
    feedback: Column | None = None


_CONTEXT = """named_struct('errors', cast(array() as array<string>), 'output', cast(null as string), 'metrics', cast(null as map<string,double>), 'passed', cast(array() as array<string>), 'failed', cast(array() as array<string>), 'feedback', '',
 'best_score', 0D, 'best_output', cast(null as string), 'best_round', 0, 'tokens', 0L, 'recorded', 0)"""


def run_agent(requests: DataFrame, stage: Stage, model: Model) -> tuple[DataFrame, DataFrame]:
    """Rounds of one agent; its results and the record of each round.

    A row goes on until a score reaches ``passing`` or ``rounds`` are over.  A call
    that fails and a reply that cannot be parsed take up a round and are
    told to the next as errors.  Only a score above the best so far, at first 0,
    becomes the best.  What the round has found is the context of the next.

    Results have ``request`` (all columns of the row), ``output``, ``score`` and
    ``best_round`` of the best round (null, 0 and 0 if there is none), ``passed``,
    ``needs_review`` and ``reason``, ``final_metrics`` (of the last round that
    was scored), ``rounds`` scored, ``tokens`` and ``errors``.  Records have
    ``request, round, metrics, score, passed, failed, tokens``.  Each row is
    a request of its own, also where rows are equal; no rows give no results.
    """
    pending = _requests(requests, _CONTEXT)
    done, records = [], []
    score, s = F.col("score"), F.col("state")
    for nth in range(1, stage.rounds + 1):
        asked = ask(pending, stage.prompt, model, nth, f"{stage.name}-{nth}")
        output = F.when(F.col("reply.error").isNull(), stage.parse(F.col("reply.text")))
        found = asked.withColumn("output", output).withColumn("metrics", F.when(F.col("output").isNotNull(), stage.evaluate(F.col("output"))))
        found = found.withColumn("score", F.when(F.col("output").isNotNull(), weighted_score(F.col("metrics"), stage.weights)))
        reaches = lambda k, v: v >= _lookup(stage.targets, k, stage.target)
        found = found.withColumns({"met": F.map_keys(F.map_filter("metrics", reaches)), "failed": F.map_keys(F.map_filter("metrics", lambda k, v: ~reaches(k, v)))})
        found = found.withColumn("told", F.when(score.isNotNull(), stage.feedback if stage.feedback is not None else F.lit("")))
        error = F.when(F.col("reply.error").isNotNull(), F.concat(F.lit("LLM call failed: "), F.col("reply.error"))).when(F.col("output").isNull(), "Parse failed: no answer in the reply")
        better = F.coalesce(score > s["best_score"], F.lit(False))
        scored = lambda new, old: F.when(score.isNotNull(), new).otherwise(old)
        state = F.struct(
            F.when(error.isNotNull(), F.concat(s["errors"], F.array(error))).otherwise(s["errors"]).alias("errors"),
            scored(F.col("output"), s["output"]).alias("output"),
            scored(F.col("metrics"), s["metrics"]).alias("metrics"),
            scored(F.col("met"), s["passed"]).alias("passed"),
            scored(F.col("failed"), s["failed"]).alias("failed"),
            scored(F.col("told"), s["feedback"]).alias("feedback"),
            F.when(better, score).otherwise(s["best_score"]).alias("best_score"),
            F.when(better, F.col("output")).otherwise(s["best_output"]).alias("best_output"),
            F.when(better, F.lit(nth)).otherwise(s["best_round"]).alias("best_round"),
            (s["tokens"] + F.col("reply.tokens")).alias("tokens"),
            (s["recorded"] + score.isNotNull().cast("int")).alias("recorded"),
        )
        over = F.coalesce(score >= stage.passing, F.lit(False))
        records.append(found.where("score is not null").select("request", F.lit(nth).alias("round"), "metrics", "score", over.alias("passed"), "failed", F.col("reply.tokens").alias("tokens")))
        found = found.select("request", state.alias("state"), over.alias("over"))
        done.append((found if nth == stage.rounds else found.where("over")).drop("over"))
        pending = found.where("not over").drop("over")
        if nth < stage.rounds and pending.isEmpty():
            break
    last = _all(done)
    best = F.col("state.best_score")
    reason = F.when(best < stage.viable, F.format_string(f"Score %.2f below minimum viable {stage.viable}", best)).when(best < stage.passing, F.format_string(f"Score %.2f below pass threshold {stage.passing}", best))
    result = last.select(
        "request",
        F.col("state.best_output").alias("output"),
        best.alias("score"),
        "state.best_round",
        (best >= stage.passing).alias("passed"),
        reason.isNotNull().alias("needs_review"),
        reason.alias("reason"),
        F.col("state.metrics").alias("final_metrics"),
        F.col("state.recorded").alias("rounds"),
        "state.tokens",
        "state.errors",
    )
    return result, _all(records)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def actionable(feedback: Column) -> Column:
    """Whether feedback asks for a change: not empty, and without a phrase of praise."""
    text = F.lower(F.coalesce(feedback, F.lit("")))
    praised = F.lit(False)
    for phrase in PRAISE:
        praised = praised | text.contains(phrase)
    return (text != "") & ~praised


@dataclass(frozen=True)
class Judge:
    """A judge of drafts and the agent that revises what it rejects.

    ``prompt`` and ``revision`` may name ``request`` and ``state.draft``, the
    latter also ``judged`` (``verdict, confidence, feedback``); ``parse`` turns a reply's text into that struct.
    """

    prompt: Column
    parse: Callable[[Column], Column]
    revision: Column
    retries: int = 2
    passing: float = 0.96


_JUDGED = "struct<verdict:string,confidence:double,feedback:string>"


def run_judge(requests: DataFrame, draft: Column, judge: Judge, model: Model, reviser: Model) -> DataFrame:
    """Judge drafts, revise rejected ones with the judge's feedback, at most ``1 + retries`` verdicts for each.

    A verdict PASS of at least ``passing`` confidence ends a row and is its result; else the
    verdict with the largest confidence above 0 is, the first of equal ones.  A
    failed call and a reply without a verdict count as a verdict of confidence 0.  A
    revision that fails or is empty leaves the draft as it is.

    Returns ``request, verdict, confidence, attempt`` (of the result; null, 0 and 0 if there is
    none), ``passed``, ``attempts``, ``revisions``, ``draft`` (the last judged) and ``tokens``.
    """
    start = f"named_struct('draft', cast(null as string), 'judged', cast(null as {_JUDGED}), 'attempt', 0, 'passed', false, 'revisions', 0, 'tokens', 0L)"
    pending = _requests(requests, start).withColumn("state", F.col("state").withField("draft", draft))
    done = []
    s = F.col("state")
    for nth in range(1, judge.retries + 2):
        asked = ask(pending, judge.prompt, model, nth, f"judge-{nth}")
        found = asked.withColumn("judged", F.when(F.col("reply.error").isNull(), judge.parse(F.col("reply.text"))).cast(_JUDGED))
        passes = F.coalesce((F.col("judged.verdict") == "PASS") & (F.col("judged.confidence") >= judge.passing), F.lit(False))
        better = passes | F.coalesce(F.col("judged.confidence") > F.coalesce(s["judged"]["confidence"], F.lit(0.0)), F.lit(False))
        state = F.struct(
            s["draft"].alias("draft"), F.when(better, F.col("judged")).otherwise(s["judged"]).alias("judged"), F.when(better, F.lit(nth)).otherwise(s["attempt"]).alias("attempt"),
            passes.alias("passed"), s["revisions"].alias("revisions"), (s["tokens"] + F.col("reply.tokens")).alias("tokens"),
        )
        found = found.select("request", state.alias("state"), "judged")
        ended = found if nth == judge.retries + 1 else found.where("state.passed")
        done.append(ended.select("request", "state", F.lit(nth).alias("attempts")))
        if nth > judge.retries:
            break
        revised = ask(found.where("not state.passed"), judge.revision, reviser, nth, f"revision-{nth}")
        kept = F.col("reply.error").isNull() & (F.coalesce("reply.text", F.lit("")) != "")
        renewed = s.withField("draft", F.when(kept, F.col("reply.text")).otherwise(s["draft"])).withField("revisions", s["revisions"] + kept.cast("int")).withField("tokens", s["tokens"] + F.col("reply.tokens"))
        pending = revised.select("request", renewed.alias("state"))
        if pending.isEmpty():
            break
    last = _all(done)
    return last.select(
        "request", F.col("state.judged.verdict").alias("verdict"), F.coalesce("state.judged.confidence", F.lit(0.0)).alias("confidence"), "state.attempt", "state.passed", "attempts", "state.revisions", "state.draft", "state.tokens"
    )
