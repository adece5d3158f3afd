"""Rounds of models against the same loops in plain Python."""

from __future__ import annotations

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from netloom.functions import text as T
from netloom.operators import agents

# Workers do not import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def answer(row):
    """Replies by request: scripted texts; an exception for a text that begins with an exclamation mark."""
    text = (row["request"]["script"] or [])[row["round"] - 1 : row["round"]]
    if not text or text[0].startswith("!"):
        raise RuntimeError(text[0][1:] if text else "nothing scripted")
    return text[0], len(row["prompt"])


def scripted(*scores):
    return [s if isinstance(s, str) else json.dumps({"good": s, "fine": s}) for s in scores]


SCRIPTS = {
    1: scripted(1.05), 2: scripted(0.3, 0.7, 0.6), 3: scripted(0.0, 0.0, 0.0), 4: scripted("!down", 0.2, 1.1), 5: scripted("no json", "!down", "none"),
    6: scripted(0.6, 0.6, 1.08), 7: None, 8: scripted(0.7, "!", 0.7), 9: scripted(0.9),
}
def stage():
    return agents.Stage(
        "test",
        prompt=F.concat_ws("|", F.lit("ask"), F.array_join("state.failed", ","), "state.feedback", F.size("state.errors").cast("string"), F.coalesce("state.output", F.lit("-"))),
        parse=T.reply_json,
        evaluate=lambda o: F.create_map(F.lit("good"), F.get_json_object(o, "$.good").cast("double"), F.lit("fine"), F.get_json_object(o, "$.fine").cast("double") / 2),
        weights={"good": 3.0}, targets={"fine": 0.4}, feedback=F.concat(F.lit("mend "), F.array_join("failed", " ")),
    )


def loop(script):
    """One request's rounds: result and prompts."""
    errors, output, metrics, failed, feedback, best, prompts, tokens, records = [], None, None, [], "", (0.0, None, 0), [], 0, []
    for nth in range(1, 4):
        prompt = "|".join(["ask", ",".join(failed), feedback, str(len(errors)), output or "-"])
        prompts.append(prompt)
        try:
            text, n = answer({"request": {"script": script}, "round": nth, "prompt": prompt})
        except RuntimeError as failure:
            errors.append(f"LLM call failed: {failure}")
            continue
        tokens += n
        if "{" not in text:
            errors.append("Parse failed: no answer in the reply")
            continue
        output, values = text, json.loads(text)
        metrics = {"good": values["good"], "fine": values["fine"] / 2}
        score = (metrics["good"] * 3 + metrics["fine"]) / 4
        failed = [m for m, target in (("good", 0.8), ("fine", 0.4)) if metrics[m] < target]
        feedback = "mend " + " ".join(failed)
        records.append((nth, round(score, 9), score >= 0.9, n))
        if score > best[0]:
            best = (score, output, nth)
        if score >= 0.9:
            break
    return best, metrics, tokens, errors, records


def test_agent_is_the_loop(spark):
    # The last requests are equal rows; columns have the names that the rounds use themselves.
    rows = [(k, s, "mine", 3) for k, s in SCRIPTS.items()] + [(9, SCRIPTS[9], "mine", 3)]
    requests = spark.createDataFrame(rows, "id long, script array<string>, state string, round int")
    results, records = agents.run_agent(requests, stage(), agents.one_by_one(answer))
    got = results.collect()
    assert sorted(r.request.id for r in got) == sorted(r[0] for r in rows)
    for r in got:
        (score, output, nth), metrics, tokens, errors, own = loop(SCRIPTS[r.request.id])
        assert (r.score, r.output, r.best_round, r.final_metrics, r.tokens, r.errors, r.rounds) == (pytest.approx(score), output, nth, metrics, tokens, errors, len(own))
        assert r.passed == (score >= 0.9) and r.needs_review == (score < 0.9)
        assert r.reason == (None if score >= 0.9 else f"Score {score:.2f} below {'minimum viable 0.5' if score < 0.5 else 'pass threshold 0.9'}")
        assert (r.request.state, r.request.round) == ("mine", 3)
    want = sorted((k, *x) for k, *_ in rows for x in loop(SCRIPTS[k])[4])
    assert sorted((r.request.id, r["round"], round(r.score, 9), r.passed, r.tokens) for r in records.collect()) == want
    empty, none = agents.run_agent(requests.limit(0), stage(), agents.one_by_one(answer))
    assert empty.count() == none.count() == 0


def test_models_are_asked_once_for_pending_rows(spark, tmp_path):
    """Each pending row is asked once in a round, however often results are read."""

    def model(asked):
        for row in asked:
            with open(f"{tmp_path}/{row['request']['id']}-{row['round']}", "a") as note:
                note.write("x")
            yield from agents.one_by_one(answer)([row])

    requests = spark.createDataFrame(list(SCRIPTS.items()), "id long, script array<string>").repartition(3)
    results, records = agents.run_agent(requests, stage(), model)
    assert results.count() == len(SCRIPTS) == len(results.collect()) and records.count() == len({(r.request.id, r["round"]) for r in records.collect()})
    rounds = {k: 1 if k in (1,) else 3 for k in SCRIPTS}
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {f"{k}-{n}": "x" for k, most in rounds.items() for n in range(1, most + 1)}


def test_provider_retries():
    tries = iter([RuntimeError("busy"), "", "text"])

    def flaky(row):
        found = next(tries)
        if isinstance(found, Exception):
            raise found
        return found, 4

    assert list(agents.one_by_one(flaky, 3)([{}])) == [agents.Reply("text", 4)]
    assert list(agents.one_by_one(answer, 2)([{"request": {"script": ["!down"]}, "round": 1, "prompt": ""}])) == [agents.Reply(None, 0, "down")]


def test_wrong_number_of_replies(spark):
    with pytest.raises(Exception, match="0 replies for 1 rows"):
        agents.run_agent(spark.createDataFrame([(1, ["x"])], "id long, script array<string>"), stage(), lambda asked: [])


def test_judge(spark):
    """Verdicts by draft; drafts change by revision, which may fail."""
    verdicts = {
        "a": ("PASS", 0.97), "b": ("FAIL", 0.4), "b+": ("FAIL", 0.6), "b++": ("FAIL", 0.6), "c": ("FAIL", 0.99), "c+": ("PASS", 0.96), "d": ("PASS", 0.9), "d+": None, "d++": ("FAIL", 0.0),
        "stuck": ("FAIL", 0.0), "e": None, "e+": None, "e++": None,
    }

    def judged(row):
        if verdicts[row["prompt"]] is None:
            return "not a verdict", 1
        kind, confidence = verdicts[row["prompt"]]
        return json.dumps({"verdict": kind, "confidence": confidence, "feedback": f"mend {row['prompt']}"}), 1

    def revised(row):
        feedback, draft = row["prompt"].split("|")
        assert feedback in (f"mend {draft}", "")
        if draft == "stuck":
            raise RuntimeError
        return draft + "+", 100

    field = lambda text, name, kind: F.get_json_object(text, f"$.{name}").cast(kind).alias(name)
    judge = agents.Judge(
        prompt=F.col("state.draft"),
        parse=lambda text: F.when(F.get_json_object(text, "$.verdict").isNotNull(), F.struct(field(text, "verdict", "string"), field(text, "confidence", "double"), field(text, "feedback", "string"))),
        revision=F.concat_ws("|", F.coalesce("judged.feedback", F.lit("")), "state.draft"),
    )
    drafts = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("stuck",), ("e",)], "draft string")
    got = agents.run_judge(drafts, F.col("request.draft"), judge, agents.one_by_one(judged), agents.one_by_one(revised)).collect()
    assert {r.request.draft: (r.verdict, r.confidence, r.attempt, r.passed, r.attempts, r.revisions, r.draft, r.tokens) for r in got} == {
        "a": ("PASS", 0.97, 1, True, 1, 0, "a", 1), "b": ("FAIL", 0.6, 2, False, 3, 2, "b++", 203), "c": ("PASS", 0.96, 2, True, 2, 1, "c+", 102), "d": ("PASS", 0.9, 1, False, 3, 2, "d++", 203),
        "stuck": (None, 0.0, 0, False, 3, 0, "stuck", 3), "e": (None, 0.0, 0, False, 3, 2, "e++", 203),
    }
    assert agents.run_judge(drafts.limit(0), F.col("request.draft"), judge, agents.one_by_one(judged), agents.one_by_one(revised)).count() == 0


def test_feedback_that_asks_for_a_change(spark):
    said = spark.createDataFrame([("Net n1 is open",), ("",), (None,), ("Well identified, go on",), ("ALL GOOD",)], "t string")
    assert [r.x for r in said.select(agents.actionable(F.col("t")).alias("x")).collect()] == [True, False, False, False, False]


def test_replies_are_written_without_prompts_and_rows_are_asked_in_small_lists(spark):
    rows = spark.range(150).select(F.struct("id").alias("request"), F.lit("s").alias("state")).coalesce(1)
    model = lambda asked: [agents.Reply(row["prompt"], len(asked), None if row["request"]["id"] else "none") for row in asked]
    found = agents.ask(rows, F.concat(F.lit("p"), F.col("request.id").cast("string")), model, 1, "asked")
    assert found.columns == ["request", "state", "reply"]
    got = {r.request.id: tuple(r.reply) for r in found.collect()}
    assert got == {k: (f"p{k}", 64 if k < 128 else 22, None if k else "none") for k in range(150)}
    with pytest.raises(Exception, match="the model gave 1 replies for 64 rows"):
        agents.ask(rows, F.lit("p"), lambda asked: [agents.Reply("x")], 1, "asked")
