"""Models whose replies follow from a digest of what they are asked, so that SQL can replay every round."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from netloom.operators.agents import one_by_one


def _digits(text: str) -> list[int]:
    """Numbers from a digest: two of 16 bits, then bytes."""
    h = hashlib.md5(text.encode()).hexdigest()
    return [int(h[:4], 16), int(h[4:8], 16), *(int(h[k : k + 2], 16) for k in range(8, 32, 2))]


def refine(row: dict[str, Any]) -> tuple[str, int]:
    """Two measures of a document that rise with every failed metric and error that the prompt names; fails or rambles at times."""
    a, b, fails, rambles, *_ = _digits(f"{row['request']['doc_id']}:{row['round']}")
    if not fails % 11:
        raise TimeoutError("no reply in time")
    if not rambles % 13:
        return "I am not sure.", len(row["prompt"])
    _, failed, errors = row["prompt"].split(": ")
    more = 100 * (len([f for f in failed.split(".")[0].split(",") if f]) + int(errors))
    return f"Here it is.\n```json\n{json.dumps({'coverage': min(1000, a % 1001 + more), 'wire_ratio': min(1000, b % 1001 + more)})}\n```", len(row["prompt"])


def verdict(row: dict[str, Any]) -> tuple[str, int]:
    """A verdict on a netlist, with feedback that is praise at times."""
    a, _, praise, *_ = _digits(row["prompt"])
    confidence = a % 1001
    return json.dumps({"verdict": "PASS" if confidence >= 900 else "FAIL", "confidence": confidence / 1000, "feedback": "All good so far" if praise % 2 else "Net n1 is open"}), 10


def revise(row: dict[str, Any]) -> tuple[str, int]:
    """The netlist with a further line; no reply at times."""
    draft = row["prompt"].split("\n", 1)[1]
    if not _digits(draft)[3] % 7:
        raise TimeoutError("no reply in time")
    return f"{draft}\n* revision {row['round']}", 5


REFINE, VERDICT, REVISE = one_by_one(refine), one_by_one(verdict), one_by_one(revise)
