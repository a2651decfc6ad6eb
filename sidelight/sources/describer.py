"""Calls to a describing model, from executors.

A call is paid for and not repeatable, and Spark may run a task twice. So answers
are written before anything else reads them (``describe`` returns the written
table), and what is already answered in that folder is not asked again.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidelight.functions.images import data_url
from sidelight.operators.logs import even_sample

ATTEMPTS, WAIT, TIMEOUT = 3, 3, 60
ANSWERS_DDL = "path string, context string, text string, cost double, error string"
ANSWERS = [c.split()[0] for c in ANSWERS_DDL.split(", ")]
Call = Callable[[str, str, bytes], dict]  # (path, prompt, content) to {"text", "cost"} or {"error"}


def is_transient(error: str) -> bool:
    return error.startswith("HTTP 429") or "data_inspection_failed" in error


def answer_of(status: int, body: str) -> dict:
    """A provider's reply as {"text", "cost"} or {"error"}; a null text is an answer, not an error."""
    if status != 200:
        return {"error": f"HTTP {status}: {body[:500]}"}
    try:
        reply = json.loads(body)
    except ValueError:
        return {"error": f"a reply that is no JSON: {body[:500]}"}
    try:
        return {"text": reply["choices"][0]["message"]["content"], "cost": (reply.get("usage") or {}).get("cost")}
    except (KeyError, IndexError, TypeError, AttributeError):
        return {"error": f"a reply without an answer: {json.dumps(reply)[:500]}"}


def http_call(url: str, key: str, model: str, reasoning: bool | None = None) -> Call:
    """A call to a chat-completions endpoint that takes images as data URLs."""

    def call(path: str, prompt: str, content: bytes) -> dict:
        parts = [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": data_url(path, content)}}]
        body = {"model": model, "messages": [{"role": "user", "content": parts}]} | ({} if reasoning is None else {"reasoning": {"enabled": reasoning}})
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Authorization": f"Bearer {key}", "Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=TIMEOUT) as r:
                return answer_of(r.status, r.read().decode("utf-8", "replace"))
        except urllib.error.HTTPError as e:
            return answer_of(e.code, e.read().decode("utf-8", "replace"))
        except OSError as e:
            return {"error": f"request failed: {e}"}

    return call


def with_retries(call: Call, attempts: int = ATTEMPTS, wait: float = WAIT, sleep: Callable[[float], None] = time.sleep) -> Call:
    """Repeats a call on transient errors alone, waiting longer each time."""

    def run(path: str, prompt: str, content: bytes) -> dict:
        answer: dict = {}
        for n in range(attempts):
            answer = call(path, prompt, content)
            if "error" not in answer or not is_transient(answer["error"]):
                return answer
            sleep(wait * (n + 1))
        return answer

    return run


def describe(asked: DataFrame, call: Call, out: str, tasks: int = 8) -> DataFrame:
    """Answers of ``asked`` (path, context, prompt, content), written under ``out``; ``tasks`` calls run at a time."""
    spark = asked.sparkSession
    from sidelight.sources.files import _exists

    if _exists(spark, out):
        asked = asked.join(spark.read.schema(ANSWERS_DDL).parquet(out).select("path"), "path", "left_anti")

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            said = [call(r["path"], r["prompt"], r["content"]) for r in rows]
            cols = [r["path"] for r in rows], [r["context"] for r in rows], *([s.get(k) for s in said] for k in ("text", "cost", "error"))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.string(), pa.float64(), pa.string()))], names=ANSWERS)

    asked.select("path", "context", "prompt", "content").repartition(tasks).mapInArrow(run, ANSWERS_DDL).write.mode("append").parquet(out)
    return spark.read.schema(ANSWERS_DDL).parquet(out).withColumn("answer", F.struct("text", "cost", "error"))


def probe(asked: DataFrame, call: Call, out: str, limit: int | None = 10) -> tuple[DataFrame, float]:
    """Answers of an even sample in path order, and what they cost together: a look before a full run."""
    some = even_sample(asked, [F.split("path", "/")], limit)
    said = describe(some, call, out)
    total = said.agg(F.sum(F.coalesce("cost", F.lit(0.0)))).first()[0]
    return said.select("path", "context", "text", "cost", "error"), total or 0.0
