"""Texts about files from a model outside: listing, cost, prompts, batches, replies and their writing. No network here: a
provider is any object with describe(requests) -> replies."""

import json
import time
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import language, prompt_chars
from lodestone.operators.index import set_texts

# Dollars a million tokens in and out, and what a batch costs of it.
PRICES = {"gemini": (0.10, 0.40, 0.5), "anthropic": (1.0, 5.0, 1.0)}
CHARS_A_TOKEN, REPLY_TOKENS, BATCH = 3.5, 150, 100


class Provider(Protocol):
    def describe(self, requests: list[dict]) -> list[dict]:
        """A reply for each request (path, prompt): {"summary", "when_to_use"}, or {"error"}."""


class Offline:
    """A provider that answers from the prompt alone, for tests and dry runs."""

    def describe(self, requests):
        return [{"summary": f"File {r['path']}", "when_to_use": f"Changing {r['path']}"} for r in requests]


class Limiter:
    """At least `interval` seconds between calls of one worker."""

    def __init__(self, interval: float = 0.2, clock=time.monotonic, sleep=time.sleep):
        self.interval, self.clock, self.sleep, self.last = interval, clock, sleep, None

    def wait(self):
        now = self.clock()
        if self.last is not None and now - self.last < self.interval:
            self.sleep(self.interval - (now - self.last))
        self.last = self.clock()


def retrying(call, retries: int = 3, base: float = 0.5, cap: float = 60.0, sleep=time.sleep):
    """call() -> (status, retry_after or None, body), tried again on 429 (after what the answer asks for, at most cap) and 500, 502, 503."""
    for n in range(retries + 1):
        status, after, body = call()
        if status == 200:
            return body
        if status in (403, 404) or status not in (429, 500, 502, 503) or n == retries:
            raise RuntimeError(f"request failed with status {status}")
        sleep(min(after, cap) if status == 429 and after is not None else base * 2**n)
    raise AssertionError


def provider_name(name: str | None, key: str | None, env: dict) -> tuple[str, str]:
    """(provider, key): arguments go before the environment; an unknown provider is an error."""
    chosen = name or env.get("ENRICH_PROVIDER") or "gemini"
    if chosen not in PRICES:
        raise ValueError(f"unknown provider: {chosen}")
    found = key or env.get(f"{chosen.upper()}_API_KEY")
    if not found:
        raise ValueError(f"no key for {chosen}")
    return chosen, found


def coverage(files: DataFrame) -> DataFrame:
    """One row: total_files, enriched_files, unenriched_files, pct (0 for no files)."""
    n, e = F.count("*"), F.count("summary")
    return files.agg(n.alias("total_files"), e.alias("enriched_files"), (n - e).alias("unenriched_files"), F.when(n > 0, 100.0 * e / n).otherwise(0.0).alias("pct"))


def unenriched(described: DataFrame, top: int | None = None, force: bool = False) -> DataFrame:
    """Files (with exports) without texts, by rank, then path."""
    todo = (described if force else described.where("summary is null")).orderBy(F.desc("rank"), "path")
    return todo if top is None else todo.limit(top)


def cost(described: DataFrame, provider: str = "gemini", batch: bool = False) -> DataFrame:
    """One row: files, chars, input_tokens, output_tokens, dollars."""
    dear_in, dear_out, share = PRICES[provider]
    chars, n = F.coalesce(F.sum(prompt_chars(F.col("path"), F.col("exports"))), F.lit(0)), F.count("*")
    got = described.agg(n.alias("files"), chars.alias("chars"))
    t_in, t_out = F.col("chars") / CHARS_A_TOKEN, F.col("files") * REPLY_TOKENS
    return got.select("files", "chars", t_in.alias("input_tokens"), t_out.cast("double").alias("output_tokens"), ((dear_in * t_in + dear_out * t_out) / 1e6 * (share if batch else 1.0)).alias("dollars"))


def prompts(described: DataFrame) -> DataFrame:
    """(path, prompt): language, path and, where there are any, exports."""
    text = F.concat(F.lit("Describe a "), language(F.col("path")), F.lit(" file in one sentence, and say when to change it.\nPath: "), "path", F.when(F.size("exports") > 0, F.concat(F.lit("\nExports: "), F.array_join("exports", ", "))).otherwise(""), F.lit('\nAnswer as JSON: {"summary": "...", "when_to_use": "..."}'))
    return described.select("path", text.alias("prompt"))


def parse_reply(text: str) -> dict:
    """The two texts of a reply in JSON (bare, or as the first part of the first candidate, which must have ended by itself)."""
    doc = json.loads(text)
    if isinstance(doc, dict) and "candidates" in doc:
        first = doc["candidates"][0]
        if first.get("finishReason") != "STOP":
            raise ValueError("reply was cut short")
        doc = json.loads(first["content"]["parts"][0]["text"])
    if not isinstance(doc, dict) or not all(isinstance(doc.get(k), str) for k in ("summary", "when_to_use")):
        raise ValueError("reply lacks a text")
    return {"summary": doc["summary"], "when_to_use": doc["when_to_use"]}


def poll(check, first: float = 5.0, growth: float = 1.5, cap: float = 15.0, timeout: float = 600.0, clock=time.monotonic, sleep=time.sleep):
    """check() until it gives something other than None: after 5 s, then ever longer, 15 s at most, for 600 s."""
    began, wait = clock(), first
    while (got := check()) is None:
        if clock() - began + wait > timeout:
            raise TimeoutError("batch was not done in time")
        sleep(wait)
        wait = min(wait * growth, cap)
    return got


def batch_texts(operation: dict) -> list[str]:
    """Texts of a finished batch in the order of its requests, from any of the three places where replies stand."""
    response = operation.get("response", operation)
    rows = response.get("inlinedResponses", response.get("responses", response.get("results", [])))
    rows = rows.get("inlinedResponses", []) if isinstance(rows, dict) else rows
    return [json.dumps(r.get("response", r)) for r in rows]


def describe(asked: DataFrame, provider: Provider, concurrency: int = 4, size: int = BATCH) -> DataFrame:
    """(path, summary, when_to_use, error) from (path, prompt): batches of `size`, on `concurrency` tasks."""

    def run(batches):
        import pandas as pd

        for b in batches:
            for i in range(0, len(b), size):
                part = b.iloc[i : i + size].to_dict("records")
                replies = provider.describe(part)
                yield pd.DataFrame([{"path": r["path"], "summary": x.get("summary"), "when_to_use": x.get("when_to_use"), "error": x.get("error")} for r, x in zip(part, replies, strict=True)])

    return asked.repartition(concurrency).mapInPandas(run, "path string, summary string, when_to_use string, error string")


def apply_replies(files: DataFrame, replies: DataFrame):
    """(files with the texts of replies without error, one row of counts: enriched, failed)."""
    good = replies.where("error is null")
    return set_texts(files, good, strict=False), replies.agg(F.count_if(F.col("error").isNull()).alias("enriched"), F.count_if(F.col("error").isNotNull()).alias("failed"))
