"""Language-model calls as a map over a table of requests: retries, a circuit breaker, validation, an audit row each.

The client is any callable (operation, payload) -> text that a task can build for itself. ScriptedClient answers from a
table and is the double for tests. Concurrency is the number of partitions.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RETRYABLE = {"timeout", "rate_limit", "network", "unknown"}
ATTEMPTS, FIRST_DELAY, LONGEST_DELAY = 3, 0.25, 2.0
FAILURES, RECOVERY = 5, 30.0


class CallFailed(Exception):
    """A failed call: category is one of timeout, rate_limit, network, auth, configuration, validation, unknown."""

    def __init__(self, category: str, message: str = ""):
        super().__init__(message or category)
        self.category = category


@dataclass
class ScriptedClient:
    """Answers by operation, in order; the last one repeats. An answer `!category` is a failure."""

    answers: dict[str, list[str]]
    used: dict[str, int] = field(default_factory=dict)

    def __call__(self, operation: str, payload: str) -> str:
        own = self.answers.get(operation)
        if not own:
            raise CallFailed("configuration", f"no answer for {operation}")
        k = self.used[operation] = self.used.get(operation, -1) + 1
        answer = own[min(k, len(own) - 1)]
        if answer.startswith("!"):
            raise CallFailed(answer[1:])
        return answer


@dataclass
class Breaker:
    """Opens after so many failures in a row; lets one call through after a while."""

    clock: Callable[[], float] = time.monotonic
    failures: int = 0
    opened: float | None = None

    def allows(self) -> bool:
        return self.opened is None or self.clock() - self.opened >= RECOVERY

    def note(self, ok: bool) -> None:
        if ok:
            self.failures, self.opened = 0, None
            return
        self.failures += 1
        if self.failures >= FAILURES or self.opened is not None:
            self.opened = self.clock()


def call(client: Callable[[str, str], str], operation: str, payload: str, required: list[str], breaker: Breaker, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, int]:
    """(answer, failure category, attempts). An answer must be a JSON object with the required keys, if any are named."""
    category, attempt = "unknown", 0
    for attempt in range(1, ATTEMPTS + 1):
        if not breaker.allows():
            return None, "circuit_open", attempt - 1
        try:
            answer = client(operation, payload)
            if required:
                found = json.loads(answer)
                if missing := [k for k in required if k not in found]:
                    raise CallFailed("validation", f"missing {missing}")
            breaker.note(True)
            return answer, None, attempt
        except CallFailed as e:
            category = e.category
        except json.JSONDecodeError:
            category = "validation"
        breaker.note(False)
        if category not in RETRYABLE:
            break
        if attempt < ATTEMPTS:
            sleep(min(LONGEST_DELAY, FIRST_DELAY * 2 ** (attempt - 1)))
    return None, category, attempt


def invoke(requests: DataFrame, make_client: Callable[[], Callable[[str, str], str]], required: list[str] = (), partitions: int | None = None, redact: Callable[[str], str] | None = None) -> DataFrame:
    """request_id, operation, answer, failure, attempts, latency_ms, payload (redacted) of each request (request_id, operation, payload)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, breaker = make_client(), Breaker()
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                began = time.monotonic()
                answer, failure, attempts = call(client, r.operation, r.payload, list(required), breaker)
                rows.append((r.request_id, r.operation, answer, failure, attempts, int(1000 * (time.monotonic() - began)), redact(r.payload) if redact else r.payload))
            yield pd.DataFrame(rows, columns=["request_id", "operation", "answer", "failure", "attempts", "latency_ms", "payload"])

    if partitions:
        requests = requests.repartition(partitions)
    return requests.select(F.col("request_id").cast("string").alias("request_id"), "operation", "payload").mapInPandas(run, "request_id string, operation string, answer string, failure string, attempts int, latency_ms long, payload string")


def requests(df: DataFrame, operation: str, id_col: str, instruction: str, *payload: str) -> DataFrame:
    """Requests with a payload of an instruction and the named columns as JSON."""
    return df.select(F.col(id_col).alias("request_id"), F.lit(operation).alias("operation"), F.to_json(F.struct(F.lit(instruction).alias("instruction"), *payload)).alias("payload"))


#: The operations that take a model, and what each is asked for.
INSTRUCTIONS = {
    "query_planning": "Plan the retrieval of this query.",
    "retrieval_ranking": "Score each candidate for the query from 0 to 1.",
    "hierarchy_synthesis": "Give the sections of these pages with level, title, first and last page.",
    "chunk_hierarchy": "Give the sections of this run of pages.",
    "merge_hierarchy": "Join the sections of all runs into one list.",
    "decomposition": "Give boundaries (page, title) inside this long section.",
    "summarization": "Summarize this section.",
    "document_description": "Describe this document in a few sentences.",
    "description_selection": "Choose the documents whose descriptions answer the query.",
    "metadata_selection": "Turn the query into clauses over these metadata fields.",
    "tree_search": "Choose at most two sections to follow.",
    "preference_tree_search": "Choose at most two sections to follow, minding the preferences.",
    "vlm_transcription": "Transcribe this page to Markdown.",
}
