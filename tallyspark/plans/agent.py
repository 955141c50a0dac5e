"""Questions to SQL to rows: generator and validator prompts, safe execution, the self-correcting loop, strategies."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from . import dialect

PREVIEW, ATTEMPTS = 20, 5


@dataclass
class Generated:
    query: str
    reasoning: str = ""


@dataclass
class Validation:
    approved: bool
    error_message: str = ""
    corrected_query: str | None = None
    analysis_summary: str | None = None


@dataclass
class Response:
    query: str
    results: DataFrame | None
    total_count: int
    summary: str = ""
    reasoning: str = ""
    metadata: dict = field(default_factory=dict)


class Model(Protocol):
    """Anything that answers the two prompts with the structures above."""

    def generate(self, prompt: str) -> Generated: ...

    def validate(self, prompt: str) -> Validation: ...


class Scripted:
    """A model that gives prepared answers in turn; an exception among them is raised."""

    def __init__(self, generated: list, validations: list = ()):
        self.answers, self.checks, self.prompts = list(generated), list(validations), []

    def _next(self, prompt: str, of: list):
        self.prompts.append(prompt)
        x = of.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    def generate(self, prompt: str) -> Generated:
        return self._next(prompt, self.answers)

    def validate(self, prompt: str) -> Validation:
        return self._next(prompt, self.checks)


class Retrying:
    """Spreads calls over several clients at a least interval; failed ones wait longer, those that are gone leave."""

    def __init__(self, clients: list[Model], interval: float = 1.5, attempts: int = 15, gone: Callable[[Exception], bool] = lambda e: False, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.clients, self.interval, self.attempts, self.gone, self.sleep, self.clock = list(clients), interval, attempts, gone, sleep, clock
        self.last, self.turn = -1e9, 0

    def _call(self, how: str, prompt: str):
        wait, error = 1.0, None
        for _ in range(self.attempts):
            if not self.clients:
                break
            self.sleep(max(0.0, self.last + self.interval - self.clock()))
            self.last = self.clock()
            client = self.clients[self.turn % len(self.clients)]
            self.turn += 1
            try:
                return getattr(client, how)(prompt)
            except Exception as e:
                error = e
                if self.gone(e):
                    self.clients.remove(client)
                else:
                    self.sleep(wait)
                    wait = min(30.0, 2 * wait)
        raise RuntimeError("no client answered") from error

    def generate(self, prompt: str) -> Generated:
        return self._call("generate", prompt)

    def validate(self, prompt: str) -> Validation:
        return self._call("validate", prompt)


@dataclass(frozen=True)
class Strategy:
    retrieve: str | None  # None, "structured" or "unstructured"
    correct: bool

    @staticmethod
    def named(name: str) -> Strategy:
        kind = ("unstructured" if "unstructured" in name else "structured") if "rag" in name else None
        return Strategy(kind, "self_correcting" in name)


# The names of the strategies.
STRATEGIES = ["zero_context_sql", "unstructured_rag_sql", "structured_rag_sql", "self_correcting_sql", "self_correcting_structured_rag_sql"]

RULES = [
    "Use only the columns of the schema; there is no balance and no amount column.",
    "Never return id, file_name, page, passed_validation or search_text.",
    "Search texts with search_text LIKE '%word%' in lower case; use rlike for whole words.",
    "An inactive side is 0, not null: the amount is greatest(coalesce(debit, 0), coalesce(credit, 0)).",
    "Subqueries and common table expressions are fine; the statement must be one SELECT.",
    "A singular superlative asks for LIMIT 1; other questions have no limit unless they name one.",
    "In identifier columns 'None', 'nan', 'null' and '' mean that the value is missing.",
    "Use DISTINCT only if the question asks for it.",
    "dayofweek() counts from Sunday = 1; last_day() gives the end of a month; datediff() the days between.",
]
AUDIT = ["columns exist and are the ones asked for", "filters say what the question says", "grouping and amounts are right", "the preview is plausible for the question"]


def generator_prompt(question: str, schema: str, domain: str = "", context: str = "", history: list[str] = ()) -> str:
    parts = [("Schema", schema), ("Domain", domain), ("Context", context), ("Earlier attempts", "\n".join(history)), ("Rules", "\n".join(f"{i}. {r}" for i, r in enumerate(RULES, 1))), ("Question", question)]
    return "\n\n".join(f"## {k}\n{v}" for k, v in parts if v)


def validator_prompt(question: str, query: str, preview: str, count: int, schema: str, domain: str = "", history: list[str] = (), context: str = "", reasoning: str = "", last: bool = False) -> str:
    parts = [("Schema", schema), ("Domain", domain), ("Context", context), ("Question", question), ("Query", query), ("Reasoning of its author", reasoning), ("Rows", str(count)), ("Preview", preview), ("Earlier remarks", "\n".join(history)), ("Check that", "\n".join(AUDIT)), ("Last attempt", "This is the last attempt: reject only what a corrected query mends." if last else "")]
    return "\n\n".join(f"## {k}\n{v}" for k, v in parts if v)


def column_contract(columns: list[str], properties: list | None = None) -> str:
    return "Return exactly these columns in this order: " + ", ".join(columns) + (f"\nProperties: {properties}" if properties else "")


@dataclass
class Agent:
    spark: SparkSession
    model: Model
    schema: str
    domain: str = ""
    attempts: int = ATTEMPTS

    def _try(self, query: str) -> tuple[DataFrame, str, int]:
        """The plan, its first rows as text and its number of rows."""
        df = dialect.run(self.spark, query)
        return df, "\n".join(str(r.asDict()) for r in df.limit(PREVIEW).collect()), df.count()

    def run(self, question: str, context: str = "", correct: bool = False) -> Response:
        began = time.monotonic()
        r = (self._loop if correct else self._once)(question, context)
        r.metadata["execution_time_ms"] = round(1000 * (time.monotonic() - began))
        return r

    def _once(self, question: str, context: str) -> Response:
        try:
            g = self.model.generate(generator_prompt(question, self.schema, self.domain, context))
        except Exception as e:
            return Response("", None, 0, metadata={"attempts": 1, "validation_passed": False, "generation_error": str(e)})
        try:
            df = dialect.run(self.spark, g.query)
            return Response(g.query, df, df.count(), reasoning=g.reasoning, metadata={"attempts": 1, "validation_passed": None})
        except Exception as e:
            return Response(g.query, None, 0, reasoning=g.reasoning, metadata={"attempts": 1, "validation_passed": False, "error": str(e)})

    def _loop(self, question: str, context: str) -> Response:
        said: list[str] = []  # to the generator
        remarks: list[str] = []  # to the validator
        pending: tuple[str, DataFrame, str, int] | None = None  # a corrected query that has run
        for n in range(1, self.attempts + 1):
            if pending is None:
                try:
                    g = self.model.generate(generator_prompt(question, self.schema, self.domain, context, said))
                    query, why = g.query, g.reasoning
                    if not query.strip():
                        raise ValueError("no query was given")
                except Exception as e:
                    said.append(f"generation failed: {e}")
                    continue
                try:
                    df, preview, count = self._try(query)
                except Exception as e:
                    said.append(f"{query}\nfailed: {e}")
                    continue
            else:
                (query, df, preview, count), pending, why = pending, None, ""
            try:
                v = self.model.validate(validator_prompt(question, query, preview, count, self.schema, self.domain, remarks, context, why, n == self.attempts))
            except Exception as e:
                remarks.append(f"validation failed: {e}")
                continue
            if v.approved:
                return Response(query, df, count, v.analysis_summary or "", metadata={"attempts": n, "validation_passed": True})
            better = v.corrected_query or query
            remarks.append(f"{query}\nrejected: {v.error_message}")
            said.append(f"{query}\nrejected: {v.error_message}")
            try:
                df, preview, count = (df, preview, count) if better == query else self._try(better)
            except Exception as e:
                said.append(f"{better}\nfailed: {e}")
                continue
            if n == self.attempts:
                return Response(better, df, count, v.analysis_summary or "", metadata={"attempts": n, "validation_passed": False})
            pending = (better, df, preview, count)
        return Response("", None, 0, metadata={"attempts": self.attempts, "validation_passed": False, "error": said[-1] if said else "no attempt led to a result"})
