"""Plug-ins for models and services: registries by name, retries with a circuit breaker, fallbacks, deterministic stand-ins.

Everything here runs where the caller runs, inside the Python of a plug-in; the engine's own expressions need none of it.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Protocol, TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

T = TypeVar("T")


class Transient(Exception):
    """A failure that may pass by itself."""


class CircuitOpen(Exception):
    """Calls to an endpoint that is known to be down."""


@dataclass
class Circuits:
    """Breakers by endpoint: so many transient failures in a row close it for a while."""

    failures: int = 3
    cooldown: float = 60.0
    clock: Callable[[], float] = time.monotonic
    _count: dict[str, int] = field(default_factory=dict)
    _until: dict[str, float] = field(default_factory=dict)

    def is_open(self, key: str | None) -> bool:
        return key is not None and self.clock() < self._until.get(key, 0.0)

    def call(self, key: str | None, f: Callable[[], T], transient: Callable[[Exception], bool]) -> T:
        if self.is_open(key):
            raise CircuitOpen(key)
        try:
            out = f()
        except Exception as e:
            if key is not None and transient(e):
                self._count[key] = self._count.get(key, 0) + 1
                if self._count[key] >= self.failures:
                    self._until[key] = self.clock() + self.cooldown
            raise
        if key is not None:
            self._count.pop(key, None)
            self._until.pop(key, None)
        return out


def is_transient(e: Exception) -> bool:
    return isinstance(e, Transient | TimeoutError | ConnectionError)


def with_retries(f: Callable[[], T], attempts: int = 3, waits: tuple[float, ...] = (1.0, 2.0, 4.0), transient: Callable[[Exception], bool] = is_transient, sleep: Callable[[float], None] = time.sleep, key: str | None = None, circuits: Circuits | None = None) -> T:
    """The value of a call; a transient failure is tried again until the attempts or the endpoint are spent, any other is raised at once."""
    circuits = circuits or Circuits()
    for k in range(max(1, attempts)):
        try:
            return circuits.call(key, f, transient)
        except CircuitOpen:
            raise
        except Exception as e:
            if not transient(e) or k == max(1, attempts) - 1 or circuits.is_open(key):
                raise
            sleep(waits[min(k, len(waits) - 1)] if waits else 0.0)
    raise AssertionError("no attempt was made")


def with_fallback(primary: Callable[[], str], fallback: Callable[[], str] | None, empty_is_clean: bool = False) -> str:
    """A text of the first provider, or else of the second; nothing from both is a blank, nothing from one alone is not sure and raises."""
    if (text := primary()).strip():
        return text
    if fallback is None:
        if empty_is_clean:
            return ""
        raise Transient("an empty answer that no second provider confirms")
    second = fallback()
    return second if second.strip() else ""


class Generator(Protocol):
    """A model that answers a prompt."""

    def generate(self, prompt: str) -> str: ...


class EchoGenerator:
    """A deterministic stand-in: a record whose fields come from the words of the prompt."""

    def generate(self, prompt: str) -> str:
        words = re.findall(r"[a-z]{4,}", prompt.lower())
        common = sorted(set(words), key=lambda w: (-words.count(w), w))
        return json.dumps({"summary": " ".join(prompt.split()[:12]), "doc_type": ["note"], "topics": common[:3], "keywords": common[:8], "key_facts": [], "importance": 0.5})


def generate(df: DataFrame, prompt: str, generator: Generator, out: str = "answer") -> DataFrame:
    """Adds the answers of a model to the prompts of a column, batch by batch; a failure leaves null and its message in `<out>_error`."""
    schema = df.select("*", F.lit(None).cast("string").alias(out), F.lit(None).cast("string").alias(f"{out}_error")).schema

    def run(batches):
        for b in batches:
            answers, errors = [], []
            for p in b[prompt]:
                try:
                    answers.append(None if p is None else generator.generate(p))
                    errors.append(None)
                except Exception as e:  # a prompt that fails does not take the others with it
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:300])
            b[out], b[f"{out}_error"] = answers, errors
            yield b

    return df.mapInPandas(run, schema)


class Registry[V]:
    """Plug-ins by name; an unknown name is an error that lists the known ones."""

    def __init__(self, what: str):
        self.what, self._by = what, {}

    def add(self, name: str, value: V) -> V:
        self._by[name] = value
        return value

    def get(self, name: str) -> V:
        if name not in self._by:
            raise ValueError(f"unknown {self.what}: {name!r}; known: {sorted(self._by)}")
        return self._by[name]

    def names(self) -> list[str]:
        return sorted(self._by)


#: Text normalisers by name: a messages table and a participants table to messages.
NORMALIZERS: Registry[Callable[[DataFrame, DataFrame], DataFrame]] = Registry("text normalizer")


def normalizer(name: str | None) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A normaliser by its name; no name leaves messages as they are."""
    return (lambda messages, participants: messages) if not name else NORMALIZERS.get(name)


@dataclass
class Task:
    """A kind of benchmark: the score of a case from its columns, and the modes that it runs in."""

    score: Callable[[Mapping[str, Column]], Column]
    modes: tuple[str, ...] = ("default",)


TASKS: Registry[Task] = Registry("benchmark task")


def score_cases(cases: DataFrame, task: str, mode: str = "default") -> DataFrame:
    """Adds score to cases by a registered task."""
    t = TASKS.get(task)
    if mode not in t.modes:
        raise ValueError(f"unknown mode: {mode!r}; known: {sorted(t.modes)}")
    return cases.withColumn("score", t.score({c: F.col(c) for c in cases.columns}))
