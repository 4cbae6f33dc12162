"""Extraction by pluggable providers: retry with back-off, fallback chain, saturation breaker, reported failures."""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "key string, payload string, provider string, attempts int, error string"


def classify(error: Exception) -> str:
    text = f"{type(error).__name__} {error}".lower()
    for word, kind in (("rate", "rate_limited"), ("429", "rate_limited"), ("timeout", "timeout"), ("json", "bad_output"), ("auth", "unauthorised")):
        if word in text:
            return kind
    return "provider_error"


def delay(attempt: int, base: float = 0.5, most: float = 20.0, asked: float | None = None) -> float:
    """Seconds before the next attempt: what the provider asked for, else doubling."""
    return min(most, asked if asked is not None else base * 2**attempt)


def extract(rows: DataFrame, key: str, text: str, providers: list[tuple[str, Callable[[str], str]]], attempts: int = 3, saturation: int = 5, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """One row per input: the first provider that answers. Within a task a provider that was rate limited
    `saturation` times in a row is left out from then on; a row that no provider answers carries the last error."""

    def run(batches):
        limited = dict.fromkeys((n for n, _ in providers), 0)
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, tried, last = None, 0, "no_provider"
                for name, call in providers:
                    if limited[name] >= saturation:
                        continue
                    for i in range(attempts):
                        tried += 1
                        try:
                            found = (call(t or ""), name)
                            limited[name] = 0
                            break
                        except Exception as e:  # noqa: BLE001  (classified and reported with the row)
                            last = classify(e)
                            limited[name] = limited[name] + 1 if last == "rate_limited" else 0
                            if last == "unauthorised" or limited[name] >= saturation:
                                break
                            pause(delay(i))
                    if found:
                        break
                out.append((str(k), found and found[0], found and found[1], tried, None if found else last))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return rows.select(key, text).mapInArrow(run, SCHEMA)
