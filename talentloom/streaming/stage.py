"""A batch stage over items that arrive as files: idempotent epochs, a ledger of attempts, early stop, resume of failed items, preflight, run records.

Each epoch's results and ledger go to folders of that epoch, overwritten if the epoch runs again after a crash, so every item counts once. An item
that an earlier epoch settled is left out of later ones. The stage stops before the next epoch once provider errors end the order of items for
``saturation`` items in a row: that epoch stays unread, and the next run starts with it. Failed items (not rejected or skipped ones) can be run again; the last
attempt of an item is its state.

A process is a function DataFrame -> DataFrame that keeps `item` and adds state (success, skipped, rejected, failed), failure_type, error and whatever columns
make up the result.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Process = Callable[[DataFrame], DataFrame]
LEDGER = "item long, state string, failure_type string, error string, epoch long, attempt int"
PROVIDER_ERROR = "provider_error"


def provider_status(name: str, probe: Callable[[], object]) -> dict:
    """Whether one provider answers, and if not, what kind of error it gives."""
    try:
        probe()
    except Exception as e:  # noqa: BLE001  (reported)
        text = f"{type(e).__name__} {e}".lower()
        kinds = [(("429", "too many requests"), "provider_rate_limited"), (("timed out", "timeout"), "provider_timeout"), (("not_configured", "missing_api_key"), "missing_api_key")]
        return {"provider": name, "available": False, "status": next((kind for words, kind in kinds if any(w in text for w in words)), "provider_error")}
    return {"provider": name, "available": True, "status": "ok"}


def preflight(primary: tuple[str, Callable], fallback: tuple[str, Callable]) -> dict:
    """ok, degraded_fallback_only or provider_preflight_failed, with the provider to use."""
    first, second = provider_status(*primary), provider_status(*fallback)
    status = "ok" if first["available"] else "degraded_fallback_only" if second["available"] else "provider_preflight_failed"
    use = primary[0] if first["available"] else fallback[0] if second["available"] else None
    return {"provider_preflight_status": status, "recommended_provider": use, "providers": {first["provider"]: first, second["provider"]: second}}


class Stage:
    """One stage with its folder: checkpoint, results, ledger, runs."""

    def __init__(self, spark: SparkSession, root: str, source: str, schema: str, process: Process, saturation: int = 3, files_per_epoch: int = 1) -> None:
        self.spark, self.root, self.source, self.schema = spark, root, source, schema
        self.process, self.saturation, self.files_per_epoch = process, saturation, files_per_epoch
        spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(f"{root}/ledger/epoch=-1")

    def ledger(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).option("basePath", f"{self.root}/ledger").parquet(f"{self.root}/ledger/*")

    def states(self) -> DataFrame:
        """(item, state, failure_type, error, epoch, attempts): each item's last attempt."""
        last = F.max_by(F.struct("state", "failure_type", "error", "epoch", "attempt"), F.struct("attempt", "epoch"))
        return self.ledger().groupBy("item").agg(last.alias("_l")).select("item", "_l.state", "_l.failure_type", "_l.error", "_l.epoch", F.col("_l.attempt").alias("attempts"))

    def results(self) -> DataFrame:
        """The results of successful attempts, one row an item."""
        rows = self.spark.read.option("basePath", f"{self.root}/results").parquet(f"{self.root}/results/*")
        good = self.states().where("state = 'success'").select(F.col("item").alias("_i"), F.col("epoch").alias("_e"))
        return rows.join(good, (F.col("item") == F.col("_i")) & (F.col("epoch") == F.col("_e"))).drop("_i", "_e")

    def _commit(self, rows: DataFrame, epoch: int) -> DataFrame:
        """Process rows as one epoch and write its results and ledger; its ledger is returned."""
        before = self.ledger().where(F.col("epoch") != epoch).groupBy("item").agg(F.max("attempt").alias("_tries"), F.max_by("state", "attempt").alias("_was"))
        before = before.withColumnRenamed("item", "_i")
        todo = rows.join(before, F.col("item") == F.col("_i"), "left").where("_was is null or _was = 'failed'").withColumn("attempt", F.coalesce("_tries", F.lit(0)) + 1).drop("_i", "_tries", "_was")
        done = self.process(todo.dropDuplicates(["item"]))
        result = f"{self.root}/results/epoch={epoch}"
        done.write.mode("overwrite").parquet(result)
        entries = self.spark.read.schema(done.schema).parquet(result).select("item", "state", "failure_type", "error", F.col("attempt").cast("int").alias("attempt"))
        entries.write.mode("overwrite").parquet(f"{self.root}/ledger/epoch={epoch}")
        return entries

    def _streak(self, entries: DataFrame) -> tuple[int, bool]:
        """Provider errors at the end of the order of items, and whether they are all there is."""
        bad = F.coalesce((F.col("state") == "failed") & (F.col("failure_type") == PROVIDER_ERROR), F.lit(False))
        last_other = entries.where(~bad).agg(F.max("item")).first()[0]
        tail = entries.where(bad) if last_other is None else entries.where(bad & (F.col("item") > last_other))
        return tail.count(), last_other is None

    def run(self, run_id: str, check: dict | None = None) -> dict:
        """All files that are there, epoch by epoch; check: what preflight said."""
        if check and check["provider_preflight_status"] == "provider_preflight_failed":
            return self._record(run_id, [], False, "provider_preflight_failed", check)
        epochs: list[int] = []
        state = {"streak": 0, "stop": False}

        def epoch(batch: DataFrame, number: int) -> None:
            if state["stop"]:
                raise RuntimeError("stage stopped early")  # the epoch is not committed: a later run reads it
            tail, whole = self._streak(self._commit(batch, number))
            state["streak"] = tail + (state["streak"] if whole else 0)
            state["stop"] = state["streak"] >= self.saturation
            epochs.append(number)

        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files_per_epoch).parquet(self.source)
        q = stream.writeStream.foreachBatch(epoch).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except StreamingQueryException:
            if not state["stop"]:
                raise
        return self._record(run_id, epochs, state["stop"], "provider_saturation" if state["stop"] else None, check)

    def resume_failed(self, run_id: str) -> dict:
        """Another attempt of all items whose last one failed."""
        failed = self.states().where("state = 'failed'").select(F.col("item").alias("_i"))
        rows = self.spark.read.schema(self.schema).parquet(self.source).join(failed, F.col("item") == F.col("_i"), "left_semi")
        number = (1 << 40) + self.ledger().where(F.col("epoch") >= 1 << 40).select("epoch").distinct().count()  # behind those of streams
        self._commit(rows, number)
        return self._record(run_id, [number], False, None, None)

    def _record(self, run_id: str, epochs: list[int], early: bool, reason: str | None, check: dict | None) -> dict:
        mine = self.ledger().where(F.col("epoch").isin(epochs)) if epochs else self.ledger().limit(0)
        states = {r["state"]: r["n"] for r in mine.groupBy("state").agg(F.count("*").alias("n")).collect()}
        causes = mine.where("state in ('failed', 'rejected')").groupBy(F.coalesce("failure_type", F.lit("unknown_error")).alias("c")).agg(F.count("*").alias("n")).collect()
        total = sum(r["n"] for r in causes)
        record = {
            "run_id": run_id, "recorded_at": datetime.now(UTC).isoformat(), "epochs": epochs, "items": sum(states.values()), "states": states, "stopped_early": early, "stop_reason": reason, "preflight": check,
            "dominant_failure_causes": [{"cause": r["c"], "count": r["n"], "frequency": round(r["n"] / total, 4)} for r in sorted(causes, key=lambda r: (-r["n"], r["c"]))],
        }
        self.spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/runs/{run_id}")
        return record

    def read_record(self, run_id: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/runs/{run_id}").first()[0])
