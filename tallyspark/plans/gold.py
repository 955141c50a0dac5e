"""The gold answers of a question set, kept by question id."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.ledger import read_results, write_results
from . import dialect


def without_zone(df: DataFrame) -> DataFrame:
    """Timestamps as the session's local time, without a zone."""
    return df.select(*(F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`") for f in df.schema))


def materialise(spark: SparkSession, questions: Iterable[dict], folder: str, force: bool = False, limit: int | None = None) -> dict[str, str]:
    """Runs each question's ground_truth_sql and writes its answer to folder/id; what became of each id.

    Answers that exist stay unless ``force``; a question without SQL is left out; one that fails doesn't stop the others. An empty
    answer keeps its columns. ``limit`` takes the first questions only, for trials.
    """
    done: dict[str, str] = {}
    for q in list(questions)[:limit]:
        path, sql = f"{folder}/{q['id']}", q.get("ground_truth_sql")
        if not force and read_results(spark, path) is not None:
            done[q["id"]] = "kept"
        elif not sql:
            done[q["id"]] = "no sql"
        else:
            try:
                write_results(without_zone(dialect.run(spark, sql)), path)
                done[q["id"]] = "written"
            except Exception as e:
                done[q["id"]] = f"failed: {str(e).splitlines()[0]}"
    return done
