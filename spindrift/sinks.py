"""Writers: audited tables, single CSV files, JSON documents, reports, gated promotion of results."""

from __future__ import annotations

import json
import os
import shutil
import time
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: CSV that read_csv reads back as it was: quotes doubled, white space and line breaks of cells kept.
CSV = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}


def write_tables(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        w.options(**CSV).csv(f"{folder}/{name}") if fmt == "csv" else w.format(fmt).save(f"{folder}/{name}")


def write_single_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """One CSV file with header and byte-order mark, for small reports; rows are streamed through the driver
    one partition at a time."""
    import csv

    with open(path, "w", encoding="utf-8-sig" if bom else "utf-8", newline="") as f:
        w = csv.writer(f)
        w.writerow(df.columns)
        for r in df.toLocalIterator():
            w.writerow(["" if v is None else v for v in r])


def to_document(df: DataFrame, keep_nulls: bool = True) -> str:
    """A one-row table as one JSON text with sorted keys."""
    row = df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": str(not keep_nulls).lower()})).first()
    return json.dumps(json.loads(row[0]), ensure_ascii=False, sort_keys=True) if row else "{}"


def write_document(value: Mapping, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, sort_keys=True, default=str)


def write_report(title: str, lines: list[str], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join([f"# {title}", "", *lines]) + "\n")


def write_vectors(df: DataFrame, path: str, id_col: str, vec_col: str = "features") -> None:
    df.select(id_col, F.col(vec_col).cast("array<double>").alias(vec_col)).write.mode("overwrite").parquet(path)


def promote(write: Callable[[str], None], target: str, accepted: bool, review: Mapping, review_path: str) -> bool:
    """Write results beside their place and move them in only if accepted; otherwise leave the old ones, write
    the review document and return False. Accepted results delete a stale review. Local folders."""
    if not accepted:
        write_document(review, review_path)
        return False
    fresh = f"{target}.new-{os.getpid()}"
    shutil.rmtree(fresh, ignore_errors=True)
    write(fresh)
    shutil.rmtree(target, ignore_errors=True)
    os.replace(fresh, target)
    if os.path.exists(review_path):
        os.remove(review_path)
    return True


class RunLog:
    """Elapsed seconds of named steps."""

    def __init__(self) -> None:
        self.steps: list[tuple[str, float]] = []
        self._at = time.monotonic()

    def mark(self, name: str) -> None:
        now = time.monotonic()
        self.steps.append((name, now - self._at))
        self._at = now

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.steps, "step string, seconds double")
