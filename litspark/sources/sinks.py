"""CSV sinks for the deliverable tables and the packaging of stage outputs
into a submission layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import StageMissing, StageStore


def write_csv(df: DataFrame, path: str, order_by=None, drop=()) -> None:
    """CSV with a header row, no index column. Arrays are written as JSON
    text. ``order_by`` sorts the rows (a range sort, not one task)."""
    out = df.select(*[F.to_json(F.col(f.name)).alias(f.name)
                      if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name)
                      for f in df.schema.fields])
    if order_by:
        out = out.orderBy(*order_by)
    if drop:
        out = out.drop(*drop)
    # Spark's CSV writer trims outer whitespace unless told not to.
    (out.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_projected_csv(df: DataFrame, path: str, fields: list[str], order_by=None) -> None:
    """Write only ``fields`` (extras ignored; a missing field is NULL)."""
    cols = [F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields]
    write_csv(df.select(*cols), path, order_by)


def package_outputs(store: StageStore, target: str, deliverables: dict[str, str]) -> list[str]:
    """Copy each deliverable stage to ``target/<name>`` (parquet); missing
    stages are skipped and returned as warnings."""
    missing = []
    for name, stage in deliverables.items():
        try:
            df = store.read(stage)
        except StageMissing:
            missing.append(f"missing stage '{stage}' for {name}: skipped")
            continue
        df.write.mode("overwrite").parquet(f"{target.rstrip('/')}/{name}")
    return missing
