"""Reports from results that are small by definition (a top list, bucket counts), rendered on the driver."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import DataFrame, functions as F


def markdown_table(df: DataFrame, columns: list[str] | None = None, most: int = 200, digits: int = 4) -> str:
    """A table of at most ``most`` rows; bars in cells are escaped."""
    columns = columns or df.columns

    def cell(v) -> str:
        v = "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else ", ".join(map(str, v)) if isinstance(v, list) else str(v)
        return v.replace("|", "\\|").replace("\n", " ")

    rows = df.select(*columns).limit(most).collect()
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows)]) + "\n"


def histogram(bins: DataFrame, low: float, high: float, width: int = 40) -> str:
    """Bars of (bin, n) as text."""
    rows = bins.orderBy("bin").collect()
    most, step = max((r["n"] for r in rows), default=0), (high - low) / max(1, len(rows))
    return "\n".join(f"{low + i * step:8.3f} {'#' * round(width * r['n'] / most if most else 0)} {r['n']}" for i, r in enumerate(rows)) + "\n"


def metadata(spaces: dict[str, DataFrame], results: dict[str, dict | None], inputs: DataFrame | None = None, day: date | None = None) -> str:
    """Version 2 export metadata as JSON: sizes and accuracy of each space (null where there are no results), hashes of the inputs."""
    out = {"metadata_schema_version": 2, "date": day.isoformat() if day else None, "spaces": {}}
    for name, s in spaces.items():
        r = s.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
        out["spaces"][name] = {"vocab_size": r["n"], "dim": r["d"], "accuracy": results.get(name)}
    out["inputs"] = {r["path"]: r["sha256"] for r in inputs.collect()} if inputs is not None else {}
    return json.dumps(out, sort_keys=True, ensure_ascii=False)


def summary(tables: dict[str, DataFrame], version: int = 1, most: int = 50) -> str:
    """The top rows of each table as one JSON document with sorted keys."""
    return json.dumps({"schema_version": version} | {k: [r.asDict(recursive=True) for r in t.limit(most).collect()] for k, t in tables.items()}, sort_keys=True, ensure_ascii=False, default=str)
