"""Report sinks and readers.  Reports hold one row per setup, so they are driver-side text."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADLINE_METRICS = ("ndcg@5", "recall@5", "mrr", "map")
_NO_METRIC = {"mean": 0.0, "ci_lo": 0.0, "ci_hi": 0.0}


def format_ci(mean: float, lo: float, hi: float, decimals: int = 3) -> str:
    return f"{mean:.{decimals}f} [{lo:.{decimals}f}, {hi:.{decimals}f}]"


def format_latency(ms: float) -> str:
    return f"{ms:.1f} ms"


def significance(p: float) -> str:
    return "**" if p < 0.01 else "*" if p < 0.05 else ""


def _headline(result: Mapping[str, Any]) -> list[str]:
    cells = []
    for metric in HEADLINE_METRICS:
        m = result["summary"].get(metric, _NO_METRIC)
        cells.append(format_ci(m["mean"], m["ci_lo"], m["ci_hi"]))
    return cells + [format_latency(result["latency"].get(key, 0.0)) for key in ("p50_ms", "p95_ms")]


def _table(header: Sequence[str], rows: Sequence[Sequence[str]]) -> str:
    lines = ["| " + " | ".join(header) + " |", "|" + "---|" * len(header)]
    return "\n".join(lines + ["| " + " | ".join(row) + " |" for row in rows])


def _stamp() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M UTC")


def _comparison_rows(comparisons: Mapping[str, Mapping[str, float]]) -> list[list[str]]:
    return [[f"`{name}`", f"{c['delta']:+.4f}", f"{c['p_value']:.4f}", significance(c["p_value"])]
            for name, c in comparisons.items()]


def results_markdown(results: Mapping[str, Mapping[str, Any]],
                     comparisons: Mapping[str, Mapping[str, float]], reference: str) -> str:
    metrics = [[f"`{name}`", *_headline(result)] for name, result in results.items()]
    return "\n\n".join([
        "# Retrieval evaluation", f"_Generated: {_stamp()}_",
        "## Metrics per setup (mean [95% CI])",
        _table(["Setup", *HEADLINE_METRICS, "p50 lat", "p95 lat"], metrics),
        f"## Significance against `{reference}` on ndcg@5",
        _table(["Setup", "delta", "p-value", "sig"], _comparison_rows(comparisons)),
        r"_\* p<0.05  \*\* p<0.01_", ""])


def console_table(results: Mapping[str, Mapping[str, Any]],
                  comparisons: Mapping[str, Mapping[str, float]], reference: str) -> str:
    """The same two tables, aligned for a terminal."""
    rows = [["Setup", *HEADLINE_METRICS, "p50 lat", "p95 lat"]]
    rows += [[name, *_headline(result)] for name, result in results.items()]
    if comparisons:
        rows.append([f"vs {reference} (ndcg@5)", "delta", "p-value", "sig", "", "", ""])
        rows += [[name.strip("`"), *rest, "", "", ""] for name, *rest in _comparison_rows(comparisons)]
    widths = [max(len(row[i]) for row in rows) for i in range(len(rows[0]))]
    return "\n".join("  ".join(cell.ljust(w) for cell, w in zip(row, widths)).rstrip() for row in rows)


def write_text(path: str | Path, text: str) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return path


def write_results_json(path: str | Path, results: Mapping[str, Mapping[str, Any]],
                       comparisons: Mapping[str, Any], metadata: Mapping[str, Any]) -> Path:
    """metadata, one summary block per setup (per-question rows are left out), comparisons."""
    blocks = {name: {key: result[key] for key in ("summary", "latency", "n_queries")}
              for name, result in results.items()}
    payload = {"metadata": dict(metadata), "pipelines": blocks, "comparisons": dict(comparisons)}
    return write_text(path, json.dumps(payload, indent=2))


def read_results(spark: SparkSession, path: str | Path) -> DataFrame:
    """setup, metric, mean, ci_lo, ci_hi from a results file; empty for a damaged one."""
    schema = "setup string, metric string, mean double, ci_lo double, ci_hi double"
    try:
        report = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, json.JSONDecodeError):
        report = {}
    rows = [
        (setup, metric, *(float(values[key]) if values.get(key) is not None else None
                          for key in ("mean", "ci_lo", "ci_hi")))
        for setup, block in report.get("pipelines", {}).items() if isinstance(block, dict)
        for metric, values in block.get("summary", {}).items() if isinstance(values, dict)
    ]
    return spark.createDataFrame(rows, schema)


def write_csv(df: DataFrame, path: str | Path) -> None:
    """One CSV file with a header; for reports of a few rows."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(str(path))


def ablation_markdown(rows: Sequence[Mapping[str, Any]]) -> str:
    """Grid table, best nDCG@5 first; *rows* are already ordered."""
    body = [[f"`{r['label']}`", r["chunker"], r["retriever"], "yes" if r["rerank"] else "no",
             *(format_ci(r[f"{m}_mean"], r[f"{m}_lo"], r[f"{m}_hi"]) for m in ("ndcg5", "recall5", "mrr")),
             format_latency(r["p50_ms"])] for r in rows]
    header = ["Config", "Chunker", "Retriever", "Rerank", "nDCG@5 (CI)", "Recall@5 (CI)", "MRR (CI)", "p50 lat"]
    return "\n\n".join(["# Ablation study", f"_Generated: {_stamp()}_",
                        "## Grid, best nDCG@5 first", _table(header, body), ""])


def ndcg_chart(ablation: DataFrame) -> DataFrame:
    """Bars with error lengths, best first: label, mean, err_lo, err_hi (never negative)."""
    zero = F.lit(0.0)
    return ablation.select(
        "label", F.col("ndcg5_mean").alias("mean"),
        F.greatest(zero, F.col("ndcg5_mean") - F.col("ndcg5_lo")).alias("err_lo"),
        F.greatest(zero, F.col("ndcg5_hi") - F.col("ndcg5_mean")).alias("err_hi"),
    ).orderBy(F.desc("mean"), "label")


def latency_quality_chart(ablation: DataFrame) -> DataFrame:
    return ablation.select("label", "p50_ms", "ndcg5_mean")


def search_view(run: DataFrame) -> DataFrame:
    """Result table for display: scores at five digits and a 200-character preview."""
    from rankloom.functions.text import snippet

    return run.select("qid", "rank", F.round("score", 5).alias("score"), "doc_id", "chunk_id", "retriever",
                      snippet(F.col("text"), 200, ellipsis=False).alias("snippet"))
