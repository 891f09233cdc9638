"""Results as JSON rows, Markdown tables, and trees of files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.project import open_root


def json_rows(df: DataFrame) -> DataFrame:
    """One compact JSON text a row, column ``value``; write it with ``.write.text``."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def markdown_table(columns: list[str], rows: list[tuple]) -> str:
    def line(cells) -> str:
        return "| " + " | ".join("" if c is None else str(c).replace("|", "\\|").replace("\n", " ") for c in cells) + " |"

    return "\n".join([line(columns), line("---" for _ in columns), *map(line, rows)])


def write_files(files: DataFrame, root: str) -> str:
    """``root``, where each row of ``files`` (path, text) has become a file, written by tasks; a task that runs again
    writes the same once more. A null text is an empty file."""

    def run(batches):
        store, top = open_root(root)
        for b in batches:
            for path, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True):
                store.create_dir(f"{top}/{path}".rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(f"{top}/{path}", compression=None) as f:
                    f.write((text or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    files.select("path", "text").mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()
    return root


def bench_summary(runs: list[dict]) -> dict:
    """Averages of runs that have ``tokens``, ``other_tokens``, ``ms`` and ``other_ms``; recall and false positives of
    runs that have ``found`` and ``expected``."""
    compared = [r for r in runs if r.get("other_tokens")]
    judged = [r for r in runs if "expected" in r]
    hits = sum(len(set(r["found"]) & set(r["expected"])) for r in judged)
    wanted = sum(len(set(r["expected"])) for r in judged)
    return {
        "token_ratio": sum(r["tokens"] / r["other_tokens"] for r in compared) / len(compared) if compared else None,
        "speed_up": sum(r["other_ms"] / r["ms"] for r in compared) / len(compared) if compared else None,
        "recall": hits / wanted if wanted else None,
        "false_positives": sum(len(set(r["found"]) - set(r["expected"])) for r in judged),
    }
