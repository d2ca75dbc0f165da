"""Sinks: JSON, CSV with a word for nulls, one text or edit log for each experiment row, HTML report."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, null: str = "null") -> None:
    df.write.mode("overwrite").csv(path, header=True, nullValue=null)


def write_texts(df: DataFrame, path: str, by: str = "experiment_id") -> None:
    """One folder for each value of by; only the text is written."""
    df.select(by, "text").write.mode("overwrite").partitionBy(by).text(path)


def write_edit_log(edits: DataFrame, path: str, by: str = "experiment_id") -> None:
    edits.write.mode("overwrite").partitionBy(by).json(path)


#: What a statement in a report rests on.
TAGS = ("FACT", "RESULT", "ASSUMPTION", "UNKNOWN")


def report(title: str, sections: list[tuple[str, list[tuple[str, str]], DataFrame | None]], rows: int = 200) -> str:
    """HTML of sections (heading, tagged statements, table); a table shows its first rows, which are
    all that comes to the driver."""
    esc = lambda x: html.escape("" if x is None else str(x))
    out = [f"<!doctype html><html><head><meta charset='utf-8'><title>{esc(title)}</title></head><body><h1>{esc(title)}</h1>"]
    for heading, statements, table in sections:
        out.append(f"<h2>{esc(heading)}</h2>")
        for tag, text in statements:
            if tag not in TAGS:
                raise ValueError(f"unknown tag {tag!r}")
            out.append(f"<p><b>{tag}</b> {esc(text)}</p>")
        if table is not None:
            got = table.limit(rows).collect()
            out.append("<table><tr>" + "".join(f"<th>{esc(c)}</th>" for c in table.columns) + "</tr>" + "".join("<tr>" + "".join(f"<td>{esc(v)}</td>" for v in r) + "</tr>" for r in got) + "</table>")
    return "".join(out) + "</body></html>"


def plots(df: DataFrame, path: str) -> dict[str, str]:
    """Scatter plots of the tradeoff table, if matplotlib is there; else none."""
    try:
        import matplotlib.pyplot as plt
    except ImportError:
        return {}
    rows = df.select("edit_distance", "watermark_score_after", "preservation_score").filter(F.col("watermark_score_after").isNotNull()).limit(5000).collect()
    made = {}
    for name in ("edit_distance", "preservation_score"):
        fig, ax = plt.subplots()
        ax.scatter([r[name] for r in rows], [r.watermark_score_after for r in rows])
        fig.savefig(f"{path}/{name}.png")
        made[name] = f"{path}/{name}.png"
    return made
