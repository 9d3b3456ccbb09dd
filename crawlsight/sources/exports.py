"""Text and CSV exports for other tools."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_scores_csv(scored: DataFrame, path: str) -> None:
    """`ip,risk_score,is_bot` with a header."""
    (scored.select("ip", "risk_score", "is_bot")
     .write.mode("overwrite").option("header", True).csv(path))


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One value per line: flagged addresses, subnet blocklist."""
    df.select(df[column].cast("string").alias("value")).write.mode("overwrite").text(path)
