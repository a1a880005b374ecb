"""Settings from ``name = value`` files."""

from __future__ import annotations

from pyspark.sql import SparkSession


def parse(text: str) -> dict[str, str]:
    """Names and values; lines that are empty, comments (# or ;) or sections say nothing, later values win."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] not in "#;[" and "=" in line:
            name, value = line.split("=", 1)
            out[name.strip()] = value.strip()
    return out


def apply(spark: SparkSession, settings: dict[str, str], prefix: str = "spark.sql.") -> None:
    """Set the session's settings that start with the prefix."""
    for name, value in settings.items():
        if name.startswith(prefix):
            spark.conf.set(name, value)
