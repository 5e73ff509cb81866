"""What is done with answers on the driver: rows as text, HTML tables, mean times."""

from __future__ import annotations

import html
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def string_rows(df: DataFrame, limit: int | None = None) -> list[list[str | None]]:
    """All rows (or the first ``limit``) with every value as text."""
    text = df.toDF(*(f"c{i}" for i in range(len(df.columns)))).select(*(F.col(f"c{i}").cast("string") for i in range(len(df.columns))))
    return [list(r) for r in (text if limit is None else text.limit(limit)).collect()]


def html_table(df: DataFrame, limit: int | None = None) -> str:
    """An HTML table of the rows under a head of column names; values are escaped, nulls have an empty cell of class ``null``."""

    def cell(value: str | None) -> str:
        return "<td class='null'></td>" if value is None else f"<td>{html.escape(value)}</td>"

    head = "".join(f"<th scope='col'>{html.escape(c)}</th>" for c in df.columns)
    body = "\n".join("<tr>" + "".join(map(cell, r)) + "</tr>" for r in string_rows(df, limit))
    return f"<table class='answer'>\n<thead><tr>{head}</tr></thead>\n<tbody>\n{body}\n</tbody>\n</table>"


def note(text: str) -> str:
    """A line of HTML that stands in the place of an answer."""
    return f"<p class='note'>{html.escape(text)}</p>"


def quoted(value: str) -> str:
    """A value for a place between single quotes in standard SQL."""
    return value.replace("'", "''")


def mean(times: Sequence[int]) -> int:
    """The whole mean."""
    return sum(times) // len(times)
