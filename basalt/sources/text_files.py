"""CSV in and out, SQL scripts, and previews."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions.render import text_table
from basalt.functions.scalars import clean_text
from basalt.operators.cleaning import coerce


def read_csv(spark: SparkSession, path: str, longs: tuple[str, ...] = (), doubles: tuple[str, ...] = (), clean: bool = True) -> DataFrame:
    """A CSV with a header, all text; named columns become numbers, texts that stand for NULL become
    NULL. ``clean=False`` gives the raw text."""
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(f"{path} not found; give the path of a CSV file or folder with a header line")
    df = spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE").csv(path)
    if not clean:
        return df
    texts = [c for c in df.columns if c not in longs and c not in doubles]
    return coerce(df.withColumns({c: clean_text(F.col(f"`{c}`")) for c in texts}), longs, doubles)


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """A spreadsheet through pandas (needs a spreadsheet reader to be installed); for small files."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading spreadsheets needs openpyxl") from e
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, dtype=str))


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV folder, replaced as a whole."""
    df.write.mode("overwrite").option("header", True).csv(path)


def split_sql(script: str) -> list[str]:
    """Statements of a script: ``--`` comments go, semicolons inside quotes do not split."""
    out, now, quote, i = [], [], None, 0
    while i < len(script):
        c = script[i]
        if quote:
            now.append(c)
            quote = None if c == quote else quote
        elif c in "'\"`":
            quote = c
            now.append(c)
        elif script.startswith("--", i):
            i = script.find("\n", i)
            if i < 0:
                break
            continue
        elif c == ";":
            out.append("".join(now).strip())
            now = []
        else:
            now.append(c)
        i += 1
    return [s for s in [*out, "".join(now).strip()] if s]


def run_sql(spark: SparkSession, script: str, most: int = 25) -> list[tuple[str, str]]:
    """Run all statements, going on after an error: (statement, printed rows or error)."""
    out = []
    for s in split_sql(script):
        try:
            df = spark.sql(s)
            rows = df.limit(most + 1).collect()  # a preview, bounded
            out.append((s, text_table(df.columns, [tuple(r) for r in rows], most=most)))
        except Exception as e:
            out.append((s, f"error: {str(e).splitlines()[0]}"))
    return out


def show(df: DataFrame, title: str = "", most: int = 20) -> str:
    """The first rows as aligned text."""
    return text_table(df.columns, [tuple(r) for r in df.limit(most + 1).collect()], title, most)
