"""What the training-data operators share: tables, the shared folder, text expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.shared import arrow_batches, delete, drop_stash, gives_back, scratch, stash, workspace  # noqa: F401  the operators take them from here

#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def operator(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator's result (ids and numbers, no texts) becomes a table in the shared folder; what it wrote on the way is deleted."""

    @wraps(f)
    def run(rows: DataFrame, *args, **kw) -> DataFrame:
        with workspace(rows.sparkSession), arrow_batches(rows.sparkSession):
            return stash(f(rows, *args, **kw), f.__name__, keep=True)

    return run


def maybe_broadcast(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """Broadcast only what was counted to be small; otherwise the planner chooses."""
    return F.broadcast(df) if rows <= limit else df


def text_key(text: Column) -> Column:
    """With the id, what tells rows apart; rows equal in both are copies."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def crc_mod3(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def without(docs: DataFrame, every: DataFrame, gone: DataFrame, id_col: str, th: Column) -> DataFrame:
    """The rows of docs but those whose id and text key are in gone (id, th); of rows that repeat both, one. every: all of docs' (id, th)."""
    marked = docs.withColumns({"_cairn_i": F.col(id_col).cast("long"), "_cairn_t": th})
    on = F.col("_cairn_i").eqNullSafe(F.col("_cairn_id")) & F.col("_cairn_t").eqNullSafe(F.col("_cairn_th"))

    def keys(df: DataFrame) -> DataFrame:
        df = df.select(F.col("id").cast("long").alias("_cairn_id"), F.col("th").alias("_cairn_th"))
        return maybe_broadcast(df, df.count())

    rows = marked.join(keys(gone), on, "left_anti")
    again = every.groupBy("id", "th").count().filter("count > 1")
    if again.limit(1).count():
        again = keys(again)
        once = rows.join(again, on, "left_semi").dropDuplicates(["_cairn_i", "_cairn_t"])
        rows = rows.join(again, on, "left_anti").unionByName(once)
    return rows.select(docs.columns)
