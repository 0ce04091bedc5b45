"""What the corpus operators share: reading, checkpoints, words and row identity."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def load(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of a table; the scan reads no others."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared folder. Where none is set one is made up if all runs on this machine; on a cluster the other
    machines would not see it, and that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="cairn-checkpoint-"))
    return context.getCheckpointDir()


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there, so that a lost executor costs no more than
    the stage it was in."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def join_heavy(rows: DataFrame, classes: DataFrame, keys: list[str], size: str, share: int = 1000) -> DataFrame:
    """``rows`` joined on ``keys`` with ``classes``, which has one row per key and in ``size``, which goes, how many rows
    hold it. Keys that hold more than one in ``share`` of the rows of all classes are fewer than ``share``, whatever the
    data, and are broadcast; among the rest, joined by a shuffle, none holds more than that."""
    total = classes.agg(F.sum(size)).first()[0] or 0
    heavy = F.col(size) * share > total
    few, rest = classes.filter(heavy).drop(size), classes.filter(~heavy).drop(size)
    light = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(few), keys).unionByName(light.join(rest, keys))


#: Bytes of a table that is sent to every task, at most.
SENT = 8 << 20


def join_sized(rows: DataFrame, table: DataFrame, on: Column, how: str, size: int) -> DataFrame:
    """``rows`` joined with a table of ``size`` bytes as measured: sent to where the rows are if it is small, else both are
    shuffled. The rows are the same either way."""
    return rows.join(F.broadcast(table) if size <= SENT else table, on, how)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` does just that, and faster, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def version(text: Column) -> Column:
    """Tells rows that share an id apart by their texts. Rows equal in both are copies of one row and fare alike."""
    return F.coalesce(F.xxhash64(text), F.lit(0))


def once(column: Column) -> Column:
    """``column``, computed where it stands and nowhere else. The optimizer copies an expression into the filters above it
    and moves those down; within a lambda the copy would be computed anew for each element. It does neither with what
    isn't deterministic, such as this condition, which always holds."""
    return F.when(F.monotonically_increasing_id() >= 0, column)
