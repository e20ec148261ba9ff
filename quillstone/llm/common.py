"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir, stored

__all__ = ["LOWER", "UPPER", "WORD", "ascii_lower", "give_back", "shared_dir", "stored", "table"]

#: The word rule of the contracts, as a Java and an RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(col, UPPER, LOWER)


def give_back(encoders: bool = True) -> None:
    """Returns memory that a task has freed to the system: Python workers live on, and executors count what they hold.

    Encoders that earlier tasks have left in the worker go too, unless the caller's next tasks need them.
    """
    if encoders:
        sys.__dict__.pop("_quillstone_encoders", None)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass
