"""Queries over the driver tables, one for each operator of the inventory, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.plans import code, content, sample, structure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _part in (structure, content, code, sample):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
