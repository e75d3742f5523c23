"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import fleet, ingest, logs, metrics, rates, recon, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = metrics.QUERIES | rates.QUERIES | logs.QUERIES | fleet.QUERIES | recon.QUERIES | ingest.QUERIES | streams.QUERIES
ORACLES: dict[str, str] = metrics.ORACLES | rates.ORACLES | logs.ORACLES | fleet.ORACLES | recon.ORACLES | ingest.ORACLES | streams.ORACLES
