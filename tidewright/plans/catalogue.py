"""The named queries over the tables of a scale-factor folder, and their equivalents in ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.plans import audit_queries, report_queries, series_queries, source_queries, telemetry_queries
from tidewright.plans.audit_oracles import ORACLES as AUDIT_ORACLES
from tidewright.plans.report_oracles import ORACLES as REPORT_ORACLES
from tidewright.plans.series_oracles import ORACLES as SERIES_ORACLES
from tidewright.plans.source_oracles import ORACLES as SOURCE_ORACLES
from tidewright.plans.telemetry_oracles import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**telemetry_queries.QUERIES, **series_queries.QUERIES, **report_queries.QUERIES, **audit_queries.QUERIES, **source_queries.QUERIES}
ORACLES: dict[str, str] = {key: sql for key in telemetry_queries.QUERIES if (sql := oracle(key))} | SERIES_ORACLES | REPORT_ORACLES | AUDIT_ORACLES | SOURCE_ORACLES
