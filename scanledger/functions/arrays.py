"""The arrays of tables a job refers to, given by column name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCES = "array<struct<project_id:string,dataset_id:string,table_id:string,ref_count:bigint>>"


def or_empty(values: Column, element_type: str) -> Column:
    return F.coalesce(values, F.array().cast(f"array<{element_type}>"))


def _refs(name: str) -> str:
    return f"coalesce({name}, CAST(array() AS {REFERENCES}))"


def distinct_datasets(refs: str) -> Column:
    """Distinct project.dataset names; elements lacking either part are skipped."""
    return F.expr(
        f"""array_distinct(transform(
              filter({_refs(refs)}, r -> r.project_id IS NOT NULL AND r.dataset_id IS NOT NULL),
              r -> concat(r.project_id, '.', r.dataset_id)))"""
    )


def full_tables(refs: str) -> Column:
    """Elements with project, dataset and table all present, repeats kept."""
    return F.expr(
        f"""filter({_refs(refs)}, r ->
              r.project_id IS NOT NULL AND r.dataset_id IS NOT NULL AND r.table_id IS NOT NULL)"""
    )


def reference_total(refs: str) -> Column:
    """How many references the elements stand for."""
    return F.expr(f"aggregate({_refs(refs)}, 0L, (n, r) -> n + r.ref_count)")


def writes_own_source(destination: str, refs: str) -> Column:
    """True when a job's destination is among the tables it reads.

    Dataset and table are compared, the project is not.
    """
    return F.expr(
        f"""coalesce(exists({_refs(refs)}, r ->
              r.table_id = {destination}.table_id AND r.dataset_id = {destination}.dataset_id), false)"""
    )
