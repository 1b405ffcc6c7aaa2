"""scanledger: who spends what in a data warehouse, computed on Spark.

The input is a job log with one row per executed query.  Everything here is a
function from DataFrames to DataFrames built on Spark's own expressions, so
Catalyst sees the whole plan; nothing is collected and no Python runs per row.

Packages
    sources     job logs, project settings, stored snapshots
    functions   column expressions: cost, identity, text, display
    operators   filters, cost allocation, roll-ups, top-k
    plans       the user-day mart, summaries, reports and monitoring runs
    sinks       partitioned tables, snapshots, retention
    streaming   threshold alerts
"""

from scanledger.params import Params

__all__ = ["Params"]
