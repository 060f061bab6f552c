"""SQL-workload governance as Spark jobs.

Statement logs, catalogue snapshots, plan rows and workflow tables come in as
DataFrames or streams; every operator is a function from DataFrames to a
DataFrame, so Catalyst sees one declarative plan from scan to result.
"""

__version__ = "0.1.0"
