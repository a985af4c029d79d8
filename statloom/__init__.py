"""statloom: database-telemetry analytics as PySpark DataFrame operators.

Every operator takes exported telemetry tables of a fleet of database servers as DataFrames and returns a
DataFrame. Nothing here connects to a database server, collects a fact table or runs row-at-a-time Python.
"""

__version__ = "0.1.0"
