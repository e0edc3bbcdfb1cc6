"""carelake: clinical encounter analytics on Spark DataFrames.

Sub-packages:
  functions  column expressions and the fixed value tables
  sources    table, file and fixture readers; sinks
  operators  clean, features, analytics, lookups, logs, images, models
  plans      multi-stage jobs (ETL report, training, cohort scoring)
  streaming  Structured Streaming versions of the arriving-data jobs
"""

from carelake.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
