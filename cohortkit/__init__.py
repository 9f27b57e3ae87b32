"""cohortkit: Spark-native cohort, windowing, time-binning and feature operators.

Every operator is a plain function ``DataFrame -> DataFrame`` (or a Column
builder) so it composes with ``df.transform``.  Column names are parameters;
the defaults follow the clinical long model ``(PID, TIMESTAMP, FEATURE, VALUE)``.
"""

__all__ = ["session", "config"]
