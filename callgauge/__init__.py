"""Analytics over model-call telemetry, written as plain Spark DataFrame operators.

Every public function takes DataFrames (or Columns) plus explicit parameters and
returns a DataFrame (or Column). Nothing reads a clock, draws a random id or keeps
a session around: the instant a report is computed for is always the ``as_of``
argument. Instants are ``TIMESTAMP_NTZ`` values that hold UTC wall-clock time, so
results do not depend on the session time zone of whoever runs them.
"""
