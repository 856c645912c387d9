"""How a call ended, from the error it raised."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------
CANCELLATION_TYPES = ("CancelledError", "KeyboardInterrupt")
WEB_ABORT_TYPE = "AbortError"
WEB_CANCELLED = "(?i)abort|cancel"
WEB_RATE_LIMITED = "(?i)rate.?limit|429"
# --- end of fixed values ----------------------------------------------------------


def classify(error_type: Column, error_message: Column, ruleset: str = "python") -> Column:
    """SUCCESS, CANCELLED, RATE_LIMITED or ERROR.

    ``ruleset="python"`` looks at the exception's name and for the code 429 in its
    message; ``ruleset="web"`` matches the message text.
    """
    name = F.coalesce(error_type, F.lit(""))
    message = F.coalesce(error_message, F.lit(""))
    succeeded = error_type.isNull() & error_message.isNull()
    if ruleset == "python":
        cancelled = name.isin(*CANCELLATION_TYPES)
        limited = F.lower(name).contains("ratelimit") | message.contains("429")
    elif ruleset == "web":
        cancelled = (name == WEB_ABORT_TYPE) | message.rlike(WEB_CANCELLED)
        limited = message.rlike(WEB_RATE_LIMITED)
    else:
        raise ValueError(f"unknown ruleset {ruleset!r}")
    return (
        F.when(succeeded, F.lit("SUCCESS"))
        .when(cancelled, F.lit("CANCELLED"))
        .when(limited, F.lit("RATE_LIMITED"))
        .otherwise(F.lit("ERROR"))
    )
