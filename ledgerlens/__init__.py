"""ledgerlens — business-analytics operators on Spark DataFrames.

Every operator takes a DataFrame plus a *role mapping* (``{"revenue": "amount",
"date": "order_date", ...}``) and returns a lazy DataFrame assembled from
built-in Spark SQL expressions, windows and aggregates.  Nothing is collected
unless the *shape* of the output depends on the data (e.g. pivot headers) or a
tiny, bounded summary (a 6x6 moment matrix, a handful of quantiles) has to be
solved on the driver.
"""

from ledgerlens.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
__version__ = "0.1.0"
