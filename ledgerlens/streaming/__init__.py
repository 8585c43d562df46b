"""Incremental (Structured Streaming) forms of the period aggregates.

The reference has no streaming; this package only runs the same K3 period
sums incrementally over files landing in a folder, for tables that grow
continuously.  Late rows inside the watermark update their period.
"""

from ledgerlens.streaming.periods import revenue_by_period_stream, run_once  # noqa: F401
