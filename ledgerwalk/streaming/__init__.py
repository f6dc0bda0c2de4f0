"""Incremental drivers.

The catalogue has no event streams; "incremental" means re-running a batch
job over rows not yet done.  ``walk_stream`` lets Structured Streaming pick
up published listing snapshots and applies each whole, in order and once, with
the ordinary batch job.
"""

from .incremental import apply_snapshot, publish_snapshot, walk_stream

__all__ = ["apply_snapshot", "publish_snapshot", "walk_stream"]
