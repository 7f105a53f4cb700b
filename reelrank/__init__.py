"""reelrank: personal rating analytics expressed as Spark DataFrame jobs.

People are rows (``user_id``), titles are rows (``title_id``); every operator
takes DataFrames and returns a DataFrame, never collects, and never starts a
session of its own (see :mod:`reelrank.session`).
"""

__all__ = ["session"]
