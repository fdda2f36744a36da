"""Keeping Python workers small: they are reused from task to task, and so is what they hold."""

from __future__ import annotations

import ctypes

from pyspark.sql import SparkSession

_libc = None


def tidy() -> None:
    """Give freed memory back to the system; large arrays are mapped, so they never stay in the heap."""
    global _libc
    if _libc is None:
        try:
            _libc = ctypes.CDLL("libc.so.6")
            _libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD, fixed instead of growing
            _libc.mallopt(-1, 8 << 20)  # M_TRIM_THRESHOLD
        except (OSError, AttributeError):  # another C library
            _libc = False
    if _libc:
        _libc.malloc_trim(0)


#: Rows that Spark sends to Python at once; its default of 10,000 documents can be hundreds of megabytes.
ARROW_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch to ARROW_ROWS unless the session asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
