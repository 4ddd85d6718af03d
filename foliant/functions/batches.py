"""How much of its texts a Python worker holds at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch; rows vary too much in length for a number of rows to bound memory.
BATCH_BYTES = 4 << 20
_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """Cut the session's Arrow batches to BATCH_BYTES; a lower setting stays."""
    held = str(spark.conf.get(_CONF, "64m")).rstrip("b")
    if not held.isdigit() or int(held) > BATCH_BYTES:
        spark.conf.set(_CONF, str(BATCH_BYTES))


def pieces(texts: list, limit: int = BATCH_BYTES):
    """Ranges [a, b) of a list of texts of at most `limit` characters together, or one longer text."""
    a = total = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if total and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(texts):
        yield a, len(texts)
