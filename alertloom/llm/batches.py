"""Arrow batches of bounded size for tables with texts, and column names of their own for helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import DecimalType, IntegralType

#: rows in an Arrow batch: the limit counts rows, and a text may be long
BATCH_ROWS = 1000
_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded(docs: DataFrame) -> DataFrame:
    """``docs``, with the session's Arrow batches limited to BATCH_ROWS rows where they are larger."""
    conf = docs.sparkSession.conf
    now = int(conf.get(_KEY))
    if now <= 0 or now > BATCH_ROWS:
        conf.set(_KEY, BATCH_ROWS)
    return docs


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores behind as keep it apart from ``columns`` in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def integer_ids(docs: DataFrame, doc_id: str) -> DataFrame:
    """``docs``, or an error where the ids are no integers: an order by value and arrays of ids need them."""
    kind = docs.schema[doc_id].dataType
    if not (isinstance(kind, IntegralType) or isinstance(kind, DecimalType) and kind.scale == 0):
        raise ValueError(f"{doc_id} must hold integers, not {kind.simpleString()}; number the rows first")
    return docs
