"""Row shapes of the tables that are stored or parsed."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()
_STRINGS = T.ArrayType(_S)

# The six text columns of a fact, preceded by its place in the documents.
FACTS = _struct(
    doc_id=_L, table_id=_I, row_id=_I, col_id=_I,
    company=_S, heading=_S, item_code=_S, item_name=_S, value=_S, source=_S,
)

FOLLOWUP = _struct(agent=_S, table=_S, keywords=_STRINGS, reason=_S)
DECISION = _struct(
    status=_S, answer=_S, followups=T.ArrayType(FOLLOWUP), missing=_STRINGS
)
