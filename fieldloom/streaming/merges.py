"""Fields over streams. A template whose fields need but their own record runs as it stands; counters keep state by key.

Records may come late or twice: a counter counts in the order of arrival, so its numbers are those of the stream, not of a
table sorted afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from fieldloom.lang.instruction import parse
from fieldloom.plans.fields import Context, evaluate

#: Field types that need the records before or behind.
ORDERED = ("NEXT", "NEXTIF", "SKIPIF", "MERGEREC", "MERGESEQ")


def merge_stream(stream: DataFrame, template: Mapping[str, str], context: Context | None = None) -> DataFrame:
    """Each record with the texts of the template's fields. Fields that need an order of records are refused."""
    held = [i for i in template.values() if parse(i).type in ORDERED]
    if held:
        raise ValueError(f"a stream has no order of records for {held}")
    return evaluate(stream, template, context)


def sequence_stream(stream: DataFrame, keys: list[str], name: str = "seq") -> DataFrame:
    """Each record with the running number of its key, kept as state."""
    kind = StructType([*stream.schema]).add(name, "long")

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for pdf in batches:
            yield pdf.assign(**{name: range(n + 1, n + 1 + len(pdf))})
            n += len(pdf)
        state.update((n,))

    return stream.groupBy(*keys).applyInPandasWithState(count, kind, "n long", "append", GroupStateTimeout.NoTimeout)
