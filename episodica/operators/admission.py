"""When requests go out under a shared limit: each decision depends on those before it."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

#: Requests that may go out in a window, in microseconds, and the window.
LIMIT, WINDOW = 18, 1_000_000


def admit(requests: DataFrame, key: str, at: str, tie: str, wait: str, limit: int = LIMIT, window: int = WINDOW) -> DataFrame:
    """Adds admitted and waited (microseconds, long). requests: key, at (microseconds, long), tie (order of equal times), wait (long or null).

    In order of `at`, each request of a key goes out as soon as the one before it has gone, fewer than `limit` have gone out in the window up to then (its
    first instant included) and no cooldown runs. A request with a wait was refused by the server: from its going out, nothing goes out
    for that long; a cooldown only ever grows.

    One exchange and sort by key; a task reads its rows in order and holds `limit` times of one key, so that a key's size bounds no memory,
    though its rows follow one another in one task, as each decision needs the last. A null key is a key; rows without a time have
    neither result and count for nothing.
    """
    names = requests.columns
    schema = StructType([*requests.schema.fields, StructField("admitted", LongType()), StructField("waited", LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, gone, free, cool = object(), deque(maxlen=limit), 0, 0
        for b in batches:
            out = []
            for k, t, w in zip(b.column(key).to_pylist(), b.column(at).to_pylist(), b.column(wait).to_pylist(), strict=True):
                if k != of:
                    of, gone, free, cool = k, deque(maxlen=limit), None, None
                if t is None:
                    out.append(None)
                    continue
                now = max(x for x in (t, free, cool, gone[0] + window + 1 if len(gone) == limit else None) if x is not None)
                gone.append(now)
                free, cool = now, max(cool or now, now + w) if w else cool
                out.append(now)
            a = pa.array(out, pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, a, pa.array([None if x is None else x - t for x, t in zip(out, b.column(at).to_pylist(), strict=True)], pa.int64())], schema.names)

    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return requests.repartition(n, key).sortWithinPartitions(key, at, tie).select(*names).mapInArrow(work, schema)
