"""A bitmap of ids of fixed size, to leave out most rows that a join would drop anyway."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23  # 1 MB, whatever the number of ids


def _place() -> F.Column:
    return F.pmod(F.xxhash64("id"), F.lit(BITS))


def id_bits(ids: DataFrame) -> np.ndarray:
    """Bits of column ``id``; rows are hashed, so other ids may share a bit."""
    place = _place() + 1
    maps = ids.where("id is not null").groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in maps.collect():  # BITS / 32768 rows of 4 KB at most
        at = (r[0] - 1) * 4096
        out[at : at + len(r[1])] |= np.frombuffer(r[1], np.uint8)
    return out


def _test(batches: Iterator[pa.RecordBatch], bits: np.ndarray, work: Callable | None) -> Iterator[pa.RecordBatch]:
    def kept() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(batch.num_columns - 1).to_numpy()
            ok = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            part = batch.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays(part.columns[:-1], names=batch.schema.names[:-1])

    return work(kept()) if work else kept()


def with_bit(rows: DataFrame, bits: np.ndarray, work: Callable | None = None, schema: str | None = None) -> DataFrame:
    """Rows (id, ...) whose id's bit is set; an exact join must follow. Null ids go.

    ``work`` goes on with the batches in the same Python worker, and gives rows of ``schema``.
    """
    return rows.where("id is not null").withColumn("place", _place()).mapInArrow(partial(_test, bits=bits, work=work), schema or rows.schema)
