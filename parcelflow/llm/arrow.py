"""Running a function over Arrow batches: texts in slices of bounded size, columns carried along."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts hold about ``most`` bytes; one row at least.

    The column holds texts, or structs whose last field is the text.
    """
    texts = batch.column(column)
    texts = texts if not pa.types.is_struct(texts.type) else texts.field(texts.type.num_fields - 1)
    lengths = [n or 0 for n in pc.binary_length(texts).to_pylist()]
    start = held = 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def with_arrow_columns(df: DataFrame, text: str, added: list[tuple[str, T.DataType]],
                       make: Callable[[], Callable[[list], list[pa.Array]]], keep: list[str] | None = None, most: int = SLICE_BYTES) -> DataFrame:
    """Adds columns computed from the text column, in one pass and without a shuffle.

    ``make`` is called once per task and returns the function from a list of texts to the new
    columns, one Arrow array for each of ``added``. ``keep`` names the columns carried along (all);
    ``most`` bounds the bytes of text that the function gets at once.
    """
    keep = list(df.columns) if keep is None else keep
    carried = df.select(*[f"`{c}`" for c in keep], df[text].alias(inner := free_name(df, "_text_in")))
    schema = T.StructType([*[f for f in carried.schema.fields if f.name != inner],
                           *[T.StructField(n, t, True) for n, t in added]])

    def run(batches):
        work = make()
        for batch in batches:
            for part in slices(batch, inner, most):
                columns = work(part.column(inner).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(len(keep))], *columns],
                    names=[*keep, *[n for n, _ in added]])

    return carried.mapInArrow(run, schema)
