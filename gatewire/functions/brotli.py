"""Brotli codec for message payloads. Spark has no built-in expression for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def brotli_decompress(payload: Column) -> Column:
    """BINARY -> BINARY; NULL for NULL and for anything that is not one whole Brotli stream.

    The function is nested so that it travels to the executors by value, which
    spares a cluster from installing this package on every node.
    """

    @F.arrow_udf("binary")
    def decompress(payloads):
        import pyarrow as pa

        def one(value):
            if not value.is_valid or not len(value.as_buffer()):
                return None
            try:
                return pa.CompressedInputStream(pa.BufferReader(value.as_buffer()), "brotli").read()
            except OSError:
                return None

        return pa.array([one(value) for value in payloads], type=pa.binary())

    return decompress(payload)


def inflate(messages: DataFrame, payload: str, packed: str, most_bytes: int = 32 << 20) -> DataFrame:
    """Replace ``payload`` where the boolean ``packed`` holds by what ``brotli_decompress`` gives for it.

    A few bytes may inflate to megabytes, so a batch of payloads goes back in as
    many parts as it takes to keep each near ``most_bytes``; no payload is refused
    for its size.  Nested to travel by value, too.
    """
    schema = messages.schema
    names, place, mark = schema.names, schema.names.index(payload), schema.names.index(packed)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def one(value):
            if not value.is_valid or not len(value.as_buffer()):
                return None
            try:
                return pa.CompressedInputStream(pa.BufferReader(value.as_buffer()), "brotli").read()
            except OSError:
                return None

        for batch in batches:
            values, marks = batch.column(place), batch.column(mark).to_pylist()
            start, made, size = 0, [], 0
            for number, is_packed in enumerate(marks, 1):
                if is_packed:
                    made.append(one(values[number - 1]))
                    size += len(made[-1] or b"")
                if size >= most_bytes or number == batch.num_rows:
                    columns = batch.slice(start, number - start).columns
                    if made:
                        chosen = pa.array(marks[start:number], pa.bool_())
                        columns[place] = pc.replace_with_mask(columns[place], chosen, pa.array(made, columns[place].type))
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    start, made, size = number, [], 0

    return messages.mapInArrow(run, schema)


def brotli_compress(payload: Column, level: int = 4) -> Column:
    """BINARY -> BINARY, the producer's side; NULL stays NULL."""

    @F.arrow_udf("binary")
    def compress(payloads):
        import pyarrow as pa

        codec = pa.Codec("brotli", compression_level=level)
        return pa.array(
            [codec.compress(v.as_buffer(), asbytes=True) if v.is_valid else None for v in payloads],
            type=pa.binary(),
        )

    return compress(payload)
