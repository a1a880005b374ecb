"""Stated query sets as files: blocks of rows in the shared folder, which tasks read one after the other."""

from __future__ import annotations

import uuid

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.functions.session import fresh_path, ship

_held: dict[str, pd.DataFrame] = {}


def write(rows: DataFrame, most: int, n: int | None = None) -> list[str]:
    """Write ``rows`` as files of at most ``most`` rows; their names, sorted. Only names go to the driver.

    Rows are counted where ``n``, how many there are at most, is not given.
    """
    ship(rows.sparkSession)
    folder = fresh_path(rows.sparkSession, "blocks")
    folder = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"

    def run(batches):
        fs, path = pafs.FileSystem.from_uri(folder)

        def flush(block: pa.Table) -> pa.RecordBatch:
            # A name of its own for each attempt of a task; only those of the attempt that counts are told.
            name = f"block-{uuid.uuid4().hex}.arrow"
            fs.create_dir(path, recursive=True)
            with fs.open_output_stream(f"{path}/{name}") as out, pa.ipc.new_file(out, block.schema) as writer:
                writer.write_table(block)
            return pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

        held: pa.Table | None = None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            while held.num_rows >= most:
                yield flush(held.slice(0, most))
                held = held.slice(most)
        if held is not None and held.num_rows:
            yield flush(held)

    n = rows.count() if n is None else n
    # By a shuffle, even to one file: what makes the rows stays in tasks of its own.
    dealt = rows.repartition(max(1, -(-n // most)))
    return sorted(f"{folder}/{r.name}" for r in dealt.mapInArrow(run, "name string").select(F.col("name")).collect())


def read(file: str) -> pd.DataFrame:
    """One block; this worker keeps the last one it read."""
    if file not in _held:
        _held.clear()
        fs, path = pafs.FileSystem.from_uri(file)
        with fs.open_input_file(path) as f:
            _held[file] = pa.ipc.open_file(f).read_all().to_pandas()
    return _held[file]
