"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import slotcast

_shipped: set[str] = set()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers of executors, once per application.

    The archive is made on the driver and served by it; executors keep it as any added file.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        home = os.path.dirname(os.path.abspath(slotcast.__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="slotcast-code-"), "slotcast-code.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(home):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.join("slotcast", os.path.relpath(full, home)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``limit`` bytes of text, or one row."""
    for batch in batches:
        start, held = 0, 0
        column = batch.column(batch.schema.get_field_index(text))
        for i, n in enumerate(column_bytes(column)):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def column_bytes(column: pa.Array) -> list[int]:
    """UTF-8 bytes of every text; 0 for NULL."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches, cut again so that no run of equal keys spans two of the tables."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            v = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        if held:
            last, first = held[-1].slice(held[-1].num_rows - 1).to_pylist()[0], batch.slice(0, 1).to_pylist()[0]
            change[0] = any(last[k] != first[k] for k in keys)
        at = np.flatnonzero(change)
        if not len(at):
            held.append(batch)
            continue
        cut = int(at[-1])
        if cut:
            held.append(batch.slice(0, cut))
        if held:
            yield pa.Table.from_batches(held)
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def carried(docs: DataFrame, text: str, names: list[str] | None) -> tuple[DataFrame, str]:
    """The columns ``names`` of ``docs`` (by default all) with the text as ``_text`` after them, and the schema of the former.

    If the text is carried too, it goes to Python once: steps put ``_text`` back in its place.
    """
    fields = [docs.schema[n] for n in (names if names is not None else docs.columns)]
    kept = [F.col(f"`{f.name}`") for f in fields if f.name != text]
    return docs.select(*kept, F.col(f"`{text}`").alias("_text")), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)


def put_back(batch: pa.RecordBatch, text: str, names: list[str]) -> list[pa.Array]:
    """The columns ``names`` of a batch whose text is in ``_text``."""
    return [batch.column(batch.schema.get_field_index("_text" if n == text else n)) for n in names]


def positional(docs: DataFrame) -> DataFrame:
    """``docs`` with columns named by position, so that no name clashes with those a step adds or holds a dot."""
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])


def fresh(names: list[str], taken: list[str]) -> list[str]:
    """``names``, each with as many further underscores in front as it takes to differ from all that are taken."""
    seen = {t.lower() for t in taken}
    out = []
    for n in names:
        while n.lower() in seen:
            n = f"_{n}"
        seen.add(n.lower())
        out.append(n)
    return out
