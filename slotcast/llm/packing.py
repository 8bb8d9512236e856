"""Best-fit packing into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from slotcast.llm.common import ship
from slotcast.session import materialise

CAPACITIES = (2048, 4096, 8192)
#: What a sequence costs beyond its tokens, in tokens.
OVERHEAD = 64
GROUP_ITEMS = 20_000


def best_fit(sizes: np.ndarray, capacities: tuple[int, ...], prices: tuple[float, ...], favour: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, largest sizes first, each into the open bin it fills best.

    If none has room, the bin opened has the least price for the tokens it can still get, of the permitted
    capacities up to ``favour`` (or the next one that holds the size).
    """
    order = np.argsort(-sizes, kind="stable")
    ahead = int(sizes.sum())
    spaces: list[int] = []
    open_: dict[int, list[int]] = {}
    bins, offsets, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    room: list[int] = []
    for k in order:
        size = int(sizes[k])
        at = bisect_left(spaces, size)
        if at < len(spaces):
            space = spaces[at]
            stack = open_[space]
            b = stack.pop()
            if not stack:
                del open_[space]
                del spaces[at]
        else:
            able = [c for c in capacities if c >= size]
            able = [c for c in able if c <= favour] or able[:1]
            space = min(able, key=lambda c: (prices[capacities.index(c)] / min(c, max(ahead, 1)), c))
            b = len(fill)
            fill.append(0)
            room.append(space)
        bins[k], offsets[k] = b, fill[b]
        fill[b] += size
        ahead -= size
        left = space - size
        if left:
            if left not in open_:
                open_[left] = []
                insort(spaces, left)
            open_[left].append(b)
    return bins, offsets


def packed(sizes: np.ndarray, capacities: tuple[int, ...], prices: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and final capacity of each size.

    Packings that favour each of the capacities are compared after every bin is downsized to the smallest
    capacity that holds its contents; the one of least price wins, the one with the smaller capacity on ties.
    """
    best = None
    for favour in capacities:
        bins, offsets = best_fit(sizes, capacities, prices, favour)
        fill = np.bincount(bins, weights=sizes).astype(np.int64)
        small = np.searchsorted(capacities, fill)
        price = float(np.asarray(prices)[small].sum())
        if best is None or price < best[0]:
            best = (price, bins, offsets, np.asarray(capacities)[small][bins])
    return best[1:]


def _group(capacities: tuple[int, ...], prices: tuple[float, ...]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_item", kind="stable")
        bins, offsets, capacity = packed(rows["n_tokens"].to_numpy(), capacities, prices)
        rows["bin"] = rows["_group"].to_numpy() * (1 << 32) + bins
        rows["position"] = pd.Series(offsets, index=rows.index).groupby(bins).rank(method="first").astype("int32") - 1
        rows["offset"], rows["capacity"] = offsets.astype(np.int32), capacity.astype(np.int32)
        return rows.drop(columns=["_item", "_group"])

    return pack


def pack(
    docs: DataFrame, size: Column, id_column: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES, prices: tuple[float, ...] | None = None, group_items: int = GROUP_ITEMS
) -> DataFrame:
    """Pack every row of ``docs``, ``size`` tokens long, into bins of the permitted capacities.

    Returns ``(id, piece, start, n_tokens, bin, position, offset, capacity)``. A row longer than the largest capacity is cut into
    pieces that fill bins of it, and a rest. NULL or smaller than one counts as one token, so each row is in a bin. Ids may be NULL
    or repeat. ``prices`` are those of one bin of each capacity, by default its tokens and a constant.

    Pieces are dealt by a hash of their number in a written table into groups of about ``group_items``, so that neither an
    id nor a length can make a group large; each group is packed on its own and leaves a few bins half full, which are downsized.
    """
    capacities = tuple(sorted(capacities))
    prices = prices or tuple(c + OVERHEAD for c in capacities)
    if not capacities or capacities[0] < 1 or len(prices) != len(capacities) or min(prices) <= 0:
        raise ValueError("capacities must be positive, with one positive price each")
    ship(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    most = capacities[-1]
    long = docs.select(F.col(f"`{id_column}`").alias("id"), F.greatest(F.coalesce(size.cast("long"), F.lit(1)), F.lit(1)).alias("_size"))
    pieces = long.select("id", "_size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_size") - 1) / most))).alias("_piece")).select(
        "id", F.col("_piece").cast("int").alias("piece"), (F.col("_piece") * most).alias("start"), F.least(F.lit(most).cast("long"), F.col("_size") - F.col("_piece") * most).cast("int").alias("n_tokens"),
        F.monotonically_increasing_id().alias("_item"),
    )
    items = materialise(pieces)  # numbers stay as they are from here on
    groups = max(1, -(-items.count() // group_items))
    dealt = items.withColumn("_group", F.pmod(F.xxhash64("_item"), F.lit(groups)))
    schema = f"id {kind}, piece int, start long, n_tokens int, bin long, position int, offset int, capacity int"
    return dealt.groupBy("_group").applyInPandas(_group(capacities, prices), schema)


#: Marks the end of a text among byte tokens.
END = 256
_SOURCES = "array<struct<position: int, id: {0}, piece: int, start: bigint, n_tokens: int, offset: int>>"


def _joiner(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sequences from their pieces, in the order of position."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for parts in batch.column("parts"):
                made = []
                for part in parts:
                    if whole:
                        made.append(part["tokens"].values.to_numpy())
                    else:
                        raw = np.frombuffer(part["tokens"].as_py(), dtype=np.uint8).astype(np.int32)
                        made.append(raw if len(raw) == part["n_tokens"].as_py() else np.append(raw, np.int32(END)))
                ids.append(np.concatenate(made))
            yield pa.RecordBatch.from_arrays(
                [batch.column("bin"), batch.column("capacity"), pa.array([len(i) for i in ids], pa.int32()), pa.array(ids, pa.list_(pa.int32())), batch.column("sources")],
                ["bin", "capacity", "n_tokens", "ids", "sources"],
            )

    return step


def sequences(
    docs: DataFrame, tokens: Column, id_column: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES, prices: tuple[float, ...] | None = None, group_items: int = GROUP_ITEMS
) -> DataFrame:
    """Packed token sequences, one row each: ``(bin, capacity, n_tokens, ids, sources)``.

    ``tokens`` is a text, whose tokens are its UTF-8 bytes and the mark ``END``, or an array of token ids, taken as it is. ``ids`` holds the tokens of the
    bin's pieces one after the other, ``sources`` says which piece of which row lies where, in order. Every token of every row is in one sequence. A NULL or empty text has the mark
    only; a NULL or empty array is in no sequence. Ids may be NULL or repeat; other columns are not read; an empty table gives no sequences.

    Rows are numbered in a written table, placed by :func:`pack`, cut, and brought together by bin, which bounds what a group holds.
    """
    ship(docs.sparkSession)
    picked = docs.select(F.col(f"`{id_column}`").alias("id"), tokens.alias("tokens"))
    kind = picked.schema["id"].dataType.simpleString()
    whole = isinstance(picked.schema["tokens"].dataType, ArrayType)
    if whole:
        picked = picked.where(F.size("tokens") > 0).select("id", F.col("tokens").cast("array<int>").alias("tokens"))
        size, cut = F.size("tokens"), F.expr("slice(tokens, int(start + 1), n_tokens)")
    else:
        picked = picked.select("id", F.coalesce(F.col("tokens").cast("binary"), F.lit(b"")).alias("tokens"))
        size, cut = F.octet_length("tokens") + 1, F.expr("substring(tokens, int(start + 1), n_tokens)")
    rows = materialise(picked.withColumn("row", F.monotonically_increasing_id()))
    placed = materialise(pack(rows, size, "row", capacities, prices, group_items))
    pieces = rows.join(placed.withColumnRenamed("id", "row"), "row").withColumn("tokens", cut)
    source = F.struct("position", "id", "piece", "start", "n_tokens", "offset")
    held = pieces.groupBy("bin", "capacity").agg(F.array_sort(F.collect_list(F.struct("position", "n_tokens", "tokens"))).alias("parts"), F.array_sort(F.collect_list(source)).alias("sources"))
    sources = _SOURCES.format(kind)
    return held.mapInArrow(_joiner(whole), f"bin bigint, capacity int, n_tokens int, ids array<int>, sources {sources}")
