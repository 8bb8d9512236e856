"""SimHash near-duplicates through covering locality-sensitive hashing."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.llm.cells import CELL, arranged, bounds, cut, deal, meetings
from slotcast.llm.common import carried, positional, put_back, runs, ship, slices
from slotcast.llm.components import components, local_roots
from slotcast.llm.membership import told_apart
from slotcast.operators.sizing import lookup_side, settle
from slotcast.session import materialise, release, scratch

BITS = 64
BLOCK = 1024
#: The wide fingerprint: 128 bits in two words, looked up in four parts of 32 bits. A Jaccard similarity of 0.8 makes 19 bits differ
#: in expectation; every pair up to 19 bits apart meets in some table (4 bits in each part, 124 tables).
WIDE = ("_first", "_second")
WIDE_PARTS = 4
WIDE_LIMIT = 19
WIDE_RADIUS = WIDE_LIMIT
#: Near copies share four fifths of their different shingles or more.
NEAR = (4, 5)
#: Min-hash bands that propose pairs beyond the limit of bits: a pair at a Jaccard similarity of 0.8 misses all with probability (1 - 0.8^5)^30 < 1e-5.
BANDS = 30
BAND_ROWS = 5
#: Min-hash bytes that tell before sets are compared whether a pair can be near.
SKETCH = 128
#: Bits within which every pair of fingerprints meets in a covering table before sets are compared: three in each of two parts of 64 bits.
#: Keys of 32 to 34 bits keep chance collisions few; those of shorter parts have about 20 and fill up from millions of rows on.
CLOSE = 7
CLOSE_PARTS = 2
_CHUNK = 1 << 16


def masks(radius: int, bits: int = BITS) -> list[int]:
    """Masks of ``bits`` bits that cover the radius: of any ``radius`` bits, some mask holds none.

    Bit i gets a nonzero vector of radius + 1 binary digits; mask v holds the bits whose vector has an odd
    product with v. The vectors of ``radius`` bits span less than the whole space, so some v is orthogonal to all.
    There are 2^(radius + 1) - 1 masks, each with about half of the bits.
    """
    if not 0 <= radius <= 8:
        raise ValueError("radius must be between 0 and 8: the masks double with each step")
    if radius == 0:
        return [(1 << bits) - 1]
    space = (1 << (radius + 1)) - 1
    vectors = [i % space + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, space + 1)]


def covering(radius: int, bits: tuple[str, ...], parts: int) -> list[tuple[str, int]]:
    """Columns and masks, one of which holds none of any ``radius`` bits of the columns ``bits``: of these some part has at most ``radius // parts``."""
    width = BITS * len(bits) // parts
    return [(bits[p * width // BITS], m << (p * width % BITS)) for p in range(parts) for m in masks(radius // parts, width)]


def _narrow(shingles: Iterator[bytes], seed: int) -> bytes:
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype="<u8").tobytes()


def _wide(shingles: Iterator[bytes], seed: int) -> bytes:
    return b"".join(map(xxhash.xxh3_128_digest, shingles, repeat(seed)))


def majority(text: bytes, words: int, seed: int, hashes: Callable[[Iterator[bytes], int], bytes], size: int) -> np.ndarray:
    """Majority bits over the hashes of all word shingles of a text, with repeats, as ``size`` words of 64 bits."""
    w = text.lower().split()
    if not w:
        return np.zeros(size, dtype=np.uint64)
    n = max(1, len(w) - words + 1)
    ones = np.zeros(BITS * size, dtype=np.int64)
    for start in range(0, n, _CHUNK):
        part = w[start : start + _CHUNK + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)))) if len(w) >= words else iter([b" ".join(w)])
        h = np.frombuffer(hashes(shingles, seed), dtype=np.uint8)
        ones += np.unpackbits(h.reshape(-1, 8 * size), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n, bitorder="little").view("<u8")


def fingerprint(text: bytes, words: int, seed: int) -> int:
    """The 64 majority bits over the XXH64 values of a text's shingles."""
    return int(majority(text, words, seed, _narrow, 1)[0])


def _fingerprinter(words: int, seed: int, text: str, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            texts = batch.column("_text").cast(pa.binary()).to_pylist()
            values = np.array([fingerprint(t or b"", words, seed) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*put_back(batch, text, names), pa.array(values)], [*names, "_fingerprint"])

    return step


def fingerprinted(docs: DataFrame, text_column: str = "text", carry: list[str] | None = None, words: int = 4, seed: int = 42) -> DataFrame:
    """The columns ``carry`` of every row and ``_fingerprint``: 64 bits, each set if it is set in over half of the XXH64 values
    of the text's word shingles. A-Z are lower-cased, words end at ASCII white space. A text of fewer words is one
    shingle; NULL or a text without words has fingerprint zero."""
    ship(docs.sparkSession)
    names = carry if carry is not None else docs.columns
    rows, schema = carried(docs, text_column, names)
    return rows.mapInArrow(_fingerprinter(words, seed, text_column, names), f"{schema}, _fingerprint long")


def _wide_fingerprinter(words: int, seed: int, text: str, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            texts = batch.column("_text").cast(pa.binary()).to_pylist()
            values = np.array([majority(t or b"", words, seed, _wide, len(WIDE)) for t in texts], dtype=np.uint64).reshape(-1, len(WIDE)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*put_back(batch, text, names), *(pa.array(np.ascontiguousarray(v)) for v in values.T)], [*names, *WIDE])

    return step


def wide_fingerprinted(docs: DataFrame, text_column: str = "text", words: int = 5, seed: int = 42) -> DataFrame:
    """``docs`` and a fingerprint of 128 bits in two columns, made as in :func:`fingerprinted` from 128-bit XXH3 values."""
    ship(docs.sparkSession)
    rows, schema = carried(docs, text_column, docs.columns)
    return rows.mapInArrow(_wide_fingerprinter(words, seed, text_column, docs.columns), f"{schema}, " + ", ".join(f"{c} long" for c in WIDE))


def _linker(limit: int, bits: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["table", "key", *CELL]):
            table, key, i, j, part, value = (rows.column(c).to_numpy() for c in ("table", "key", *CELL, "_part", "value"))
            words = [rows.column(c).to_numpy().view(np.uint64) for c in bits]
            at = bounds([table, key, i, j])
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in meetings(at, part, (i != j)[at[:-1]]):
                apart = np.bitwise_count(words[0][a] ^ words[0][b])
                for w in words[1:]:
                    apart = apart + np.bitwise_count(w[a] ^ w[b])
                near = apart <= limit
                left.append(a[near])
                right.append(b[near])
            root = local_roots(len(value), np.concatenate(left), np.concatenate(right))
            moved = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(value[moved]), pa.array(value[root[moved]])], ["a", "b"])

    return step


def links(distinct: DataFrame, radius: int, block: int = BLOCK, bits: tuple[str, ...] = ("value",), parts: int = 1, limit: int | None = None) -> DataFrame:
    """Edges ``(a, b)`` that connect the rows of ``distinct`` (column ``value``, no repeats) whose fingerprints, in the columns ``bits``,
    are at most ``limit`` bits apart and meet in some table. Every pair at most ``radius`` bits apart does; without a ``limit``,
    these are all.

    A fingerprint is cut into ``parts``; of ``radius`` bits some part has at most ``radius // parts``, so masks that cover
    so many in each part are enough. A bucket is worked off in cells; of each cell only a spanning forest leaves the task.
    """
    ship(distinct.sparkSession)
    width = BITS * len(bits) // parts
    signed = [(c, m - (1 << BITS) if m >> (BITS - 1) else m) for c, m in covering(radius, bits, parts)]
    # the masked value itself is the key, so a bucket holds no chance collisions
    tables = F.array(*[F.struct(F.lit(n).alias("table"), F.col(c).bitwiseAND(F.lit(m).cast("long")).alias("key")) for n, (c, m) in enumerate(signed)])
    columns = list(dict.fromkeys(["value", *bits]))
    keyed = distinct.select(*columns, F.explode(tables).alias("t")).select(*columns, "t.table", "t.key")
    dealt = deal(keyed, ["table", "key"], "value", block, rare=width == BITS)
    return dealt.select("table", "key", *CELL, "_part", *columns).mapInArrow(_linker(radius if limit is None else limit, bits), "a long, b long").distinct()


def rooted(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """``distinct`` (a written table with nodes as ``value``) and ``root``, one node for each component."""
    root = components(edges)
    return materialise(distinct.join(root, F.col("value") == F.col("node"), "left").withColumn("root", F.coalesce("root", "value")).drop("node"))


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 4, radius: int = 4, seed: int = 42, block: int = BLOCK
) -> DataFrame:
    """``(id, fingerprint, component)`` for every row: the smallest id among all rows whose fingerprints links of at most
    ``radius`` bits reach. Equal fingerprints are one node, so copies cost one row. Rows with a NULL id take
    part; a component of NULL ids only has NULL. Ids may repeat. An empty table gives an empty result.
    """
    marked = materialise(fingerprinted(docs, text_column, [id_column], words, seed).select(F.col(id_column).alias("id"), F.col("_fingerprint").alias("fingerprint")))
    distinct = materialise(marked.groupBy(F.col("fingerprint").alias("value")).agg(F.min("id").alias("least")))
    nodes = rooted(distinct, links(distinct, radius, block))
    lowest = materialise(nodes.groupBy("root").agg(F.min("least").alias("component")))
    named = nodes.join(lowest, "root").select("value", "component")
    return marked.join(named, F.col("fingerprint") == F.col("value")).select("id", "fingerprint", "component")


def shingle_digests(text: bytes, words: int, seed: int) -> np.ndarray:
    """128-bit XXH3 values of the different word shingles of a text as rows of two 64-bit words, sorted by the first, by which they are told apart."""
    w = text.lower().split()
    if not w:
        return np.zeros((0, len(WIDE)), dtype=np.uint64)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else iter([b" ".join(w)])
    h = np.frombuffer(_wide(shingles, seed), dtype="<u8").reshape(-1, len(WIDE))
    return h[np.unique(h[:, 0], return_index=True)[1]]


def sketch(digests: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Majority bits over the different shingles, a key for each min-hash band, and a byte of each of the first ``SKETCH`` min-hashes."""
    if not len(digests):
        return np.zeros(len(WIDE), dtype=np.uint64), np.zeros(BANDS, dtype=np.uint64), np.zeros(SKETCH, dtype=np.uint8)
    random = np.random.default_rng(seed)
    times, plus = (random.integers(0, 1 << 64, BANDS * BAND_ROWS, dtype=np.uint64, endpoint=False) | np.uint64(1) for _ in range(2))
    ones, least = np.zeros(BITS * len(WIDE), dtype=np.int64), np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for start in range(0, len(digests), 4096):
        part = np.ascontiguousarray(digests[start : start + 4096])
        ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        least = np.minimum(least, (part[:, 1, None] * times + plus).min(axis=0))
    bands = [xxhash.xxh3_64_intdigest(b.tobytes(), seed) for b in least.reshape(BANDS, BAND_ROWS)]
    return np.packbits(ones * 2 > len(digests), bitorder="little").view("<u8"), np.array(bands, dtype=np.uint64), (least[:SKETCH] >> np.uint64(16)).astype(np.uint8)


def _set_sketcher(words: int, seed: int, text: str, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found = [shingle_digests(t or b"", words, seed) for t in batch.column("_text").cast(pa.binary()).to_pylist()]
            made = [sketch(d, seed) for d in found]
            bits = np.array([b for b, _, _ in made], dtype=np.uint64).reshape(-1, len(WIDE)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *put_back(batch, text, names), *(pa.array(np.ascontiguousarray(v)) for v in bits.T), pa.array([xxhash.xxh3_128_digest(d.tobytes(), seed) for d in found], pa.binary()),
                    pa.array([len(d) for d in found], pa.int64()), pa.array([b.view(np.int64) for _, b, _ in made], pa.list_(pa.int64())), pa.array([m.tobytes() for _, _, m in made], pa.binary()),
                ],
                [*names, *WIDE, "_set", "_size", "_bands", "_sketch"],
            )

    return step


def set_sketched(docs: DataFrame, text_column: str = "text", words: int = 5, seed: int = 42) -> DataFrame:
    """``docs`` with what :func:`near_links` needs of each text's set of shingles: a fingerprint of 128 bits, a digest and the size of the set,
    min-hash bands and a sketch of min-hash bytes. A repeated shingle counts once."""
    ship(docs.sparkSession)
    rows, schema = carried(docs, text_column, docs.columns)
    added = "".join(f", {c} long" for c in WIDE) + ", _set binary, _size long, _bands array<long>, _sketch binary"
    return rows.mapInArrow(_set_sketcher(words, seed, text_column, docs.columns), schema + added)


def least_equal(near: tuple[int, int]) -> int:
    """Equal sketch bytes below which a pair is not proposed: four standard deviations under the mean at the limit (a near pair falls below with
    probability 4e-5)."""
    p = near[0] / near[1]
    p += (1 - p) / 256
    return math.floor(SKETCH * p - 4 * math.sqrt(SKETCH * p * (1 - p)))


def _alike(size: np.ndarray, sketches: np.ndarray, near: tuple[int, int]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Number of equal sketch bytes of row pairs that may be near, else -1: sizes must allow it, and enough bytes be equal."""
    least = least_equal(near)

    def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), -1, dtype=np.int16)
        fit = np.flatnonzero(near[1] * np.minimum(size[a], size[b]) >= near[0] * np.maximum(size[a], size[b]))
        for k in range(0, len(fit), _CHUNK):
            at = fit[k : k + _CHUNK]
            equal = (sketches[a[at]] == sketches[b[at]]).sum(axis=1, dtype=np.int16)
            out[at] = np.where(equal >= least, equal, -1)
        return out

    return score


def _sketches(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("_sketch").to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)


def _forester(near: tuple[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each row of a cell the row before it that is most alike, if any: never more pairs than rows."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["table", "key", *CELL]):
            table, key, i, j, part, value, size = (rows.column(c).to_numpy() for c in ("table", "key", *CELL, "_part", "value", "_size"))
            at, score = bounds([table, key, i, j]), _alike(size, _sketches(rows), near)
            best, parent = np.full(len(value), -1, dtype=np.int64), np.full(len(value), -1, dtype=np.int64)
            for a, b in meetings(at, part, (i != j)[at[:-1]]):
                equal = score(a, b).astype(np.int64)
                good = equal >= 0
                a, b = a[good], b[good]
                # most equal bytes first, then the smaller value, by which rows of a part are sorted
                rank = (equal[good] << 40) + (len(value) - a)
                np.maximum.at(best, b, rank)
                hit = best[b] == rank
                parent[b[hit]] = a[hit]
            child = np.flatnonzero(parent >= 0)
            a, b = value[child], value[parent[child]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    return step


def _opener(near: tuple[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows of each cell that have a proposed partner with another label, with the cell's table and key."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["table", "key", *CELL]):
            table, key, i, j, part, value, size, label = (rows.column(c).to_numpy() for c in ("table", "key", *CELL, "_part", "value", "_size", "label"))
            at, score = bounds([table, key, i, j]), _alike(size, _sketches(rows), near)
            wanted = np.zeros(len(value), dtype=bool)
            for a, b in meetings(at, part, (i != j)[at[:-1]]):
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
                good = score(a, b) >= 0
                wanted[a[good]] = wanted[b[good]] = True
            yield pa.RecordBatch.from_arrays([pa.array(c[wanted]) for c in (table, key, value)], ["table", "key", "value"])

    return step


def _is_near(x: np.ndarray, y: np.ndarray, near: tuple[int, int]) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return near[1] * both >= near[0] * (len(x) + len(y) - both)


def _shingles(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=np.uint64)


def _closer(near: tuple[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Near pairs of each cell that connect what all its near pairs connect. Sets are compared here, so that only found links leave the task.

    A pair whose rows meet in an earlier table is left to that table's cell.
    """
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["table", "key", *CELL]):
            table, key, i, j, part, value, size, label = (rows.column(c).to_numpy() for c in ("table", "key", *CELL, "_part", "value", "_size", "label"))
            at, score = bounds([table, key, i, j]), _alike(size, _sketches(rows), near)
            keys = rows.column("_keys").combine_chunks().flatten().to_numpy().reshape(len(value), -1)
            blobs = rows.column("_shingles")
            root = dict(zip(label.tolist(), label.tolist()))

            def top(k: int) -> int:
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            found: list[tuple[int, int]] = []
            for a, b in meetings(at, part, (i != j)[at[:-1]]):
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
                good = score(a, b) >= 0
                a, b = a[good], b[good]
                for k in range(0, len(a), _CHUNK):
                    x, y = a[k : k + _CHUNK], b[k : k + _CHUNK]
                    first = (keys[x] == keys[y]).argmax(axis=1) == table[x]
                    for m, n in zip(x[first].tolist(), y[first].tolist()):
                        p, q = top(int(label[m])), top(int(label[n]))
                        if p != q and _is_near(_shingles(blobs[m].as_py()), _shingles(blobs[n].as_py()), near):
                            root[p] = q
                            found.append((int(value[m]), int(value[n])))
            yield pa.RecordBatch.from_arrays([pa.array([max(f) for f in found], pa.int64()), pa.array([min(f) for f in found], pa.int64())], ["a", "b"])

    return step


def _verifier(near: tuple[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Near pairs of rows sorted by (a, _salt, b), where the set of a comes first, with a NULL b."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            found = []
            for a, b, blob in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("_shingles")):
                if b is None:
                    head = _shingles(blob.as_py())
                elif _is_near(head, _shingles(blob.as_py()), near):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return step


def verified(pairs: DataFrame, sets: DataFrame, near: tuple[int, int]) -> DataFrame:
    """The pairs whose sets (``value``, ``_shingles``) have a Jaccard similarity of ``near[0] / near[1]`` or more, in whole numbers. The set of
    ``a`` goes once to each 64 or so of its pairs, however many there are."""
    hubs, n = settle(pairs.groupBy(F.col("a").alias("_hub")).agg(F.count("*").alias("_n")).where("_n > 64"))
    spread = pairs.join(lookup_side(hubs, n), F.col("a") == F.col("_hub"), "left")
    salted = spread.select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce(F.ceil(F.col("_n") / 64), F.lit(1))).cast("int").alias("_salt"))
    tails = salted.join(sets.withColumnRenamed("value", "b"), "b").select("a", "_salt", "b", "_shingles")
    heads = salted.select("a", "_salt").distinct().join(sets.withColumnRenamed("value", "a"), "a").select("a", "_salt", F.lit(None).cast("long").alias("b"), "_shingles")
    dealt = heads.union(tails).repartition("a", "_salt").sortWithinPartitions("a", "_salt", F.col("b").asc_nulls_first())
    found = materialise(dealt.mapInArrow(_verifier(near), "a long, b long"))
    release(hubs)
    return found


def _set_reader(words: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            sets = [np.ascontiguousarray(shingle_digests(t, words, seed)[:, 0]).tobytes() for t in batch.column("_text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("value"), pa.array(sets, pa.binary())], ["value", "_shingles"])

    return step


def shingle_sets(wanted: DataFrame, texts: DataFrame, words: int, seed: int) -> DataFrame:
    """``(value, _shingles)``: the sorted shingle hashes of the texts of the wanted values, written."""
    few, n = settle(wanted.distinct())
    made = materialise(texts.join(lookup_side(few, n), "value").select("value", "_text").mapInArrow(_set_reader(words, seed), "value long, _shingles binary"))
    release(few)
    return made


def near_links(distinct: DataFrame, texts: DataFrame, radius: int, near: tuple[int, int], words: int, seed: int, block: int = BLOCK) -> DataFrame:
    """Edges ``(a, b)`` between near sets that connect what all proposed near pairs connect, each verified on the sets in whole numbers.

    Proposed are pairs that meet in a covering table of fingerprints, as all within ``radius`` bits do, or in a min-hash band, if their sizes
    and sketches allow the similarity. First each row of a cell is verified against the one before it that is most alike, which joins most of a
    group. Then the rows that still have a proposed partner in another group are sent with their sets to the cells where they meet it, and compared
    there. So no step makes more rows than there are rows in cells, whatever the size of a group; only comparisons inside cells grow with the square of groups
    that are proposed but not near.
    """
    ship(distinct.sparkSession)
    signed = [(c, m - (1 << BITS) if m >> (BITS - 1) else m) for c, m in covering(radius, WIDE, CLOSE_PARTS)]
    keys = F.concat(F.array(*[F.col(c).bitwiseAND(F.lit(m).cast("long")) for c, m in signed]), F.col("_bands"))
    keyed = distinct.where("_size > 0").select("value", F.posexplode(keys).alias("table", "key"))
    order = ["table", "key", *CELL]

    cells = materialise(cut(keyed, ["table", "key"], "value", block))
    sketches = distinct.select("value", "_size", "_sketch")
    forest = arranged(cells.join(sketches, "value"), ["table", "key"], ["value"]).select(*order, "_part", "value", "_size", "_sketch").mapInArrow(_forester(near), "a long, b long")
    pairs = materialise(forest.distinct())
    sets = shingle_sets(pairs.select(F.col("a").alias("value")).union(pairs.select("b")), texts, words, seed)
    edges = verified(pairs, sets, near)
    release(pairs, sets)

    labelled = rooted(distinct.select("value", "_size", "_sketch"), edges).withColumnRenamed("root", "label")
    open_rows = arranged(cells.join(labelled, "value"), ["table", "key"]).select(*order, "_part", "value", "_size", "_sketch", "label").mapInArrow(
        _opener(near), "table int, key long, value long"
    )
    left = materialise(open_rows.distinct())
    release(cells)
    sets = shingle_sets(left.select("value"), texts, words, seed)
    # the open rows of a cell, cut anew: sets take more room than sketches
    again = cut(left, ["table", "key"], "value", max(1, block // 4))
    whole = distinct.select("value", keys.alias("_keys")).join(sets, "value")
    dealt = arranged(again.join(labelled, "value").join(whole, "value"), ["table", "key"])
    more = materialise(dealt.select(*order, "_part", "value", "_size", "_sketch", "label", "_keys", "_shingles").mapInArrow(_closer(near), "a long, b long"))
    release(left, sets)
    return edges.union(more)


def without_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, radius: int = WIDE_RADIUS, limit: int = WIDE_LIMIT, seed: int = 42, block: int = BLOCK,
    near: tuple[int, int] | None = None,
) -> DataFrame:
    """``docs`` with all columns, one row of each component: that of the smallest id, the first read of equal ones. NULL ids
    stand behind all others. Texts without a word are one component. Rows are numbered in a written table, so
    repeated ids are told apart.

    Fingerprints have 128 bits here, because 64 leave too wide a spread at a Jaccard similarity of 0.8. They are linked at no more than
    ``limit`` differing bits if they meet in a table, which all pairs up to ``radius`` bits do; by default that is the limit.

    With ``near``, two numbers, the similarity of the texts decides instead: rows are linked if their sets of shingles have a Jaccard similarity
    of ``near[0] / near[1]`` or more. See :func:`near_links`. Columns may have any names.
    """
    names = docs.columns
    inner = positional(docs)
    place = dict(zip(names, inner.columns))
    id_column, text_column = place[id_column], place[text_column]
    sketched = wide_fingerprinted(inner, text_column, words, seed) if near is None else set_sketched(inner, text_column, words, seed)
    marked = materialise(sketched.withColumn("_row", F.monotonically_increasing_id()))
    with scratch() as made:
        first = F.min(F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), "_row", *([] if near is None else [*WIDE, "_bands", "_sketch"])))
        if near is None:
            distinct = materialise(marked.groupBy(*WIDE).agg(first.alias("first")).withColumn("value", F.monotonically_increasing_id()))
            edges = links(distinct, radius, block, WIDE, WIDE_PARTS, limit)
        else:
            # rows of one set of shingles are one node, whose text is that of the first row
            one = marked.groupBy("_set", "_size").agg(first.alias("first"))
            distinct = materialise(one.select("first", F.col("first._row").alias("value"), *[F.col(f"first.{c}").alias(c) for c in (*WIDE, "_bands", "_sketch")], "_size"))
            texts = marked.select(F.col("_row").alias("value"), F.col(text_column).alias("_text"))
            edges = near_links(distinct, texts, CLOSE, near, words, seed, block)
        nodes = rooted(distinct.select("value", F.struct("first.none", "first.id", "first._row").alias("first")), edges)
        kept = nodes.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first._row").alias("_row"))
    # only the numbers of rows that stay, or of those that go, whichever are fewer, are needed from here on
    stay = materialise(kept)
    release(*made)
    if 2 * stay.count() <= marked.count():
        few, how = stay, "left_semi"
    else:
        few, how = materialise(marked.select("_row").join(stay, "_row", "left_anti")), "left_anti"
        release(stay)
    listed, others = told_apart(marked, F.col("_row"), few.select("_row"))
    rows = listed.join(few, "_row", how).select(*inner.columns)
    return (rows if how == "left_semi" else rows.union(others.select(*inner.columns))).toDF(*names)
