import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotcast.llm.packing import CAPACITIES, END, GROUP_ITEMS, OVERHEAD, best_fit, pack, packed, sequences


def plain_best_fit(sizes, capacities, prices, favour):
    bins, ahead, step = [], sum(sizes), 0
    for s in sorted(sizes, reverse=True):
        able = [b for b in bins if b[0] - sum(b[1]) >= s]
        if able:
            b = min(able, key=lambda b: (b[0] - sum(b[1]), -b[2]))  # of equals the one changed last
        else:
            sizes_ = [c for c in capacities if c >= s]
            sizes_ = [c for c in sizes_ if c <= favour] or sizes_[:1]
            b = [min(sizes_, key=lambda c: (prices[capacities.index(c)] / min(c, ahead), c)), [], 0]
            bins.append(b)
        b[1].append(s)
        step += 1
        b[2] = step
        ahead -= s
    return sorted(sum(b[1]) for b in bins)


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_equals_a_plain_search(seed):
    source = random.Random(seed)
    sizes = [source.randrange(1, 65) for _ in range(200)]
    capacities, prices = (16, 32, 64), (18.0, 34.0, 60.0)
    costs = []
    for favour in capacities:
        bins, offsets = best_fit(np.array(sizes), capacities, prices, favour)
        fill = np.bincount(bins, weights=sizes)
        assert sorted(fill) == plain_best_fit(sizes, capacities, prices, favour)
        costs.append(sum(prices[np.searchsorted(capacities, f)] for f in fill))
    bins, offsets, capacity = packed(np.array(sizes), capacities, prices)
    fill = np.bincount(bins, weights=sizes)
    final = {b: c for b, c in zip(bins, capacity)}
    assert all(final[b] == min(c for c in capacities if c >= f) for b, f in enumerate(fill))
    assert sum(prices[capacities.index(c)] for c in final.values()) == min(costs)


def test_rows_lie_side_by_side(spark):
    source = random.Random(9)
    rows = [(i, source.choice([None, 0, 1, 5, 17, 64, 65, 200, 1000])) for i in range(300)] + [(None, 7)] + [(5, 64)] * 200
    out = pack(spark.createDataFrame(rows, "doc_id long, bin int"), F.col("bin"), capacities=(64, 16, 32), group_items=100).collect()
    want = {}
    for i, n in rows:
        want[i] = want.get(i, 0) + max(1, n or 1)
    got, bins = {}, {}
    for r in out:
        got[r.id] = got.get(r.id, 0) + r.n_tokens
        bins.setdefault(r.bin, []).append(r)
    assert got == want
    for held in bins.values():
        held.sort(key=lambda r: r.position)
        at = 0
        for k, r in enumerate(held):
            assert r.position == k and r.offset == at
            at += r.n_tokens
        assert {r.capacity for r in held} == {min(c for c in (16, 32, 64) if c >= at)}
    one = sorted((r.piece, r.start, r.n_tokens) for r in out if r.id == next(i for i, n in rows if n == 200))
    assert one == [(0, 0, 64), (1, 64, 64), (2, 128, 64), (3, 192, 8)]


def test_empty_table_and_wrong_prices(spark):
    none = spark.createDataFrame([], "doc_id long, n int")
    assert pack(none, F.col("n")).count() == 0
    with pytest.raises(ValueError):
        pack(none, F.col("n"), prices=(1.0,))


def unpacked(out):
    """Tokens of each (id, row of that id) from the sequences, pieces put together again."""
    found = {}
    for r in out:
        assert len(r.ids) == r.n_tokens == sum(s.n_tokens for s in r.sources) <= r.capacity
        at = 0
        for k, s in enumerate(r.sources):
            assert (s.position, s.offset) == (k, at)
            found.setdefault(s.id, []).append((s.start, r.ids[at : at + s.n_tokens]))
            at += s.n_tokens
    return {i: [t for _, p in sorted(v, key=lambda x: x[0]) for t in p] for i, v in found.items()}


def test_byte_sequences_hold_every_text(spark):
    source = random.Random(3)
    rows = [(i, "".join(source.choice("aé ñ\n") for _ in range(source.choice([0, 3, 30, 63, 64, 300])))) for i in range(200)] + [(900, None), (901, "")]
    out = sequences(spark.createDataFrame(rows, "`doc.id` long, text string").withColumn("tokens", F.lit(7)), F.col("text"), "doc.id", capacities=(16, 32, 64), group_items=80).collect()
    assert unpacked(out) == {i: [*(t or "").encode(), END] for i, t in rows}
    assert all(r.capacity == min(c for c in (16, 32, 64) if c >= r.n_tokens) for r in out)


def test_token_sequences_and_odd_rows(spark):
    rows = [(1, [5, 6, 7]), (2, list(range(100))), (3, []), (4, None), (None, [9] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    got = unpacked(sequences(docs, F.col("ids"), capacities=(8, 32)).collect())
    assert got == {1: [5, 6, 7], 2: list(range(100)), None: [9] * 40}
    assert sequences(docs.limit(0), F.col("ids")).count() == 0
    twice = spark.createDataFrame([(5, "ab"), (5, "ab")], "doc_id long, text string")
    assert sorted(unpacked(sequences(twice, F.col("text")).collect())[5]) == sorted([97, 98, END] * 2)


def test_whole_query_equals_a_plain_packing(spark, tmp_path):
    """Placements of one group against a plain best fit over all pieces: the same fills, capacities and price."""
    from slotcast.llm.queries import registered

    source = random.Random(12)
    rows = [(i, "x" * source.choice([0, 10, 700, 2047, 2500, 5000, 8191, 9000, 30_000])) for i in range(300)] + [(301, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registered()["op10_packing"](spark, str(tmp_path)).collect()
    sizes = []
    for _, t in rows:
        n = len(t or "") + 1
        sizes += [CAPACITIES[-1]] * (n // CAPACITIES[-1]) + ([n % CAPACITIES[-1]] if n % CAPACITIES[-1] else [])
    assert len(sizes) < GROUP_ITEMS and sorted(r.n_tokens for r in got) == sorted(sizes)
    prices = tuple(c + OVERHEAD for c in CAPACITIES)
    fills = {}
    for r in got:
        fills[r.bin, r.capacity] = fills.get((r.bin, r.capacity), 0) + r.n_tokens

    def price(held):
        return sum(next(p for c, p in zip(CAPACITIES, prices) if c >= f) for f in held)

    plain = [plain_best_fit(sizes, CAPACITIES, prices, favour) for favour in CAPACITIES]
    best = min(plain, key=price)
    assert sorted(fills.values()) == best and all(c == min(x for x in CAPACITIES if x >= f) for (_, c), f in fills.items())
