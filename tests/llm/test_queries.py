"""Queries without SQL against plain versions, over whole tables."""

import glob
import hashlib
import zlib

import numpy as np
import pytest

from slotcast.llm import langid, packing
from slotcast.llm.queries import registered
from tests.llm.test_simhash import plain_components, plain_fingerprint

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not glob.glob(f"{FOLDER}/*.parquet"), reason="driver tables are not here")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in registered()] == [f"op{k}" for k in range(1, 14)]


def test_sentencepiece(spark, docs):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"))
    want = {}
    for i, r in docs.items():
        ids = [*library.encode(r.text or ""), library.eos_id()]
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = registered()["op3_sentencepiece"](spark, FOLDER).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(want)


def test_simhash(spark, docs):
    ids = sorted(docs)
    values = [plain_fingerprint(docs[i].text) for i in ids]
    roots, least = plain_components(values, 4), {}
    for i, r in zip(ids, roots):
        least.setdefault(r, i)
    got = registered()["op5_simhash"](spark, FOLDER).collect()
    assert sorted(map(tuple, got)) == [(i, f"{v:016x}", least[r]) for i, v, r in zip(ids, values, roots)]


def test_language(spark, docs):
    got = {r.doc_id: r for r in registered()["op7_language"](spark, FOLDER).collect()}
    assert set(got) == set(docs)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    assert all((r.lang_pred == "und") == (not len(langid.subwords(docs[i].text or ""))) for i, r in got.items())
    held = [i for i in got if got[i].held_out]
    assert np.mean([got[i].lang_pred == docs[i].lang for i in held]) > 0.9


def test_quality(spark, docs):
    got = {r.doc_id: r for r in registered()["op9_quality"](spark, FOLDER).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert set(got) == set(docs)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    assert np.mean([got[i].predicted == q for i, q in labels.items() if i in got and got[i].held_out]) > 0.85


def test_packing(spark, docs):
    tokens, fill = {}, {}
    for r in registered()["op10_packing"](spark, FOLDER).collect():
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
        fill[r.bin, r.capacity] = fill.get((r.bin, r.capacity), 0) + r.n_tokens
    assert tokens == {i: len((r.text or "").encode()) + 1 for i, r in docs.items()}
    assert all(f <= c for (_, c), f in fill.items())
