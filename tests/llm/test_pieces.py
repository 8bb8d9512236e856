import random

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("public_tokenizers")

from slotcast.llm.pieces import Encoder, Vocabulary, decode, decoded, encode, piece_bytes  # noqa: E402

PATH = tokenizers.path("piece_bpe_32k.model")
ODD = [" ", "  ", "▁", "\n", "\t", "é", "ü", "中", "文", "😀", "0", "99", "==", "--", "\x00", "\r\n", "　", "ﬁ", "Å", "the", "ing", "a", "b"]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.read(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts(vocabulary, n, seed=5):
    source = random.Random(seed)
    parts = ODD * 20 + [p.replace("▁", " ") for p in vocabulary.pieces[259:4000]]
    return ["", " ", " " * 40 + "x", *("".join(source.choice(parts) for _ in range(source.randrange(14))) for _ in range(n))]


def test_ids_and_texts_equal_the_library(vocabulary, library):
    own, table = Encoder(vocabulary), piece_bytes(vocabulary)
    for text in texts(vocabulary, 8000):
        ids = list(memoryview(own.encode(text)).cast("i")) if text else []
        assert ids == library.encode(text)
        assert decoded([*ids, vocabulary.end], table) == library.decode(ids)


def test_the_whole_text_needs_no_cuts(vocabulary, library):
    """The prefix table alone, over texts that are not cut into words."""
    own = Encoder(vocabulary)
    for text in texts(vocabulary, 2000, seed=6):
        known = "".join(c for c in "▁" + text.replace(" ", "▁") if c in own.known)
        assert len(known) == 1 or own.run(known) == library.encode(known[1:])


def test_long_word(vocabulary, library):
    text = "ab" * 20_000 + " " + "the" * 3000
    assert list(memoryview(Encoder(vocabulary).encode(text)).cast("i")) == library.encode(text)


def test_tables(spark, vocabulary, library):
    rows = [(1, None, "k"), (2, "", None), (None, "Hello  world\n", "x"), (2, "é" * 3000, "y"), (2, "é" * 3000, "y")]
    coded = encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), vocabulary)
    want = sorted(((i, [*library.encode(t or ""), library.eos_id()]) for i, t, _ in rows), key=repr)
    assert sorted(((r.id, r.ids) for r in coded.collect()), key=repr) == want
    back = decode(coded, vocabulary)
    assert sorted(((r.id, r.text) for r in back.collect()), key=repr) == sorted(((i, t or "") for i, t, _ in rows), key=repr)
    assert encode(spark.createDataFrame([], "doc_id long, text string"), vocabulary).count() == 0
    assert decode(spark.createDataFrame([(1, None)], "id long, ids array<int>"), vocabulary).first().text is None
