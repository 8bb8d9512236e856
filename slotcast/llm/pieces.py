"""Piece encoding with merges by score, through a table of the last token of every prefix."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.llm.common import ship, slices

SPACE = "▁"
START = -1
NEVER = float("inf")
#: Whether a token is made by its own merges; its last parts and its first parts, each with the time of its next merge.
Edges = tuple[bool, list[tuple[str, float]], list[tuple[str, float]]]
#: Words and pair tests that a Python worker remembers; twice as many at most are held.
WORDS_HELD = 300_000
PAIRS_HELD = 400_000


@dataclass(frozen=True)
class Vocabulary:
    """What the encoder needs of a model file; about a megabyte, so tasks get it with their code."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    plain: tuple[bool, ...]  # pieces that merges can make
    byte_ids: tuple[int, ...]  # 256, by byte value
    unknown: int
    end: int

    @staticmethod
    def read(path: str) -> Vocabulary:
        """Read the pieces of a merge-type model with byte fallback. Other types and normalisers that change
        more than spaces are refused."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " a  b\nÅﬁ　 "
        if model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("the model normalises more than spaces")
        n = range(model.vocab_size())
        bytes_ = {model.id_to_piece(i): i for i in n if model.is_byte(i)}
        if len(bytes_) != 256:
            raise ValueError("the model has no byte fallback")
        return Vocabulary(
            tuple(model.id_to_piece(i) for i in n), tuple(model.get_score(i) for i in n),
            tuple(not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in n),
            tuple(bytes_[f"<0x{b:02X}>"] for b in range(256)), model.unk_id(), model.eos_id(),
        )


@dataclass
class Encoder:
    """Encodes by prefixes: of every prefix only the last token is stored.

    A token ends a prefix if it is a suffix of it (an automaton finds those), and if it is compatible with the last token of
    what is before it: merging the two texts alone gives these two tokens again. Exactly one token passes,
    and the ids are read off from the end. Merges never cross a character outside the vocabulary or the start of
    a word, so words are encoded one by one and remembered.
    """

    vocabulary: Vocabulary
    rank: dict[str, float] = field(default_factory=dict)
    ids: dict[str, int] = field(default_factory=dict)
    spines: dict[int, Edges] = field(default_factory=dict)
    pairs: dict[tuple[int, int], bool] = field(default_factory=dict)
    young: dict[str, bytes] = field(default_factory=dict)
    old: dict[str, bytes] = field(default_factory=dict)

    def __post_init__(self) -> None:
        v = self.vocabulary
        self.automaton = ahocorasick.Automaton()
        for i, (piece, plain) in enumerate(zip(v.pieces, v.plain)):
            if plain:
                self.rank[piece], self.ids[piece] = v.scores[i], i
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.known = {c for p in self.ids for c in p}
        self.adjacent = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        # a piece with a space after another character would join words
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def best(self, parts: list[str]) -> int | None:
        """Where the neighbours with the best score are, the leftmost of equals; None if no two make a piece."""
        best, at = None, None
        for k in range(len(parts) - 1):
            r = self.rank.get(parts[k] + parts[k + 1])
            if r is not None and (best is None or r > best):
                best, at = r, k
        return at

    def edges(self, token: int) -> Edges:
        """The parts at both ends of a token over time, while its own characters are merged."""
        made = self.spines.get(token)
        if made is None:
            text = self.vocabulary.pieces[token]
            parts, right, left = list(text), [], []
            tail, head = parts[-1], parts[0]
            while (at := self.best(parts)) is not None:
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                key = -self.rank[parts[at]]
                if parts[-1] != tail:
                    right.append((tail, key))
                    tail = parts[-1]
                if parts[0] != head:
                    left.append((head, key))
                    head = parts[0]
            right.append((tail, NEVER))
            left.append((head, NEVER))
            made = self.spines[token] = (len(parts) == 1, right, left)
        return made

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' texts together gives just these tokens.

        Both ends at the border grow as if alone; a pair across it must never be due before the parts' own next merges.
        Of equal scores the leftmost merge is first.
        """
        whole, _, heads = self.edges(right)
        if left == START or not whole:
            return whole
        tails = self.edges(left)[1]
        i = j = 0
        while True:
            (tail, tail_due), (head, head_due) = tails[i], heads[j]
            score = self.rank.get(tail + head)
            if score is not None and -score < tail_due and -score <= head_due:
                return False
            if tail_due == head_due == NEVER:
                return True
            if tail_due <= head_due:
                i += 1
            else:
                j += 1

    def run(self, text: str) -> list[int]:
        """Ids of a text of known characters."""
        last: list[int | None] = [None] * (len(text) + 1)
        last[0] = START
        known = self.pairs.get
        for end, (token, size) in self.automaton.iter(text):
            end += 1
            if last[end] is None and (before := last[end - size]) is not None:
                good = known((before, token))
                if good is None:
                    if len(self.pairs) >= PAIRS_HELD:
                        self.pairs.clear()
                    good = self.pairs[(before, token)] = self.compatible(before, token)
                if good:
                    last[end] = token
        out, at, pieces = [], len(text), self.vocabulary.pieces
        while at:
            token = last[at]
            if token is None:
                raise AssertionError("a prefix has no last token")
            out.append(token)
            at -= len(pieces[token])
        out.reverse()
        return out

    def fresh(self, text: str) -> bytes:
        """Ids of a text as 32-bit numbers. It is cut where no piece holds the two characters side by side;
        unknown characters become bytes."""
        cuts = [k for k in range(1, len(text)) if text[k - 1 : k + 1] not in self.adjacent]
        if cuts:
            return b"".join([self.remembered(text[a:b]) if b - a < 64 else self.fresh(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)])])
        if len(text) == 1 and text not in self.known:
            return array("i", [self.vocabulary.byte_ids[b] for b in text.encode()]).tobytes()
        return array("i", self.run(text)).tobytes()

    def remembered(self, word: str) -> bytes:
        ids = self.young.get(word)
        if ids is None:
            ids = self.old.get(word)
            if ids is None:
                ids = self.fresh(word)
            if len(self.young) >= WORDS_HELD:
                self.old, self.young = self.young, {}
            self.young[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, without an end id."""
        if not text:
            return b""
        text = SPACE + text.replace(" ", SPACE)
        if not self.by_word:
            return self.fresh(text)
        get, out = self.young.get, []
        for word in self.words.findall(text):
            ids = get(word)
            if ids is None:
                ids = self.remembered(word) if len(word) < 64 else self.fresh(word)
                get = self.young.get
            out.append(ids)
        return b"".join(out)


_encoders: dict[Vocabulary, Encoder] = {}


def encoder(vocabulary: Vocabulary) -> Encoder:
    """The worker's own encoder, made once."""
    if vocabulary not in _encoders:
        _encoders.clear()
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def _encode_step(shared: Any, end: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        own = encoder(vocabulary)
        tail = array("i", [vocabulary.end]).tobytes() if end else b""
        for batch in slices(batches, "text"):
            rows = [own.encode(t or "") + tail for t in batch.column("text").to_pylist()]
            offsets = np.zeros(len(rows) + 1, dtype=np.int32)
            np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
            values = pa.array(np.frombuffer(b"".join(rows), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), values)], ["id", "ids"])

    return step


def encode(docs: DataFrame, vocabulary: Vocabulary, id_column: str = "doc_id", text_column: str = "text", end: bool = True) -> DataFrame:
    """``(id, ids)`` of every row: the ids of the whole text, then the end id. NULL and empty texts have the end id only.
    A space is put before the first word; nothing else is normalised, left out or cut. Ids may be NULL or repeat."""
    spark = ship(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    shared = spark.sparkContext.broadcast(vocabulary)
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(_encode_step(shared, end), f"id {kind}, ids array<int>")


def decoded(ids: list[int], table: list[bytes]) -> str:
    """Text of ids by a table of each piece's bytes; the space before the first word goes."""
    raw = b"".join(map(table.__getitem__, ids))
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def piece_bytes(vocabulary: Vocabulary) -> list[bytes]:
    table = [p.replace(SPACE, " ").encode() if plain else b"" for p, plain in zip(vocabulary.pieces, vocabulary.plain)]
    table[vocabulary.unknown] = " ⁇ ".encode()
    for b, i in enumerate(vocabulary.byte_ids):
        table[i] = bytes([b])
    return table


def _decode_step(shared: Any) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_bytes(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [None if ids is None else decoded(ids, table) for ids in _lists(part.column("ids"))]
                at = part.schema.get_field_index("ids")
                yield part.set_column(at, "text", pa.array(texts, pa.string()))

    return step


def _lists(column: pa.ListArray) -> Iterator[list[int] | None]:
    offsets, values, null = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False), column.is_null().to_pylist()
    for k in range(len(column)):
        yield None if null[k] else values[offsets[k] : offsets[k + 1]].tolist()


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_column: str = "ids") -> DataFrame:
    """Turn the ids of every row into ``text``; other columns stay. Control ids have no text, NULL gives NULL."""
    spark = ship(encoded.sparkSession)
    others = [f for f in encoded.schema.fields if f.name not in (ids_column, "text")]
    shared = spark.sparkContext.broadcast(vocabulary)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "text string"])
    return encoded.select(*[f"`{f.name}`" for f in others], F.col(ids_column).alias("ids")).mapInArrow(_decode_step(shared), schema)
