"""Quality rules: lines are judged and removed first, then documents that lose too much of their text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.llm.common import ship, slices

#: Base rules: fewest words of a document, and the percentage of its words in repeated three-word windows that is too much.
MIN_WORDS = 50
MOST_REPEATED = 50
#: Percentage of words in removed lines above which a document goes.
MOST_LOST = 30
SYMBOLS = "#*$%&|<>"
#: Words that only part the entries of a menu.
SEPARATORS = ("|", ">", "»", "›", "•", "·", "/")
#: What a short line of navigation starts with.
NAVIGATION = ("home", "menu", "search", "log in", "login", "sign in", "sign up", "skip to", "back to", "next", "previous", "read more", "click here", "share")
#: What boilerplate lines contain.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "privacy policy", "cookie policy", "use cookies", "terms of use", "terms of service",
    "enable javascript", "lorem ipsum", "subscribe to our", "powered by",
)
RULES = ("punctuation", "navigation", "boilerplate")
_SPACE = b" \t\n\r\x0b\x0c"
_NOT_COUNTED = _SPACE + bytes(range(0x80, 0xC0))
_END = re.compile(r"""(?:[.!?]|…)(?:[ "')\]]|”|»)*$""".encode())
_DOUBLED = re.compile(rb"[!?]{2,}")
_PARTING = frozenset(s.encode() for s in SEPARATORS)
_START = re.compile(("(?:" + "|".join(NAVIGATION) + r")\b").encode())
_PHRASE = re.compile("|".join(BOILERPLATE).encode())


def in_repeated_windows(words: list[bytes], width: int = 3) -> int:
    """Number of words in windows of ``width`` words that occur twice or more, the first occurrence included. Words are compared themselves, not by hash."""
    if len(words) <= width:
        return 0
    rank = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(rank.__getitem__, words), dtype=np.int64, count=len(words))
    n, most = len(words) - width + 1, len(rank)
    key, kinds = ids[:n], most
    for k in range(1, width):
        if kinds * most >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            kinds = n
        key = key * most + ids[k : k + n]
        kinds *= most
    ordered = np.sort(key)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    found = np.isin(key, again)
    covered = np.zeros(len(words), dtype=bool)
    for k in range(width):
        covered[k : k + n] |= found
    return int(covered.sum())


def failed_rule(line: bytes, words: list[bytes], seen: bool) -> str | None:
    """The first rule that a line with words fails, if any.

    Boilerplate: it holds a stock phrase or equals an earlier line. Navigation: two or more of its words, a fifth at least, are bare separators, or it has
    six words at most and starts with a menu entry without ending a sentence. Punctuation: it does not end a sentence, or symbols and doubled marks are more than a quarter of its words.
    """
    low = line.lower()
    if seen or _PHRASE.search(low):
        return "boilerplate"
    ends = _END.search(line.rstrip(_SPACE)) is not None
    bars = sum(w in _PARTING for w in words)
    if (bars >= 2 and 5 * bars >= len(words)) or (not ends and len(words) <= 6 and _START.match(low.lstrip(_SPACE))):
        return "navigation"
    symbols = len(line) - len(line.translate(None, SYMBOLS.encode()))
    if not ends or 4 * (symbols + len(_DOUBLED.findall(line))) > len(words):
        return "punctuation"
    return None


def cleaned(raw: bytes) -> tuple[bytes, int, int, dict[str, int]]:
    """A text without the lines that fail a rule, its repeated lines, its lost words and its lost lines by rule. Lines without a word stay."""
    seen: set[bytes] = set()
    stay, repeated, lost, by_rule = [], 0, 0, dict.fromkeys(RULES, 0)
    for line in raw.split(b"\n"):
        words = line.split()
        if not words:
            stay.append(line)
            continue
        again = line in seen
        seen.add(line)
        repeated += again
        rule = failed_rule(line, words, again)
        if rule is None:
            stay.append(line)
        else:
            by_rule[rule] += 1
            lost += len(words)
    return b"\n".join(stay), repeated, lost, by_rule


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words", *(f"{r}_lines" for r in RULES))


def _judge(most_lost: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, failed, kept, texts = [], [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                raw = text or b""
                words = raw.split()
                left, repeated, lost, by_rule = cleaned(raw)
                n, again = len(words), in_repeated_windows(words)
                counts.append((n, len(raw.translate(None, _NOT_COUNTED)), len(raw) - len(raw.translate(None, SYMBOLS.encode())), repeated, again, lost, *by_rule.values()))
                failed.append(n < MIN_WORDS or 100 * again > MOST_REPEATED * n)
                kept.append(not failed[-1] and 100 * lost <= most_lost * n)
                texts.append(None if text is None else left.decode())
            columns = zip(*counts) if counts else [[] for _ in _COUNTS]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(c, pa.int64()) for c in columns), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(texts, pa.string())],
                ["id", *_COUNTS, "base_failed", "kept", "cleaned"],
            )

    return step


def judge(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", most_lost: int = MOST_LOST) -> DataFrame:
    """One row for each row of ``docs``: ``id``, counts of the text, lost lines by rule, ``base_failed``, ``kept`` and the ``cleaned`` text.

    Lines (split at line feeds) are judged first: see :func:`failed_rule`. Failing lines are taken out; lines without a word stay. A document is kept if
    it passes the base rules on its original text and at most ``most_lost`` percent of its words were in lines taken out.
    NULL and empty texts have no words, fail the base rules and give a ``cleaned`` text of NULL and of nothing. Repeated rows and ids are judged one
    by one, a NULL id stays NULL, other columns of ``docs`` are not read, whatever their names, and an empty table gives an empty result.

    Each text is judged whole in its task, without a shuffle; equal lines and windows are those of one text only.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    schema = f"id {kind}, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", base_failed boolean, kept boolean, cleaned string"
    return rows.mapInArrow(_judge(most_lost), schema)
