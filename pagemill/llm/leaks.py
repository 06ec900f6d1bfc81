"""Evaluation texts inside a training corpus.

The word n-grams of the evaluation items, folded, form a hash set that is broadcast block by block
(`BLOCK_BYTES` bounds a block). Every document is scanned once per block: its words become numbers
(0: in no item), windows without a 0 are hashed and looked up, and a hit is verified word by word.
The set is packed: sorted hashes with the places of their windows in one array of word numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Consecutive words that make a leak.
WORDS = 13
#: Memory of a block in a Python worker, about, and what a window and a new word of the items take of it.
BLOCK_BYTES, WINDOW_BYTES, WORD_BYTES = 64_000_000, 28, 120

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits, case folded."""
    return _WORD.findall(text.casefold())


def _hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every window of n numbers."""
    out = np.zeros(len(ids) - n + 1, np.uint64)
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    for k in range(n):
        out = out * np.uint64(0xD1B54A32D192ED03) + mixed[k : k + len(out)]
    return out


class Grams:
    """The n-grams of some items (id, words): word -> number, hashes of windows -> where they stand and in which item."""

    def __init__(self, items: list[tuple[int, list[str]]], n: int) -> None:
        self.n, self.number = n, {}
        number = self.number
        self.ids = np.fromiter((number.setdefault(w, len(number) + 1) for _, ws in items for w in ws), np.int32)
        starts, owners, at = [], [], 0
        for item, ws in items:
            starts.append(np.arange(at, at + len(ws) - n + 1))
            owners.append(np.full(len(ws) - n + 1, item, np.int64))
            at += len(ws)
        starts, owners = np.concatenate(starts), np.concatenate(owners)
        hashes = _hashes(self.ids, n)[starts]
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.starts, self.items = hashes[order], starts[order], owners[order]
        # The first and last words of windows rule most others out before they are hashed.
        self.first, self.last = np.zeros(len(number) + 1, bool), np.zeros(len(number) + 1, bool)
        self.first[self.ids[starts]] = self.last[self.ids[starts + n - 1]] = True

    def hits(self, tokens: list[str]) -> list[tuple[int, int]]:
        """(window start, item) of every window of the document that is in an item."""
        n = self.n
        if len(tokens) < n:
            return []
        ids = np.fromiter(map(self.number.get, tokens, [0] * len(tokens)), np.int32, len(tokens))
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        at = np.flatnonzero(known[n:] - known[:-n] == n)
        at = at[self.first[ids[at]] & self.last[ids[at + n - 1]]]
        if not len(at):
            return []
        # Only the stretch that holds candidates is hashed.
        low = int(at[0])
        hashes = _hashes(ids[low : int(at[-1]) + n], n)[at - low]
        lo, hi = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        out = []
        for k, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
            window = ids[k : k + n]
            out += [(k, int(self.items[j])) for j in range(a, b) if np.array_equal(self.ids[self.starts[j] : self.starts[j] + n], window)]
        return out


def _pieces(ws: list[str], n: int, limit: int) -> Iterator[list[str]]:
    """The words of an item in pieces of at most `limit` windows that lose no window."""
    for k in range(0, len(ws) - n + 1, limit):
        yield ws[k : k + limit + n - 1]


def _blocks(items: DataFrame, id_col: str, text_col: str, n: int, size: int) -> Iterator[Grams]:
    """The items in blocks of about `size` bytes; the driver holds one block at a time, and long items are divided."""
    rows = items.select(F.col(id_col).cast("bigint"), F.col(text_col)).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).distinct()
    block: list[tuple[int, list[str]]] = []
    seen: set[str] = set()
    taken = 0
    for i, text in rows.toLocalIterator():
        # Items of fewer than n words have no window.
        for piece in _pieces(words(text), n, max(1, size // (WINDOW_BYTES + WORD_BYTES))):
            more = len(piece) * WINDOW_BYTES + len(set(piece) - seen) * WORD_BYTES
            if block and taken + more > size:
                yield Grams(block, n)
                block, seen, taken = [], set(), 0
                more = len(piece) * WINDOW_BYTES + len(set(piece)) * WORD_BYTES
            block.append((i, piece))
            seen.update(piece)
            taken += more
    if block:
        yield Grams(block, n)


def _scan(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: Grams = shared.value
        for b in batches:
            docs, items = [], []
            for doc, text in zip(b["doc"].tolist(), b["text"]):
                found = {item for _, item in grams.hits(words(text))}
                docs += [doc] * len(found)
                items += sorted(found)
            yield pd.DataFrame({"doc_id": docs, "item_id": items}, dtype="int64")

    return run


def leaks(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id): every document and item that share n consecutive words; each pair once.

    Null ids and texts have no words; items of fewer than n words cannot leak. No items or no documents: no rows.
    """
    docs = documents.select(F.col(doc_col).cast("bigint").alias("doc"), F.col(text_col).alias("text")).where("doc is not null and text is not null")
    out = None
    for grams in _blocks(items, item_col, item_text_col, n, block_bytes):
        part = docs.mapInPandas(_scan(documents.sparkSession.sparkContext.broadcast(grams)), "doc_id bigint, item_id bigint")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = documents.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint")
    return out.distinct()


def _spans(text: str, grams: Grams) -> list[tuple[int, int]]:
    """Where leaked passages stand in a text."""
    folded = text.casefold()
    if len(folded) != len(text):
        # Folding changed lengths (sharp s and the like): fold word by word instead, to keep the places.
        spans = [m.span() for m in _WORD.finditer(text)]
        tokens = [text[a:b].casefold() for a, b in spans]
    else:
        spans = [m.span() for m in _WORD.finditer(folded)]
        tokens = [folded[a:b] for a, b in spans]
    return [(spans[k][0], spans[k + grams.n - 1][1]) for k, _ in grams.hits(tokens)]


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    out, end = [], 0
    for a, b in sorted(spans):
        if a > end:
            out.append(text[end:a])
        end = max(end, b)
    out.append(text[end:])
    return "".join(out)


def _finder(shared):
    @F.pandas_udf("array<bigint>")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else [x for span in _spans(t, shared.value) for x in span])

    return find


def _cutter():
    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or not len(s) else _without(t, list(zip(s[::2], s[1::2]))) for t, s in zip(texts, spans)])

    return cut


def without_leaks(documents: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """documents with all leaked passages cut out of text_col; other columns, rows and null texts are unchanged.

    The passages of all blocks are found in the text as it was and cut at once, so their size does not matter.
    """
    finders = [_finder(documents.sparkSession.sparkContext.broadcast(g))(F.col(text_col)) for g in _blocks(items, item_col, item_text_col, n, block_bytes)]
    if not finders:
        return documents
    return documents.withColumn(text_col, _cutter()(F.col(text_col), F.concat(*finders)))
