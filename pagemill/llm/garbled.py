"""Text decoded with the wrong character encoding, found and restored by description length.

A candidate chain says how text went wrong: its characters are taken back to bytes by one encoding
and read by another, once or several times (see `Judge.restore`). Wrongly decoded characters stand in runs of non-ASCII
characters, so a chain is tried on each distinct run; runs it cannot read stay as they are. For
every chain that reads at least one run of a document, the affected surroundings are compressed
with a zstandard dictionary of each language, trained on a bounded sample of the corpus. The chain
with the least compressed size plus its own cost wins; if none beats the text as it is, it is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import hash_sample

#: Documents, about, that the dictionaries are trained on; bytes of a dictionary; cost of a step of a chain in bytes.
SAMPLE_DOCS, DICTIONARY_BYTES, STEP_COST = 3000, 32_768, 0.5
#: Longest document, in characters, that dictionaries are trained on.
SAMPLE_LONGEST = 50_000
#: Steps a chain may have; text around a run that is compressed with it.
DEPTH, AROUND = 4, 24

# (bytes by, read by): what a step undoes. Single-byte readings of UTF-8, double-byte readings of it, and
# double-byte or single-byte text read as Western.
STEPS = [
    *((e, "utf-8") for e in ("western", "latin-1", "cp1251", "cp437", "mac_roman", "cp850", "koi8_r", "cp1250", "gb18030", "big5", "shift_jis", "euc_kr")),
    *(("western", e) for e in ("gb2312", "gbk", "big5", "shift_jis", "euc_kr", "cp1251", "koi8_r")),
]

_RUN = re.compile(r"[^\x00-\x7f]+")
_LOST = re.compile("[�\u0080-\u0084\u0086-\u009f]")
#: The bytes of a UTF-8 character without its last.
_STUMP = re.compile(rb"(?s:.*[\xe0-\xef][\x80-\xbf]|.*[\xf0-\xf4][\x80-\xbf]{1,2})")
#: Short runs of ordinary Western text: one character, small letters, or quotes beside a letter or an opening mark.
_ORDINARY = re.compile("(?s:.)|[ß-öø-ÿœšž]+|[“”„‘’‚«»‹›]+[¿¡]?[À-ÖØ-öø-ÿŒœŠšŽžŸ]?|[ß-öø-ÿœšž]+[“”„‘’‚«»‹›…–—]+")


def _western() -> dict[int, int]:
    """Windows-1252 with the undefined bytes kept as control characters, the way browsers read it."""
    table = {}
    for b in range(128, 256):
        try:
            table[ord(bytes([b]).decode("cp1252"))] = b
        except UnicodeDecodeError:
            table[b] = b
    for b in range(0x80, 0xA0):
        table.setdefault(b, b)
    return table


_WESTERN = _western()


def _to_bytes(text: str, encoding: str) -> bytes | None:
    if encoding == "western":
        out = bytearray()
        for c in text:
            b = ord(c) if c < "\x80" else _WESTERN.get(ord(c))
            if b is None:
                return None
            out.append(b)
        return bytes(out)
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        return None


@lru_cache(200_000)
def readings(run: str, short: bool = False) -> tuple[tuple[int, str], ...]:
    """(number of the step, text) for every step that reads a run as something else.

    Western letters as bytes of another script are doubtful in runs of under six, which may be ordinary
    accented letters and quotes side by side; short asks for these readings, else they are left out.
    """
    out = []
    for k, (by, to) in enumerate(STEPS):
        if short != (to != "utf-8" and len(run) < 6):
            continue
        raw = _to_bytes(run, by)
        if raw is None:
            continue
        try:
            text = raw.decode(to)
        except UnicodeDecodeError:
            continue
        if text != run and "\ufffd" not in text and (not _LOST.search(text) or _LOST.search(run)):
            out.append((k, text))
    return tuple(out)


def _runs(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _RUN.finditer(text)]


def _again(text: str) -> str | None:
    """The text after one more Western reading of its runs is undone; None if none can be."""
    done = {r: n for r in set(_RUN.findall(text)) for k, n in readings(r) if k == 0}
    return _RUN.sub(lambda m: done.get(m.group(), m.group()), text) if done else None


class Judge:
    """Description lengths by the dictionaries of all languages."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.by = [zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in dictionaries.values()] or [zstandard.ZstdCompressor(level=6, write_content_size=False)]

    def size(self, text: str) -> int:
        raw = text.encode("utf-8", "surrogatepass")
        return min(len(c.compress(raw)) for c in self.by)

    def _gain(self, text: str, spans: list[tuple[int, int]], new: dict[str, str]) -> int:
        """Bytes saved where the runs in `new` stand, each compressed with the ASCII text around it."""
        before, after, end = [], [], 0
        for k, (a, b) in enumerate(spans):
            if text[a:b] in new:
                lo, hi = max(a - AROUND, end), min(b + AROUND, spans[k + 1][0] if k + 1 < len(spans) else len(text))
                before.append(text[lo:hi])
                after += [text[lo:a], new[text[a:b]], text[b:hi]]
                end = hi
            else:
                end = b
        return self.size("".join(before)) - self.size("".join(after))

    def _short(self, text: str, spans: list[tuple[int, int]]) -> tuple[dict[int, dict[str, str]], dict[int, dict[str, str]]]:
        """By step, the doubtful readings of runs that are no ordinary Western text, and of those that are."""
        # Letters that go on in ASCII letters are part of a word.
        inner = {text[a:b] for a, b in spans if text[a:b].isalpha() and (text[max(a - 1, 0) : a].isalpha() or text[b : b + 1].isalpha())}
        odd: dict[int, dict[str, str]] = {}
        plain: dict[int, dict[str, str]] = {}
        for run in {text[a:b] for a, b in spans}:
            for step, new in readings(run, True):
                if _STUMP.fullmatch(_to_bytes(run, "western")):
                    continue
                (plain if run in inner or _ORDINARY.fullmatch(run) else odd).setdefault(step, {})[run] = new
        return odd, plain

    def restore(self, text: str) -> tuple[str, int]:
        """The most likely original and the number of wrong readings undone (0: unchanged).

        The candidates are every step, alone and followed by further Western readings undone. The chain
        that saves most beyond its cost is taken; runs that it cannot read wait for another round. Short runs
        of Western letters join a step if the text gets shorter for it.
        """
        total = 0
        for _ in range(DEPTH):
            spans = _runs(text)
            chains: dict[tuple[int, int], dict[str, str]] = {}
            for run in {text[a:b] for a, b in spans}:
                for step, new in readings(run):
                    for more in range(DEPTH):
                        chains.setdefault((step, more), {})[run] = new
                        again = _again(new) if step < 2 else None
                        if again is None:
                            break
                        new = again
            # A longer chain also holds what a shorter one reads in full.
            for (step, more), new in sorted(chains.items()):
                if more:
                    for run, shorter in chains[step, more - 1].items():
                        new.setdefault(run, shorter)
            tries = sorted(chains.items())
            odd, plain = self._short(text, spans)
            for step, short in sorted(odd.items()):
                known = chains.get((step, 0), {})
                own = {r: n for r, n in short.items() if self._gain(text, spans, {r: n}) > 0}
                tries += [((step, 0), known | x) for x in (short, own) if x]
            best, gain = None, 0.0
            for chain, new in tries:
                g = self._gain(text, spans, new) - STEP_COST * (1 + chain[1])
                if g > gain:
                    best, gain = (chain, new), g
            if best is None:
                break
            (step, more), new = best
            # Runs that look ordinary follow a step that others have shown, where each is the shorter for it.
            new = new | {r: n for r, n in plain.get(step, {}).items() if self._gain(text, spans, {r: n}) > 0}
            text = _RUN.sub(lambda m, new=new: new.get(m.group(), m.group()), text)
            total += 1 + more
        return text, total


def _language(lang: str | None) -> str:
    return (lang or "?").strip().lower()[:2]


def train(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """A dictionary per language from about `sample` documents (at most twice as many), chosen by the hash of the text; documents with candidate chains are left out."""
    texts_of = documents.select(F.col(lang_col).cast("string"), F.col(text_col).alias("text")).where("text is not null and text <> ''").where(F.length("text") <= SAMPLE_LONGEST)
    rows = hash_sample(texts_of, sample, "text").collect()
    texts: dict[str, list[bytes]] = {}
    for lang, text in rows:
        if _LOST.search(text) or any(readings(text[a:b]) for a, b in _runs(text)):
            continue
        texts.setdefault(_language(lang), []).append(text.encode("utf-8", "surrogatepass"))
    out = {}
    for lang, raw in texts.items():
        cut = [r[k : k + 1000] for r in raw for k in range(0, len(r), 1000)]
        try:
            out[lang] = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, cut)) // 8)), cut).as_bytes()
        except zstandard.ZstdError:
            continue  # too few texts of this language for a dictionary
    return out


def _judged(dictionaries: dict[str, bytes], keep_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(dictionaries)
        for b in batches:
            rows = []
            for doc, text in zip(b["doc"].tolist(), b["text"]):
                lost = bool(_LOST.search(text))
                new, steps = judge.restore(text)
                if lost or steps:
                    rows.append((doc, steps, lost and bool(_LOST.search(new)), new if keep_text else None))
            yield pd.DataFrame(rows, columns=["doc_id", "steps", "lossy", "restored"])

    return run


def garbled(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dictionaries: dict[str, bytes] | None = None, keep_text: bool = True) -> DataFrame:
    """(doc_id, steps, lossy, restored) of every document with a wrongly decoded sequence.

    steps: wrong readings undone, 0 where nothing can be restored. lossy: replacement or control
    characters remain. restored: the text as far as it can be restored. Null and ASCII texts are never
    garbled; repeated rows come out once.
    """
    dictionaries = train(documents, text_col, lang_col) if dictionaries is None else dictionaries
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text")).where(F.col("text").rlike("[^\\x00-\\x7f]"))
    return rows.mapInPandas(_judged(dictionaries, keep_text), "doc_id bigint, steps int, lossy boolean, restored string").dropDuplicates(["doc_id", "restored"])
