"""Text that looks the same but is made of other characters, brought to one form.

Compatibility normalisation (composed), full case folding, mapped white space and removal of
default-ignorable characters, plus look-alike letters of other scripts inside Latin text. Values
of plain ASCII need no Python: they are folded in the JVM. Others are worked on once per distinct
value a task meets. A value is odd if its normal form differs from it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts drawn like a Latin letter.
CYRILLIC = dict(zip("авеікморстухѕјһԁԛԝАВЕІКМНОРСТУХЅЈԚԜ", "abeikmopctyxsjhdqwABEIKMHOPCTYXSJQW"))
CYRILLIC.update({"в": "b", "к": "k", "м": "m", "т": "t"})
GREEK = dict(zip("ονΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovABEZHIKMNOPTYX"))
ALIKE = {**CYRILLIC, **GREEK}

IGNORABLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff"
SPACES = "   -     　\u000b\u000c\u0085"

_ignorable, _spaces = re.compile(f"[{IGNORABLE}]"), re.compile(f"[{SPACES}]")
_wide = re.compile("[０-９Ａ-Ｚａ-ｚ]")
_marks = re.compile(r"[̀-ͯ҃-҇᪰-᫿᷀-᷿⃐-⃿゙゚︠-︯]")
_alike = re.compile("[" + "".join(ALIKE) + "]")
_word = re.compile(r"[^\W\d_]+")
_other = re.compile(r"[^\x00-\x7f]")

# The tests of a value that needs more than ASCII folding (Java pattern).
ODD = "[^\\x00-\\x0a\\x0d-\\x7f]"


def _script(ch: str) -> str:
    if ch.isascii() or "À" <= ch <= "ɏ":
        return "L"
    if "Ѐ" <= ch <= "ԯ":
        return "C"
    return "G" if "Ͱ" <= ch <= "Ͽ" or "ἀ" <= ch <= "῿" else ""


def alike_positions(text: str) -> list[int]:
    """Where a letter of another script stands for the Latin letter it looks like.

    Within a run of letters that also holds Latin ones, every look-alike does. A run of look-alikes
    only does, unless the text has words that are written in that script beyond doubt (a letter of
    the script that looks like no Latin one); for Greek, single real letters are symbols, so only runs
    of two or more count as words. A single small nu counts only beside a Latin v or another look-alike.
    """
    if not _alike.search(text):
        return []
    out: list[int] = []
    pure: list[tuple[str, int, str]] = []
    real: set[str] = set()
    for m in _word.finditer(text):
        run, start = m.group(), m.start()
        scripts = {_script(c) for c in run}
        for s in ("C", "G"):
            if s not in scripts:
                continue
            if "L" in scripts or scripts >= {"C", "G"}:
                out += [start + k for k, c in enumerate(run) if c in ALIKE and _script(c) == s]
            elif any(c not in ALIKE for c in run if _script(c) == s):
                if s == "C" or len(run) > 1:
                    real.add(s)
            else:
                pure.append((s, start, run))
    nu = []
    for s, start, run in pure:
        if s in real:
            continue
        (nu if run == "ν" else out).extend(range(start, start + len(run)))
    if nu and (out or re.search(r"(?<![A-Za-z])v(?![A-Za-z])", text)):
        out += nu
    return sorted(out)


def _stands_for_letter(ch: str) -> bool:
    """A compatibility sign (ohm, kelvin, micro, ligature, letter of a mathematical alphabet ...) for ordinary letters."""
    if _wide.match(ch) or ch in "ªº":
        return ch in "ªº"
    plain = unicodedata.normalize("NFKC", ch)
    return plain != ch and plain.isalpha() and (unicodedata.category(ch)[0] == "L" or plain[0].isalpha()) and not unicodedata.combining(ch)


_sign_cache: dict[str, bool] = {}


def kinds(text: str) -> list[str]:
    """The kinds of odd characters in a text, in fixed order: wide, combining, invisible, space, alike, sign."""
    out = []
    chars = set(_other.findall(text))
    if _wide.search(text):
        out.append("wide")
    if any(_marks.match(c) for c in chars) and any(unicodedata.normalize("NFC", m.group()) != m.group() for m in re.finditer(r"[^\W\d_]" + _marks.pattern + "+", text)):
        out.append("combining")
    if _ignorable.search(text):
        out.append("invisible")
    if _spaces.search(text):
        out.append("space")
    # Invisible characters and combining marks must not cut a word in two here.
    joined = _ignorable.sub("", text)
    joined = unicodedata.normalize("NFC", _wide.sub(lambda m: unicodedata.normalize("NFKC", m.group()), joined)) if out else joined
    if alike_positions(joined):
        out.append("alike")
    for c in chars:
        if c not in _sign_cache:
            _sign_cache[c] = _stands_for_letter(c)
        if _sign_cache[c]:
            out.append("sign")
            break
    return out


def normalise(text: str, fold: bool = True) -> str:
    """One form of a text: NFKC, no default-ignorable characters, white space as blank, tab or newline,
    look-alike letters as Latin ones and, with fold, full case folding."""
    out = _spaces.sub(lambda m: "\n" if m.group() in "  \u0085" else " ", _ignorable.sub("", text))
    out = unicodedata.normalize("NFKC", out)
    at = alike_positions(out)
    if at:
        letters = list(out)
        for k in at:
            letters[k] = ALIKE[letters[k]]
        out = "".join(letters)
    if fold:
        out = unicodedata.normalize("NFKC", out.casefold())
    return out


class _Settled(dict):
    """For str.translate: what differs in compatibility form but stands for no letter (punctuation, raised digits ...) in that form."""

    def __missing__(self, code: int) -> str | int:
        c = chr(code)
        counts = c.isascii() or _wide.match(c) or _spaces.match(c) or _ignorable.match(c) or _stands_for_letter(c)
        self[code] = out = code if counts else unicodedata.normalize("NFKC", c)
        return out


_settled = _Settled()


def differs(text: str) -> bool:
    """Whether a text is in another than its normal form, apart from letter case and from signs that stand for no letter."""
    return normalise(text, fold=False) != unicodedata.normalize("NFC", text).translate(_settled) or unicodedata.normalize("NFC", text) != text


def _per_distinct(function, values: pd.Series, done: dict, most: int = 100_000) -> list:
    """function of every value, once per distinct one; done is kept from batch to batch and emptied when it holds `most`."""
    out = []
    for v in values:
        if v not in done:
            if len(done) >= most:
                done.clear()
            done[v] = function(v)
        out.append(done[v])
    return out


def is_odd(text: Column) -> Column:
    return text.rlike(ODD)


def normalised(df: DataFrame, text_col: str, out_col: str = "normal", fold: bool = True) -> DataFrame:
    """df with one more column, the normal form of text_col; null stays null, the empty text stays empty.

    Rows, order of columns and other columns are unchanged; an existing column of the name out_col is replaced.
    """

    @F.pandas_udf("string")
    def odd_form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        done: dict = {}
        for values in batches:
            # Null is settled by the function, not by an entry of done, which is lost when done is emptied.
            yield pd.Series(_per_distinct(lambda v: None if v is None else normalise(v, fold), values, done))

    text = F.col(text_col)
    # The UDF gets null for plain values, so that they do not travel to Python and back.
    odd = odd_form(F.when(is_odd(text), text))
    return df.withColumn(out_col, F.when(is_odd(text), odd).otherwise(F.lower(text) if fold else text))


def _flagged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    done: dict = {}
    for b in batches:
        # The normal form decides; the kinds only say why.
        found = _per_distinct(lambda t: (kinds(t) or ["other"]) if differs(t) else [], b["text"], done)
        keep = [bool(k) for k in found]
        yield pd.DataFrame({"tbl": b["tbl"][keep], "rec_id": b["rec_id"][keep], "kinds": [k for k in found if k]})


def odd_records(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(tbl, rec_id, kinds) of every record whose text is in another than its normal form. tables: name -> (table, id column, text column).

    Repeated rows come out once, with the kinds of all of them. Null texts and plain ASCII texts have none.
    """
    parts = [t.select(F.lit(n).alias("tbl"), F.col(i).cast("bigint").alias("rec_id"), F.col(c).alias("text")).where(is_odd(F.col("text"))) for n, (t, i, c) in tables.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    found = rows.mapInPandas(_flagged, "tbl string, rec_id bigint, kinds array<string>")
    return found.groupBy("tbl", "rec_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds"))
