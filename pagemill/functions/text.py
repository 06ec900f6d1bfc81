"""String functions of results: LaTeX repair and clean-up, exports, escapes, templates, versions, times."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Commands that are renamed, and commands with the number of their arguments.
RENAMED = {r"\textsc": r"\text", r"\textup": r"\text", r"\textbf": r"\mathbf", r"\textit": r"\mathit", r"\texttt": r"\mathtt"}
ARGUMENTS = {r"\frac": 2, r"\dfrac": 2, r"\tfrac": 2, r"\binom": 2}
#: Repeated prefix: texts longer than this are looked at; prefixes from this length, so often; cleared below this share.
REPEAT_FROM, REPEAT_PREFIX, REPEAT_TIMES, REPEAT_SHARE = 20, 3, 3, 0.4
CHECK_HOURS = 12
NO_NOTES = "暂无更新说明。"

_BLANKS = r"^[\x00-\x20]+|[\x00-\x20]+$"
_JS_BLANKS = r"^[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+|[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+$"


def trim_controls(s: Column) -> Column:
    """Strip everything up to U+0020 at both ends."""
    return F.regexp_replace(s, _BLANKS, "")


def trim_blanks(s: Column) -> Column:
    """Strip all Unicode white space at both ends."""
    return F.regexp_replace(s, _JS_BLANKS, "")


# Repair.


_FRACTIONS = re.compile(r"\\(?:" + "|".join(c[1:] for c in ARGUMENTS) + r")(?![A-Za-z0-9_])")
_SCOPES = re.compile(r"\\(?:(left|right)(?![A-Za-z0-9_])|(begin|end)[ \t\n\x0b\f\r]*\{([A-Za-z*]+)[ \t\n\x0b\f\r]*\})")


def repair(tex: str | None, strict_compat: bool = True) -> str | None:
    """LaTeX made well-formed: line ends and edges cleaned, trailing backslashes (with blanks between them) and unmatched
    closing braces dropped, missing arguments filled with empty ones, open braces, lefts and environments closed.

    Null stays null. With strict_compat an escaped brace counts as a brace, fillings go in from the last found to the first
    at the places they had before any was put in (so in nested commands they may miss their place), and an open first
    argument gets an empty one before it. Without, none of this happens: escaped braces are left alone, arguments are
    filled where they are missing, inner ones included, and an open group takes in all the rest.
    """
    if tex is None:
        return None
    controls = "".join(map(chr, range(33)))
    s = re.sub(r"(?:\\[ \t\n\x0b\f\r]*)+$", "", tex.replace("\r\n", "\n").strip(controls)).strip(controls)
    kept, depth = [], 0
    for piece in re.findall(r"[{}]|[^{}]+" if strict_compat else r"\\.|[{}]|[^\\{}]+|\\", s, re.S):
        if piece == "}" and not depth:
            continue
        depth += (piece == "{") - (piece == "}")
        kept.append(piece)
    s = "".join(kept)
    s = _filled_as_found(s) if strict_compat else _filled(s)
    lefts, scopes = 0, []
    for m in _SCOPES.finditer(s):
        if m.group(1):
            lefts = max(0, lefts + (1 if m.group(1) == "left" else -1))
        elif m.group(2) == "begin":
            scopes.append(m.group(3))
        elif m.group(3) in scopes:
            del scopes[len(scopes) - 1 - scopes[::-1].index(m.group(3)) :]
    ends = "".join(f"\n\\end{{{name}}}" for name in reversed(scopes))
    return (s + "}" * depth + r" \right." * lefts + ends).strip(controls).replace(". .", "..")


def _group_end(s: str, at: int, escapes: bool) -> int | None:
    """Place behind the group that starts at `at`; None if it never ends."""
    depth = 0
    for m in re.compile(r"\\.|[{}]" if escapes else "[{}]", re.S).finditer(s, at):
        depth += (m.group() == "{") - (m.group() == "}")
        if depth == 0 and m.group() == "}":
            return m.end()
    return None


def _behind_blanks(s: str, at: int) -> int:
    return len(s) - len(s[at:].lstrip(" "))


def _filled_as_found(s: str) -> str:
    """Fillings of all commands by their places in s, put in from the last command to the first."""
    fillings = []
    for m in _FRACTIONS.finditer(s):
        first = _behind_blanks(s, m.end())
        if s[first : first + 1] != "{":
            fillings.append((first, " {} {}"))
            continue
        end = _group_end(s, first, False)
        if end is None:
            fillings.append((first, " {}"))
        elif s[_behind_blanks(s, end) :][:1] != "{":
            fillings.append((end, " {}"))
    for place, empty in reversed(fillings):
        s = s[:place] + empty + s[place:]
    return s


def _filled(s: str) -> str:
    out, at = [], 0
    while True:
        m = _FRACTIONS.search(s, at)
        if not m:
            return "".join(out) + s[at:]
        out.append(s[at : m.end()])
        at = m.end()
        for _ in range(ARGUMENTS[m.group()]):
            k = _behind_blanks(s, at)
            opened = s[k : k + 1] == "{"
            end = _group_end(s, k, True) if opened else None
            if opened and end is None:
                break  # an open group takes in all the rest
            if end is None:
                out.append(" {}")
            else:
                out.append(s[at : k + 1] + _filled(s[k + 1 : end - 1]) + "}")
                at = end


def repair_latex(tex: Column, strict_compat: bool = True) -> Column:
    @F.pandas_udf(StringType())
    def repaired(values: pd.Series) -> pd.Series:
        return values.map(lambda t: repair(t, strict_compat))

    return repaired(tex)


def sanitize_latex(s: Column) -> Column:
    """Command spellings of the renderer: renames, no blank between a command and its group, spaced letters of short groups joined."""
    for old, new in RENAMED.items():
        s = F.regexp_replace(s, re.escape(old) + r"\b", new.replace("\\", "\\\\"))
    s = F.regexp_replace(s, r"(\\[a-zA-Z*]+)\s+(\{)", "$1$2")
    letter = r"([a-zA-Z0-9])"
    s = F.regexp_replace(s, rf"\{{\s+{letter}\s+{letter}\s*\}}", "{$1$2}")
    return F.regexp_replace(s, rf"\{{\s+{letter}\s+{letter}\s+{letter}\s*\}}", "{$1$2$3}")


def repeated_prefix(s: Column) -> Column:
    """The shortest prefix of at least three characters that the text begins with three times over; null if there is none."""
    most = F.floor(F.length(s) / 3).cast("int")
    tries = F.when(most >= REPEAT_PREFIX, F.sequence(F.lit(REPEAT_PREFIX), most)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(tries, lambda n: s.startswith(F.repeat(F.left(s, n), F.lit(REPEAT_TIMES))))
    return F.left(s, F.get(hits, F.lit(0)))


def guard_repetition(s: Column) -> Column:
    """The empty text if a longer text only repeats a short prefix, else the text."""
    prefix = repeated_prefix(s)
    bad = (F.length(s) > REPEAT_FROM) & prefix.isNotNull() & (F.length(prefix) * 10 < F.length(s) * int(REPEAT_SHARE * 10))
    return F.when(F.coalesce(bad, F.lit(False)), F.lit("")).otherwise(s)


def fold_characters(s: Column, pairs: dict[str, str]) -> Column:
    """Characters replaced one by one, as for traditional by simplified ones; the pairs are a parameter, the first of a doubled one holds."""
    return F.translate(s, "".join(pairs), "".join(pairs.values())) if pairs else s


# Exports.


def as_latex(s: Column, form: str) -> Column:
    """Inline, display or equation form; anything else is the trimmed code."""
    code = trim_blanks(s)
    around = {"inline": ("$", "$"), "display": ("$$\n", "\n$$"), "equation": ("\\begin{equation}\n", "\n\\end{equation}")}.get(form)
    return F.concat(F.lit(around[0]), code, F.lit(around[1])) if around else code


def as_markdown(s: Column, form: str) -> Column:
    return as_latex(s, "inline" if form == "inline" else "display")


def as_text(s: Column) -> Column:
    """Plain text: no commands, braces, dollars or ampersands; white space collapsed."""
    return trim_blanks(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\\[a-zA-Z]+", ""), r"[{}$&]", ""), r"\s+", " "))


def wrap_lines(s: Column) -> Column:
    """Every line that is not blank between $$ marks."""
    lines = F.filter(F.transform(F.split(s, "\n"), trim_blanks), lambda x: x != "")
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit("$$"), x, F.lit("$$"))), "\n")


def aligned(lines: Column) -> Column:
    """Lines of a formula as one: none gives the empty text, one itself, more an aligned environment; edge dollars are dropped."""
    bare = F.transform(lines, lambda x: trim_controls(F.regexp_replace(x, r"^\$+|\$+$", "")))
    return F.when(F.size(bare) == 0, F.lit("")).when(F.size(bare) == 1, bare[0]).otherwise(F.concat(F.lit("\\begin{aligned}"), F.array_join(bare, " \\\\ "), F.lit("\\end{aligned}")))


def strip_fences(s: Column, any_case: bool = False) -> Column:
    """Without code fences; any_case also takes tex and other letter case."""
    opening = r"(?i)```(?:latex|tex)?\n?" if any_case else r"```latex\n?"
    return trim_blanks(F.regexp_replace(F.regexp_replace(s, opening, ""), r"```\n?", ""))


def fill_template(template: Column, values: Column) -> Column:
    """{{name}} by the value of a map; unknown names stay; values are not filled again: the text is cut at the names first."""
    parts = F.split(template, r"(?=\{\{\w+\}\})|(?<=\}\})")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\{\{\w+\}\}$"), F.coalesce(F.try_element_at(values, F.regexp_extract(p, r"(\w+)", 1)), p)).otherwise(p)), "")


def strip_slashes(s: Column) -> Column:
    return F.regexp_replace(s, "/+$", "")


def release_notes(s: Column) -> Column:
    """Headings on lines of their own, links and images dropped; a set text if there are no notes."""
    t = F.regexp_replace(F.regexp_replace(s, "### ", "\n### "), "## ", "\n## ")
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(NO_NOTES)).otherwise(trim_blanks(F.regexp_replace(t, r"!?\[.*?\]\(.*?\)", "")))


def escape_html(s: Column) -> Column:
    return F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def version_key(v: Column) -> Column:
    """Numbers of a dotted version, unreadable ones as 0."""
    return F.transform(F.split(v, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def newer(a: Column, b: Column) -> Column:
    """Whether version a is newer than b; missing parts count as 0."""
    ka, kb = version_key(a), version_key(b)
    # Both arrays get the length of the two together, whatever it is.
    return F.concat(ka, F.array_repeat(F.lit(0), F.size(kb))) > F.concat(kb, F.array_repeat(F.lit(0), F.size(ka)))


# JSON and binary.


def escape_json(s: Column) -> Column:
    """Body of a JSON string; null becomes the empty text."""
    quoted = F.to_json(F.struct(F.coalesce(s, F.lit("")).alias("v")))
    return F.substr(quoted, F.lit(7), F.length(quoted) - 8)


def result_json(kind: str) -> Column:
    """A result row as JSON, in the shape of its kind (formula: latex; text: text; both with confidence and time_ms;
    mixed: regions and formatted_text, without a confidence of its own)."""
    done, time = F.lit(True).alias("done"), F.coalesce("time_ms", F.lit(0)).alias("timeMs")
    if kind == "mixed":
        fields = [F.transform("regions", lambda r: F.struct(*(r[c].alias(c) for c in ("x", "y", "w", "h", "type")), F.coalesce(r["text"], F.lit("")).alias("text"), F.coalesce(r["confidence"], F.lit(0.0)).alias("confidence"))).alias("regions"), time, F.coalesce("formatted_text", F.lit("")).alias("formattedText")]
    else:
        name = {"formula": "latex", "text": "text"}[kind]
        fields = [F.coalesce(name, F.lit("")).alias(name), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), time]
    return F.to_json(F.struct(done, *fields))


def parse_result(s: Column) -> Column:
    """A result from JSON; fields it lacks are null, broken JSON gives nulls."""
    return F.from_json(s, "done boolean, latex string, text string, formattedText string, confidence double, timeMs int, regions array<struct<x:int,y:int,w:int,h:int,type:string,text:string,confidence:double>>, error string")


def read_int(raw: Column, at: int, n: int, little: bool) -> Column:
    """Unsigned integer of n bytes (at most 7) from place `at` (from 0)."""
    byte = [F.conv(F.hex(F.substring(raw, at + k + 1, 1)), 16, 10).cast("bigint") for k in range(n)]
    out = F.lit(0).cast("bigint")
    for b in reversed(byte) if little else byte:
        out = out * 256 + b
    return out


# Time.


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss.SSS")


def check_due(now: Column, last: Column, enabled: Column) -> Column:
    """Whether an update check is due: enabled, and none yet or twelve hours past. An unset preference counts as off."""
    return F.coalesce(enabled, F.lit(False)) & (last.isNull() | (now - F.expr(f"interval {CHECK_HOURS} hours") >= last))
