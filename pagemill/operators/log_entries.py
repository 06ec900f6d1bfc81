"""Semi-structured log lines into entries with time, level, component and message.

Every line is collapsed to a shape signature (quoted strings, letter runs, digit runs, other
scripts and white space each become one symbol). Signatures are few, so each distinct one is
resolved once to an extraction rule; the rules are broadcast and a line is taken apart only by
the rule of its own signature. Lines without a rule continue the entry before them.

Sessions are cut into blocks of line numbers, so no task ever holds a whole session: entries are
closed within blocks, and only the lines at the head of a block are handed back to the entry that
was open at the end of an earlier block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.session import small, written

#: Symbols kept of a signature. The layout is decided by the header; extraction reads the whole line. Signatures of this
#: length that begin like a header and fit no layout yet are taken whole.
SIGNATURE_SYMBOLS = 48
#: Line numbers per block of a session.
BLOCK_LINES = 65_536
#: Distinct signatures up to which the resolved rules are broadcast.
RULES_LIMIT = 200_000

_CLOCK = r"(\d{1,2}):(\d\d):(\d\d)"
_QUOTED = r'"(?:[^"\\]|\\.)*"'

# name, pattern on the signature, pattern on the line whose groups are time, level, component;
# 0 where the layout has none. The text behind the match is the message.
LAYOUTS = [
    ("page", r"^\[9:9:9( a)?[.,]9\]\[a\]\[[^\]]+\]", r"^\[([0-9:.,]+(?: [AP]M)?[.,]?\d*)\]\[([A-Za-z]+)\]\[([^\]]+)\] ?", (1, 2, 3)),
    ("forwarded", r"^9 \[a\] \[a-a\]\[", r"^(\d{13}) +\[[^\]]+\] +\[[A-Za-z]+-([A-Za-z]+)\]\[([^\]]+)\] ?", (1, 2, 3)),
    ("bridge", r"^9 \[[^\]]+\]( |$)", r"^(\d{13}) +\[([^\]]+)\] ?", (1, 0, 2)),
    ("logcat-thread", r"^9-9 9:9:9\.9 9 9 a [^:]+:", r"^\d\d-\d\d (\d\d:\d\d:\d\d\.\d+) +\d+ +\d+ ([VDIWEFA]) ([^:]+?) *:(?: |$)", (1, 2, 3)),
    ("logcat-time", r"^9-9 9:9:9\.9 a/[^(]+\(", r"^\d\d-\d\d (\d\d:\d\d:\d\d\.\d+) ([VDIWEFA])/([^(]+?) *\( *\d+\):(?: |$)", (1, 2, 3)),
    ("runtime", r"^9-9-9 9:9:9\.9 \[a:a", r"^\d{4}-\d\d-\d\d (\d\d:\d\d:\d\d\.\d+) \[([VDIWEF]):([^:\]]+):[^\]]*\] ?", (1, 2, 3)),
    ("worker", r"^9-9-9a9:9:9(\.9)?(a|[+-]9:9|[+-]9) a \S+ - ?", r"^\d{4}-\d\d-\d\dT(\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:?\d\d)) ([A-Za-z]+) (\S+) -(?: |$)", (1, 2, 3)),
    ("script", r"^9-9-9 9:9:9,9 a [^:]+:", r"^\d{4}-\d\d-\d\d (\d\d:\d\d:\d\d,\d+) ([A-Za-z]+) ([^:\s]+):(?: |$)", (1, 2, 3)),
    ("json", r"^\{ ?s ?: ?", "", (0, 0, 0)),
    ("pairs", r"^[a.]+=\S", "", (0, 0, 0)),
]

# Names under which self-describing records keep their own time, level and module.
TIME_KEYS, LEVEL_KEYS, MODULE_KEYS, TEXT_KEYS = ("ts", "time", "timestamp"), ("level", "lvl", "severity"), ("component", "module", "mod", "logger"), ("message", "msg")

# Spellings of the four levels.
LEVELS = {
    "DEBUG": ("DEBUG", "D", "V", "VERBOSE", "TRACE", "FINE"),
    "INFO": ("INFO", "I", "NOTICE", "LOG"),
    "WARN": ("WARN", "W", "WARNING"),
    "ERROR": ("ERROR", "E", "F", "A", "ERR", "FATAL", "CRITICAL", "SEVERE"),
}


def plain(line: Column) -> Column:
    """The line without terminal colour sequences; null counts as empty."""
    line = F.coalesce(line, F.lit(""))
    return F.when(F.instr(line, "\u001b") > 0, F.regexp_replace(line, "\u001b\\[[0-9;]*[A-Za-z]", "")).otherwise(line)


def signature(line: Column, symbols: int | None = SIGNATURE_SYMBOLS) -> Column:
    """Shape of a line: s quoted string, 9 digits, a letters, u other scripts, one blank for white space; whole if symbols is None."""
    s = F.when(F.instr(line, '"') > 0, F.regexp_replace(line, _QUOTED, "\u0001")).otherwise(line)
    for pattern, symbol in ((r"[A-Za-z_]+", "a"), ("\u0001", "s"), (r"[0-9]+", "9"), (r"\s+", " "), (r"[^\x00-\x7f]+", "u")):
        s = F.regexp_replace(s, pattern, symbol)
    return s if symbols is None else F.substring(s, 1, symbols)


def resolve(signatures: DataFrame) -> DataFrame:
    """(sig) -> (sig, rule): the first layout whose shape pattern holds; other signatures drop out."""
    rule = F.lit(None).cast("string")
    for name, shape, _, _ in reversed(LAYOUTS):
        rule = F.when(F.col("sig").rlike(shape), F.lit(name)).otherwise(rule)
    return signatures.select("sig", rule.alias("rule")).where(F.col("rule").isNotNull())


#: How a header begins: a clock, date or epoch, an object, or a name of a pair.
_BEGINS = r"^(\[9:9:9|9 \[|9-9 9:9:9|9-9-9.9:9:9|\{ ?s|[a.]+$)"


def with_rules(base: DataFrame) -> DataFrame:
    """Lines (column line) with the rule of their signature, or null."""
    # Written first: otherwise the rule patterns would be pushed below the distinct and run on every line.
    shapes = written(base.select(signature(F.col("line")).alias("sig")).distinct(), "log-shapes")
    rules = resolve(shapes)
    known = base.withColumn("sig", signature(F.col("line"))).join(small(rules, RULES_LIMIT), "sig", "left")
    undecided = shapes.where(F.length("sig") == SIGNATURE_SYMBOLS).where(F.col("sig").rlike(_BEGINS)).join(rules, "sig", "left_anti").select("sig", F.lit(True).alias("undecided"))
    undecided = written(undecided, "log-undecided")
    if undecided.isEmpty():
        return known
    known = known.join(small(undecided, RULES_LIMIT), "sig", "left").withColumn("whole", F.when(F.col("undecided"), signature(F.col("line"), None)))
    longer = written(known.where("undecided").select(F.col("whole").alias("sig")).distinct(), "log-longer")
    more = resolve(longer).select(F.col("sig").alias("whole"), F.col("rule").alias("late"))
    return known.join(small(more, RULES_LIMIT), "whole", "left").withColumn("rule", F.coalesce("rule", "late"))


def level_of(raw: Column) -> Column:
    up = F.upper(F.trim(raw))
    out = F.lit("")
    for name, spellings in LEVELS.items():
        out = F.when(up.isin(*spellings), F.lit(name)).otherwise(out)
    return out


def ms_of_day(raw: Column) -> Column:
    """UTC milliseconds since midnight of a clock (24:xx counts as 00:xx, AM/PM and zone offsets honoured) or of epoch milliseconds."""
    part = lambda k: F.regexp_extract(raw, _CLOCK, k).cast("int")
    digits = F.regexp_extract(raw, r":\d\d(?: [AP]M)?[.,](\d+)", 1)
    ms = F.substring(F.concat(digits, F.lit("000")), 1, 3).cast("int")
    hour = F.when(F.instr(raw, "M") == 0, part(1) % 24).otherwise(part(1) % 12 + F.when(F.instr(raw, "PM") > 0, 12).otherwise(0))
    zone = lambda k: F.regexp_extract(raw, r"([+-])(\d\d):?(\d\d)$", k)
    shift = F.when(~raw.rlike(r"[+-]\d\d:?\d\d$"), F.lit(0)).otherwise((zone(2).cast("int") * 60 + zone(3).cast("int")) * F.when(zone(1) == "-", -60_000).otherwise(60_000))
    clock = F.pmod(hour * 3_600_000 + part(2) * 60_000 + part(3) * 1000 + ms - shift, F.lit(86_400_000)).cast("bigint")
    return F.when(raw.rlike(r"^\d{13}$"), F.pmod(raw.try_cast("bigint"), F.lit(86_400_000))).when(raw.rlike(_CLOCK), clock)


def clock_text(ms: Column) -> Column:
    """`HH:mm:ss.SSS` of milliseconds since midnight."""
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat(two(ms / 3_600_000), F.lit(":"), two(ms / 60_000 % 60), F.lit(":"), two(ms / 1000 % 60), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def _parsed(line: Column, rule: Column) -> Column:
    """struct(raw time, level, component, message) by the line's rule; null where the rule does not hold."""
    out = F.lit(None).cast("struct<raw:string,level:string,component:string,message:string>")

    def fields(raw: Column, level: Column, component: Column, message: Column) -> Column:
        return F.struct(raw.alias("raw"), level.alias("level"), component.alias("component"), message.alias("message"))

    keys = (*TIME_KEYS, *LEVEL_KEYS, *MODULE_KEYS, *TEXT_KEYS)
    record = F.from_json(line, ", ".join(f"{k} string" for k in keys))
    of = lambda names: F.coalesce(*(record[k] for k in names))
    bare = F.regexp_replace(line, _QUOTED, "")
    pair = lambda names, text: F.nullif(F.regexp_extract(text, rf"(?:^| )(?:{'|'.join(names)})=([^\s\"]+)", 1), F.lit(""))
    quoted = F.regexp_extract(line, rf"(?:^| )(?:{'|'.join(TEXT_KEYS)})=\"((?:[^\"\\]|\\.)*)\"", 1)
    self_told = {
        "json": fields(of(TIME_KEYS), F.coalesce(of(LEVEL_KEYS), F.lit("")), of(MODULE_KEYS), F.coalesce(of(TEXT_KEYS), line)),
        "pairs": fields(pair(TIME_KEYS, bare), F.coalesce(pair(LEVEL_KEYS, bare), F.lit("")), pair(MODULE_KEYS, bare), F.when(quoted == "", line).otherwise(F.regexp_replace(quoted, r'\\(["\\])', "$1"))),
    }
    for name, _, pattern, groups in reversed(LAYOUTS):
        if name in self_told:
            value = self_told[name]
        else:
            get = [F.regexp_extract(line, pattern, g) if g else F.lit("") for g in groups]
            value = fields(F.nullif(get[0], F.lit("")), get[1], get[2], F.regexp_replace(line, pattern, ""))
        out = F.when(rule == name, value).otherwise(out)
    return out


def log_entries(lines: DataFrame, message: bool = True) -> DataFrame:
    """One row per entry: session_id, line_no, last_line, tod, level, component[, message].

    lines: session_id, line_no, line and any other columns, which are ignored. Repeated rows count
    once. A null line is an empty one; a null session is a session of its own; rows with a null
    line_no have no place in a session and are left out; lines before the first entry belong to none.
    Two different lines under one number both belong to the entry, in the order of their text.
    message=False leaves out the text, so that it is neither shuffled nor collected.
    """
    base = lines.where(F.col("line_no").isNotNull()).select("session_id", "line_no", plain(F.col("line")).alias("line"))
    known = with_rules(base)
    # inline() is a plan node of its own, so a line is taken apart once, not once per field used.
    known = known.select("session_id", "line_no", "line", F.inline(F.array(_parsed(F.col("line"), F.col("rule"))))).withColumn("ms", ms_of_day(F.col("raw")))
    start = F.col("ms").isNotNull() & F.coalesce(F.col("component") != "", F.lit(False))
    slim = known.select(
        "session_id",
        "line_no",
        F.floor(F.col("line_no") / BLOCK_LINES).alias("block"),
        F.when(start, F.struct("ms", level_of(F.col("level")).alias("level"), "component")).alias("head"),
        *([F.when(start, F.col("message")).otherwise(F.col("line")).alias("line")] if message else []),
    )
    w = Window.partitionBy("session_id", "block").orderBy("line_no").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = slim.withColumn("start", F.max(F.when(F.col("head").isNotNull(), F.col("line_no"))).over(w))
    text = [F.collect_set(F.struct("line_no", "line")).alias("lines")] if message else []
    local = written(
        placed.groupBy("session_id", "block", "start").agg(F.max("line_no").alias("last_line"), F.max("head").alias("head"), *text),
        "log-blocks",
    )
    # The entry still open when a block begins: the last start of any earlier block of the session.
    earlier = Window.partitionBy("session_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = local.groupBy("session_id", "block").agg(F.max("start").alias("s")).select("session_id", "block", F.max("s").over(earlier).alias("carried"))
    orphan = (
        local.where(F.col("start").isNull())
        .alias("l")
        .join(carry.alias("c"), F.col("l.session_id").eqNullSafe(F.col("c.session_id")) & (F.col("l.block") == F.col("c.block")))
        .where(F.col("carried").isNotNull())
        .select("l.session_id", F.col("carried").alias("start"), "last_line", "head", *(["lines"] if message else []))
    )
    whole = local.where(F.col("start").isNotNull()).drop("block").unionByName(orphan)
    more = [F.flatten(F.collect_list("lines")).alias("lines")] if message else []
    entry = whole.groupBy("session_id", "start").agg(F.max("last_line").alias("last_line"), F.max("head").alias("head"), *more)
    out = [F.col("session_id"), F.col("start").alias("line_no"), F.col("last_line"), clock_text(F.col("head.ms")).alias("tod"), F.col("head.level"), F.col("head.component")]
    if message:
        out.append(F.array_join(F.transform(F.array_sort("lines"), lambda x: x["line"]), "\n").alias("message"))
    return entry.select(*out)
