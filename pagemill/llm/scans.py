"""Noise of scanned pages: split words, misread letters, running headers and page numbers.

Regions are put in reading order by image; texts of whole images (`mixed_result`, `text_result`) hold
their lines in order already and never shuffle. Page edges are the outermost lines. Page numbers are
edge lines of a number form, checked against the sequence of their document. Headers and footers are
edge lines that return on enough pages of their document: lines of one skeleton (letters that scanners
confuse fall together, digits and spacing drop out) count together, and so do lines whose skeletons
differ from a frequent one by little. The vocabulary is counted over the whole corpus; a split or
misread word is decided once per distinct word, by its joined form and its possible originals.

No window ever holds a whole image: lines are ordered within blocks of the page whose ends are stitched.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.lookalikes import normalised
from pagemill.session import dropped, small, written

# What a scanner reads (left) for what stands there (right).
CONFUSIONS = [
    ("c", "e"), ("e", "c"), ("f", "t"), ("o", "a"), ("b", "h"), ("ri", "n"), ("ii", "u"), ("rn", "m"), ("cl", "d"), ("vv", "w"), ("m", "rn"), ("n", "ri"), ("h", "b"), ("t", "f"), ("a", "o"), ("u", "ii"), ("d", "cl"), ("li", "h"),
    ("1", "i"), ("1", "l"), ("0", "o"), ("5", "s"), ("9", "g"), ("6", "b"), ("2", "z"), ("8", "b"), ("4", "a"), ("3", "e"), ("7", "t"), ("I", "l"), ("l", "i"), ("|", "l"),
]

#: An original is believed if it is at least so many times as frequent as the reading (so many times more for each letter
#: that a word is shorter than SHORT), and occurs so often at all. Texts of regions stand in mixed_result once more.
RATIO, SHORT, SHORTER, LEAST = 8, 4, 6, 6
#: Header and footer: pages at least, and share of the pages of the document that must be exceeded.
HEADER_PAGES, HEADER_SHARE = 3, 1 / 3
#: Lines at each end of a page that may be a header; letters of a skeleton per letter that may differ from a frequent one.
EDGE, PER_DIFFERENCE = 3, 8
#: Height of a block of a page in pixels.
BLOCK = 8192
#: Distinct decided words, and words of the vocabulary, that may be broadcast.
WORDS_LIMIT = 500_000

_HYPHENS = "-‐‑¬\u00ad"
_MARK = f"[{_HYPHENS}]"
_SPLIT = rf"([\p{{L}}\p{{N}}]+){_MARK}\s*$"
_HEAD = r"^\s*([\p{L}\p{N}]+)"
_WORD = r"[\p{L}\p{N}]+"
#: Stands for a formula among the lines of a text.
_FORMULA = "\u0001"

_NUMBER = re.compile(r"^\s*(?:[-–—\[(]\s*)?(?:(p\.|pp\.|page|seite|página|pág\.|s\.|第)\s*)?(\d{1,5})\s*(页|頁)?\s*(?:(?:/|of|von|de)\s*\d+)?\s*(?:[-–—\])])?\s*$", re.I)
_ROMAN = re.compile(r"^\W*([ivxlcdm]+)\W*$", re.I)
_ROMAN_FORM = re.compile(r"m{0,4}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})", re.I)
_BARE = re.compile(r"^\s*[\[(]?\s*\d+\s*[\])]?\s*$")


def roman(text: str) -> int | None:
    if not text or not _ROMAN_FORM.fullmatch(text):
        return None
    value = [dict(i=1, v=5, x=10, l=50, c=100, d=500, m=1000)[c] for c in text.lower()]
    return sum(-v if k + 1 < len(value) and v < value[k + 1] else v for k, v in enumerate(value))


def page_number(text: str) -> tuple[int | None, bool]:
    """(number, whether the form alone says that it is a page number) of a line that holds only one."""
    m = _NUMBER.match(text)
    if m:
        return int(m.group(2)), not _BARE.match(text)
    m = _ROMAN.match(text)
    if m:
        return roman(m.group(1)), False
    return None, False


#: Each character by itself, so that both sides of every confusion, whatever else is misread, come out equal (u, h and b, being ii and li, as two strokes).
_STROKES = {"e": "c", "3": "c", "a": "o", "0": "o", "4": "o", "f": "t", "7": "t", "1": "i", "l": "i", "|": "i", "9": "g", "5": "s", "2": "z", "h": "ii", "b": "ii", "6": "ii", "8": "ii", "u": "ii", "d": "ci", "n": "ri", "m": "rri", "w": "vv"}
_STROKE_TABLE = str.maketrans(_STROKES)
_BAR = re.compile(r"(?<=[^\W\d_])\|(?=[^\W\d_])")
_TOKEN = re.compile(r"[^\W_]+")


_ROMANS = frozenset("ivxlcdmIVXLCDM")


def skeleton(text: str) -> str:
    """What stays of a line that only differs in page number, case, spacing and misreadings: equal lines get equal skeletons.

    A token of digits (or a roman number at an end) is taken for the page number.
    """
    tokens = [t for t in _TOKEN.findall(_BAR.sub("l", text) if "|" in text else text) if not t.isdigit()]
    for end in (0, -1):
        if len(tokens) > 1 and tokens[end][0] in _ROMANS and tokens[end][-1] in _ROMANS and tokens[end] != "I" and roman(tokens[end]):
            tokens.pop(end)
    return "".join(tokens).lower().translate(_STROKE_TABLE)


# Lines.


def _half(text: Column) -> Column:
    """The half of a word that a line leaves at its end, else null; a look at its last sign spares most lines the pattern."""
    bare = F.rtrim(text)
    ends = bare.endswith(_HYPHENS[0])
    for mark in _HYPHENS[1:]:
        ends = ends | bare.endswith(mark)
    return F.when(ends, F.nullif(F.regexp_extract(text, _SPLIT, 1), F.lit("")))


def _hyphens_at_ends(text: Column) -> Column:
    # A soft hyphen is invisible within a line, but at its end it splits a word.
    return F.when(F.instr(text, "\u00ad") > 0, F.regexp_replace(text, "(?m)(?<=\\p{L})\u00ad([ \\t]*)$", "-$1")).otherwise(text)


def values_of(mixed: DataFrame | None, texts: DataFrame | None) -> DataFrame | None:
    """(tbl, rec, doc, page, lines): the texts of whole images in normal form; lines that are not blank, a formula as one mark."""
    parts = []
    if mixed is not None and "formatted_text" in mixed.columns:
        parts.append(mixed.select(F.lit("mixed_result").alias("tbl"), F.col("img").cast("bigint").alias("rec"), F.col("doc").cast("bigint").alias("doc"), F.col("page").cast("bigint").alias("page"), F.col("formatted_text").alias("text")))
    if texts is not None:
        none = F.lit(None).cast("bigint")
        parts.append(texts.select(F.lit("text_result").alias("tbl"), F.col("img").cast("bigint").alias("rec"), none.alias("doc"), none.alias("page"), "text"))
    if not parts:
        return None
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = out.where("rec is not null and text is not null").withColumn("text", _hyphens_at_ends(F.col("text")))
    out = normalised(out, "text", "text", fold=False)
    marked = F.when(F.instr("text", "$$") > 0, F.regexp_replace("text", r"(?ms)^\$\$$.*?^\$\$$", _FORMULA)).otherwise(F.col("text"))
    return out.select("tbl", "rec", "doc", "page", F.filter(F.split(marked, "\n"), lambda x: F.trim(x) != "").alias("lines"))


def _value_lines(values: DataFrame) -> DataFrame:
    body = values.select("tbl", "rec", F.filter("lines", lambda x: x != _FORMULA).alias("body"))
    rows = body.select("tbl", "rec", F.posexplode(F.arrays_zip("body", F.concat(F.array(F.lit(None).cast("string")), "body").alias("prev"))).alias("line", "z")).where("z.body is not null")
    return rows.select("tbl", "rec", F.col("line").cast("bigint").alias("line"), F.col("z.body").alias("text"), _half(F.col("z.prev")).alias("a"), F.col("rec").alias("a_rec"))


def _value_edges(values: DataFrame) -> DataFrame:
    places = F.transform("lines", lambda x, k: F.struct(x.alias("text"), (k + 1).alias("top"), (F.size("lines") - k).alias("bottom")))
    outer = F.filter(places, lambda s: ((s["top"] <= EDGE) | (s["bottom"] <= EDGE)) & (s["text"] != _FORMULA))
    return values.select("tbl", "rec", F.col("rec").alias("img"), "doc", "page", F.inline(outer))


def _region_lines(regions: DataFrame) -> DataFrame:
    """Region lines with block, places from both ends of the block, and the half of a word (a, a_rec) that the line before
    (formulas aside) leaves at its end. All windows share one order.

    Rows repeated in full count once. A null y or x counts as 0, an unknown type as text.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    rows = regions.where("text is not null and trim(text) <> '' and region_id is not null").select(F.col("region_id").cast("bigint").alias("rec"), F.col("img").cast("bigint").alias("img"), zero("y"), zero("x"), F.coalesce(F.col("type") == "formula", F.lit(False)).alias("formula"), _hyphens_at_ends(F.col("text")).alias("text"))
    rows = normalised(rows, "text", "text", fold=False).withColumn("block", F.floor(F.col("y") / BLOCK))
    part = Window.partitionBy("img", "block")
    order = part.orderBy("y", "x", "rec", "text")
    line = F.struct("rec", "y", "x", "text")
    rows = rows.withColumn("new", F.when(F.lag(line).over(order).eqNullSafe(line), 0).otherwise(1))
    halves = F.when(~F.col("formula"), F.struct(_half(F.col("text")).alias("a"), F.col("rec").alias("a_rec")))
    before = F.last(halves, True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"top": F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"), "all": F.sum("new").over(part).cast("int"), "before": F.when(F.col("new") == 1, before)})
    return rows.where("new = 1").withColumn("bottom", F.col("all") - F.col("top") + 1).drop("new", "all")


def _stitched(rows: DataFrame, several: DataFrame) -> DataFrame:
    """Lines of regions (no formulas); a word split at the end of a block goes on in the first line of the next block that has one."""
    body = rows.where("not formula")
    columns = ["tbl", "rec", "line", "text", "a", "a_rec"]
    plain = body.select(F.lit("regions").alias("tbl"), "rec", F.lit(0).cast("bigint").alias("line"), "text", "before", "before.*", "img", "block", "y", "x")
    # Only images of several blocks are stitched.
    tall, low = plain.join(several, "img", "left_semi"), plain.join(several, "img", "left_anti")
    ends = tall.groupBy("img", "block").agg(F.max(F.struct("y", "x", "rec", "text")).alias("end"))
    later = ends.select("img", "block", F.lag(F.struct(_half(F.col("end.text")).alias("a"), F.col("end.rec").alias("a_rec"))).over(Window.partitionBy("img").orderBy("block")).alias("earlier"))
    tall = tall.drop("a", "a_rec").join(later, ["img", "block"]).select("tbl", "rec", "line", "text", F.coalesce("before", "earlier").alias("e")).select("tbl", "rec", "line", "text", "e.*")
    return low.select(columns).unionByName(tall.select(columns))


def _region_edges(rows: DataFrame, several: DataFrame, pages: DataFrame | None) -> DataFrame:
    outer = rows.where((F.col("top") <= EDGE) | (F.col("bottom") <= EDGE)).select("rec", "img", "y", "x", "text", "top", "bottom", "formula", "block")
    low, tall = outer.join(several, "img", "left_anti").drop("block", "y", "x"), outer.join(several, "img", "left_semi")
    w = Window.partitionBy("img")
    tall = tall.withColumns({"top": F.row_number().over(w.orderBy("y", "x", "rec")), "bottom": F.row_number().over(w.orderBy(F.desc("y"), F.desc("x"), F.desc("rec")))}).drop("block", "y", "x")
    out = low.unionByName(tall).where(((F.col("top") <= EDGE) | (F.col("bottom") <= EDGE)) & ~F.col("formula")).drop("formula")
    if pages is None:
        out = out.withColumns({"doc": F.lit(None).cast("bigint"), "page": F.lit(None).cast("bigint")})
    else:
        out = out.join(pages, "img", "left")
    return out.select(F.lit("regions").alias("tbl"), "rec", "img", "doc", "page", "text", "top", "bottom")


# Headers and page numbers.


def _edge_marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [page_number(t) for t in b["text"]]
        b["number"] = pd.array([n for n, _ in found], dtype="Int64")
        b["sure"] = [s for _, s in found]
        b["key"] = [skeleton(t) if n is None else "" for t, (n, _) in zip(b["text"], found)]
        yield b[["tbl", "rec", "img", "doc", "page", "top", "bottom", "number", "sure", "key"]][[n is not None or len(k) >= 4 for (n, _), k in zip(found, b["key"])]]


_EDGE_ROW = "tbl string, rec bigint, img bigint, doc bigint, page bigint, top int, bottom int, number bigint, sure boolean, key string"


def header_keys(named: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, key): skeletons of headers. named: doc, page, key of edge lines; pages: doc, pages.

    Keys near a frequent one (on two pages and a twelfth of the document at least, so less than 12 * 2 * EDGE
    of them in a document) count with it: at most one difference for PER_DIFFERENCE letters.
    """
    counted = written(named.groupBy("doc", "key").agg(F.countDistinct("page").alias("n")).join(pages, "doc"), "scan-keys")
    enough = lambda n: (F.col(n) >= HEADER_PAGES) & (F.col(n) > F.col("pages") * HEADER_SHARE)
    seeds = counted.where("n >= 2 and n * 12 >= pages").select("doc", F.col("key").alias("seed"))
    far = F.floor(F.length("seed") / PER_DIFFERENCE).cast("int")
    near = F.abs(F.length("seed") - F.length("key")) <= far
    pairs = counted.select("doc", "key").join(seeds, "doc").where(near & (F.levenshtein("seed", "key") <= far))
    wide = pairs.where("seed <> key").select("doc", "seed").distinct()
    # Where a seed has near keys, its pages are counted with theirs.
    joint = named.join(pairs.join(wide, ["doc", "seed"]), ["doc", "key"]).groupBy("doc", "seed").agg(F.countDistinct("page").alias("n")).join(pages, "doc").where(enough("n")).select("doc", "seed")
    return counted.where(enough("n")).select("doc", "key").unionByName(pairs.join(joint, ["doc", "seed"], "left_semi").select("doc", "key")).distinct()


def furniture(edges: DataFrame, pages: DataFrame, spent: Iterable[DataFrame] = ()) -> DataFrame:
    """(tbl, rec, top, noise): page numbers and headers among the edge lines. pages: doc, pages. spent: written tables that
    only edges still reads; they are dropped.

    A page number may stand within headers; in a document at least two pages must show the same step from page to
    number, unless the form is sure or the document has fewer than two numbered pages.
    """
    at_edge = written(edges.mapInPandas(_edge_marks, _EDGE_ROW), "scan-edges")
    dropped(*spent)
    keys = small(written(header_keys(at_edge.where("doc is not null and key <> ''").select("doc", "page", "key"), pages), "scan-headers"))
    marked = written(at_edge.join(keys.withColumn("header", F.lit(True)), ["doc", "key"], "left").where("header or number is not null").withColumn("header", F.coalesce("header", F.lit(False))), "scan-marked")
    dropped(at_edge)
    w = Window.partitionBy("tbl", "img")
    # Headers outside a line: if they are all that lies there, the line is outermost.
    within = lambda place: F.coalesce(F.sum(F.col("header").cast("int")).over(w.orderBy(place).rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)) == F.col(place) - 1
    outer = marked.withColumn("outer", within("top") | within("bottom")).where("outer and number is not null").withColumn("step", F.col("number") - F.col("page"))
    steps = outer.where("doc is not null").groupBy("doc", "step").agg(F.countDistinct("page").alias("n"))
    known = outer.where("doc is not null").groupBy("doc").agg(F.countDistinct("page").alias("numbered"))
    numbers = outer.join(steps, ["doc", "step"], "left").join(known, "doc", "left").where("doc is null or sure or n >= 2 or numbered < 2")
    return numbers.select("tbl", "rec", "top", F.lit("pageno").alias("noise")).unionByName(marked.where("header").select("tbl", "rec", "top", F.lit("header").alias("noise"))).distinct()


# Words.


def originals(word: str) -> set[tuple[str, int]]:
    """Words (lower case) that a scanner may have read as this one, and where the misreading stands."""
    out = set()
    low = word.lower()
    for seen, real in CONFUSIONS:
        shouted = seen == "I"
        if len(word) < 2 or (shouted and word.isupper()):
            continue
        text = word if shouted else low
        at = text.find(seen, 1 if shouted else 0)
        while at >= 0:
            out.add(((text[:at] + real + text[at + len(seen) :]).lower(), at))
            at = text.find(seen, at + 1)
    return out


def _needed(length: Column, own: Column) -> Column:
    """How often an original must occur to be believed beside a reading of this length that occurs `own` times."""
    return F.greatest(F.lit(LEAST), own * RATIO * F.pow(F.lit(SHORTER), F.greatest(F.lit(SHORT) - length, F.lit(0))))


def _single_lookups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(a, own, at, o) for a, own in zip(b["a"], b["own"].tolist()) if any(x.isalpha() for x in a) for o, at in originals(a)]
        yield pd.DataFrame(rows, columns=["a", "own", "at", "word"])


def _pair_lookups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for a, c in zip(b["a"], b["b"]):
            word = a + c
            rows += [(a, c, "self", 0, word.lower()), (a, c, "compound", 0, f"{a}-{c}".lower()), (a, c, "left", 0, a.lower()), (a, c, "right", 0, c.lower())]
            rows += [(a, c, "original", at, o) for o, at in originals(word)]
        yield pd.DataFrame(rows, columns=["a", "b", "kind", "at", "word"])


def misread_words(vocabulary: DataFrame) -> DataFrame:
    """(a, original, at) of the words with a likelier original. vocabulary: word (lower case), n, forms (as written); a written table."""
    top = vocabulary.agg(F.max("n").alias("n")).first()["n"] or 0
    rare = vocabulary.where(F.size("forms") > 0).where(F.col("n") * RATIO <= top).select(F.explode("forms").alias("a"), F.col("n").alias("own"))
    frequent = small(vocabulary.where(F.col("n") >= LEAST).select("word", "n"), WORDS_LIMIT)
    looked = rare.mapInPandas(_single_lookups, "a string, own bigint, at int, word string").join(frequent, "word")
    looked = looked.where(F.col("n") >= _needed(F.length("a"), F.col("own")))
    return looked.groupBy("a").agg(F.max(F.struct("n", "word", "at")).alias("best")).select("a", F.col("best.word").alias("original"), F.col("best.at").alias("at"))


def split_words(pairs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(a, b, split, original, at) of the pairs of halves with something wrong.

    split: the halves are one word that the scan split (and not a compound broken at its own hyphen).
    original: the word that was misread, or null; at: where.
    """
    looked = pairs.select("a", "b").distinct().mapInPandas(_pair_lookups, "a string, b string, kind string, at int, word string").join(small(vocabulary.select("word", "n"), WORDS_LIMIT), "word")
    n = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    best = F.max(F.when(F.col("kind") == "original", F.struct("n", "word", "at")))
    d = looked.groupBy("a", "b").agg(n("self").alias("own"), n("compound").alias("compound"), n("left").alias("left"), n("right").alias("right"), best.alias("best"))
    wrong = (F.col("best.n") >= _needed(F.length("a") + F.length("b"), F.col("own"))) & (F.col("best.n") > F.col("compound"))
    split = (F.col("own") > F.col("compound")) | ((F.col("compound") == 0) & (F.coalesce(wrong, F.lit(False)) | ~((F.col("left") >= LEAST) & (F.col("right") >= LEAST))))
    d = d.select("a", "b", split.alias("split"), F.when(wrong, F.col("best.word")).alias("original"), F.when(wrong, F.col("best.at")).alias("at"))
    return d.where(F.col("split") | F.col("original").isNotNull())


#: ASCII signs that are no letters or digits.
_SIGNS = "".join(chr(k) for k in range(1, 127) if not chr(k).isalnum() and k != 32)


class ScanNoise:
    """The parts of an analysis that reports and repairs share; each is written once."""

    def __init__(self, regions: DataFrame | None, mixed: DataFrame | None, texts: DataFrame | None) -> None:
        self.regions, self.mixed, self.texts = regions, mixed, texts
        paged = None
        lines, edges, spent = [], [], []
        if mixed is not None:
            paged = mixed.where("img is not null and doc is not null and page is not null").groupBy(F.col("img").cast("bigint").alias("img")).agg(F.min(F.struct(F.col("doc").cast("bigint").alias("doc"), F.col("page").cast("bigint").alias("page"))).alias("p")).select("img", "p.*")
            paged = written(paged, "scan-pages")
        if regions is not None:
            rows = written(_region_lines(regions), "scan-regions")
            spent.append(rows)
            several = small(rows.where("block <> 0").select("img").distinct())
            lines.append(_stitched(rows, several))
            edges.append(_region_edges(rows, several, small(paged) if paged is not None else None))
        values = values_of(mixed, texts)
        if values is not None:
            values = written(values, "scan-values")
            spent.append(values)
            lines.append(_value_lines(values))
            edges.append(_value_edges(values))
        union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        self.lines = written(self._words(union(lines)), "scan-lines")
        pages = paged.groupBy("doc").agg(F.countDistinct("page").alias("pages")) if paged is not None else self.lines.sparkSession.createDataFrame([], "doc bigint, pages bigint")
        self.furniture = written(furniture(union(edges), pages, spent), "scan-furniture")
        singles = self.lines.select(F.explode("words").alias("a")).where("a <> ''").groupBy("a").count()
        compounds = self.lines.select(F.explode("compounds").alias("a")).groupBy("a").count()
        halves = singles.select(F.lower("a").alias("word"), "a", "count").unionByName(compounds.select(F.lower("a").alias("word"), F.lit(None).cast("string").alias("a"), "count"))
        self.vocabulary = written(halves.groupBy("word").agg(F.sum("count").alias("n"), F.collect_set("a").alias("forms")), "scan-vocabulary")
        self.pairs = self.lines.where("b is not null").select("tbl", F.col("a_rec").alias("rec"), (F.col("line") - 1).alias("line"), "a", "b", F.col("rec").alias("next_rec"))
        self.misread = written(misread_words(self.vocabulary), "scan-misread")
        self.split = written(split_words(self.pairs, self.vocabulary), "scan-split")

    @staticmethod
    def _words(lines: DataFrame) -> DataFrame:
        """(tbl, rec, line, a, a_rec, b, words, compounds): lines with their whole words and compounds, and the halves of a word
        split at the end of the line before (a, in record a_rec) and going on here (b). Halves are no words of their own.
        """
        text, half = F.col("text"), F.col("half")
        lines = lines.withColumns({"half": _half(text), "b": F.when(F.col("a").rlike(r"\p{L}$"), F.nullif(F.regexp_extract(text, _HEAD, 1), F.lit("")))})
        whole = F.when(F.col("b").isNotNull(), F.regexp_replace(text, _HEAD, "")).otherwise(text)
        whole = F.when(half.isNotNull(), F.regexp_replace(whole, _SPLIT, "")).otherwise(whole)
        found = lambda t: F.regexp_extract_all(t, F.lit(_WORD), F.lit(0))
        # Cutting at blanks, with empty words between, is far cheaper than a pattern; most lines are plain and whole.
        plain = F.split(F.translate(text, _SIGNS, " " * len(_SIGNS)), " ")
        words = F.when(half.isNotNull() | F.col("b").isNotNull(), found(whole)).when(F.octet_length(text) == F.char_length(text), plain).otherwise(found(text))
        compounds = F.when(F.instr(text, "-") > 0, F.regexp_extract_all(text, F.lit(r"\p{L}+-\p{L}+"), F.lit(0)))
        return lines.select("tbl", "rec", "line", "a", "a_rec", "b", words.alias("words"), compounds.alias("compounds"))

    def word_noise(self) -> DataFrame:
        """(tbl, rec, noise) of split and misread words."""
        single = small(self.misread.select("a"), WORDS_LIMIT)
        misread = self.lines.select("tbl", "rec", F.explode("words").alias("a")).join(single, "a", "left_semi").select("tbl", "rec", F.lit("misread").alias("noise"))
        pair = self.pairs.join(small(self.split, WORDS_LIMIT), ["a", "b"])
        # A misreading in the second half belongs to the record of the next line.
        place = F.when(F.col("at") < F.length("a"), F.col("rec")).otherwise(F.col("next_rec"))
        found = F.array_compact(F.array(F.when(F.col("split"), F.struct("rec", F.lit("hyphen").alias("noise"))), F.when(F.col("original").isNotNull(), F.struct(place.alias("rec"), F.lit("misread").alias("noise")))))
        return misread.unionByName(pair.select("tbl", F.inline(found)))

    def found(self) -> DataFrame:
        """(tbl, rec_id, noise), one row per record and kind of noise."""
        own = self.word_noise().unionByName(self.furniture.select("tbl", "rec", "noise"))
        return own.select("tbl", F.col("rec").alias("rec_id"), "noise").distinct()

    def repaired(self) -> DataFrame:
        """(tbl, rec_id, text): every record without headers and page numbers, split words joined, misread words replaced.

        Whole images come out as paragraphs: lines run on, formulas stand apart between $$ marks. A region comes out
        by itself, with the whole of a word split at its end and without the rest of one split before; where nothing but
        noise was in it, with an empty text. Null texts have no row, repeated rows come out once.
        """
        word = F.struct(F.col("a"), F.lit(None).cast("string").alias("b"), F.col("original"), F.lit(None).cast("bigint").alias("line"), F.lit("word").alias("kind"))
        words = self.lines.select("tbl", "rec", F.explode("words").alias("a")).join(small(self.misread.select("a", "original"), WORDS_LIMIT), "a").select("tbl", "rec", word.alias("fix"))
        pair = self.pairs.join(small(self.split.where("split").select("a", "b", "original"), WORDS_LIMIT), ["a", "b"])
        fix = lambda kind: F.struct("a", "b", F.coalesce("original", F.concat("a", "b")).alias("original"), "line", F.lit(kind).alias("kind"))
        first = pair.select("tbl", "rec", fix("split").alias("fix"))
        second = pair.where("tbl = 'regions'").select("tbl", F.col("next_rec").alias("rec"), fix("rest").alias("fix"))
        none = F.lit(None).cast("string")
        gone = self.furniture.select("tbl", "rec", F.struct(none.alias("a"), none.alias("b"), none.alias("original"), F.col("top").cast("bigint").alias("line"), F.lit("gone").alias("kind")).alias("fix"))
        fixes = words.unionByName(first).unionByName(second).unionByName(gone).groupBy("tbl", "rec").agg(F.collect_set("fix").alias("fixes"))
        parts = []
        if self.regions is not None:
            parts.append(self.regions.where("region_id is not null and text is not null").select(F.lit("regions").alias("tbl"), F.col("region_id").cast("bigint").alias("rec"), F.when(F.col("type") != "formula", _hyphens_at_ends(F.col("text"))).otherwise(F.col("text")).alias("text")).distinct())
        if self.mixed is not None and "formatted_text" in self.mixed.columns:
            parts.append(self.mixed.where("img is not null and formatted_text is not null").select(F.lit("mixed_result").alias("tbl"), F.col("img").cast("bigint").alias("rec"), _hyphens_at_ends(F.col("formatted_text")).alias("text")))
        if self.texts is not None:
            parts.append(self.texts.where("img is not null and text is not null").select(F.lit("text_result").alias("tbl"), F.col("img").cast("bigint").alias("rec"), _hyphens_at_ends(F.col("text")).alias("text")))
        records = parts[0]
        for p in parts[1:]:
            records = records.unionByName(p)
        records = normalised(records, "text", "text", fold=False).join(fixes, ["tbl", "rec"], "left")
        return records.mapInPandas(_repairs, "tbl string, rec_id bigint, text string")


def _repairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = []
        for tbl, text, fixes in zip(b["tbl"], b["text"], b["fixes"]):
            by: dict[str, list] = {"word": [], "split": [], "rest": [], "gone": []}
            for f in fixes if fixes is not None else ():
                by[f["kind"]].append(f)
            words = {f["a"]: f["original"] for f in by["word"]}
            if tbl == "regions":
                texts.append("" if by["gone"] else _line(text, words, by["split"][0] if by["split"] else None, bool(by["rest"])))
            else:
                texts.append(_paragraphs(text, words, {int(f["line"]): f for f in by["split"]}, {int(f["line"]) for f in by["gone"]}))
        yield pd.DataFrame({"tbl": b["tbl"], "rec_id": b["rec"], "text": texts})


def _line(text: str, words: dict[str, str], split, rest: bool) -> str:
    """A line with its misread words replaced, the rest of a word split before it gone, the word split at its end whole."""
    if rest:
        text = re.sub(r"^\s*[^\W_]+", "", text).lstrip()
    if words:
        text = _TOKEN.sub(lambda m: _cased(words[m.group()], m.group()) if m.group() in words else m.group(), text)
    if split is not None:
        text = re.sub(rf"{re.escape(split['a'])}{_MARK}\s*$", lambda m: _cased(split["original"], split["a"]), text)
    return text


def _paragraphs(text: str, words: dict[str, str], splits: dict[int, object], gone: set[int]) -> str:
    """Lines of a whole text run on. splits: by number of the line among those that are no formula; gone: by place from the top (1)."""
    out: list[str] = []
    now, formula, number, place, rest = "", None, 0, 0, False

    def close() -> None:
        nonlocal now
        if now:
            out.append(now)
        now = ""

    for line in text.split("\n"):
        if formula is not None:
            formula.append(line)
            if line == "$$":
                out.append("\n".join(formula))
                formula = None
            continue
        if line == "$$":
            close()
            formula, place = [line], place + 1
            continue
        if not line.strip(" "):
            continue
        place += 1
        split = splits.get(number)
        number += 1
        if place in gone:
            continue
        piece = _line(line.strip(), words, split, rest)
        wide = now and piece and "⺀" <= now[-1] <= "￯" and "⺀" <= piece[0] <= "￯"
        # What is left of a line behind the rest of a split word may begin with its punctuation.
        tight = wide or not now or not piece or (rest and not piece[:1].isalnum() and piece[:1] not in "([{$“„«")
        now += ("" if tight else " ") + piece
        rest = split is not None
    if formula is not None:
        out.append("\n".join(formula))
    close()
    return "\n\n".join(out)


def _cased(word: str, like: str) -> str:
    if len(like) > 1 and like.isupper():
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() else word
