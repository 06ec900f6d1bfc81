"""Values cut at a field limit or in transfer.

Intact values are cut artificially to make positives; a logistic regression on hashed features of
how a value ends (its last shapes and characters, closing characters still due, sentence marks,
its distance to a length limit of its source) scores every record. The score alone decides.

The sample holds cut values too, unmarked. Each half of it is therefore scored by a regression fitted
on the other half, and what scores as cut leaves the intact values, some rounds long. The same
scores fix the threshold: the share of cut values follows from how many of the sample and how many
of the artificial cuts lie beyond a score, and the threshold is where the expected F1 is greatest.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.session import hash_sample, small

#: Values, about (never twice as many), that the regression is fitted on, and the longest of them in characters;
#: size of the feature space; artificial cuts of a value; rounds of cleaning, before and after the limits are known.
SAMPLE, SAMPLE_LONGEST, WIDTH, CUTS, ROUNDS = 16_000, 20_000, 1 << 18, 2, (1, 3)
#: Log odds from which a value of the sample is taken for cut when the sample is cleaned.
SURE = 0.7
#: A feature must occur so often in the sample; penalty on the squares of weights; steps of the fit.
LEAST, PENALTY, STEPS = 4, 3e-5, 100
#: A length may be a limit if it is so many times as frequent as its neighbours and occurs so often at all.
PEAK, PEAK_COUNT, NEAR = 4.0, 8, 6
#: A peak is a limit if so many values of the sample have that length and such a share of them scores as cut.
LIMIT_COUNT, LIMIT_SHARE = 6, 0.3
#: Share of the artificial cuts that the threshold may leave out.
MISSED = 0.1
#: Half the width over which values about a score are counted.
VALLEY = 0.75
#: Characters that are worked on as one array; characters of a block, about; width of a bin of log odds.
CHARS, BLOCK_CHARS, BIN = 4_000_000, 16_000_000, 0.01
#: Distance to a limit that is told apart.
REACH = 2
#: Characters at the end whose shapes are looked at.
TAIL = 60

# Marks that transfer or display may leave at a cut.
MARKS = ["…", "...", "�", "[...]", "[…]", "..", "-", "[truncated]", "(truncated)", "<...>"]

_PIECE = re.compile(r"\\[A-Za-z]+|\\.|\\$|[0-9]+(?:[.,][0-9]+)*|[^\W\d_㐀-鿿]+|[㐀-鿿]+|\S", re.S)
_BRACE = re.compile(r"\\.|[{}]", re.S)
_DIGIT = re.compile("[0-9]")
_LAST_WORD = re.compile(r"\\?[A-Za-z]+$")
_OWNER = re.compile(r"\\[A-Za-z]+$|[_^]$")
_WIDE = {0xFF01 + k: 0x21 + k for k in range(94) if chr(0x21 + k).isalnum()}
_WIDE.update(dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD]))


def _plain(text: str) -> str:
    return text if text.isascii() else text.translate(_WIDE)


def balances(texts: list[str]) -> np.ndarray:
    """Per text: braces, environments, lefts, brackets and displays still open at its end, whether a dollar is,
    words of three letters or more, other signs. A stray closing one opens nothing and closes nothing.

    All texts are worked on as one array of code points.
    """
    if not texts:
        return np.zeros((0, 8), np.int64)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    a = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    ends = starts + lengths - 1
    place = np.arange(len(a))
    slash = a == 92
    run = place - np.maximum.accumulate(np.where(slash, -1, place))
    escaped = np.concatenate(([False], (run[:-1] & 1) == 1))
    low = a | 32
    latin = (low >= 97) & (low <= 122)

    def has(*codes: str) -> np.ndarray:
        return np.logical_or.reduce([a == ord(c) for c in codes])

    def ahead(mask: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate((mask[k:], np.zeros(min(k, len(mask)), bool)))

    def command(name: str) -> np.ndarray:
        out = escaped & ~ahead(latin, len(name))
        for k, c in enumerate(name):
            out &= ahead(a == ord(c), k)
        return out

    def still_open(opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        level = np.cumsum(opens.astype(np.int32) - closes.astype(np.int32))
        base = np.concatenate(([0], level))[starts]
        lowest = np.minimum.reduceat(level, starts) - base
        return level[ends] - base - np.minimum(lowest, 0)

    def count(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.int64), starts)

    letter = latin | ((a >= 0xC0) & (a < 0x250))
    chinese = (a >= 0x3400) & (a < 0xA000)
    before = np.concatenate(([False], (letter | slash)[:-1]))
    words = letter & ~before & ahead(letter, 1) & ahead(letter, 2)
    return np.stack(
        [
            still_open(has("{") & ~escaped, has("}") & ~escaped),
            still_open(command("begin"), command("end")),
            still_open(command("left"), command("right")),
            still_open(has("(", "[", "（") & ~escaped, has(")", "]", "）") & ~escaped),
            still_open(has("[") & escaped, has("]") & escaped),
            count(has("$") & ~escaped) & 1,
            count(words) + count(chinese) // 2,
            count(~letter & ~chinese & (a > 32)),
        ],
        1,
    )


def _shape(piece: str) -> str:
    c = piece[0]
    if c == "\\":
        return piece
    if c.isdigit():
        return "9" if piece.isdigit() else "9.9"
    if c.isalpha():
        return "字" if "㐀" <= c <= "鿿" else "a" if len(piece) == 1 else "w"
    return c


def _owner(end: str) -> str:
    """Whose argument the group that closes a text is, and which: the command before its groups."""
    if not end.endswith("}"):
        return ""
    marks = [(m.start(), m.group()) for m in _BRACE.finditer(end) if len(m.group()) == 1]
    k, number = len(marks) - 1, 0
    if k < 0 or marks[k][0] != len(end) - 1:
        return ""
    while k >= 0:
        depth, number = 0, number + 1
        while k >= 0:
            depth += 1 if marks[k][1] == "}" else -1
            if not depth:
                break
            k -= 1
        if k < 0:
            break
        at = marks[k][0]
        before = end[max(0, at - 32) : at].rstrip()
        k -= 1
        if k < 0 or not before.endswith("}") or marks[k][1] != "}":
            m = _OWNER.search(before)
            return f"{m.group() if m else ''}:{number}"
    return "?"


_numbers: dict[str, int] = {}


def _number(name: str) -> int:
    n = _numbers.get(name)
    if n is None:
        if len(_numbers) > 500_000:
            _numbers.clear()
        n = _numbers[name] = zlib.crc32(name.encode("utf-8", "surrogatepass")) % (WIDTH - 1) + 1
    return n


def _names(text: str, balance: list[int], distance: int | None) -> list[str]:
    end = text.rstrip()
    pieces = _PIECE.findall(end[-TAIL:])[-7:]
    shapes = [_shape(p) for p in pieces]
    tails = [" ".join(shapes[-k:]) for k in range(1, len(shapes) + 1)]
    braces, envs, lefts, brackets, displays, dollar, words, signs = balance
    prose = int(words >= 6) + int(words >= 6 and words * 3 > signs)
    last = shapes[-1] if shapes else ""
    word = _LAST_WORD.search(end)
    word = word.group()[-14:] if word else ""
    limit = "no" if distance is None else str(distance)
    due = [("b", braces, 3), ("e", envs, 2), ("l", lefts, 2), ("k", brackets, 2), ("D", displays, 1), ("d", dollar, 1)]
    names = ["s" + t for t in tails]
    if any(c in "0123456789" for c in end[-4:]):
        # Numbers by the count of their digits, with what stands before and behind them.
        names += [f"n{k}:{_DIGIT.sub('9', ' '.join(pieces[-k:]))}" for k in (1, 2, 3)]
    names += [f"{kind}+" for kind, n, _ in due if n > 0]
    names += [f"{kind}{min(n, most)}" for kind, n, most in due]
    return names + [
        "due:" + "".join(kind for kind, n, _ in due if n > 0),
        f"limit:{limit}",
        f"limit:{limit}:{last}",
        f"limit:{limit}:{prose}",
        f"p{prose}",
        f"p{prose}:{last}",
        f"p{prose}:{tails[1] if len(tails) > 1 else last}.",
        f"pd{prose}{dollar}",
        f"c1:{end[-1:]}",
        f"c2:{end[-2:]}",
        f"c3:{end[-3:]}",
        f"c4:{end[-4:]}",
        f"pc{prose}:{end[-1:]}",
        f"w:{word}",
        f"cmd:{word[:1] == chr(92)}",
        f"own:{_owner(end)}",
        f"blank:{len(end) != len(text)}",
    ]


@dataclass
class Rows:
    """Hashed features of many values, one after the other (number 0 is the constant), and where each value's begin."""

    index: np.ndarray
    owner: np.ndarray
    n: int

    def take(self, mask: np.ndarray) -> Rows:
        keep = mask[self.owner]
        return Rows(self.index[keep], (np.cumsum(mask) - 1)[self.owner[keep]], int(mask.sum()))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Log odds of a cut."""
        return np.bincount(self.owner, weights[self.index], self.n)


def features(texts: list[str], distances: list[int | None]) -> Rows:
    texts = [_plain(t) for t in texts]
    numbers, at = [], 0
    while at < len(texts):
        # So many at once as hold some million characters, one at least.
        end, chars = at + 1, len(texts[at])
        while end < len(texts) and chars + len(texts[end]) <= CHARS:
            chars, end = chars + len(texts[end]), end + 1
        numbers += [[0, *map(_number, _names(t, b, d))] for t, b, d in zip(texts[at:end], balances(texts[at:end]).tolist(), distances[at:end])]
        at = end
    lengths = np.fromiter(map(len, numbers), np.int64, len(numbers))
    index = np.fromiter((k for row in numbers for k in row), np.int64, int(lengths.sum()))
    return Rows(index, np.repeat(np.arange(len(numbers)), lengths), len(numbers))


def fit(intact: Rows, cut: Rows) -> np.ndarray:
    """Weights of a logistic regression; both classes weigh the same."""
    if not intact.n or not cut.n:
        return np.zeros(WIDTH)
    n = intact.n + cut.n
    index, owner = np.concatenate((intact.index, cut.index)), np.concatenate((intact.owner, cut.owner + intact.n))
    used = np.flatnonzero(np.bincount(index, minlength=WIDTH) >= LEAST)
    column = np.full(WIDTH, -1)
    column[used] = np.arange(len(used))
    index = column[index]
    index, owner = index[index >= 0], owner[index >= 0]
    truth = np.repeat([0.0, 1.0], [intact.n, cut.n])
    share = np.repeat([n / 2 / intact.n, n / 2 / cut.n], [intact.n, cut.n])
    w, m, v = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used))
    for step in range(1, STEPS + 1):
        z = np.clip(np.bincount(owner, w[index], n), -30, 30)
        g = np.bincount(index, ((1 / (1 + np.exp(-z)) - truth) * share)[owner], len(used)) / n + PENALTY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    out = np.zeros(WIDTH)
    out[used] = w
    return out


def threshold(intact: np.ndarray, cut: np.ndarray, held: np.ndarray | None = None, made: np.ndarray | None = None) -> tuple[float, float]:
    """(score from which a value counts as cut, share of cut values), from scores of held-out values and artificial cuts.

    Beyond a score lie U of the values and P of the cuts. Where few intact values are left, U / P is the share
    of cut values; the F1 to be expected beyond a score is 2 share P / (U + share). At most MISSED of the cuts may lie below.
    That holds if true cuts score like artificial ones; where they score less, the valley between intact and cut values
    (the score with the fewest values about it) lies lower, and is taken. held, made: how often each score occurs, once if not given.
    """
    if not len(intact) or not len(cut):
        return 0.0, 0.0

    def sums(z: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(z, kind="stable")
        return z[order], np.concatenate(([0], np.cumsum(np.ones(len(z)) if n is None else n[order])))

    (intact, below), (cut, cut_below) = sums(intact, held), sums(cut, made)
    quantile = lambda q: np.interp(q * (cut_below[-1] - 1), cut_below[1:] - 1, cut)
    top = quantile(MISSED)
    grid = np.unique(quantile(np.linspace(0, MISSED, 101)))
    u, p = (1 - n[np.searchsorted(z, grid, "left")] / n[-1] for z, n in ((intact, below), (cut, cut_below)))
    share = float((u / p).min())
    best = float(grid[int(np.argmax(2 * share * p / (u + share + 1e-12)))])
    between = np.linspace(0, max(top, 0), 51)
    near = below[np.searchsorted(intact, between + VALLEY)] - below[np.searchsorted(intact, between - VALLEY)]
    return min(best, float(between[int(np.argmin(near))])), share


@dataclass
class Model:
    weights: np.ndarray
    at: float
    #: source -> its length limits
    limits: dict[str | None, list[int]]
    #: Share of cut values in the sample, and of artificial cuts found beyond the threshold (both held out).
    share: float = 0.0
    found: float = 0.0


def _distance(length: int, limits: list[int]) -> int | None:
    near = [length - k for k in limits if abs(length - k) <= REACH]
    return min(near, key=lambda d: (abs(d), d)) if near else None


def _artificial(text: str, limits: list[int], rng: random.Random) -> str:
    """The text cut at a limit it exceeds, or at a random place, at times with a mark."""
    body = text.rstrip()
    beyond = [k for k in limits if k < len(body)]
    if beyond and rng.random() < 0.5:
        return body[: rng.choice(beyond)]
    out = body[: rng.randrange(max(1, len(body) // 5), len(body))]
    return out + rng.choice(MARKS) if rng.random() < 0.15 else out


def _with_cuts(values: list[tuple[str | None, str]], limits: dict[str | None, list[int]], rng: random.Random) -> tuple[Rows, Rows]:
    cut = [(s, _artificial(t, limits.get(s, []), rng)) for s, t in values for _ in range(CUTS)]
    both = [features([t for _, t in some], [_distance(len(t), limits.get(s, [])) for s, t in some]) for some in (values, cut)]
    return both[0], both[1]


def _crossed(intact: Rows, cut: Rows, half: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of values and artificial cuts, each half by a regression fitted on the other."""
    z, zc, cut_half = np.zeros(intact.n), np.zeros(cut.n), np.repeat(half, CUTS)
    for side in (True, False):
        w = fit(intact.take((half == side) & alive), cut.take(cut_half == side))
        z[half != side], zc[cut_half != side] = intact.take(half != side).scores(w), cut.take(cut_half != side).scores(w)
    return z, zc


def train(values: list[tuple[str | None, str]], peaks: dict[str | None, list[int]], seed: int = 7) -> Model:
    """values: (source, text), as they are, cut ones among them. peaks: lengths that may be limits, by source."""
    values = [(s, t) for s, t in values if len(t.strip()) >= 4]
    rng = random.Random(seed)
    half = np.fromiter((rng.random() < 0.5 for _ in values), bool, len(values))

    def rows(limits: dict[str | None, list[int]]) -> tuple[Rows, Rows]:
        return _with_cuts(values, limits, rng)

    alive = np.ones(len(values), bool)
    limits: dict[str | None, list[int]] = {}
    z = zc = np.zeros(0)
    # The first pass knows no lengths: it shows which peaks hold cut values and which are only common lengths.
    for rounds in ROUNDS:
        limits = _confirmed(values, z, peaks) if len(z) else {}
        intact, cut = rows(limits)
        for _ in range(rounds):
            z, zc = _crossed(intact, cut, half, alive)
            alive = z < SURE
    at, share = threshold(z, zc)
    return Model(fit(intact.take(alive), cut), at, limits, share, float((zc >= at).mean()) if len(zc) else 0.0)


def _confirmed(values: list[tuple[str | None, str]], z: np.ndarray, peaks: dict[str | None, list[int]]) -> dict[str | None, list[int]]:
    at: dict[tuple[str | None, int], list[bool]] = {}
    for (s, t), score in zip(values, z.tolist()):
        at.setdefault((s, len(t)), []).append(score > 0)
    # A cut value may have lost a blank at its end, so the length itself is what counts here.
    held = lambda s, k: at.get((s, k), [])
    return {s: sorted(k for k in ks if len(held(s, k)) >= LIMIT_COUNT and sum(held(s, k)) >= LIMIT_SHARE * len(held(s, k))) for s, ks in peaks.items()}


def peaks(values: DataFrame) -> DataFrame:
    """(src, len): lengths at which values of a source pile up. values: src, len."""
    counts = values.groupBy("src", "len").count()
    w = Window.partitionBy("src").orderBy("len").rangeBetween(-NEAR, NEAR)
    near = counts.withColumn("around", F.sum("count").over(w) - F.col("count"))
    return near.where((F.col("count") >= PEAK_COUNT) & (F.col("count") > PEAK * F.col("around") / (2 * NEAR))).select("src", "len")


def _scored(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = shared.value
        for b in batches:
            distances = [None if d != d else int(d) for d in b["distance"].astype("float64")]
            yield b[["tbl", "src", "key1", "key2", "h1", "h2"]].assign(score=features(b["text"].tolist(), distances).scores(weights))

    return run


def _blind(shared):
    """(src, len, score): scores of values as if no lengths were known."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["src", "len"]].assign(score=features(b["text"].tolist(), [None] * len(b)).scores(shared.value))

    return run


def _block(shared, limits: dict[str | None, list[int]], seed: int):
    """What a block adds to the sums: (kind, k, w, n) with the weight of feature k times its count (kind 0), values and artificial cuts by bin k of their held-out log odds (1, 2)."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        values = sorted(((s, t) for s, t in zip(b["src"], b["text"]) if len(t.strip()) >= 4), key=lambda v: (v[0] or "", v[1]))
        rng = random.Random(seed)
        half = np.fromiter((rng.random() < 0.5 for _ in values), bool, len(values))
        intact, cut = _with_cuts(values, limits, rng)
        z, zc = _crossed(intact, cut, half, intact.scores(shared.value) < SURE)
        weights = fit(intact.take(z < SURE), cut)
        count = np.bincount(np.concatenate((intact.index, cut.index)), minlength=WIDTH)
        used = np.flatnonzero(weights)
        parts = [pd.DataFrame({"kind": 0, "k": used, "w": weights[used] * count[used], "n": count[used]})]
        for kind, scores in ((1, z), (2, zc)):
            k, n = np.unique(np.floor(scores / BIN).astype(np.int64), return_counts=True)
            parts.append(pd.DataFrame({"kind": kind, "k": k, "w": 0.0, "n": n}))
        return pd.concat(parts, ignore_index=True)

    return run


def refitted(rows: DataFrame, start: Model, blocks: int, seed: int = 7) -> Model:
    """The model of all values. rows: tbl, src, key1, key2, text, len. start: only says which values are clearly cut before the first fit.

    Limits are confirmed on all values of a common length. Each value stands in one block by its hash; a regression is fitted on
    every block, a weight is the mean over the blocks that have it, by count, and the threshold follows from the held-out scores of all blocks.
    """
    shared = rows.sparkSession.sparkContext.broadcast(start.weights)
    pile = peaks(rows.select("src", "len")).select(F.col("src").alias("s"), F.col("len").alias("l"))
    at_peak = rows.join(small(pile), rows["src"].eqNullSafe(F.col("s")) & (rows["len"] == F.col("l"))).select("src", "len", "text")
    held = at_peak.mapInPandas(_blind(shared), "src string, len int, score double").groupBy("src", "len").agg(F.count("*").alias("n"), F.count_if(F.col("score") > 0).alias("cut"))
    limits: dict[str | None, list[int]] = {}
    for s, n in sorted(map(tuple, held.where((F.col("n") >= LIMIT_COUNT) & (F.col("cut") >= LIMIT_SHARE * F.col("n"))).select("src", "len").collect()), key=lambda v: (v[0] or "", v[1])):
        limits.setdefault(s, []).append(n)
    keys = ["tbl", "src", "key1", "key2", "text"]
    parted = rows.select(F.pmod(F.xxhash64(*keys), F.lit(blocks)).alias("block"), *keys).repartition(blocks, "block").dropDuplicates(["block", *keys])
    sums = parted.groupBy("block").applyInPandas(_block(shared, limits, seed), "kind int, k int, w double, n bigint").groupBy("kind", "k").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).toPandas()
    mean, values, cuts = (sums[sums["kind"] == kind] for kind in range(3))
    weights = np.zeros(WIDTH)
    weights[mean["k"].to_numpy(np.int64)] = mean["w"] / mean["n"]
    z, zc, made = values["k"].to_numpy(float) * BIN, cuts["k"].to_numpy(float) * BIN, cuts["n"].to_numpy(float)
    at, share = threshold(z, zc, values["n"].to_numpy(float), made)
    return Model(weights, at, limits, share, float(made[zc >= at].sum() / max(made.sum(), 1)))


def scored(tables: DataFrame, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """(tbl, src, key1, key2, score, cut) of every distinct record. tables: tbl, src, key1, key2, text.

    A null text is no value and has no row; an empty one is scored like any other; repeated rows come out once.
    Null sources form a source of their own. Up to `sample` values are fitted at once; more of them, or values longer than
    SAMPLE_LONGEST, are fitted in blocks of about that size (see `refitted`), for which alone texts are shuffled.
    """
    spark = tables.sparkSession
    rows = tables.where("text is not null").withColumn("len", F.length("text"))
    taken = hash_sample(rows.where(F.col("len") <= SAMPLE_LONGEST).select("tbl", "src", "key1", "key2", "text"), sample, "tbl", "key1", "key2", "text").select("src", "text").collect()
    lengths = spark.createDataFrame(sorted({(r["src"], len(r["text"])) for r in taken}, key=str), "s string, l int")
    pile = peaks(rows.select("src", "len"))
    may: dict[str | None, list[int]] = {}
    for s, n in pile.join(F.broadcast(lengths), pile["src"].eqNullSafe(F.col("s")) & (pile["len"] == F.col("l"))).select("src", "len").collect():
        may.setdefault(s, []).append(n)
    model = train([(r["src"], r["text"]) for r in taken], may, seed)
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("chars"), F.max("len").alias("longest")).first()
    if total["n"] > sample or (total["longest"] or 0) > SAMPLE_LONGEST:
        model = refitted(rows, model, -(-max(total["n"] * BLOCK_CHARS, total["chars"] * sample) // (sample * BLOCK_CHARS)), seed)
    near = [(s, n + d, _distance(n + d, ks)) for s, ks in model.limits.items() for n in ks for d in range(-REACH, REACH + 1)]
    limits = small(spark.createDataFrame(sorted(set(near), key=str), "s string, l int, distance int"), 200_000)
    known = rows.join(limits, rows["src"].eqNullSafe(F.col("s")) & (rows["len"] == F.col("l")), "left").drop("s", "l")
    known = known.select("tbl", "src", "key1", "key2", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text", "distance")
    shared = spark.sparkContext.broadcast(model.weights)
    out = known.mapInPandas(_scored(shared), "tbl string, src string, key1 bigint, key2 bigint, h1 bigint, h2 bigint, score double")
    out = out.groupBy("tbl", "src", "key1", "key2", "h1", "h2").agg(F.max("score").alias("score")).drop("h1", "h2")
    return out.withColumn("cut", F.col("score") >= model.at)


def history_and_pages(history: DataFrame, pages: DataFrame) -> DataFrame:
    h = history.select(F.lit("history").alias("tbl"), F.col("source").alias("src"), F.col("id").cast("bigint").alias("key1"), F.lit(0).cast("bigint").alias("key2"), F.col("latex").alias("text"))
    p = pages.select(F.lit("pages_result").alias("tbl"), F.lit("pages_result").alias("src"), F.col("doc").cast("bigint").alias("key1"), F.col("page").cast("bigint").alias("key2"), F.col("latex").alias("text"))
    return h.unionByName(p)


def cut_records(records: DataFrame) -> DataFrame:
    """(tbl, key1, key2) of the cut records; rows without a key are left out."""
    return records.where("cut and key1 is not null and key2 is not null").select("tbl", "key1", "key2").distinct()


def cut_shares(records: DataFrame) -> DataFrame:
    """(tbl, src, records, cut, share) per source."""
    return records.groupBy("tbl", "src").agg(F.count("*").alias("records"), F.count_if("cut").alias("cut")).withColumn("share", F.round(F.col("cut") / F.col("records"), 6))
