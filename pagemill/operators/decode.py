"""Sequence decoding: softmax, argmax, collapse of repeated labels, top k, beams, tokens to text."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the decoder.
START, STOPS, MAX_STEPS = 2, (2, 0), 512
BEAMS, KEPT, FIRST_K, LATER_K, FIRST_STEPS, LEAST_P = 3, 5, 10, 5, 3, 0.01
FALLBACK_VOCABULARY = {0: "<pad>", 1: "<s>", 2: "</s>"}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: inside a lambda it would be computed for every element."""
    return F.transform(F.array(value), use)[0]


def softmax(a: Column) -> Column:
    """Probabilities of an array of scores, stable against large ones; an empty array stays empty."""
    powers = _let(F.array_max(a).cast("double"), lambda top: F.transform(a, lambda v: F.exp(v.cast("double") - top)))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    return _let(powers, lambda e: _let(total(e), lambda t: F.transform(e, lambda v: v / t)))


def argmax(a: Column) -> Column:
    """Place (from 0) of the greatest value; the first of several; null for an empty array."""
    return F.array_position(a, F.array_max(a)).cast("int") - 1


def top_k(p: Column, k: int, least: float = LEAST_P) -> Column:
    """array(struct(id, p)) of the k greatest values, down to the first below least; ties by place."""
    ranked = F.slice(F.array_sort(F.transform(p, lambda v, i: F.struct((-v).alias("n"), i.alias("i")))), 1, k)
    return F.transform(F.filter(ranked, lambda s: -s["n"] >= least), lambda s: F.struct(s["i"].alias("id"), (-s["n"]).alias("p")))


def collapse(steps: DataFrame, *keys: str) -> DataFrame:
    """steps (keys, t, id, v) without blanks (0) and repeats of the step before; a blank between two equal labels keeps both."""
    before = F.lag("id").over(Window.partitionBy(*keys).orderBy("t"))
    return steps.withColumn("before", before).where((F.col("id") > 0) & (F.col("before").isNull() | (F.col("before") != F.col("id")))).drop("before")


def label_text(emitted: DataFrame, symbols: DataFrame, n: int, *keys: str) -> DataFrame:
    """(keys, text, confidence): labels as text (n + 1 is a blank, greater ones nothing) and the mean of v over all emitted steps.

    symbols: id (from 1), ch; the dictionary of a recogniser, a few thousand rows.
    """
    from pagemill.session import small

    named = emitted.join(small(symbols.select("id", "ch")), "id", "left")
    ch = F.when(F.col("id") == n + 1, F.lit(" ")).when(F.col("id") <= n, F.coalesce("ch", F.lit(""))).otherwise(F.lit(""))
    out = named.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", ch.alias("c")))), lambda s: s["c"]), "").alias("text"), F.avg(F.col("v").cast("double")).alias("confidence"))
    return out.withColumn("text", clean(F.col("text")))


def clean(text: Column) -> Column:
    """Without line ends; control characters and blanks stripped at both ends."""
    return F.regexp_replace(F.translate(text, "\r\n", ""), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def token_text(tokens: DataFrame, vocabulary: DataFrame, *keys: str) -> DataFrame:
    """(keys, text): token ids in order of t as text. Unknown ids and <...> tokens vanish, word marks are blanks."""
    from pagemill.session import small

    named = tokens.join(small(vocabulary.select("id", "token")), "id").where(~F.col("token").rlike(r"^<.*>$"))
    piece = F.regexp_replace("token", r"^[Ġ▁]", " ")
    return named.groupBy(*keys).agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", piece.alias("s")))), lambda s: s["s"]), "")).alias("text"))


def ids_text(ids: Column) -> Column:
    """The ids themselves, for want of a vocabulary."""
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")


def geometric_mean(log_sum: Column, length: Column) -> Column:
    """exp of the mean log probability over the emitted tokens (one less than the length, which counts the start)."""
    return F.exp(log_sum / F.greatest(length - 1, F.lit(1)))


def distinct_sequences(beams: DataFrame, *keys: str) -> DataFrame:
    """The best beam of every distinct token sequence, the start token aside. beams: keys, beam, tokens, score."""
    w = Window.partitionBy(*keys, F.array_join(F.transform(F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(0))), lambda t: t.cast("string")), ",")).orderBy(F.col("score").desc(), "beam")
    return beams.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def prune(finished: DataFrame, active: DataFrame, *keys: str) -> DataFrame:
    """The beams that go on: the best BEAMS distinct active ones, with all finished before, KEPT of them by score."""
    w = lambda: Window.partitionBy(*keys).orderBy(F.col("score").desc(), "beam")
    best = distinct_sequences(active, *keys).withColumn("n", F.row_number().over(w())).where(F.col("n") <= BEAMS).drop("n")
    return finished.unionByName(best).withColumn("n", F.row_number().over(w())).where(F.col("n") <= KEPT).drop("n")


def best_beam(beams: DataFrame, *keys: str) -> DataFrame:
    """One beam per key: finished before unfinished, then by score, then by number."""
    w = Window.partitionBy(*keys).orderBy(F.col("finished").desc(), F.col("score").desc(), "beam")
    return beams.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def beam_search(step: Callable[[list[list[int]]], list[list[float]]], start: int = START, max_steps: int = MAX_STEPS) -> tuple[list[int], float]:
    """(tokens, confidence) by beam search over a decoder step: token prefixes in, scores of the next token out.

    Runs within a task for one image, as each step needs the one before.
    """
    beams: list[tuple[list[int], float, bool]] = [([start], 0.0, False)]
    for n in range(max_steps):
        live = [b for b in beams if not b[2]]
        if not live:
            break
        k = FIRST_K if n < FIRST_STEPS else LATER_K
        grown: dict[tuple[int, ...], tuple[list[int], float, bool]] = {}
        for (tokens, total, _), scores in zip(live, step([b[0] for b in live])):
            top = max(scores)
            e = [math.exp(s - top) for s in scores]
            whole = sum(e)
            for i in sorted(range(len(e)), key=lambda i: (-e[i], i))[:k]:
                p = e[i] / whole
                if p < LEAST_P:
                    break
                new = (tokens + [i], total + math.log(p), i in STOPS)
                key = tuple(new[0][1:])
                if key not in grown or grown[key][1] < new[1]:
                    grown[key] = new
        if not grown:
            break
        best = sorted(grown.values(), key=lambda b: -b[1])[:BEAMS]
        beams = sorted([b for b in beams if b[2]] + best, key=lambda b: -b[1])[:KEPT]
    tokens, total, _ = min(beams, key=lambda b: (not b[2], -b[1]))
    return tokens, math.exp(total / max(len(tokens) - 1, 1))


def decode_images(images: DataFrame, make_step: Callable[[object], Callable[[list[list[int]]], list[list[float]]]]) -> DataFrame:
    """(img, tokens, confidence) for images (img, state): make_step gives the decoder step for one image's state.

    The model itself is the caller's; it is loaded once per Python worker if make_step caches it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [beam_search(make_step(s)) for s in b["state"]]
            yield pd.DataFrame({"img": b["img"], "tokens": [t for t, _ in found], "confidence": [c for _, c in found]})

    return images.select("img", "state").mapInPandas(run, "img bigint, tokens array<bigint>, confidence double")
