"""Mixing sources to target shares of tokens.

Within a source documents are ordered by exponential keys divided by a quality weight
(Efraimidis-Spirakis); a budget is met by complete epochs first and then by the documents of the
smallest keys up to the rest. The prefix sum is found by narrowing an interval of keys with sums
per bucket, so no source is ever sorted as a whole. Budgets and intervals are tables of one row a
source; the driver holds two numbers.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.session import small, written

#: Folder of the public tokenizers, and the vocabulary that sizes are counted in.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
#: Splits text before the byte pairs are merged (fixed value of these vocabularies).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bits of a sampling key, and bits by which a round narrows an interval.
KEY_BITS, ROUND_BITS = 50, 10
#: Documents of an interval that may be ordered at once.
LAST = 50_000

_encoders: dict[str, object] = {}


def _encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def _sizes(name: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(SparkFiles.get(name)).encode_ordinary
        for b in batches:
            n = [len(encode(t)) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": n, "bytes": [len(t.encode("utf-8", "surrogatepass")) for t in b["text"]]})

    return run


def default_quality() -> Column:
    """Bytes per token over 4, within 0.1 to 1: text that the tokenizer breaks into crumbs weighs little."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.col("bytes") / F.greatest(F.col("tokens"), F.lit(1)) / 4))


def sized(documents: DataFrame, sources: DataFrame, id_col: str, text_col: str, source_col: str, tokenizer: str, quality: Column | None, seed: int) -> DataFrame:
    """(doc_id, source, tokens, key): documents of the listed sources with their size and sampling key; repeated ids count once.

    The vocabulary file travels to the executors with the job.
    """
    documents.sparkSession.sparkContext.addFile(tokenizer)
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull() & (F.coalesce(F.length("text"), F.lit(0)) > 0)).join(small(sources), "source", "left_semi")
    counted = rows.select("doc_id", "source", "text").mapInPandas(_sizes(os.path.basename(tokenizer)), "doc_id bigint, source string, tokens bigint, bytes bigint").groupBy("doc_id").agg(F.min(F.struct("source", "tokens", "bytes")).alias("r")).select("doc_id", "r.*").where("tokens > 0")
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    key = -F.log(uniform) / (default_quality() if quality is None else quality)
    # key / (1 + key) keeps the order and lies in 0 to 1; as a whole number it can be divided without rounding.
    return counted.withColumn("key", F.floor(key / (key + 1) * float(1 << KEY_BITS)).cast("bigint")).select("doc_id", "source", "tokens", "key")


def budgets(targets: DataFrame, sizes: DataFrame, total: float | None) -> DataFrame:
    """(source, size, max_repeat, budget) of the sources that have documents. targets: source, target_share, max_repeat; sizes: source, size.

    Without a total, the largest one at which every source with documents reaches its share; shares of
    sources without documents fall to the others in proportion. With a total, a source gives its share of it or all it may.
    """
    live = targets.join(sizes, "source").where("size > 0 and target_share > 0 and max_repeat > 0").withColumn("most", F.col("size") * F.col("max_repeat"))
    whole = live.agg(F.min(F.col("most") / F.col("target_share")).alias("reach"), F.sum("target_share").alias("shares")).first()
    total = (whole["reach"] or 0.0) if total is None else total / (whole["shares"] or 1.0)
    return live.select("source", "size", "max_repeat", F.least(F.col("target_share") * F.lit(float(total)), F.col("most").cast("double")).alias("budget"))


def intervals(docs: DataFrame, rest: DataFrame) -> DataFrame:
    """(source, lo, hi, left): documents of keys below lo fit wholly into the rest; those from lo to before hi hold the end of what is left.

    docs: source, tokens, key; rest: source, left. Each round sums the tokens of 2 ** ROUND_BITS buckets of every open interval.
    """
    state = rest.select("source", F.lit(0).cast("bigint").alias("lo"), F.lit(KEY_BITS).alias("bits"), F.col("left").cast("double").alias("left"), (F.col("left") > 0).alias("open"))
    while True:
        state = written(state, "mix-intervals")
        if state.where("open").isEmpty():
            return state.select("source", "lo", F.when(F.col("bits") < 0, F.col("lo")).otherwise(F.expr("lo + shiftleft(1L, bits)")).alias("hi"), "left")
        now = state.where("open").withColumn("step", F.greatest(F.col("bits") - ROUND_BITS, F.lit(0)))
        inside = docs.join(small(now.select("source", "lo", "bits", "step")), "source").where("key >= lo and key - lo < shiftleft(1L, bits)")
        sums = inside.groupBy("source", F.expr("shiftright(key - lo, step)").alias("bucket")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
        # One row a bucket, so a source has 2 ** ROUND_BITS of them at most.
        sums = sums.withColumn("upto", F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket")))
        ends = sums.join(small(now.select("source", "left")), "source").groupBy("source").agg(F.max("upto").alias("all"), F.min(F.when(F.col("upto") >= F.col("left"), F.struct("bucket", "tokens", "upto", "docs"))).alias("end"))
        found = F.col("end").isNotNull()
        after = now.join(ends, "source", "left").select(
            "source",
            F.when(found, F.expr("lo + shiftleft(cast(end.bucket as bigint), step)")).otherwise(F.expr("lo + shiftleft(1L, bits)")).alias("lo"),
            # Where all fits, the interval is empty.
            F.when(found, F.col("step")).otherwise(-1).alias("bits"),
            F.when(found, F.col("left") - F.col("end.upto") + F.col("end.tokens")).otherwise(F.col("left") - F.coalesce("all", F.lit(0))).alias("left"),
            F.coalesce(found & (F.col("end.docs") > LAST) & (F.col("step") > 0), F.lit(False)).alias("open"),
        )
        state = state.where("not open").unionByName(after)


def mix(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str | None = None, quality: Column | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares).

    chosen: doc_id, source, tokens, copies - every document used, at most max_repeat times. shares: source,
    target_share, documents, tokens, actual_share, one row per target source, with zeros where it has no documents.
    Null or unlisted sources, null or empty texts and null ids are not used. A source listed twice counts with
    its least share. The document at the end of a budget is used if that comes nearer to it.
    """
    listed = targets.where("source is not null").groupBy("source").agg(F.min(F.struct(F.coalesce("target_share", F.lit(0.0)).cast("double").alias("target_share"), F.coalesce("max_repeat", F.lit(0)).cast("int").alias("max_repeat"))).alias("t")).select("source", "t.*")
    listed = written(listed, "mix-targets")
    docs = written(sized(documents, listed.select("source"), id_col, text_col, source_col, tokenizer or os.path.join(TOKENIZERS, VOCABULARY), quality, seed), "mix-docs")
    plan = budgets(listed, docs.groupBy("source").agg(F.sum("tokens").alias("size")), total_tokens)
    plan = plan.withColumn("full", F.least(F.floor(F.col("budget") / F.col("size")).cast("int"), F.col("max_repeat")))
    plan = written(plan.select("source", "full", F.when(F.col("full") < F.col("max_repeat"), F.col("budget") - F.col("full") * F.col("size")).otherwise(0.0).alias("left")), "mix-budgets")
    ends = written(plan.select("source", "full").join(intervals(docs, plan.select("source", "left")), "source"), "mix-ends")
    marked = docs.join(small(ends), "source")
    last = marked.where("key >= lo and key < hi")
    outer = marked.where("not (key >= lo and key < hi)").withColumn("more", F.when(F.col("key") < F.col("lo"), 1).otherwise(0))
    up_to = F.sum("tokens").over(Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("sum", up_to).withColumn("more", F.when(F.col("sum") - F.col("tokens") / 2 <= F.col("left"), 1).otherwise(0)).drop("sum")
    chosen = outer.unionByName(last).withColumn("copies", (F.col("full") + F.col("more")).cast("int")).where("copies > 0").select("doc_id", "source", "tokens", "copies")
    return chosen, shares_of(chosen, listed)


def shares_of(chosen: DataFrame, listed: DataFrame) -> DataFrame:
    used = chosen.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    # The sum over all is one row, joined by a key that every row has.
    whole = used.agg(F.sum("tokens").alias("whole")).withColumn("one", F.lit(1))
    out = listed.select("source", "target_share", F.lit(1).alias("one")).join(used, "source", "left").join(F.broadcast(whole), "one", "left")
    return out.select("source", "target_share", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)), 6).alias("actual_share"))
