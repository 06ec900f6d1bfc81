"""Records that differ only in formatting: canonical bytes, recursive radix partitioning, tries.

1. Every value gets canonical bytes (`canonical`) and their 128-bit digest. Equal bytes mean equal records.
2. Partial counts are formed where the rows lie, so a hot record reaches the shuffle as a few
   partial rows, however many copies it has.
3. Radix partitioning on the canonical bytes: a bucket is a byte prefix. Buckets with more partial
   rows than `CAPACITY` are split by the bytes after their longest common prefix (the common prefix
   of the least and the greatest key), again and again, until each fits or holds one key only. Which
   buckets are split, and where, is a table; the driver only learns whether there are any.
4. A task reads its buckets one after the other and counts each in a trie whose terminal nodes hold
   the number of copies and the smallest id.
5. Copies find their set by the digest, so texts are shuffled once, and only as partial rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import small, written

#: Partial rows a bucket may hold.
CAPACITY = 50_000
#: Bytes by which an oversized bucket is split behind its common prefix.
RADIX = 2
#: Keys held by the partial counts of a task before they are passed on.
PARTIAL_KEYS = 20_000
#: A record with at least this many copies counts as hot when copies are attached to it.
HOT_COPIES = 20_000
#: Hot records (digest and id) that may be broadcast; there are at most rows / HOT_COPIES. More are joined over SALT parts.
HOT_LIMIT, SALT = 500_000, 32

# TeX spacing, math delimiters and sentence marks that do not tell records apart.
_SPACE = re.compile(r"(\\\\)|\\[,;:! ]|\\q?quad(?![A-Za-z])|\\[\[\]]|[~$\s]")
_MARKS = ".,;:?!，。；：？！、"
_PUNCTUATION = re.compile(rf"(?<![0-9])[{_MARKS}]+|[{_MARKS}]+(?![0-9])")
_ITEM = r"[^()=,;]+=[^()=,;]+"
_CLOSING_LIST = re.compile(rf"\(({_ITEM}(?:[,;]{_ITEM})*)\)([{_MARKS}]*)$")


def canonical(text: str) -> str:
    """The text without white space, TeX spacing, math delimiters, sentence punctuation (except between
    digits) and letter case, and with the items of a closing (name=value, ...) list in order.

    A row break (two backslashes) stays. Punctuation is judged after white space is gone.
    """
    out = _SPACE.sub(lambda m: m.group(1) or "", text).lower()
    tail = _CLOSING_LIST.search(out)
    if tail:
        out = out[: tail.start()] + "(" + ",".join(sorted(re.split("[,;]", tail.group(1)))) + ")"
    return _PUNCTUATION.sub("", out)


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        keys = [canonical(t).encode("utf-8", "surrogatepass") for t in b["text"]]
        yield pd.DataFrame({"id": b["id"], "key": keys, "digest": [xxhash.xxh3_128_digest(k) for k in keys]})


def keyed(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, digest) of every distinct (id, canonical form); rows whose id or text is null are no copies of anything and are left out.

    A written table. Only rows whose id occurs more than once are shuffled to find those that repeat.
    """
    rows = records.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    keys = written(rows.mapInPandas(_keys, "id bigint, key binary, digest binary"), "copy-rows")
    repeated = written(keys.groupBy("id").count().where("count > 1").select("id"), "copy-repeated")
    if repeated.isEmpty():
        return keys
    repeated = small(repeated)
    return written(keys.join(repeated, "id", "left_anti").unionByName(keys.join(repeated, "id", "left_semi").distinct()), "copy-keys")


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[bytes, list] = {}

    def flush() -> pd.DataFrame:
        out = pd.DataFrame([(k, *v) for k, v in held.items()], columns=["digest", "key", "keep", "n"])
        held.clear()
        return out

    for b in batches:
        for i, k, d in zip(b["id"].tolist(), b["key"], b["digest"]):
            v = held.get(d)
            if v is None:
                held[d] = [k, i, 1]
            else:
                v[2] += 1
                if i < v[1]:
                    v[1] = i
        if len(held) > PARTIAL_KEYS:
            yield flush()
    if held:
        yield flush()


def _depths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        depth = [max(len(os.path.commonprefix([bytes(lo), bytes(hi)])), len(bucket)) + RADIX for bucket, lo, hi in zip(b["bucket"], b["lo"], b["hi"])]
        yield pd.DataFrame({"bucket": b["bucket"], "depth": depth})


def bucketed(partials: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """partials with their bucket. partials: a written table with a column key."""
    # Empty, but not a constant: the join below shall stay one of equal buckets.
    placed = partials.withColumn("bucket", F.substring("key", F.lit(1), F.lit(0)))
    while True:
        sizes = placed.groupBy("bucket").agg(F.count("*").alias("rows"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        over = written(sizes.where((F.col("rows") > capacity) & (F.col("lo") != F.col("hi"))).select("bucket", "lo", "hi").mapInPandas(_depths, "bucket binary, depth int"), "copy-split")
        if over.isEmpty():
            return placed
        deeper = F.substring("key", F.lit(1), F.col("depth"))
        # A key that ends within the common prefix gets a bucket of its own beside the longer keys.
        ended = F.concat("bucket", F.lit(b"\x00end"))
        placed = placed.join(small(over), "bucket", "left").withColumn("bucket", F.when(F.col("depth").isNull(), F.col("bucket")).when(F.octet_length("key") <= F.octet_length("bucket"), ended).otherwise(deeper)).drop("depth")


class Trie:
    """Radix trie over byte strings; a terminal node holds [smallest id, copies]."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: list = [{}, None]

    def add(self, key: bytes, keep: int, n: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            edge = node[0].get(key[at])
            if edge is None:
                leaf = [{}, [keep, n]]
                node[0][key[at]] = [key[at:], leaf]
                return
            label, child = edge
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            cut = len(os.path.commonprefix([label, key[at : at + len(label)]]))
            middle = [{label[cut]: [label[cut:], child]}, None]
            edge[0], edge[1] = label[:cut], middle
            node, at = middle, at + cut
        if node[1] is None:
            node[1] = [keep, n]
        else:
            node[1][0] = min(node[1][0], keep)
            node[1][1] += n

    def terminals(self) -> Iterator[tuple[bytes, int, int]]:
        stack = [(b"", self.root)]
        while stack:
            prefix, (edges, end) = stack.pop()
            if end is not None:
                yield prefix, end[0], end[1]
            stack += [(prefix + label, child) for label, child in edges.values()]


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, trie = None, Trie()

    def done() -> pd.DataFrame:
        rows = list(trie.terminals())
        return pd.DataFrame({"digest": [xxhash.xxh3_128_digest(k) for k, _, _ in rows], "keep": [i for _, i, _ in rows], "n": [n for _, _, n in rows]})

    for b in batches:
        for bucket, key, keep, n in zip(b["bucket"], b["key"], b["keep"].tolist(), b["n"].tolist()):
            bucket = bytes(bucket)
            if bucket != now:
                if now is not None:
                    yield done()
                now, trie = bucket, Trie()
            trie.add(bytes(key), keep, n)
    if now is not None:
        yield done()


def copy_sets(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(digest, keep, n): each distinct record once, with its smallest id and its number of rows. keys: a written table of `keyed`."""
    partials = written(keys.mapInPandas(_partial, "digest binary, key binary, keep bigint, n bigint").drop("digest"), "copy-partials")
    placed = bucketed(partials, capacity)
    return placed.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_counted, "digest binary, keep bigint, n bigint")


def formatting_copies(records: DataFrame, id_col: str = "id", text_col: str = "latex", capacity: int = CAPACITY, hot_limit: int = HOT_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(sets, members). sets: keep_id, copies, one row per distinct record. members: keep_id, dup_id, one row per further copy.

    Values that are empty once canonical form one set. Repeated rows of one id and text count once.
    """
    keys = keyed(records, id_col, text_col)
    sets = written(copy_sets(keys, capacity), "copy-sets")
    several = sets.where("n > 1")
    hot = several.where(F.col("n") >= HOT_COPIES).select("digest", "keep")
    cold = several.where(F.col("n") < HOT_COPIES).select("digest", "keep")
    ids = keys.select("id", "digest")
    # Every digest of `several` is hot or cold, so each row finds its set once; hot ones never meet in one task.
    if hot.limit(hot_limit + 1).count() <= hot_limit:
        with_hot = ids.join(F.broadcast(hot), "digest")
    else:
        parts = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        with_hot = ids.withColumn("salt", F.pmod("id", F.lit(SALT)).cast("int")).join(parts, ["digest", "salt"]).drop("salt")
    members = with_hot.unionByName(ids.join(cold, "digest"))
    members = members.where(F.col("id") != F.col("keep")).select(F.col("keep").alias("keep_id"), F.col("id").alias("dup_id"))
    return sets.select(F.col("keep").alias("keep_id"), F.col("n").alias("copies")), members
