"""Sequence decoding queries over vectors that stand for the scores of time steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import decode as D
from pagemill.plans.fixtures import ctes, view

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# A dictionary of 62 symbols: labels 1 to 62, 63 is the blank between words; and a vocabulary of 64 with marks and blanks.
_SYMBOLS = [(k, chr(96 + k) if k <= 26 else chr(38 + k) if k <= 52 else str(k - 53)) for k in range(1, 63)]
_VOCABULARY = [(k, "<%d>" % k if k % 16 == 0 else ("Ġ", "▁", "", "")[k % 4] + "t%d" % k) for k in range(64)]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _values(rows: list, names: str) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in rows) + f") AS v({names}))"


_E = "{cte}, e AS (SELECT box, t, logits, list_transform(logits, lambda v: exp(v::DOUBLE - list_max(logits)::DOUBLE)) AS ex FROM steps)".format(cte=ctes("steps"))
# Labels: the first greatest of all scores.
_IDS = "{cte}, i AS (SELECT box, t, list_position(logits, list_max(logits)) - 1 AS id, list_max(logits)::DOUBLE AS v FROM steps), b AS (SELECT *, lag(id) OVER (PARTITION BY box ORDER BY t) AS before FROM i), c AS (SELECT box, t, id, v FROM b WHERE id > 0 AND (before IS NULL OR before <> id))".format(cte=ctes("steps"))


@query(f"{_E} SELECT box, t, unnest(range(64))::INT AS id, round(unnest(list_transform(ex, lambda v: v / list_sum(ex))), 6) AS p FROM e")
def dec_softmax(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "steps").select("box", "t", F.posexplode(D.softmax(F.col("logits"))).alias("id", "p"))
    return p.withColumn("p", F.round("p", 6))


@query(f"{ctes('steps')} SELECT box, t, list_position(logits, list_max(logits)) - 1 AS id FROM steps")
def dec_argmax(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "steps").select("box", "t", D.argmax(F.col("logits")).alias("id"))


@query(f"{_E}, r AS (SELECT box, t, unnest(list_transform(ex, lambda v: v / list_sum(ex))) AS p, unnest(range(64)) AS id FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY box, t ORDER BY p DESC, id) AS n FROM r) SELECT box, t, CAST(id AS INT) AS id, round(p, 6) AS p FROM k WHERE n <= 10 AND p >= 0.01")
def dec_topk(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "steps").select("box", "t", F.inline(D.top_k(D.softmax(F.col("logits")), D.FIRST_K))).withColumn("p", F.round("p", 6))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "steps").select("box", "t", D.argmax(F.col("logits")).alias("id"), F.array_max("logits").cast("double").alias("v"))


@query(f"{_IDS} SELECT box, t, id FROM c")
def dec_collapse(spark: SparkSession, d: str) -> DataFrame:
    return D.collapse(_labels(spark, d), "box").select("box", "t", "id")


@query(
    f"{_IDS} SELECT box, trim(string_agg(CASE WHEN c.id = 63 THEN ' ' WHEN c.id <= 62 THEN s.ch ELSE '' END, '' ORDER BY t)) AS text, round(avg(v), 6) AS confidence FROM c LEFT JOIN {_values(_SYMBOLS, 'id, ch')} s ON c.id = s.id GROUP BY box"
)
def dec_text(spark: SparkSession, d: str) -> DataFrame:
    symbols = spark.createDataFrame(_SYMBOLS, "id int, ch string")
    return D.label_text(D.collapse(_labels(spark, d), "box"), symbols, 62, "box").withColumn("confidence", F.round("confidence", 6))


@query(
    f"{_IDS} SELECT box, trim(string_agg(replace(replace(s.token, 'Ġ', ' '), '▁', ' '), '' ORDER BY t)) AS text FROM i JOIN {_values(_VOCABULARY, 'id, token')} s ON i.id = s.id WHERE s.token NOT LIKE '<%>' GROUP BY box"
)
def dec_tokens(spark: SparkSession, d: str) -> DataFrame:
    return D.token_text(_labels(spark, d), spark.createDataFrame(_VOCABULARY, "id int, token string"), "box")


@query(f"{_IDS} SELECT box, array_to_string(list(id ORDER BY t), ',') AS ids FROM i GROUP BY box")
def dec_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = _labels(spark, d).groupBy("box").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "id"))), lambda s: s["id"]).alias("ids"))
    return ids.select("box", D.ids_text(F.col("ids")).alias("ids"))


# Beams: a vector is a beam of its image; its tokens are the start and three labels, its score the log of a value in 0 to 1.
_BEAMS = "{cte}, b AS (SELECT box AS img, t AS beam, list_concat([2], list_transform([1, 2, 3], lambda k: CAST(floor((logits[k] + 1) * 2) AS BIGINT))) AS tokens, round(ln(0.5 + logits[4]::DOUBLE / 4), 9) AS score, t % 3 = 0 AS finished FROM steps)".format(cte=ctes("steps"))
_BEST = "d AS (SELECT *, row_number() OVER (PARTITION BY img, tokens[2:] ORDER BY score DESC, beam) AS n FROM b WHERE NOT finished), a AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY score DESC, beam) AS r FROM d WHERE n = 1)"


def _beams(spark: SparkSession, d: str) -> DataFrame:
    token = lambda k: F.floor((F.col("logits")[k].cast("double") + 1) * 2).cast("bigint")
    return view(spark, d, "steps").select(F.col("box").alias("img"), F.col("t").alias("beam"), F.array(F.lit(2).cast("bigint"), token(0), token(1), token(2)).alias("tokens"), F.round(F.log(0.5 + F.col("logits")[3].cast("double") / 4), 9).alias("score"), (F.col("t") % 3 == 0).alias("finished"))


@query(f"{_BEAMS}, d AS (SELECT *, row_number() OVER (PARTITION BY img, tokens[2:] ORDER BY score DESC, beam) AS n FROM b) SELECT img, beam, score FROM d WHERE n = 1")
def dec_distinct(spark: SparkSession, d: str) -> DataFrame:
    return D.distinct_sequences(_beams(spark, d), "img").select("img", "beam", "score")


@query(f"{_BEAMS}, {_BEST}, u AS (SELECT img, beam, score FROM b WHERE finished UNION ALL SELECT img, beam, score FROM a WHERE r <= 3), k AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY score DESC, beam) AS q FROM u) SELECT img, beam, score FROM k WHERE q <= 5")
def dec_prune(spark: SparkSession, d: str) -> DataFrame:
    b = _beams(spark, d)
    return D.prune(b.where("finished"), b.where("not finished"), "img").select("img", "beam", "score")


@query(f"{_BEAMS}, k AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY finished DESC, score DESC, beam) AS q FROM b) SELECT img, beam, round(exp(score / greatest(len(tokens) - 1, 1)), 6) AS confidence FROM k WHERE q = 1")
def dec_best(spark: SparkSession, d: str) -> DataFrame:
    return D.best_beam(_beams(spark, d), "img").select("img", "beam", F.round(D.geometric_mean(F.col("score"), F.size("tokens")), 6).alias("confidence"))


def _stub(state):
    """A decoder step that walks through a vector: the scores of step n are eight of its values; it stops after eight."""

    def step(prefixes: list[list[int]]) -> list[list[float]]:
        return [([50.0] + [0.0] * 7) if len(p) > 8 else [float(v) * 10 for v in state[(len(p) - 1) * 7 : (len(p) - 1) * 7 + 8]] for p in prefixes]

    return step


@query()
def dec_beam_search(spark: SparkSession, d: str) -> DataFrame:
    images = view(spark, d, "steps").select(F.col("t").alias("img"), F.col("logits").alias("state"))
    return D.decode_images(images, _stub).select("img", D.ids_text(F.col("tokens")).alias("ids"), F.round("confidence", 6).alias("confidence"))
