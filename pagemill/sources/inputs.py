"""Scans: image files, pages, data URIs, EXIF orientation, vocabularies, settings, release feeds."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from pagemill.operators.decode import FALLBACK_VOCABULARY

IMAGES, PDF = ("jpg", "jpeg", "png", "webp", "gif", "bmp"), "pdf"
PAGE_SCALE, PAGE_MODE = 2, "mixed"

# Start of the tag that holds the orientation, and its type (unsigned short).
EXIF_TAG, EXIF_SHORT = 0x0112, 3


def mime(name: Column) -> Column:
    """Type of a file by the ending of its name; null for others."""
    ending = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ending == PDF, "application/pdf").when(ending.isin("jpg", "jpeg"), "image/jpeg").when(ending.isin(*IMAGES), F.concat(F.lit("image/"), ending))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, mime, size, content) of all files in a folder; content is only read where it is used."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select("path", name.alias("name"), mime(name).alias("mime"), F.col("length").alias("size"), "content")


def accepted(found: DataFrame) -> DataFrame:
    """Images and PDFs only."""
    return found.where(F.col("mime").startswith("image/") | (F.col("mime") == "application/pdf"))


def first_image(items: DataFrame, key: str, order: str) -> DataFrame:
    """The first image of each drop or paste."""
    w = Window.partitionBy(key).orderBy(order)
    return items.where(F.col("mime").startswith("image/")).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def pages(docs: DataFrame) -> DataFrame:
    """(doc, page, scale, mode): a row per page of each document (doc, n); none for documents without pages."""
    return docs.where("n >= 1").select("doc", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("page"), F.lit(PAGE_SCALE).alias("scale"), F.lit(PAGE_MODE).alias("mode"))


def data_uri(text: Column) -> Column:
    """Bytes of a data URI or of bare base64; null if it is no base64."""
    comma = F.instr(text, ",")
    return F.try_to_binary(F.when(comma > 0, F.substr(text, comma + 1)).otherwise(text), F.lit("base64"))


def _read(raw: bytes, at: int, n: int, little: bool) -> int:
    return int.from_bytes(raw[at : at + n], "little" if little else "big")


def orientation_of(raw: bytes | None) -> int:
    """EXIF orientation of a JPEG; 1 where there is none or the file is broken."""
    if not raw or raw[:2] != b"\xff\xd8":
        return 1
    at = 2
    while at + 4 <= len(raw) and raw[at] == 0xFF:
        marker, (size,) = raw[at + 1], struct.unpack(">H", raw[at + 2 : at + 4])
        if marker == 0xDA or size < 2:
            break
        part = raw[at + 4 : at + 2 + size]
        if marker == 0xE1 and part[:6] == b"Exif\0\0":
            tiff = part[6:]
            little = tiff[:2] == b"II"
            if not little and tiff[:2] != b"MM" or _read(tiff, 2, 2, little) != 42:
                return 1
            table = _read(tiff, 4, 4, little)
            for k in range(_read(tiff, table, 2, little)):
                entry = table + 2 + 12 * k
                if entry + 12 > len(tiff):
                    break
                if (_read(tiff, entry, 2, little), _read(tiff, entry + 2, 2, little), _read(tiff, entry + 4, 4, little)) == (EXIF_TAG, EXIF_SHORT, 1):
                    value = _read(tiff, entry + 8, 2, little)
                    return value if 1 <= value <= 8 else 1
        at += 2 + size
    return 1


@F.pandas_udf(IntegerType())
def exif_orientation(content: pd.Series) -> pd.Series:
    return content.map(orientation_of).astype("int32")


def vocabulary(text: DataFrame) -> DataFrame:
    """(id, token) from a tokenizer file (value: its JSON); the least token of an id used twice; the fallback for a broken file."""
    spark = text.sparkSession
    found = text.select(F.explode(F.from_json("value", "model struct<vocab:map<string,int>>")["model"]["vocab"]).alias("token", "id")).groupBy("id").agg(F.min("token").alias("token"))
    fallback = spark.createDataFrame(list(FALLBACK_VOCABULARY.items()), "id int, token string")
    return found.unionByName(fallback.join(found.limit(1).select(F.lit(True).alias("any")), how="left_anti"))


def keys(lines: DataFrame) -> DataFrame:
    """(id, ch): the symbols of a recogniser by place, from 1; lines: (n, value) numbered by the reader."""
    return lines.select((F.col("n") + 1).cast("int").alias("id"), F.regexp_replace("value", "[\r\n]", "").alias("ch"))


def settings(native: Column, local: Column) -> Column:
    """Settings as a map: the native text if it is JSON, else the local one, else empty."""
    parse = lambda c: F.from_json(c, "map<string,string>")
    return F.coalesce(parse(native), parse(local), F.create_map().cast("map<string,string>"))


def preset(name: Column, presets: dict[str, tuple[str, str]], base_url: Column, model: Column) -> Column:
    """struct(base_url, model) of a provider; an unknown name changes nothing."""
    url, mod = base_url, model
    for k, (u, m) in presets.items():
        url, mod = F.when(name == k, F.lit(u)).otherwise(url), F.when(name == k, F.lit(m)).otherwise(mod)
    return F.struct(url.alias("base_url"), mod.alias("model"))


def release(feed: Column) -> Column:
    """struct(version, url, body) of a release feed entry; a leading v of the version is dropped."""
    r = F.from_json(feed, "tag_name string, html_url string, body string")
    return F.struct(F.regexp_replace(r["tag_name"], "^v", "").alias("version"), r["html_url"].alias("url"), r["body"].alias("body"))


# Sinks.


def save_settings(values: DataFrame, path: str) -> None:
    """The one row of settings (key, val) as JSON, in place of what was there; null values are kept as empty."""
    one = values.where("key is not null").groupBy("key").agg(F.min(F.coalesce("val", F.lit(""))).alias("val")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "val"))))).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def load_settings(spark: SparkSession, path: str) -> DataFrame:
    """(key, val) of saved settings."""
    return spark.read.text(path).select(F.explode(settings(F.col("value"), F.lit(None).cast("string"))).alias("key", "val"))


def save_texts(texts: DataFrame, path: str, column: str = "text") -> None:
    """Texts as files, a record after the other with an empty line between; nulls are left out."""
    texts.where(F.col(column).isNotNull()).select(F.concat(F.col(column), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)
