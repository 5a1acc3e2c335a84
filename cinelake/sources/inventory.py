"""Media folders: listing, content fingerprints and probe output."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cinelake.functions.documents import json_field

# File endings the catalog takes in.
EXTENSIONS = (".mp4", ".mov", ".wav", ".mp3", ".aac", ".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp", ".webp")

READ_BYTES = 8 * 1024


def supported(path: Column) -> Column:
    return F.concat(F.lit("."), F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))).isin(*EXTENSIONS)


def media_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Path, length and time of every media file below `root`. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length", "modificationTime").filter(supported(F.col("path")))


def fingerprint(content: Column, max_bytes: int | None = None) -> Column:
    """SHA-256 of a binary column, or of its first `max_bytes` bytes if asked for."""
    return F.sha2(content if max_bytes is None else F.substring(content, 1, max_bytes), 256)


def fingerprint_files(files: DataFrame, path: str = "path", max_bytes: int | None = None) -> DataFrame:
    """Add `sha256_prefix`, the digest of the whole file, by reading it in small pieces, for files too big for one row.

    With `max_bytes` only the start of each file counts, so files that differ later get the same digest.

    Paths must be readable on the executors under the given name.
    """

    def digest(name: str) -> str:
        h, left = hashlib.sha256(), math.inf if max_bytes is None else max_bytes
        with open(name.removeprefix("file:"), "rb") as f:
            while left > 0 and (piece := f.read(int(min(READ_BYTES, left)))):
                h.update(piece)
                left -= len(piece)
        return h.hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(sha256_prefix=pdf[path].map(digest))

    schema = files.withColumn("sha256_prefix", F.lit("")).schema
    return files.mapInPandas(run, schema)


def parse_probe(df: DataFrame, probe: str = "probe_json", exif: str = "exif_json") -> DataFrame:
    """Typed media columns from probe and EXIF output. Broken JSON gives nulls; the row stays."""
    p, e = F.col(probe), F.col(exif)
    streams = F.try_variant_get(F.try_parse_json(p), "$.streams", "array<variant>")
    of_kind = lambda kind: F.get(
        F.filter(streams, lambda s: F.coalesce(F.try_variant_get(s, "$.codec_type", "string") == kind, F.lit(False))), F.lit(0)
    )
    at = F.try_variant_get
    read = df.withColumns({"__v": of_kind("video"), "__a": of_kind("audio")})
    v, a = F.col("__v"), F.col("__a")
    rate = F.split(at(v, "$.r_frame_rate", "string"), "/", 2)
    num, den = F.get(rate, F.lit(0)).try_cast("double"), F.get(rate, F.lit(1)).try_cast("double")
    taken = F.coalesce(
        F.nullif(json_field(e, "$[0].CreateDate"), F.lit("")), F.nullif(json_field(e, "$[0].DateTimeOriginal"), F.lit(""))
    )
    # The first two colons and the first blank of `YYYY:MM:DD HH:MM:SS`.
    iso = F.regexp_replace(F.regexp_replace(taken, r"^([^:]*):([^:]*):", "$1-$2-"), r"^([^ ]*) ", "$1T")
    number = lambda path: F.when(
        F.schema_of_variant(at(F.try_parse_json(e), path, "variant")) != "STRING", json_field(e, path, "double")
    )
    return read.withColumns({
        "codec": F.when(v.isNotNull(), at(v, "$.codec_name", "string")).otherwise(at(a, "$.codec_name", "string")),
        "resolution_w": at(v, "$.width", "bigint"),
        "resolution_h": at(v, "$.height", "bigint"),
        "fps": F.when(den != 0, F.try_divide(num, den)),
        "duration_seconds": json_field(p, "$.format.duration", "string").try_cast("double"),
        "audio_channels": at(a, "$.channels", "bigint"),
        "created_at": iso,
        "gps_lat": number("$[0].GPSLatitude"),
        "gps_lon": number("$[0].GPSLongitude"),
        "metadata_json": F.when(F.try_parse_json(p).isNotNull(), p),
    }).drop("__v", "__a")
