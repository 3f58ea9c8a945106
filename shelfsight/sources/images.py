"""Image sources: files through Spark's image reader, blob headers, and raster rows.

A raster row follows the reader's struct: ``image_id, height, width,
n_channels, data`` with ``data`` in row-major order, three channels as BGR or
four as BGRA.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.functions.binding import let, with_once
from shelfsight.settings import DEFAULTS

_SUMS = ("ring", "ring_clear", "ring_white", "top", "top_white", "bottom", "bottom_white")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decode image files; files that do not decode are dropped by the reader."""
    image = F.col("image")
    return (
        spark.read.format("image").option("dropInvalid", True).load(path)
        .select(
            image["origin"].alias("image_id"), image["height"].alias("height"), image["width"].alias("width"),
            image["nChannels"].alias("n_channels"), image["data"].alias("data"),
        )
    )


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Byte length per file, without reading the content column into the plan."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("image_id"), F.col("length").alias("n_bytes"))


def _number(content: Column, start: Column | int, n: int, little: bool = False) -> Column:
    """``n`` bytes from a 1-based place as a number; null where they are missing."""
    raw = F.substring(content, start, n) if isinstance(start, int) else F.substring(content, start, F.lit(n))
    value = F.conv(F.hex(raw), 16, 10)
    if little:
        byte = lambda k: F.hex(F.substring(content, (F.lit(start) if isinstance(start, int) else start) + k, F.lit(1)))
        value = F.conv(F.concat(*[byte(k) for k in range(n - 1, -1, -1)]), 16, 10)
    return F.when(F.octet_length(raw) == n, value.cast("long"))


def _walk(content: Column, least: int, start: Column, step: Callable[[Column], Column]) -> Column:
    """Fold ``step`` over the segments of a binary value until it sets ``done``.

    There are at most length / ``least`` segments. The fold is two levels of about
    the square root of that number, and a level is left out once it is done, so
    neither short headers nor very many segments cost more than they must.
    """
    level = F.sequence(F.lit(1), F.ceil(F.sqrt(F.octet_length(content) / least)).cast("int") + 1)
    inner = lambda state: F.aggregate(level, state, lambda s, _: F.when(s["done"], s).otherwise(step(s)))
    return F.aggregate(level, start, lambda s, _: F.when(s["done"], s).otherwise(inner(s)))


def _state(at: Column, done: Column, ok: Column, width: Column, height: Column) -> Column:
    return F.struct(
        at.cast("long").alias("at"), F.coalesce(done, F.lit(True)).alias("done"), F.coalesce(ok, F.lit(False)).alias("ok"),
        width.cast("int").alias("width"), height.cast("int").alias("height"),
    )


def _jpeg(content: Column) -> Column:
    """Sizes from the first start-of-frame segment; segments are skipped by their length, so their data is not searched."""
    none = F.lit(None)

    def step(s: Column) -> Column:
        at = s["at"]
        marker, size = F.hex(F.substring(content, at + 1, F.lit(1))), _number(content, at + 2, 2)
        whole = F.hex(F.substring(content, at, F.lit(1))) == "FF"
        bare = marker.isin("01", *[f"D{k}" for k in range(9)])  # fixed values: markers without a segment
        frame = marker.startswith("C") & ~marker.isin("C4", "C8", "CC")
        stop = lambda ok, w, h: _state(at, F.lit(True), ok, w, h)
        go = lambda to: _state(to, to > F.octet_length(content), F.lit(False), none, none)
        return (
            F.when(~whole | marker.isin("", "D9", "DA"), stop(F.lit(False), none, none))
            .when(marker == "FF", go(at + 1)).when(bare, go(at + 2))
            .when(frame, stop(F.lit(True), _number(content, at + 7, 2), _number(content, at + 5, 2)))
            .when(size >= 2, go(at + 2 + size)).otherwise(stop(F.lit(False), none, none))
        )

    return _walk(content, 2, _state(F.lit(3), F.lit(False), F.lit(False), none, none), step)


def _png(content: Column) -> Column:
    """Sizes from the first chunk; readable if the chunks, each inside the content, end with the end chunk."""
    width, height = _number(content, 17, 4), _number(content, 21, 4)

    def step(s: Column) -> Column:
        at = s["at"]
        size, kind = _number(content, at, 4), F.hex(F.substring(content, at + 4, F.lit(4)))
        after = at + 12 + size
        fits = (after <= F.octet_length(content) + 1) & ((at > 9) | (kind == "49484452"))
        return _state(after, ~F.coalesce(fits, F.lit(False)) | (kind == "49454E44"), fits & (kind == "49454E44"), width, height)

    return _walk(content, 12, _state(F.lit(9), F.lit(False), F.lit(False), width, height), step)


def _gif(content: Column) -> Column:
    width, height = _number(content, 7, 2, True), _number(content, 9, 2, True)
    return _state(F.lit(0), F.lit(True), F.octet_length(content) > 13, width, height)


def _webp(content: Column) -> Column:
    """Sizes of the three kinds of first chunk; readable if the container's length is there."""
    kind, whole = F.hex(F.substring(content, 13, 4)), _number(content, 5, 4, True) + 8 <= F.octet_length(content)
    low = lambda start: _number(content, start, 2, True).bitwiseAND(F.lit(0x3FFF))
    bits = _number(content, 22, 4, True)
    lossy = (kind == "56503820") & (F.hex(F.substring(content, 24, 3)) == "9D012A")
    lossless = (kind == "5650384C") & (F.hex(F.substring(content, 21, 1)) == "2F")
    extended = kind == "56503858"
    width = F.when(lossy, low(27)).when(lossless, bits.bitwiseAND(F.lit(0x3FFF)) + 1).when(extended, _number(content, 25, 3, True) + 1)
    height = F.when(lossy, low(29)).when(lossless, F.shiftright(bits, 14).bitwiseAND(F.lit(0x3FFF)) + 1).when(extended, _number(content, 28, 3, True) + 1)
    return _state(F.lit(0), F.lit(True), whole, width, height)


def image_headers(blobs: DataFrame) -> DataFrame:
    """Format, width and height of ``content`` and whether it is ``readable``; expressions only, no pixel is decoded.

    JPEG segments and PNG chunks are followed by their lengths through the whole
    content. Unknown formats and null or empty content have no format and are not
    readable, nor are images without both sides.
    """
    content = F.col("content")
    head = lambda start, n: F.hex(F.substring(content, start, n))
    png, jpeg = head(1, 8) == "89504E470D0A1A0A", head(1, 3) == "FFD8FF"
    gif = head(1, 6).isin("474946383761", "474946383961")
    webp = (head(1, 4) == "52494646") & (head(9, 4) == "57454250")
    found = F.when(png, _png(content)).when(jpeg, _jpeg(content)).when(gif, _gif(content)).when(webp, _webp(content))
    told = with_once(blobs, "_image", found)
    both = F.col("_image.width").isNotNull() & F.col("_image.height").isNotNull()
    sized = (F.col("_image.width") > 0) & (F.col("_image.height") > 0)
    return told.select(
        "image_id",
        F.octet_length("content").cast("long").alias("n_bytes"),
        F.when(png, "png").when(jpeg, "jpeg").when(gif, "gif").when(webp, "webp").alias("format"),
        F.when(both, F.col("_image.width")).alias("width"),
        F.when(both, F.col("_image.height")).alias("height"),
        F.coalesce(F.col("_image.ok") & sized, F.lit(False)).alias("readable"),
    )


def _with_sample_bytes(rasters: DataFrame) -> DataFrame:
    return rasters if "sample_bytes" in rasters.columns else rasters.withColumn("sample_bytes", F.lit(1))


def pixels_from_rasters(rasters: DataFrame) -> DataFrame:
    """One row per pixel from raster rows, using only built-in expressions. One channel is grey.

    A sample takes one byte, or ``sample_bytes`` where that column exists; two
    bytes are a signed number, the high byte first.
    """
    per, size = F.col("n_channels"), F.col("sample_bytes")
    cell = _with_sample_bytes(rasters).select(
        "image_id", "width", "height", "n_channels", "data", "sample_bytes",
        F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i"),
    )
    unsigned = lambda k: F.conv(F.hex(F.substring(F.col("data"), (F.col("i") * per + k) * size + 1, size)), 16, 10).cast("int")
    sample = lambda k: let(unsigned(k), lambda v: F.when((size == 2) & (v >= 1 << 15), v - (1 << 16)).otherwise(v))
    return cell.select(
        "image_id", "width", "height",
        (F.col("i") % F.col("width")).alias("x"),
        F.floor(F.col("i") / F.col("width")).cast("int").alias("y"),
        F.when(per == 1, sample(0)).otherwise(sample(2)).alias("r"), F.when(per == 1, sample(0)).otherwise(sample(1)).alias("g"),
        sample(0).alias("b"), F.when(per == 4, sample(3)).otherwise(255).alias("a"),
    )


def raster_border_sums(rasters: DataFrame, white_threshold: int = DEFAULTS.white_threshold) -> DataFrame:
    """Weighted border counts straight from raster rows, one vectorised pass per image.

    Same columns as the pixel-table aggregation, and no shuffle: each image is
    measured where it is read. Images are bounded by the download size limit.
    """
    thr = max(0, min(255, int(white_threshold)))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for image_id, h, w, n, k, data in batch.itertuples(index=False, name=None):
                grid = np.frombuffer(data, dtype=np.uint8 if k == 1 else ">i2").reshape(h, w, n)
                low = grid[..., :3].min(axis=2)
                clear = grid[..., 3] < 32 if n == 4 else np.zeros((h, w), dtype=bool)
                t, c = max(1, int(min(h, w) * 0.05)), max(5, int(min(h, w) * 0.02))
                ring = lambda m: (m[:t], m[-t:], m[:, :t], m[:, -t:])
                top = lambda m: (m[:c, :c], m[:c, -c:])
                bottom = lambda m: (m[-c:, :c], m[-c:, -c:])
                count = lambda parts: int(sum(int(p.sum()) for p in parts))
                size = lambda parts: int(sum(p.size for p in parts))
                rows.append((
                    image_id, size(ring(low)), count(ring(clear)), count(ring(low >= thr)),
                    size(top(low)), count(top(low >= thr)), size(bottom(low)), count(bottom(low.astype(int) >= thr - 15)),
                ))
            yield pd.DataFrame(rows, columns=["image_id", *_SUMS])

    id_type = rasters.schema["image_id"].dataType.simpleString()
    schema = f"image_id {id_type}, " + ", ".join(f"{c} long" for c in _SUMS)
    return _with_sample_bytes(rasters).select("image_id", "height", "width", "n_channels", "sample_bytes", "data").mapInPandas(measure, schema)
