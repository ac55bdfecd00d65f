"""Media columns: binary columns of lossless WebP files and the pixel arrays in them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp_lossless as webp
from ._spark import documents

#: Bytes that a payload is a multiple of; also the width of its image.
ROW = 576
PAD = b"\xff"
#: Samples in one file; longer payloads are several files, one after the other.
FILE_SAMPLES = ROW << 12


def pack_grey(samples: bytes, row: int = ROW) -> bytes:
    """A file whose opaque grey pixels are the samples, in rows of ``row`` (wider beyond the format's height); beyond FILE_SAMPLES several, one after the other."""
    if len(samples) > FILE_SAMPLES:
        return b"".join(pack_grey(samples[k : k + FILE_SAMPLES], row) for k in range(0, len(samples), FILE_SAMPLES))
    width, height = webp.sides(len(samples), row)
    grey = np.zeros(width * height, np.uint32)
    grey[: len(samples)] = np.frombuffer(samples, np.uint8)
    few = len(samples) and np.count_nonzero(np.bincount(grey, minlength=256)) <= 16  # then a palette packs pixels
    return webp.encode(grey * np.uint32(0x010101) | np.uint32(0xFF000000), width, palette=few, subtract_green=not few)


def encode_text_images(docs: DataFrame, text_col: str = "text", media_col: str = "media", size_col: str = "n_bytes") -> DataFrame:
    """Columns of ``docs`` but the text, the size of its UTF-8 bytes and its image; columns of these names are replaced.

    The bytes are padded with 255 to a positive multiple of ``ROW`` and stored
    as 8-bit samples.  Null texts are stored as the empty text: one row of
    padding.  Texts beyond FILE_SAMPLES are stored as several files, one after
    the other in the binary, so memory is bounded by a file and the text.
    Repeated rows have equal images; an empty table gives no rows.
    """
    names = [n for n in docs.columns if n not in (text_col, media_col, size_col)]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name in names) + f"`{size_col}` long, `{media_col}` binary"

    def encode(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(batch.schema.get_field_index(text_col)).cast(pa.large_binary()), b"")
            for at in range(0, len(texts), 256):
                part, raw = batch.slice(at, 256), [t.as_py() for t in texts.slice(at, 256)]
                files = [pack_grey(x + PAD * (-len(x) % ROW or (0 if x else ROW))) for x in raw]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), pa.array([len(x) for x in raw], pa.int64()), pa.array(files, pa.binary())], [*names, size_col, media_col])

    return docs.mapInArrow(encode, schema)


def features(width: int, height: int, samples: np.ndarray) -> str:
    """Sides, mean, number of different samples and shares of 8 equal ranges in 1/1000."""
    counts = np.bincount(samples, minlength=256)
    shares = counts.reshape(8, 32).sum(1) * 1000 // max(1, len(samples))
    return f"{width}x{height};mean={samples.mean() if len(samples) else 0:.3f};distinct={np.count_nonzero(counts)};shares={','.join(map(str, shares.tolist()))}"


def decode_images(media: DataFrame, media_col: str = "media", keep_media: bool = True) -> DataFrame:
    """Columns of ``media``, and ``width``, ``height``, ``channels``, ``pixels``, ``feature`` of each image; columns of these names are replaced.

    ``pixels`` holds one byte a pixel for opaque grey images (``channels`` 1),
    else red, green, blue, alpha (4).  Several files of one width, one after the
    other, are one image, each below the one before.  Null media, and bytes that
    are no lossless WebP, give nulls.
    """
    own = ["width", "height", "channels", "pixels", "feature"]
    names = [n for n in media.columns if n not in own and (keep_media or n != media_col)]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in media.schema.fields if f.name in names) + "width int, height int, channels int, pixels binary, feature string"

    def one(file):
        if file is None:
            return (None,) * 5
        try:
            parts = [webp.decode(x) for x in webp.files(file)]
        except ValueError:
            return (None,) * 5
        if len({w for w, _, _ in parts}) > 1:
            return (None,) * 5
        width, height, argb = parts[0][0], sum(h for _, h, _ in parts), np.concatenate([a for _, _, a in parts]) if len(parts) > 1 else parts[0][2]
        blue, green, red, alpha = (((argb >> k) & 255).astype(np.uint8) for k in (0, 8, 16, 24))
        if (alpha == 255).all() and np.array_equal(red, green) and np.array_equal(green, blue):
            return width, height, 1, green.tobytes(), features(width, height, green)
        grey = ((red.astype(np.uint16) + green + blue) // 3).astype(np.uint8)
        return width, height, 4, np.stack([red, green, blue, alpha], 1).tobytes(), features(width, height, grey)

    def decode(batches):
        for batch in batches:
            files = batch.column(batch.schema.get_field_index(media_col))
            for at in range(0, len(files), 256):
                part, rows = batch.slice(at, 256), [one(f.as_py()) for f in files.slice(at, 256)]
                found = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), *found], [*names, *own])

    return media.mapInArrow(decode, schema)


def op1_webp_media(spark, sf_dir: str) -> DataFrame:
    stored = encode_text_images(documents(spark, sf_dir).select("doc_id", "text"))
    padded = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / ROW)).cast("int") * ROW
    back = decode_images(stored).withColumn("payload", F.substring("pixels", F.lit(1), padded))  # an image wider than a row may have unused pixels
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
