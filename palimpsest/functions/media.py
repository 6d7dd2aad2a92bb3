"""Kinds of files: by extension, by MIME type; slices of tall images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions and their kinds.
EXTENSIONS = {
    "png": "image", "jpg": "image", "jpeg": "image", "webp": "image", "tiff": "image", "tif": "image", "bmp": "image", "svg": "image",
    "pdf": "pdf",
    "mp3": "audio", "wav": "audio", "m4a": "audio", "amr": "audio", "aiff": "audio", "aac": "audio", "ogg": "audio", "flac": "audio",
    "docx": "document", "pptx": "document", "xlsx": "document", "doc": "document", "ppt": "document", "xls": "document",
    "pages": "document", "key": "document", "numbers": "document", "odt": "document", "ods": "document", "odp": "document", "rtf": "document",
    "html": "html", "htm": "html", "eml": "email", "txt": "direct", "md": "direct", "vtt": "direct", "csv": "direct", "tsv": "direct",
}
#: MIME types and the extension they stand for.
MIME = {
    "text/plain": "txt", "text/markdown": "md", "text/csv": "csv", "application/json": "json", "text/html": "html", "application/pdf": "pdf", "message/rfc822": "eml",
    "image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/webp": "webp", "audio/mpeg": "mp3", "audio/wav": "wav", "video/mp4": "mp4",
}


def _lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), default)


def extension(name: Column) -> Column:
    """The lower-case extension of a path or URL, '' without one."""
    path = F.regexp_replace(F.regexp_replace(name, r"[?#].*$", ""), r"^.*/", "")
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def modality(ext: Column) -> Column:
    return _lookup(F.lower(F.regexp_replace(F.coalesce(ext, F.lit("")), r"^\.", "")), EXTENSIONS, F.lit("unknown"))


def normal_mime(mime: Column) -> Column:
    return F.lower(F.trim(F.split(F.coalesce(mime, F.lit("")), ";")[0]))


def mime_extension(mime: Column) -> Column:
    return _lookup(normal_mime(mime), MIME, F.lit(""))


def slices(width: Column, height: Column, ratio: int = 10) -> Column:
    """(top, bottom) of the parts of an image: tall ones are cut so that none is over ``ratio`` times as high as wide.

    Neighbouring parts share a tenth of a part, 50 to 200 pixels, on each inner side.
    """
    n = F.ceil(height / width / ratio)
    part = F.floor(height / n)
    shared = F.greatest(F.lit(50), F.least(F.lit(200), F.floor(0.1 * part)))
    cut = F.transform(
        F.sequence(F.lit(0).cast("bigint"), n - 1),
        lambda i: F.struct(
            F.when(i == 0, F.lit(0).cast("bigint")).otherwise(i * part - shared).alias("top"),
            F.when(i == n - 1, height.cast("bigint")).otherwise((i + 1) * part + shared).alias("bottom"),
        ),
    )
    return F.when(height <= ratio * width, F.array(F.struct(F.lit(0).cast("bigint").alias("top"), height.cast("bigint").alias("bottom")))).otherwise(cut)
