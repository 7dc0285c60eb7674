"""Structural provenance markers in PNG and JPEG files."""

from __future__ import annotations

from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from imgaudit import fixed_values as fixed
from imgaudit.functions.common import ColumnLike, col
from imgaudit.functions.images import is_jpeg, is_png
from imgaudit.session import small_batches

# the only chunks and segments a marker is honoured in
MARKER_KINDS = ("tEXt", "iTXt", "caBX", "APP1", "APP11")

_PNG_START = 8


def _png_chunks(data: memoryview) -> Iterator[tuple[str, int, int]]:
    at, end = _PNG_START, len(data)
    while at + 12 <= end:
        length = int.from_bytes(data[at:at + 4], "big")
        kind = bytes(data[at + 4:at + 8]).decode("latin-1")
        if kind == "IEND":
            return
        yield kind, at + 8, min(at + 8 + length, end)
        at += 12 + length


def _segment_name(marker: int) -> str:
    if 0xE0 <= marker <= 0xEF:
        return f"APP{marker - 0xE0}"
    return "COM" if marker == 0xFE else f"FF{marker:02X}"


def _jpeg_segments(data: memoryview) -> Iterator[tuple[str, int, int]]:
    at, end = 2, len(data)
    while at + 4 <= end and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
        elif 0xD0 <= marker <= 0xD8:  # stands alone
            at += 2
        else:
            length = int.from_bytes(data[at + 2:at + 4], "big")
            if marker in (0xD9, 0xDA) or length < 2:
                return
            yield _segment_name(marker), at + 4, min(at + 2 + length, end)
            at += 2 + length


_WALKERS = {"png": _png_chunks, "jpeg": _jpeg_segments}


CHUNK = pa.struct([("ord", pa.int32()), ("container", pa.string()), ("kind", pa.string()),
                   ("payload", pa.binary())])


def _walk(kinds: Collection[str] | None, key_type: pa.DataType):
    schema = pa.schema([("key", key_type), ("chunks", pa.list_(CHUNK))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for container, head in zip(batch.column(1), batch.column(2)):
                name = container.as_py()
                data = memoryview(head.as_buffer()).cast("B") if name else b""
                rows.append([
                    {"ord": ord_, "container": name, "kind": kind, "payload": bytes(data[start:stop])}
                    for ord_, (kind, start, stop) in enumerate(_WALKERS[name](data) if name else ())
                    if kinds is None or kind in kinds])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, schema.field("chunks").type)], schema=schema)

    return run


def with_chunks(images: DataFrame, key: str = "path", content: str = "content",
                kinds: Collection[str] | None = None, window: int | None = None) -> DataFrame:
    """Per image its key and ``chunks``, an array of (ord, container, kind, payload).

    Files are walked to their end, or as far as ``window`` bytes, where payloads are
    clipped. Files in other containers have no chunks and none of their bytes reach Python.
    ``kinds`` limits which chunks come back.
    """
    container = F.when(is_png(content) & (F.octet_length(content) >= 16), "png").when(
        is_jpeg(content) & (F.octet_length(content) >= 4), "jpeg")
    body = F.col(content) if window is None else F.substring(F.col(content), 1, window)
    heads = images.select(F.col(key).alias("key"), container.alias("container"),
                          F.when(container.isNotNull(), body).alias("head"))
    key_type = heads.schema["key"].dataType
    small_batches(images.sparkSession)
    walked = heads.mapInArrow(
        _walk(None if kinds is None else frozenset(kinds), to_arrow_type(key_type)),
        f"key {key_type.simpleString()}, chunks array<struct<ord:int,container:string,kind:string,"
        "payload:binary>>")
    return walked.withColumnRenamed("key", key)


def image_chunks(images: DataFrame, key: str = "path", content: str = "content",
                 kinds: Collection[str] | None = None, window: int | None = None) -> DataFrame:
    """Chunks of PNG and segments of JPEG files: (key, ord, container, kind, payload)."""
    return with_chunks(images, key, content, kinds, window).select(key, F.inline("chunks"))


def c2pa_search(payload: ColumnLike) -> Column:
    """Reason of the first pattern, in table order, that occurs in the bytes; else null."""
    reason = F.lit(None).cast("string")
    for pattern, name in reversed(fixed.C2PA_MARKERS):
        found = F.position(F.lit(pattern.encode()), col(payload)) > 0
        reason = F.when(found, name).otherwise(reason)
    return reason


def keyword_end(payload: ColumnLike) -> Column:
    """1-based position of the byte that ends a text chunk's keyword; 0 when there is none."""
    return F.position(F.lit(b"\x00"), col(payload))


def marker_reason(container: ColumnLike = "container", kind: ColumnLike = "kind",
                  payload: ColumnLike = "payload") -> Column:
    """Reason a chunk marks its image as generated, or null."""
    container, kind, payload = col(container), col(kind), col(payload)
    end = keyword_end(payload)
    keyword = F.when(end > 1, F.substring(payload, F.lit(1), end - 1))
    text = kind.isin("tEXt", "iTXt")
    graph = (kind == "iTXt") | (F.substring(payload, end + 1, F.lit(2)) == F.lit(b'{"'))
    searched = (((container == "jpeg") & kind.isin("APP1", "APP11"))
                | ((container == "png") & (kind == "caBX"))
                | ((kind == "iTXt") & (keyword == F.lit(b"XML:com.adobe.xmp"))))
    return (F.when(text & (keyword == F.lit(b"parameters")), "png:sd-parameters")
            .when(text & (keyword == F.lit(b"prompt")) & graph, "png:comfyui-prompt")
            .when(text & (keyword == F.lit(b"workflow")) & graph, "png:comfyui-workflow")
            .when(searched, c2pa_search(payload)))


def marker_rules(chunks: DataFrame) -> DataFrame:
    """Chunks that carry a marker, with its reason."""
    return chunks.withColumn("reason", marker_reason()).filter(F.col("reason").isNotNull())


def first_hits(images: DataFrame, key: str = "path", content: str = "content",
               window: int | None = None) -> DataFrame:
    """Per image: ``hit`` and the reason of its earliest marker. One scan, no shuffle."""
    marked = with_chunks(images, key, content, MARKER_KINDS, window)
    reasons = F.filter(F.transform("chunks", lambda c: marker_reason(
        c["container"], c["kind"], c["payload"])), lambda reason: reason.isNotNull())
    return marked.select(key, F.get(reasons, F.lit(0)).alias("reason")).withColumn(
        "hit", F.col("reason").isNotNull())
