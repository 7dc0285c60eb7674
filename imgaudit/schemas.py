"""Explicit schemas of the tables the operators read and write."""

from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


STRING, INT, LONG, DOUBLE, BOOL = (
    StringType(), IntegerType(), LongType(), DoubleType(), BooleanType())

IMAGE = _struct(bytes=BinaryType(), path=STRING)

# one row per labelled image; label 1 = generated, 0 = real
MANIFEST = _struct(path=STRING, label=INT, source=STRING, subset=STRING)

SHARD = _struct(image=IMAGE, label=STRING, model=STRING)

# one row per (image, degradation view, model); z is the raw logit
LOGITS = _struct(path=STRING, label=INT, source=STRING, subset=STRING,
                 view=STRING, model_tag=STRING, z=DOUBLE)

TTA = _struct(path=STRING, label=INT, source=STRING,
              z_std=DOUBLE, z_v1=DOUBLE, z_v2=DOUBLE, z_v3=DOUBLE)

CALIBRATION = _struct(bias=DOUBLE, z_star=DOUBLE, pooled_balanced_acc=DOUBLE,
                      per_view=MapType(STRING, DOUBLE))

MODEL = _struct(
    version=STRING,
    input_size=INT,
    resize_shorter_side=INT,
    norm_mean=ArrayType(DOUBLE),
    norm_std=ArrayType(DOUBLE),
    calibration=_struct(type=STRING, temperature=DOUBLE, bias=DOUBLE),
    tta=_struct(enabled=BOOL, band_lo=DOUBLE, band_hi=DOUBLE, min_side=INT),
)

CACHE = _struct(url=STRING, score=DOUBLE, ms=LONG, tta=BOOL, model_version=STRING, seq=LONG)

OBSERVATION = _struct(page=LONG, url=STRING, w=INT, h=INT, disp_w=DOUBLE, disp_h=DOUBLE,
                      score=DOUBLE, tta=BOOL, error=STRING, ts=TimestampType())

CHUNK = _struct(ord=INT, container=STRING, kind=STRING, payload=BinaryType())

ISSUE = _struct(number=LONG, title=STRING, body=STRING, createdAt=TimestampType(),
                labels=ArrayType(_struct(name=STRING)))

REPORT = _struct(issue=LONG, created=TimestampType(), klass=STRING, score=DOUBLE, truth=STRING,
                 image_url=STRING, attachments=STRING, evidence=STRING)

GOLDEN = _struct(file=STRING, score=DOUBLE)

PARAMETER = _struct(ckpt=STRING, param=STRING, idx=LONG, value=DOUBLE)
