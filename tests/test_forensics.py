"""Structural markers: where they count and where they are spoofed."""

import pytest
from pyspark.sql import functions as F

from image_files import PNG_SIGNATURE, URI, chunk, jpeg, png, segment, text
from imgaudit.functions import images
from imgaudit.operators import forensics

GRAPH = b'{"nodes": 3}'
OTHER = b"compositeWithTrainedAlgorithmicMedia"
LONG = b"\x01" * 700_000

# rule by rule: file, reason
CASES = {
    # text chunks by their keyword
    "parameters in tEXt": (png(extra=[text(b"tEXt", b"parameters", b"seed 7, cfg 4")]), "png:sd-parameters"),
    "parameters in iTXt": (png(extra=[text(b"iTXt", b"parameters", b"")]), "png:sd-parameters"),
    "prompt with a graph": (png(extra=[text(b"tEXt", b"prompt", GRAPH)]), "png:comfyui-prompt"),
    "prompt in iTXt needs no graph": (png(extra=[text(b"iTXt", b"prompt", b"a hill")]), "png:comfyui-prompt"),
    "prompt in words": (png(extra=[text(b"tEXt", b"prompt", b"a hill at dusk")]), None),
    "workflow with a graph": (png(extra=[text(b"tEXt", b"workflow", GRAPH)]), "png:comfyui-workflow"),
    "workflow as a list": (png(extra=[text(b"tEXt", b"workflow", b"[1]")]), None),
    "another keyword": (png(extra=[text(b"tEXt", b"Software", GRAPH)]), None),
    "keyword in another case": (png(extra=[text(b"tEXt", b"Parameters", b"x")]), None),
    "keyword that does not end": (png(extra=[chunk(b"tEXt", b"workflow" + GRAPH)]), None),
    "keyword in a private chunk": (png(extra=[text(b"zzZz", b"parameters", b"x")]), None),
    # vocabulary uris by where they stand
    "uri in APP1": (jpeg(segment(0xE1, b"<rdf>" + URI + b"</rdf>")), "c2pa:trainedAlgorithmicMedia"),
    "uri in APP11": (jpeg(segment(0xEB, b"box" + URI)), "c2pa:trainedAlgorithmicMedia"),
    "uri in APP2": (jpeg(segment(0xE2, URI)), None),
    "uri in a comment segment": (jpeg(segment(0xFE, URI)), None),
    "uri behind the image": (jpeg(trailing=URI), None),
    "uri in caBX": (png(extra=[chunk(b"caBX", b"\0\0" + OTHER)]), "c2pa:" + OTHER.decode()),
    "uri in an XMP packet": (png(extra=[text(b"iTXt", b"XML:com.adobe.xmp", b"\0\0\0\0" + OTHER)]),
                             "c2pa:" + OTHER.decode()),
    "uri in other international text": (png(extra=[text(b"iTXt", b"Description", URI)]), None),
    "uri behind IEND": (png(trailing=chunk(b"caBX", URI)), None),
    "chunk named like a segment": (png(extra=[chunk(b"APP1", URI)]), None),
    "uri in a file of another kind": (b"GIF89a" + URI, None),
    # order
    "earlier pattern of the table, later in the bytes": (
        jpeg(segment(0xE1, OTHER + b" / " + URI)), "c2pa:trainedAlgorithmicMedia"),
    "earlier chunk of the file": (
        png(extra=[chunk(b"caBX", OTHER), text(b"tEXt", b"parameters", b"x")]), "c2pa:" + OTHER.decode()),
    # walking
    "marker far into the file": (png(extra=[chunk(b"ruBs", LONG), text(b"tEXt", b"parameters", b"x")]),
                                 "png:sd-parameters"),
    "marker at the end of a long chunk": (png(extra=[chunk(b"caBX", LONG + URI)]), "c2pa:trainedAlgorithmicMedia"),
    "chunk longer than the file": (PNG_SIGNATURE + b"\x7f\0\0\0tEXtparameters\0ab", "png:sd-parameters"),
    "fill bytes before a segment": (b"\xff\xd8\xff\xff\xff" + segment(0xE1, URI)[1:], "c2pa:trainedAlgorithmicMedia"),
    "restart marker before a segment": (b"\xff\xd8\xff\xd3" + jpeg(segment(0xEB, URI))[2:],
                                        "c2pa:trainedAlgorithmicMedia"),
    "segment shorter than its own length": (b"\xff\xd8\xff\xeb\0\0" + URI, None),
    "bytes between segments": (b"\xff\xd8\xff\xe0\0\x02\x55" + segment(0xEB, URI), None),
    "no bytes": (b"", None),
    "null": (None, None),
}


@pytest.fixture(scope="module")
def hits(spark):
    files = spark.createDataFrame([(k, v[0] if v[0] is None else bytearray(v[0])) for k, v in CASES.items()],
                                  "path string, content binary")
    return {r.path: r for r in forensics.first_hits(files).collect()}


@pytest.mark.parametrize("name", CASES)
def test_first_hit(hits, name):
    expected = CASES[name][1]
    assert (hits[name].reason, hits[name].hit) == (expected, expected is not None)


def test_window_clips(spark):
    """With a window, markers beyond it are not seen and payloads end there."""
    window = 524_288
    names = ["marker far into the file", "marker at the end of a long chunk", "parameters in tEXt"]
    files = spark.createDataFrame([(n, bytearray(CASES[n][0])) for n in names], "path string, content binary")
    found = {r.path: r.reason for r in forensics.first_hits(files, window=window).collect()}
    assert found == {names[0]: None, names[1]: None, names[2]: "png:sd-parameters"}
    chunks = forensics.image_chunks(files, window=window).filter("kind IN ('ruBs', 'caBX')").collect()
    assert all(len(r.payload) < window for r in chunks) and len(chunks) == 2


def test_first_hits_scans_once_without_a_shuffle(spark):
    files = spark.createDataFrame([(1, bytearray(png()))], "id int, content binary")
    plan = forensics.first_hits(files, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


@pytest.mark.parametrize("kind", ["string", "short", "decimal(9,0)", "struct<a:int,b:string>"])
def test_keys_of_any_type(spark, kind):
    key = "named_struct('a', 5, 'b', 'x')" if kind.startswith("struct") else f"CAST(5 AS {kind})"
    files = spark.createDataFrame([(bytearray(png(extra=[text(b"tEXt", b"parameters", b"x")])),)],
                                  "content binary").selectExpr(f"{key} AS k", "content")
    row = forensics.first_hits(files, "k").first()
    assert row.hit and row.k is not None


def test_chunks_of_a_png(spark):
    files = spark.createDataFrame([(1, bytearray(png(extra=[text(b"tEXt", b"a", b"b")])))],
                                  "id int, content binary")
    rows = forensics.image_chunks(files, "id").orderBy("ord").collect()
    assert [r.kind for r in rows] == ["IHDR", "tEXt", "IDAT"]
    assert bytes(rows[1].payload) == b"a\0b"


def test_formats_and_junk(spark):
    cases = {"a": (jpeg(), ".jpg", False), "b": (png(), ".png", False),
             "c": (b"RIFF\0\0\0\0WEBPVP8 ", ".webp", False), "d": (b"RIFF\0\0\0\0WAVE", ".jpg", False),
             "e": (bytes.fromhex("00051607") + b"Mac", ".jpg", True), "f": (b"", ".jpg", False)}
    df = spark.createDataFrame([(k, bytearray(v[0])) for k, v in cases.items()],
                               "path string, content binary")
    rows = df.select("path", images.sniff_format("content").alias("ext"),
                     F.coalesce(images.is_appledouble("content"), F.lit(False)).alias("junk")).collect()
    assert {r.path: (r.ext, r.junk) for r in rows} == {k: v[1:] for k, v in cases.items()}
