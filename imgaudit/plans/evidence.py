"""Byte forensics, tensors and report mining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgaudit import fixed_values as fixed
from imgaudit.functions import images, report_text
from imgaudit.operators import analysis, degenerate, forensics, reports, scoring
from imgaudit.plans import views
from imgaudit.plans.registry import Tables, query, rounded
from imgaudit.plans.scalars import MODEL, MODEL_SQL
from imgaudit.plans.views import sql
from imgaudit.session import shared_dir
from imgaudit.sources import issues, manifests, sinks

_URI = fixed.C2PA_MARKERS[0][0]


def _chunk(kind: str, payload: str) -> str:
    return (f"concat(unhex(lpad(hex(octet_length({payload})), 8, '0')), "
            f"encode('{kind}', 'utf-8'), {payload}, X'00000000')")


def _text(keyword: str, body: str) -> str:
    return f"concat(encode('{keyword}', 'utf-8'), X'00', encode({body}, 'utf-8'))"


def _segment(marker: str, payload: str) -> str:
    return (f"concat(X'FF{marker}', unhex(lpad(hex(octet_length({payload}) + 2), 4, '0')), "
            f"{payload})")


_HEAD = "concat(X'89504E470D0A1A0A', " + _chunk("IHDR", "X'00000001000000010802000000'") + ", "
_END = ", " + _chunk("IEND", "X''")
_SCAN = ", X'FFDA0002A5C3', encode(text, 'utf-8'), X'FFD9')"
_MARK = f"encode('manifest {_URI}', 'utf-8')"
_JSON = """concat('{"', text)"""

# eight file kinds, dealt out by document
_FILES = [
    _HEAD + _chunk("tEXt", _text("parameters", "text")) + _END + ")",
    _HEAD + _chunk("tEXt", _text("prompt", _JSON)) + _END + ")",
    _HEAD + _chunk("tEXt", _text("prompt", "concat('-', text)")) + _END + ")",
    _HEAD + _chunk("iTXt", _text("workflow", "text")) + _END + ")",
    "concat(X'FFD8', " + _segment("EB", _MARK) + _SCAN,
    "concat(X'FFD8', " + _segment("FE", _MARK) + _SCAN,
    _HEAD + _chunk("IDAT", "encode(text, 'utf-8')") + _END + ", "
    + _chunk("tEXt", _text("parameters", "text")) + ")",
    f"concat(X'52494646', X'00000000', encode('WEBP', 'utf-8'), {_MARK})",
]


def _image_files(t: Tables, *more: str) -> DataFrame:
    """Each document's whole text wrapped as an image file, with more columns of the document."""
    kinds = " ".join(f"WHEN {i} THEN {expr}" for i, expr in enumerate(_FILES))
    return t.documents.selectExpr("doc_id", *more, f"CASE doc_id % 8 {kinds} END AS content")


@query("""SELECT doc_id, CASE WHEN doc_id % 8 IN (4, 5) THEN '.jpg' WHEN doc_id % 8 = 7 THEN '.webp'
              ELSE '.png' END AS format, doc_id % 8 IN (4, 5) AS is_jpeg FROM documents""")
def sniff_format(t: Tables) -> DataFrame:
    return _image_files(t).select("doc_id", images.sniff_format("content").alias("format"),
                                  images.is_jpeg("content").alias("is_jpeg"))


@query("""
    SELECT concat('sb_', source) AS source, concat(CASE WHEN doc_id % 9 = 0 THEN '.' ELSE '' END, doc_id,
        CASE WHEN doc_id % 8 IN (4, 5) THEN '.JPG' WHEN doc_id % 8 = 7 THEN '.webp' ELSE '.png' END) AS name
    FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 7 <> 0""")
def scan_image_dir(t: Tables) -> DataFrame:
    """Files of all documents, written by source and scanned; some are hidden or no images."""
    kind = F.col("doc_id") % 8
    ending = F.when(F.col("doc_id") % 7 == 0, ".txt").when(kind.isin(4, 5), ".JPG").when(
        kind == 7, ".webp").otherwise(".png")
    hidden = F.when(F.col("doc_id") % 9 == 0, ".").otherwise("")
    root = shared_dir(t.spark, "image-dir")
    files = _image_files(t, "source").withColumn("name", F.concat("source", F.lit("/"), hidden, F.col("doc_id").cast(
        "string"), ending))
    sinks.write_files(files, root)
    found = manifests.scan_image_dir(t.spark, root, "sb_", content=False)
    return found.select("source", images.basename("path").alias("name"))


@query("SELECT doc_id FROM documents WHERE doc_id % 6 <> 0")
def drop_appledouble(t: Tables) -> DataFrame:
    junk = F.concat(F.lit(bytes.fromhex(fixed.APPLEDOUBLE_MAGIC)), F.col("content"))
    files = _image_files(t).withColumn("content", F.when(F.col("doc_id") % 6 == 0, junk).otherwise(
        F.col("content")))
    return files.filter(~images.is_appledouble("content")).select("doc_id")


@query(sql("scores", """
    SELECT path FROM (SELECT concat('img/', CASE doc_id % 9 WHEN 0 THEN '.' WHEN 1 THEN '._' ELSE ''
        END, substr(path, 5)) AS path FROM scores WHERE view = 'clean')
    WHERE NOT starts_with(split_part(path, '/', 2), '.')"""))
def drop_hidden(t: Tables) -> DataFrame:
    kind = F.col("doc_id") % 9
    mark = F.when(kind == 0, ".").when(kind == 1, "._").otherwise("")
    named = views.clean_scores(t).select(
        F.concat(F.lit("img/"), mark, images.basename("path")).alias("path"))
    return named.filter(~images.is_hidden("path"))


_PAYLOAD = f"""CASE doc_id % 8 WHEN 0 THEN encode('parameters') || '\\x00'::BLOB || encode(text)
    WHEN 1 THEN encode('prompt') || '\\x00'::BLOB || encode(concat('{{"', text))
    WHEN 2 THEN encode('prompt') || '\\x00'::BLOB || encode(concat('-', text))
    WHEN 3 THEN encode('workflow') || '\\x00'::BLOB || encode(text)
    WHEN 6 THEN encode(text) ELSE encode('manifest {_URI}') END"""


@query(f"""
    SELECT doc_id, CAST(CASE WHEN doc_id % 8 IN (4, 5) THEN 0 ELSE 1 END AS INT) AS ord,
        CASE WHEN doc_id % 8 IN (4, 5) THEN 'jpeg' ELSE 'png' END AS container,
        CASE doc_id % 8 WHEN 3 THEN 'iTXt' WHEN 4 THEN 'APP11' WHEN 5 THEN 'COM'
            WHEN 6 THEN 'IDAT' ELSE 'tEXt' END AS kind,
        CAST(octet_length({_PAYLOAD}) AS INT) AS n_bytes, md5({_PAYLOAD}) AS digest
    FROM documents WHERE doc_id % 8 <> 7
    UNION ALL SELECT doc_id, 0, 'png', 'IHDR', 13, md5('\\x00\\x00\\x00\\x01\\x00\\x00\\x00\\x01\\x08\\x02\\x00\\x00\\x00'::BLOB)
    FROM documents WHERE doc_id % 8 IN (0, 1, 2, 3, 6)""")
def image_chunks(t: Tables) -> DataFrame:
    return forensics.image_chunks(_image_files(t), "doc_id").select(
        "doc_id", "ord", "container", "kind", F.octet_length("payload").alias("n_bytes"),
        F.md5("payload").alias("digest"))


_REASON = """CASE doc_id % 8 WHEN 0 THEN 'png:sd-parameters' WHEN 1 THEN 'png:comfyui-prompt'
    WHEN 3 THEN 'png:comfyui-workflow' WHEN 4 THEN 'c2pa:trainedAlgorithmicMedia' END"""


@query(f"""
    SELECT doc_id, CAST(CASE WHEN doc_id % 8 = 4 THEN 0 ELSE 1 END AS INT) AS ord, {_REASON} AS reason
    FROM documents WHERE doc_id % 8 IN (0, 1, 3, 4)""")
def marker_rules(t: Tables) -> DataFrame:
    chunks = forensics.image_chunks(_image_files(t), "doc_id", kinds=forensics.MARKER_KINDS)
    return forensics.marker_rules(chunks).select("doc_id", "ord", "reason")


@query(f"SELECT doc_id, doc_id % 8 IN (0, 1, 3, 4) AS hit, {_REASON} AS reason FROM documents")
def first_hits(t: Tables) -> DataFrame:
    return forensics.first_hits(_image_files(t), "doc_id")


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'c2pa:trainedAlgorithmicMedia'
              WHEN 1 THEN 'c2pa:compositeWithTrainedAlgorithmicMedia' END AS reason FROM documents""")
def c2pa_search(t: Tables) -> DataFrame:
    kind = F.col("doc_id") % 4
    inserted = F.when(kind == 0, F.concat(F.lit(fixed.C2PA_MARKERS[1][0] + " "), F.lit(_URI))).when(
        kind == 1, F.lit(fixed.C2PA_MARKERS[1][0])).otherwise("")
    payload = F.encode(F.concat("text", inserted, "text"), "utf-8")
    return t.documents.select("doc_id", forensics.c2pa_search(payload).alias("reason"))


_WIDE = 64


def _rasters(t: Tables, rows: int = 1, channels: int = 1) -> DataFrame:
    """Each document's whole text as an image, 64 pixels wide, padded with blanks.

    Heights are multiples of ``rows``; a pixel is one byte, or several of them as its channels.
    """
    content = F.encode("text", "utf-8")
    height = (F.ceil(F.octet_length(content) / (rows * channels * _WIDE)) * rows).cast("int")
    raster = t.documents.select("doc_id", content.alias("data"), height.alias("height"))
    padded = F.expr(f"rpad(data, height * {channels * _WIDE}, X'20')")
    return raster.filter("height > 0").select(
        F.col("doc_id").cast("string").alias("path"), "height", F.lit(_WIDE).alias("width"),
        F.lit(channels).alias("channels"), padded.alias("data"))


_STATS = f"""
    WITH raw AS (SELECT doc_id, hex(encode(text)) AS hx, octet_length(encode(text)) AS len
        FROM documents WHERE text <> ''),
    rows AS (SELECT doc_id, hx, len, CAST(ceil(len/64e0) AS BIGINT) AS height FROM raw),
    cells AS (SELECT doc_id, len, hx, unnest(range(0, height*64)) AS i, height FROM rows),
    pixels AS (SELECT doc_id, i // 64 AS y, i % 64 AS x, 0.299e0*0e0 + CASE WHEN i < len THEN
        CAST(CAST(concat('0x', substr(hx, 2*i + 1, 2)) AS INT) AS DOUBLE) ELSE 32e0 END AS v
        FROM cells),
    series AS (SELECT doc_id AS grp, y, x, v FROM pixels),
    pairs AS (SELECT grp, v AS x, lag(v) OVER (PARTITION BY grp, y ORDER BY x) AS a FROM series),
    sums AS (SELECT grp, count(*) AS n, sum(x*x)/count(*) - (sum(x)/count(*))*(sum(x)/count(*))
        AS variance, count(a) AS m, sum(a) AS sa, sum(CASE WHEN a IS NOT NULL THEN x END) AS sb,
        sum(a*x) AS sab, sum(a*a) AS saa, sum(CASE WHEN a IS NOT NULL THEN x*x END) AS sbb
        FROM pairs GROUP BY grp)
    SELECT CAST(grp AS VARCHAR) AS path, round(variance, 4) AS variance,
        round((sab/m - (sa/m)*(sb/m)) / sqrt(greatest((saa/m - (sa/m)*(sa/m))*(sbb/m - (sb/m)*(sb/m)),
            1e-9)), 4) AS correlation FROM sums"""


@query(_STATS)
def image_stats(t: Tables) -> DataFrame:
    return rounded(degenerate.image_stats(_rasters(t)), "variance", "correlation", digits=4)


_VIEWED = """SELECT doc_id, visit, 40 + doc_id*37 % 2000 AS w, 40 + doc_id*53 % 1500 AS h
    FROM documents CROSS JOIN (VALUES (0), (1)) AS v(visit)"""


@query(f"""
    WITH viewed AS ({_VIEWED}), stats AS ({_STATS}),
    hits AS (SELECT doc_id, {_REASON} AS reason FROM documents),
    scored AS (SELECT vec_id, 1e0/(1e0+exp(-({MODEL_SQL}))) AS score FROM embeddings),
    judged AS (SELECT doc_id, visit, least(w, h) >= 200 AS eligible, reason,
        CASE WHEN reason IS NOT NULL THEN NULL WHEN variance < 4 THEN 'degenerate-flat'
            WHEN correlation < 0.15e0 THEN 'degenerate-noise' END AS error, score
        FROM viewed JOIN hits USING (doc_id) LEFT JOIN stats ON path = CAST(doc_id AS VARCHAR)
            LEFT JOIN scored ON vec_id = doc_id),
    resolved AS (SELECT *, CASE WHEN NOT eligible OR error IS NOT NULL AND reason IS NULL THEN NULL
        WHEN reason IS NOT NULL THEN 0.99e0 ELSE score END AS final FROM judged)
    SELECT doc_id, visit, eligible, CASE WHEN eligible THEN reason END AS reason,
        CASE WHEN eligible THEN error END AS error, round(final, 6) AS score,
        CASE WHEN final >= 0.65e0 THEN 'AI' WHEN final >= 0.5e0 THEN 'unsure'
            WHEN final IS NOT NULL THEN 'low' END AS band FROM resolved""")
def analyse(t: Tables) -> DataFrame:
    """Every document's file asked for twice, displayed at half its size."""
    viewed = t.documents.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("visit"))
    requests = viewed.selectExpr("doc_id", "visit", "40 + doc_id*37 % 2000 AS w", "40 + doc_id*53 % 1500 AS h",
                                 "CAST(doc_id AS STRING) AS url")
    requests = requests.withColumns({f"disp_{c}": F.col(c) / 2 for c in ("w", "h")})
    files = _image_files(t).withColumn("url", F.col("doc_id").cast("string"))
    rasters = _rasters(t).withColumnRenamed("path", "url")
    vectors = t.embeddings.select(F.col("vec_id").cast("string").alias("url"), F.col("embedding").alias("vector"))
    found = analysis.analyse(requests, files.select("url", "content"), rasters, vectors,
                             scoring.linear_scorer(MODEL, 0.1), 64)
    return rounded(found.select("doc_id", "visit", "eligible", "reason", "error", "score", "band"), "score")


@query("""
    WITH raw AS (SELECT doc_id, hex(encode(text)) AS hx, octet_length(encode(text)) AS len
        FROM documents WHERE text <> ''),
    sized AS (SELECT *, CAST(ceil(len/4096e0) AS BIGINT)*64 AS h FROM raw),
    dims AS (SELECT DISTINCT h, greatest(24, floor(h*(32e0/least(h, 64)) + 0.5e0)) AS rows,
        greatest(24, floor(64*(32e0/least(h, 64)) + 0.5e0)) AS cols FROM sized),
    axes AS (SELECT h, 'y' AS axis, h AS n, rows AS size FROM dims
        UNION ALL SELECT h, 'x', 64, cols FROM dims),
    outs AS (SELECT *, unnest(range(24)) AS i FROM axes),
    centred AS (SELECT *, ((CAST(size AS BIGINT) - 24)//2 + i + 0.5e0)*(n/size) AS c,
        greatest(n/size, 1e0) AS width FROM outs),
    taps AS (SELECT *, unnest(range(CAST(greatest(0, floor(c - width)) AS BIGINT),
        CAST(least(n, ceil(c + width) + 1) AS BIGINT))) AS k FROM centred),
    reach AS (SELECT h, axis, i, k, greatest(0e0, 1 - abs(k + 0.5e0 - c)/width) AS w FROM taps),
    weights AS (SELECT h, axis, i, k, w / sum(w) OVER (PARTITION BY h, axis, i) AS w FROM reach),
    values AS (SELECT s.doc_id, y.i AS yi, x.i AS xi, sum(y.w*x.w*CASE WHEN y.k*64 + x.k < s.len THEN
            CAST(CAST(concat('0x', substr(s.hx, 2*(y.k*64 + x.k) + 1, 2)) AS INT) AS DOUBLE)
            ELSE 32e0 END) AS v
        FROM sized s JOIN weights y ON y.h = s.h AND y.axis = 'y' AND y.w > 0
            JOIN weights x ON x.h = s.h AND x.axis = 'x' AND x.w > 0 GROUP BY ALL)
    SELECT CAST(doc_id AS VARCHAR) AS path, CAST(3*24*24 AS INT) AS n, round(3*sum(CAST(CAST(
        (least(255, greatest(0, floor(v + 0.5e0)))/255e0 - 0.5e0)/0.5e0 AS FLOAT) AS DOUBLE)), 3) AS total
    FROM values GROUP BY doc_id""")
def prepare_tensors(t: Tables) -> DataFrame:
    """Heights are multiples of 64, so that all weights are exact and so are halves."""
    tensors = scoring.prepare_tensors(_rasters(t, 64), shorter=32, crop=24, preset="half")
    total = F.aggregate("tensor", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return tensors.select("path", F.size("tensor").alias("n"), F.round(total, 3).alias("total"))


@query("""
    WITH raw AS (SELECT doc_id, hex(encode(text)) AS hx, octet_length(encode(text)) AS len
        FROM documents WHERE text <> ''),
    sized AS (SELECT *, CAST(ceil(len/12288e0) AS BIGINT)*64 AS h FROM raw),
    dims AS (SELECT DISTINCT h, greatest(24, floor(h*(32e0/least(h, 64)) + 0.5e0)) AS rows,
        greatest(24, floor(64*(32e0/least(h, 64)) + 0.5e0)) AS cols FROM sized),
    axes AS (SELECT h, 'y' AS axis, h AS n, rows AS size FROM dims
        UNION ALL SELECT h, 'x', 64, cols FROM dims),
    outs AS (SELECT *, unnest(range(24)) AS i FROM axes),
    centred AS (SELECT *, ((CAST(size AS BIGINT) - 24)//2 + i + 0.5e0)*(n/size) AS c,
        greatest(n/size, 1e0) AS width FROM outs),
    taps AS (SELECT *, unnest(range(CAST(greatest(0, floor(c - width)) AS BIGINT),
        CAST(least(n, ceil(c + width) + 1) AS BIGINT))) AS k FROM centred),
    reach AS (SELECT h, axis, i, k, greatest(0e0, 1 - abs(k + 0.5e0 - c)/width) AS w FROM taps),
    weights AS (SELECT h, axis, i, k, w / sum(w) OVER (PARTITION BY h, axis, i) AS w FROM reach),
    values AS (SELECT s.doc_id, c.c, y.i AS yi, x.i AS xi, sum(y.w*x.w*CASE WHEN (y.k*64 + x.k)*3 + 2 - c.c < s.len
            THEN CAST(CAST(concat('0x', substr(s.hx, 2*((y.k*64 + x.k)*3 + 2 - c.c) + 1, 2)) AS INT) AS DOUBLE)
            ELSE 32e0 END) AS v
        FROM sized s JOIN weights y ON y.h = s.h AND y.axis = 'y' AND y.w > 0
            JOIN weights x ON x.h = s.h AND x.axis = 'x' AND x.w > 0, (SELECT unnest(range(3)) AS c) c GROUP BY ALL)
    SELECT CAST(doc_id AS VARCHAR) AS path, md5(string_agg(CAST(CAST(least(255, greatest(0, floor(v + 0.5e0)))
        AS INT) AS VARCHAR), ',' ORDER BY c, yi, xi)) AS levels FROM values GROUP BY doc_id""")
def prepare_tensor_values(t: Tables) -> DataFrame:
    """Coloured images that are mostly not square; every value counts, by place and channel."""
    tensors = scoring.prepare_tensors(_rasters(t, 64, 3), shorter=32, crop=24, preset="half")
    level = F.transform("tensor", lambda v: F.round((v.cast("double") * 0.5 + 0.5) * 255).cast("int").cast("string"))
    return tensors.select("path", F.md5(F.array_join(level, ",")).alias("levels"))


# ------------------------------------------------------------------ reports

_WORDS = ("CASE WHEN issue % 7 = 0 THEN concat(said, ' maybe 1050%') WHEN issue % 7 = 1 THEN "
          "'_No response_' WHEN issue % 7 = 2 THEN 'score 870%' ELSE said END")
_SCORE = r"""CASE WHEN regexp_matches(lower(said), 'not\s*analy[sz]ed|_no response_') THEN NULL ELSE
    CAST(nullif(regexp_extract(lower(said), '(\d{1,3}(?:\.\d+)?)\s*%', 1), '') AS DOUBLE)/100e0 END"""
_PARSED = rf"""
    worded AS (SELECT issue, {_WORDS} AS said, actually FROM reports),
    parsed AS (SELECT issue, CASE WHEN s BETWEEN 0 AND 1 THEN s END AS score,
        CASE WHEN regexp_matches(lower(said), 'not\s*analy[sz]ed|_no response_') THEN false
            WHEN s BETWEEN 0 AND 1 THEN true END AS analyzed,
        CASE WHEN actually = 'AI-generated' THEN 'ai' ELSE 'real' END AS truth
        FROM (SELECT *, {_SCORE} AS s FROM worded)),
    classed AS (SELECT *, CASE WHEN score IS NULL AND analyzed = false THEN 'not-analyzed'
        WHEN score IS NULL THEN 'needs-review'
        WHEN truth = 'real' AND score >= 0.65e0 THEN 'false-positive'
        WHEN truth = 'ai' AND score < 0.5e0 THEN 'false-negative'
        WHEN truth = 'ai' AND score < 0.65e0 THEN 'borderline-miss'
        WHEN truth = 'real' AND score >= 0.5e0 THEN 'unsure-on-real' ELSE 'consistent' END AS klass
        FROM parsed)"""


@query(sql("reports", f"{_PARSED} SELECT issue, score, analyzed FROM parsed"))
def parse_verdict(t: Tables) -> DataFrame:
    worded = views.reports(t).selectExpr("issue", f"{_WORDS} AS said")
    return worded.select("issue", report_text.parse_verdict("said").alias("v")).select(
        "issue", "v.score", "v.analyzed")


@query(sql("reports", """
    SELECT issue, CASE WHEN issue % 6 = 0 THEN 'uncertain' WHEN issue % 6 = 1 THEN NULL
        WHEN actually = 'AI-generated' THEN 'ai' ELSE 'real' END AS truth FROM reports"""))
def parse_truth(t: Tables) -> DataFrame:
    kind = F.col("issue") % 6
    actually = F.when(kind == 0, "Not certain").when(kind == 1, "no idea").otherwise(
        F.col("actually"))
    return views.reports(t).select("issue", report_text.parse_truth(actually).alias("truth"))


@query(sql("reports", f"{_PARSED} SELECT issue, klass FROM classed"))
def classify_report(t: Tables) -> DataFrame:
    worded = views.reports(t).selectExpr("issue", f"{_WORDS} AS said", "actually")
    verdict = report_text.parse_verdict("said")
    klass = report_text.classify_report(report_text.parse_truth("actually"), verdict["score"],
                                        verdict["analyzed"])
    return worded.select("issue", klass.alias("klass"))


@query(sql("reports", """
    SELECT issue AS number, said, actually, CAST(NULL AS VARCHAR) AS absent FROM reports"""))
def extract_section(t: Tables) -> DataFrame:
    return views.report_bodies(t).select(
        "number", report_text.extract_section("body", fixed.SAID_HEADING).alias("said"),
        report_text.extract_section("body", fixed.ACTUAL_HEADING).alias("actually"),
        report_text.extract_section("body", "No such heading").alias("absent"))


MINED = _PARSED.replace(_WORDS, "said")
_LINKS = """concat('https://github.com/user-attachments/assets/', issue,
    ' https://github.com/user-attachments/files/', issue)"""
_EVIDENCE = """concat('see https://github.com/user-attachments/assets/', issue, ' and ', chr(10),
    'https://github.com/user-attachments/files/', issue, ')')"""


@query(sql("reports", f"""
    {MINED} SELECT issue, klass, score, truth, concat('https://example.com/', issue, '.jpg')
        AS image_url, {_LINKS} AS attachments, {_EVIDENCE} AS evidence FROM classed"""))
def mine_reports(t: Tables) -> DataFrame:
    return reports.mine_reports(views.report_bodies(t)).drop("created")


@query(sql("reports", f"""
    {MINED} SELECT issue, klass, score, truth, concat('https://example.com/', issue, '.jpg')
        AS image_url, {_LINKS} AS attachments, replace({_EVIDENCE}, chr(10), ' ') AS evidence
    FROM classed WHERE issue % 3 = 0"""))
def reports_csv(t: Tables) -> DataFrame:
    """Issues written and read as JSON, mined, written and read as CSV."""
    root = shared_dir(t.spark, "reports")
    views.report_bodies(t).write.json(f"{root}/issues")
    labelled = issues.read_issues(t.spark, f"{root}/issues", multi_line=False)
    issues.write_reports_csv(reports.mine_reports(labelled).drop("created"), f"{root}/mined")
    return t.spark.read.schema("issue long, klass string, score double, truth string, image_url "
                               "string, attachments string, evidence string").options(
        header=True, escape='"').csv(f"{root}/mined")


@query(sql("reports", f"""
    {MINED} SELECT issue AS number, klass, concat('misclassification,', klass) AS added,
        CASE WHEN issue % 3 = 0 AND klass <> 'consistent' THEN 'consistent'
            WHEN issue % 3 = 1 AND klass <> 'false-positive' THEN 'false-positive' ELSE '' END AS removed
    FROM classed WHERE issue % 5 <> 0 OR issue % 3 = 0"""))
def reconcile_labels(t: Tables) -> DataFrame:
    return reports.label_changes(views.report_bodies(t)).select(
        "number", "klass", F.array_join("add", ",").alias("added"),
        F.array_join("remove", ",").alias("removed"))
