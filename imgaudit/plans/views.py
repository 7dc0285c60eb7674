"""Input views derived from the driver tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgaudit.plans.registry import Tables

_Z = ("((doc_id*7919 + n_chars*31 + k*101) % 2001 - 1000)/200e0 "
      "+ 1.5e0*quality - 0.25e0*k")
_W, _H = "200 + doc_id*37 % 1400", "200 + doc_id*53 % 1000"

_SCORES = [
    "doc_id",
    "concat('img/', source, '_', lpad(CAST(doc_id AS STRING), 6, '0'), '.jpg') AS path",
    "quality AS label",
    "source",
    "lang AS subset",
    "view",
    f"{_Z} AS z",
    f"CASE WHEN least({_W}, {_H}) >= 384 THEN {_Z} + (doc_id*13 % 41 - 20)/10e0 END AS z_native",
    f"{_W} AS w",
    f"{_H} AS h",
]

_SHARDS = [
    "doc_id AS ord",
    "concat('core/train-', lpad(CAST(doc_id % 64 AS STRING), 5, '0'), '.parquet') AS file",
    "CASE WHEN doc_id % 3 = 0 THEN 'real' ELSE 'fake' END AS label",
    "CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 31 = 0 THEN '' "
    "ELSE concat('org/', source) END AS model",
    "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE text END AS payload",
    "CASE WHEN doc_id % 4 = 0 THEN 'Recraft V3' ELSE source END AS model1",
    "CASE WHEN doc_id % 4 = 2 THEN 'recraft-v2' END AS model2",
]

_CACHE = [
    "page_id AS seq",
    "url",
    "(page_id*7919 % 1000)/999e0 AS score",
    "CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 5 = 1 THEN 'old' ELSE 'cur' END "
    "AS model_version",
]

_REQUESTS = [
    "page_id AS req_id",
    "CASE WHEN page_id % 3 = 0 THEN url "
    "ELSE concat(split_part(url,'?',1), '?v=', page_id % 3) END AS url",
]

EVENTS = [
    "event_id",
    "ts",
    "user_id AS page",
    "concat('u', event_id % 400) AS url",
    "CASE event_type WHEN 'error' THEN 'fetch 503' WHEN 'signup' THEN 'too-small' END AS error",
    "CASE WHEN event_type NOT IN ('error','signup') THEN (event_id*7919 % 1000)/999e0 END "
    "AS score",
]

_SERIES = [
    "user_id AS grp",
    "event_id AS ord",
    "CASE user_id % 3 WHEN 0 THEN 50e0 WHEN 1 THEN value ELSE (event_id % 5000)/10e0 END AS x",
]

_GEOMETRY = ["doc_id", "40 + doc_id*37 % 2000 AS w", "40 + doc_id*53 % 1500 AS h"]

_REPORTS = [
    "doc_id AS issue",
    "CASE WHEN z >= 0e0 THEN concat('AI ', CAST(floor(100/(1+exp(-z))+0.5e0) AS INT), '%') "
    "ELSE 'not analyzed' END AS said",
    "CASE label WHEN 1 THEN 'AI-generated' ELSE 'Real / human-made' END AS actually",
]


def scores(t: Tables) -> DataFrame:
    """One row per labelled document and view, with a made-up logit."""
    views = F.array(*[F.struct(F.lit(v).alias("view"), F.lit(k).alias("k"))
                      for k, v in enumerate(("clean", "web", "hard"))])
    labelled = t.documents.select("doc_id", "source", "lang", "n_chars").join(
        t.labels.select("doc_id", "quality"), "doc_id")
    return labelled.select("*", F.inline(views)).selectExpr(*_SCORES)


def clean_scores(t: Tables) -> DataFrame:
    return scores(t).filter(F.col("view") == "clean")


def shards(t: Tables) -> DataFrame:
    return t.documents.selectExpr(*_SHARDS)


ADDRESS = ("stored_file", "stored_row")


def shard_rows(t: Tables) -> DataFrame:
    """The shards with the file that a row is read from and its number there."""
    return t.documents.select("*", F.col("_metadata.file_path").alias(ADDRESS[0]),
                              F.col("_metadata.row_index").alias(ADDRESS[1])).selectExpr(*_SHARDS, *ADDRESS)


def cache(t: Tables) -> DataFrame:
    return t.pages.filter("page_id % 2 = 0").selectExpr(*_CACHE)


def requests(t: Tables) -> DataFrame:
    return t.pages.selectExpr(*_REQUESTS)


def verdict_events(t: Tables) -> DataFrame:
    return t.events.selectExpr(*EVENTS)


def series(t: Tables) -> DataFrame:
    return t.events.selectExpr(*_SERIES)


def geometry(t: Tables) -> DataFrame:
    return t.documents.selectExpr(*_GEOMETRY)


def reports(t: Tables) -> DataFrame:
    return clean_scores(t).selectExpr(*_REPORTS)


def report_bodies(t: Tables) -> DataFrame:
    """Issues whose bodies follow the report form."""
    return reports(t).selectExpr(
        "issue AS number",
        "CASE WHEN issue % 5 = 0 THEN 'other' ELSE '[misclassification] x' END AS title",
        f"{BODY} AS body",
        "timestamp_seconds(1700000000 + issue * 60) AS createdAt",
        "CASE WHEN issue % 3 = 0 THEN array(named_struct('name', 'misclassification'), "
        "named_struct('name', 'consistent')) WHEN issue % 3 = 1 THEN "
        "array(named_struct('name', 'false-positive')) END AS labels")


BODY = ("concat('### What is the image actually?', chr(10), chr(10), actually, chr(10), chr(10), "
        "'### Image URL', chr(10), chr(10), 'https://example.com/', issue, '.jpg', chr(10), "
        "chr(10), '### What did it say?', chr(10), chr(10), said, chr(10), chr(10), "
        "'### How do you know the true label?', chr(10), chr(10), "
        "'see https://github.com/user-attachments/assets/', issue, ' and ', chr(10), "
        "'https://github.com/user-attachments/files/', issue, ')')")

_SQL = {
    "scores": ((), f"SELECT {', '.join(_SCORES)} FROM (SELECT d.doc_id, d.source, d.lang, "
               "d.n_chars, l.quality, v.view, v.k FROM documents d JOIN labels l ON "
               "d.doc_id = l.doc_id CROSS JOIN (VALUES ('clean',0),('web',1),('hard',2)) "
               "AS v(view,k))"),
    "shards": ((), f"SELECT {', '.join(_SHARDS)} FROM documents"),
    "cache": ((), f"SELECT {', '.join(_CACHE)} FROM pages WHERE page_id % 2 = 0"),
    "requests": ((), f"SELECT {', '.join(_REQUESTS)} FROM pages"),
    "verdict_events": ((), f"SELECT {', '.join(EVENTS)} FROM events"),
    "series": ((), f"SELECT {', '.join(_SERIES)} FROM events"),
    "geometry": ((), f"SELECT {', '.join(_GEOMETRY)} FROM documents"),
    "reports": (("scores",), f"SELECT {', '.join(_REPORTS)} FROM scores WHERE view = 'clean'"),
}


def sql(names: str, body: str) -> str:
    """An oracle statement: the named views (space separated) as CTEs, then the body.

    A body that starts with a CTE name goes on with the same WITH list.
    """
    wanted: list[str] = []
    for name in names.split():
        wanted += [n for n in (*_SQL[name][0], name) if n not in wanted]
    ctes = ", ".join(f"{n} AS ({_SQL[n][1]})" for n in wanted)
    body = body.strip()
    joint = " " if body.upper().startswith("SELECT") else ", "
    return f"WITH {ctes}{joint}{body}"


# ------------------------------------------------------------------ SQL fragments

def score_sql(z: str = "z", bias: float = 0.0, temperature: float = 1.0) -> str:
    return f"1e0/(1e0+exp(-({z}/{temperature}e0+{bias}e0)))"


def draw_sql(key: str, seed: str) -> str:
    return f"CAST(concat('0x', substr(md5(concat('{seed}:', {key})), 1, 13)) AS BIGINT)"


def unit_sql(key: str, seed: str) -> str:
    return f"({draw_sql(key, seed)}/4503599627370496e0)"


def int_sql(key: str, seed: str, low: str, high: str) -> str:
    return f"({low} + {draw_sql(key, seed)} % ({high} - {low} + 1))"


def list_sql(values) -> str:
    return "[" + ", ".join(f"{v!r}e0" for v in values) + "]"
