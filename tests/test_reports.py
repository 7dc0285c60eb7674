"""Report parsing, class by class and at the bounds of each."""

import pytest


from imgaudit import schemas
from imgaudit.functions import report_text
from imgaudit.operators import reports

FORM = ("### What is the image actually?\n\n{actual}\n\n### Image URL\n\nhttps://example.com/x.jpg"
        "\n\n### What did it say?\n\n{said}\n\n### Version\n\n1.0")

REAL, MADE = "Real / human-made", "AI-generated"
# what was said, the truth, class, score
CASES = [
    ("it wrote 91.25 % next to it", REAL, "false-positive", 0.9125),
    ("badge: 65%", REAL, "false-positive", 0.65),
    ("64.9%", REAL, "unsure-on-real", 0.649),
    ("exactly 50 %", REAL, "unsure-on-real", 0.5),
    ("49.9% only", REAL, "consistent", 0.499),
    ("0%", MADE, "false-negative", 0.0),
    ("49%", MADE, "false-negative", 0.49),
    ("50%", MADE, "borderline-miss", 0.5),
    ("64.99%", MADE, "borderline-miss", 0.6499),
    ("100%", MADE, "consistent", 1.0),
    ("first 20%, later 95%", MADE, "false-negative", 0.2),
    ("NOT   Analysed yet", REAL, "not-analyzed", None),
    ("33% but not analyzed", MADE, "not-analyzed", None),
    ("_No response_", REAL, "not-analyzed", None),
    ("quite sure, no number", REAL, "needs-review", None),
    ("999%", MADE, "needs-review", None),
    ("scored 2020%", REAL, "consistent", 0.2),
    ("72%", "Not certain", "needs-review", 0.72),
]


@pytest.fixture(scope="module")
def classified(spark):
    rows = [(i, FORM.format(said=said, actual=actual)) for i, (said, actual, *_) in enumerate(CASES)]
    df = spark.createDataFrame([*rows, (len(rows), None)], "id int, body string")
    return {r.id: r for r in reports.classify_reports(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_classification(classified, i):
    _, _, klass, score = CASES[i]
    assert classified[i].klass == klass
    assert classified[i].score == (None if score is None else pytest.approx(score))


def test_missing_body_needs_review(classified):
    assert classified[len(CASES)].klass == "needs-review"


def test_sections(spark):
    body = "### A\n\n one \n\ttwo \n### B\n\n### C\n\nlast\n"
    df = spark.createDataFrame([(body,)], "body string")
    r = df.select(*[report_text.extract_section("body", h).alias(h)
                    for h in ("a", "B", "C", "D")]).first()
    assert (r["a"], r["C"], r["D"]) == ("one \n\ttwo", "last", None)
    assert r["B"].startswith("### C")  # an empty section takes in the next heading


def _issue(number, title, labels, body):
    return (number, title, body, None, [(name,) for name in labels])


def test_label_changes(spark):
    body = FORM.format(said="AI 88%", actual=REAL)
    df = spark.createDataFrame([
        _issue(1, "[Misclassification] x", ["consistent", "bug"], body),
        _issue(2, "x", ["misclassification", "false-positive"], body),
        _issue(3, "x", ["bug"], body),
        _issue(4, "misclassification", [], ""),
    ], schemas.ISSUE)
    rows = {r.number: r for r in reports.label_changes(df).collect()}
    assert set(rows) == {1, 2, 4}
    assert (rows[1].remove, rows[1].add) == (["consistent"], ["misclassification", "false-positive"])
    assert rows[2].remove == [] and rows[4].klass == "needs-review"


def test_evidence_is_whole_and_links_are_joined(spark):
    body = ("### How do you know the true label?\n\n" + "word " * 2000
            + "\n\nhttps://github.com/user-attachments/q1)(https://github.com/user-attachments/q2")
    df = spark.createDataFrame([_issue(1, "t", [], body)], schemas.ISSUE)
    r = reports.mine_reports(df).first()
    assert r.evidence.startswith("word " * 2000) and r.image_url == ""
    assert r.attachments == ("https://github.com/user-attachments/q1 "
                             "https://github.com/user-attachments/q2")
    assert len(reports.mine_reports(df, evidence_chars=300).first().evidence) == 300
