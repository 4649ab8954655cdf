import re

from pyspark.sql import functions as F

from veilspark.functions import fixed as X
from veilspark.functions.spans import spans

TEXTS = [
    "mail a.b@x.com, c@d.org; ip 10.0.0.1 and 999.1.1.1 😀 ip 8.8.8.8",
    "émile é123-45-6789 123-45-6789 ☃ 4111 1111 1111 1111",
    "",
    None,
    "no matches here",
]
PATTERNS = [X.EMAIL_PATTERN, X.IPV4_PATTERN, X.SSN_PATTERN, X.CARD_PATTERN, X.PIN_CANDIDATE]


def test_spans_equal_python_finditer(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    cols = [spans(F.col("text"), p).alias(f"p{j}") for j, p in enumerate(PATTERNS)]
    rows = df.select("id", "text", *cols).collect()
    for r in rows:
        for j, p in enumerate(PATTERNS):
            got = r[f"p{j}"]
            if r.text is None:
                assert got is None
                continue
            want = [(m.start(), m.end(), m.group(0)) for m in re.finditer(p, r.text)]
            assert [(s.start, s.end, s.value) for s in got] == want, (p, r.text)


def test_group_spans_report_suffix_group(spark):
    df = spark.createDataFrame([("my password: Hunter22x and password is abcd1234",)], "text string")
    got = df.select(spans(F.col("text"), X.PASSWORD_PATTERN, 1).alias("s")).collect()[0].s
    t = "my password: Hunter22x and password is abcd1234"
    want = [(m.start(1), m.end(1), m.group(1)) for m in re.finditer(X.PASSWORD_PATTERN, t)]
    assert [(s.start, s.end, s.value) for s in got] == want
