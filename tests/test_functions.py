import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docstrata.functions import masks, paths as P, pii, text as X
from docstrata.options import ProfileOptions
from docstrata.sources.readers import glob_to_regex, matches_filter


def apply(spark, values, fn, schema="x string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab.$\\[]0", max_size=8), min_size=1, max_size=20))
def test_unescape_inverts_escape(spark, keys):
    assert apply(spark, keys, lambda k: P.unescape_key(P.escape_key(k))) == keys


def test_paths(spark):
    assert apply(spark, ["a.b\\.c.[0].d", ".a..b.", ""], P.split_path) == [["a", "b\\.c", "[0]", "d"], ["a", "b"], []]
    assert apply(spark, ["[12]", "[x]", "12"], P.parse_array_index) == [12, None, None]
    assert apply(spark, ["a.[3].b", "a\\.[3].b"], P.normalize_path) == ["a.[*].b", "a\\.[3].b"]
    assert apply(spark, [["b10", "b9", "a.b", "a", "A.c"]], P.sort_paths, "x array<string>") == [["a", "a.b", "A.c", "b9", "b10"]]


@pytest.mark.parametrize(
    ("value", "mode", "want"),
    [("ab", "balanced", "**"), ("abcd", "balanced", "a**d"), ("abcdefgh", "balanced", "ab****gh"), ("hello", "strict", "h****"),
     ("x" * 40, "balanced", "xxx" + "*" * 10 + "xxx"), ("", "balanced", "")],
)
def test_mask_string(spark, value, mode, want):
    assert apply(spark, [value], lambda x: masks.mask_string(x, mode)) == [want]


def test_masks(spark):
    assert apply(spark, ["test@example.com", "a@b.com", "x@localhost", "plain", "ab@.com"], masks.mask_email) == [
        "t***@e***.com", "*@b***.com", "*@lo*****st", "p***n", "a***@***.com"]
    assert apply(spark, ["010-1234-5678", "2024", "12"], masks.mask_phone) == ["*******5678", "2024", "**"]
    assert apply(spark, ["2024"], lambda x: masks.mask_phone(x, mask_short=True)) == ["****"]
    assert apply(spark, ["12345", "7"], masks.mask_number) == ["1***5", "7"]


def test_mask_table_keeps_the_schema(spark):
    df = spark.sql("select named_struct('email', 'a1@b.com', 'n', 1) as who, array('x') as tags, 'Bob Smith' as name, 5 as k")
    out = masks.mask_table(df, ProfileOptions())
    assert out.schema.simpleString() == df.schema.simpleString()
    row = out.first()
    assert (row["who"]["email"], row["who"]["n"], row["tags"], row["name"], row["k"]) == ("a***@b***.com", 1, ["x"], "Bo*****th", 5)


def test_detection(spark):
    def detect(path, value, custom=()):
        df = spark.createDataFrame([(path, value)], "p string, v string")
        return df.select(pii.detect_pii(F.col("p"), F.col("v"), custom)).first()[0]

    assert detect("userEmail", None) == ["email"]
    assert detect("x", "test@example.com") == ["email"]
    assert "ssn" in detect("x", "123-45-6789")
    assert "credit_card" in detect("x", "4111-1111-1111-1111")
    assert detect("x", "550e8400-e29b-41d4-a716-446655440000") == ["uuid"]
    assert detect("x", "192.168.1.1") == ["phone", "ip_address"]
    assert "jwt" in detect("x", "eyJhbGci.eyJzdWIi.SflKxw")
    assert detect("address.detail", None) == ["address"]
    assert detect("location.[*].x", None) == ["location"]
    assert detect("hotel", None) == ["phone"] and detect("ci", None) == ["ci"] and detect("city", None) == []
    assert detect("vendor.id", None, ("vendor.*",)) == ["vendor"] and detect("vendor", None, ("vendor.*",)) == []
    assert detect("x", "a@b.com\n") == []


def test_warning_texts(spark):
    out = apply(spark, [["email", "custom"], []], pii.pii_warning, "x array<string>")
    assert out == ["Email address detected, PII: custom", None]


def test_text(spark):
    assert apply(spark, ["mail a@b.io or 010-1234-5678 now"], X.redact_text) == ["mail [REDACTED] or [REDACTED] now"]
    assert apply(spark, ["db://u:p@h/x", "http://h/x"], X.redact_uri_credentials) == ["db://***:***@h/x", "http://h/x"]
    assert apply(spark, ["a\r\nb", "x" * 101], X.preview_text) == ["a b", "x" * 97 + "..."]
    diff = lambda x: X.format_diff(x, F.array().cast("array<string>"))
    assert apply(spark, [["a", "b", "c", "d"], []], diff, "x array<string>") == ["+a, b, c... (+1 more)", "-"]
    assert apply(spark, [1234.0, 999.0], lambda n: X.format_count(n.cast("bigint")), "x double") == ["~1K", "~999"]
    blocks = apply(spark, ['say {"a": {"b": 2}} ok', "none", "{bad}"], lambda t: X.extract_json_block(t).cast("string"))
    assert blocks == ['{"a":{"b":2}}', None, None]


def test_globs():
    import re

    assert re.fullmatch(glob_to_regex("user*"), "users") and not re.fullmatch(glob_to_regex("user?"), "user")
    assert re.fullmatch(glob_to_regex("{a,b}[cd]"), "bd") and not re.fullmatch(glob_to_regex("[!a]x"), "ax")
    assert not matches_filter("system.views", None, None) and not matches_filter("logs", None, "log*")
