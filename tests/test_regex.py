import pytest
from pyspark.sql import functions as F

from tidemark.functions.regex import BadPattern, to_java

CASES = [
    ("5..", "503", True), ("5..", "5031", False), ("a|b", "b", True), ("", "", True), (".*", "", True), ("x", "x\n", False), (".", "\n", False), (".", "\r", True), ("[[:alpha:]]+", "abC", True), ("[[:^digit:]]", "5", False),
    ("(?P<n>a)b", "ab", True), ("[]a]+", "]a", True), ("[^]a]", "]", False), ("[a&&b]+", "a&b", True), ("[a[b]", "[", True), (r"\s", "\x0b", False), (r"[\s]", " ", True), ("(?i)AB", "ab", True), ("a{2,3}", "aaa", True), ("x{", "x{", True), (r"\pL+", "é", True), (r"\Qa.b\E", "a.b", True),
    (r"\Qa.b\E", "axb", False), (r"\060\61", "01", True), (r"\x41", "A", True), (r"a\.b", "a.b", True),
]
BAD = ["(?i)*", "[z-a]", "(",  ")", "[a", "a**", "*a", "(?=x)", "(?!x)", "(?<=x)", r"\1", "a{1001}", "a{3,2}", "a\\", r"\Z", "[[:nope:]]", "a++", "(?>a)", r"\X"]


def test_whole_value_matches(spark):
    for pattern, value, want in CASES:
        row = spark.createDataFrame([(value,)], "v string").select(F.col("v").rlike(to_java(pattern)).alias("r")).first()
        assert row.r == want, (pattern, value)


@pytest.mark.parametrize("pattern", BAD)
def test_rejected(spark, pattern):
    with pytest.raises(BadPattern):
        to_java(pattern)
