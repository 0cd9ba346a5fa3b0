import re

import pytest

from skein.functions.regex import anchored, like, to_java, to_python


@pytest.mark.parametrize(
    "pattern,text,hit",
    [("a$", "a\n", False), ("a$", "a", True), ("^.+$", "a\rb", True), ("^.+$", "a\nb", False), ("[[:alpha:]]+x", "abx", True), ("[a&&b]x", "&x", True), ("[]a]x", "]x", True), ("[^]a]x", "]x", False), ("(?P<n>a)b", "ab", True), (r"a\$", "a$", True), ("(?m)^b$", "a\nb\nc", True), ("[[]x", "[x", True)],
)
def test_to_java(spark, pattern, text, hit):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(to_java(pattern)).alias("h")).collect()[0].h == hit
    if "\r" not in text:
        assert (re.search(to_python(pattern), text) is not None) == hit


def test_anchored_and_globs(spark):
    from pyspark.sql import functions as F

    row = lambda p, t: spark.createDataFrame([(t,)], "t string").select(F.col("t").rlike(p).alias("h")).collect()[0].h
    assert row(anchored("a|b"), "b") and not row(anchored("a|b"), "ab") and row(anchored("a.b"), "a\nb") and not row(anchored("a"), "a\n")
    assert row(like("a*[b-d]?"), "axxcz") and not row(like("a*[!b]"), "ab") and row(like("a.b"), "a.b") and not row(like("a.b"), "axb")


@pytest.mark.parametrize("pattern", ["(?=a)", "(?<!a)b", r"(a)\1", "(?>a)"])
def test_refused(pattern):
    with pytest.raises(ValueError):
        to_java(pattern)
    re.compile(pattern)
