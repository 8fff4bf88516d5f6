"""Which lines of tools' outputs are told apart, phrase by phrase."""

from pyspark.sql import functions as F
from strataline.functions import views as V


def kept(spark, told, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.filter(told(F.col("t"))).collect()]


def test_lines(spark):
    assert kept(spark, V._is_complexity, ["a: Warning: x", "warnings", "CCN 12", "Cyclomatic", "my FUNCTION LENGTH is", "fine"]) == ["a: Warning: x", "CCN 12", "Cyclomatic", "my FUNCTION LENGTH is"]
    assert kept(spark, V._is_advisory, ["x is Affected By y", "2 packages", "packages are", "the Package", "GHSA-1", "see cve-2", "none", ""]) == ["x is Affected By y", "2 packages", "the Package", "GHSA-1", "see cve-2"]


def test_limitations(spark):
    texts = ["warning: './...' matched no packages", "matched no packages for ./...", "No packages to analyze", "a\nno buildable Go source files in x", "no test files", "x.go (compile)", "ok\n-: could", "all: well", "Package Pattern\nmatched no packages", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r[0].split(":")[0] for r in df.orderBy("i").select(V.static_limitation(F.col("t"))).collect()]
    universe, files, compiled = (n.split(":")[0] for n in V.STATIC_NOTES)
    assert got == [universe, compiled, universe, files, "", compiled, compiled, "", compiled, ""]
