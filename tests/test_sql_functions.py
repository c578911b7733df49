"""The SQL functions give what the column expressions give."""

from pyspark.sql import functions as F

from rampart.functions import text as X

TEXTS = [
    None, "", "a", "aab", "   padded   ", r"x \x41A y", "QUJD" * 12, "go javascript:alert(1) now\nnext", "<SCRIPT src=x>\nbad</script>ok",
    "a" + " " * 12 + "b", "see https://a.b/c and http://d", "jane.doe@example.com", "4111-1111 1111 1111", "+1 (555) 123-4567", "short1", "naïve café ½ ​z",
]


def test_sql_functions_equal_columns(spark):
    X.register_sql_functions(spark)
    kinds = ["email", "credit_card", "ssn", "phone", "api_key"]
    df = spark.createDataFrame([(i, t, kinds[i % 5]) for i, t in enumerate(TEXTS)], "i int, t string, kind string")
    m = X.complexity_metrics("t")
    got = df.select(
        "i", F.expr("rampart_sanitize(t, false)").alias("a"), X.sanitize("t").alias("a2"), F.expr("rampart_sanitize(t, true)").alias("b"),
        X.sanitize("t", True).alias("b2"), F.expr("rampart_entropy(t)").alias("c"), X.shannon_entropy("t").alias("c2"),
        F.expr("rampart_mask_value(t, kind)").alias("d"), X.mask_value("t", "kind").alias("d2"),
        F.expr("rampart_complexity(t)").alias("e"), F.struct(*[c.alias(n) for n, c in m.items()]).alias("e2"),
        F.expr("rampart_luhn_valid(t)").alias("f"), X.luhn_valid("t").alias("f2"),
    ).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        for c in "abcdef":
            assert r[c] == r[c + "2"], (r.i, c, r[c], r[c + "2"])
