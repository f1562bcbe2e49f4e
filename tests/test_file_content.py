"""File contents from base64: as Spark's own decoder has them."""

import itertools

from pyspark.sql import functions as F

from patchloom.sources import landed

ODD = ["", "=", "====", "QQ==\r\n", "Q Q=\t=", "*not base64*", "\u00e9QUJD", "QUJD\nRA", "QUJDR", "QUJDRA=", "QUJD=RA=", "//8=", "4pyT", "a-b_", "QQ\r\r\n=="]


def test_contents_as_the_plain_decoder_has_them(spark):
    every = ["".join(w) for n in range(7) for w in itertools.product("Aq=*\n", repeat=n) if n < 6 or w[0] == "A"]
    files = spark.createDataFrame([(k, c, 1) for k, c in enumerate(every + ODD + [None])], "k long, content_b64 string, size long")
    letters = F.regexp_replace("content_b64", "[^A-Za-z0-9+/=]", "")
    plain = F.coalesce(F.make_valid_utf8(F.try_to_binary(letters, F.lit("base64")).cast("string")), F.lit(""))
    found = landed.file_content(files, ["k", "content_b64"]).withColumn("plain", plain)
    assert found.count() == len(every) + len(ODD) + 1
    assert found.filter(~F.col("content").eqNullSafe(F.col("plain"))).collect() == []
    assert found.filter("content != ''").count() > 100


def test_no_search_and_no_check_at_each_character(spark):
    """Line ends go by plain replacements, letters are checked by one pattern, and the search is left for texts with other characters."""
    files = spark.createDataFrame([(1, "QUJD", 1)], "id long, content_b64 string, size long")

    def plan(frame):
        return frame._jdf.queryExecution().optimizedPlan().toString().lower()

    found = plan(landed.file_content(files, ["id"]))
    searched = plan(files.select(F.try_to_binary(F.regexp_replace("content_b64", "[^A-Za-z0-9+/=]", ""), F.lit("base64"))))
    assert "try" in searched and "try" not in found
    assert found.count("regexp_replace(") == 1 and "case when rlike(" in found.replace("case when (", "case when ") and "replace(replace(" in found
