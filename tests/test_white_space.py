"""White space is told with few comparisons, and told as before."""

import random

from claimweave.functions import text
from pyspark.sql import functions as F


def test_white_space_is_squeezed_as_before(spark):
    every = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x10000)]))
    draw, odd = random.Random(3), text.SPACE_CHARS + "aß中​ᚁ﻾"
    rows = [(every[i : i + 500],) for i in range(0, len(every), 500)] + [("".join(draw.choice(odd + " " * 20) for _ in range(draw.randrange(30))),) for _ in range(400)] + [(None,)]
    other = text.SPACE_CLASS.replace(" ", "", 1)
    old = text.strip(F.regexp_replace("t", f"{other}{text.SPACE_CLASS}*| {text.SPACE_CLASS}+", " "))
    df = spark.createDataFrame(rows, "t string")
    assert df.where(~text.squeeze(F.col("t")).eqNullSafe(old)).collect() == []
    pattern = text.squeeze(F.col("t"))._jc.toString()
    assert "&&" in pattern and text.SPACE_CLASS not in pattern
