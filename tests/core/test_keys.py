"""Keys of texts of any length against the plain loop, and at a cost that is far below an expression's."""

import random
import time

from pyspark.sql import functions as F

from marginalia.functions import keys as K
from marginalia.functions import prose as P


def plain(text: bytes) -> int:
    h = K.BASIS
    for b in text:
        h = (h ^ b) * K.PRIME & K.MASK
    return h


def test_equal_to_the_loop():
    r = random.Random(3)
    for n in [0, 1, 99, 100, 101, 257, 5000, K.PART - 1, K.PART, K.PART + 1, 3 * K.PART + 17]:
        text = r.randbytes(n)
        assert K.fnv(text) == plain(text)


def test_long_texts_take_little_time(spark):
    # As an expression a character took about a microsecond: 20 s for these.
    text = "some words of a long text " * 800_000
    start = time.process_time()
    K.fnv(text.encode())
    assert time.process_time() - start < 5
    rows = spark.createDataFrame([("A b",), (None,), ("",)], "t string").select(P.site_key(F.col("t")).alias("k")).collect()
    assert [r.k and int(r.k) for r in rows] == [plain(b" a b "), None, plain(b" ")]
