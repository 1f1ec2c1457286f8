"""What a task of contamination holds: arrays and bytes, not a string and a list for each asked text."""

import numpy as np

from evalloom.operators.contamination import Asked, _in_blocks


def test_a_block_is_arrays_with_every_text_under_its_key(spark):
    rows = [("no key", None), ("zwölf", 5), ("b", -3), ("", 5), ("cc", 9)]
    texts = spark.createDataFrame(rows, "low string, key long")
    (block,) = _in_blocks(texts, 1 << 20)
    asked = Asked(np.zeros(8, np.uint8), *block)
    assert asked.keyless == 1 and asked.text(0) == b"no key" and asked.keys.tolist() == [-3, 5, 9] and isinstance(asked.texts, bytes)
    got = {(asked.text(i).decode(), key) for j, key in enumerate(asked.keys.tolist()) for i in range(asked.firsts[j], asked.firsts[j + 1])}
    assert got == set(rows[1:])
    (empty,) = _in_blocks(texts.filter("false"), 1 << 20)
    assert len(empty[0]) == 0 and empty[3] == b"" and empty[4] == 0
