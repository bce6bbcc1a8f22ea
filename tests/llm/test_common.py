"""Settings and helpers that the operators share."""

import pytest

from cairn.llm.common import BATCH_BYTES, small_batches

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize(("set_to", "then"), [("64m", str(BATCH_BYTES)), ("67108864b", str(BATCH_BYTES)), ("1g", str(BATCH_BYTES)), ("64k", "64k"), ("1000", "1000")])
def test_any_spelling_of_a_size_is_understood(spark, set_to, then):
    before = spark.conf.get(NAME)
    try:
        spark.conf.set(NAME, set_to)
        assert small_batches(spark.range(3)).count() == 3
        assert spark.conf.get(NAME).rstrip("b") == then.rstrip("b")
    finally:
        spark.conf.set(NAME, before)
