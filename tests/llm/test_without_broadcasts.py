"""What is joined by shuffle once it is too large to broadcast gives the same rows."""

from __future__ import annotations

import pytest

from gridlark.llm import common, decontamination, exact_dedup, mixing, simhash

from .conftest import rows_of
from .test_decontamination import tests  # noqa: F401


@pytest.fixture
def shuffled(spark, monkeypatch):
    def off():
        monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    yield off
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_same_rows(spark, odd, shuffled, tests):  # noqa: F811
    items = spark.createDataFrame(tests, "item_id long, text string")
    runs = (lambda: exact_dedup.exact_duplicates(odd), lambda: decontamination.decontaminate(odd, items), lambda: mixing.mix(odd), lambda: simhash.near_duplicates(odd))
    first = [rows_of(r()) for r in runs]
    shuffled()
    assert [rows_of(r()) for r in runs] == first
