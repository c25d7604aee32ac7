"""Intermediate tables are kept until they are released."""

import pytest

from vigilog import session


def test_stored_tables_are_released(spark, monkeypatch):
    monkeypatch.setattr(session, "_stored", {})  # other tests go on reading theirs
    table = session.stored(spark.range(5))
    again = session.stored(table.filter("id > 1"))
    assert (table.count(), again.count()) == (5, 3)
    folder = table.inputFiles()[0].rsplit("/", 1)[0]
    assert session.release_tables(spark) == 2 and session.release_tables(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder)
