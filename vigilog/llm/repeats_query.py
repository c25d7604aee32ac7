"""op7: documents without byte strings of 200 that occur twice. Checked against brute force."""

from __future__ import annotations

from vigilog.llm.registry import query, table
from vigilog.llm.repeats import without_repeats


@query("op7_suffix_dedup")
def op7_suffix_dedup(spark, sf_dir):
    return without_repeats(table(spark, sf_dir, "documents"))
