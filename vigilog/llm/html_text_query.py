"""op9: the main text of all pages. Checked against texts that made pages were built from."""

from __future__ import annotations

from vigilog.llm.html_text import extracted
from vigilog.llm.registry import query, table


@query("op9_html_text")
def op9_html_text(spark, sf_dir):
    return extracted(table(spark, sf_dir, "pages"))
