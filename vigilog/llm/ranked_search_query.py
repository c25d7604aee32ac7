"""op13: the fifty best documents for each benchmark item."""

from __future__ import annotations

from vigilog.llm.ranked_search import ranked_documents
from vigilog.llm.registry import query, table

TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {TERMS.format("coalesce(text, '')")} AS terms FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, {TERMS.format("coalesce(text, '')")} AS terms FROM benchmark),
held AS (SELECT row, doc_id, len(terms)::HUGEINT AS n, unnest(terms) AS term FROM d),
tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM held GROUP BY ALL),
asked AS (SELECT DISTINCT item, item_id, unnest(terms) AS term FROM i),
total AS (SELECT count(*) FILTER (len(terms) > 0) AS docs, sum(len(terms)) AS length FROM d),
weight AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term),
score AS (
  SELECT item, item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // length))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term), total GROUP BY item, item_id, row, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INT AS rank FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


@query("op13_ranked_search", SQL)
def op13_ranked_search(spark, sf_dir):
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)
