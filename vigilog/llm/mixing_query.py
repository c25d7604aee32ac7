"""op5: the mix of all documents."""

from __future__ import annotations

from vigilog.llm.mixing import shares, sized
from vigilog.llm.registry import query, table

SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
t AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
        sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap AS before,
        sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM r),
u AS (SELECT *, cap * open_weight <= (budget - before) * weight AS full_up FROM t),
v AS (SELECT *, budget - coalesce(sum(CASE WHEN full_up THEN cap END) OVER (), 0.0) AS rest, sum(CASE WHEN NOT full_up THEN weight END) OVER () AS open FROM u),
g AS (SELECT source, source_size, (CASE WHEN full_up THEN cap ELSE weight * rest / open END)::DOUBLE AS target FROM v),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM g),
c AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS missing,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place RANGE UNBOUNDED PRECEDING) AS until,
         sum(d.size) OVER (PARTITION BY d.source, d.place) AS own
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (size * (passes + CASE WHEN missing > 0 AND until - own < missing AND (until < missing OR until - missing < missing - (until - own)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""


@query("op5_mixing", SQL)
def op5_mixing(spark, sf_dir):
    return shares(sized(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")
