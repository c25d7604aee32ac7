"""op3: license notices in all documents."""

from __future__ import annotations

from vigilog.llm.licenses import CONTAINED, STRETCH, TEMPLATES, licenses
from vigilog.llm.registry import query, table

_VALUES = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in t)) for t in TEMPLATES)

SQL = f"""
WITH t(license, text) AS (VALUES {_VALUES}),
tw AS (SELECT license, regexp_extract_all(text, '[A-Za-z0-9]+') AS ws FROM t),
tr AS (SELECT license, ceil((len(ws) - 2) * {STRETCH})::BIGINT AS reach FROM tw),
ts AS MATERIALIZED (SELECT DISTINCT license, lower(array_to_string(ws[i:i + 2], ' ')) AS shingle FROM (SELECT license, ws, unnest(range(1, len(ws) - 1)) AS i FROM tw)),
tn AS (SELECT license, count(*) AS n_shingles FROM ts GROUP BY license),
dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+') AS ws FROM documents),
ds AS MATERIALIZED (SELECT doc_id, i - 1 AS pos, lower(array_to_string(ws[i:i + 2], ' ')) AS shingle FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM dw WHERE len(ws) > 2)),
h AS MATERIALIZED (SELECT doc_id, license, pos, shingle, reach FROM ds JOIN ts USING (shingle) JOIN tr USING (license)),
m AS (
  SELECT a.doc_id, a.license, a.pos AS first_word, max(b.pos) + 2 AS last_word, count(DISTINCT b.shingle) AS n_matched
  FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.license = b.license AND b.pos >= a.pos AND b.pos < a.pos + a.reach GROUP BY 1, 2, 3
),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY n_matched DESC, first_word) AS place FROM m)
SELECT doc_id, license, n_matched, n_shingles, n_matched / n_shingles AS containment, first_word, last_word
FROM k JOIN tn USING (license) WHERE place = 1 AND n_matched >= {CONTAINED} * n_shingles
"""


@query("op3_licenses", SQL)
def op3_licenses(spark, sf_dir):
    return licenses(table(spark, sf_dir, "documents"))
