"""op12: the prefix trie of conversations, after each took over the start of another one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigilog.llm.prefix_trie import prefix_trie, sequences
from vigilog.llm.registry import query, table

GROUP = 20
STARTS = 4

SQL = """
WITH RECURSIVE own AS (
  SELECT conv_id AS c, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, turn,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest, words) AS i FROM own),
convs AS (SELECT DISTINCT c, c - c % 20 AS base,
    4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)),
      lambda state, code: list_reduce(list_prepend(xor(state, code), range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)) AS crc FROM own),
rebuilt AS (
  SELECT v.c, n.digest, n.words, n.i AS i FROM convs v JOIN numbered n ON n.c = v.base AND n.i <= v.crc % 4
  UNION ALL SELECT v.c, n.digest, n.words, n.i + 4 FROM convs v JOIN numbered n ON n.c = v.c AND n.i > v.crc % 4),
turns AS (SELECT c, digest, words, row_number() OVER (PARTITION BY c ORDER BY i) AS d FROM rebuilt),
paths AS (
  SELECT c, 0::BIGINT AS d, '' AS path, 0 AS words FROM convs
  UNION ALL SELECT p.c, t.d, md5(p.path || t.digest), t.words FROM paths p JOIN turns t ON t.c = p.c AND t.d = p.d + 1),
lengths AS (SELECT c, max(d) AS n FROM paths GROUP BY c),
nodes AS (SELECT d, path, min(p.c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    coalesce(string_agg(CASE WHEN l.n = p.d THEN p.c::VARCHAR END, ',' ORDER BY p.c), '') AS ends FROM paths p JOIN lengths l ON l.c = p.c GROUP BY d, path),
parents AS (SELECT DISTINCT n.d, n.path, p.path AS parent, m.conv_id AS parent_conv_id FROM nodes n JOIN paths p ON p.c = n.conv_id AND p.d = n.d - 1 JOIN nodes m ON m.d = p.d AND m.path = p.path),
children AS (SELECT d - 1 AS d, parent AS path, count(*) AS n_children FROM parents GROUP BY 1, 2),
below AS (SELECT p.d, p.path, sum((u.n_convs - 1) * u.words) AS saved_tokens, count(*) FILTER (k.n_children IS NULL) AS n_leaves
  FROM nodes u LEFT JOIN children k ON k.d = u.d AND k.path = u.path JOIN paths p ON p.c = u.conv_id AND p.d <= u.d GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, q.parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n LEFT JOIN parents q ON q.d = n.d AND q.path = n.path LEFT JOIN children k ON k.d = n.d AND k.path = n.path JOIN below b ON b.d = n.d AND b.path = n.path
"""


def with_shared_starts(conversations: DataFrame) -> DataFrame:
    """Conversation c begins with the first h turns of conversation c - c % 20, then come its own after the first h; h is CRC-32 of c, modulo 4."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(STARTS)).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    starts = conversations.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, STARTS - 1).alias("start"))
    rows = conversations.withColumns({"base": base, "h": h}).join(starts, "base", "left")
    own = F.slice(F.col("turns"), F.col("h") + 1, F.size("turns"))
    start = F.slice(F.coalesce("start", F.array().cast(starts.schema["start"].dataType)), F.lit(1), F.col("h"))
    return rows.select("conv_id", F.concat(start, own).alias("turns"))


@query("op12_conversation_trie", SQL)
def op12_conversation_trie(spark, sf_dir):
    return prefix_trie(with_shared_starts(sequences(table(spark, sf_dir, "conversations"))))
