"""Secret scan with DataFrame functions only.

Base rules are patterns: assignments of secrets, access keys, long hexadecimal runs. On top,
tokens are scored by two first-order character Markov models, one of random strings and one
of ordinary identifiers, and are findings where the log-likelihood ratio reaches ``RATIO``.
A token is a run of ``TOKEN_CHARS`` or more token characters, where characters in base
findings count as such. Only what base findings leave of it is scored, each rest from its own
beginning: a key that holds a hexadecimal run is found as a whole, a path before a hash is not.
Where less than ``TOKEN_CHARS`` is left, its share of ``RATIO`` decides, and below ``LEFT_CHARS``
nothing does.

The models are counts of character transitions from labelled samples. Random: the values
of base matches and, for every document, a string that SHA-256 makes of its id. Ordinary:
tokens of ``SAMPLE_CHARS`` or more characters of all texts outside base matches. Transitions
are counted where the tokens are and combined before the shuffle; the 95 x 95 ratios are
bounded and become a constant of the plan.

Positions come from the lengths of what lies between matches. Running sums over an array
work in blocks of 256, so a text of very many matches costs little more than its length.

Defined results: a null text is empty and has no findings; repeated rows have equal
findings; a table without rows gives none. Where no sample exists, a model is uniform.
Other columns are ignored by ``findings`` and kept by ``redacted``.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, functions as F

from vigilog.llm.batches import column, fresh
from vigilog.llm.quality_rules import let

KINDS = ("assign", "access", "hex", "random")
#: Pattern, group whose length counts, and least length. The length is tested on finished
#: matches of the first pattern; for the others no match of the open pattern can contain a
#: longer one, so the length is part of the pattern.
BASE = (
    (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    (r"AKIA[A-Z0-9]{14,}", 0, 18),
    (r"[0-9a-f]{16,}", 0, 16),
)
TOKEN_CHARS = 16
LEFT_CHARS = 8
SAMPLE_CHARS = 10
TOKEN = r"[A-Za-z0-9+/_=-]{%d,}"
#: Stands for each character of a base finding; where a text has it, ``OTHER`` takes its place.
COVERED = "\x01"
OTHER = "\x02"
LEFT = rf"[A-Za-z0-9+/_=\x01-]{{{TOKEN_CHARS},}}"
RATIO = 12.0
SMOOTHING = 0.5
BLOCK = 256
#: Characters 33 .. 126, and one state for the beginning of a token.
STATES = 95
BEGIN = 94


def _running(values: Column, start: Column, combine) -> Column:
    """Running ``combine`` (associative, with identity ``start``) of a let-bound array."""
    scan = lambda x: F.aggregate(
        x,
        F.struct(start.alias("t"), F.array().cast("array<int>").alias("a")),
        lambda s, v: let(combine(s["t"], v), lambda n: F.struct(n.alias("t"), F.concat(s["a"], F.array(n)).alias("a"))),
    )
    def blocks_of(x):
        last = F.floor((F.size(x) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: scan(F.slice(x, b * BLOCK + 1, BLOCK)))

    def joined(blocks):
        totals = scan(F.transform(blocks, lambda b: b["t"]))["a"]
        return let(totals, lambda t: F.flatten(F.transform(blocks, lambda b, i: let(F.when(i == 0, start).otherwise(F.get(t, i - 1)), lambda before: F.transform(b["a"], lambda v: combine(before, v))))))

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(let(blocks_of(values), joined))


def _spans(text: Column, pattern: str, kind: int, matches: Column, wanted: Column | None = None) -> Column:
    """Spans of ``matches`` (all matches of the pattern); ``wanted`` says which of them count."""
    span = "array<struct<start:int,kind:int,end:int>>"
    gaps = let(F.split(text, pattern, -1), lambda p: F.transform(matches, lambda m, i: F.length(F.get(p, i)) + F.coalesce(F.length(F.get(matches, i - 1)), F.lit(0))))
    starts = let(gaps, lambda g: _running(g, F.lit(0), lambda a, b: a + b))
    found = let(starts, lambda s: F.transform(matches, lambda m, i: F.struct(F.get(s, i).alias("start"), F.lit(kind).alias("kind"), (F.get(s, i) + F.length(m)).alias("end"))))
    if wanted is not None:
        found = let(found, lambda f: F.filter(f, lambda x, i: F.get(wanted, i)))
    return F.when(F.size(matches) == 0, F.array().cast(span)).otherwise(found.cast(span))


def _plain(token: Column) -> Column:
    """Tokens without a base match in them."""
    return ~(token.rlike(BASE[0][0]) | token.rlike(BASE[1][0]) | token.rlike(BASE[2][0]))


def _codes(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda x: F.when(x != COVERED, F.ascii(x) - 33))


def _transitions(token: Column) -> Column:
    """The place in the table of each step to a character; null for a covered one, and the step after it is a beginning."""
    return let(_codes(token), lambda c: F.transform(c, lambda x, i: F.coalesce(F.get(c, i - 1), F.lit(BEGIN)) * STATES + x))


def samples(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Labelled samples ``token``, ``random`` from all documents."""
    rows = docs.select(column(docs, id_column).cast("string").alias("id"), F.coalesce(column(docs, text_column).cast("string"), F.lit("")).alias("text"))
    assigned = F.filter(F.regexp_extract_all("text", F.lit(BASE[0][0]), F.lit(2)), lambda x: F.length(x) >= BASE[0][2])
    made = F.array(F.rtrim(F.base64(F.unhex(F.sha2(F.coalesce("id", F.lit("")).cast("binary"), 256)))))
    random = F.concat(assigned, F.regexp_extract_all("text", F.lit(BASE[1][0]), F.lit(0)), F.regexp_extract_all("text", F.lit(BASE[2][0]), F.lit(0)), F.transform(made, lambda x: F.regexp_replace(x, "[^A-Za-z0-9+/]", "")))
    ordinary = F.filter(F.regexp_extract_all("text", F.lit(TOKEN % SAMPLE_CHARS), F.lit(0)), _plain)
    both = F.concat(F.transform(random, lambda x: F.struct(x.alias("token"), F.lit(True).alias("random"))), F.transform(ordinary, lambda x: F.struct(x.alias("token"), F.lit(False).alias("random"))))
    return rows.select(F.explode(both).alias("s")).select("s.token", "s.random")


def ratios(labelled: DataFrame) -> list[float]:
    """log P(next | previous, random) - log P(next | previous, ordinary), by 95 x previous + next."""
    counts = {True: [0] * STATES**2, False: [0] * STATES**2}
    steps = labelled.select("random", F.explode(_transitions(F.col("token"))).alias("step")).filter((F.col("step") >= 0) & (F.col("step") < STATES**2))
    for row in steps.groupBy("random", "step").count().collect():  # at most 2 x 95 x 95 rows
        counts[row["random"]][row["step"]] = row["count"]

    def logs(own: list[int]) -> list[float]:
        out = []
        for previous in range(STATES):
            line = own[previous * STATES : (previous + 1) * STATES]
            whole = sum(line) + SMOOTHING * STATES
            out += [math.log((n + SMOOTHING) / whole) for n in line]
        return out

    return [a - b for a, b in zip(logs(counts[True]), logs(counts[False]), strict=True)]


def _score(token: Column, table: list[float]) -> Column:
    weights = F.from_json(F.lit(json.dumps(table)), "array<double>")
    return F.aggregate(_transitions(token), F.lit(0.0), lambda s, t: s + F.coalesce(F.get(weights, t), F.lit(0.0)))


def _random(token: Column, table: list[float]) -> Column:
    """Whether a token is random, by the characters that no base finding covers."""
    left = F.length(F.regexp_replace(token, f"{COVERED}+", ""))
    return let(left, lambda n: F.when(n >= LEFT_CHARS, _score(token, table) >= RATIO * F.least(n, F.lit(TOKEN_CHARS)) / TOKEN_CHARS).otherwise(False))


def _with_runs(rows: DataFrame, spans: str, names: dict[str, str]) -> DataFrame:
    """``rows`` with the running ``ends`` of the sorted spans, and ``heads``: the start of each run of
    overlapping spans with the end of the run before it. Both are null where there is no span."""
    ends = let(F.transform(spans, lambda x: x["end"]), lambda e: _running(e, F.lit(0), F.greatest))
    rows = rows.withColumn(names["ends"], F.when(F.size(spans) > 0, ends))
    heads = F.filter(F.transform(spans, lambda x, i: F.struct(x["start"].alias("start"), F.coalesce(F.get(names["ends"], i - 1), F.lit(0)).alias("before"), (i == 0).alias("first"))), lambda x: x["first"] | (x["start"] >= x["before"]))
    return rows.withColumn(names["heads"], F.when(F.size(spans) > 0, heads))


def _replaced(text: Column, names: dict[str, str], filling) -> Column:
    """The text with every run of spans replaced by ``filling(length)``."""
    heads = F.col(names["heads"])
    last = F.array_max(names["ends"])
    parts = F.transform(heads, lambda x, i: F.concat(F.substring(text, x["before"] + 1, x["start"] - x["before"]), filling(F.coalesce(F.get(heads, i + 1)["before"], last) - x["start"])))
    return F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text)))


def _with_spans(rows: DataFrame, text: str, table: list[float], names: dict[str, str]) -> DataFrame:
    """``rows`` with the sorted ``base`` and ``all`` spans of the text."""
    all_of = lambda pattern, group=0: F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))
    m = [names[f"m{i}"] for i in range(4)]
    rows = rows.withColumns({m[0]: all_of(BASE[0][0]), m[1]: all_of(BASE[1][0]), m[2]: all_of(BASE[2][0])})
    long = F.when(F.size(m[0]) > 0, F.transform(all_of(BASE[0][0], 2), lambda x: F.length(x) >= BASE[0][2]))
    rows = rows.withColumn(names["ok0"], long)
    spans = [_spans(F.col(text), BASE[0][0], 0, F.col(m[0]), F.col(names["ok0"])), _spans(F.col(text), BASE[1][0], 1, F.col(m[1])), _spans(F.col(text), BASE[2][0], 2, F.col(m[2]))]
    rows = _with_runs(rows.withColumn(names["base"], F.sort_array(F.concat(*spans))), names["base"], names)
    own = F.when(F.contains(F.col(text), F.lit(COVERED)), F.translate(F.col(text), COVERED, OTHER)).otherwise(F.col(text))
    rows = rows.withColumn(names["own"], own)
    covered = F.when(F.size(names["base"]) > 0, _replaced(F.col(names["own"]), names, lambda n: F.repeat(F.lit(COVERED), n))).otherwise(F.col(names["own"]))
    rows = rows.withColumn(names["covered"], covered)
    rows = rows.withColumn(m[3], F.regexp_extract_all(F.col(names["covered"]), F.lit(LEFT), F.lit(0)))
    rows = rows.withColumn(names["ok3"], F.when(F.size(m[3]) > 0, F.transform(m[3], lambda x: _random(x, table))))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    added = F.when(F.coalesce(F.exists(names["ok3"], lambda x: x), F.lit(False)), _spans(F.col(names["covered"]), LEFT, 3, F.col(m[3]), F.col(names["ok3"]))).otherwise(none)
    rows = rows.withColumn(names["added"], added)
    return rows.withColumn(names["all"], F.sort_array(F.concat(names["base"], names["added"]))).drop(*m, *[names[n] for n in ("ok0", "ok3", "added", "own", "covered", "ends", "heads")])


def _names(df: DataFrame) -> dict[str, str]:
    return {n: fresh(df, f"secret_{n}") for n in ("m0", "m1", "m2", "m3", "ok0", "ok3", "base", "added", "all", "ends", "heads", "own", "covered")}


def findings(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: list[float] | None = None) -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` (arrays of start, kind, end in code points, sorted) per document.

    ``kind`` is the place in ``KINDS``. Without ``model``, ratios are trained from all documents.
    """
    table = ratios(samples(docs, id_column, text_column)) if model is None else model
    rows = docs.select(column(docs, id_column).alias("doc_id"), F.coalesce(column(docs, text_column).cast("string"), F.lit("")).alias("text"))
    names = _names(rows)
    return _with_spans(rows, "text", table, names).select("doc_id", F.col(names["base"]).alias("base"), F.col(names["all"]).alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")


def redacted(docs: DataFrame, mark: str = "[secret]", id_column: str = "doc_id", text_column: str = "text", model: list[float] | None = None) -> DataFrame:
    """``docs`` with every finding replaced by ``mark``; other columns and texts stay as they are."""
    table = ratios(samples(docs, id_column, text_column)) if model is None else model
    names = _names(docs)
    text = fresh(docs, "secret_text")
    rows = docs.withColumn(text, column(docs, text_column).cast("string"))
    rows = _with_spans(rows.withColumn(text, F.coalesce(text, F.lit(""))), text, table, names)
    rows = _with_runs(rows, names["all"], names)
    whole = _replaced(F.col(text), names, lambda n: F.lit(mark))
    cleaned = F.when(F.size(names["all"]) > 0, whole).otherwise(column(docs, text_column).cast("string"))
    return rows.select(*[cleaned.alias(c) if c == text_column else column(rows, c) for c in docs.columns])
