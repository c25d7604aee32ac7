"""Quality rules with DataFrame functions only: base counts and robust multivariate outliers.

Base rules reject texts of few words or of mostly repeated word windows. For the others a
vector of six transformed statistics is compared with its language and source: location
and scatter are a regularised minimum-covariance-determinant estimate, and a document whose
squared Mahalanobis distance exceeds ``CUTOFF`` is rejected.

The estimate is deterministic. One start takes coordinatewise medians and quartiles, the
other the plain mean and covariance; from each, concentration steps keep the ``SUBSET``
share of rows with the smallest distances and estimate again, and the smaller determinant
wins. Medians and distance ranks come from histograms on fixed grids, so every pass is
one aggregate over the stored vectors that is combined before the shuffle; a group that
holds a third of all rows is a handful of sums per task. ``FLOOR`` is added to the
variances: most texts have no symbols and no repeated lines, and without it any first
symbol would be infinitely far away.

Groups of fewer than ``LEAST_ROWS`` vectors are judged by the estimate of their whole
language, or of the whole table where the language is as small; a smaller table is not judged.

Defined results: a null text has no words and fails the base rules, as an empty one does.
A null language or source is a group of its own. Repeated rows are judged alike. A table
without rows gives none. Other columns are ignored by ``judged`` and kept by ``kept_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vigilog.llm.batches import SPACE, column
from vigilog.session import stored

FEATURES = ("word_length", "symbols", "capitals", "letters", "repeats", "lines")
#: Added to the variances: the squares of these deviations.
FLOOR = (0.08, 0.06, 0.03, 0.03, 0.12, 0.12)
SUBSET = 0.75
#: Scatter of the inner 75 % to scatter of all rows for six normal statistics.
CONSISTENCY = 1.36
#: Squared distance with a chance of 1e-9 for six normal statistics, rounded up.
CUTOFF = 54.0
LEAST_ROWS = 60
STEPS = 4
GRID = 200.0
BROADCAST_GROUPS = 20_000
WORDS = SPACE.replace("[", "[^")
P = len(FEATURES)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that the array holds twice or more."""
    windows = let(
        words,
        lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.struct(F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("p"))),
    )
    ranked = F.sort_array(windows)
    twice = let(ranked, lambda s: F.filter(s, lambda x, i: F.get(s, i - 1)["t"].eqNullSafe(x["t"]) | F.get(s, i + 1)["t"].eqNullSafe(x["t"])))
    places = F.sort_array(F.transform(twice, lambda x: x["p"]))
    covered = let(places, lambda p: F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))))
    return F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)


def statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", source_column: str = "source", whole: bool = False) -> DataFrame:
    """The counts of every whole text, with ``doc_id`` and ``team`` (language and source), and
    with ``whole`` the row itself as ``row``."""
    text = F.coalesce(column(docs, text_column).cast("string"), F.lit(""))
    rows = docs.select(
        *([F.struct(*[column(docs, c) for c in docs.columns]).alias("row")] if whole else []),
        column(docs, id_column).alias("doc_id"),
        F.to_json(F.struct(column(docs, lang_column).alias("l"), column(docs, source_column).alias("s"))).alias("team"),
        F.to_json(F.struct(column(docs, lang_column).alias("l"))).alias("language"),
        text.alias("text"),
        F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)).alias("words"),
    )
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORDS))
    return rows.select(
        *(["row"] if whole else []),
        "doc_id",
        "team",
        "language",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        let(lines, lambda x: F.size(x).cast("long")).alias("n_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        F.length(F.regexp_replace("text", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
    )


def _vector() -> list[Column]:
    words, chars = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "word_chars"))
    return [
        F.log(chars / words).alias("word_length"),
        F.sqrt(F.col("n_symbols") / words).alias("symbols"),
        F.sqrt(F.col("n_capitals") / chars).alias("capitals"),
        (F.col("n_letters") / chars).alias("letters"),
        F.sqrt(F.col("n_repeat_words") / words).alias("repeats"),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("lines"),
    ]


def _with(rows: DataFrame, table: DataFrame, count: int, key: str = "team") -> DataFrame:
    return rows.join(F.broadcast(table) if count <= BROADCAST_GROUPS else table, key)


def _moments(rows: DataFrame) -> DataFrame:
    """Per team the mean ``m0..``, and the Cholesky factor ``c_i_j`` of the regularised scatter."""
    sums = [F.count("*").cast("double").alias("n")]
    sums += [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    sums += [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s{i}_{j}") for i in range(P) for j in range(i + 1)]
    state = rows.groupBy("team").agg(*sums)
    scatter = [((F.col(f"s{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")) / F.col("n") * CONSISTENCY + (FLOOR[i] ** 2 if i == j else 0.0)).alias(f"v{i}_{j}") for i in range(P) for j in range(i + 1)]
    state = state.select("team", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(P)], *scatter)
    return _factor(state)


def _factor(state: DataFrame) -> DataFrame:
    for j in range(P):
        for i in range(j, P):
            rest = F.col(f"v{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"c{i}_{k}") * F.col(f"c{j}_{k}")
            state = state.withColumn(f"c{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"c{j}_{j}"))
    volume = F.lit(0.0)
    for i in range(P):
        volume = volume + 2 * F.log(f"c{i}_{i}")
    return state.select("team", *[f"m{i}" for i in range(P)], *[f"c{i}_{j}" for i in range(P) for j in range(i + 1)], volume.alias("volume"))


def _distances(rows: DataFrame, estimate: DataFrame, count: int) -> DataFrame:
    """``rows`` with the squared distance ``d2`` from their team's estimate."""
    names = rows.columns
    met = _with(rows, estimate.drop("volume"), count)
    for i in range(P):
        rest = F.col(FEATURES[i]) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"c{i}_{k}") * F.col(f"_y{k}")
        met = met.withColumn(f"_y{i}", rest / F.col(f"c{i}_{i}"))
    d2 = F.lit(0.0)
    for i in range(P):
        d2 = d2 + F.col(f"_y{i}") * F.col(f"_y{i}")
    return met.select(*names, d2.alias("d2"))


def _concentrated(rows: DataFrame, estimate: DataFrame, count: int) -> DataFrame:
    """The estimate from the ``SUBSET`` share of each team's rows that are nearest to ``estimate``."""
    near = _distances(rows, estimate, count).withColumn("_bar", F.floor(F.log1p("d2") * 100).cast("int"))
    bars = near.groupBy("team", "_bar").agg(F.count("*").alias("n"))
    order = W.partitionBy("team").orderBy("_bar")
    running = bars.select("team", "_bar", F.sum("n").over(order).alias("until"), F.sum("n").over(W.partitionBy("team")).alias("all"))
    edges = running.filter(F.col("until") >= F.col("all") * SUBSET).groupBy("team").agg(F.min("_bar").alias("_edge"))
    return stored(_moments(_with(near, edges, count).filter(F.col("_bar") <= F.col("_edge"))))


def _quartile_start(rows: DataFrame) -> DataFrame:
    """Medians, and a diagonal scatter from quartiles, read from a grid of 1/200."""
    tall = rows.select("team", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(f) * GRID).cast("int").alias("bar")) for i, f in enumerate(FEATURES)])).alias("x"))
    bars = tall.groupBy("team", "x.i", "x.bar").agg(F.count("*").alias("n"))
    whole = W.partitionBy("team", "i")
    running = bars.select("team", "i", "bar", F.sum("n").over(whole.orderBy("bar")).alias("until"), F.sum("n").over(whole).alias("all"))
    at = lambda q: F.min(F.when(F.col("until") >= F.col("all") * q, (F.col("bar") + 0.5) / GRID))
    marks = running.groupBy("team", "i").agg(at(0.25).alias("low"), at(0.5).alias("mid"), at(0.75).alias("high"))
    of = lambda i, x: F.max(F.when(F.col("i") == i, x))
    spread = (F.col("high") - F.col("low")) / 1.349
    columns = [of(i, F.col("mid")).alias(f"m{i}") for i in range(P)]
    columns += [of(i, spread * spread + FLOOR[i] ** 2).alias(f"v{i}_{i}") for i in range(P)]
    state = marks.groupBy("team").agg(*columns)
    return _factor(state.withColumns({f"v{i}_{j}": F.lit(0.0) for i in range(P) for j in range(i)}))


def scatter_estimates(rows: DataFrame, count: int) -> DataFrame:
    """The minimum-covariance-determinant estimate of each team, one row per team, stored."""
    found = []
    for start in (_quartile_start(rows), _moments(rows)):
        estimate = stored(start)
        for _ in range(STEPS):
            estimate = _concentrated(rows, estimate, count)
        found.append(estimate)
    both = found[0].unionAll(found[1])
    names = [c for c in both.columns if c != "team"]
    least = both.groupBy("team").agg(F.min(F.struct("volume", *[n for n in names if n != "volume"])).alias("e"))
    return stored(least.select("team", *[F.col(f"e.{n}").alias(n) for n in names]))


def _teams(rows: DataFrame) -> tuple[DataFrame, int, DataFrame]:
    """For each team the one whose estimate judges it (``team``, ``judge``), the number of
    teams, and the rows of each judging team."""
    sizes = rows.groupBy("team", "language").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("language_n", F.sum("n").over(W.partitionBy("language"))).withColumn("all_n", F.sum("n").over(W.partitionBy()))
    of_language = F.concat(F.lit("l"), F.col("language"))
    judge = F.when(F.col("n") >= LEAST_ROWS, F.concat(F.lit("s"), F.col("team"))).when(F.col("language_n") >= LEAST_ROWS, of_language).when(F.col("all_n") >= LEAST_ROWS, F.lit("all"))
    sizes = stored(sizes.select("team", "language", judge.alias("judge")))
    count = sizes.count()
    own = _with(rows, sizes.select("team", "judge"), count).drop("team").withColumnRenamed("judge", "team")
    asked = sizes.filter("judge LIKE 'l%'").select("language").distinct()
    members = own.filter("team LIKE 's%'")
    members = members.unionByName(_with(rows.drop("team"), asked, count, "language").withColumn("team", of_language))
    if not sizes.filter("judge = 'all'").isEmpty():
        members = members.unionByName(rows.withColumn("team", F.lit("all")))
    return sizes.select("team", "judge"), count, members


def _failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _estimated(passed: DataFrame) -> tuple[DataFrame, int, DataFrame, int]:
    """The judging teams of all teams and the estimates of those, each with its number of rows."""
    judges, teams, members = _teams(passed)
    members = stored(members.select("team", *FEATURES))
    count = members.select("team").distinct().count()
    return judges, teams, scatter_estimates(members, count) if count else None, count


def _with_distance(passed: DataFrame, judges: DataFrame, teams: int, estimates: DataFrame | None, count: int) -> DataFrame:
    """``passed`` with ``distance`` (squared); null in a table too small for any estimate."""
    if estimates is None:
        return passed.withColumn("distance", F.lit(None).cast("double"))
    own = _with(passed, judges, teams).drop("team").withColumnRenamed("judge", "team")
    return _distances(own, estimates, count).withColumnRenamed("d2", "distance")


def judged(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """One row per document: the counts, ``base_failed``, ``distance`` (squared) and ``kept``."""
    rows = stored(statistics(docs, id_column, text_column, lang_column, source_column).withColumn("base_failed", _failed()))
    passed = stored(rows.filter("NOT base_failed").select(*rows.columns, *_vector()))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance"]
    measured = _with_distance(passed, *_estimated(passed)).select(*names)
    failed = rows.filter("base_failed").withColumn("distance", F.lit(None).cast("double")).select(*names)
    kept = F.coalesce(F.col("distance") <= CUTOFF, ~F.col("base_failed"))
    return measured.unionAll(failed).withColumn("kept", kept)


def kept_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with all their columns.

    The estimates come from a first pass over the texts; a second one counts again and keeps
    or drops each row as it passes, so that no text is shuffled.
    """
    counts = stored(statistics(docs, id_column, text_column, lang_column, source_column).drop("doc_id"))
    found = _estimated(stored(counts.filter(~_failed()).select("team", "language", *_vector())))
    rows = statistics(docs, id_column, text_column, lang_column, source_column, whole=True)
    # A filter right above the counts would move below them and count a second time; none
    # moves below a generator, here one of a single struct.
    once = rows.select("row", F.inline(F.array(F.struct("team", "n_words", "n_repeat_words", _failed().alias("base_failed"), F.struct(*_vector()).alias("vector")))))
    measured = _with_distance(once.select("row", "team", "base_failed", "vector.*"), *found)
    return measured.filter(~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))).select("row.*")
