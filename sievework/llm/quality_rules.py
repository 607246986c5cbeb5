"""Quality rules: base rules and robust multivariate outliers, as DataFrame expressions only.

Statistics of each text are transformed to a vector; per language and source a
minimum-covariance-determinant estimate of centre and covariance is sought. There
are several deterministic starts about the group's medians: the quartiles' spreads
alone, and with these the covariances of hyperbolic tangents and of spatial signs
of the standardised vectors. From each, concentration steps follow: the half of
the rows with the least Mahalanobis distances gives the next mean and covariance,
until no determinant changes any more. Of a group's starts the one with the least
determinant is kept. Scaled to be consistent for normal data, it gives each row's
distance; rows beyond a chi-square quantile are outliers and are rejected.

A group's steps are aggregations (sums, and quantile sketches of bounded size)
and joins with one row per group; all starts are columns of the same rows. A group
with a third of all rows is pre-aggregated like any other. Covariances get a
floor, so that a group whose rows are all alike rejects only what is far from them
by common measure. Quantiles are sketches with a relative rank error of 1e-4.

Defined results: a null or empty text has no words and fails the base rules; a
null language or source is a group of its own; a group of fewer than
``MIN_GROUP`` usable rows is judged by the estimate of all rows of its language,
and where these are fewer too, by that of all rows. Only if the whole table has
fewer usable rows is nothing an outlier. Repeated rows get equal verdicts; of
starts with equal determinants the first counts; empty tables give empty results;
further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sievework.llm.common import cut_lineage, pick, stored

WORD = r"[^\x20\x09-\x0D]"
MIN_WORDS = 10
WINDOW = 5
MAX_REPEATED_PERCENT = 20
#: Concentration steps at most, if the determinants don't settle before: their logarithms change by less than ``SETTLED``.
STEPS = 25
SETTLED = 1e-3
#: Starts: spreads alone, hyperbolic tangents, spatial signs.
STARTS = 3
#: Share of a group's rows that an estimate rests on.
CORE = 0.5
#: Square root of the 0.999999 quantile of chi-square with 4 degrees of freedom.
MAX_DISTANCE = 5.8
#: Makes the covariance of the core of half the rows consistent for normal data in 4 dimensions.
CONSISTENCY = 2.11
MIN_GROUP = 30
#: What an estimate is made for: level 0, a language and source; 1, a language; 2, all rows. Names above the level are null.
POOL = ("__level", "__lang", "__source")
#: Least standard deviation of each transformed statistic, and the statistic.
FLOORS = {"word_length": 0.05, "symbols": 0.03, "line_length": 0.4, "repeats": 0.1}


def _sorted_hashes(words: Column) -> Column:
    """Each window's hash, with its position in the low bits, sorted. ``__bits`` low bits hold any position."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.call_function("shiftleft", F.xxhash64(F.slice(words, i + 1, WINDOW)), F.col("__bits")).bitwiseOR(i.cast("long")),
    )
    return F.sort_array(windows)


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines of each row.

    Repeated windows are found by sorting 64-bit numbers: the hash of a window
    above, its position in the low bits, so one sort yields the positions of
    all windows that occur again. A text of 2**b words leaves 64 - b bits of hash.
    """
    rows = pick(docs, doc_id="doc_id", lang="lang", source="source", text="text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = rows.select("doc_id", "lang", "source", text.alias("text"))
    has_word = lambda line: line.rlike(WORD)
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        F.regexp_extract_all("text", F.lit(f"{WORD}+"), F.lit(0)).alias("__words"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), has_word).alias("__lines"),
    )
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        "n_symbols",
        "__words",
        F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.ceil(F.log2(F.greatest(F.size("__words"), F.lit(2)))).cast("int").alias("__bits"),
    )
    rows = rows.withColumn("__sorted", F.when(F.size("__words") >= WINDOW, _sorted_hashes(F.col("__words")))).drop("__words")
    # a window is found again if a neighbour in the sorted list has the same hash
    above = lambda x: F.call_function("shiftright", x, F.col("__bits"))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__bits")) - 1
    previous = lambda i: F.get("__sorted", i - 1)
    again = F.filter(
        F.transform(
            "__sorted",
            lambda x, i: F.when((above(x) == above(previous(i))) | (above(x) == above(F.get("__sorted", i + 1))), x.bitwiseAND(low)),
        ),
        lambda p: p.isNotNull(),
    )
    rows = rows.withColumn("__again", F.sort_array(again)).drop("__sorted")
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    covered = F.aggregate(
        "__again",
        start,
        lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(a["to"], p)).alias("n"), (p + WINDOW).alias("to")),
        lambda a: a["n"],
    )
    return rows.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"), "n_lines",
    )


def transformed() -> dict[str, Column]:
    """The vector's components from the base statistics."""
    words = F.col("n_words").cast("double")
    return {
        # few words vary more: as if 20 words of 5 characters stood before each text
        "word_length": F.log((F.col("word_chars") + 100) / (words + 20)),
        "symbols": F.log1p(F.col("n_symbols") / words),
        "line_length": F.log(words / F.greatest("n_lines", F.lit(1))),
        "repeats": F.sqrt((F.col("n_repeat_words") / words)),
    }


# Formulas over several columns are SQL texts: one expression each, instead of a tree of hundreds of calls.


def _factored(groups: DataFrame, names: list[str]) -> DataFrame:
    """``groups`` with the Cholesky factors ``l_k_y_x`` of the covariances ``c_k_y_x`` of each start k instead of these, and their log determinants ``det_k``."""
    for j, b in enumerate(names):  # column by column, all starts at once

        def rest(k: int, a: str) -> str:
            return " - ".join([f"c_{k}_{b}_{a}", *[f"l_{k}_{n}_{a} * l_{k}_{n}_{b}" for n in names[:j]]])  # noqa: B023

        groups = groups.withColumns({f"l_{k}_{b}_{b}": F.expr(f"sqrt(greatest({rest(k, b)}, {FLOORS[b] ** 2 * 1e-3!r}D))") for k in range(STARTS)})
        below = {f"l_{k}_{b}_{a}": F.expr(f"({rest(k, a)}) / l_{k}_{b}_{b}") for k in range(STARTS) for a in names[j + 1 :]}
        groups = groups.withColumns(below) if below else groups
    groups = groups.withColumns({f"det_{k}": F.expr(" + ".join(f"2 * ln(l_{k}_{a}_{a})" for a in names)) for k in range(STARTS)})
    return groups.drop(*[f"c_{k}_{b}_{a}" for k in range(STARTS) for i, a in enumerate(names) for b in names[: i + 1]])


def _distance(names: list[str], start: str = "") -> Column:
    """Mahalanobis distance from ``m_x`` by forward substitution in the Cholesky factor; of a start: ``start`` is its number and ``_``."""
    solved: list[str] = []
    for i, a in enumerate(names):
        rest = " - ".join([f"{a} - m_{start}{a}", *[f"l_{start}{names[k]}_{a} * {solved[k]}" for k in range(i)]])
        solved.append(f"(({rest}) / l_{start}{a}_{a})")
    return F.expr("sqrt(" + " + ".join(f"{y} * {y}" for y in solved) + ")")


def _estimates(rows: DataFrame, names: list[str]) -> DataFrame:
    """Mean and floored covariance of each group's rows within the bound, for each start."""
    found = []
    for k in range(STARTS):
        core = {a: f"CASE WHEN __d_{k} <= __bound_{k} THEN {a} END" for a in names}
        found += [F.expr(f"avg({core[a]}) AS m_{k}_{a}") for a in names]
        found += [
            F.expr(f"covar_pop({core[a]}, {core[b]}) * {CONSISTENCY!r}D + {FLOORS[a] ** 2 if a == b else 0.0!r}D AS c_{k}_{b}_{a}")
            for i, a in enumerate(names)
            for b in names[: i + 1]
        ]
    return rows.groupBy(*POOL).agg(*found)


def _with_pool(rows: DataFrame, pools: DataFrame, how: str = "inner") -> DataFrame:
    own = pools.select(*[F.col(c).alias(f"{c}_own") if c in POOL else F.col(c) for c in pools.columns])
    same = reduce(lambda s, c: s & F.col(c).eqNullSafe(F.col(f"{c}_own")), POOL, F.lit(True))
    return rows.join(own, same, how).drop(*[f"{c}_own" for c in POOL])


def _pool(level: Column) -> Column:
    return F.struct(
        level.alias("level"), F.when(level < 2, F.col("lang")).alias("lang"), F.when(level < 1, F.col("source")).alias("source")
    )


def levels_of(vectors: DataFrame) -> DataFrame:
    """(lang, source, __level, __feeds): the level by which each group is judged, and all levels of estimates that its rows feed."""
    groups = cut_lineage(vectors.groupBy("lang", "source").agg(F.count("*").alias("rows")))
    languages = groups.groupBy("lang").agg(F.sum("rows").alias("lang_rows"), (F.min("rows") < MIN_GROUP).alias("small"))
    languages = languages.withColumn("small_lang", F.col("small") & (F.col("lang_rows") < MIN_GROUP))
    any_small = languages.agg(F.coalesce(F.max("small_lang"), F.lit(False)).alias("any_small"))
    own = languages.withColumnRenamed("lang", "__own")
    level = F.when(F.col("rows") >= MIN_GROUP, 0).when(F.col("lang_rows") >= MIN_GROUP, 1).otherwise(2)
    feeds = F.array(
        F.when(F.col("rows") >= MIN_GROUP, 0), F.when(F.col("small") & (F.col("lang_rows") >= MIN_GROUP), 1), F.when(F.col("any_small"), 2)
    )
    known = groups.join(own, F.col("lang").eqNullSafe(F.col("__own"))).crossJoin(F.broadcast(any_small))
    return cut_lineage(known.select("lang", "source", level.alias("__level"), F.array_compact(feeds).alias("__feeds")))


def _leveled(rows: DataFrame, levels: DataFrame) -> DataFrame:
    own = levels.withColumnRenamed("lang", "__l").withColumnRenamed("source", "__s")
    same = F.col("lang").eqNullSafe(F.col("__l")) & F.col("source").eqNullSafe(F.col("__s"))
    return rows.join(own, same, "left").drop("__l", "__s")


def _pooled(rows: DataFrame, level: Column) -> DataFrame:
    """``rows`` with the columns of ``POOL`` for ``level``."""
    others = [c for c in rows.columns if c not in (*POOL, "__feeds")]
    named = rows.withColumn("__level", level).withColumn("__pool", _pool(F.col("__level")))
    return named.select(*others, *[F.col(f"__pool.{c[2:]}").alias(c) for c in POOL])


def _starts(vectors: DataFrame, names: list[str]) -> DataFrame:
    """Each pool's medians ``m_k_x`` and first covariances ``c_k_y_x`` for each start k."""
    middle = vectors.groupBy(*POOL).agg(
        *[F.percentile_approx(a, [0.25, 0.5, 0.75], 10_000).alias(f"q_{a}") for a in names],
        F.count("*").alias("rows"),
    )
    spread = {a: (F.col(f"q_{a}")[2] - F.col(f"q_{a}")[0]) / 1.349 for a in names}
    middle = cut_lineage(
        middle.filter(F.col("rows") >= MIN_GROUP).select(
            *POOL,
            *[F.col(f"q_{a}")[1].alias(f"m_{a}") for a in names],
            *[F.sqrt(spread[a] * spread[a] + FLOORS[a] ** 2).alias(f"s_{a}") for a in names],
        )
    )
    standard = {a: (F.col(a) - F.col(f"m_{a}")) / F.col(f"s_{a}") for a in names}
    length = F.sqrt(reduce(lambda s, a: s + standard[a] * standard[a], names, F.lit(0.0)))
    bent = _with_pool(vectors, middle).select(
        *POOL,
        *[F.tanh(standard[a]).alias(f"__1_{a}") for a in names],
        *[F.when(length > 0, standard[a] / length).otherwise(0.0).alias(f"__2_{a}") for a in names],
    )
    pairs = [(a, b) for i, a in enumerate(names) for b in names[: i + 1]]
    shapes = bent.groupBy(*POOL).agg(*[F.covar_pop(f"__{k}_{a}", f"__{k}_{b}").alias(f"v_{k}_{b}_{a}") for k in (1, 2) for a, b in pairs])
    both = _with_pool(middle, shapes)
    floor = lambda a, b: F.lit(FLOORS[a] ** 2) if a == b else F.lit(0.0)
    return both.select(
        *POOL,
        *[F.col(f"m_{a}").alias(f"m_{k}_{a}") for k in range(STARTS) for a in names],
        *[(F.col(f"s_{a}") * F.col(f"s_{b}") if a == b else F.lit(0.0)).alias(f"c_0_{b}_{a}") for a, b in pairs],
        *[(F.col(f"v_{k}_{b}_{a}") * F.col(f"s_{a}") * F.col(f"s_{b}") + floor(a, b)).alias(f"c_{k}_{b}_{a}") for k in (1, 2) for a, b in pairs],
    )


def core_estimates(vectors: DataFrame, levels: DataFrame, names: list[str], steps: int = STEPS) -> DataFrame:
    """Minimum-covariance-determinant estimates of each pool that ``levels`` asks for, from ``vectors`` (lang, source, names)."""
    vectors = stored(_pooled(_leveled(vectors, levels), F.explode("__feeds")).select(*POOL, *names), "vectors")
    now = stored(_factored(_starts(vectors, names), names), "estimates")
    for _ in range(steps):
        measured = _with_pool(vectors, now).select(*POOL, *names, *[_distance(names, f"{k}_").alias(f"__d_{k}") for k in range(STARTS)])
        bounds = measured.groupBy(*POOL).agg(*[F.percentile_approx(f"__d_{k}", CORE, 10_000).alias(f"__bound_{k}") for k in range(STARTS)])
        after = _factored(_estimates(_with_pool(measured, bounds), names), names)
        before = now.select(*POOL, *[F.col(f"det_{k}").alias(f"was_{k}") for k in range(STARTS)])
        change = F.greatest(*[F.abs(F.col(f"det_{k}") - F.col(f"was_{k}")) for k in range(STARTS)])
        seen = Observation()
        now = stored(_with_pool(after, before).observe(seen, F.max(change).alias("moved")), "estimates").drop(*[f"was_{k}" for k in range(STARTS)])
        moved = seen.get["moved"]
        if moved is None or moved < SETTLED:
            break
    best = F.array_position(F.array(*[f"det_{k}" for k in range(STARTS)]), F.least(*[F.col(f"det_{k}") for k in range(STARTS)])).cast("int")
    entries = [f"m_{{}}{a}" for a in names] + [f"l_{{}}{b}_{a}" for i, a in enumerate(names) for b in names[: i + 1]]
    return now.select(*POOL, *[F.element_at(F.array(*[e.format(f"{k}_") for k in range(STARTS)]), best).alias(e.format("")) for e in entries])


def judge(docs: DataFrame) -> DataFrame:
    """Base statistics of each row of ``docs`` (doc_id, text, lang, source), base_failed, distance, outlier and kept."""
    base = base_statistics(docs).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    )
    parts = transformed()
    rows = stored(base.select("*", *[F.when(~F.col("base_failed"), c).alias(n) for n, c in parts.items()]), "statistics")
    names = list(parts)
    usable = rows.filter("NOT base_failed").select("lang", "source", *names)
    levels = levels_of(usable)
    groups = core_estimates(usable, levels, names)
    measured = _with_pool(_pooled(_leveled(rows, levels), F.col("__level")), groups, "left")
    measured = measured.withColumn("distance", F.when(~F.col("base_failed"), _distance(names)))
    outlier = F.coalesce(F.col("distance") > MAX_DISTANCE, F.lit(False))
    return measured.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "distance", outlier.alias("outlier"), (~F.col("base_failed") & ~outlier).alias("kept"),
    )
