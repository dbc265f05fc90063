"""Quality rules: text statistics, and robust multivariate outliers per language and source. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlytics.llm.common import pick, read, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Length of the word windows whose repetition counts.
SPAN = 5
#: Features of the statistic vector, and the least standard deviation each is taken to have: a feature that hardly varies rejects nothing.
FEATURES = ("x0", "x1", "x2", "x3")
LEAST_SD = (0.3, 0.08, 0.4, 0.03)
#: Rows that a group needs (else its language stands in), and the fall of a log determinant below which C-steps have ended.
LEAST_ROWS, STILL = 100, 1e-3
#: Chi-square with four degrees: factors that make the covariance of the nearest half, and of the rows within the 0.975
#: quantile WITHIN, consistent; and the squared distance of rejection, which one normal row in 3e11 exceeds.
HALF_FACTOR, WITHIN, WITHIN_FACTOR, CUT = 2.1097, 11.143, 1.0645, 60.0
#: Cells per unit in the histograms behind quantiles, and the widest logarithm of a squared distance they hold.
CELLS = 200


def text_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_distinct`` of ``text``, whole.

    All are column expressions on one row. Words of windows found twice or more are counted over the sorted
    places of such windows; only texts with an equal pair of windows sort them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn("_t", text)
    t = F.col("_t")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    rows = rows.withColumn("_h", F.transform(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))).withColumn("_l", lines)
    h, n = F.col("_h"), F.size("_h")
    windows = F.transform(F.sequence(F.lit(1), n - (SPAN - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + j) for j in range(SPAN)]))
    rows = rows.withColumn("_w", F.when(n >= SPAN, windows).otherwise(F.expr("cast(array() as array<bigint>)")))
    rows = rows.withColumn("_twice", F.size(F.array_distinct("_w")) < F.size("_w"))
    placed = F.array_sort(F.transform("_w", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_s", F.when(F.col("_twice"), placed))
    s = F.col("_s")
    both = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
    places = F.array_sort(F.transform(both, lambda x: x["i"]))
    covered = F.aggregate(places, F.struct(F.lit(-SPAN).alias("last"), F.lit(0).alias("n")), lambda a, i: F.struct(
        i.alias("last"), (a["n"] + F.least(F.lit(SPAN), i - a["last"])).alias("n")))["n"]
    gone = lambda signs: F.length(F.translate(t, signs, ""))
    long = lambda c, name: c.cast("bigint").alias(name)
    return rows.select(
        *docs.columns, long(n, "n_words"), long(gone(" \t\n\x0b\f\r"), "word_chars"), long(F.length(t) - gone("#*$%&|<>"), "n_symbols"),
        long(F.size("_l") - F.size(F.array_distinct("_l")), "n_dup_lines"),
        long(F.when(F.col("_twice"), covered).otherwise(0), "n_repeat_words"), long(F.size(F.array_distinct("_h")), "n_distinct"))


def _features() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [F.log1p(n).alias("x0"), F.log1p(F.col("word_chars") / n).alias("x1"), F.log1p(100 * F.col("n_symbols") / n).alias("x2"),
            (F.log1p("n_distinct") / F.log1p(n)).alias("x3")]


def _quantiles(rows: DataFrame, keys: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """Quantiles of a value per key from counted cells: the same whatever the partitions, and no group is gathered."""
    cells = rows.groupBy(*keys, F.floor(value * CELLS).alias("cell")).agg(F.count("*").alias("n"))
    run = Window.partitionBy(*keys).orderBy("cell")
    whole = Window.partitionBy(*keys)
    cells = cells.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(whole))
    return cells.groupBy(*keys).agg(*[
        F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("all")), (F.col("cell") + 1) / CELLS)).alias(name) for name, q in shares.items()])


def _fit_columns() -> list[str]:
    p = len(FEATURES)
    return [*[f"m{j}" for j in range(p)], *[f"i{i}{j}" for i in range(p) for j in range(i + 1)]]


def _whitening(moments: DataFrame, factor: float) -> DataFrame:
    """Means, the inverse Cholesky factor of ``factor`` times the covariance (with floors on its diagonal) and its log determinant.

    Columns m0.., i00, i10, ... and det, beside those that are no sums.
    """
    p = len(FEATURES)
    keys = [c for c in moments.columns if c in ("g", "s")]
    out = moments
    for j in range(p):
        out = out.withColumn(f"m{j}", F.col(f"s{j}") / F.col("k"))
    low: dict[tuple[int, int], Column] = {}
    for i in range(p):
        for j in range(i + 1):
            cov = factor * (F.col(f"s{j}{i}") / F.col("k") - F.col(f"m{i}") * F.col(f"m{j}"))
            for k in range(j):
                cov = cov - low[i, k] * low[j, k]
            value = F.sqrt(F.greatest(cov, F.lit(0.0)) + LEAST_SD[i] ** 2) if i == j else cov / low[j, j]
            out = out.withColumn(f"l{i}{j}", value)
            low[i, j] = F.col(f"l{i}{j}")
    for i in range(p):
        for j in range(i + 1):
            if i == j:
                value = 1 / low[i, i]
            else:
                value = F.lit(0.0)
                for k in range(j, i):
                    value = value - low[i, k] * F.col(f"i{k}{j}")
                value = value / low[i, i]
            out = out.withColumn(f"i{i}{j}", value)
    det = sum((2 * F.log(low[i, i]) for i in range(p)), F.lit(0.0))
    return out.select(*keys, det.alias("det"), *_fit_columns())


def _sums(weight: Column, x: list[Column]) -> list[Column]:
    p = len(x)
    return [F.sum(weight).alias("k"), *[F.sum(weight * x[j]).alias(f"s{j}") for j in range(p)],
            *[F.sum(weight * x[j] * x[i]).alias(f"s{j}{i}") for i in range(p) for j in range(i + 1)]]


def _distance() -> Column:
    """Squared Mahalanobis distance of a row joined to its group's whitening."""
    p, total = len(FEATURES), F.lit(0.0)
    for i in range(p):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col(f"i{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}"))
        total = total + y * y
    return total


def _starts(rows: DataFrame) -> DataFrame:
    """First fits of each group: ``g, s`` and a fit each.

    Start 0 has medians and median deviations. The others are moments of: the rows scaled by these and pressed by tanh, their
    directions from the medians, and for each feature the rows up to and from its median, so that junk on one
    side of any feature, up to half of the group, is left out by one of them.
    """
    p = len(FEATURES)
    wide = lambda q, name, sign: q.groupBy("g").agg(*[F.max(F.when(F.col("f") == j, F.col(name))).alias(f"{sign}{j}") for j in range(p)])
    long = rows.select("g", F.posexplode(F.array(*FEATURES)).alias("f", "x"))
    middle = stored(wide(_quantiles(long, ["g", "f"], F.col("x"), {"mid": 0.5}), "mid", "c"), "middle")
    away = rows.join(middle, "g").select("g", F.posexplode(F.array(*[F.abs(F.col(f"x{j}") - F.col(f"c{j}")) for j in range(p)])).alias("f", "x"))
    spread = wide(_quantiles(away, ["g", "f"], F.col("x"), {"mad": 0.5}), "mad", "d")
    scale = [F.greatest(1.4826 * F.col(f"d{j}"), F.lit(LEAST_SD[j])).alias(f"d{j}") for j in range(p)]
    scale = stored(middle.join(spread, "g").select("g", *[f"c{j}" for j in range(p)], *scale), "scale")
    first = scale.select("g", F.lit(0).alias("s"), F.lit(0.0).alias("det"), *[F.col(f"c{j}").alias(f"m{j}") for j in range(p)],
                         *[(1 / F.col(f"d{i}") if i == j else F.lit(0.0)).alias(f"i{i}{j}") for i in range(p) for j in range(i + 1)])
    known = rows.join(scale, "g")
    x, c, d = ([F.col(f"{n}{j}") for j in range(p)] for n in "xcd")
    z = [(x[j] - c[j]) / d[j] for j in range(p)]
    norm = F.greatest(F.sqrt(sum((v * v for v in z), F.lit(0.0))), F.lit(1e-9))
    shapes = [[c[j] + d[j] * F.tanh(z[j]) for j in range(p)], [c[j] + d[j] * z[j] / norm for j in range(p)]]
    kinds = [F.struct(F.lit(n + 1).alias("s"), F.lit(1.0).alias("w"), *[v.alias(f"y{j}") for j, v in enumerate(y)]) for n, y in enumerate(shapes)]
    for j in range(p):
        for n, side in enumerate((x[j] <= c[j], x[j] >= c[j])):
            kinds.append(F.struct(F.lit(3 + 2 * j + n).alias("s"), side.cast("double").alias("w"), *[v.alias(f"y{i}") for i, v in enumerate(x)]))
    every = known.select("g", F.inline(F.array(*kinds))).where("w > 0")
    others = _whitening(every.groupBy("g", "s").agg(*_sums(F.col("w"), [F.col(f"y{j}") for j in range(p)])), 1.0)
    return first.unionByName(others)


def covariance_determinant(rows: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant fit of each group ``g`` with LEAST_ROWS rows of the FEATURES.

    From each of :func:`_starts`, C-steps fit mean and covariance to the half of the group, (n + p + 1) / 2 rows, that lies
    nearest by the fit before, until the determinant falls no more; of all starts the least determinant counts, and the rows
    within the 0.975 quantile of it give the final fit. Rows in the cell of distances that holds the last of the half share its
    remaining weight. Steps are grouped sums and counted cells joined back by group, so a group may be of any size; each step's
    small table is written to the shared folder. Returns per group the whitening and the number of rows.
    """
    p, columns = len(FEATURES), _fit_columns()
    sizes = stored(rows.groupBy("g").agg(F.count("*").alias("rows")).where(F.col("rows") >= LEAST_ROWS), "sizes")
    rows = rows.join(sizes.select("g"), "g", "left_semi")
    x = [F.col(f) for f in FEATURES]
    ended: list[DataFrame] = []
    fit = stored(_starts(rows).withColumn("det", F.lit(float("inf"))).withColumn("turn", F.lit(0)), "fit")
    turn = 0
    while True:
        turn += 1
        near = rows.join(fit.select("g", "s", *columns), "g").select("g", "s", *FEATURES, F.floor(F.log1p(_distance()) * CELLS).alias("cell"))
        run = Window.partitionBy("g", "s").orderBy("cell")
        cells = near.groupBy("g", "s", "cell").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(run))
        half = F.floor((F.sum("n").over(Window.partitionBy("g", "s")) + (p + 1)) / 2)
        edge = cells.withColumn("half", half).where("upto >= half AND upto - n < half")
        edge = stored(edge.select("g", "s", F.col("cell").alias("last"), ((F.col("half") - F.col("upto") + F.col("n")) / F.col("n")).alias("part")), "edge")
        inner = near.join(edge, ["g", "s"]).where("cell <= last").withColumn("w", F.when(F.col("cell") < F.col("last"), 1.0).otherwise(F.col("part")))
        new = _whitening(inner.groupBy("g", "s").agg(*_sums(F.col("w"), x)), HALF_FACTOR).withColumn("turn", F.lit(turn))
        both = new.unionByName(fit).groupBy("g", "s").agg(F.min(F.struct("det", "turn", *columns)).alias("fit"), F.max("det").alias("before"))
        # Starts that have met go on as one.
        both = both.groupBy("g", F.round("fit.det", 9).alias("met")).agg(F.min(F.struct("s", "fit", "before")).alias("b"))
        both = stored(both.select("g", "b.s", "b.fit.*", (F.col("b.fit.turn") < turn).alias("rose"), "b.before"), "fit")
        falls = (F.col("before") - F.col("det") > STILL) & ~F.col("rose")
        ended.append(both.where(~falls).select("g", "s", "det", *columns))
        fit = both.where(falls).select("g", "s", "det", "turn", *columns)
        if fit.isEmpty():
            break
    every = ended[0]
    for more in ended[1:]:
        every = every.unionByName(more)
    best = stored(every.groupBy("g").agg(F.min(F.struct("det", "s", *columns)).alias("b")).select("g", *[f"b.{c}" for c in columns]), "fit")
    inner = rows.join(best, "g").where(_distance() <= WITHIN)
    final = _whitening(inner.groupBy("g").agg(*_sums(F.lit(1.0), x)), WITHIN_FACTOR)
    return stored(final.join(sizes, "g").select("g", *columns, "rows"), "fit")


def quality_verdicts(stats: DataFrame) -> DataFrame:
    """``stats`` (of :func:`text_statistics`, with ``lang`` and ``source``) with ``base_failed, distance, kept``.

    Rows that pass the base rule are judged in their group of language and source if it has LEAST_ROWS such rows, else
    among their language; where that is too small as well they are kept with a NULL distance. NULL language or
    source is the value ''. Rejected are rows whose squared distance from the final fit exceeds CUT.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    own = F.to_json(F.array(F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))))
    wide = F.to_json(F.array(F.coalesce("lang", F.lit(""))))
    told = stats.select("*", *_features(), failed.alias("base_failed"), own.alias("_own"), wide.alias("_wide"))
    good = told.where("NOT base_failed")
    fits = covariance_determinant(good.select(F.explode(F.array("_own", "_wide")).alias("g"), *FEATURES))
    known = fits.select(F.col("g").alias("_k"))
    chosen = told.join(known, F.col("_own") == F.col("_k"), "left").withColumn("g", F.when(F.col("_k").isNotNull(), F.col("_own")).otherwise(F.col("_wide"))).drop("_k")
    judged = chosen.join(fits, "g", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return judged.select(*stats.columns, "base_failed", "distance", (~F.col("base_failed") & F.coalesce(F.col("distance") <= CUT, F.lit(True))).alias("kept"))


def judge_quality(docs: DataFrame) -> DataFrame:
    """One row per document: ids, statistics and verdict. The statistics are stored, as every step reads them.

    NULL, empty and blank texts have no words and fail the base rule; repeated rows are judged alike; other columns
    are ignored; an empty table gives an empty result.
    """
    own = pick(docs, doc_id="bigint", text="string", lang="string", source="string")
    return quality_verdicts(stored(text_statistics(own).drop("text"), "statistics"))


def op8_mcd_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge_quality(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
