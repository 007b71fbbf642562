"""Quality rules: multivariate outliers by minimum-covariance-determinant estimates per language and source, in column expressions only.

Each text gives four transformed statistics. Within each language and source, the `SUPPORT` share of texts is sought whose covariance has the
least determinant. Concentration steps lead there: distances from the present estimate, their quantile, and the moments of the texts within
it, whose determinant is no larger. They begin from four estimates at once: medians and median absolute deviations, all moments, and the
moments of texts drawn towards the median by a hyperbolic tangent and by cutting off. After `STEPS` steps the start of the least determinant goes on for
`MORE` steps, of which the least determinant counts. A text whose Mahalanobis distance from its group exceeds the
cutoff is rejected. Estimates of small groups lean on those of all texts (a regularised determinant): the latter count as `PRIOR` texts of every group, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.shared import written

BLANK = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEATED = 20, 30

STEPS, MORE, SUPPORT, PRIOR = 2, 3, 0.75, 50.0
#: Makes the covariance of the closest 75 % of normal vectors in 4 dimensions consistent: 0.75 / P(chi2 with 6 <= quantile of chi2 with 4).
CONSISTENCY = 1.485
#: Squared distance at which a text is rejected: the quantile 1 - 1e-6 of chi2 with 4 degrees of freedom.
CUTOFF = 33.4
#: Least standard deviation of each transformed statistic, so that a group that is all alike does not reject the slightest difference.
FLOORS = (0.1, 0.3, 0.05, 0.05)
P = len(FLOORS)
#: Parts of each group in joins, so that a language and source with a third of all texts is not one task.
SALTS = 16
KEYS = ("_lang", "_source")
_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def base_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of `docs` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long) of the whole text.

    Lines count if they have a word. A window occurring twice is found by sorting the hashes of all windows of a text with their places.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = docs.withColumn("_words", F.filter(F.split(text, BLANK, -1), lambda w: w != ""))
    lines = words.withColumn("_lines", F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != ""))
    n = F.size("_words")
    places = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(places, lambda i: F.struct(F.xxhash64(F.slice("_words", i + 1, WINDOW)).alias("h"), i.alias("i")))
    counted = lines.select(
        *docs.columns, n.cast("long").alias("n_words"), F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"), F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.sort_array(windows).alias("_sorted"),
    )

    def twice(x: Column, i: Column) -> Column:
        near = [F.coalesce(F.get("_sorted", k)["h"] == x["h"], F.lit(False)) for k in (i - 1, i + 1)]
        return F.when(near[0] | near[1], x["i"])

    repeated = counted.withColumn("_at", F.sort_array(F.filter(F.transform("_sorted", twice), lambda p: p.isNotNull())))
    new = F.transform("_at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", i + 1), p + WINDOW) - p))
    return repeated.withColumn("n_repeat_words", F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_sorted", "_at")


def vector() -> list[Column]:
    """Mean word length, share of symbols, of repeated lines and of repeated words; few words or lines pull them to what is usual."""
    return [
        F.log((F.col("word_chars") + 250.0) / (F.col("n_words") + 50.0)),
        F.log1p(100.0 * F.col("n_symbols") / (F.col("word_chars") + 20.0)),
        F.col("n_dup_lines") / (F.col("n_lines") + 10.0),
        F.col("n_repeat_words") / (F.col("n_words") + 20.0),
    ]


def _moments() -> list[Column]:
    means = [F.avg(f"x{i}").alias(f"m{i}") for i in range(P)]
    return [F.count("*").cast("double").alias("n"), *means, *(F.covar_pop(f"x{i}", f"x{j}").alias(f"s{i}{j}") for i, j in _PAIRS)]


def _whitened(groups: DataFrame) -> DataFrame:
    """(lang, source, start, logdet, m0.., w00..): w is the inverse of the Cholesky factor of the covariance s00.. with its floors added, and logdet the
    logarithm of that covariance's determinant."""
    for i, j in _PAIRS:
        rest = F.col(f"s{i}{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        groups = groups.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    for i in range(P):
        for j in range(i + 1):
            total = F.lit(1.0 if i == j else 0.0)
            for k in range(j, i):
                total = total - F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
            groups = groups.withColumn(f"w{i}{j}", total / F.col(f"l{i}{i}"))
    determinant = sum((2 * F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0)).alias("logdet")
    return groups.select(*KEYS, "_start", determinant, *(f"m{i}" for i in range(P)), *(f"w{i}{j}" for i, j in _PAIRS))


def _distance() -> Column:
    rows = [sum((F.col(f"w{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0)) for i in range(P)]
    return sum((r * r for r in rows), F.lit(0.0))


def _salted(groups: DataFrame) -> DataFrame:
    """Each row of a table by group once for each part; texts have the number of their part in `_salt`."""
    return groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _measured(points: DataFrame, groups: DataFrame) -> DataFrame:
    """`points` with their distance, once for each start of `groups`."""
    return points.join(_salted(groups), [*KEYS, "_salt"]).select(*points.columns, "_start", _distance().alias("distance"))


def _starts(points: DataFrame) -> DataFrame:
    """(_lang, _source, _start, m0.., s00..): four first estimates of mean and covariance."""
    middle = written(points.groupBy(*KEYS).agg(*(F.percentile_approx(f"x{i}", 0.5).alias(f"m{i}") for i in range(P))), "medians")
    deviation = points.join(_salted(middle), [*KEYS, "_salt"]).groupBy(*KEYS).agg(
        *(F.first(f"m{i}").alias(f"m{i}") for i in range(P)),
        *((1.4826 * F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5)).alias(f"d{i}") for i in range(P)),
    )
    scale = written(deviation, "scale")
    medians = scale.select(*KEYS, F.lit(0).alias("_start"), *(f"m{i}" for i in range(P)), *((F.pow(f"d{i}", F.lit(2.0)) if i == j else F.lit(0.0)).alias(f"s{i}{j}") for i, j in _PAIRS))

    def drawn(pull) -> Column:
        width = [F.greatest(F.col(f"d{i}"), F.lit(FLOORS[i])) for i in range(P)]
        return F.array(*(F.col(f"m{i}") + width[i] * pull((F.col(f"x{i}") - F.col(f"m{i}")) / width[i]) for i in range(P)))

    kinds = [F.array(*(F.col(f"x{i}") for i in range(P))), drawn(F.tanh), drawn(lambda z: F.greatest(F.lit(-1.5), F.least(F.lit(1.5), z)))]
    versions = F.array(*(F.struct(F.lit(k + 1).alias("start"), v.alias("v")) for k, v in enumerate(kinds)))
    moved = points.join(_salted(scale), [*KEYS, "_salt"]).select(*KEYS, F.explode(versions).alias("y")).select(
        *KEYS, F.col("y.start").alias("_start"), *(F.col("y.v")[i].alias(f"x{i}") for i in range(P)))
    return medians.unionByName(moved.groupBy(*KEYS, "_start").agg(*_moments()).drop("n"))


def concentrated(points: DataFrame, groups: DataFrame) -> DataFrame:
    """The estimates after one concentration step: the moments of the closest `SUPPORT` share, mixed with those of all groups."""
    keys = [*KEYS, "_start"]
    measured = _measured(points, groups)
    cuts = written(measured.groupBy(*keys).agg(F.percentile_approx("distance", SUPPORT, 10_000).alias("cut")), "cuts")
    within = measured.join(_salted(cuts), [*keys, "_salt"]).where("distance <= cut")
    moments = written(within.groupBy(*keys).agg(*_moments()), "moments")
    n = F.col("n")
    pooled = moments.groupBy("_start").agg(  # a row for each start: the pooled mean and the pooled covariance within groups
        *(F.coalesce(F.sum(n * F.col(f"m{i}")) / F.sum(n), F.lit(0.0)).alias(f"pm{i}") for i in range(P)),
        *(F.coalesce(F.sum(n * F.col(f"s{i}{j}")) / F.sum(n), F.lit(0.0)).alias(f"ps{i}{j}") for i, j in _PAIRS),
    )
    own, prior = n / (n + PRIOR), PRIOR / (n + PRIOR)
    apart = [F.col(f"m{i}") - F.col(f"pm{i}") for i in range(P)]
    mixed = moments.join(F.broadcast(pooled), "_start").select(
        *keys, *((own * F.col(f"m{i}") + prior * F.col(f"pm{i}")).alias(f"m{i}") for i in range(P)),
        *((CONSISTENCY * (own * F.col(f"s{i}{j}") + prior * F.col(f"ps{i}{j}")) + own * prior * apart[i] * apart[j]).alias(f"s{i}{j}") for i, j in _PAIRS),
    )
    return written(_whitened(mixed), "estimate")


def _least(groups: DataFrame) -> DataFrame:
    """Of each group the estimate of the least determinant; of equals the first start's."""
    rest = [c for c in groups.columns if c not in KEYS]
    best = F.min_by(F.struct(*rest), F.struct("logdet", "_start")).alias("best")
    return written(groups.groupBy(*KEYS).agg(best).select(*KEYS, *(F.col(f"best.{c}").alias(c) for c in rest)), "least")


def estimates(points: DataFrame, steps: int = STEPS, more: int = MORE) -> DataFrame:
    """(_lang, _source, _start, logdet, m0.., w00..) of `points` (_lang, _source, _salt, x0..): the robust mean and whitening of each group."""
    groups = written(_whitened(_starts(points)), "estimate")
    for _ in range(steps):
        groups = concentrated(points, groups)
    best = _least(groups)
    for _ in range(more):
        best = _least(best.unionByName(concentrated(points, best)))
    return best


def quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF
) -> DataFrame:
    """(`id_col`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept) for every row of `docs`.

    A null text has no words. A null language or source counts as an empty one. Texts without words take no part in the estimates and are
    not kept; repeated rows come out as often as they came in; an empty table gives an empty table. Other columns are not read.
    """
    source = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("_lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source"), F.col(text_col).cast("string").alias("_text"),
    )
    stats = base_statistics(source, "_text").drop("_text")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    salt = F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int").alias("_salt")
    ready = written(stats.select("*", salt, failed.alias("base_failed"), *(x.alias(f"x{i}") for i, x in enumerate(vector()))), "statistics")
    groups = estimates(ready.where("n_words > 0").select(*KEYS, "_salt", *(f"x{i}" for i in range(P))))
    found = ready.join(_salted(groups), [*KEYS, "_salt"], "left").withColumn("distance", F.coalesce(_distance(), F.lit(0.0)))
    return found.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & (F.col("distance") <= cutoff)).alias("kept"),
    )
