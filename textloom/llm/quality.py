"""Quality rules: robust multivariate outliers by minimum covariance determinants, in column expressions only.

Each text yields counts (words, symbols, repeated lines and passages); two plain rules reject at once. The others' transformed counts form
a vector. For each language and source, each language, and all texts a minimum-covariance-determinant estimate is found by concentration steps: from two
starts (mean and covariance; medians with quartile ranges), the share SHARE of rows with the smallest distances gives the next mean and covariance, until no determinant falls any more; the
start that ends at the smaller determinant is taken, scaled for normal data and re-weighted once. A group leans on the wider one by n / (n + LEAN), its language on all texts, and these on
a wide prior, so that groups of any size are treated alike and a handful of rows rejects nothing. A row whose squared Mahalanobis distance from its group's estimate passes the CUTOFF quantile of
chi-square is rejected.

Everything is plain sums over groups: moments, and counts of values and distances in bins of fixed edges (one percent of a distance, a tenth of a part's least deviation), from which shares
and quartiles are read. Moments are summed by group and salt first, so that a group's rows never meet in one task.

Cases: null and empty texts have no words and fail the base rules. Null languages and sources are groups of their own. Repeated rows count each for themselves;
rows in the bin of a step's threshold are all taken in. A text of any length is counted whole, in one task. An empty table gives no rows. Extra columns are ignored by judge() and kept by passing().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, cut, hashes_of, small, table

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATS = 50, 50
#: The share of rows that an estimate rests on, the most concentration steps, and the fall of a log-determinant that counts as one.
SHARE, STEPS, FALL = 0.75, 5, 1e-2
#: Rows at which a group's estimate weighs as much as that of the wider group.
LEAN = 100
#: Groups (about 250 bytes each) up to which estimates are sent to every executor.
FEW = 20_000
#: Quantile of chi-square beyond which a row is rejected.
CUTOFF = 1 - 1e-9
#: Sub-groups that sums are made by first.
SALT = 32
#: The prior for all texts, in least deviations.
WIDE = 10
#: The vector, and the least standard deviation of each part, so that parts that hardly vary reject nothing by rounding.
PARTS = {"v_words": 0.5, "v_length": 0.25, "v_symbols": 0.05, "v_lines": 0.25, "v_repeats": 0.1}
NAMES = list(PARTS)
P = len(NAMES)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def chi2_cdf(x: float, k: float) -> float:
    """By the series of the lower incomplete gamma function."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(q: float, k: float) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return (low + high) / 2


def scale(share: float) -> float:
    """What the covariance of the rows with the smallest distances is multiplied by, for normal data."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


def counts(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) for each row, with the columns to keep."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"), *keep)
    trimmed = F.btrim("text", F.lit(BLANKS))
    d = d.withColumn("words", F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0))
    d = d.select(
        "doc_id", "lang", "source", *keep, "words", F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    # Windows of three words by hash; only texts that repeat one sort them, to find which positions repeat.
    windows = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    d = d.withColumn("windows", F.when(F.col("n_words") >= 4, windows))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    d = d.withColumn("order", F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("words", "windows")
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    found = F.filter("order", lambda x, k: same(x, F.get("order", k - 1)) | same(x, F.get("order", k + 1)))
    d = d.withColumn("found", F.sort_array(F.transform(found, lambda x: x["i"]))).drop("order")
    covered = F.transform("found", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("found", k + 1) - p, F.lit(3))))
    d = d.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("found")
    return d.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATS * F.col("n_words")))


def _vector(d: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    parts = {
        "v_words": F.log1p("n_words"),
        "v_length": F.log((F.col("word_chars") + 1) / n),
        "v_symbols": F.sqrt(F.col("n_symbols") / n),
        "v_lines": F.log1p("n_dup_lines"),
        "v_repeats": F.sqrt(F.col("n_repeat_words") / n),
    }
    own = lambda c: F.concat(F.when(F.col(c).isNull(), "-").otherwise("="), F.coalesce(F.col(c), F.lit("")))
    return d.withColumns(parts).withColumns({"own": F.concat(own("lang"), F.lit("\n"), own("source")), "pooled": own("lang")})


def _with_distance(df: DataFrame) -> DataFrame:
    """df with d2, the squared Mahalanobis distance from columns m0.. and the factor l00.. of the covariance, by forward substitution: each part is a column, so that it is computed once."""
    for i in range(P):
        rest = F.col(NAMES[i]) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"_z{j}")
        df = df.withColumn(f"_z{i}", rest / F.col(f"l{i}{i}"))
    d2 = F.col("_z0") * F.col("_z0")
    for i in range(1, P):
        d2 = d2 + F.col(f"_z{i}") * F.col(f"_z{i}")
    return df.withColumn("d2", d2).drop(*[f"_z{i}" for i in range(P)])


def _counted(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, n): rows by group and bin."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def _summed(df: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """Sums by group, first by group and salt: whatever number of tasks hold a group's rows, few partial sums meet in one."""
    part = df.withColumn("_salt", F.spark_partition_id() % SALT).groupBy(*by, "_salt").agg(*[F.sum(x).alias(n) for n, x in sums.items()])
    return part.groupBy(*by).agg(*[F.sum(n).alias(n) for n in sums])


def _moments(df: DataFrame, by: list[str], near: Column | None = None) -> DataFrame:
    """(by, n, m0.., c00..): rows, means and covariances of each group, of the rows that are near if that is given. These are summed by a weight of 1 or 0: a filter would compute distances anew."""
    w = F.lit(1.0) if near is None else F.col("_w")
    df = df if near is None else df.withColumn("_w", F.when(near, 1.0).otherwise(0.0))
    one = {"n": w} | {f"s{i}": w * F.col(x) for i, x in enumerate(NAMES)} | {f"p{i}{j}": w * F.col(NAMES[i]) * F.col(NAMES[j]) for i, j in PAIRS}
    g = _summed(df, by, one).where("n > 0").withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(P)})
    return g.select(*by, "n", *[f"m{i}" for i in range(P)], *[(F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")).alias(f"c{i}{j}") for i, j in PAIRS])


def _factor(g: DataFrame, times: float) -> DataFrame:
    """l00..: the Cholesky factor of `times` the covariances c00.. with the floors added to the diagonal, in place of them, and logdet."""
    for i, j in PAIRS:
        x = F.col(f"c{i}{j}") * times + (PARTS[NAMES[i]] ** 2 if i == j else 0)
        for k in range(j):
            x = x - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        g = g.withColumn(f"l{i}{j}", F.sqrt(F.greatest(x, F.lit(1e-12))) if i == j else x / F.col(f"l{j}{j}"))
    logdet = sum((F.log(f"l{i}{i}") for i in range(1, P)), F.log("l00"))
    return g.withColumn("logdet", logdet).drop(*[f"c{i}{j}" for i, j in PAIRS])


def _reached(counted: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """(by, one column a share): the first bin at which the counts of (by, bin, n) reach each share of the group's. A group has as many rows here as it has bins."""
    w = Window.partitionBy(*by)
    c = counted.withColumn("_sum", F.sum("n").over(w.orderBy("bin"))).withColumn("_all", F.sum("n").over(w))
    return c.groupBy(*by).agg(*[F.min(F.when(F.col("_sum") >= s * F.col("_all"), F.col("bin"))).alias(n) for n, s in shares.items()])


def _quartiles(rows: DataFrame) -> DataFrame:
    """(grp, q0.., r0..): medians and quartile ranges as deviations of normal data, by bins of a tenth of the least deviation."""
    each = F.array(*[F.struct(F.lit(i).alias("part"), F.floor(F.col(n) / (PARTS[n] / 10)).alias("bin")) for i, n in enumerate(NAMES)])
    counted = _counted(rows.select("grp", F.inline(each)), ["grp", "part", "bin"])
    found = _reached(counted, ["grp", "part"], {"low": 0.25, "mid": 0.5, "high": 0.75})
    of = lambda i, x: F.max(F.when(F.col("part") == i, x))
    width = {i: PARTS[n] / 10 for i, n in enumerate(NAMES)}
    return found.groupBy("grp").agg(*[of(i, (F.col("mid") + 0.5) * width[i]).alias(f"q{i}") for i in range(P)], *[of(i, (F.col("high") - F.col("low")) * (width[i] / 1.349)).alias(f"r{i}") for i in range(P)])


_LOG_STEP = math.log(1.01)


def _bin(d2: Column) -> Column:
    """The bin of a squared distance: bins are one percent wide, from the smallest that matters."""
    return F.greatest(F.lit(-1), F.floor(F.log(d2 + 1e-6) / _LOG_STEP - math.log(1e-3) / _LOG_STEP)).cast("int")


def concentrated(rows: DataFrame) -> DataFrame:
    """(grp, size, start, m0.., l00.., logdet): the estimate of each group of rows (grp not null, and NAMES), by the better of two starts, and the group's rows."""
    means = [f"m{i}" for i in range(P)]
    factors = [f"l{i}{j}" for i, j in PAIRS]
    columns = ["grp", "start", *means, *factors, "logdet"]
    first = cut(_moments(rows, ["grp"]))
    whole = _factor(first, 1.0).select("grp", F.lit(0).alias("start"), *means, *factors, "logdet")
    spread = lambda i: F.sqrt(F.pow(F.col(f"r{i}"), 2) + PARTS[NAMES[i]] ** 2)
    robust = _quartiles(rows).select("grp", F.lit(1).alias("start"), *[F.col(f"q{i}").alias(f"m{i}") for i in range(P)], *[(spread(i) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in PAIRS], F.lit(float("inf")).alias("logdet"))
    now = cut(whole.withColumn("logdet", F.lit(float("inf"))).unionByName(robust).select(*columns))
    sent = F.broadcast if first.limit(FEW + 1).count() <= FEW else (lambda df: df)  # all steps have the same groups
    both, by = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1)))), ["grp", "start"]
    for _ in range(STEPS):
        counted = _counted(_with_distance(both.join(sent(now), by)).select(*by, _bin(F.col("d2")).alias("bin")), [*by, "bin"])
        edged = cut(now.join(_reached(counted, by, {"edge": SHARE}), by))
        far = _with_distance(both.join(sent(edged), by)).select(*by, *NAMES, "d2", "edge")
        new = cut(_factor(_moments(far, by, _bin(F.col("d2")) <= F.col("edge")), scale(SHARE)).select(*columns))
        # Only a count comes to the driver.
        fell = new.alias("x").join(now.alias("y"), by).where(F.col("x.logdet") < F.col("y.logdet") - FALL).limit(1).count()
        now = new
        if not fell:
            break
    best = now.groupBy("grp").agg(F.min(F.struct("logdet", "start")).alias("best")).select("grp", F.col("best.start").alias("start"))
    return cut(best.join(now, by).join(first.select("grp", F.col("n").alias("size")), "grp"))


def mcd(rows: DataFrame) -> DataFrame:
    """(grp, n, m0.., c00..): the minimum-covariance-determinant estimate of each group of rows (grp not null, and NAMES), re-weighted, and the group's rows."""
    found = concentrated(rows)
    best = found.drop("start", "logdet", "size")
    q = chi2_quantile(0.975, P)
    far = _with_distance(rows.join(small(best, FEW), "grp")).select("grp", *NAMES, "d2")
    times = 0.975 / chi2_cdf(q, P + 2)
    g = _moments(far, ["grp"], F.col("d2") <= q).drop("n").join(found.select("grp", F.col("size").alias("n")), "grp")
    return g.select("grp", "n", *[f"m{i}" for i in range(P)], *[(F.col(f"c{i}{j}") * times).alias(f"c{i}{j}") for i, j in PAIRS])


def _leaned(own: str, on: list[str], wide: dict[str, Column]) -> dict[str, Column]:
    """Estimates blended with those of the wider group, by n / (n + LEAN)."""
    share = F.coalesce(F.col(f"{own}n") / (F.col(f"{own}n") + LEAN), F.lit(0.0))
    return {x: share * F.coalesce(F.col(f"{own}{x}"), F.lit(0.0)) + (1 - share) * wide[x] for x in on}


def estimates(d: DataFrame) -> DataFrame:
    """(own, m0.., l00..): what each group of d (own, pooled, base_failed, and NAMES) is judged by."""
    fit = d.where(~F.col("base_failed")).select(F.explode(F.array("own", "pooled", F.lit("*"))).alias("grp"), *NAMES)
    found = cut(mcd(fit))
    parts = [f"m{i}" for i in range(P)] + [f"c{i}{j}" for i, j in PAIRS]
    of = lambda name, mark: found.select(F.col("grp").alias(name), *[F.col(c).alias(f"{mark}{c}") for c in ["n", *parts]])
    groups = d.select("own", "pooled").distinct().withColumn("every", F.lit("*"))
    every = small(found.where("grp = '*'").select(F.col("grp").alias("every"), *[F.col(c).alias(f"e_{c}") for c in ["n", *parts]]), 1)
    g = groups.join(of("own", "a_"), "own", "left").join(of("pooled", "b_"), "pooled", "left").join(every, "every", "left")
    prior = {f"m{i}": F.coalesce(F.col(f"e_m{i}"), F.lit(0.0)) for i in range(P)} | {f"c{i}{j}": F.lit((WIDE * PARTS[NAMES[i]]) ** 2 if i == j else 0.0) for i, j in PAIRS}
    blend = prior
    for mark in ("e_", "b_", "a_"):
        g = g.withColumns({f"x_{k}": v for k, v in _leaned(mark, parts, blend).items()})
        blend = {k: F.col(f"x_{k}") for k in parts}
    return _factor(g.select("own", *[F.col(f"x_{k}").alias(k) for k in parts]), 1.0).drop("logdet")


def judge(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """counts() with distance (double) and kept."""
    d = cut(_vector(counts(docs, keep)))
    chosen = small(cut(estimates(d)), FEW)
    counted = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    far = _with_distance(d.join(chosen, "own", "left"))
    # A row's number beside the distance keeps conditions on verdicts above it.
    far = far.withColumn("_far", F.struct("d2", F.monotonically_increasing_id().alias("row"))).withColumn("distance", F.col("_far.d2"))
    verdict = F.coalesce(F.col("distance") <= chi2_quantile(CUTOFF, P), F.lit(True))
    return far.select(*keep, "doc_id", "lang", "source", *counted, "distance", (~F.col("base_failed") & verdict).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def passing(docs: DataFrame) -> DataFrame:
    """docs without the rows that judge() rejects. A verdict depends on text, lang and source only, so rows meet theirs by doc_id and hashes of these. All columns of docs stay, whatever their names."""
    flat = docs.select(F.struct("*").alias("row"), "doc_id", "text", "lang", "source").withColumns(hashes_of("text", "lang", "source"))
    gone = judge(flat, ("_h1", "_h2")).where(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.col("_h1").alias("_g1"), F.col("_h2").alias("_g2")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_gone")) & (F.col("_h1") == F.col("_g1")) & (F.col("_h2") == F.col("_g2"))
    return flat.select("row", "doc_id", "_h1", "_h2").join(gone, same, "left_anti").select("row.*")
