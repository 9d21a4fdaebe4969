"""Quality by robust multivariate outliers: minimum covariance determinant for each language and source.

Documents that pass the base rules are described by five transformed statistics in whole grid steps, and equal
descriptions of a group are counted as one cell, so that the estimates work on cells and not on documents. From two
starts (median and median deviation; mean and covariance), concentration steps take the half of a group nearest to
the current centre by Mahalanobis distance and estimate centre and covariance from that half; of the two ends the one
with the smaller determinant stays. It is made consistent for normal data, and one reweighting step uses all cells
within the usual range. Estimates of groups are drawn towards those of the whole corpus, as if the whole had
contributed `prior` documents, and no deviation is less than its least one: small and constant groups need no rule of
their own. Documents beyond the cutoff are rejected.

Everything is DataFrame functions. Sums are over whole numbers, so reruns agree in every bit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrove.llm.common import Scratch, documents, join_hot, joins_hot

_SPACES = "\t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

#: The statistics and their least deviations, in the units of the transform.
LEAST = {"length": 0.5, "word_length": 0.05, "symbols": 0.3, "dup_lines": 0.2, "repeats": 0.2}
_NAMES = tuple(LEAST)
_P = len(_NAMES)
_GRID = 16  # grid steps in a least deviation
_STEPS = 6  # concentration steps from each start
_BINS = 4095  # of distances, 256 to a unit
_PRIOR = 50.0
_STARTS = ("median", "mean")


# --- chi-squared values that the estimates need, from the closed form for whole degrees of freedom


def chi2_below(x: float, k: int) -> float:
    """The probability that a chi-squared variable of k degrees is below x."""
    if k % 2 == 0:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))
    tail = math.erfc(math.sqrt(x / 2))
    return 1 - tail - math.exp(-x / 2) * sum((x / 2) ** (i - 0.5) / math.gamma(i + 0.5) for i in range(1, (k + 1) // 2))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_below(mid, k) < q else (low, mid)
    return low


def consistency(q: float) -> float:
    """What the covariance of the nearest share q of normal data has to be multiplied by."""
    return q / chi2_below(chi2_quantile(q, _P), _P + 2)


_NEAR = chi2_quantile(0.975, _P)  # the usual range of the reweighting step
_HALF, _MOST = consistency(0.5), consistency(0.975)


# --- base statistics


def base_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    A text's windows of three words are sorted by a 64-bit hash within the row; no text is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(F.translate(text, _SPACES, " " * len(_SPACES)), " "), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, _SPACES + " ", "") != "")
    out = docs.withColumns({"_words": words, "_lines": lines, "_chars": F.length(text)})
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"), "word_chars": F.length(F.translate(text, _SPACES + " ", "")).cast("long"),
        "n_symbols": (F.col("_chars") - F.length(F.translate(text, _SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    })  # fmt: skip
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    window = lambda i: F.struct(F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.cast("int").alias("i"))  # noqa: E731
    windows = F.when(F.col("n_words") >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size("_words") - 3), window))).otherwise(none)
    out = out.withColumn("_windows", windows)
    same = lambda x, i: F.coalesce(F.get("_windows", i)["h"] == x["h"], F.lit(False))  # noqa: E731
    starts = F.sort_array(F.transform(F.filter("_windows", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))
    out = out.withColumn("_starts", starts)
    fresh = F.transform("_starts", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("_starts", i + 1) - x, F.lit(3))))
    out = out.withColumn("n_repeat_words", F.aggregate(fresh, F.lit(0).cast("long"), lambda s, x: s + x.cast("long")))
    return out.drop("_words", "_lines", "_chars", "_windows", "_starts")


def base_failed(least_words: int, most_repeats: int) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))


def described() -> dict[str, Column]:
    """z0 and so on: the transformed statistics in whole grid steps, for documents with a word."""
    words = F.col("n_words").cast("double")
    values = {
        "length": F.ln(words), "word_length": F.ln(F.col("word_chars") / words), "symbols": F.log1p(100.0 * F.col("n_symbols") / F.col("word_chars")),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / F.col("n_lines").cast("double")), "repeats": F.sqrt(F.col("n_repeat_words") / words),
    }  # fmt: skip
    return {f"z{i}": F.floor(values[n] * F.lit(_GRID / LEAST[n]) + F.lit(0.5)).cast("long") for i, n in enumerate(_NAMES)}


# --- estimates: rows (g, ..., m0 .. m4, and the lower triangle c00, c10, c11 .. c44 of a covariance)
#
# A chain of columns is one select whose items name those before them: each DataFrame on the way would be analysed anew.

_TRIANGLE = [(i, j) for i in range(_P) for j in range(i + 1)]


def _factored(params: DataFrame) -> DataFrame:
    """params with the Cholesky factor l00 .. l44 of its covariance, row by row, and `logdet`."""
    left = {(i, j): " - ".join([f"c{i}{j}", *[f"l{i}{k} * l{j}{k}" for k in range(j)]]) for i, j in _TRIANGLE}
    factor = [f"sqrt({left[i, j]}) AS l{i}{j}" if i == j else f"({left[i, j]}) / l{j}{j} AS l{i}{j}" for i, j in _TRIANGLE]
    return params.selectExpr("*", *factor, " + ".join(f"ln(l{i}{i})" for i in range(_P)) + " AS logdet")


def _distanced(rows: DataFrame) -> DataFrame:
    """rows with z, m and l columns, and `d2`, the squared Mahalanobis distance."""
    away = [f"({' - '.join([f'z{i} - m{i}', *[f'l{i}{k} * y{k}' for k in range(i)]])}) / l{i}{i} AS y{i}" for i in range(_P)]
    return rows.selectExpr("*", *away, " + ".join(f"y{i} * y{i}" for i in range(_P)) + " AS d2").drop(*[f"y{i}" for i in range(_P)])


def _sums() -> list[Column]:
    """Weighted counts and sums of whole numbers: exact in any order."""
    wide = lambda c, name: F.expr(f"sum(CAST({c} AS DECIMAL(38,0))) AS {name}")  # noqa: E731
    return [F.sum("n").alias("n"), *[wide(f"n * z{i}", f"s{i}") for i in range(_P)], *[wide(f"n * z{i} * z{j}", f"q{i}{j}") for i, j in _TRIANGLE]]


def _moments(sums: DataFrame, factor: float) -> DataFrame:
    """Centre and covariance times factor, plus the least deviations, from sums."""
    mean = [f"CAST(s{i} AS DOUBLE) / CAST(n AS DOUBLE) AS m{i}" for i in range(_P)]
    least = lambda i, j: float(_GRID * _GRID) if i == j else 0.0  # noqa: E731
    cov = [f"{factor!r}D * (CAST(q{i}{j} AS DOUBLE) / CAST(n AS DOUBLE) - m{i} * m{j}) + {least(i, j)!r}D AS c{i}{j}" for i, j in _TRIANGLE]
    return sums.selectExpr("*", *mean, *cov).drop(*[f"s{i}" for i in range(_P)], *[f"q{i}{j}" for i, j in _TRIANGLE])


def _medians(counts: DataFrame, of: str) -> DataFrame:
    """counts (g, dim, v, n, ..) with `of`: the lower weighted median of v in its group and dimension."""
    upto = Window.partitionBy("g", "dim").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("g", "dim")
    counts = counts.withColumns({"below": F.sum("n").over(upto), "all": F.sum("n").over(whole)})
    return counts.withColumn(of, F.min(F.when(F.col("below") * 2 >= F.col("all"), F.col("v"))).over(whole)).drop("below", "all")


def _first(cells: DataFrame) -> DataFrame:
    """The two starts of each group: median with 1.4826 median deviations on the diagonal, and mean with covariance.

    Both medians are taken from the counts of a group's distinct whole values, so cells are read once for them.
    """
    tall = cells.select("g", "n", F.posexplode(F.array(*[f"z{i}" for i in range(_P)])).alias("dim", "v"))
    middle = _medians(tall.groupBy("g", "dim", "v").agg(F.sum("n").alias("n")), "middle")
    both = _medians(middle.groupBy("g", "dim", "middle", F.abs(F.col("v") - F.col("middle")).alias("v")).agg(F.sum("n").alias("n")), "spread").groupBy("g")
    one = lambda name, i: F.max(F.when(F.col("dim") == i, F.col(name))).cast("double")  # noqa: E731
    robust = both.agg(*[one("middle", i).alias(f"m{i}") for i in range(_P)], *[one("spread", i).alias(f"d{i}") for i in range(_P)])
    scale = lambda i: F.lit(1.4826) * F.col(f"d{i}")  # noqa: E731
    robust = robust.withColumns({f"c{i}{j}": scale(i) * scale(i) + F.lit(float(_GRID * _GRID)) if i == j else F.lit(0.0) for i, j in _TRIANGLE})
    plain = _moments(cells.groupBy("g").agg(*_sums()), 1.0)
    columns = ["g", *[f"m{i}" for i in range(_P)], *[f"c{i}{j}" for i, j in _TRIANGLE]]
    return robust.select(F.lit(_STARTS[0]).alias("start"), *columns).unionByName(plain.select(F.lit(_STARTS[1]).alias("start"), *columns))


def estimates(cells: DataFrame, scratch: Scratch, prior: float, steps: int) -> DataFrame:
    """(g, rows, m0 .., l00 ..) for each group g of cells (g, z0 .. z4, n); g = '' is the whole corpus, `rows` the sum of n.

    A step shuffles at most 4096 rows of sums for each group, start and task; cells stay where they are. It is one query
    with one join of cells: estimates are saved with their factors and sizes, as the driver holds what it plans and broadcasts.
    """
    sizes = scratch.save(cells.groupBy("g").agg(F.count("*").alias("cells"), F.sum("n").alias("rows")), "sizes")
    met = joins_hot(cells, sizes, ["g"], "cells", scratch, "cells")
    now = scratch.save(_factored(_first(cells)).join(sizes, "g"), "step-0")
    half = F.floor((F.col("rows") + _P + 1) / 2).cast("long")
    kept = [F.first(c).alias(c) for c in ("cells", "rows")]
    upto = Window.partitionBy("g", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = ["n", *[f"s{i}" for i in range(_P)], *[f"q{i}{j}" for i, j in _TRIANGLE]]
    for k in range(1, steps + 1):
        near = _distanced(met(now)).withColumn("bin", F.least(F.lit(_BINS), F.floor(F.lit(256.0) * F.sqrt("d2"))).cast("int"))
        binned = near.groupBy("g", "start", "bin").agg(*kept, *_sums())
        taken = binned.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).where(F.col("before") < half)
        added = taken.groupBy("g", "start").agg(*kept, *[F.sum(c).alias(c) for c in sums])
        now = scratch.save(_factored(_moments(added, _HALF).drop("n")), f"step-{k}")
    best = Window.partitionBy("g").orderBy("logdet", "start")
    raw = now.withColumn("place", F.row_number().over(best)).where(F.col("place") == 1).withColumn("n", half)
    raw = scratch.save(_factored(_drawn(raw, prior)), "raw")
    usual = _distanced(met(raw.drop("n"))).where(F.col("d2") <= F.lit(_NEAR)).groupBy("g").agg(*kept, *_sums())
    final = scratch.save(_moments(usual, _MOST), "usual")
    lone = raw.join(final, "g", "left_anti").withColumn("n", F.lit(0).cast("long"))  # no document in the usual range: the half stays
    final = _factored(_drawn(final.unionByName(lone.select(final.columns)), prior))
    return scratch.save(final.drop("cells", "n", "start", "logdet", *[f"c{i}{j}" for i, j in _TRIANGLE]), "final")


def _drawn(params: DataFrame, prior: float) -> DataFrame:
    """params (g, cells, rows, n, m, c) drawn towards the row of g = '' as if that had contributed `prior` documents."""
    names = {f"m{i}": f"w{i}" for i in range(_P)} | {f"c{i}{j}": f"v{i}{j}" for i, j in _TRIANGLE}
    whole = F.broadcast(params.where("g = ''").selectExpr(*[f"{own} AS {all_}" for own, all_ in names.items()]))  # one row
    own, all_ = "CAST(n AS DOUBLE)", f"{float(prior)!r}D"
    mixed = [f"({own} * {c} + {all_} * {w}) / ({own} + {all_}) AS {c}" for c, w in names.items()]
    return params.join(whole).selectExpr("g", "cells", "rows", "'drawn' AS start", "n", *mixed)


def screen_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source"),
    least_words: int = 50, most_repeats: int = 50, beyond: float = 1e-6, prior: float = _PRIOR, steps: int = _STEPS, carry: tuple[str, ...] = (),
) -> DataFrame:  # fmt: skip
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept, and c0, c1 .. for carry).

    Base rules: at least `least_words` words, at most `most_repeats` percent of them in repeated windows of three. The
    others are rejected if their squared distance is beyond what a share of `beyond` of normal data exceeds.

    Texts are read once and described row by row. Descriptions are counted per task before they are shuffled, and the
    estimates of a group reach its documents by `join_hot`, so a group of any size spreads over tasks.

    Defined cases: null and empty texts have no words and fail the base rules; a text of any length is one row; a null
    language or source is a value of its own; repeated rows count as often as they stand; documents that fail the base
    rules have no distance and no part in the estimates; ties of distance are taken together; an empty table gives an
    empty one; columns that are not named are ignored.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    g = F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(f"k{i}") for i, c in enumerate(group_cols)]))
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), g.alias("g"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)])
    stats = base_statistics(named, "text").drop("text").withColumn("base_failed", base_failed(least_words, most_repeats))
    stats = scratch.save(stats.withColumns({k: F.when(~F.col("base_failed"), v) for k, v in described().items()}), "statistics")
    good = stats.where(~F.col("base_failed"))
    zs = [f"z{i}" for i in range(_P)]
    cells = scratch.save(good.groupBy("g", *zs).agg(F.count("*").alias("n")), "own")
    cells = scratch.save(cells.unionByName(cells.groupBy(*zs).agg(F.sum("n").alias("n")).withColumn("g", F.lit(""))), "cells")
    found = estimates(cells, scratch, prior, steps).where("g <> ''")
    judged = _distanced(join_hot(good, found, ["g"], "rows"))
    shape = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    more = [f"c{i}" for i in range(len(carry))]
    most = chi2_quantile(1 - beyond, _P)
    passed = judged.select(*shape, F.sqrt("d2").alias("distance"), (F.col("d2") <= F.lit(most)).alias("kept"), *more)
    return passed.unionByName(stats.where("base_failed").select(*shape, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"), *more))


def op12_quality(spark, sf_dir: str) -> DataFrame:
    return screen_quality(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id").drop("distance")


def _oracle() -> str:
    """The same estimates over documents instead of cells; the sums of the steps are spelled out by rule."""
    r, tri = range(_P), _TRIANGLE
    units = [_GRID / LEAST[n] for n in _NAMES]
    forms = ["ln(n_words)", "ln(word_chars / n_words::DOUBLE)", "ln(1 + 100::DOUBLE * n_symbols / word_chars)", "sqrt(n_dup_lines / n_lines::DOUBLE)", "sqrt(n_repeat_words / n_words::DOUBLE)"]
    z = ", ".join(f"floor(({f}) * {u!r}::DOUBLE + 0.5::DOUBLE)::BIGINT AS z{i}" for i, (f, u) in enumerate(zip(forms, units)))
    sums = ", ".join(["count(*) AS n", *[f"sum(z{i}) AS s{i}" for i in r], *[f"sum(z{i} * z{j}) AS q{i}{j}" for i, j in tri]])
    added = ", ".join(["sum(n) AS n", *[f"sum(s{i}) AS s{i}" for i in r], *[f"sum(q{i}{j}) AS q{i}{j}" for i, j in tri]])
    ml = ", ".join([*[f"m{i}" for i in r], *[f"l{i}{j}" for i, j in tri]])
    mc = ", ".join([*[f"m{i}" for i in r], *[f"c{i}{j}" for i, j in tri]])

    def moments(factor: float) -> str:
        cov = [f"{factor!r}::DOUBLE * (q{i}{j}::DOUBLE / n::DOUBLE - m{i} * m{j}) + {float(_GRID**2 if i == j else 0)!r}::DOUBLE AS c{i}{j}" for i, j in tri]
        return ", ".join([*[f"s{i}::DOUBLE / n::DOUBLE AS m{i}" for i in r], *cov])

    less = lambda head, a, b, k: head + "".join(f" - {a}{x} * {b}{x}" for x in range(k))  # noqa: E731
    factor = ", ".join(f"sqrt({less(f'c{i}{i}', f'l{i}', f'l{i}', i)}) AS l{i}{i}" if i == j else f"({less(f'c{i}{j}', f'l{i}', f'l{j}', j)}) / l{j}{j} AS l{i}{j}" for i, j in tri)
    away = ", ".join(f"(z{i} - m{i}{''.join(f' - l{i}{k} * y{k}' for k in range(i))}) / l{i}{i} AS y{i}" for i in r)
    d2 = f"{away}, {' + '.join(f'y{i} * y{i}' for i in r)} AS d2"
    logdet = " + ".join(f"ln(l{i}{i})" for i in r)
    mix = lambda c, w: f"(n::DOUBLE * {c} + {_PRIOR!r}::DOUBLE * {w}) / (n::DOUBLE + {_PRIOR!r}::DOUBLE) AS {c}"  # noqa: E731
    whole = ", ".join([*[f"m{i} AS w{i}" for i in r], *[f"c{i}{j} AS v{i}{j}" for i, j in tri]])
    mixed = ", ".join([*[mix(f"m{i}", f"w{i}") for i in r], *[mix(f"c{i}{j}", f"v{i}{j}") for i, j in tri]])
    drawn = lambda of: f"SELECT g, n, {mixed} FROM {of} CROSS JOIN (SELECT {whole} FROM {of} WHERE g = '')"  # noqa: E731
    least = f"{float(_GRID**2)!r}::DOUBLE"
    spread = ", ".join(["1 AS n", *[f"m{i}" for i in r], *[(f"1.4826::DOUBLE * d{i} * (1.4826::DOUBLE * d{i}) + {least} AS c{i}{i}" if i == j else f"0.0::DOUBLE AS c{i}{j}") for i, j in tri]])
    steps = "".join(f"""
f{k} AS MATERIALIZED (SELECT g, start, {ml} FROM (SELECT *, {factor} FROM p{k})),
b{k} AS MATERIALIZED (SELECT g, start, bin, any_value(half) AS half, {sums} FROM (
  SELECT *, {d2}, least({_BINS}, floor(256::DOUBLE * sqrt(d2)))::INT AS bin FROM both_ JOIN sizes USING (g) JOIN f{k} USING (g)) GROUP BY g, start, bin),
p{k + 1} AS MATERIALIZED (SELECT g, start, {moments(_HALF)} FROM (
  SELECT g, start, {added} FROM (
    SELECT *, coalesce(sum(n) OVER (PARTITION BY g, start ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b{k})
  WHERE before < half GROUP BY g, start)),""" for k in range(_STEPS))
    return rf"""
WITH texts AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	-]')) AS lines FROM documents),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS many FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM texts)),
repeats AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM windows, range(3) t(o) WHERE many > 1 GROUP BY doc_id),
base AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, (len(text) - len(translate(text, '{_SYMBOLS}', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
         n_words < 50 OR 100 * coalesce(repeats.n_repeat_words, 0) > 50 * n_words AS base_failed
  FROM texts LEFT JOIN repeats USING (doc_id)),
good AS MATERIALIZED (
  SELECT doc_id, coalesce('+' || lang, '-') || chr(31) || coalesce('+' || source, '-') AS g, {z} FROM base WHERE NOT base_failed),
both_ AS MATERIALIZED (FROM good UNION ALL SELECT * REPLACE ('' AS g) FROM good),
sizes AS MATERIALIZED (SELECT g, (count(*) + {_P + 1}) // 2 AS half FROM both_ GROUP BY g),
middles AS MATERIALIZED (SELECT g, {", ".join(f"quantile_disc(z{i}, 0.5)::DOUBLE AS m{i}" for i in r)} FROM both_ GROUP BY g),
spreads AS (SELECT g, {", ".join(f"any_value(m{i}) AS m{i}, quantile_disc(abs(z{i} - m{i}), 0.5)::DOUBLE AS d{i}" for i in r)} FROM both_ JOIN middles USING (g) GROUP BY g),
p0 AS MATERIALIZED (
  SELECT g, 'median' AS start, {mc} FROM (SELECT g, {spread} FROM spreads)
  UNION ALL SELECT g, 'mean' AS start, {moments(1.0)} FROM (SELECT g, {sums} FROM both_ GROUP BY g)),{steps}
ends AS (
  SELECT g, half AS n, {mc} FROM (SELECT *, {factor}, {logdet} AS logdet FROM p{_STEPS}) JOIN sizes USING (g) QUALIFY row_number() OVER (PARTITION BY g ORDER BY logdet, start) = 1),
raw AS MATERIALIZED ({drawn("ends")}),
usual AS MATERIALIZED (
  SELECT g, n, {moments(_MOST)} FROM (
    SELECT g, {sums} FROM (SELECT *, {d2} FROM both_ JOIN (SELECT g, {ml} FROM (SELECT *, {factor} FROM raw)) USING (g)) WHERE d2 <= {_NEAR!r}::DOUBLE GROUP BY g)),
final AS MATERIALIZED (FROM usual UNION ALL SELECT g, 0 AS n, {mc} FROM raw ANTI JOIN usual USING (g)),
last AS ({drawn("final")}),
judged AS (SELECT doc_id, {d2} FROM good JOIN (SELECT g, {ml} FROM (SELECT *, {factor} FROM last)) USING (g))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(d2 <= {chi2_quantile(1 - 1e-6, _P)!r}::DOUBLE, false) AS kept
FROM base LEFT JOIN judged USING (doc_id)"""


ORACLE = {"op12_quality": _oracle()}
