"""Rule statistics of texts and robust multivariate outliers, with DataFrame operations only.

Base statistics: words are runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage
return. n_words, word_chars (code points in words), n_symbols (of ``#*$%&|<>``), n_lines (with a word), n_dup_lines (lines with a word that
equal an earlier one) and n_repeat_words (words in 3-word windows that the text holds twice or more, by 64-bit hashes of
the windows; the windows of one text are at most some ten thousand, so that a wrong match is out of the question).

Texts that pass the base rules are judged by transformed statistics against the minimum-covariance-determinant estimate
of their language and source: from a coordinate-wise robust start, concentration steps refit mean and covariance to the
``core`` share of smallest Mahalanobis distance. Which rows those are follows from counts per distance bin, so that
a step is one mergeable aggregate and the order of rows does not matter. The last covariance is scaled so that the median
distance is that of the normal distribution, and texts beyond the ``cut`` distance are rejected. Groups of fewer than
``min_rows`` rows are judged by their language's estimate, and where that is as small by that of all rows.

Null and empty texts have no words and fail the base rules. Null languages and sources count as values of their own.
Repeated rows are judged alike. Columns other than doc_id, text, lang and source do not take part.
"""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

STATS = ["word_length", "symbols", "dup_lines", "repeats"]
#: Medians of the chi-square distribution with 1 to 6 degrees of freedom.
CHI2_MEDIAN = [0.454936, 1.386294, 2.365974, 3.356694, 4.351460, 5.348121]
#: Quantiles of 0.999 of the same distributions.
CHI2_FAR = [10.827566, 13.815511, 16.266236, 18.466827, 20.515006, 22.457744]
#: Least spread of each transformed statistic, added to its spread: shares of repeats or symbols are zero in most texts,
#: and a first small one is no sign of a bad text. With the cut of four statistics each of them rejects alone well within its
#: range: from 0.42 of the lines (of 1) and from 0.27 of the words in repeats (of 0.5, where the base rules end).
FLOORS = [0.05, 0.07, 0.15, 0.12]


def base_statistics(df, *others):
    """The base statistics beside ``others``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    d = df.select(*others, text.alias("t"), words.alias("w"), F.split(text, "\n").alias("l"))
    # every element of a split by white space that is not empty is a word; a window starts at each word but the last two
    starts = F.when(F.size("w") >= 3, F.sequence(F.lit(1), F.size("w") - 2)).otherwise(F.array().cast("array<int>"))
    lines = F.filter("l", lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    d = d.select(*others, F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
                 (F.length("t") - F.length(F.regexp_replace("t", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
                 lines.alias("l"), F.transform(starts, lambda i: F.xxhash64(F.get("w", i - 1), F.get("w", i), F.get("w", i + 1))).alias("h"))
    # windows that another one equals, by place: sorted by hash they stand side by side
    pairs = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.select(*others, "n_words", "word_chars", "n_symbols", F.size("l").cast("long").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
                 F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs).alias("p"))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    twice = F.filter("p", lambda x, i: same(x, F.get("p", i - 1)) | same(x, F.get("p", i + 1)))
    d = d.select(*others, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("p"))
    # a window covers three words, but for those that the next one covers, too
    covered = F.aggregate(F.transform("p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("p", i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return d.select(*others, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def transformed():
    """Transformed statistics: logarithm of the mean word length, square roots of the shares of symbols in words, of repeated
    lines in lines and of repeated words in words."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n).alias("word_length"), F.sqrt(F.col("n_symbols") / n).alias("symbols"),
            F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_lines"), F.sqrt(F.col("n_repeat_words") / n).alias("repeats")]


def _with_factor(d, floors):
    """Adds the Cholesky factor l00, l10, l11, ... of the covariance c00, c10, c11, ... with the floors on its diagonal;
    one column at a time, since each needs those before."""
    for i in range(len(floors)):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            least = F.lit(floors[i] ** 2)
            d = d.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest + least, least)) if i == j else rest / F.col(f"l{j}{j}"))
    return d


def _distance(stats):
    """Squared Mahalanobis distance, by forward substitution through the factor."""
    def through(d):
        for i, s in enumerate(stats):
            rest = F.col(s) - F.col(f"m{i}")
            for j in range(i):
                rest = rest - F.col(f"l{i}{j}") * F.col(f"z{j}")
            d = d.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
        d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(len(stats))), F.lit(0.0))
        return d.withColumn("d2", d2).drop(*(f"z{i}" for i in range(len(stats))))
    return through


BINS_A_DOUBLING = 16


def _bin():
    """Distances in bins of a sixteenth of a doubling, from below a millionth to above a million."""
    return F.least(F.greatest(F.floor(F.log2(F.col("d2") + F.lit(1e-12)) * BINS_A_DOUBLING), F.lit(-400)), F.lit(400)).cast("int")


def _quantile_bin(rows, share, name):
    """Per group, the lowest bin up to which ``share`` of the rows lie: counts per bin, then sums over at most 801 bins."""
    counts = rows.groupBy("grp", _bin().alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("grp").orderBy("bin")
    total = Window.partitionBy("grp")
    ranked = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(total))
    return ranked.where(F.col("upto") >= F.lit(share) * F.col("total")).groupBy("grp").agg(F.min("bin").alias(name))


def _moments(rows, stats):
    """Mean and covariance per group."""
    p = len(stats)
    aggs = [F.avg(s).alias(f"m{i}") for i, s in enumerate(stats)]
    aggs += [F.covar_pop(stats[i], stats[j]).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)]
    return rows.groupBy("grp").agg(*aggs)


def _start(rows, stats):
    """Coordinate-wise start: median and spread between the quartiles, from approximate quantiles; no covariance."""
    p = len(stats)
    q = rows.groupBy("grp").agg(*(F.percentile_approx(s, [0.25, 0.5, 0.75], 2000).alias(f"q{i}") for i, s in enumerate(stats)))
    cols = [F.col(f"q{i}")[1].alias(f"m{i}") for i in range(p)]
    spread = lambda i: (F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349
    cols += [(F.pow(spread(i), 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)]
    return q.select("grp", *cols)


def estimate(rows, stats=STATS, floors=FLOORS, core=0.75, steps=6):
    """Minimum-covariance-determinant estimates per ``grp`` of a written table: grp, mean m*, factor l*, scale."""
    p = len(stats)
    params = _with_factor(_start(rows, stats), floors)
    for _ in range(steps):
        params = materialize(params)  # a row a group; Spark broadcasts it where its size allows
        near = _distance(stats)(rows.join(params, "grp"))
        limit = materialize(_quantile_bin(near, core, "limit"))
        params = _with_factor(_moments(near.join(limit, "grp").where(_bin() <= F.col("limit")).select("grp", *stats), stats), floors)
    params = materialize(params)
    median = _quantile_bin(_distance(stats)(rows.join(params, "grp")), 0.5, "median")
    scale = F.greatest(F.pow(F.lit(2.0), (F.col("median") + 1) / BINS_A_DOUBLING) / CHI2_MEDIAN[p - 1], F.lit(1.0))
    return materialize(params.join(median, "grp").select("grp", *(f"m{i}" for i in range(p)), *(f"l{i}{j}" for i in range(p) for j in range(i + 1)), scale.alias("scale")))


def judge(df, core=0.75, steps=6, cut=CHI2_FAR[len(STATS) - 1], min_rows=200):
    """Per document: doc_id, the base statistics, base_failed, distance (robust, squared; null where the base rules fail)
    and kept. ``cut`` is the distance that one in a thousand texts is beyond if they are normal."""
    stats = base_statistics(df, "doc_id", F.coalesce("lang", F.lit("\x00")).alias("lang"), F.coalesce("source", F.lit("\x00")).alias("source"))
    table = materialize(stats.withColumn("base_failed", base_failed()).select("*", *transformed()))
    passed = table.where(~F.col("base_failed"))
    fine = passed.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    coarse = Window.partitionBy("lang")
    sized = fine.withColumn("n_lang", F.sum("n").over(coarse))  # a row a language and source
    name = F.when(F.col("n") >= min_rows, F.to_json(F.array("lang", "source"))).when(F.col("n_lang") >= min_rows, F.to_json(F.array("lang"))).otherwise("[]")
    groups = materialize(sized.select("lang", "source", name.alias("grp")))
    named = passed.join(groups, ["lang", "source"])
    # a language's estimate rests on all its rows, not on those of its small sources alone
    wanted = groups.select("grp").distinct()
    levels = F.array(F.to_json(F.array("lang", "source")), F.to_json(F.array("lang")), F.lit("[]"))
    spread = passed.select(F.explode(levels).alias("grp"), *STATS).join(wanted, "grp", "left_semi")
    params = estimate(materialize(spread), core=core, steps=steps)
    far = _distance(STATS)(named.join(params, "grp")).withColumn("distance", F.col("d2") / F.col("scale"))
    given = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    good = far.select(*given, "distance", (F.col("distance") <= cut).alias("kept"))
    bad = table.where("base_failed").select(*given, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return good.unionByName(bad)
