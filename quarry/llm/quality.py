"""Quality rules and robust multivariate outliers (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.shared import BROADCAST_ROWS, cut, cut_table, free_names, id_key, own_columns, table, text_key, without

GAP = r"[\x20\x09-\x0D]+"
#: Words of a window that counts as a repeat when the text has it twice; a power of two.
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PCT = 20, 30
#: Share of a group's documents that the covariance estimate keeps.
CORE = 0.75
#: Rounds of concentration from every start, and at most so many more from the best; they end when no log-determinant changes by SETTLED.
SHORT, ROUNDS, SETTLED = 2, 20, 1e-3
#: Stands between a group's name and the number of the start.
START = "\x02"
#: Groups with fewer documents are held against the estimate of their whole language, or else of the whole table.
MIN_GROUP = 100
#: Names of the transformed statistics with the least variance of each, so that a statistic that is constant within the core neither divides by zero nor makes a small change an outlier.
STATS = {"s_length": 0.25, "s_word": 0.09, "s_symbol": 0.25, "s_dup": 0.25, "s_repeat": 0.0225}
#: What the operator adds.
RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept"]
#: Consistency factor of a core of three quarters, CORE / P(chi-squared with 7 degrees of freedom <= 6.626, the CORE quantile with 5), and the 0.9999 quantile with five degrees of freedom.
CONSISTENT, CHI2_REJECT = 1.412, 25.745


def repeat_words(hashes: str) -> Column:
    """Words covered by windows whose hash occurs twice in the array column *hashes*."""
    return F.expr(f"""
      CASE WHEN size({hashes}) = size(array_distinct({hashes})) THEN 0 ELSE
        aggregate(transform(array(array_sort(transform({hashes}, (h, i) -> struct(h AS h, i AS i)))), s ->
          aggregate(transform(array(array_sort(transform(
            filter(transform(s, (x, j) -> struct(x.i AS i, coalesce(get(s, j - 1).h = x.h, false) OR coalesce(get(s, j + 1).h = x.h, false) AS twice)), x -> x.twice), x -> x.i))),
            p -> aggregate(transform(p, (x, j) -> least({WINDOW}, coalesce(get(p, j + 1) - x, {WINDOW}))), 0, (a, b) -> a + b)), 0, (a, b) -> a + b)), 0, (a, b) -> a + b)
      END""").cast("long")


def base_statistics(docs: DataFrame) -> DataFrame:
    """*docs* with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    d = docs.withColumn("_t", F.coalesce("text", F.lit(""))).withColumn("_w", F.array_remove(F.split("_t", GAP), ""))
    d = d.withColumn("_hw", F.transform("_w", lambda x: F.xxhash64(x)))
    # hashes of 2, 4 and 8 words from the halves: each pass hashes two numbers a position
    for i in (1, 2, 4):
        d = d.withColumn("_hw", F.expr(f"CASE WHEN size(_hw) <= {i} THEN array() ELSE slice(zip_with(_hw, slice(_hw, {i + 1}, size(_hw)), (a, b) -> xxhash64(a, b)), 1, size(_hw) - {i}) END"))
    d = d.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = (
        d.withColumn("n_words", F.size("_w").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
        .withColumn("n_symbols", (F.length("_t") - F.length(F.regexp_replace("_t", r"[#*$%&|<>]", ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
        .withColumn("n_lines", F.size("_l").cast("long"))
        .withColumn("n_repeat_words", repeat_words("_hw"))
    )
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))
    return d.drop("_t", "_w", "_hw", "_l")


def transformed(d: DataFrame) -> DataFrame:
    """Adds the statistic vector; every entry is finite."""
    chars, words, lines = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return (
        d.withColumn("s_length", F.log1p(F.col("n_words").cast("double")))
        .withColumn("s_word", F.log(chars / words) * 2)
        .withColumn("s_symbol", F.log1p(F.col("n_symbols") * 200 / chars))
        .withColumn("s_dup", F.log1p(F.col("n_dup_lines") * 10 / lines))
        .withColumn("s_repeat", F.sqrt(F.col("n_repeat_words") / words))
    )


def group_names(d: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """_lang, _source and _g: language and source, the language alone, or all, whichever has *min_group* usable documents."""
    lang, source = F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    counted = d.filter("usable").groupBy(lang.alias("_lang"), source.alias("_source")).agg(F.count("*").alias("n"))
    languages = counted.groupBy("_lang").agg(F.sum("n").alias("of_lang"))
    own, language, everything = levels()
    label = F.when(F.col("n") >= min_group, own).when(F.col("of_lang") >= min_group, language).otherwise(everything)
    return counted.join(languages, "_lang").select("_lang", "_source", label.alias("_g"))


def levels() -> list[Column]:
    """Names of the groups that a language and source can be held against, the smallest first."""
    return [F.concat_ws("\x01", F.lit("s"), "_lang", "_source"), F.concat_ws("\x01", F.lit("l"), "_lang"), F.lit("all")]


def members(names: DataFrame) -> DataFrame:
    """_lang, _source and _g for every group in use that a language and source is part of, so that a fallback is fitted on all of its language or table, not on the small groups alone."""
    return names.select("_lang", "_source", F.explode(F.array(*levels())).alias("_g")).join(small(names.select("_g").distinct()), "_g", "left_semi")


def grouped(d: DataFrame, names: DataFrame) -> DataFrame:
    """Adds _g; a language and source without usable documents is in the group of all."""
    lang, source = F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    return d.withColumn("_lang", lang).withColumn("_source", source).join(small(names), ["_lang", "_source"], "left").withColumn("_g", F.coalesce("_g", F.lit("all"))).drop("_lang", "_source")


def small(df: DataFrame) -> DataFrame:
    """A table of groups, broadcast where its counted rows allow."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def covariance(moments: DataFrame) -> DataFrame:
    """Mean m_i and covariance k_i_j (lower triangle) from the sums n, s_i and p_i_j of each group: the core's, made consistent."""
    k = len(STATS)
    m = moments.withColumns({f"m_{i}": F.col(f"s_{i}") / F.col("n") for i in range(k)})
    cov = {}
    for i, floor in enumerate(STATS.values()):
        for j in range(i + 1):
            c = (F.col(f"p_{i}_{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}")) * CONSISTENT
            cov[f"k_{i}_{j}"] = F.greatest(c, F.lit(0.0)) + floor if i == j else c
    return m.withColumns(cov)


def cholesky(m: DataFrame) -> DataFrame:
    """m_i, l_i_j (the lower triangle of the Cholesky factor) and logdet from m_i and k_i_j."""
    k, floors = len(STATS), list(STATS.values())
    for i in range(k):
        for j in range(i + 1):
            c = F.col(f"k_{i}_{j}")
            for q in range(j):
                c = c - F.col(f"l_{i}_{q}") * F.col(f"l_{j}_{q}")
            m = m.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(c, F.lit(floors[i] / 100))) if i == j else c / F.col(f"l_{j}_{j}"))
    logdet = sum((2 * F.log(f"l_{i}_{i}") for i in range(1, k)), 2 * F.log("l_0_0"))
    return m.select("_g", *[f"m_{i}" for i in range(k)], *[f"l_{i}_{j}" for i in range(k) for j in range(i + 1)], logdet.alias("logdet"))


def distance(d: DataFrame, factors: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution in the Cholesky factor."""
    d = d.join(factors, "_g", "left")
    z: list[Column] = []
    for i, s in enumerate(STATS):
        c = F.col(s) - F.col(f"m_{i}")
        for q in range(i):
            c = c - F.col(f"l_{i}_{q}") * F.col(f"_z{q}")
        d = d.withColumn(f"_z{i}", c / F.col(f"l_{i}_{i}"))
        z.append(F.col(f"_z{i}") * F.col(f"_z{i}"))
    total = z[0]
    for x in z[1:]:
        total = total + x
    return d.withColumn("d2", total).drop(*[f"_z{i}" for i in range(len(STATS))], *[c for c in factors.columns if c != "_g"])


def moments(d: DataFrame) -> DataFrame:
    names = list(STATS)
    sums = [F.sum(F.col(x)).alias(f"s_{i}") for i, x in enumerate(names)]
    products = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p_{i}_{j}") for i in range(len(names)) for j in range(i + 1)]
    return d.groupBy("_g").agg(F.count("*").alias("n"), *sums, *products)


def core_of(d: DataFrame, per_group: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows whose d2 is within the CORE quantile of their group."""
    limits = d.groupBy("_g").agg(F.percentile_approx("d2", CORE, 10_000).alias("_limit"))
    return d.join(per_group(limits), "_g").filter("d2 <= _limit").drop("_limit")


def quality_rules(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """*docs* with the base statistics, base_failed, distance and kept.

    Base: fewer than 20 words, or over 30 % of the words in eight-word windows that the text has
    twice. The others of a language and source get a minimum-covariance-determinant estimate: from four robust
    starts (medians and absolute deviations alone, and with the correlations of hyperbolic tangents, of spatial
    signs and of clipped values), rounds of concentration keep the three quarters of smallest Mahalanobis distance and estimate mean and
    covariance anew; the start of the smallest determinant goes on until it settles. The core's covariance is multiplied by
    its consistency factor, so that distances of normal data are chi-squared; beyond the 0.9999 quantile
    a document is rejected. Only sums and quantile sketches of each group are shuffled, so a group that holds a
    third of the rows is combined before the shuffle; the factor table has one row per group and start.

    Null texts have no words and fail; null languages and sources are the empty string. Groups of fewer than *min_group*
    are held against the estimate of all usable documents of their language, or of the table. Each row stays once, repeats too; columns named
    as a result (RESULT) are replaced, all others stay; an empty table gives an empty result.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in RESULT])
    (row,) = free_names(docs, "_row")
    keyed = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias(row))  # so that no column meets one of ours
    own = own_columns(docs, "text", "lang", "source")
    have = {c.lower(): c for c in docs.columns}
    keyed = keyed.select(row, *[(F.col(f"{row}.`{have[c]}`") if c in have else F.lit(None).cast("string")).alias(c) for c in own.columns])
    d = cut_table(transformed(base_statistics(keyed)).withColumn("usable", ~F.col("base_failed")).drop("text"))
    names, factors = estimate(d.select("lang", "source", "usable", *STATS), min_group)
    return verdict(grouped(d, names), factors).select(*[F.col(f"{row}.`{c}`").alias(c) for c in docs.columns], *RESULT)


def estimate(d: DataFrame, min_group: int = MIN_GROUP) -> tuple[DataFrame, DataFrame]:
    """Group names and the Cholesky factors of smallest determinant, from the statistics alone."""
    names = cut(group_names(d, min_group))
    # tables of one row a group and start have few more rows than names: counted once, then broadcast, so that a hot group stays where its rows are
    per_group: Callable[[DataFrame], DataFrame] = F.broadcast if names.count() <= BROADCAST_ROWS else lambda x: x
    usable = grouped(d.filter("usable"), cut(members(names))).select("_g", *STATS)
    factors = cut(cholesky(starts(usable, per_group)))
    each = usable.withColumn("_g", F.explode(F.array(*[F.concat("_g", F.lit(f"{START}{i}")) for i in range(N_STARTS)])))
    for _ in range(SHORT):
        factors = concentrated(each, factors, per_group)
    group = F.substring_index("_g", START, 1)
    best = factors.groupBy(group.alias("name")).agg(F.min(F.struct("logdet", "_g")).alias("best")).select(F.col("best._g").alias("_g"))
    factors = cut(factors.join(per_group(best), "_g", "left_semi").withColumn("_g", group))
    for _ in range(ROUNDS):
        last, factors = factors, concentrated(usable, factors, per_group)
        before = last.select("_g", F.col("logdet").alias("before"))
        if not factors.join(before, "_g").filter(F.abs(F.col("logdet") - F.col("before")) >= SETTLED).take(1):
            break
    return names, factors


def concentrated(d: DataFrame, factors: DataFrame, per_group: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One round: the factors of each group's core under the present factors."""
    return cut(cholesky(covariance(moments(core_of(distance(d, per_group(factors.drop("logdet"))), per_group)))))


#: Kinds of starts: none, hyperbolic tangents, spatial signs, values cut off at CLIP deviations.
N_STARTS, CLIP = 4, 1.5


def starts(usable: DataFrame, per_group: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Median m_i and a robust covariance k_i_j of each group from each start; _g holds the group and the start's number."""
    k, floors = len(STATS), list(STATS.values())
    centre = usable.groupBy("_g").agg(*[F.percentile_approx(s, 0.5, 10_000).alias(f"m_{i}") for i, s in enumerate(STATS)])
    away = [F.abs(F.col(s) - F.col(f"m_{i}")) for i, s in enumerate(STATS)]
    spread = usable.join(per_group(centre), "_g").groupBy("_g").agg(*[F.first(f"m_{i}").alias(f"m_{i}") for i in range(k)], *[F.percentile_approx(x, 0.5, 10_000).alias(f"v_{i}") for i, x in enumerate(away)])
    spread = cut(spread.select("_g", *[f"m_{i}" for i in range(k)], *[F.sqrt(F.pow(1.4826 * F.col(f"v_{i}"), 2) + floors[i]).alias(f"d_{i}") for i in range(k)]))
    z = usable.join(per_group(spread), "_g").withColumns({f"z_{i}": (F.col(s) - F.col(f"m_{i}")) / F.col(f"d_{i}") for i, s in enumerate(STATS)})
    size = F.sqrt(sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(1, k)), F.col("z_0") * F.col("z_0")))
    z = z.withColumn("size", F.greatest(size, F.lit(1e-9))).withColumns({f"t_{i}": F.tanh(f"z_{i}") for i in range(k)} | {f"u_{i}": F.col(f"z_{i}") / F.col("size") for i in range(k)} | {f"w_{i}": F.greatest(F.least(F.col(f"z_{i}"), F.lit(CLIP)), F.lit(-CLIP)) for i in range(k)})
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    sums = z.groupBy("_g").agg(*[F.avg(F.col(f"{x}_{i}") * F.col(f"{x}_{j}")).alias(f"{x}_{i}_{j}") for x in "tuw" for i, j in pairs]).join(per_group(spread), "_g")

    def entry(x: str, i: int, j: int) -> Column:
        if i == j:
            return F.pow(f"d_{i}", F.lit(2.0))
        if not x:
            return F.lit(0.0)
        return F.coalesce(F.col(f"{x}_{i}_{j}") / F.nullif(F.sqrt(F.col(f"{x}_{i}_{i}") * F.col(f"{x}_{j}_{j}")), F.lit(0.0)), F.lit(0.0)) * F.col(f"d_{i}") * F.col(f"d_{j}")

    rows = [F.struct(F.concat("_g", F.lit(f"{START}{n}")).alias("_g"), *[F.col(f"m_{i}") for i in range(k)], *[entry(x, i, j).alias(f"k_{i}_{j}") for i, j in pairs]) for n, x in enumerate(["", "t", "u", "w"])]
    return sums.select(F.inline(F.array(*rows)))


def verdict(d: DataFrame, factors: DataFrame) -> DataFrame:
    """Adds distance and kept to rows that have _g, usable and the statistics."""
    out = distance(d, small(factors.drop("logdet"))).withColumn("distance", F.sqrt("d2"))
    return out.withColumn("kept", F.col("usable") & F.coalesce(F.col("d2") <= CHI2_REJECT, F.lit(True)))


def good_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns.

    The texts are read once for the statistics. The verdict comes from the small table of these, and the
    rejected rows leave by an anti-join on id and text hash: a filter on the verdict would be pushed
    into the expressions over the text and repeat them many times.
    """
    d = own_columns(docs, "doc_id", "text", "lang", "source").withColumn("_id", id_key("doc_id").cast("long")).withColumn("_k", text_key("text"))
    d = transformed(base_statistics(d)).withColumn("usable", ~F.col("base_failed")).select("_id", "_k", "lang", "source", "usable", *STATS)
    d = cut(d)
    names, factors = estimate(d)
    bad = cut(verdict(grouped(d, names), factors).filter("not kept").select("_id", "_k", F.coalesce("lang", F.lit("")).alias("_lang"), F.coalesce("source", F.lit("")).alias("_source")).distinct())
    return without(docs, bad, "_id", "_k", "_lang", "_source")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = own_columns(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source")
    d = cut(transformed(base_statistics(docs)).withColumn("usable", ~F.col("base_failed")).drop("text"))  # so that the texts are read once
    names, factors = estimate(d.select("lang", "source", "usable", *STATS))
    return verdict(grouped(d, names), factors).select("doc_id", *RESULT)
