"""Profiles of raw sources, ground truth and pairs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinbridge.functions.hashing import md5_key
from kinbridge.functions.similarity import scorer
from kinbridge.operators.metrics import nearest_rank

# What a profile counts.
PUNCTUATION = r"[^\p{L}\p{N}_\p{Z}\s]"
DIGIT = r"\p{Nd}"
POSTCODE = r"(^|[^0-9])([0-9]{3}\s?[0-9]{3}|[0-9]{5}(-[0-9]{4})?)($|[^0-9])"
LANDMARK = r"\b(near|nr|opp|opposite|behind|beside)\b"
NAME_FORMS = (("pvt", "private"), ("ltd", "limited"), ("corp", "corporation"), ("inc", "incorporated"), ("co", "company"), ("&", "and"), ("intl", "international"), ("mfg", "manufacturing"))
ADDRESS_FORMS = (("rd", "road"), ("st", "street"), ("ave", "avenue"), ("blvd", "boulevard"), ("dr", "drive"), ("ln", "lane"), ("nr", "near"), ("opp", "opposite"), ("apt", "apartment"))
LEGAL_WORDS = ("pvt", "private", "ltd", "limited", "llc", "llp", "inc", "corp", "corporation", "co", "company", "plc", "sa", "sas", "sarl", "gmbh", "lp")
# End of fixed values.


def patterns(x: Column) -> dict[str, Column]:
    """Formatting flags of a text that is not blank; letters decide upper and lower."""
    return {
        "upper": (x == F.upper(x)) & (x != F.lower(x)), "lower": (x == F.lower(x)) & (x != F.upper(x)), "non_ascii": x.rlike(r"[^\x00-\x7F]"), "punctuation": x.rlike(PUNCTUATION), "digit": x.rlike(DIGIT),
        "postcode_like": x.rlike(POSTCODE), "landmark": F.lower(x).rlike(LANDMARK), "ampersand": F.contains(x, F.lit("&")),
    }


def pattern_shares(rows: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """The share of values that are not blank and match each pattern, to six places; a row for each value of ``by``."""
    kept = rows.where(F.trim(column) != "")
    grouped = kept.groupBy(by) if by else kept.groupBy()
    return grouped.agg(F.count("*").alias("n"), *[F.round(F.avg(p.cast("double")), 6).alias(n) for n, p in patterns(F.col(column)).items()])


def compatible_fold():
    """A UDF: lower case, compatibility decomposition without marks; the profile's own folding, wider than the normaliser's."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: "".join(c for c in unicodedata.normalize("NFKD", v.lower()) if not unicodedata.combining(c)) if isinstance(v, str) else None)

    return run


def fold(x: Column) -> Column:
    """Lower case without accents; only texts beyond ASCII go through Python."""
    return F.coalesce(compatible_fold()(F.when(x.rlike(r"[^\x00-\x7F]"), x)), F.lower(x))


def words_of(folded: Column) -> Column:
    """Runs of a-z and 0-9 and ampersands of a folded text."""
    return F.regexp_extract_all(folded, F.lit("([a-z0-9]+|&)"), F.lit(1))


def profile_tokens(x: Column) -> Column:
    return words_of(fold(x))


def legal_word_shares(rows: DataFrame, column: str, k: int = 12) -> DataFrame:
    """(word, share): the k legal words that most values hold, anywhere, and the share of values that do; ties by word."""
    held = F.array_intersect(profile_tokens(F.coalesce(F.col(column), F.lit(""))), F.array(*map(F.lit, LEGAL_WORDS)))
    total = rows.agg(F.count("*").alias("total"))
    counts = rows.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n")).crossJoin(total)  # total is one row
    return counts.select("word", F.round(F.col("n") / F.col("total"), 6).alias("share")).orderBy(F.desc("share"), "word").limit(k)


def describe(rows: DataFrame, value: Column) -> DataFrame:
    """min, p05, median, p95 and max by index, and the mean, of one figure."""
    v = rows.select(value.alias("v")).where("v is not null")
    return nearest_rank(v, "v", {"min": 0.0, "p05": 0.05, "median": 0.5, "p95": 0.95, "max": 1.0}).crossJoin(v.agg(F.round(F.avg("v"), 6).alias("mean")))  # one row each


def source_profile(rows: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """One row: rows, repeated ids, and for each column the missing and the mean length."""
    per = [x for c in columns for x in (F.sum(F.coalesce(F.trim(c) == "", F.lit(True)).cast("long")).alias(f"missing_{c}"), F.round(F.avg(F.length(c)), 6).alias(f"mean_length_{c}"))]
    # distinct ids are counted by a grouping, so no set of ids meets in one place
    ids = rows.groupBy(id_col).agg(F.count("*").alias("k")).agg(F.sum((F.col("k") > 1).cast("long")).alias("repeated_ids"), F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias("rows_with_repeated_ids"))
    return rows.agg(F.count("*").alias("n"), *per).crossJoin(ids)  # one row each


def value_counts(rows: DataFrame, column: Column, name: str) -> DataFrame:
    return rows.groupBy(column.alias(name)).agg(F.count("*").alias("n"))


def id_prefixes(rows: DataFrame, id_col: str) -> DataFrame:
    return value_counts(rows, F.regexp_extract(id_col, r"^([A-Za-z]+[0-9]*)", 1), "prefix")


def last_tokens(rows: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent last words (candidates for legal forms); ties by word."""
    last = F.regexp_extract(F.lower(F.trim(column)), r"([^\x20]+)$", 1)
    return value_counts(rows, last, "token").where("token <> ''").orderBy(F.desc("n"), "token").limit(k)


def match_distribution(truth: DataFrame, queries: DataFrame) -> DataFrame:
    """(matches, n, share): queries by number of matches, ten and more in one."""
    n = truth.groupBy("q").agg(F.count("*").alias("k"))
    per = queries.select("q").distinct().join(n, "q", "left").select(F.when(F.coalesce("k", F.lit(0)) >= 10, "10+").otherwise(F.coalesce("k", F.lit(0)).cast("string")).alias("matches"))
    total = per.agg(F.count("*").alias("total"))
    return per.groupBy("matches").agg(F.count("*").alias("n")).crossJoin(total).select("matches", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))  # total is one row


def shared_targets(truth: DataFrame) -> DataFrame:
    """(t, owners): targets that belong to two or more queries."""
    return truth.select("q", "t").distinct().groupBy("t").agg(F.count("*").alias("owners")).where("owners > 1")


def uncovered(truth: DataFrame, side: DataFrame, column: str) -> DataFrame:
    """Ids of the truth that a source does not hold."""
    return truth.select(column).distinct().join(side.select(column), column, "left_anti")


def source_mix(truth: DataFrame) -> DataFrame:
    """One row: pairs by target source and queries with targets in both; truth has q, t, target_source (2 or 3)."""
    per = truth.groupBy("q").agg(F.sum((F.col("target_source") == 2).cast("long")).alias("s2"), F.sum((F.col("target_source") == 3).cast("long")).alias("s3"))
    return per.agg(F.sum("s2").alias("pairs_s2"), F.sum("s3").alias("pairs_s3"), F.sum(((F.col("s2") > 0) & (F.col("s3") > 0)).cast("long")).alias("queries_both"))


def postcode(x: Column) -> Column:
    """The first five digits of the first postcode-like number, or null."""
    return F.nullif(F.substring(F.regexp_replace(F.regexp_extract(x, POSTCODE, 2), " ", ""), 1, 5), F.lit(""))


def pair_noise(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adds flags and scores of how two texts of a pair differ; token sets of two empty texts agree."""
    x, y, t, u = (F.col(c) for c in (a, b, "_kb_t", "_kb_u"))
    either, plain = F.size(F.array_union(t, u)), lambda v: F.array_join(v, " ")
    return pairs.withColumns({"_kb_t": profile_tokens(x), "_kb_u": profile_tokens(y)}).withColumns({
        "exact": x == y, "same_letters": F.lower(x) == F.lower(y), "same_squashed": plain(t) == plain(u), "same_tokens": F.array_sort(F.array_distinct(t)) == F.array_sort(F.array_distinct(u)),
        "case_only": (x != y) & (F.lower(x) == F.lower(y)), "punctuation_only": (plain(t) == plain(u)) & (F.lower(x) != F.lower(y)), "share_token": F.size(F.array_intersect(t, u)) > 0,
        "share_first": F.coalesce(F.try_element_at(t, F.lit(1)) == F.try_element_at(u, F.lit(1)), F.lit(False)), "postcode_both": postcode(x).isNotNull() & postcode(y).isNotNull(),
        "postcode_equal": F.coalesce(postcode(x) == postcode(y), F.lit(False)), "jaccard": F.when(either == 0, 1.0).otherwise(F.round(F.size(F.array_intersect(t, u)) / F.greatest(either, F.lit(1)), 6)),
        "gestalt": scorer("gestalt")(plain(t), plain(u)),
    }).drop("_kb_t", "_kb_u")


def summarize_pairs(pairs: DataFrame, flags: list[str], figures: list[str]) -> DataFrame:
    """One row: shares of flags; p10 and median by index, mean and share of 0.9 and more of figures."""
    out = [F.round(F.avg(F.col(c).cast("double")), 6).alias(f"{c}_share") for c in flags]
    for c in figures:
        out += [F.round(F.avg(c), 6).alias(f"{c}_mean"), F.round(F.avg((F.col(c) >= 0.9).cast("double")), 6).alias(f"{c}_high")]
    summary = pairs.agg(F.count("*").alias("n"), *out)
    for c in figures:
        summary = summary.crossJoin(nearest_rank(pairs, c, {f"{c}_p10": 0.1, f"{c}_median": 0.5}))  # one row each
    return summary


def abbreviation_usage(rows: DataFrame, column: str, forms: tuple[tuple[str, str], ...]) -> DataFrame:
    """(short, long, n_short, n_long): rows that use the short and the long form of each pair."""
    words = rows.select(F.explode(F.array_distinct(profile_tokens(F.col(column)))).alias("w")).where(F.col("w").isin(*{w for f in forms for w in f})).groupBy("w").agg(F.count("*").alias("n"))
    table = rows.sparkSession.createDataFrame(list(forms), "short string, long string")
    short, long = words.select(F.col("w").alias("short"), F.col("n").alias("n_short")), words.select(F.col("w").alias("long"), F.col("n").alias("n_long"))
    return table.join(short, "short", "left").join(long, "long", "left").select("short", "long", F.coalesce("n_short", F.lit(0)).alias("n_short"), F.coalesce("n_long", F.lit(0)).alias("n_long"))


def non_ascii_by(rows: DataFrame, column: str, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(F.col(column).rlike(r"[^\x00-\x7F]").cast("double")), 6).alias("share"))


def repeated_share(rows: DataFrame, value: Column) -> DataFrame:
    """One row: the share of rows whose value occurs more than once."""
    return rows.groupBy(value.alias("v")).agg(F.count("*").alias("n")).agg(F.round(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("share"), F.count("*").alias("distinct_values"))


def only_in(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct values of a that b lacks."""
    return a.select(column).distinct().exceptAll(b.select(column).distinct())


def random_pairs(queries: DataFrame, targets: DataFrame, truth: DataFrame, each: int, seed: str) -> DataFrame:
    """Each query with ``each`` targets drawn by keyed hash, true pairs taken out: a baseline, not a cross join.

    Targets are numbered in the order of their hashes within ranges of it, whose counts alone are ordered in
    one place; a query's draws are hashes of it modulo the targets' number.
    """
    keyed = targets.select("t", md5_key(F.col("t"), seed).alias("h")).withColumn("range", F.substring("h", 1, 3))
    counts = keyed.groupBy("range").agg(F.count("*").alias("k"))
    starts = counts.select("range", F.coalesce(F.sum("k").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("h", "t")) - 1
    numbered = keyed.withColumn("place", place).join(starts, "range").select("t", (F.col("start") + F.col("place")).alias("n"))
    total = max(1, targets.count())
    one = lambda i: F.conv(F.substring(md5_key(F.concat_ws(":", F.col("q"), i), seed), 1, 12), 16, 10).cast("long") % total
    draw = F.explode(F.transform(F.sequence(F.lit(1), F.lit(each)), one))
    return queries.select("q", draw.alias("n")).distinct().join(numbered, "n").select("q", "t").join(truth.select("q", "t"), ["q", "t"], "left_anti")
