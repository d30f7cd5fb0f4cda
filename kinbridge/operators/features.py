"""Pair features for the ranker (stage 1) and the matcher (stage 2).  Absent values are null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinbridge.functions.similarity import scorer

SCRIPT_CODES = {"empty": 0, "latin": 1, "mixed": 2, "other": 3}
COUNTRY_CODES = {"US": 0, "India": 1}


def ratio(a: Column, b: Column) -> Column:
    """Rounded to six places; null where b is 0 or either is null."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)


def code(x: Column, codes: dict[str, int], other: int) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in codes.items() for v in kv]), x), F.lit(other))


def masses(posts: DataFrame, vocab: DataFrame, df_cap: int | None) -> DataFrame:
    """(doc, mass, ntok, maxidf): summed idf of tokens within the cap; token count and greatest idf of all known tokens."""
    inside = F.lit(True) if df_cap is None else F.col("df") <= df_cap
    known = posts.join(vocab, ["part", "token"])
    return known.groupBy("doc").agg(F.round(F.coalesce(F.sum(F.when(inside, F.col("idf"))), F.lit(0.0)), 6).alias("mass"), F.count("*").alias("ntok"), F.max("idf").alias("maxidf"))


def overlap_features(pairs: DataFrame, channel: str, q_mass: DataFrame, t_mass: DataFrame) -> DataFrame:
    """Adds qfrac, tfrac and wjac of a channel: containment and weighted Jaccard."""
    s, q, t = F.col(f"s_{channel}"), F.col(f"qmass_{channel}"), F.col(f"tmass_{channel}")
    out = pairs.join(q_mass.select(F.col("doc").alias("q"), F.col("mass").alias(f"qmass_{channel}")), "q", "left").join(t_mass.select(F.col("doc").alias("t"), F.col("mass").alias(f"tmass_{channel}")), "t", "left")
    return out.withColumns({f"qfrac_{channel}": ratio(s, q), f"tfrac_{channel}": ratio(s, t), f"wjac_{channel}": ratio(s, q + t - s)})


def union_features(pairs: DataFrame) -> DataFrame:
    """Adds s_rel (union score over the query's best), log_n_cand."""
    return pairs.withColumns({"s_rel": ratio(F.col("s_sum"), F.col("s_best")), "log_n_cand": F.round(F.log1p(F.col("n_cand")), 6)})


def first_value(x: Column) -> Column:
    return F.nullif(F.element_at(F.split(x, " "), 1), F.lit(""))


def equal_conflict(a: Column, b: Column) -> tuple[Column, Column]:
    """(eq, conflict) of the first values, 1 or 0: both present and equal, both present and different."""
    x, y = first_value(a), first_value(b)
    return F.coalesce((x == y).cast("int"), F.lit(0)), F.coalesce((x != y).cast("int"), F.lit(0))


#: What the features need of a record; texts stay behind.
RECORD_COLUMNS = ("country", "name_script", "address_missing", "house_numbers", "unit_numbers", "postcode", "source")
#: Stage-2 columns before the string scores.
CONTEXT = ("s1_score", "s1_rank", "s1_gap", "s1_best", "s1_gap12", "s1_ntop")


def stage1_names(channels: list[str]) -> list[str]:
    """Five columns a channel, five of the union, six of number agreement, six of the records, seven counts."""
    own = [f"{c}_{n}" for n in channels for c in ("s", "r", "qfrac", "tfrac", "wjac")]
    union = ["s_sum", "r_sum", "s_rel", "log_n_cand", "n_channels"]
    agree = [f"{n}_{c}" for n in ("house", "unit", "post") for c in ("eq", "conflict")]
    return own + union + agree + ["t_source", "country", "q_script", "t_script", "q_addr_missing", "t_addr_missing", "q_name_ntok", "t_name_ntok", "q_addr_ntok", "t_addr_ntok", "q_name_maxidf", "q_key_df", "t_key_df"]


def stage2_names(channels: list[str]) -> list[str]:
    """All of stage 1 but the country, the context of the ranking, string scores and equalities."""
    return [n for n in stage1_names(channels) if n != "country"] + [*CONTEXT, *[n for n, _, _ in STRING_FEATURES], "legal_form_equal", "stripped_first_token_equal"]


Field = tuple[str, str]


def side_statistics(records: DataFrame, posts: dict[Field, DataFrame], vocabs: dict[Field, DataFrame], masses: dict[str, tuple[Field, int | None]], name: str, address: str, key_field: str, key: str) -> DataFrame:
    """A row a record: its columns for the features and its token statistics, 0 where it has no known token.

    posts and vocabs go by text column and mode; masses: channel to its field and df cap.  A field's figures come
    from one grouping, and the groupings meet in one, so a record is joined once.
    """
    parts, wanted = [], {f"mass_{c}": F.lit(0.0) for c in masses} | {"name_ntok": F.lit(0), "addr_ntok": F.lit(0), "name_maxidf": F.lit(0.0), "key_df": F.lit(0)}
    for field in posts:
        within = lambda cap: F.lit(True) if cap is None else F.col("df") <= cap
        own = [F.round(F.sum(F.when(within(cap), F.col("idf"))), 6).alias(f"mass_{c}") for c, (f, cap) in masses.items() if f == field]
        own += [F.count("*").alias("name_ntok"), F.max("idf").alias("name_maxidf")] if field == (name, "tokens") else []
        own += [F.count("*").alias("addr_ntok")] if field == (address, "tokens") else []
        own += [F.max("df").alias("key_df")] if field == (key_field, "key") else []
        parts.append(posts[field].join(vocabs[field], ["part", "token"]).groupBy("doc").agg(*own))
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    found = together.groupBy("doc").agg(*[F.max(c).alias(c) for c in wanted])
    out = records.select(F.col(key).alias("doc"), *RECORD_COLUMNS).join(found, "doc", "left")
    return out.withColumns({c: F.coalesce(c, zero) for c, zero in wanted.items()})


def stage1_features(pairs: DataFrame, channels: list[str], queries: DataFrame, targets: DataFrame) -> DataFrame:
    """The pairs (merged channels) with q, t and the columns of ``stage1_names``; queries and targets: ``side_statistics``."""
    side = lambda df, p: df.select(F.col("doc").alias(p), *[F.col(c).alias(f"_{p}_{c}") for c in df.columns if c != "doc"])
    out = union_features(pairs.join(side(queries, "q"), "q").join(side(targets, "t"), "t"))
    for n in channels:
        s, q, t = F.col(f"s_{n}"), F.col(f"_q_mass_{n}"), F.col(f"_t_mass_{n}")
        out = out.withColumns({f"qfrac_{n}": ratio(s, q), f"tfrac_{n}": ratio(s, t), f"wjac_{n}": ratio(s, q + t - s)})
    for name, column in (("house", "house_numbers"), ("unit", "unit_numbers"), ("post", "postcode")):
        eq, conflict = equal_conflict(F.col(f"_q_{column}"), F.col(f"_t_{column}"))
        out = out.withColumns({f"{name}_eq": eq, f"{name}_conflict": conflict})
    out = out.withColumns({
        "t_source": F.col("_t_source").cast("int"), "country": code(F.col("_q_country"), COUNTRY_CODES, 2), "q_script": code(F.col("_q_name_script"), SCRIPT_CODES, 4), "t_script": code(F.col("_t_name_script"), SCRIPT_CODES, 4),
        "q_addr_missing": F.col("_q_address_missing").cast("int"), "t_addr_missing": F.col("_t_address_missing").cast("int"), "q_name_maxidf": F.round("_q_name_maxidf", 6),
    } | {f"{p}_{c}": F.col(f"_{p}_{c}") for p in "qt" for c in ("name_ntok", "addr_ntok", "key_df")})
    return out.select("q", "t", *stage1_names(channels))


def rank_context(scored: DataFrame, score: str = "s1_score") -> DataFrame:
    """Adds s1_rank, s1_best, s1_gap, s1_gap12 (null if alone) and s1_ntop (the query's rows)."""
    q = Window.partitionBy("q")
    out = scored.withColumn("s1_rank", (F.row_number().over(q.orderBy(F.desc(score), "t")) - 1).cast("long"))
    best, second = F.max(score).over(q), F.max(F.when(F.col("s1_rank") == 1, F.col(score))).over(q)
    return out.withColumns({"s1_best": best, "s1_gap": F.round(best - F.col(score), 6), "s1_gap12": F.round(best - second, 6), "s1_ntop": F.count("*").over(q)})


#: Stage-2 string features: name, scorer, column.
STRING_FEATURES = (
    ("name_ratio", "ratio", "name_fold"), ("name_token_set", "token_set", "name_fold"), ("name_token_sort", "token_sort", "name_fold"), ("name_partial", "partial", "name_fold"),
    ("name_jaro_winkler", "jaro_winkler", "name_fold"), ("stripped_ratio", "ratio", "name_stripped"), ("stripped_token_set", "token_set", "name_stripped"),
    ("addr_ratio", "ratio", "address_norm"), ("addr_token_set", "token_set", "address_norm"), ("addr_partial", "partial", "address_norm"), ("addr_numbers_token_set", "token_set", "address_numbers"),
)


def string_features(pairs: DataFrame, queries: DataFrame, targets: DataFrame, key: str = "row_idx") -> DataFrame:
    """Adds the string scores and two equality flags; null where a side is empty."""
    columns = sorted({c for _, _, c in STRING_FEATURES} | {"legal_forms"})
    side = lambda df, p: df.select(F.col(key).alias(p), *[F.col(c).alias(f"_{p}_{c}") for c in columns])
    out = pairs.join(side(queries, "q"), "q").join(side(targets, "t"), "t")
    out = out.withColumns({n: scorer(s)(F.col(f"_q_{c}"), F.col(f"_t_{c}")) for n, s, c in STRING_FEATURES})
    same = lambda a, b: F.when((a != "") & (b != ""), (a == b).cast("int"))
    out = out.withColumns({"legal_form_equal": same(F.col("_q_legal_forms"), F.col("_t_legal_forms")), "stripped_first_token_equal": same(F.element_at(F.split("_q_name_stripped", " "), 1), F.element_at(F.split("_t_name_stripped", " "), 1))})
    return out.drop(*[c for c in out.columns if c.startswith(("_q_", "_t_"))])


def labels(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds label: 1 if truth has the pair."""
    known = truth.select("q", "t").distinct().withColumn("_hit", F.lit(1))
    return pairs.join(known, ["q", "t"], "left").withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_hit")
