"""Secret scans with corpus-wide ownership frequency; DataFrame functions only.

Base kinds are found by their patterns in every whole text.  Beyond them, tokens that look generated
are candidates.  Each candidate value's hash is counted over distinct repositories and owners: a value
that ``owners`` or more owners hold, or that lies in ``repos`` or more repositories (by default a document is
one), is a widely copied example; any other is owner-specific.  Owner-specific candidates outside the base
spans are added as kind ``owned``; a base span is ``example`` or ``live``.

Spans are code points, end exclusive.  Null and empty texts have no spans and the digest of the empty
string; a null owner counts as one owner; repeated rows (equal id and text) are one document; a value
repeated in one document counts once; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinbridge.llm.common import cut, with_key

KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is shorter is no match, and nothing in it could start a longer one.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Whole tokens of 20 or more characters of keys and base64.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
MASK = "<SECRET>"


#: A value's rows meet its counts in so many groups, so that a value in a third of all documents is no single key.
GROUPS = 16


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def _running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """The running sums (or maxima) of an array of integers from 0 on.

    A fold copies what it has gathered at every step, so the array is folded in blocks of about the root of its size.
    """
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def fold(part: Column, inclusive: bool) -> Column:
        def step(acc: Column, v: Column) -> Column:
            now = merge(acc["at"], v)
            return F.struct(now.alias("at"), F.concat(acc["out"], F.array(now if inclusive else acc["at"])).alias("out"))

        return F.aggregate(part, zero, step)

    def joined(folded: Column) -> Column:
        before = fold(F.transform(folded, lambda b: b["at"]), False)["out"]
        return F.flatten(F.zip_with(folded, before, lambda b, o: F.transform(b["out"], lambda x: merge(o, x))))

    def whole(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        parts = F.transform(F.sequence(F.lit(1), F.size(v), size), lambda at: F.slice(v, at, size))
        return F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(_let(F.transform(parts, lambda p: fold(p, True)), joined))

    return _let(values, whole)


def _positions(text: Column, pattern: str, group: int) -> Column:
    """array<struct<start, end, value>> of all matches; value is the group.

    The text splits at the matches, so a match ends after all gaps and matches up to it.
    """
    kind = "array<struct<start:int,end:int,value:string>>"

    def placed(whole: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
        sizes = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)), whole, lambda g, m: F.length(g) + F.length(m))
        ends = F.zip_with(_running(sizes, lambda a, b: a + b), whole, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end")))
        return F.zip_with(ends, values, lambda e, v: F.struct(e["start"].alias("start"), e["end"].alias("end"), v.alias("value")))

    return F.when(text.rlike(pattern), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(F.array().cast(kind))


def _kind(spans: Column, order: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("ord"), s["end"].alias("end"), s["value"].alias("value")))


def _generated(value: Column) -> Column:
    """Looks generated: digits among letters, several of each, and many different characters."""
    digits, letters = F.length(F.regexp_replace(value, r"[^0-9]", "")), F.length(F.regexp_replace(value, r"[^A-Za-z]", ""))
    return (digits >= 3) & (letters >= 3) & (F.size(F.array_distinct(F.split(value, ""))) >= 10)


def scan_spans(text: Column) -> tuple[Column, Column]:
    """(base spans, other candidates) of a text, each sorted, as array<struct<start, ord, end, value>>."""
    assign = F.filter(_positions(text, ASSIGN, 2), lambda s: F.length(s["value"]) >= 12)
    base = F.array_sort(F.concat(_kind(assign, 0), _kind(_positions(text, ACCESS, 0), 1), _kind(_positions(text, HEX, 0), 2)))
    tokens = F.filter(_positions(text, TOKEN, 0), lambda s: _generated(s["value"]))
    return base, F.array_sort(_kind(tokens, 3))


def _reach(spans: Column) -> Column:
    """The furthest end of the base spans up to each."""
    return _running(F.transform(spans, lambda s: F.when(s["ord"] < 3, s["end"]).otherwise(F.lit(0))), F.greatest)


def _uncovered(base: Column, tokens: Column) -> Column:
    """The tokens that do not start inside a base span: one pass over both in order of start."""
    free = lambda both: F.filter(F.zip_with(both, _reach(both), lambda s, r: F.when((s["ord"] == 3) & (s["start"] >= r), s)), lambda s: s.isNotNull())
    return F.when((F.size(tokens) == 0) | (F.size(base) == 0), tokens).otherwise(_let(F.array_sort(F.concat(base, tokens)), free))


def _render(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["ord"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _scan(keyed: DataFrame, owners: int, repos: int) -> DataFrame:
    """A row a row of keyed (id, d, tag, owner, repo, text): d, tag, id, base and found."""
    base, tokens = scan_spans(F.col("text"))
    with_spans = keyed.select("id", "d", "tag", "owner", "repo", base.alias("base"), tokens.alias("tokens")).withColumn("tokens", _uncovered(F.col("base"), F.col("tokens")))
    # values become hashes here; they are never written
    hashed = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash")))
    scanned = cut(with_spans.select("id", "d", "tag", "owner", "repo", hashed("base").alias("base"), hashed("tokens").alias("tokens")), "secrets")
    held = scanned.where("size(base) + size(tokens) > 0").select("d", "tag", "owner", "repo", F.explode(F.concat("base", "tokens")).alias("s"))
    # distinct (value, owner, repository), then owners and repositories of each value: all combined before their shuffles
    each = held.select("s.hash", "owner", "repo").distinct().groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    wide = each.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos")).where((F.col("n_owners") >= owners) | (F.col("n_repos") >= repos))
    copied = wide.select("hash", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(GROUPS - 1).cast("long"))).alias("g"), F.lit(True).alias("copied"))
    dealt = held.select("d", "tag", F.pmod("tag", F.lit(GROUPS)).alias("g"), "s.*")
    judged = dealt.join(copied, ["hash", "g"], "left").select("d", "tag", F.struct("start", "ord", "end", F.col("copied").isNull().alias("live")).alias("s"))
    judged = judged.where("s.ord < 3 or s.live").groupBy("d", "tag").agg(F.array_sort(F.collect_set("s")).alias("found"))
    none = F.array().cast("array<struct<start:int,ord:int,end:int,live:boolean>>")
    return scanned.join(judged, ["d", "tag"], "left").select("id", "d", "tag", "base", F.coalesce("found", none).alias("found"))


def _inputs(keyed: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return keyed.select(F.col(id_col).alias("id"), F.col("__kb_d").alias("d"), F.col("__kb_tag").alias("tag"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), text.alias("text"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", owners: int = 3, repos: int = 50) -> DataFrame:
    """A row a document: its id and key (id, d, tag), the base spans and all spans with their classes.

    ``base``: array<struct<start, ord, end, hash>>; ``found``: array<struct<start, ord, end, live>>; both in order
    of start, then kind.
    """
    return _scan(_inputs(with_key(docs, id_col, text_col, "__kb_d", "__kb_tag"), id_col, text_col, owner_col, repo_col), owners, repos)


def report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Counts by kind, the base spans' digest, all spans as text, and how many are live, copied or added."""
    found = scan(docs, id_col=id_col, **options)
    n = lambda order: F.size(F.filter("base", lambda s: s["ord"] == order)).cast("long")
    of = lambda test: F.size(F.filter("found", test)).cast("long")
    return found.select(
        F.col("id").alias(id_col), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(_render(F.col("base")), 256).alias("base_sha256"), _render(F.col("found")).alias("spans"),
        of(lambda s: s["live"]).alias("n_live"), of(lambda s: ~s["live"]).alias("n_example"), of(lambda s: s["ord"] == 3).alias("n_owned"),
    )


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with its spans, in order of start, replaced; spans that overlap are one."""

    def pieces(reach: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.slice(reach, F.lit(1), F.size(reach) - 1))
        piece = lambda s, at: F.when(s["end"] <= at, "").otherwise(F.concat(F.substring(text, at + 1, F.greatest(s["start"] - at, F.lit(0))), F.when(s["start"] >= at, F.lit(mask)).otherwise(F.lit(""))))
        return F.concat(F.array_join(F.zip_with(spans, before, piece), ""), F.substring(text, F.array_max(reach) + 1, F.length(text)))

    return _let(_running(F.transform(spans, lambda s: s["end"]), F.greatest), pieces)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", mask: str = MASK, owners: int = 3, repos: int = 50) -> DataFrame:
    """The documents with the live spans of their texts replaced by ``mask``; other columns stay, null texts too."""
    keyed = with_key(docs, id_col, text_col, "__kb_d", "__kb_tag")
    found = _scan(_inputs(keyed, id_col, text_col, owner_col, repo_col), owners, repos)
    live = found.select(F.col("d").alias("__kb_d"), F.col("tag").alias("__kb_tag"), F.filter("found", lambda s: s["live"]).alias("__kb_spans")).where("size(__kb_spans) > 0").dropDuplicates(["__kb_d", "__kb_tag"])
    masked = _masked(F.col(text_col).cast("string"), F.col("__kb_spans"), mask)
    return keyed.join(live, ["__kb_d", "__kb_tag"], "left").withColumn(text_col, F.when(F.col("__kb_spans").isNotNull(), masked).otherwise(F.col(text_col))).select(*docs.columns)
