"""Probabilistic record linkage of two lists without a shared key.

Entries are reduced to a few noisy attributes, equal ones collapse to one
class, candidate pairs come from several blocking passes, every attribute is
compared on agreement levels, and expectation-maximisation over the counts of
the agreement patterns gives the probabilities of each level among matches and
non-matches.  The posterior is a pair's confidence.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litloom.runtime import cut

ATTRIBUTES = ("surname", "initials", "year", "journal", "volume", "page")
# Levels are 0 differ, 1 unknown or compatible, 2 near, 3 equal; starting weights of the levels among matches and non-matches.
START_M = {"surname": (0.02, 0.01, 0.17, 0.80), "initials": (0.02, 0.13, 0.05, 0.80), "year": (0.02, 0.04, 0.06, 0.88), "journal": (0.02, 0.02, 0.11, 0.85), "volume": (0.02, 0.16, 0.02, 0.80), "page": (0.002, 0.138, 0.01, 0.85)}
START_U = {"surname": (0.60, 0.01, 0.05, 0.34), "initials": (0.60, 0.10, 0.05, 0.25), "year": (0.60, 0.04, 0.10, 0.26), "journal": (0.70, 0.02, 0.08, 0.20), "volume": (0.60, 0.16, 0.02, 0.22), "page": (0.65, 0.13, 0.02, 0.20)}
SMALL_WORDS = "of|the|and|in|on|for|a|an|de|der|la|et"


def plain(c: Column) -> Column:
    """Lower-case letters without accents, with ue, oe, ae as u, o, a: one form for both ways of writing umlauts."""
    c = F.lower(c)
    c = F.translate(c, "äàáâãåöòóôõøüùúûéèêëíìîïñçýß", "aaaaaaoooooouuuueeeeiiiincys")
    c = F.regexp_replace(c, "ue", "u")
    c = F.regexp_replace(c, "oe", "o")
    c = F.regexp_replace(c, "ae", "a")
    return F.regexp_replace(c, "[^a-z]", "")


def _number(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int")


def wos_attributes(lines: DataFrame, key: str, text: str) -> DataFrame:
    """``id, surname, initials, year, journal, volume, page`` of lines such as
    ``Sohavik S, 2005, INT J WRIT ASSESS, V70, P12, DOI 10...``; what is missing is null."""
    t = F.regexp_replace(F.trim(F.coalesce(F.col(text), F.lit(""))), r"(?U)\s+", " ")
    parts = F.split(t, r",\s*")
    author = F.element_at(parts, 1)
    rest = F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda p: ~p.rlike(r"(?i)^(?:(?:18|19|20)\d\d|[vp]\s?\d+.*|\[?(?:doi\b.*|10\..*)|arxiv.*|in press)$") & (p != ""))
    return lines.select(
        F.col(key).alias("id"),
        F.nullif(plain(F.regexp_replace(author, r"(?U)\s+\p{Lu}{1,3}\.?$", "")), F.lit("")).alias("surname"),
        F.nullif(F.lower(F.regexp_extract(author, r"(?U)\s(\p{Lu}{1,3})\.?$", 1)), F.lit("")).alias("initials"),
        _number(t, r",\s*((?:18|19|20)\d\d)(?:,|$)").alias("year"),
        F.get(rest, F.lit(0)).alias("j"),
        _number(t, r"(?i),\s*V\s?(\d{1,6})(?:\D|$)").alias("volume"),
        _number(t, r"(?i),\s*P\s?(\d{1,8})(?:\D|$)").alias("page"),
    )


def scopus_attributes(refs: DataFrame, key: str, text: str) -> DataFrame:
    """The same of strings such as ``Povirosk M., Vepik V., Title, Journal Name, 44, pp. 334-346, (2004)``."""
    t = F.regexp_replace(F.trim(F.coalesce(F.col(text), F.lit(""))), r"(?U)\s+", " ")
    first = F.element_at(F.split(t, r"[,;]"), 1)
    no_year = F.regexp_replace(t, r",?\s*(?:\(?(?:18|19|20)\d\d\)?|in press)\s*\.?$", "")
    no_page = F.regexp_replace(no_year, r",?\s*pp?\.?\s*\w*\d+(?:\s*[-–]\s*\w*\d+)?\s*$", "")
    no_volume = F.regexp_replace(no_page, r",\s*(?:vol\.?\s*)?\d+\s*(?:\(\d+\))?\s*$", "")
    return refs.select(
        F.col(key).alias("id"),
        F.nullif(plain(F.regexp_replace(first, r"(?U)\s+(?:\p{Lu}\.?-?)+$", "")), F.lit("")).alias("surname"),
        F.nullif(F.regexp_replace(F.lower(F.regexp_extract(first, r"(?U)\s((?:\p{Lu}\.?-?)+)$", 1)), r"[^\p{L}]", ""), F.lit("")).alias("initials"),
        _number(t, r"\(?((?:18|19|20)\d\d)\)?\s*\.?$").alias("year"),
        F.element_at(F.split(no_volume, r",\s*"), -1).alias("j"),
        _number(no_page, r",\s*(?:vol\.?\s*)?(\d{1,6})\s*(?:\(\d+\))?\s*$").alias("volume"),
        _number(no_year, r"pp?\.?\s*\w*?(\d{1,8})(?:\s*[-–]\s*\w*\d+)?\s*$").alias("page"),
    )


def _journal_words(c: Column) -> Column:
    t = F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(F.trim(t), " "), lambda w: (w != "") & ~w.rlike(f"^(?:{SMALL_WORDS})$"))


def classes(attributes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of equal attributes and the membership of entries.

    Popular works come as many equal entries; only their class is compared.
    """
    d = attributes.select("id", "surname", "initials", "year", "volume", "page", F.array_join(_journal_words(F.coalesce("j", F.lit(""))), " ").alias("jw"))
    what = ["surname", "initials", "year", "volume", "page", "jw"]
    d = d.withColumn("cls", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0001")) for c in what]))
    return d.groupBy("cls").agg(*[F.first(c).alias(c) for c in what]), d.select("id", "cls")


def _keys(d: DataFrame) -> DataFrame:
    """Every class under its blocking keys; passes that lack an attribute are left out."""
    s1 = F.substring("surname", 1, 1)
    words = F.split("jw", " ")
    # Short words and full words agree on their first letters.
    sig = F.when(F.col("jw") != "", F.concat(F.substring(words[0], 1, 1), F.coalesce(F.substring(F.get(words, F.lit(1)), 1, 1), F.lit(""))))

    def k(name: str, *cols: Column) -> Column:
        ok = cols[0].isNotNull()
        for c in cols[1:]:
            ok = ok & c.isNotNull()
        return F.when(ok, F.xxhash64(F.lit(name), *cols))

    c = F.col
    keys = F.array(
        k("pvj", c("page"), c("volume"), sig),
        k("pys", c("page"), c("year"), s1),
        k("syj", c("surname"), c("year"), sig),
        k("sp", c("surname"), c("page")),
        k("svj", c("surname"), c("volume"), sig),
        k("yvjs", c("year"), c("volume"), sig, s1),
    )
    return d.withColumn("key", F.explode(F.filter(keys, lambda x: x.isNotNull())))


def _tiled(d: DataFrame, hot: DataFrame, left: bool) -> DataFrame:
    """Keys of large blocks split into tiles: ``key, cls``.

    A class of one list stands in one row (or column) of its block's tiles and
    is sent to every tile of it, so each pair meets in exactly one tile.
    """
    d = d.join(hot, "key", "left")
    own, other = ("rows", "columns") if left else ("columns", "rows")
    at = F.pmod(F.xxhash64("cls"), F.col(own))
    tile = (lambda x: F.xxhash64("key", at, x)) if left else (lambda x: F.xxhash64("key", x, at))
    keys = F.when(F.col(own).isNotNull(), F.transform(F.sequence(F.lit(0).cast("long"), F.col(other) - 1), tile)).otherwise(F.array("key"))
    return d.select(F.explode(keys).alias("key"), "cls")


def _levels(a: str, b: str) -> list[Column]:
    """One agreement level per attribute of classes prefixed a and b."""
    A, B = (lambda n: F.col(f"{a}_{n}")), (lambda n: F.col(f"{b}_{n}"))

    def compare(name: str, near: Column) -> Column:
        x, y = A(name), B(name)
        return F.when(x.isNull() | y.isNull(), 1).when(x == y, 3).when(near, 2).otherwise(0)

    def numbers(name: str) -> Column:
        return compare(name, F.lit(False))

    near_name = (F.length(A("surname")) >= 4) & (F.levenshtein(A("surname"), B("surname")) <= F.when(F.length(A("surname")) < 6, 1).otherwise(3))
    ini = F.when(A("initials").isNull() | B("initials").isNull(), 1).when(A("initials") == B("initials"), 3)
    ini = ini.when(A("initials").startswith(B("initials")) | B("initials").startswith(A("initials")), 2).otherwise(0)
    # A short word agrees with the full word it begins; words missing at the end of one side are allowed.
    wa, wb = F.split(A("jw"), " "), F.split(B("jw"), " ")
    n = F.least(F.size(wa), F.size(wb))
    fits = lambda x, y: x.startswith(y) | y.startswith(x)
    good = F.size(F.filter(F.zip_with(F.slice(wa, F.lit(1), n), F.slice(wb, F.lit(1), n), lambda x, y: fits(x, y) | (F.levenshtein(F.substring(x, 1, 4), F.substring(y, 1, 4)) <= 1)), lambda v: v))
    exact = F.size(F.filter(F.zip_with(F.slice(wa, F.lit(1), n), F.slice(wb, F.lit(1), n), fits), lambda v: v))
    jour = F.when((A("jw") == "") | (B("jw") == ""), 1).when((exact == n) & (F.size(wa) == F.size(wb)), 3).when((exact == n) | (good == n), 2).otherwise(0)
    return [
        compare("surname", near_name).alias("surname"),
        ini.alias("initials"),
        compare("year", F.abs(A("year") - B("year")) <= 1).alias("year"),
        jour.alias("journal"),
        numbers("volume").alias("volume"),
        numbers("page").alias("page"),
    ]


def fit(patterns: np.ndarray, counts: np.ndarray, steps: int = 60, tie: float = 25.0):
    """EM over agreement patterns: (share of matches, m, u); level tables have one row per attribute.

    ``tie`` pseudo-counts hold the tables near their starting values, so that a
    few patterns can't turn the two classes round.
    """
    m = np.array([START_M[a] for a in ATTRIBUTES])
    u = np.array([START_U[a] for a in ATTRIBUTES])
    m0, u0, share = m.copy(), u.copy(), 0.2
    at = np.arange(len(ATTRIBUTES))
    for _ in range(steps):
        p = posterior(patterns, share, m, u)
        share = float(np.clip((p * counts).sum() / max(1.0, counts.sum()), 1e-6, 0.999))
        for table, start, w in ((m, m0, p * counts), (u, u0, (1 - p) * counts)):
            new = tie * start
            for j in at:
                new[j] += np.bincount(patterns[:, j], weights=w, minlength=4)
            table[:] = new / new.sum(axis=1, keepdims=True)
    return share, m, u


def posterior(patterns: np.ndarray, share: float, m: np.ndarray, u: np.ndarray) -> np.ndarray:
    at = np.arange(patterns.shape[1])
    ll = np.log(share / (1 - share)) + (np.log(m[at, patterns]) - np.log(u[at, patterns])).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(ll, -500, 500)))


def link(a: DataFrame, b: DataFrame, least: float = 0.5, most_pairs: int = 1_000_000) -> DataFrame:
    """``id_a, id_b, confidence`` of the entries that denote the same thing.

    ``a`` and ``b`` come from ``*_attributes``.  All pairs that share a
    blocking key are compared (blocks of more than ``most_pairs`` pairs in tiles
    of about that many, with the same result); equal entries of one list are
    compared once, as a class, and expanded at the end.  Where an entry has several partners
    whose pages contradict one another, the best page stays (ties: all).
    Entries without any attribute match nothing; an empty list gives no row.
    """
    spark = a.sparkSession
    ca, ma = classes(a)
    cb, mb = classes(b)
    ca, cb = cut(ca), cut(cb)
    cols = ["cls", "surname", "initials", "year", "volume", "page", "jw"]
    ka, kb = _keys(ca).select("key", "cls"), _keys(cb).select("key", "cls")
    sizes = ka.groupBy("key").agg(F.count("*").alias("n")).join(kb.groupBy("key").agg(F.count("*").alias("m")), "key")
    side = max(1, math.isqrt(most_pairs))
    tiles = [F.ceil(F.col(c) / side).alias(name) for c, name in (("n", "rows"), ("m", "columns"))]
    hot = cut(sizes.filter(F.col("n") * F.col("m") > most_pairs).select("key", *tiles))
    if hot.limit(1).count():
        ka, kb = _tiled(ka, hot, True), _tiled(kb, hot, False)
    ka, kb = ka.select("key", F.col("cls").alias("a_cls")), kb.select("key", F.col("cls").alias("b_cls"))
    pairs = ka.join(kb, "key").select("a_cls", "b_cls").distinct()
    fa = ca.select(*[F.col(c).alias(f"a_{c}") for c in cols])
    fb = cb.select(*[F.col(c).alias(f"b_{c}") for c in cols])
    seen = pairs.join(fa, "a_cls").join(fb, "b_cls").select("a_cls", "b_cls", "a_page", "b_page", *_levels("a", "b"))
    seen = cut(seen)
    tally = seen.groupBy(*ATTRIBUTES).count().collect()  # at most 4^6 patterns
    if not tally:
        kinds = dict(a.dtypes)["id"], dict(b.dtypes)["id"]
        return spark.createDataFrame([], f"id_a {kinds[0]}, id_b {kinds[1]}, confidence double")
    patterns = np.array([[r[x] for x in ATTRIBUTES] for r in tally], int)
    counts = np.array([r["count"] for r in tally], float)
    p = posterior(patterns, *fit(patterns, counts))
    rows = [(*map(int, x), float(v)) for x, v in zip(patterns, p, strict=True) if v >= least]
    scored = spark.createDataFrame(rows, ", ".join(f"{x} int" for x in ATTRIBUTES) + ", confidence double")
    good = seen.join(F.broadcast(scored), list(ATTRIBUTES)).select("a_cls", "b_cls", "a_page", "b_page", "confidence")
    # Partners on different pages are different works: the page of the best one stays.
    for mine, page in (("a_cls", "b_page"), ("b_cls", "a_page")):
        top = F.max("confidence").over(Window.partitionBy(mine, page))
        best = F.max("confidence").over(Window.partitionBy(mine))
        good = good.withColumn("top", top).withColumn("best", best).filter(F.col(page).isNull() | (F.col("top") >= F.col("best") - 1e-6)).drop("top", "best")
    return (
        good.join(ma.select(F.col("id").alias("id_a"), F.col("cls").alias("a_cls")), "a_cls")
        .join(mb.select(F.col("id").alias("id_b"), F.col("cls").alias("b_cls")), "b_cls")
        .select("id_a", "id_b", "confidence")
    )
