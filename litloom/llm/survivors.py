"""One surviving record per group of rows that describe the same publication.

Groups come from exact keys (DOI, title with first author, accession number)
and, for rows without a trustworthy DOI, from titles that differ by a slip or
were cut short.  Field values then survive by a latent two-sided quality model:
every source has a sensitivity (it shows a value that is true) and a false
positive rate (it shows one that isn't), every form of value a prior of being
unaltered, all inferred by expectation-maximisation.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litloom.llm.components import components
from litloom.runtime import blank_trim, cut, stored

# Texts that stand in for a missing value.
STAND_INS = r"(?i)^[\W_]*$|^(?:n/?a|none|null|nan|unknown|untitled|\[?no (?:abstract|title)(?: available)?\]?\.?|(?:abstract|title) not available.*)$"
CHUNK = {True: 8, False: 32}  # letters of a chunk of titles, and of other texts
VERSION_LENGTH = 12  # letters by which a title must go on for its beginning to count as cut short


def norm_doi(c: Column) -> Column:
    t = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", "")
    return F.nullif(F.regexp_replace(F.regexp_extract(t, r"10\.\d{4,9}/\S+", 0), r"[.,;]+$", ""), F.lit(""))


def norm_text(c: Column) -> Column:
    t = F.regexp_replace(F.coalesce(c, F.lit("")), "</?[A-Za-z][^<>]*>", "")
    return F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]+", "")


def _shape(c: Column) -> Column:
    """Letter runs as a or A, digits as 9: the form of an identifier."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]", "9")


def _known(c: Column) -> Column:
    return c.isNotNull() & ~blank_trim(c).rlike(STAND_INS)


def _identity(d: DataFrame) -> dict[str, Column]:
    """What rows are grouped by; ``begin`` is the beginning of the whole abstract's letters."""
    c = F.col
    letters = lambda f: c(f"_l_{f}") if f"_l_{f}" in d.columns else norm_text(c(f))
    return {
        "doi": norm_doi(c("doi")),
        "ut": F.nullif(blank_trim(c("wos_ut")), F.lit("")),
        "t": F.when(_known(c("title")), letters("title")),
        "cut_title": c("title").rlike(r"(?:…|\.\.\.)\s*$"),
        "author": F.nullif(norm_text(F.regexp_extract(F.coalesce(c("author_full_names"), F.lit("")), r"^[\s\"\[]*([^,;|&\n(]+)", 1)), F.lit("")),
        "journal": F.nullif(norm_text(c("source_title")), F.lit("")),
        "year": F.regexp_extract(F.coalesce(c("pub_year"), F.lit("")), r"^\s*((?:19|20)\d\d)", 1),
        "begin": F.when(_known(c("abstract")), F.substring(letters("abstract"), 1, 60)),
    }


def _cut_forms(d: DataFrame, least_share: float) -> list[str]:
    """Forms of DOIs that are the beginning of a common form and aren't common themselves: cut DOIs."""
    shapes = d.filter("doi is not null").groupBy(_shape(F.col("doi")).alias("s")).agg(F.count("*").alias("n"))
    total = shapes.agg(F.sum("n")).first()[0]
    if not total:
        return []
    common = [r["s"] for r in shapes.filter(F.col("n") >= least_share * total).collect()]  # at most 1 / least_share
    begins = F.lit(False)
    for g in common:
        begins = begins | (F.lit(g).startswith(F.col("s")) & (F.col("s") != g))
    # Beginnings of at most 1 / least_share forms: a short list.
    return [r["s"] for r in shapes.filter(begins & ~F.col("s").isin(*common)).select("s").collect()]


def _hot_keys(keyed: DataFrame, most_pairs: int) -> DataFrame:
    """Keys whose queries x others exceed ``most_pairs``, with the tiles they need: rows of queries, columns of others."""
    n = keyed.groupBy("key").agg(F.count_if("is_o").alias("n"), F.count_if("is_q").alias("m")).filter(F.col("n") * F.col("m") > most_pairs)
    side = max(1, math.isqrt(most_pairs))
    return n.select("key", F.ceil(F.col("m") / side).alias("rows"), F.ceil(F.col("n") / side).alias("columns"))


def _finer(d: DataFrame) -> DataFrame:
    """Keys within a large block, as queries (is_q) and others (is_o); no pair that can link is lost.

    A slip keeps the digits and changes the length by two letters at most.  A
    cut title and the whole one share 24 letters and, to score, the abstract's
    beginning, the year, or that both are unknown in one of them.
    """
    c = F.col
    n, digits, head = F.length("t"), F.regexp_replace("t", r"\P{N}+", " "), F.substring("t", 1, 24)
    no_begin, no_year = c("begin").isNull(), c("year") == ""
    out = lambda kind, *cols: F.xxhash64("key", F.lit(kind), *cols)
    as_q = F.array(
        *[out("slip", digits, n + i) for i in range(-2, 3)],
        F.when(~no_begin, out("begin", head, c("begin"))), out("year", head, c("year")),
        F.when(no_begin & no_year, out("q", head)), out("o", head), F.when(no_begin, out("qo", head)), F.when(no_year, out("oq", head)),
    )
    as_o = F.array(
        out("slip", digits, n), F.when(~no_begin, out("begin", head, c("begin"))), out("year", head, c("year")),
        out("q", head), F.when(no_begin & no_year, out("o", head)), F.when(no_year, out("qo", head)), F.when(no_begin, out("oq", head)),
    )
    sides = F.array(F.struct(c("is_q"), F.lit(False).alias("is_o"), as_q.alias("k")), F.struct(F.lit(False).alias("is_q"), c("is_o"), as_o.alias("k")))
    one = d.withColumn("x", F.explode(sides)).select(*[x for x in d.columns if x not in ("key", "is_q", "is_o")], "x.is_q", "x.is_o", F.explode(F.filter("x.k", lambda k: k.isNotNull())).alias("key"))
    return one.filter(c("is_q") | c("is_o"))


def blocked(forms: DataFrame, most_pairs: int) -> DataFrame:
    """``forms`` under their block keys, as queries (is_q, rows without a DOI) and others (is_o).

    A block of more than ``most_pairs`` pairs goes to finer keys, and what is
    still larger to tiles: a query stands in one row of its block's tiles, any
    other in one column, and each is sent to every tile of it.  All pairs that
    can link still meet, and no key forms more than about ``most_pairs``.
    """
    c = F.col
    head, tail = F.substring("t", 1, 16), F.substring("t", -16, 16)
    block = F.array(
        F.when(c("author").isNotNull(), F.xxhash64(F.lit("ah"), "author", head)),
        F.when(c("author").isNotNull(), F.xxhash64(F.lit("at"), "author", tail)),
        F.when(c("journal").isNotNull(), F.xxhash64(F.lit("jh"), "journal", F.substring("t", 1, 28))),
        F.when(c("journal").isNotNull(), F.xxhash64(F.lit("jt"), "journal", F.substring("t", -28, 28))),
    )
    d = forms.withColumn("key", F.explode(F.filter(block, lambda k: k.isNotNull()))).withColumns({"is_q": ~c("has_doi"), "is_o": F.lit(True)})
    # Most keys hold one group only, or no query: they form no pair.
    sizes = d.groupBy("key").agg(F.count_if("is_o").alias("n"), F.count_if("is_q").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    sizes = cut(sizes.filter("m > 0 and lo <> hi").select("key", (c("n") * c("m") > most_pairs).alias("hot")))
    d = d.join(sizes, "key")
    if not sizes.filter("hot").limit(1).count():
        return d.drop("hot")
    fine = _finer(d.filter("hot").drop("hot"))
    still = cut(_hot_keys(fine, most_pairs))
    fine = fine.join(still, "key", "left")
    at = lambda n: F.pmod(F.xxhash64("label", "t"), c(n))
    to = lambda n: F.sequence(F.lit(0).cast("long"), c(n) - 1)
    as_q, as_o = F.transform(to("columns"), lambda x: F.xxhash64("key", at("rows"), x)), F.transform(to("rows"), lambda x: F.xxhash64("key", x, at("columns")))
    tile = F.when(c("rows").isNull(), F.array("key")).when(c("is_q"), as_q).otherwise(as_o)
    fine = fine.withColumn("key", F.explode(tile)).drop("rows", "columns")
    return d.filter("not hot").drop("hot").unionByName(fine)


def duplicate_groups(rows: DataFrame, least_shape_share: float = 0.05, most_pairs: int = 1_000_000) -> DataFrame:
    """``record_id, group_id``: group_id is the smallest record_id of the publication's rows.

    Rows join by equal DOI, by equal accession number (wos_ut), by equal
    title and first author, and, without an author or DOI, by equal title,
    journal, year and abstract's beginning.  Titles under 20 letters say too
    little alone: they join rows whose author, journal, year and abstract's
    beginning are known and equal too.  A DOI whose form is the beginning of a
    common one (a cut DOI) isn't trusted.  A group without a trusted DOI joins
    the best other group of the same first author or journal whose title
    differs by two letters at most or is the longer form of a cut one; a title
    that merely adds a word or two (", revisited", "(Part II)") is another
    publication.  Rows that lack all of these are groups of one.  Ties go to
    the smallest group_id.  Equal rows fall into one group.
    """
    return _groups(cut(rows.select("record_id", *[v.alias(k) for k, v in _identity(rows).items()])), least_shape_share, most_pairs)


def _groups(d: DataFrame, least_shape_share: float = 0.05, most_pairs: int = 1_000_000) -> DataFrame:
    cut_forms = _cut_forms(d, least_shape_share)
    if cut_forms:
        d = d.withColumn("doi", F.when(~_shape(F.col("doi")).isin(*cut_forms), F.col("doi")))
    long_title = F.length("t") >= 20
    known = lambda *cs: functools.reduce(lambda x, y: x & y, [F.col(c).isNotNull() & (F.col(c) != "") for c in cs])
    keys = F.array(
        F.when(F.col("doi").isNotNull(), F.xxhash64(F.lit("doi"), "doi")),
        F.when(F.col("ut").isNotNull(), F.xxhash64(F.lit("ut"), "ut")),
        F.when(long_title & F.col("author").isNotNull(), F.xxhash64(F.lit("title"), "t", "author")),
        F.when(long_title & F.col("author").isNull() & F.col("doi").isNull() & known("journal"), F.xxhash64(F.lit("same"), "t", "journal", "year", F.coalesce("begin", F.lit("")))),
        F.when(~long_title & known("t", "author", "journal", "year", "begin"), F.xxhash64(F.lit("short"), "t", "author", "journal", "year", "begin")),
    )
    links = d.select(F.col("record_id").alias("id"), F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("key"))
    exact = components(d.select(F.col("record_id").alias("id")), links)
    # What each exact group is known by; one row per group and title.
    d = d.join(exact.withColumnRenamed("id", "record_id"), "record_id")
    forms = d.groupBy("label", "t").agg(
        F.max("cut_title").alias("cut_title"), F.max("author").alias("author"), F.max("journal").alias("journal"), F.max("begin").alias("begin"),
        F.max(F.col("doi").isNotNull()).alias("a_doi"), F.max("year").alias("a_year"),
    )
    forms = cut(forms)
    has = forms.groupBy("label").agg(F.max("a_doi").alias("has_doi"), F.max("a_year").alias("year"), F.max("author").alias("any_author"))
    forms = forms.filter(F.length("t") >= 20).drop("a_doi", "a_year").join(has, "label").withColumn("author", F.coalesce("author", "any_author")).drop("any_author")
    keyed = blocked(cut(forms), most_pairs)
    cols = ["label", "t", "cut_title", "author", "begin", "year"]
    q = keyed.filter("is_q").select("key", *[F.col(c).alias(f"q_{c}") for c in cols])
    o = keyed.filter("is_o").select("key", *[F.col(c).alias(f"o_{c}") for c in cols])
    pair = q.join(o, "key").filter("q_label <> o_label")
    shorter = F.when(F.length("q_t") <= F.length("o_t"), F.col("q_t")).otherwise(F.col("o_t"))
    longer = F.when(F.length("q_t") <= F.length("o_t"), F.col("o_t")).otherwise(F.col("q_t"))
    marked = F.when(F.length("q_t") <= F.length("o_t"), F.col("q_cut_title")).otherwise(F.col("o_cut_title"))
    gap = F.length(longer) - F.length(shorter)
    slip = (gap <= 2) & (F.levenshtein("q_t", "o_t", 2) >= 0) & (F.regexp_replace("q_t", r"\P{N}+", " ") == F.regexp_replace("o_t", r"\P{N}+", " "))
    short = longer.startswith(shorter) & (F.length(shorter) >= 24) & (marked | (gap >= VERSION_LENGTH))
    same_author = F.col("q_author").isNull() | F.col("o_author").isNull() | (F.levenshtein("q_author", "o_author", 2) >= 0)
    pair = pair.filter((slip | short) & same_author)
    score = (
        F.when(slip, 4).otherwise(0)
        + F.when(F.col("q_begin") == F.col("o_begin"), 3).when(F.col("q_begin").isNull() | F.col("o_begin").isNull(), 1).otherwise(0)
        + F.when(F.col("q_year") == F.col("o_year"), 2).when((F.col("q_year") == "") | (F.col("o_year") == ""), 1).otherwise(0)
    )
    # A cut title alone says little: the abstract's beginning or the year must agree, or both be unknown.
    pair = pair.filter(slip | (score >= 2))
    best = pair.groupBy("q_label").agg(F.min(F.struct((-score).alias("s"), F.col("o_label"))).alias("b")).select("q_label", F.col("b.o_label").alias("o_label"))
    best = cut(best)
    named = F.concat_ws(">", "q_label", "o_label")
    more = best.select(F.explode(F.array("q_label", "o_label")).alias("id"), F.xxhash64(named).alias("key"))
    merged = components(more.select("id"), more)
    out = exact.join(merged.select(F.col("id").alias("label"), F.col("label").alias("low")), "label", "left")
    return out.select(F.col("id").alias("record_id"), F.coalesce("low", "label").alias("group_id"))


def _form(name: str, v: Column) -> Column:
    """The form of a value: what altering leaves visible."""
    if name == "doi":
        return _shape(v)
    flag = lambda cond, tag: F.when(cond, tag).otherwise("")
    common = [
        flag(v.rlike(r"(?:…|\.\.\.|\[more\]|\[…\])\s*$"), "ellipsis "),
        flag(v != blank_trim(v), "blanks "),
        flag(v.rlike(r"(?U)\S\s{2,}\S"), "gap "),
        flag(v.rlike("</?[A-Za-z]|&[a-z]+;"), "markup "),
    ]
    if name == "title":
        return F.concat(
            *common,
            flag((v == F.upper(v)) & (v != F.lower(v)), "upper "),
            flag((v == F.lower(v)) & (v != F.upper(v)), "lower "),
            flag(v.rlike(r"[^.]\.\s*$"), "stop "),
            flag(v.rlike(r"\s-\s"), "dash "),
        )
    return F.concat(*common, flag(~v.rlike(r"[.!?][\"”')\]]?\s*$"), "open "))


def fit_quality(form: np.ndarray, k: np.ndarray, n: np.ndarray, weight: np.ndarray, learn: np.ndarray, steps: int = 80):
    """EM of the two-sided model over patterns.

    form: index of the value's form; k, n: per source, rows that show the value
    and rows that show any; weight: how often the pattern occurs; learn: where
    a group has rival values, the only place where forms can be judged.
    Returns the posterior per pattern, priors of forms, sensitivities and
    false positive rates of sources.
    """
    forms, sources = int(form.max()) + 1, k.shape[1]
    share = (k.sum(1) / np.maximum(1, n.sum(1))).clip(0.02, 0.98)
    p = share.copy()
    w = weight * learn
    prior, sens, false = np.full(forms, 0.5), np.full(sources, 0.7), np.full(sources, 0.2)
    for _ in range(steps):
        t, f = w * p, w * (1 - p)
        prior = (np.bincount(form, t, forms) + 0.5) / (np.bincount(form, w, forms) + 1.5)
        sens = ((t[:, None] * k).sum(0) + 7) / ((t[:, None] * n).sum(0) + 10)
        false = ((f[:, None] * k).sum(0) + 2) / ((f[:, None] * n).sum(0) + 10)
        # A source that shows false values more often than true ones would turn the classes round.
        false = np.minimum(false, sens * 0.9)
        log = np.log(prior / (1 - prior))[form]
        log = log + (k * np.log(sens / false)[None, :] + (n - k) * np.log((1 - sens) / (1 - false))[None, :]).sum(1)
        p = 1 / (1 + np.exp(-log.clip(-300, 300)))
    return p, prior, sens, false


def _chunks(letters: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(letters), F.lit(size)), lambda i: F.hash(F.substr(letters, i, F.lit(size))))


def _described(d: DataFrame, fields: tuple[str, ...], source: str) -> dict[str, Column]:
    """``s``, the source, and ``vals``: per field the value's hash, form, letters and hashes of its chunks, null where unknown."""
    every = []
    for name in fields:
        v, letters = F.col(name), F.col(f"_l_{name}") if f"_l_{name}" in d.columns else norm_text(F.col(name))
        n = F.length(letters)
        chunks = F.lit(None).cast("array<int>") if name == "doi" else F.when(n > 0, _chunks(letters, CHUNK[name == "title"]))
        one = F.struct(F.lit(name).alias("field"), F.xxhash64(v).alias("h"), _form(name, v).alias("form"), n.alias("letters"), F.coalesce(chunks, F.array().cast("array<int>")).alias("chunks"))
        every.append(F.when(_known(v), one))
    return {"s": F.coalesce(F.col(source), F.lit("")), "vals": F.array(*every)}


def surviving_values(rows: DataFrame, groups: DataFrame, name: str, source: str = "source_db", multi: bool = False, least: float = 0.5) -> DataFrame:
    """``group_id, field_name, record_id, confidence`` of one field's survivors.

    Only groups of two rows or more.  ``record_id`` is the smallest of the rows
    that hold the value.  Null, blank and stand-in values are missing.  Where
    ``multi`` is set every value judged true survives, else the likeliest
    (ties: more rows, then the longer, then the one of the smallest record_id).  A group whose
    likeliest value is judged altered (posterior below ``least``) has no row.
    """
    d = cut(rows.select("record_id", *[v.alias(k) for k, v in _described(rows, (name,), source).items()]))
    return _survivors(d, groups, (name,), multi, least)


def _several(groups: DataFrame) -> DataFrame:
    """``groups`` without groups of one row."""
    return groups.join(groups.groupBy("group_id").agg(F.count("*").alias("size")).filter("size >= 2").select("group_id"), "group_id")


def _survivors(d: DataFrame, groups: DataFrame, fields: tuple[str, ...], multi: bool, least: float, least_source: float = 0.05, least_form: int = 10) -> DataFrame:
    """The survivors of rows as ``_described``; all fields go through the same joins.

    Sources of less than ``least_source`` of all rows share their rates, forms
    of fewer than ``least_form`` values their prior: there is too little to learn of each.
    """
    spark = d.sparkSession
    total = d.count()
    # At most 1 / least_source names.
    names = sorted(r["s"] for r in d.groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= least_source * total).select("s").collect())
    if not total:
        return spark.createDataFrame([], "group_id long, field_name string, record_id long, confidence double")
    slot = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in names]), F.col("s")), F.lit(0).cast("long")), F.lit(len(names) + 1))
    ks, ns = [f"k{i}" for i in range(len(names) + 1)], [f"n{i}" for i in range(len(names) + 1)]
    each = d.select("record_id", slot.alias("slot"), F.explode("vals").alias("x")).filter("x is not null").select("record_id", "slot", "x.*").join(_several(groups), "record_id")
    facts = each.groupBy("group_id", "field", "h", "form", "letters", "chunks").agg(F.min("record_id").alias("record_id"), *[F.count_if(F.col("slot") == i + 1).alias(k) for i, k in enumerate(ks)])
    facts = cut(facts)
    tops = facts.groupBy("group_id", "field").agg(F.max(F.struct("letters", "h", "chunks")).alias("top"), F.count("*").alias("rivals"), *[F.sum(k).alias(n) for k, n in zip(ks, ns, strict=True)])
    d = facts.join(tops, ["group_id", "field"])
    # A value that another one continues was cut: all its whole chunks begin the longest value.
    size = F.when(F.col("field") == "title", CHUNK[True]).otherwise(CHUNK[False])
    whole = F.floor(F.col("letters") / size).cast("int")
    begins = (F.col("field") != "doi") & (F.col("letters") < F.col("top.letters")) & (F.slice("chunks", F.lit(1), whole) == F.slice("top.chunks", F.lit(1), whole))
    d = d.withColumn("form", F.concat("form", F.when(begins, "begins ").otherwise(""))).withColumn("contested", F.col("rivals") > 1).drop("top", "chunks")
    forms = d.groupBy("field", "form").agg(F.count("*").alias("n"))
    least_n = forms.groupBy("field").agg(F.greatest(F.lit(float(least_form)), F.sum("n") * 1e-5).alias("least"))  # hence at most 100,000 forms a field
    rare = forms.join(F.broadcast(least_n), "field").select("field", "form", F.when(F.col("n") < F.col("least"), "rare").otherwise(F.col("form")).alias("as"))
    d = cut(d.join(rare, ["field", "form"]).withColumn("form", F.col("as")).drop("as"))
    # To learn from, a group weighs like fifteen rows of a source at most: patterns of small counts stay few.
    top = F.greatest(*[F.col(n) for n in ns])
    scale = F.when(top > 15, F.lit(15.0) / top).otherwise(F.lit(1.0))
    tally = d.select("field", "form", "contested", *[F.ceil(F.col(x) * scale).cast("int").alias(x) for x in ks + ns])
    tally = tally.groupBy("field", "form", "contested", *ks, *ns).agg(F.count("*").alias("count")).collect()  # forms x small counts
    odds, priors = F.lit(0.0), []
    for name in fields:
        mine = [r for r in tally if r["field"] == name]
        if not mine:
            continue
        order = sorted({r["form"] for r in mine})
        at = {f: i for i, f in enumerate(order)}
        _, prior, sens, false = fit_quality(
            np.array([at[r["form"]] for r in mine]), np.array([[r[x] for x in ks] for r in mine], float), np.array([[r[x] for x in ns] for r in mine], float),
            np.array([r["count"] for r in mine], float), np.array([r["contested"] for r in mine], float),
        )
        priors += [(name, f, float(np.log(p / (1 - p)))) for f, p in zip(order, prior, strict=True)]
        # Every row counts in the posterior.
        said = sum((F.col(k) * float(np.log(a / b)) + (F.col(n) - F.col(k)) * float(np.log((1 - a) / (1 - b))) for k, n, a, b in zip(ks, ns, sens, false, strict=True)), F.lit(0.0))
        odds = F.when(F.col("field") == name, said).otherwise(odds)
    if not priors:
        return spark.createDataFrame([], "group_id long, field_name string, record_id long, confidence double")
    known = F.broadcast(spark.createDataFrame(priors, "field string, form string, prior double"))
    posterior = 1 / (1 + F.exp(-F.greatest(F.least(F.col("prior") + odds, F.lit(300.0)), F.lit(-300.0))))
    d = d.join(known, ["field", "form"]).withColumn("confidence", posterior).filter(F.col("confidence") >= least)
    if not multi:
        rank = F.struct(F.round("confidence", 9).alias("c"), sum(F.col(k) for k in ks).alias("k"), "letters", -F.col("record_id"))
        d = d.groupBy("group_id", "field").agg(F.max_by(F.struct("record_id", "confidence"), rank).alias("b")).select("group_id", "field", "b.*")
    return d.select("group_id", F.col("field").alias("field_name"), "record_id", "confidence")


def count_value(c: Column) -> Column:
    """A count typed as 12, " 12", 12.0 or 1,234; else null."""
    t = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s+", "")
    t = F.when(t.rlike(r"^\d{1,3}(,\d{3})+(\.0+)?$"), F.replace(t, F.lit(","), F.lit(""))).otherwise(t)
    return F.when(t.rlike(r"^\d{1,15}(\.\d+)?$"), t.try_cast("double"))


def latest_count(rows: DataFrame, groups: DataFrame, name: str = "cited_by", at: str = "exported_at") -> DataFrame:
    """The latest known count of each group of two rows or more, in the form of ``surviving_values``.

    The latest export with a readable count decides; of equally late ones the largest.
    """
    d = rows.select("record_id", F.col(at).alias("at"), count_value(F.col(name)).alias("n"))
    return _latest(d, groups, name)


def _latest(d: DataFrame, groups: DataFrame, name: str) -> DataFrame:
    """Per group the latest (at, n); of the rows that hold n, at any time, the smallest record_id."""
    d = d.filter("n is not null").join(_several(groups), "record_id")
    held = d.groupBy("group_id", "n").agg(F.min("record_id").alias("record_id"), F.max("at").alias("at"))
    best = held.groupBy("group_id").agg(F.max_by("record_id", F.struct("at", "n")).alias("record_id"))
    return best.select("group_id", F.lit(name).alias("field_name"), "record_id", F.lit(1.0).alias("confidence"))


FIELDS = ("doi", "title", "abstract")


def survivors(rows: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """``group_id, field_name, record_id, confidence`` of doi, title, abstract and cited_by, for every group of two rows or more.

    The rows are read once; hashes and forms of their values move, texts don't.
    """
    wide = rows.withColumns({f"_l_{f}": norm_text(F.col(f)) for f in ("title", "abstract")})
    every = {**_identity(wide), **_described(wide, FIELDS, "source_db"), "at": F.col("exported_at"), "n": count_value(F.col("cited_by"))}
    d = stored(wide.select("record_id", *[v.alias(k) for k, v in every.items()]))
    if groups is None:
        groups = _groups(d.select("record_id", *_identity(d)))
    groups = cut(groups)
    return _latest(d.select("record_id", "at", "n"), groups, "cited_by").unionByName(_survivors(d.select("record_id", "s", "vals"), groups, FIELDS, False, 0.5))


def merged_records(rows: DataFrame, found: DataFrame) -> DataFrame:
    """One record per group: its surviving doi, title, abstract and cited_by (null where none survives)."""
    fields = ("doi", "title", "abstract", "cited_by")
    held = found.join(rows.select("record_id", *fields), "record_id")
    pick = lambda f: F.max(F.when(F.col("field_name") == f, F.col(f))).alias(f)
    out = held.groupBy("group_id").agg(*[pick(f) for f in fields])
    return out.withColumn("cited_by", count_value(F.col("cited_by")).cast("long"))
