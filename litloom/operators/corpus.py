"""Corpus build: derived fields, de-duplication, screens, tiers and the funnel.

Rows carry their own order (``ord``), so that "first" is always the same row.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litloom.functions import refs, text
from litloom.runtime import cut

# The vocabulary of the screens. A leading blank is part of a term.
AI_TERMS = (
    "artificial intelligence", "machine learning", "deep learning", "chatgpt", "large language model", "generative ai",
    "generative artificial intelligence", " llm", "llms", " gpt", "gpt-", "neural network", "natural language processing",
    "transformer", "ai-generated", "ai generated", "ai-assisted",
)
PLAGIARISM_TERMS = (
    "plagiarism", "academic integrity", "academic misconduct", "text similarity", "ai-generated text detection",
    "ai text detection", "generated text detection", "contract cheating", "authorship", "originality", "text-matching",
    "academic dishonesty",
)
EXCLUDED_TYPES = ("erratum", "correction", "retracted", "retraction")
PLAGIARISM_FOCUS = ("plagiar", "text similarity", "text-matching", "authorship verif", "authorship attribut")
AI_TEXT_FOCUS = (
    "ai-generated text", "ai generated text", "machine-generated text", "machine generated text", "llm-generated",
    "llm generated", "generated text detection", "ai text detect", "ai detector", "ai detection", "gpt detect",
    "chatgpt detect", "detecting ai", "detect ai", "detection of ai", "fake text", "synthetic text detection", "deepfake text",
)
AI_CUES = ("ai-generated", "generative ai", "llm", "chatgpt", "gpt", "machine-generated", "large language model")
YEARS = (2022, 2026)


def derive_fields(rows: DataFrame) -> DataFrame:
    """[P1-P10, P16, P32] Typed and multi-valued columns; rows without a year are dropped.

    Expects the columns of ``papers``; the columns added are year, cites,
    has_abstract, has_references, is_oa, author_list, author_id_list,
    author_kw, index_kw, all_kw, country_list, institution_list, author_count
    and keyword_count.  Every row is treated alone.
    """
    c = F.col
    d = rows.withColumns({"year": F.floor(text.number(c("pub_year"))).cast("int"), "cites": text.count_or_zero(c("cited_by"))}).filter("year is not null")
    d = d.withColumns(
        {
            "has_abstract": text.has_abstract(c("abstract")),
            "has_references": text.has_text(c("references_text")),
            "is_oa": text.has_text(c("open_access")),
            "author_list": text.pieces(c("author_full_names")),
            "author_id_list": text.pieces(c("author_ids")),
            "author_kw": text.pieces_lower(c("author_keywords")),
            "index_kw": text.pieces_lower(c("index_keywords")),
            "country_list": text.countries(c("affiliations")),
            "institution_list": text.institutions(c("affiliations")),
        }
    )
    return d.withColumns({"all_kw": text.union_sorted(c("author_kw"), c("index_kw")), "author_count": F.size("author_list")}).withColumn("keyword_count", F.size("all_kw"))


def with_references(rows: DataFrame) -> DataFrame:
    """[P19-P25] ``ref_keys`` (repeats kept) and ``ref_labels`` (key, label) of every row."""
    r = refs.references_of(F.col("source_db"), F.col("cr_list"), F.col("references_text"))
    d = rows.withColumn("_refs", r).withColumn("ref_keys", refs.cited_keys(F.col("_refs")))
    pairs = F.filter(F.transform("_refs", lambda x: F.struct(refs.cited_key(x).alias("key"), refs.reference_label(x).alias("label"))), lambda x: x["key"].isNotNull())
    return d.withColumn("ref_labels", pairs).drop("_refs")


def label_map(rows: DataFrame, order: str = "record_id") -> DataFrame:
    """[K4] ``key, label``: within a row the first label of a key, across rows the last row's."""
    d = rows.select(F.col(order).alias("o"), F.posexplode("ref_labels").alias("pos", "x")).select("o", "pos", "x.key", "x.label")
    return d.groupBy("key").agg(F.max_by("label", F.struct("o", -F.col("pos"))).alias("label"))


def _alike(new: str, old: str, match: difflib.SequenceMatcher, ratio: float) -> bool:
    match.set_seq1(new)
    match.set_seq2(old)
    # Cheap upper bounds first; they never exclude a true match.
    return match.real_quick_ratio() >= ratio and match.quick_ratio() >= ratio and match.ratio() >= ratio


def near_title_leaders(keys: DataFrame, key: str = "key", ratio: float = 0.93, prefix: int = 12, block_keys: int = 2000) -> DataFrame:
    """[A5, M1] ``key, leader``: title keys led to the first earlier key they nearly equal.

    Keys that share their first ``prefix`` letters form a block; in order, a
    key joins the first leader whose matching ratio reaches ``ratio`` and else
    becomes a leader itself.  A block of up to ``block_keys`` is one task's
    work.  A larger one is compared in tiles of that size, spread over tasks
    that return only keys that are alike, and its leaders then follow in
    rounds: a key leads once all earlier keys like it are led.  The result is
    the same.  Only distinct keys without a DOI come here; empty input gives no
    row.
    """

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        leaders: list[str] = []
        out = []
        match = difflib.SequenceMatcher(None, "", "")
        for k in sorted(pdf["key"]):
            found = next((r for r in leaders if _alike(k, r, match, ratio)), None)
            if found is None:
                leaders.append(k)
            out.append((k, found or k))
        return pd.DataFrame(out, columns=["key", "leader"])

    def tile(name, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = name[1], name[2]
        match = difflib.SequenceMatcher(None, "", "")
        left, right = sorted(pdf.loc[pdf["t"] == x, "key"]), sorted(pdf.loc[pdf["t"] == y, "key"])
        out = []
        for i, p in enumerate(left):
            for q in left[i + 1 :] if x == y else right:
                old, new = min(p, q), max(p, q)
                # Lengths alone bound the ratio by 2 min / (sum).
                if 2 * min(len(p), len(q)) >= ratio * (len(p) + len(q)) and _alike(new, old, match, ratio):
                    out.append((old, new))
        return pd.DataFrame(out, columns=["old", "new"])

    d = keys.select(F.col(key).alias("key")).distinct().withColumn("block", F.substring("key", 1, prefix))
    sizes = d.groupBy("block").agg(F.count("*").alias("n"))
    d = cut(d.join(sizes, "block"))
    small = d.filter(F.col("n") <= block_keys).groupBy("block").applyInPandas(lead, "key string, leader string")
    big = d.filter(F.col("n") > block_keys)
    if not big.limit(1).count():
        return small
    tiles = F.ceil(F.col("n") / block_keys).cast("int")
    t = big.withColumn("t", F.pmod(F.xxhash64("key"), tiles).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), tiles - 1)))
    t = t.select("block", F.least("t", "o").alias("x"), F.greatest("t", "o").alias("y"), "key", "t")
    alike = cut(t.groupBy("block", "x", "y").applyInPandas(tile, "old string, new string"))
    # Rounds: undecided (0), leader (1), led (2).
    state = big.select("key", F.lit(0).alias("s"))
    while True:
        before = alike.join(state.select(F.col("key").alias("old"), "s"), "old").groupBy("new").agg(F.max((F.col("s") == 1).cast("int")).alias("led"), F.max((F.col("s") == 0).cast("int")).alias("open"))
        step = state.join(before, F.col("key") == F.col("new"), "left")
        s = F.when(F.col("s") > 0, F.col("s")).when(F.coalesce("led", F.lit(0)) == 1, 2).when(F.coalesce("open", F.lit(0)) == 0, 1).otherwise(0)
        state = cut(step.select("key", s.alias("s")))
        if not state.filter("s = 0").limit(1).count():
            break
    first = alike.join(state.filter("s = 1").select(F.col("key").alias("old")), "old").groupBy("new").agg(F.min("old").alias("leader"))
    led = state.join(first, F.col("key") == F.col("new"), "left").select("key", F.when(F.col("s") == 1, F.col("key")).otherwise(F.col("leader")).alias("leader"))
    return small.unionByName(led)


def dedup_groups(rows: DataFrame, order: str = "record_id", near: bool = True) -> DataFrame:
    """[P15, A4, A5] ``rows`` with ``key``: equal keys are one publication.

    DOI groups and title groups never merge.  Rows without DOI and title keep a
    key of their own.
    """
    d = rows.withColumn("key", text.dedup_key(F.col("doi"), F.col("title"), F.col(order)))
    if not near:
        return d
    titles = d.filter(F.col("key").startswith("ttl:")).select(F.substr("key", F.lit(5)).alias("key"))
    lead = near_title_leaders(titles).select(F.concat(F.lit("ttl:"), "key").alias("key"), F.concat(F.lit("ttl:"), "leader").alias("leader"))
    return d.join(lead, "key", "left").withColumn("key", F.coalesce("leader", "key")).drop("leader")


def representatives(grouped: DataFrame, order: str = "record_id") -> DataFrame:
    """[A2, A3, W1] One row per ``key``: with references first, then Scopus, then the longest abstract, then the first.

    Adds ``max_cites`` (largest count of the group), ``in_scopus`` and
    ``in_wos``; a null abstract has length 0.  Partial aggregation: a key that
    holds a third of all rows is no bottleneck.
    """
    c = F.col
    score = F.struct(
        (text.has_text(c("references_text")) | (F.coalesce(F.size("cr_list"), F.lit(0)) > 0)).alias("r"),
        (c("source_db") == "Scopus").alias("s"),
        F.length(text.text_or_empty(c("abstract"))).alias("n"),
        (-c(order)).alias("o"),
    )
    keep = [x for x in grouped.columns if x != "key"]
    best = grouped.groupBy("key").agg(
        F.max_by(F.col(order), score).alias("rep"),
        F.max(text.count_or_zero(c("cited_by"))).alias("max_cites"),
        F.bool_or(c("source_db") == "Scopus").alias("in_scopus"),
        F.bool_or(c("source_db") == "WoS").alias("in_wos"),
        F.count("*").alias("group_rows"),
    )
    return best.join(grouped.select(*keep), best["rep"] == grouped[order]).drop("rep")


def is_focus(title: Column, keywords: Column) -> Column:
    """A plagiarism phrase, a generated-text phrase, or "detect" with a cue."""
    t = text.screen_text(title, keywords)
    return text.any_term(t, PLAGIARISM_FOCUS) | text.any_term(t, AI_TEXT_FOCUS) | (t.contains("detect") & text.any_term(t, AI_CUES))


def screened(rows: DataFrame) -> DataFrame:
    """[F1-F6] ``rows`` with in_years, has_ai, has_plag, bad_type, is_relevant and is_focus; nothing is dropped."""
    c = F.col
    t = text.screen_text(c("title"), c("abstract"), c("author_keywords"), c("index_keywords"))
    year = F.floor(text.number(c("pub_year")))
    d = rows.withColumns(
        {
            "in_years": F.coalesce(year.between(*YEARS), F.lit(False)),
            "has_ai": text.any_term(t, AI_TERMS),
            "has_plag": text.any_term(t, PLAGIARISM_TERMS),
            "bad_type": text.any_term(F.lower(text.text_or_empty(c("document_type"))), EXCLUDED_TYPES),
            "is_focus": is_focus(c("title"), c("author_keywords")),
        }
    )
    return d.withColumn("is_relevant", c("in_years") & c("has_ai") & c("has_plag") & ~c("bad_type"))


def funnel(rows: DataFrame, reps: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """[A1, A6] ``stage, n``: twenty-five counters from the rows identified to the core tier, in one pass over each frame.

    ``reps`` are screened representatives; with ``is_seed`` the core is focus
    or seed, else focus alone.  ``missing`` are the seed's rows found nowhere:
    they join the extended and the core set.
    """
    c = F.col
    a = rows.agg(F.count("*").alias("identified"), F.count_if(c("source_db") == "Scopus").alias("identified_scopus"), F.count_if(c("source_db") == "WoS").alias("identified_wos"))
    m = (missing if missing is not None else rows.limit(0)).agg(F.count("*").alias("seed_missing"))
    y, both, ok = c("in_years"), c("in_scopus") & c("in_wos"), c("is_relevant")
    seed = c("is_seed") if "is_seed" in reps.columns else F.lit(False)
    b = reps.agg(
        F.count("*").alias("after_dedup"), F.count_if(both).alias("overlap"), F.count_if(c("in_scopus") & ~c("in_wos")).alias("scopus_only"), F.count_if(c("in_wos") & ~c("in_scopus")).alias("wos_only"),
        F.count_if(c("group_rows") > 1).alias("groups_merged"), F.coalesce(F.max("group_rows"), F.lit(0)).alias("largest_group"),
        F.count_if(y).alias("after_date"), F.count_if(~y).alias("excluded_date"),
        F.count_if(y & ~(c("has_ai") & c("has_plag"))).alias("excluded_terms"), F.count_if(y & ~c("has_ai")).alias("without_ai"), F.count_if(y & ~c("has_plag")).alias("without_plagiarism"),
        F.count_if(y & c("has_ai") & c("has_plag") & c("bad_type")).alias("excluded_type"), F.count_if(ok).alias("screened"), F.count_if(ok & c("is_focus")).alias("focus"), F.count_if(ok & seed).alias("seed_found"),
        F.count_if(ok & (c("is_focus") | seed)).alias("_core"), F.count_if(ok & both).alias("screened_overlap"), F.count_if(ok & text.has_abstract(c("abstract"))).alias("with_abstract"),
    )
    d = a.join(F.broadcast(b), F.lit(True)).join(F.broadcast(m), F.lit(True))  # single rows
    d = d.withColumns({"removed": c("identified") - c("after_dedup"), "seed_recovered": c("seed_missing"), "extended": c("screened") + c("seed_missing"), "core": c("_core") + c("seed_missing")}).drop("_core")
    return d.select(F.explode(F.array(*[F.struct(F.lit(x).alias("stage"), c(x).cast("long").alias("n")) for x in d.columns])).alias("x")).select("x.*")


def seed_flag(rows: DataFrame, seed: DataFrame) -> DataFrame:
    """[J4, F7] ``rows`` with ``is_seed``: DOI or title key occurs in the seed. Semi-join by distinct keys, never row by row."""
    d = rows.withColumn("_d", text.doi_found(F.col("doi"))).withColumn("_t", text.title_key(F.col("title")))
    by_doi = seed.select(text.doi_found(F.col("doi")).alias("_d"), F.lit(True).alias("_sd")).filter("_d <> ''").distinct()
    by_title = seed.select(text.title_key(F.col("title")).alias("_t"), F.lit(True).alias("_st")).filter("_t <> ''").distinct()
    d = d.join(by_doi, "_d", "left").join(by_title, "_t", "left")
    return d.withColumn("is_seed", F.coalesce("_sd", F.lit(False)) | F.coalesce("_st", F.lit(False))).drop("_d", "_t", "_sd", "_st")


def missing_seed(rows: DataFrame, seed: DataFrame, order: str = "record_id") -> DataFrame:
    """[U6] The seed's rows whose key no row has, one per key."""
    key = text.dedup_key(F.col("doi"), F.col("title"), F.col(order))
    have = rows.select(key.alias("_k")).distinct()
    return seed.withColumn("_k", key).join(have, "_k", "left_anti").dropDuplicates(["_k"]).drop("_k")


def recover_seed(rows: DataFrame, seed: DataFrame, order: str = "record_id") -> DataFrame:
    """[J3, U2, U6] ``rows`` and the seed's rows whose key is missing there; those bypass every screen (``recovered``)."""
    flags = {c: F.lit(True) for c in ("in_years", "has_ai", "has_plag", "is_relevant", "is_focus") if c in rows.columns}
    miss = missing_seed(rows, seed, order)
    return rows.withColumn("recovered", F.lit(False)).unionByName(miss.withColumns(flags).withColumn("recovered", F.lit(True)), allowMissingColumns=True)


def tiers(rows: DataFrame) -> DataFrame:
    """[F8] ``is_core``: focus or seed."""
    seed = F.col("is_seed") if "is_seed" in rows.columns else F.lit(False)
    return rows.withColumn("is_core", F.col("is_focus") | seed)


def numbered(rows: DataFrame, order: str = "record_id", name: str = "seq_id", prefix: str = "P", width: int = 3) -> DataFrame:
    """[P38] Zero-padded running ids in the order of ``order``.

    Ranks within ranges of the order, added to the ranges' running totals: no
    single task sees all rows.
    """
    ranged = rows.repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id())
    within = F.row_number().over(Window.partitionBy("_p").orderBy(order))
    # The ranges are fixed by the checkpoint, so that both uses below see the same ones.
    ranged = cut(ranged.withColumn("_w", within))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))  # one row per partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    got = ranged.join(F.broadcast(sizes.select("_p", before.alias("_b"))), "_p")
    return got.withColumn(name, text.padded_id(F.col("_b") + F.col("_w"), prefix, width)).drop("_p", "_w", "_b")


def with_abstracts(rows: DataFrame) -> DataFrame:
    """Rows that have an abstract."""
    return rows.filter(text.has_abstract(F.col("abstract")))


def united(*tables: DataFrame, file_order: str | None = None) -> DataFrame:
    """[U1] All rows of several exports as a bag, with ``source_rank`` for the order of the tables.

    Columns that a table lacks are null.  With ``file_order`` the order within
    a table is that column's; ties keep no order of their own.
    """
    out = None
    for i, t in enumerate(tables):
        d = t.withColumn("source_rank", F.lit(i)).withColumn("file_rank", F.col(file_order) if file_order else F.lit(None).cast("string"))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def reference_keys(rows: DataFrame) -> DataFrame:
    """[J19] Keys of cited works: the column ``ref_keys`` where the table has one, else parsed from its references."""
    return rows if "ref_keys" in rows.columns else with_references(rows)
