"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litloom.llm import canonical, consensus, cooccurrence, items, linkage, mixing, packing, survivors, term_counts, tokens, truncation
from litloom.operators.multivalue import split_values
from litloom.runtime import cut, stored, table


def p7_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "papers")
    counts = term_counts.term_counts(items.keyword_items(papers))
    return term_counts.band_terms(counts, papers.count())


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_terms(spark, sf_dir).filter("band <> 'useful'").select("term", "band")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivors(table(spark, sf_dir, "papers")).select("group_id", "field_name", "record_id")


def p1_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "papers")
    return survivors.merged_records(papers, survivors.survivors(papers))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.duplicate_groups(table(spark, sf_dir, "papers"))


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = linkage.wos_attributes(table(spark, sf_dir, "wos_cited"), "cite_id", "cr_line")
    b = linkage.scopus_attributes(table(spark, sf_dir, "scopus_cited"), "cite_id", "ref_text")
    return linkage.link(a, b)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("id_a"), F.col("id_b")
    return p2_links(spark, sf_dir).select(F.least(a, b).alias("cite_id_a"), F.greatest(a, b).alias("cite_id_b"))


# Aliases of keywords that initials of two letters leave open: (alias, name).
KEYWORD_ALIASES = (("AI", "artificial intelligence"), ("IP", "intellectual property"), ("LLM", "large language models"), ("OA", "open access"))


def p4_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value with its entry, how it was found and the score; ref_id -1 reports values without an entry."""
    papers, enriched = table(spark, sf_dir, "papers"), table(spark, sf_dir, "enriched_data")
    inst = canonical.read_entries(table(spark, sf_dir, "institutions_ref"), "ref_id", "inst_name")
    words = canonical.read_entries(table(spark, sf_dir, "keywords_ref"), "ref_id", "keyword")
    a = split_values(papers, "record_id", "affiliations", "source_db").withColumnRenamed("record_id", "row_id")
    k = split_values(enriched, "enriched_id", "standardized_keywords").withColumnRenamed("enriched_id", "row_id")
    parts = [
        canonical.map_values(v, e, m, aliases=x).select(F.lit(f).alias("field_name"), "row_id", "pos", "val", "ref_id", "how", "score")
        for f, v, e, m, x in (
            ("affiliations", a, inst, canonical.institution_matcher, ()),
            ("standardized_keywords", k, words, canonical.keyword_matcher, KEYWORD_ALIASES),
        )
    ]
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_mapped(spark, sf_dir).select("field_name", "row_id", "pos", "ref_id")


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "papers")
    n = papers.count()
    d = stored(items.paper_items(papers))  # read by several passes, of one kind each
    parts = [cooccurrence.item_pairs(d, items=f"{kind}s", n_rows=n).select(F.lit(kind).alias("item_kind"), "*") for kind in ("keyword", "reference")]
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pairs(spark, sf_dir).select("item_kind", "item_a", "item_b")


# The labels of the codebook.
LABELS = {
    "orientation": ["technical", "pedagogical", "governance"],
    "methodology": ["computational", "empirical", "conceptual"],
}


def _consensus(spark: SparkSession, sf_dir: str):
    coding = table(spark, sf_dir, "taxonomy_coding")
    votes = consensus.latest_votes(coding, "paper_id", "coder_id", {d: d for d in LABELS}, "coded_at", "coding_id", LABELS)
    return consensus.spectral_consensus(votes, LABELS)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir)[0].select(F.col("item").alias("paper_id"), "dim", "label")


def p6_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir)[0].withColumnRenamed("item", "paper_id")


def p6_coders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir)[1]


def p6_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _consensus(spark, sf_dir)[2]
    return a.select("dim", "n_pairs", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


def _label_sql(dim: str) -> str:
    """Latest usable label per coder and paper: equal, an abbreviation, or within two edits."""
    t = f"regexp_replace(lower({dim}), '[^a-z]', '', 'g')"
    names = "[" + ", ".join(f"'{v}'" for v in LABELS[dim]) + "]"
    one = lambda cond: f"CASE WHEN len(list_filter({names}, lambda v: {cond})) = 1 THEN list_filter({names}, lambda v: {cond})[1] END"
    label = f"coalesce({one('v = t')}, {one('length(t) >= 3 AND starts_with(v, t)')}, {one('length(t) >= 5 AND levenshtein(v, t) <= 2')})"
    inner = f"SELECT paper_id, coder_id, coded_at, coding_id, {label} AS label FROM (SELECT *, {t} AS t FROM taxonomy_coding)"
    return f"SELECT '{dim}' AS dim, paper_id AS item, arg_max(label, epoch_us(coded_at)::HUGEINT * 1000000000 + coding_id) FILTER (label IS NOT NULL) AS label FROM ({inner}) GROUP BY paper_id, coder_id"


AGREEMENT_SQL = f"""WITH v AS ({_label_sql('orientation')} UNION ALL {_label_sql('methodology')}), c AS (SELECT dim, item, label, count(*) AS c FROM v WHERE label IS NOT NULL GROUP BY 1, 2, 3),
 i AS (SELECT dim, item, sum(c * (c - 1)) AS same, sum(c) AS t FROM c GROUP BY 1, 2), o AS (SELECT dim, (sum(t * (t - 1)) / 2)::BIGINT AS n_pairs, sum(same) / sum(t * (t - 1))::DOUBLE AS observed FROM i GROUP BY 1),
 q AS (SELECT dim, label, sum(c) / (sum(sum(c)) OVER (PARTITION BY dim))::DOUBLE AS q FROM c GROUP BY 1, 2), e AS (SELECT dim, sum(q * q) AS expected FROM q GROUP BY 1)
 SELECT dim, n_pairs, round(observed, 6)::DOUBLE AS observed, round(expected, 6)::DOUBLE AS expected, round((observed - expected) / (1 - expected), 6)::DOUBLE AS kappa FROM o JOIN e USING (dim)"""


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cut(docs.select("doc_id", "source", tokens.token_count(F.col("text")).alias("n_tokens")))


def _capacities(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    return [(r["pack_id"], r["capacity_tokens"]) for r in table(spark, sf_dir, "pack_capacities").collect()]  # four rows


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_sizes(spark, sf_dir), _capacities(spark, sf_dir))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(p8_packing(spark, sf_dir), _capacities(spark, sf_dir))


def _mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "mix_targets").select("mix_id", "source", "target_share", "max_repeats").collect()  # 18 rows
    return mixing.mix_sources(_sizes(spark, sf_dir), [tuple(r) for r in rows])


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents")).filter("cut").select("doc_id")


def p10_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_report(truncation.truncated(table(spark, sf_dir, "documents")))


# --- The operators where SQL can say the whole result ---------------------------


def p1_latest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest counts of groups given by the accession number."""
    p = table(spark, sf_dir, "papers")
    ut = F.trim("wos_ut")
    first = p.filter(ut != "").groupBy(ut.alias("ut")).agg(F.min("record_id").alias("group_id"))
    groups = p.select("record_id", ut.alias("ut")).join(first, "ut").select("record_id", "group_id")
    return survivors.latest_count(p, groups).select("group_id", "record_id")


LATEST_SQL = """WITH t AS (SELECT record_id, exported_at, trim(wos_ut) AS ut, regexp_replace(coalesce(cited_by, ''), '\\s+', '', 'g') AS c FROM papers), n AS (SELECT record_id, exported_at, ut, min(record_id) OVER (PARTITION BY ut) AS group_id, count(*) OVER (PARTITION BY ut) AS size,
  CASE WHEN regexp_full_match(c, '\\d{1,3}(,\\d{3})+(\\.0+)?') THEN replace(c, ',', '') ELSE c END AS c FROM t WHERE ut <> ''), v AS (SELECT group_id, record_id, exported_at, CASE WHEN regexp_full_match(c, '\\d{1,15}(\\.\\d+)?') THEN c::DOUBLE END AS n FROM n WHERE size >= 2),
 h AS (SELECT group_id, n, min(record_id) AS record_id, max(exported_at) AS latest FROM v WHERE n IS NOT NULL GROUP BY 1, 2) SELECT group_id, record_id FROM h QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY latest DESC, n DESC) = 1"""


def p2_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year, volume and page as they are read from the lines of one list."""
    d = linkage.wos_attributes(table(spark, sf_dir, "wos_cited"), "cite_id", "cr_line")
    return d.select(F.col("id").alias("cite_id"), "year", "volume", "page")


ATTRIBUTES_SQL = """SELECT cite_id, try_cast(nullif(regexp_extract(t, ',\\s*((?:18|19|20)\\d\\d)(?:,|$)', 1), '') AS INTEGER) AS year, try_cast(nullif(regexp_extract(t, '(?i),\\s*V\\s?(\\d{1,6})(?:\\D|$)', 1), '') AS INTEGER) AS volume,
 try_cast(nullif(regexp_extract(t, '(?i),\\s*P\\s?(\\d{1,8})(?:\\D|$)', 1), '') AS INTEGER) AS page FROM (SELECT cite_id, regexp_replace(trim(coalesce(cr_line, '')), '\\s+', ' ', 'g') AS t FROM wos_cited)"""


def p4_own_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry of both lists mapped by its own name."""
    out = None
    for name, column, matcher in (("institutions_ref", "inst_name", canonical.institution_matcher), ("keywords_ref", "keyword", canonical.keyword_matcher)):
        ref = table(spark, sf_dir, name)
        part = canonical.map_values(ref.select(F.col("ref_id").alias("row_id"), F.col(column).alias("val")), canonical.read_entries(ref, "ref_id", column), matcher).select("row_id", "ref_id")
        out = part if out is None else out.unionByName(part)
    return out


def p5_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts ordered together twice or more and five times as often as chance."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey").cast("string")).alias("items"))
    return cooccurrence.item_pairs(lines, "l_orderkey", least_together=2, heavy_share=4096).withColumn("lift", F.round("lift", 6))


PARTS_SQL = """WITH t AS (SELECT DISTINCT l_orderkey AS c, l_partkey::VARCHAR AS i FROM lineitem), n AS (SELECT count(DISTINCT c) AS n FROM t), k AS (SELECT i, count(*) AS k FROM t GROUP BY 1), p AS (SELECT a.i AS item_a, b.i AS item_b, count(*) AS n_ab FROM t a JOIN t b ON a.c = b.c AND a.i < b.i GROUP BY 1, 2 HAVING count(*) >= 2)
 SELECT item_a, item_b, x.k AS n_a, y.k AS n_b, n_ab, round(n_ab * n::DOUBLE / (x.k * y.k), 6) AS lift FROM p JOIN k x ON x.i = item_a JOIN k y ON y.i = item_b, n WHERE n_ab * n >= 5 * x.k * y.k"""


def p6_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable labels after repeated and revised codings are resolved, per dim and label."""
    coding = table(spark, sf_dir, "taxonomy_coding")
    votes = consensus.latest_votes(coding, "paper_id", "coder_id", {d: d for d in LABELS}, "coded_at", "coding_id", LABELS)
    return votes.groupBy("dim", "label").agg(F.count("*").alias("n"))


VOTES_SQL = f"SELECT dim, label, count(*) AS n FROM ({_label_sql('orientation')} UNION ALL {_label_sql('methodology')}) GROUP BY 1, 2"


def p7_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses, texts and bands of every word of documents."""
    docs = table(spark, sf_dir, "documents")
    counts = term_counts.term_counts(docs.select(F.split("text", r"[ \t\n\f\r]+").alias("items")))
    return term_counts.band_terms(counts, docs.count())


WORDS_SQL = """WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\t\\n\\f\\r]+')) AS term FROM documents WHERE text IS NOT NULL), c AS (SELECT term, count(*) AS uses, count(DISTINCT doc_id) AS n_rows FROM w WHERE term <> '' GROUP BY 1)
 SELECT *, CASE WHEN n_rows <= 2 THEN 'rare' WHEN n_rows > 0.1 * (SELECT count(*) FROM documents) THEN 'common' ELSE 'useful' END AS band FROM c"""


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").cast("long").alias("n_tokens"))


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes in letters: every text's pieces and letters per capacity, none lost, none cut in vain."""
    got = packing.pack(_letters(spark, sf_dir), _capacities(spark, sf_dir))
    return got.groupBy("pack_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("letters"), F.max("n_tokens").alias("longest"))


PIECES_SQL = """SELECT pack_id, doc_id, ceil(length(text) / capacity_tokens::DOUBLE)::BIGINT AS pieces, length(text)::BIGINT AS letters, least(length(text), capacity_tokens)::BIGINT AS longest FROM documents, pack_capacities WHERE length(text) > 0 AND capacity_tokens > 0"""


def p9_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes in letters: share and amount wanted of every source of every mix."""
    rows = table(spark, sf_dir, "mix_targets").select("mix_id", "source", "target_share", "max_repeats").collect()  # 18 rows
    totals = {r["source"]: r["t"] for r in _letters(spark, sf_dir).filter("source is not null and n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}  # nine sources
    plan = mixing.plan_mixes([tuple(r) for r in rows], totals)
    return spark.createDataFrame([(int(p["mix_id"]), p["source"], round(p["share"], 6), round(p["want"], 3)) for p in plan], "mix_id int, source string, share double, want double")


PLAN_SQL = """WITH d AS (SELECT source, sum(length(text))::DOUBLE AS t FROM documents WHERE source IS NOT NULL AND length(text) > 0 GROUP BY 1), r AS (SELECT mix_id, source, sum(target_share) AS share, max(max_repeats) AS rep, any_value(t) AS t FROM mix_targets JOIN d USING (source) WHERE target_share > 0 AND max_repeats > 0 GROUP BY 1, 2),
 w AS (SELECT mix_id, sum(share) AS whole, min(t * rep / share) AS most FROM r GROUP BY 1) SELECT mix_id::INTEGER AS mix_id, source, round(share / whole, 6) AS share, round(least(share / whole * most * whole, t * rep), 3) AS want FROM r JOIN w USING (mix_id)"""


QUERIES = {
    "p1_found": p1_found,
    "p1_survivors": p1_survivors,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_links": p2_links,
    "p4_found": p4_found,
    "p4_mapped": p4_mapped,
    "p5_found": p5_found,
    "p5_pairs": p5_pairs,
    "p6_found": p6_found,
    "p6_consensus": p6_consensus,
    "p6_coders": p6_coders,
    "p6_agreement": p6_agreement,
    "p7_found": p7_found,
    "p7_terms": p7_terms,
    "p8_packing": p8_packing,
    "p8_report": p8_report,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_sources": p10_sources,
    "p1_latest_counts": p1_latest_counts,
    "p2_attributes": p2_attributes,
    "p4_own_names": p4_own_names,
    "p5_parts": p5_parts,
    "p6_votes": p6_votes,
    "p7_words": p7_words,
    "p8_pieces": p8_pieces,
    "p9_plan": p9_plan,
}
ORACLES: dict[str, str] = {
    "p6_agreement": AGREEMENT_SQL,
    "p1_latest_counts": LATEST_SQL,
    "p2_attributes": ATTRIBUTES_SQL,
    "p4_own_names": "SELECT ref_id AS row_id, ref_id FROM institutions_ref UNION ALL SELECT ref_id, ref_id FROM keywords_ref",
    "p5_parts": PARTS_SQL,
    "p6_votes": VOTES_SQL,
    "p7_words": WORDS_SQL,
    "p8_pieces": PIECES_SQL,
    "p9_plan": PLAN_SQL,
}
