"""Queries of the core operators over the parquet tables, each with its SQL twin where SQL can say it.

Results are rounded to six digits on both sides; rankings end in a unique key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litloom.functions import refs, text
from litloom.operators import agreement, corpus, countreg, coverage, graph, pairs, similarity, stats, temporal, topics
from litloom.runtime import cut, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.derive_fields(table(spark, sf_dir, "papers"))


# --- SQL building blocks -----------------------------------------------------


def _pieces(c: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({c}, ''), ';'), lambda x: trim(x)), lambda x: x <> '')"


def _number(c: str) -> str:
    return f"CASE WHEN regexp_full_match({c}, '\\s*[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?\\s*') THEN try_cast(trim({c}) AS DOUBLE) END"


_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in text.COUNTRY_NAMES.items()) + "}"
_BARE = "trim(regexp_replace(trim(y), '\\.$', ''))"
_COUNTRY = f"coalesce({_MAP}[lower({_BARE})], trim(regexp_replace(trim(y), '\\.+$', '')))"
_COUNTRIES = (
    "list_sort(list_distinct(list_filter(list_transform(list_transform("
    f"{_pieces('affiliations')}, lambda p: trim(regexp_replace(trim(list_extract(string_split(p, ','), -1)), '\\s*\\(.*?\\)\\s*', '', 'g'))), lambda y: {_COUNTRY}), "
    "lambda z: length(z) > 1 AND NOT regexp_full_match(z, '\\d+'))))"
)
_INSTITUTIONS = (
    f"list_sort(list_distinct(list_filter(list_transform(list_filter({_pieces('affiliations')}, lambda p: contains(p, ',')), "
    "lambda p: trim(string_split(p, ',')[1])), lambda z: length(z) > 3)))"
)
_KW = lambda c: f"list_transform({_pieces(c)}, lambda x: lower(x))"
DERIVED = f"""
derived AS (
  SELECT *, floor({_number('pub_year')})::INTEGER AS year, coalesce(floor({_number('cited_by')}), 0)::INTEGER AS cites,
    abstract IS NOT NULL AND abstract <> '[No abstract available]' AS has_abstract,
    references_text IS NOT NULL AND trim(references_text) <> '' AS has_references,
    open_access IS NOT NULL AND trim(open_access) <> '' AS is_oa,
    {_pieces('author_full_names')} AS author_list, {_pieces('author_ids')} AS author_id_list,
    list_sort(list_distinct(list_concat({_KW('author_keywords')}, {_KW('index_keywords')}))) AS all_kw,
    {_COUNTRIES} AS country_list, {_INSTITUTIONS} AS institution_list
  FROM papers WHERE {_number('pub_year')} IS NOT NULL)"""
_TITLE = "trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
_DOI = "regexp_replace(regexp_extract(lower(coalesce({0}, '')), '10\\.\\d{{4,9}}/\\S+', 0), '\\.+$', '')"
_COMPACT = "regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', '', 'g')"
_STRIP = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce({0}, ''))), '^https://doi\\.org/', ''), '^http://doi\\.org/', ''), '^doi:', ''))"
KEYED = f"""
keyed AS (
  SELECT *, CASE WHEN {_DOI.format('doi')} <> '' THEN 'doi:' || {_DOI.format('doi')}
    WHEN {_TITLE.format('title')} <> '' THEN 'ttl:' || substr({_TITLE.format('title')}, 1, 120) ELSE 'row:' || record_id END AS key FROM papers)"""


def _any(c: str, terms) -> str:
    return "(" + " OR ".join(f"contains({c}, '{t}')" for t in terms) + ")"


_SCREEN = "lower(coalesce(title, '') || ' ' || coalesce(abstract, '') || ' ' || coalesce(author_keywords, '') || ' ' || coalesce(index_keywords, ''))"
_FOCUS = "lower(coalesce(title, '') || ' ' || coalesce(author_keywords, ''))"
SCREENED = f"""
  SELECT *, coalesce(floor({_number('pub_year')}) BETWEEN 2022 AND 2026, false) AS in_years, {_any(_SCREEN, corpus.AI_TERMS)} AS has_ai,
    {_any(_SCREEN, corpus.PLAGIARISM_TERMS)} AS has_plag, {_any("lower(coalesce(document_type, ''))", corpus.EXCLUDED_TYPES)} AS bad_type,
    {_any(_FOCUS, corpus.PLAGIARISM_FOCUS)} OR {_any(_FOCUS, corpus.AI_TEXT_FOCUS)} OR (contains({_FOCUS}, 'detect') AND {_any(_FOCUS, corpus.AI_CUES)}) AS is_focus
  FROM """


# --- Projections and derived fields ------------------------------------------


@query(f"""WITH {DERIVED} SELECT record_id, year, cites, has_abstract, has_references, is_oa, len(author_list)::BIGINT AS author_count,
  len(all_kw)::BIGINT AS keyword_count, len(country_list)::BIGINT AS n_countries, len(institution_list)::BIGINT AS n_institutions FROM derived""")
def derived_fields(spark, sf_dir):
    """[P1-P10] Typed and multi-valued fields of every row with a year."""
    n = lambda c, a: F.size(c).cast("long").alias(a)
    return derived(spark, sf_dir).select(
        "record_id", "year", "cites", "has_abstract", "has_references", "is_oa", n("author_list", "author_count"), n("all_kw", "keyword_count"), n("country_list", "n_countries"), n("institution_list", "n_institutions")
    )


@query(f"SELECT record_id, {_TITLE.format('title')} AS title_key, {_COMPACT.format('title')} AS title_compact, {_DOI.format('doi')} AS doi_found, {_STRIP.format('doi')} AS doi_stripped FROM papers")
def identity_keys(spark, sf_dir):
    """[P11-P14] The four normal forms of identity."""
    c = F.col
    return table(spark, sf_dir, "papers").select("record_id", text.title_key(c("title")).alias("title_key"), text.title_compact(c("title")).alias("title_compact"), text.doi_found(c("doi")).alias("doi_found"), text.doi_stripped(c("doi")).alias("doi_stripped"))


@query(f"WITH {DERIVED} SELECT x AS country, count(*) AS n FROM (SELECT unnest(country_list) AS x FROM derived) GROUP BY 1")
def country_counts(spark, sf_dir):
    """[P8, P9, A10] Papers per country."""
    return stats.item_frequencies(derived(spark, sf_dir), "country_list").withColumnRenamed("item", "country")


@query(f"WITH {DERIVED} SELECT x AS institution, count(*) AS n FROM (SELECT unnest(institution_list) AS x FROM derived) GROUP BY 1")
def institution_counts(spark, sf_dir):
    """[P10, A10] Papers per institution."""
    return stats.item_frequencies(derived(spark, sf_dir), "institution_list").withColumnRenamed("item", "institution")


@query("""SELECT record_id, w AS word, count(*) AS n FROM (SELECT record_id, unnest(regexp_split_to_array(regexp_replace(lower(coalesce(abstract, '')), '[^a-z\\s]', '', 'g'), '\\s+')) AS w FROM papers)
 WHERE length(w) > 2 AND w NOT IN (""" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ") GROUP BY 1, 2")
def abstract_tokens(spark, sf_dir):
    """[P34] Words of abstracts with their counts."""
    d = topics.token_lists(table(spark, sf_dir, "papers"), "record_id", "abstract")
    return d.select("record_id", F.explode("words").alias("word")).groupBy("record_id", "word").agg(F.count("*").alias("n"))


@query("""SELECT cite_id, CASE WHEN d <> '' THEN d WHEN a <> '' THEN 'arxiv:' || a END AS doi, CASE WHEN regexp_full_match(p[2], '(19|20)\\d{2}') THEN p[2]::INTEGER ELSE nullif(y, '')::INTEGER END AS year,
  nullif(lower(regexp_split_to_array(p[1], '\\s+')[1]), '') AS first_author, p[3] AS token
 FROM (SELECT cite_id, list_transform(string_split(trim(cr_line), ','), lambda x: trim(x)) AS p, regexp_extract(trim(cr_line), '\\b((?:19|20)\\d{2})\\b', 1) AS y,
  regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(trim(cr_line), '(?i)10\\.\\d{4,9}/[^\\s,;\\]\\[]+', 0)), '\\.+$', ''), '\\)+$', ''), '\\]+$', '') AS d,
  regexp_extract(trim(cr_line), '(?i)arxiv[:\\s]*(\\d{4}\\.\\d{4,5})', 1) AS a FROM wos_cited)""")
def wos_reference_fields(spark, sf_dir):
    """[P18, P19] Parsed lines of cited references."""
    d = table(spark, sf_dir, "wos_cited").select("cite_id", refs.wos_reference(F.col("cr_line")).alias("r"))
    return d.select("cite_id", "r.doi", "r.year", "r.first_author", "r.token")


@query(f"""SELECT record_id, year, round(greatest({2026 + 153 / 365!r} - CASE WHEN year >= 2026 THEN year + {153 / 730!r} ELSE year + 0.5 END, 0.05)::DOUBLE, 6) AS exposure,
 round(ln(greatest({2026 + 153 / 365!r} - CASE WHEN year >= 2026 THEN year + {153 / 730!r} ELSE year + 0.5 END, 0.05)::DOUBLE), 6) AS log_exposure,
 is_oa, is_article, author_count, keyword_count, venue FROM (
 WITH {DERIVED} SELECT record_id, year, is_oa::INTEGER AS is_oa, coalesce(document_type = 'Article', false)::INTEGER AS is_article, len(author_list)::INTEGER AS author_count,
 len(all_kw)::INTEGER AS keyword_count, trim(coalesce(source_title, '(unknown venue)')) AS venue FROM derived)""")
def regression_features(spark, sf_dir):
    """[P29-P32] The frame of the citation models."""
    d = countreg.features(derived(spark, sf_dir))
    return d.select("record_id", "year", r6(F.col("exposure_years"), "exposure"), r6(F.col("log_exposure"), "log_exposure"), "is_oa", "is_article", "author_count", "keyword_count", "venue")


# --- Corpus build ------------------------------------------------------------


@query(f"""WITH {KEYED} SELECT key, max(coalesce(floor({_number('cited_by')}), 0))::INTEGER AS max_cites, bool_or(source_db = 'Scopus') AS in_scopus, bool_or(source_db = 'WoS') AS in_wos, count(*) AS group_rows,
 arg_max(record_id, (CASE WHEN (references_text IS NOT NULL AND trim(references_text) <> '') OR coalesce(len(cr_list), 0) > 0 THEN 1 ELSE 0 END)::HUGEINT * 100000000000000000000 + (CASE WHEN source_db = 'Scopus' THEN 1 ELSE 0 END)::HUGEINT * 10000000000000000000 + length(coalesce(abstract, ''))::HUGEINT * 1000000000000 - record_id) AS record_id
 FROM keyed GROUP BY key""")
def dedup_representatives(spark, sf_dir):
    """[P15, A2-A4, W1] One row per exact key."""
    g = corpus.dedup_groups(table(spark, sf_dir, "papers"), near=False)
    return corpus.representatives(g).select("key", "max_cites", "in_scopus", "in_wos", "group_rows", "record_id")


@query()
def near_title_groups(spark, sf_dir):
    """[A5, M1] Keys of all rows after nearly equal titles are merged."""
    return corpus.dedup_groups(table(spark, sf_dir, "papers")).select("record_id", "key")


@query(f"SELECT record_id, in_years, has_ai, has_plag, bad_type, is_focus, in_years AND has_ai AND has_plag AND NOT bad_type AS is_relevant FROM ({SCREENED} papers)")
def screen_flags(spark, sf_dir):
    """[F1-F6] Every screen of every row."""
    return corpus.screened(table(spark, sf_dir, "papers")).select("record_id", "in_years", "has_ai", "has_plag", "bad_type", "is_focus", "is_relevant")


_SEEDED = f"""({_DOI.format('p.doi')} <> '' AND {_DOI.format('p.doi')} IN (SELECT {_DOI.format('doi')} FROM enriched_data)) OR ({_TITLE.format('p.title')} <> '' AND {_TITLE.format('p.title')} IN (SELECT {_TITLE.format('title')} FROM enriched_data))"""


@query(f"SELECT record_id, {_SEEDED} AS is_seed FROM papers p")
def seed_membership(spark, sf_dir):
    """[F7, J4] Whether a row's DOI or title is in the seed."""
    return corpus.seed_flag(table(spark, sf_dir, "papers"), table(spark, sf_dir, "enriched_data")).select("record_id", "is_seed")


@query(f"""WITH {KEYED}, s AS (SELECT DISTINCT CASE WHEN {_DOI.format('doi')} <> '' THEN 'doi:' || {_DOI.format('doi')} WHEN {_TITLE.format('title')} <> '' THEN 'ttl:' || substr({_TITLE.format('title')}, 1, 120) ELSE 'row:' || enriched_id END AS key FROM enriched_data)
 SELECT (SELECT count(*) FROM papers) + (SELECT count(*) FROM s WHERE key NOT IN (SELECT key FROM keyed)) AS rows_after, (SELECT count(*) FROM s WHERE key NOT IN (SELECT key FROM keyed)) AS recovered""")
def seed_recovery(spark, sf_dir):
    """[J3, U2, U6] Rows after the seed's missing rows are appended."""
    p = corpus.screened(table(spark, sf_dir, "papers"))
    seed = table(spark, sf_dir, "enriched_data").select(F.col("enriched_id").alias("record_id"), "doi", "title", F.col("pub_year").cast("string").alias("pub_year"))
    return corpus.recover_seed(p, seed).agg(F.count("*").alias("rows_after"), F.count_if("recovered").alias("recovered"))


@query("SELECT record_id, 'P' || CASE WHEN length(n::VARCHAR) >= 3 THEN n::VARCHAR ELSE lpad(n::VARCHAR, 3, '0') END AS seq_id FROM (SELECT record_id, row_number() OVER (ORDER BY record_id) AS n FROM papers)")
def running_ids(spark, sf_dir):
    """[P38] Running ids in the order of record_id."""
    return corpus.numbered(table(spark, sf_dir, "papers").select("record_id"))


@query("SELECT record_id FROM papers WHERE abstract IS NOT NULL AND abstract <> '[No abstract available]'")
def papers_with_abstract(spark, sf_dir):
    """Papers that have an abstract."""
    return corpus.with_abstracts(table(spark, sf_dir, "papers")).select("record_id")


@query("SELECT source_rank, count(*) AS n FROM (SELECT 0 AS source_rank FROM papers WHERE source_db = 'Scopus' UNION ALL SELECT 1 FROM papers WHERE source_db = 'WoS') GROUP BY 1")
def united_exports(spark, sf_dir):
    """[U1] Rows of both exports as one bag."""
    p = table(spark, sf_dir, "papers")
    return corpus.united(p.filter("source_db = 'Scopus'"), p.filter("source_db = 'WoS'")).groupBy("source_rank").agg(F.count("*").alias("n"))


@query("SELECT record_id FROM papers WHERE contains(lower(title), 'watermark') OR contains(lower(abstract), 'watermark')")
def paper_search(spark, sf_dir):
    """Papers whose title or abstract contains a word."""
    return stats.search(table(spark, sf_dir, "papers"), " Watermark ", "title", "abstract").select("record_id")


# --- Descriptive statistics --------------------------------------------------


@query(f"WITH {DERIVED} SELECT year, count(*) AS n, round(avg(cites), 6) AS mean, median(cites)::DOUBLE AS median, sum(cites)::DOUBLE AS total, min(cites)::DOUBLE AS low, max(cites)::DOUBLE AS high FROM derived GROUP BY year")
def year_statistics(spark, sf_dir):
    """[A7, A14, A15] Citations per year."""
    return stats.group_summary(derived(spark, sf_dir), "year", "cites").withColumn("mean", F.round("mean", 6))


@query(f"""WITH {DERIVED} SELECT count(*) AS n, round(avg(cites), 6) AS mean, round(stddev_samp(cites), 6) AS std, min(cites)::DOUBLE AS low, quantile_cont(cites, 0.25)::DOUBLE AS q25, median(cites)::DOUBLE AS median,
 quantile_cont(cites, 0.75)::DOUBLE AS q75, max(cites)::DOUBLE AS high, count_if(cites = 0) AS zeros FROM derived""")
def citation_summary(spark, sf_dir):
    """[A12, A13] Citations overall."""
    return stats.summary(derived(spark, sf_dir), "cites").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(f"WITH {DERIVED} SELECT source_db, count_if(NOT is_oa) AS \"false\", count_if(is_oa) AS \"true\" FROM derived GROUP BY 1")
def access_by_source(spark, sf_dir):
    """[A16] Open access by source."""
    return stats.crosstab(derived(spark, sf_dir).withColumn("is_oa", F.col("is_oa").cast("string")), "source_db", "is_oa", ["false", "true"])


@query("""SELECT l AS orientation, count_if(methodology = 'computational') AS computational, count_if(methodology = 'empirical') AS empirical, count_if(methodology = 'conceptual') AS conceptual
 FROM (SELECT unnest(['technical', 'pedagogical', 'governance']) AS l) LEFT JOIN taxonomy_coding ON orientation = l GROUP BY 1""")
def label_crosstab(spark, sf_dir):
    """[A17, A18] Counts on fixed labels."""
    return stats.crosstab(table(spark, sf_dir, "taxonomy_coding"), "orientation", "methodology", ["computational", "empirical", "conceptual"], ["technical", "pedagogical", "governance"])


@query("SELECT document_type, source_db, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM papers), 6)::DOUBLE AS percent FROM papers GROUP BY 1, 2")
def type_shares(spark, sf_dir):
    """[A19, W6] Share of every document type and source."""
    return stats.cell_shares(table(spark, sf_dir, "papers"), "document_type", "source_db").withColumn("percent", F.round("percent", 6))


@query(f"WITH {DERIVED}, c AS (SELECT x, count(*)::DOUBLE AS n FROM (SELECT unnest(country_list) AS x FROM derived) GROUP BY 1) SELECT round(sum(n * n) / (sum(n) * sum(n)), 6) AS hhi, count(*) AS categories FROM c")
def country_concentration(spark, sf_dir):
    """[A25] Concentration of papers on countries."""
    return stats.concentration(stats.item_frequencies(derived(spark, sf_dir), "country_list")).withColumn("hhi", F.round("hhi", 6))


@query("SELECT round(sum(n * n) / (sum(n) * sum(n)), 6) AS hhi, count(*) AS categories FROM (SELECT n_name, count(*)::DOUBLE AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)")
def nation_concentration(spark, sf_dir):
    """[A25] The same over suppliers and nations."""
    n = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    return stats.concentration(stats.frequencies(n, "n_name")).withColumn("hhi", F.round("hhi", 6))


@query(f"""WITH {DERIVED} SELECT count(*) AS n_papers, count_if(has_abstract) AS with_abstract, count_if(has_references) AS with_references, count(author_keywords) AS with_author_keywords, count_if(is_oa) AS open_access,
 count(DISTINCT source_title) AS n_venues, sum(cites)::BIGINT AS citations, count_if(cites = 0) AS uncited, (SELECT count(DISTINCT x) FROM (SELECT unnest(author_id_list) AS x FROM derived)) AS n_author_id_list,
 (SELECT count(DISTINCT x) FROM (SELECT unnest(country_list) AS x FROM derived)) AS n_country_list, (SELECT count(DISTINCT x) FROM (SELECT unnest(institution_list) AS x FROM derived)) AS n_institution_list,
 (SELECT count(DISTINCT x) FROM (SELECT unnest(all_kw) AS x FROM derived)) AS n_all_kw FROM derived""")
def corpus_overview(spark, sf_dir):
    """[A9, A12, A21, A39-A41] Counts over the corpus."""
    return stats.corpus_counts(derived(spark, sf_dir))


@query(f"WITH {DERIVED} SELECT CASE WHEN len(author_list) <= 0 THEN 'none' WHEN len(author_list) = 1 THEN '1' WHEN len(author_list) <= 3 THEN '2-3' ELSE '4+' END AS team, count(*) AS n FROM derived GROUP BY 1")
def team_sizes(spark, sf_dir):
    """[A37] Papers per team size."""
    return stats.team_sizes(derived(spark, sf_dir))


@query("SELECT category, count(*) AS n FROM (SELECT unnest(list_filter(list_transform(string_split(coalesce(research_categories, ''), ';'), lambda x: trim(x)), lambda x: x <> '')) AS category FROM enriched_data) GROUP BY 1")
def enriched_categories(spark, sf_dir):
    """[A36] Records per research category."""
    d = table(spark, sf_dir, "enriched_data").select(text.pieces(F.col("research_categories")).alias("c"))
    return stats.item_frequencies(d, "c").withColumnRenamed("item", "category")


@query("SELECT quality_tier, count(*) AS n FROM enriched_data WHERE quality_tier IS NOT NULL GROUP BY 1")
def enriched_tiers(spark, sf_dir):
    """[A36] Records per tier."""
    return stats.frequencies(table(spark, sf_dir, "enriched_data"), "quality_tier")


@query("SELECT confidence, count(*) AS n FROM taxonomy_coding WHERE confidence IS NOT NULL GROUP BY 1")
def coding_confidence(spark, sf_dir):
    """[A20] Codings per confidence."""
    return stats.frequencies(table(spark, sf_dir, "taxonomy_coding"), "confidence")


@query(f"WITH {DERIVED} SELECT x AS item, count(*) AS n FROM (SELECT unnest(all_kw) AS x FROM derived) GROUP BY 1 ORDER BY n DESC, item LIMIT 25")
def top_keywords(spark, sf_dir):
    """[A8, T1, T2] The 25 most frequent keywords."""
    return stats.top(stats.item_frequencies(derived(spark, sf_dir), "all_kw"), 25, F.desc("n"), F.col("item"))


# --- Pairs -------------------------------------------------------------------


def _papers_items(spark, sf_dir, col: str) -> DataFrame:
    return derived(spark, sf_dir).select("record_id", F.explode(col).alias("item"))


def _pairs_sql(source: str, container: str, item: str, least: int) -> str:
    s = f"WITH {source} u AS (SELECT DISTINCT {container} AS c, {item} AS i FROM t WHERE {item} IS NOT NULL)"
    return f"{s} SELECT a.i AS src, b.i AS dst, count(*) AS weight FROM u a JOIN u b ON a.c = b.c AND a.i < b.i GROUP BY 1, 2 HAVING count(*) >= {least}"


@query(_pairs_sql(f"{DERIVED}, t AS (SELECT record_id, unnest(all_kw) AS item FROM derived),", "record_id", "item", 2))
def keyword_cooccurrence(spark, sf_dir):
    """[J9, F10] Keywords used together in two papers or more."""
    return pairs.pair_counts(_papers_items(spark, sf_dir, "all_kw"), "record_id", "item", 2)


@query(_pairs_sql(f"{DERIVED}, t AS (SELECT record_id, unnest(country_list) AS item FROM derived),", "record_id", "item", 1))
def country_collaboration(spark, sf_dir):
    """[J10] Countries on the same papers."""
    return pairs.pair_counts(_papers_items(spark, sf_dir, "country_list"), "record_id", "item")


@query(_pairs_sql("t AS (SELECT l_partkey, l_orderkey FROM lineitem),", "l_partkey", "l_orderkey", 2))
def order_coupling(spark, sf_dir):
    """[J7] Orders that share two parts or more."""
    return pairs.pair_counts(table(spark, sf_dir, "lineitem"), "l_partkey", "l_orderkey", 2)


@query(_pairs_sql("t AS (SELECT l_orderkey, l_partkey FROM lineitem),", "l_orderkey", "l_partkey", 1))
def part_cooccurrence(spark, sf_dir):
    """[J9] Parts ordered together."""
    return pairs.pair_counts(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@query(f"""WITH {DERIVED}, t AS (SELECT record_id, unnest(author_id_list) AS a, generate_subscripts(author_id_list, 1) AS p FROM derived)
 SELECT x.a AS a, y.a AS b, count(*) AS n FROM t x JOIN t y ON x.record_id = y.record_id AND x.p < y.p GROUP BY 1, 2""")
def coauthor_pairs(spark, sf_dir):
    """[J11] Ordered pairs of authors, repeats kept and counted."""
    return pairs.ordered_pairs(derived(spark, sf_dir), "author_id_list").groupBy("a", "b").agg(F.count("*").alias("n"))


@query(f"""WITH {DERIVED}, t AS (SELECT record_id, unnest(author_id_list) AS id, generate_subscripts(author_id_list, 1) AS p, author_list FROM derived)
 SELECT id, arg_min(coalesce(author_list[p], id), record_id * 100000 + p) AS name FROM t GROUP BY 1""")
def author_names(spark, sf_dir):
    """[J12] The first name of every author id."""
    return pairs.first_names(derived(spark, sf_dir), "author_id_list", "author_list", "record_id")


# --- Graphs ------------------------------------------------------------------


def _country_graph(spark, sf_dir):
    return cut(pairs.pair_counts(_papers_items(spark, sf_dir, "country_list"), "record_id", "item"))


_EDGES = f"""{DERIVED}, u AS (SELECT DISTINCT record_id AS c, unnest(country_list) AS i FROM derived),
 e AS (SELECT a.i AS src, b.i AS dst, count(*) AS weight FROM u a JOIN u b ON a.c = b.c AND a.i < b.i GROUP BY 1, 2), v AS (SELECT DISTINCT i AS id FROM u), w AS (SELECT src AS a, dst AS b, weight FROM e UNION ALL SELECT dst, src, weight FROM e)"""


def _country_vertices(spark, sf_dir):
    return _papers_items(spark, sf_dir, "country_list").select(F.col("item").alias("id")).distinct()


@query(f"WITH {_EDGES} SELECT id, count(w.a) AS degree, round(count(w.a)::DOUBLE / ((SELECT count(*) FROM v) - 1), 6) AS centrality FROM v LEFT JOIN w ON w.a = v.id GROUP BY 1")
def degree_centrality(spark, sf_dir):
    """[G4, G9, G10] Degree centrality of countries."""
    d = graph.degree_centrality(_country_graph(spark, sf_dir), _country_vertices(spark, sf_dir))
    return d.withColumn("centrality", F.round("centrality", 6))


@query(f"WITH {_EDGES} SELECT (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM e) AS m, round(2.0 * (SELECT count(*) FROM e) / ((SELECT count(*) FROM v) * ((SELECT count(*) FROM v) - 1)), 6)::DOUBLE AS density")
def graph_density(spark, sf_dir):
    """[G11] Density of the country graph."""
    return graph.size_and_density(_country_graph(spark, sf_dir), _country_vertices(spark, sf_dir)).withColumn("density", F.round("density", 6))


@query(f"""WITH {_EDGES}, d AS (SELECT a AS id, count(*) AS k FROM w GROUP BY 1), t AS (SELECT x.a AS id, count(*) / 2 AS t FROM w x JOIN w y ON x.b = y.a JOIN w z ON y.b = z.a AND z.b = x.a GROUP BY 1)
 SELECT round(avg(CASE WHEN k > 1 THEN coalesce(t, 0) * 2.0 / (k * (k - 1)) ELSE 0 END), 6)::DOUBLE AS avg_clustering FROM v LEFT JOIN d USING (id) LEFT JOIN t USING (id)""")
def average_clustering(spark, sf_dir):
    """[G12] Mean clustering of the country graph."""
    d = graph.average_clustering(_country_graph(spark, sf_dir), _country_vertices(spark, sf_dir))
    return d.withColumn("avg_clustering", F.round("avg_clustering", 6))


@query("""WITH RECURSIVE t AS (SELECT DISTINCT l_partkey AS c, l_orderkey AS i FROM lineitem), e AS (SELECT a.i AS s, b.i AS d FROM t a JOIN t b ON a.c = b.c AND a.i < b.i GROUP BY 1, 2 HAVING count(*) >= 2),
 w AS (SELECT s AS a, d AS b FROM e UNION ALL SELECT d, s FROM e), r(id, low) AS (SELECT DISTINCT a, a FROM w UNION SELECT w.b, r.low FROM r JOIN w ON w.a = r.id AND r.low < w.b)
 SELECT id, min(low) AS component FROM r GROUP BY 1""")
def components(spark, sf_dir):
    """[G13] Components of orders that share two parts or more."""
    return graph.components(pairs.pair_counts(table(spark, sf_dir, "lineitem"), "l_partkey", "l_orderkey", 2))


def _keyword_graph(spark, sf_dir):
    return cut(pairs.pair_counts(_papers_items(spark, sf_dir, "all_kw"), "record_id", "item", 2))


def _keyword_counts(spark, sf_dir):
    return _papers_items(spark, sf_dir, "all_kw").groupBy(F.col("item").alias("id")).agg(F.count("*").alias("n"))


@query()
def louvain_communities(spark, sf_dir):
    """[G3, G16] Communities of the keyword graph."""
    return graph.louvain(_keyword_graph(spark, sf_dir))


@query()
def louvain_without_seed_terms(spark, sf_dir):
    """[F17, G20] The same without the terms of the search itself."""
    # The terms of the search itself.
    seeds = ["artificial intelligence", "plagiarism", "plagiarism detection", "ai", "generative ai", "artificial intelligence (ai)"]
    return graph.louvain(graph.without(_keyword_graph(spark, sf_dir), seeds))


_KWE = f"{DERIVED}, u AS (SELECT DISTINCT record_id AS c, unnest(all_kw) AS i FROM derived), e AS (SELECT a.i AS src, b.i AS dst, count(*) AS weight FROM u a JOIN u b ON a.c = b.c AND a.i < b.i GROUP BY 1, 2 HAVING count(*) >= 2), n AS (SELECT i AS id, count(*) AS n FROM u GROUP BY 1)"


@query(f"""WITH {_KWE}, j AS (SELECT substr(src, 1, 1) AS cs, substr(dst, 1, 1) AS cd, weight::DOUBLE AS w FROM e), m AS (SELECT sum(w) AS m FROM j), d AS (SELECT c, sum(w) AS deg FROM (SELECT cs AS c, w FROM j UNION ALL SELECT cd, w FROM j) GROUP BY 1), i AS (SELECT cs AS c, sum(w) AS ins FROM j WHERE cs = cd GROUP BY 1)
 SELECT round(sum(coalesce(ins, 0) / m - (deg / (2 * m)) * (deg / (2 * m))), 6) AS modularity FROM d LEFT JOIN i USING (c), m""")
def modularity_by_initial(spark, sf_dir):
    """[G17] Modularity of the keyword graph under a given partition (first letters)."""
    e = _keyword_graph(spark, sf_dir)
    members = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("community", F.substring("id", 1, 1))
    return graph.modularity(e, members).withColumn("modularity", F.round("modularity", 6))


@query(f"""WITH {_KWE}, m AS (SELECT DISTINCT id, substr(id, 1, 1) AS community FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e)), j AS (SELECT substr(src, 1, 1) AS cs, substr(dst, 1, 1) AS cd, weight * weight / (a.n * b.n)::DOUBLE AS x FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst),
 c AS (SELECT community, count(*) AS size FROM m GROUP BY 1), i AS (SELECT cs AS community, avg(x) AS v FROM j WHERE cs = cd GROUP BY 1), o AS (SELECT community, sum(x) AS v FROM (SELECT cs AS community, x FROM j WHERE cs <> cd UNION ALL SELECT cd, x FROM j WHERE cs <> cd) GROUP BY 1),
 z AS (SELECT community, size, round(10 * coalesce(o.v, 0), 6)::DOUBLE AS centrality, round(100 * coalesce(i.v, 0), 6)::DOUBLE AS density FROM c LEFT JOIN i USING (community) LEFT JOIN o USING (community))
 SELECT *, CASE WHEN centrality >= (SELECT median(centrality) FROM z) AND density >= (SELECT median(density) FROM z) THEN 'motor' WHEN density >= (SELECT median(density) FROM z) THEN 'niche' WHEN centrality >= (SELECT median(centrality) FROM z) THEN 'basic/transversal' ELSE 'emerging/declining' END AS quadrant FROM z""")
def callon_quadrants(spark, sf_dir):
    """[G18, G19, W5] Callon diagram of a given partition (first letters)."""
    e = _keyword_graph(spark, sf_dir)
    members = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("community", F.substring("id", 1, 1))
    d = graph.callon(e, members, _keyword_counts(spark, sf_dir)).select("community", "size", r6(F.col("centrality"), "centrality"), r6(F.col("density"), "density"))
    return stats.median_split(cut(d), "centrality", "density")


# --- Time --------------------------------------------------------------------


@query(f"""WITH {DERIVED}, k AS (SELECT year, unnest(all_kw) AS i FROM derived), y AS (SELECT year, dense_rank() OVER (ORDER BY year) AS p FROM (SELECT DISTINCT year FROM derived)), g AS (SELECT i AS item, count(*) AS total, min(year) AS first_year, max(year) AS last_year,
 count_if(p <= 2) AS early, count_if(p > 2) AS late FROM k JOIN y USING (year) GROUP BY 1 HAVING count(*) >= 2), r AS (SELECT *, round(CASE WHEN early > 0 THEN (late - early) / early::DOUBLE WHEN late > 0 THEN 999 ELSE 0 END, 6)::DOUBLE AS growth_rate FROM g)
 SELECT *, CASE WHEN early = 0 AND late > 0 THEN 'emerging' WHEN early > 0 AND late = 0 THEN 'declining' WHEN growth_rate > 0 AND growth_rate < 999 AND total >= 3 THEN 'bursting' ELSE 'stable' END AS class FROM r""")
def keyword_bursts(spark, sf_dir):
    """[A31, W3, F14] Growth and class of keywords."""
    d = derived(spark, sf_dir)
    g = temporal.growth(d.select("year", F.explode("all_kw").alias("item")), "year", "item")
    return temporal.burst_classes(g.withColumn("growth_rate", F.round("growth_rate", 6)))


_TOPS = f"{DERIVED}, k AS (SELECT year, unnest(all_kw) AS item FROM derived), c AS (SELECT year, item, count(*) AS n FROM k GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, item)::INTEGER AS rank FROM c QUALIFY rank <= 10)"


@query(f"WITH {_TOPS} SELECT * FROM t")
def yearly_top_keywords(spark, sf_dir):
    """[W4] Ten keywords per year."""
    return temporal.top_items_per_year(derived(spark, sf_dir).select("year", F.explode("all_kw").alias("item")), "year", "item")


@query(f"WITH {_TOPS} SELECT a.item, b.year, coalesce(t.n, 0) AS n FROM (SELECT DISTINCT item FROM t) a CROSS JOIN (SELECT DISTINCT year FROM t) b LEFT JOIN t ON t.item = a.item AND t.year = b.year")
def theme_matrix(spark, sf_dir):
    """[U7] Yearly top keywords as a filled matrix."""
    return temporal.theme_matrix(cut(yearly_top_keywords(spark, sf_dir)))


@query(f"""WITH {DERIVED}, f AS (SELECT i, min(year) AS y FROM (SELECT year, unnest(all_kw) AS i FROM derived) GROUP BY 1) SELECT year, (SELECT count(*) FROM f WHERE y <= year) AS n_keywords FROM (SELECT DISTINCT year FROM derived)""")
def cumulative_keywords(spark, sf_dir):
    """[W2, F24] Distinct keywords up to each year."""
    d = derived(spark, sf_dir)
    return temporal.cumulative_counts(d.select("year", F.explode_outer("all_kw").alias("item")), "year", "item", "n_keywords")


@query(f"""WITH {DERIVED}, a AS (SELECT record_id, year, unnest(author_id_list) AS id, generate_subscripts(author_id_list, 1) AS p FROM derived), v AS (SELECT id, min(year) AS y FROM a GROUP BY 1),
 e AS (SELECT least(x.id, z.id) AS s, greatest(x.id, z.id) AS d, min(x.year) AS y FROM a x JOIN a z ON x.record_id = z.record_id AND x.p < z.p WHERE x.id <> z.id GROUP BY 1, 2), q AS (SELECT year, (SELECT count(*) FROM v WHERE y <= year) AS n, (SELECT count(*) FROM e WHERE y <= year) AS m FROM (SELECT DISTINCT y AS year FROM v))
 SELECT year, n, m, round(CASE WHEN n > 1 THEN 2.0 * m / (n * (n - 1)) ELSE 0 END, 6)::DOUBLE AS density, round(2.0 * m / n, 6)::DOUBLE AS avg_degree FROM q""")
def coauthor_series(spark, sf_dir):
    """[A35, G5] The co-author network up to each year."""
    d = derived(spark, sf_dir)
    e = d.select("year", F.col("author_id_list").alias("x"), F.posexplode("author_id_list").alias("p", "src")).select("year", "src", F.explode(F.slice("x", F.col("p") + 2, F.size("x"))).alias("dst")).filter("src <> dst")
    s = temporal.network_series(e, d.select("year", F.explode("author_id_list").alias("id")))
    return s.select("year", "n", "m", r6(F.col("density"), "density"), r6(F.col("avg_degree"), "avg_degree"))


@query("SELECT year(o_orderdate)::INTEGER AS year, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1")
def order_years(spark, sf_dir):
    """[A14] Orders per year."""
    d = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    s = stats.group_summary(d, "year", "o_totalprice")
    return s.withColumns({"mean": F.round("mean", 4), "median": F.round("median", 4), "total": F.round("total", 2)})


# --- Agreement ---------------------------------------------------------------

LABELS = ["technical", "pedagogical", "governance"]


def _coder(spark, sf_dir, who: str) -> DataFrame:
    """Each paper's coding by one coder with the largest id."""
    d = table(spark, sf_dir, "taxonomy_coding").filter(F.col("coder_id") == who)
    return d.groupBy("paper_id").agg(F.max_by(F.struct("orientation", "methodology"), "coding_id").alias("x")).select("paper_id", "x.*")


_CODERS = "c AS (SELECT coder_id, paper_id, arg_max(coding_id, coding_id) AS k FROM taxonomy_coding GROUP BY 1, 2), f AS (SELECT t.* FROM taxonomy_coding t JOIN c ON t.coding_id = c.k), p AS (SELECT a.paper_id, a.orientation AS a, b.orientation AS b, a.methodology AS ma, b.methodology AS mb FROM f a JOIN f b USING (paper_id) WHERE a.coder_id = 'coder_01' AND b.coder_id = 'coder_02')"
_L = "('technical', 'pedagogical', 'governance')"


@query(f"""WITH {_CODERS}, n AS (SELECT count(*) AS n, avg(coalesce((a = b)::INTEGER, 0)) AS agreement, count_if(a = b AND a IN {_L}) AS same FROM p), q AS (SELECT * FROM p WHERE a IN {_L} AND b IN {_L}),
 e AS (SELECT sum(x.k * y.k)::DOUBLE AS s FROM (SELECT a AS l, count(*) AS k FROM q GROUP BY 1) x JOIN (SELECT b AS l, count(*) AS k FROM q GROUP BY 1) y USING (l)) SELECT n, round(agreement, 6)::DOUBLE AS agreement, round((same / n::DOUBLE - s / (n * n)) / (1 - s / (n * n)), 6) AS kappa FROM n, e""")
def coder_kappa(spark, sf_dir):
    """[A22, A23, J15] Agreement of two coders."""
    d = agreement.kappa(agreement.paired(_coder(spark, sf_dir, "coder_01"), _coder(spark, sf_dir, "coder_02"), "paper_id", "orientation"), LABELS)
    return d.select("n", r6(F.col("agreement"), "agreement"), r6(F.col("kappa"), "kappa"))


@query(f"WITH {_CODERS} SELECT l AS a, count_if(b = 'technical') AS technical, count_if(b = 'pedagogical') AS pedagogical, count_if(b = 'governance') AS governance FROM (SELECT unnest(['technical', 'pedagogical', 'governance']) AS l) LEFT JOIN p ON a = l GROUP BY 1")
def coder_confusion(spark, sf_dir):
    """[A22] Labels of one coder against the other's."""
    return agreement.confusion(agreement.paired(_coder(spark, sf_dir, "coder_01"), _coder(spark, sf_dir, "coder_02"), "paper_id", "orientation"), LABELS)


@query(f"WITH {_CODERS} SELECT paper_id, a AS orientation_a, b AS orientation_b, ma AS methodology_a, mb AS methodology_b FROM p WHERE a IS DISTINCT FROM b OR ma IS DISTINCT FROM mb")
def coder_disagreements(spark, sf_dir):
    """Papers on which two coders differ."""
    d = agreement.disagreements(_coder(spark, sf_dir, "coder_01"), _coder(spark, sf_dir, "coder_02"), "paper_id", ["orientation", "methodology"])
    return d.select("paper_id", "orientation_a", "orientation_b", "methodology_a", "methodology_b")


@query(f"WITH {_CODERS}, x AS (SELECT * FROM f WHERE coder_id = 'coder_01'), y AS (SELECT * FROM f WHERE coder_id = 'coder_02') SELECT coalesce(x.paper_id, y.paper_id) AS paper_id, CASE WHEN x.paper_id IS NOT NULL THEN x.orientation ELSE y.orientation END AS orientation, CASE WHEN x.paper_id IS NOT NULL THEN x.methodology ELSE y.methodology END AS methodology FROM x FULL JOIN y ON x.paper_id = y.paper_id")
def merged_codings(spark, sf_dir):
    """[J16] Codings of two coders, the first one's first."""
    return agreement.merged(_coder(spark, sf_dir, "coder_01"), _coder(spark, sf_dir, "coder_02"), "paper_id", ["orientation", "methodology"])


@query("""WITH n AS (SELECT source, lang, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2) SELECT source, sum(n)::BIGINT AS size, arg_min(lang, -n * 1000 + ascii(lang)) AS top_label, round(1 - max(n) / sum(n), 6)::DOUBLE AS impurity FROM n GROUP BY 1""")
def source_impurity(spark, sf_dir):
    """[A24, F18] How mixed the languages of a source are."""
    d = agreement.comparable(table(spark, sf_dir, "documents"), "source", "lang")
    return agreement.impurity(d, "source", "lang").withColumn("impurity", F.round("impurity", 6))


@query("SELECT paper_id, arg_min(orientation, -n * 1000 + ascii(orientation)) AS orientation FROM (SELECT paper_id, orientation, count(*) AS n FROM taxonomy_coding WHERE orientation IN ('technical', 'pedagogical', 'governance') GROUP BY 1, 2) GROUP BY 1")
def majority_labels(spark, sf_dir):
    """[A32] The most frequent label of every paper."""
    return agreement.label_votes(table(spark, sf_dir, "taxonomy_coding").filter(F.col("orientation").isin(*LABELS)), "paper_id", "orientation")


# --- Coverage ----------------------------------------------------------------


@query(f"""WITH c AS (SELECT * FROM papers WHERE source_db = 'Scopus'), f AS (SELECT {_STRIP.format('doi')} AS d, {_COMPACT.format('title')} AS t FROM enriched_data),
 h AS (SELECT (d <> '' AND d IN (SELECT {_STRIP.format('doi')} FROM c)) OR (t <> '' AND t IN (SELECT {_COMPACT.format('title')} FROM c)) AS core, (d <> '' AND d IN (SELECT {_STRIP.format('doi')} FROM papers)) OR (t <> '' AND t IN (SELECT {_COMPACT.format('title')} FROM papers)) AS ext FROM f)
 SELECT count(*) AS n, count_if(core) AS in_core, count_if(ext) AS in_extended, round(count_if(core) / count(*)::DOUBLE, 6) AS core_share FROM h""")
def corpus_overlap(spark, sf_dir):
    """[J5, J6, U3] Enriched records found among Scopus rows and among all rows."""
    p = table(spark, sf_dir, "papers")
    core = cut(coverage.key_sets(p.filter("source_db = 'Scopus'")))
    ext = coverage.key_sets(p.filter("source_db = 'WoS'")).union(core).distinct()
    return coverage.overlap(table(spark, sf_dir, "enriched_data"), core, ext).withColumn("core_share", F.round("core_share", 6))


_TERMS = ("watermark", "perplexity", "stylometric", "keystroke")


@query(f"WITH t AS (SELECT {_SCREEN} AS t FROM papers) SELECT count(*) AS papers, count_if({_any('t', _TERMS)}) AS naming_a_tool, count_if({_any('t', _TERMS)} AND NOT {_any('t', coverage.GENERAL_TERMS)}) AS without_general_term, " + ", ".join(f"count_if(contains(t, '{x}')) AS tool_{x}" for x in _TERMS) + f", round(count_if({_any('t', _TERMS)} AND NOT {_any('t', coverage.GENERAL_TERMS)}) / nullif(count_if({_any('t', _TERMS)}), 0)::DOUBLE, 6) AS share_without FROM t")
def tool_mentions(spark, sf_dir):
    """[A26, A28, F13] Papers naming techniques, with and without a general term."""
    return coverage.tool_mentions(table(spark, sf_dir, "papers"), _TERMS).withColumn("share_without", F.round("share_without", 6))


@query("SELECT trim(string_split(coalesce(orig_language, '(unspecified)'), ';')[1]) AS language, count(*) AS n FROM papers GROUP BY 1")
def language_counts(spark, sf_dir):
    """[A27, P33] Rows per first language."""
    return coverage.languages(table(spark, sf_dir, "papers"))


@query("SELECT count(*) AS n, count_if(l = 'english') AS english, round((count(*) - count_if(l = 'english')) / count(*)::DOUBLE, 6) AS non_english_share FROM (SELECT lower(trim(string_split(coalesce(orig_language, '(unspecified)'), ';')[1])) AS l FROM papers)")
def language_share(spark, sf_dir):
    """[A27] Share of other languages than English."""
    return coverage.language_share(table(spark, sf_dir, "papers")).withColumn("non_english_share", F.round("non_english_share", 6))


@query("SELECT count(*) AS n, count_if(document_type = 'Article') AS matching, round(count_if(document_type = 'Article') / count(*)::DOUBLE, 6) AS share FROM papers")
def article_share(spark, sf_dir):
    """[A30] Share of one document type."""
    return coverage.type_share(table(spark, sf_dir, "papers"), "document_type", "Article").withColumn("share", F.round("share", 6))


# --- Knowledge graph ---------------------------------------------------------

_KG = f"{DERIVED}, k AS (SELECT record_id, unnest(all_kw) AS kw FROM derived), s AS (SELECT kw FROM k GROUP BY 1 HAVING count(*) >= 2)"


# --- Similarity, topics, regression ------------------------------------------


@query("""SELECT count(*) AS n_pairs, round(avg(c), 5) AS mean, round(stddev_pop(c), 5) AS deviation FROM (SELECT list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)""")
def cosine_moments(spark, sf_dir):
    """[M3, A34] Mean and deviation of all pairwise cosines."""
    return similarity.pair_moments(table(spark, sf_dir, "embeddings"), "embedding").select("n_pairs", F.round("mean", 5).alias("mean"), F.round("deviation", 5).alias("deviation"))


@query("""WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i, label FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM v GROUP BY 1, 2),
 d AS (SELECT v.vec_id, c.label AS cluster, sqrt(sum((x - m) * (x - m))) AS distance FROM v JOIN c USING (i) GROUP BY 1, 2) SELECT vec_id, arg_min(cluster, distance) AS cluster, round(min(distance), 5) AS distance FROM d GROUP BY 1""")
def nearest_centroids(spark, sf_dir):
    """[M20] The nearest class centre of every vector."""
    e = table(spark, sf_dir, "embeddings")
    v = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = v.groupBy(F.col("label").alias("cluster")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("center"))
    return similarity.nearest_centroid(e, "vec_id", "embedding", centres).withColumn("distance", F.round("distance", 5))


@query("""WITH w AS (SELECT source, unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-z\\s]', '', 'g'), '\\s+')) AS word FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
 t AS (SELECT source, word, count(*) AS tf FROM w WHERE length(word) > 2 AND word NOT IN (""" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + """) GROUP BY 1, 2), f AS (SELECT word, sum(tf) AS f FROM t GROUP BY 1), z AS (SELECT source, sum(tf) AS size FROM t GROUP BY 1),
 s AS (SELECT t.source, t.word, t.tf / z.size::DOUBLE * ln(1 + (SELECT avg(size) FROM z) / f.f) AS score FROM t JOIN f USING (word) JOIN z USING (source)) SELECT source, word, row_number() OVER (PARTITION BY source ORDER BY round(score, 12) DESC, word)::INTEGER AS rank FROM s QUALIFY rank <= 10""")
def source_words(spark, sf_dir):
    """[M7] The ten words of largest class tf-idf of every source."""
    d = table(spark, sf_dir, "documents").filter("source is not null and text is not null")
    names = sorted(r["source"] for r in d.select("source").distinct().collect())  # nine sources
    numbered = d.withColumn("topic", F.array_position(F.array(*[F.lit(n) for n in names]), F.col("source")).cast("int"))
    w = topics.topic_words(topics.token_lists(d, "doc_id", "text"), numbered.select("doc_id", "topic"), "doc_id")
    named = w.withColumn("source", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("topic")))
    return named.select("source", F.posexplode("words").alias("p", "word")).select("source", "word", (F.col("p") + 1).alias("rank"))


@query()
def document_topics(spark, sf_dir):
    """[M2, M4-M6] Topics of documents with outliers."""
    lists = topics.token_lists(table(spark, sf_dir, "documents"), "doc_id", "text")
    return topics.clusters(cut(topics.vectors(lists, "doc_id")), "doc_id")


@query()
def document_topic_years(spark, sf_dir):
    """[M11, A17, F11, J2] Topics per year."""
    years = table(spark, sf_dir, "documents").select("doc_id", F.col("pub_year").alias("year"))
    return topics.topic_years(document_topics(spark, sf_dir), years, "doc_id")


@query()
def lda_coherence(spark, sf_dir):
    """[M8-M10] Coherence of LDA models per number of topics; the best one's topics, refitted, stand in its row."""
    lists = topics.token_lists(table(spark, sf_dir, "documents"), "doc_id", "text")
    scores, words = topics.lda_sweep(cut(lists))
    lines = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("topic", "line"))), lambda t: t["line"]).alias("topics"))
    return scores.join(F.broadcast(lines), F.col("best"), "left")


FEATURES = ["author_count", "is_oa", "is_article", "keyword_count"]


@query()
def citation_model(spark, sf_dir):
    """[M12, M16] NB2 with the years since publication."""
    d = cut(countreg.features(derived(spark, sf_dir)))
    return countreg.fit_nb(d, "cites", ["years_since", *FEATURES]).table(spark)


@query()
def citation_model_offset(spark, sf_dir):
    """[M13, M14, M16] NB2 with a log-exposure offset and errors clustered by venue."""
    d = cut(countreg.features(derived(spark, sf_dir)))
    return countreg.fit_nb(d, "cites", FEATURES, offset="log_exposure", cluster="venue").table(spark)


@query()
def citation_model_inflated(spark, sf_dir):
    """[M15, M16] Zero-inflated NB2."""
    d = cut(countreg.features(derived(spark, sf_dir)))
    return countreg.fit_nb(d, "cites", ["years_since", *FEATURES], inflated=True).table(spark)


@query()
def citation_criteria(spark, sf_dir):
    """[M18] Log-likelihood and criteria of the two NB2 models."""
    d = cut(countreg.features(derived(spark, sf_dir)))
    a, b = countreg.fit_nb(d, "cites", ["years_since", *FEATURES]), countreg.fit_nb(d, "cites", FEATURES, offset="log_exposure")
    return spark.createDataFrame([(n, m.n, float(m.llf), float(m.aic), float(m.bic)) for n, m in (("covariate", a), ("offset", b))], "model string, n long, llf double, aic double, bic double")


@query(f"""WITH {DERIVED} SELECT count(*) AS n, count_if(cites = 0) AS observed_zeros, round(sum(pow(1 / (1 + 1.5 * exp(0.5 + 0.1 * len(author_list) - 0.2 * is_oa::INTEGER)), 1 / 1.5)), 4)::DOUBLE AS predicted_zeros FROM derived""")
def predicted_zeros(spark, sf_dir):
    """[M17, M19] Zeros observed and expected under given coefficients."""
    d = countreg.features(derived(spark, sf_dir))
    return countreg.predicted_zeros(d, {"Intercept": 0.5, "author_count": 0.1, "is_oa": -0.2}, 1.5).withColumn("predicted_zeros", F.round("predicted_zeros", 4))
