"""Queries over cited works, identities, tiers and small projections, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from litloom.functions import refs, text
from litloom.operators import agreement, corpus, countreg, coverage, graph, pairs, stats, temporal, topics
from litloom.plans.reference import _DOI, _EDGES, _KWE, _SCREEN, _SEEDED, _TITLE, _TOPS, DERIVED, KEYED, SCREENED, _any, _country_graph, _country_vertices, _keyword_counts, _keyword_graph, _pairs_sql, _pieces, derived, query, r6, yearly_top_keywords
from litloom.runtime import cut, stored, table

# --- SQL building blocks: parsed references of every row ----------------------

_SEGMENTS = (
    "CASE WHEN coalesce(trim(references_text), '') = '' OR len({p}) = 0 THEN [] ELSE string_split(regexp_replace(array_to_string(list_transform({p}, lambda x: "
    "CASE WHEN regexp_matches(x, '^[A-Z][a-z]+\\s+[A-Z]') THEN chr(1) ELSE '; ' END || x), ''), '^(\\x01|; )', ''), chr(1)) END"
).format(p=_pieces("references_text"))


def _parsed(raw: str) -> str:
    """DOI or arXiv id of a raw reference."""
    d = f"regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract({raw}, '(?i)10\\.\\d{{4,9}}/[^\\s,;\\]\\[]+', 0)), '\\.+$', ''), '\\)+$', ''), '\\]+$', '')"
    a = f"regexp_extract({raw}, '(?i)arxiv[:\\s]*(\\d{{4}}\\.\\d{{4,5}})', 1)"
    return f"CASE WHEN {d} <> '' THEN {d} WHEN {a} <> '' THEN 'arxiv:' || {a} END"


_SCOPUS = f"""SELECT record_id, pos, raw, {_parsed('raw')} AS doi, nullif(regexp_extract(raw, '\\((\\d{{4}})\\)', 1), '')::INTEGER AS year,
  nullif(trim(regexp_extract(raw, '^([A-Z][a-z]+(?:\\s+[A-Z]\\.?(?:\\s*[A-Z]\\.?)*)?)', 1)), '') AS first_author,
  substr(list_filter(list_transform(string_split(raw, ','), lambda x: trim(x))[2:4], lambda x: length(x) > 20 AND NOT regexp_full_match(x, '\\d+') AND NOT contains(x, 'pp.'))[1], 1, 100) AS token"""
_KEY = """CASE WHEN doi IS NOT NULL THEN 'doi:' || doi WHEN regexp_replace(lower(coalesce(first_author, '')), '[^a-z]', '', 'g') <> '' AND year IS NOT NULL THEN 'ay:' || regexp_replace(lower(coalesce(first_author, '')), '[^a-z]', '', 'g') || '|' || year
   || CASE WHEN len(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(token, '')), '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda w: w <> '')) > 0
    THEN '|' || array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(token, '')), '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda w: w <> '')[1:3], ' ') ELSE '' END END"""
_TITLED = "array_to_string(list_transform(regexp_extract_all(regexp_replace(coalesce(first_author, ''), '\\s+', ' ', 'g'), '[A-Za-zÀ-ÿ]+|[^A-Za-zÀ-ÿ]+'), lambda w: upper(w[1]) || lower(w[2:])), '')"
_LABEL = f"CASE WHEN {_TITLED} <> '' OR year IS NOT NULL THEN {_TITLED} || ' (' || coalesce(year::VARCHAR, '') || ')' ELSE substr(raw, 1, 40) END"
_SEGMENTED = f"SELECT record_id, unnest(s) AS raw, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT record_id, {_SEGMENTS} AS s FROM papers"
REFS = f"""
lines AS (SELECT record_id, pos, trim(l) AS raw, list_transform(string_split(trim(l), ','), lambda x: trim(x)) AS p FROM (SELECT record_id, unnest(cr_list) AS l, generate_subscripts(cr_list, 1) - 1 AS pos FROM papers WHERE source_db = 'WoS' AND len(cr_list) > 0)),
parsed AS (
 {_SCOPUS} FROM ({_SEGMENTED} WHERE NOT coalesce(source_db = 'WoS' AND len(cr_list) > 0, false)))
 UNION ALL SELECT record_id, pos, raw, {_parsed('raw')}, CASE WHEN regexp_full_match(p[2], '(19|20)\\d{{2}}') THEN p[2]::INTEGER ELSE nullif(regexp_extract(raw, '\\b((?:19|20)\\d{{2}})\\b', 1), '')::INTEGER END,
  nullif(lower(regexp_split_to_array(p[1], '\\s+')[1]), ''), p[3] FROM lines),
works AS (SELECT record_id, pos, raw, {_KEY} AS key, {_LABEL} AS label FROM parsed)"""


def _works(spark, sf_dir):
    """``record_id, item``: keys of the works that each row of either database cites, repeats kept."""
    return corpus.reference_keys(table(spark, sf_dir, "papers")).select("record_id", F.explode("ref_keys").alias("item"))


@query(f"SELECT record_id, pos::INTEGER AS pos, doi, year, first_author, token, {_KEY} AS key, {_LABEL} AS label FROM ({_SCOPUS} FROM ({_SEGMENTED} WHERE source_db = 'Scopus')))")
def scopus_reference_fields(spark, sf_dir):
    """[P20-P23] Segmented and parsed Scopus reference strings, with key and label."""
    d = table(spark, sf_dir, "papers").filter("source_db = 'Scopus'").select("record_id", F.posexplode(refs.scopus_references(F.col("references_text"))).alias("pos", "r"))
    return d.select("record_id", "pos", "r.doi", "r.year", "r.first_author", "r.token", refs.cited_key(F.col("r")).alias("key"), refs.reference_label(F.col("r")).alias("label"))


_CHUNKS = f"""c AS (SELECT row_number() OVER () AS record_id, c FROM (SELECT unnest(string_split(regexp_replace(coalesce(references_text, ''), '(\\(\\d{{4}}\\));\\s*', '\\1' || chr(1), 'g'), chr(1))) AS c FROM papers WHERE source_db = 'Scopus')),
 ck AS (SELECT record_id, {_KEY} AS key FROM ({_SCOPUS} FROM ({_SEGMENTED.replace('FROM papers', 'FROM (SELECT record_id, c AS references_text FROM c)')})))),
 cl AS (SELECT key, CASE WHEN length(name) BETWEEN 1 AND 40 AND y <> '' THEN name || ' (' || y || ')' END AS l FROM (SELECT key, regexp_replace(trim(regexp_split_to_array(c, '[;,]')[1]), '^(\\S+)\\s+([A-Z])[a-z]+$', '\\1 \\2.') AS name,
  regexp_extract(c, '\\((\\d{{4}})\\)\\s*$', 1) AS y FROM c JOIN (SELECT record_id, min(key) AS key FROM ck WHERE key IS NOT NULL GROUP BY 1 HAVING count(*) = 1) USING (record_id))),
 first AS (SELECT key, l AS first_label FROM (SELECT key, l, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, l) AS r FROM cl WHERE l IS NOT NULL GROUP BY 1, 2) WHERE r = 1)"""


@query(f"""WITH {REFS}, stored AS (SELECT key, label FROM (SELECT key, label, row_number() OVER (PARTITION BY key ORDER BY record_id DESC, pos) AS r FROM works WHERE key IS NOT NULL) WHERE r = 1), {_CHUNKS}
 SELECT key, coalesce(first_label, CASE WHEN trim(label) <> '' THEN label END, key) AS label FROM stored LEFT JOIN first USING (key)""")
def cited_work_labels(spark, sf_dir):
    """[P24-P28, K4, A32] Display labels of the cited works of all rows."""
    p = corpus.with_references(table(spark, sf_dir, "papers"))
    stored = corpus.label_map(p)
    chunks = p.filter("source_db = 'Scopus'").select(F.explode(refs.reference_chunks(F.col("references_text"))).alias("c"))
    one = chunks.withColumn("k", refs.cited_keys(refs.scopus_references(F.col("c")))).filter(F.size("k") == 1)
    first = agreement.label_votes(one.select(F.col("k")[0].alias("key"), refs.chunk_label(F.col("c")).alias("first_label")), "key", "first_label")
    d = stored.join(first, "key", "left")
    return d.select("key", refs.display_label(F.col("key"), F.col("first_label"), F.col("label")).alias("label"))


@query(_pairs_sql(f"{REFS}, t AS (SELECT record_id, key AS item FROM works WHERE key IS NOT NULL),", "item", "record_id", 2))
def coupling_edges(spark, sf_dir):
    """[J7, J19, F12, G1] Papers of either database that share two cited works or more."""
    keys = stored(corpus.reference_keys(table(spark, sf_dir, "papers")).select("record_id", "ref_keys"))  # else parsed once more to drop empty lists
    return pairs.coupled(keys.select("record_id", F.explode("ref_keys").alias("item")), "item", "record_id")


@query(f"""WITH {REFS}, t AS (SELECT record_id, key AS item FROM works WHERE key IS NOT NULL), k AS (SELECT item FROM t GROUP BY 1 ORDER BY count(*) DESC, item LIMIT 30), u AS (SELECT DISTINCT record_id AS c, item AS i FROM t WHERE item IN (SELECT item FROM k))
 SELECT a.i AS src, b.i AS dst, count(*) AS weight FROM u a JOIN u b ON a.c = b.c AND a.i < b.i GROUP BY 1, 2""")
def cocitation_top30(spark, sf_dir):
    """[A11, J8, G2] Co-citation among the thirty works cited most."""
    return pairs.among_top(_works(spark, sf_dir), "record_id", "item", 30)


@query(f"WITH {REFS} SELECT key AS item, count(*) AS n FROM works WHERE key IS NOT NULL GROUP BY 1")
def cited_work_counts(spark, sf_dir):
    """[A11] Occurrences of every cited work."""
    return stats.frequencies(_works(spark, sf_dir), "item")


@query(f"WITH {REFS} SELECT (SELECT count(*) FROM papers) AS n_papers, count(DISTINCT record_id) AS with_refs, count(*) AS total_refs, count(DISTINCT key) AS distinct_works FROM works WHERE key IS NOT NULL")
def reference_totals(spark, sf_dir):
    """[A40, A41] Papers with references, references and distinct works."""
    return stats.reference_counts(corpus.reference_keys(table(spark, sf_dir, "papers")))


# --- Identity, tiers, funnel ----------------------------------------------------


@query(f"""SELECT record_id, array_to_string(list_transform({_pieces('author_full_names')}, lambda x: trim(regexp_replace(trim(string_split(x, '(')[1]), ',+$', ''))), '|') AS names,
 array_to_string(list_transform({_pieces('author_full_names')}, lambda x: regexp_replace(lower(trim(x)), '\\s+', ' ', 'g')), '|') AS pseudo_ids,
 array_to_string(list_transform({_pieces('affiliations')}, lambda x: trim(regexp_replace(x, '^\\[[^\\]]*\\]\\s*', ''))), '|') AS places FROM papers""")
def cleaned_names(spark, sf_dir):
    """[P16, P17, P36] Author names without remarks, their pseudo-ids, and affiliations without names in brackets."""
    c = F.col
    d = table(spark, sf_dir, "papers").select("record_id", text.pieces(c("author_full_names")).alias("n"), text.pieces(c("affiliations")).alias("a"))
    line = lambda x: F.array_join(x, "|")
    return d.select("record_id", line(F.transform("n", text.clean_name)).alias("names"), line(F.transform("n", text.author_pseudo_id)).alias("pseudo_ids"), line(F.transform("a", text.without_bracket)).alias("places"))


@query(f"SELECT record_id, is_focus, is_seed, is_focus OR is_seed AS is_core FROM ({SCREENED} (SELECT p.*, {_SEEDED} AS is_seed FROM papers p))")
def corpus_tiers(spark, sf_dir):
    """[F8] Focus papers and seed papers together are the core tier."""
    d = corpus.tiers(corpus.seed_flag(corpus.screened(table(spark, sf_dir, "papers")), table(spark, sf_dir, "enriched_data")))
    return d.select("record_id", "is_focus", "is_seed", "is_core")


_REPS = f"""g AS (SELECT key, bool_or(source_db = 'Scopus') AS in_s, bool_or(source_db = 'WoS') AS in_w, count(*) AS group_rows,
 arg_max(record_id, (CASE WHEN (references_text IS NOT NULL AND trim(references_text) <> '') OR coalesce(len(cr_list), 0) > 0 THEN 1 ELSE 0 END)::HUGEINT * 100000000000000000000 + (CASE WHEN source_db = 'Scopus' THEN 1 ELSE 0 END)::HUGEINT * 10000000000000000000 + length(coalesce(abstract, ''))::HUGEINT * 1000000000000 - record_id) AS record_id FROM keyed GROUP BY key)"""


@query(f"""WITH {KEYED}, {_REPS}, s AS ({SCREENED} (SELECT p.*, g.in_s, g.in_w, g.group_rows, g.key, {_SEEDED} AS is_seed FROM papers p JOIN g USING (record_id))),
 e AS (SELECT DISTINCT CASE WHEN {_DOI.format('doi')} <> '' THEN 'doi:' || {_DOI.format('doi')} WHEN {_TITLE.format('title')} <> '' THEN 'ttl:' || substr({_TITLE.format('title')}, 1, 120) ELSE 'row:' || enriched_id END AS key FROM enriched_data),
 m AS (SELECT count(*) AS n FROM e WHERE key NOT IN (SELECT key FROM keyed)), i AS (SELECT count(*) AS n, count_if(source_db = 'Scopus') AS a, count_if(source_db = 'WoS') AS b FROM papers),
 r AS (SELECT *, in_years AND has_ai AND has_plag AND NOT bad_type AS ok FROM s),
 f AS (SELECT i.n AS identified, i.a AS identified_scopus, i.b AS identified_wos, count(*) AS after_dedup, i.n - count(*) AS removed, count_if(in_s AND in_w) AS overlap, count_if(in_s AND NOT in_w) AS scopus_only, count_if(in_w AND NOT in_s) AS wos_only, count_if(group_rows > 1) AS groups_merged,
  max(group_rows) AS largest_group, count_if(in_years) AS after_date, count_if(NOT in_years) AS excluded_date, count_if(in_years AND NOT (has_ai AND has_plag)) AS excluded_terms, count_if(in_years AND NOT has_ai) AS without_ai, count_if(in_years AND NOT has_plag) AS without_plagiarism,
  count_if(in_years AND has_ai AND has_plag AND bad_type) AS excluded_type, count_if(ok) AS screened, count_if(ok AND is_focus) AS focus, count_if(ok AND is_seed) AS seed_found, m.n AS seed_missing, m.n AS seed_recovered, count_if(ok) + m.n AS extended, count_if(ok AND (is_focus OR is_seed)) + m.n AS core,
  count_if(ok AND in_s AND in_w) AS screened_overlap, count_if(ok AND abstract IS NOT NULL AND abstract <> '[No abstract available]') AS with_abstract FROM r, m, i GROUP BY i.n, i.a, i.b, m.n)
 SELECT name AS stage, value::BIGINT AS n FROM (UNPIVOT f ON COLUMNS(*))""")
def screening_funnel(spark, sf_dir):
    """[A1, A6, F8] The twenty-five counters of the funnel, from the records identified to the core tier (focus or seed)."""
    p, seed = table(spark, sf_dir, "papers"), table(spark, sf_dir, "enriched_data")
    reps = corpus.seed_flag(corpus.screened(corpus.representatives(corpus.dedup_groups(p, near=False))), seed)
    s = seed.select(F.col("enriched_id").alias("record_id"), "doi", "title")
    return corpus.funnel(p, reps, corpus.missing_seed(p, s))


# --- Words, topics, themes ------------------------------------------------------

_WORDS = """w AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^a-z\\s]', '', 'g'), '\\s+'), lambda w: length(w) > 2 AND w NOT IN (""" + ", ".join(f"'{x}'" for x in text.STOP_WORDS) + """)) AS w FROM documents)"""


@query(f"""WITH {_WORDS}, g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w WHERE len(w) > 0)
 SELECT term, count(*) AS uses, count(DISTINCT doc_id) AS n_docs FROM g GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5""")
def ngram_vocabulary(spark, sf_dir):
    """[P34, P35] Words and word pairs in five documents or more."""
    return topics.vocabulary(topics.token_lists(table(spark, sf_dir, "documents"), "doc_id", "text", two=True), "doc_id", 5)


@query(f"""WITH {_WORDS.replace('FROM documents', ', source FROM documents')}, t AS (SELECT source, w AS word, count(*) AS n FROM (SELECT source, unnest(w) AS w FROM w WHERE source IS NOT NULL) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS r FROM t),
 s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS topic FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL))
 SELECT topic::INTEGER AS topic, CASE WHEN count(word) > 0 THEN 'T' || topic || ': ' || string_agg(word, ', ' ORDER BY r) ELSE 'Topic ' || topic END AS label FROM s LEFT JOIN (SELECT * FROM r WHERE r <= 3) USING (source) GROUP BY topic""")
def topic_labels(spark, sf_dir):
    """[P39] Labels of numbered topics (sources) from their three most frequent words."""
    d = table(spark, sf_dir, "documents").filter("source is not null")
    names = sorted(r["source"] for r in d.select("source").distinct().collect())  # nine sources
    lists = topics.token_lists(d, "doc_id", "text").join(d.select("doc_id", "source"), "doc_id").select("source", F.explode("words").alias("word"))
    best = stats.top_per_group(lists.groupBy("source", "word").agg(F.count("*").alias("n")), "source", 3, F.desc("n"), F.col("word"))
    words = best.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("words"))
    numbered = spark.createDataFrame(list(enumerate(names)), "topic int, source string").join(words, "source", "left")
    return numbered.select("topic", text.topic_label(F.col("topic"), F.coalesce("words", F.array().cast("array<string>"))).alias("label"))


@query(f"WITH {_TOPS} SELECT item, sum(n)::BIGINT AS total FROM t GROUP BY 1 ORDER BY total DESC, item LIMIT 8")
def heaviest_themes(spark, sf_dir):
    """[T6, U7] The eight heaviest rows of the theme matrix."""
    return temporal.heaviest_rows(temporal.theme_matrix(cut(yearly_top_keywords(spark, sf_dir))))


@query(f"WITH {DERIVED} SELECT row_number() OVER (ORDER BY year)::BIGINT AS place, year, year = 2026 AS partial, count(*) AS n FROM derived GROUP BY year")
def years_in_order(spark, sf_dir):
    """[T8, T9, P40, K8] Years in order with their counts; the year observed in part is marked, never scaled."""
    d = derived(spark, sf_dir)
    places = [(i + 1, r["year"]) for i, r in enumerate(stats.distinct_in_order(d, "year").collect())]  # a handful of years
    n = stats.frequencies(d, "year")
    return spark.createDataFrame(places, "place long, year int").join(n, "year").select("place", "year", text.is_partial_year(F.col("year")).alias("partial"), "n")


@query(f"WITH {DERIVED} SELECT record_id, cites, coalesce(t.topic, -1)::INTEGER AS topic FROM derived LEFT JOIN (SELECT record_id, length(title)::INTEGER % 7 - 1 AS topic FROM papers WHERE title IS NOT NULL) t USING (record_id)")
def features_with_topics(spark, sf_dir):
    """[J1] The regression frame with a given assignment of topics; papers without one get -1."""
    given = table(spark, sf_dir, "papers").filter("title is not null").select("record_id", (F.length("title") % 7 - 1).alias("topic"))
    return countreg.features(derived(spark, sf_dir), given).select("record_id", "cites", "topic")


@query("""WITH c AS (SELECT paper_id, orientation, methodology FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY coding_id DESC) AS r FROM taxonomy_coding) WHERE r = 1)
 SELECT p.paper_id, c.orientation, c.methodology, CASE WHEN p.source_title IS NOT NULL THEN length(p.source_title)::INTEGER % 5 END AS cluster, CASE WHEN p.source_title IS NOT NULL AND length(p.source_title) % 5 < 4 THEN 'cluster ' || length(p.source_title) % 5 END AS cluster_label FROM papers p LEFT JOIN c USING (paper_id)""")
def labelled_papers(spark, sf_dir):
    """[J17, J18] Papers with their codes, a given cluster (by the venue's length) and its label, missing ones null."""
    p, t = table(spark, sf_dir, "papers"), table(spark, sf_dir, "taxonomy_coding")
    codes = t.groupBy("paper_id").agg(F.max_by(F.struct("orientation", "methodology"), "coding_id").alias("x")).select("paper_id", "x.*")
    clusters = p.filter("source_title is not null").select("paper_id", (F.length("source_title") % 5).alias("cluster"))
    names = spark.createDataFrame([(i, f"cluster {i}") for i in range(4)], "cluster int, cluster_label string")
    return agreement.looked_up(p.select("paper_id"), codes, clusters, names, "paper_id").select("paper_id", "orientation", "methodology", "cluster", "cluster_label")


_TOOLS = [x.lower() for x in coverage.TOOLS]
_NAMED = ", ".join(f"count_if(contains(t, '{x}')) AS tool_" + "".join(ch if ch.isalnum() else "_" for ch in x) for x in _TOOLS)


@query(f"""WITH t AS (SELECT {_SCREEN} AS t FROM papers), n AS (SELECT count(*) AS papers, count_if({_any('t', _TOOLS)}) AS naming_a_tool, count_if({_any('t', _TOOLS)} AND NOT {_any('t', coverage.GENERAL_TERMS)}) AS without_general_term, {_NAMED} FROM t)
 SELECT *, round(without_general_term / nullif(naming_a_tool, 0)::DOUBLE, 6) AS share_without FROM n""")
def tool_coverage(spark, sf_dir):
    """[A26, A28, F13] Papers naming the thirteen tools, with and without a general term."""
    return coverage.tool_mentions(table(spark, sf_dir, "papers")).withColumn("share_without", F.round("share_without", 6))


# --- Subgraphs -------------------------------------------------------------------


@query(f"WITH {_EDGES} SELECT id FROM v WHERE id IN (SELECT a FROM w)")
def connected_countries(spark, sf_dir):
    """Countries without the isolated ones."""
    return graph.without_isolates(_country_vertices(spark, sf_dir), _country_graph(spark, sf_dir))


@query(f"WITH {_KWE} SELECT src, dst, weight FROM e WHERE src IN (SELECT id FROM n WHERE n >= 5) AND dst IN (SELECT id FROM n WHERE n >= 5)")
def frequent_keyword_graph(spark, sf_dir):
    """[F16, G21] The edges induced by keywords of five papers or more."""
    return graph.induced(_keyword_graph(spark, sf_dir), _keyword_counts(spark, sf_dir).filter("n >= 5"))


@query(f"WITH {_KWE}, d AS (SELECT id, count(*) AS k FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1 ORDER BY k DESC, id LIMIT 60) SELECT src, dst, weight FROM e WHERE src IN (SELECT id FROM d) AND dst IN (SELECT id FROM d)")
def top60_keyword_graph(spark, sf_dir):
    """[T5, T3] The subgraph of the sixty keywords of highest degree."""
    e = _keyword_graph(spark, sf_dir)
    return graph.induced(e, stats.top(graph.degree_centrality(e), 60, F.desc("degree"), F.col("id")))


@query(f"WITH {_EDGES} SELECT id, count(w.a) AS degree, round(count(w.a)::DOUBLE / ((SELECT count(*) FROM v) - 1), 6) AS centrality FROM v LEFT JOIN w ON w.a = v.id GROUP BY 1 ORDER BY centrality DESC, id LIMIT 20")
def top20_countries(spark, sf_dir):
    """[T3] The twenty most central countries."""
    d = graph.degree_centrality(_country_graph(spark, sf_dir), _country_vertices(spark, sf_dir)).withColumn("centrality", F.round("centrality", 6))
    return stats.top(d, 20, F.desc("centrality"), F.col("id"))


@query(f"""WITH {_KWE}, m AS (SELECT DISTINCT id, substr(id, 1, 1) AS community FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e)), r AS (SELECT community, id, row_number() OVER (PARTITION BY community ORDER BY n DESC, id) AS r FROM m JOIN n USING (id))
 SELECT community, string_agg(id, ', ' ORDER BY r) AS label FROM r WHERE r <= 3 GROUP BY 1""")
def community_labels(spark, sf_dir):
    """[T7] The three most frequent keywords of each community of a given partition (first letters)."""
    e = _keyword_graph(spark, sf_dir)
    members = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("community", F.substring("id", 1, 1))
    return graph.callon(e, members, _keyword_counts(spark, sf_dir)).select("community", "label")


@query()
def callon_of_communities(spark, sf_dir):
    """[G18, G19, W5, T7, G3, G16] Callon diagram of the Louvain communities, with their labels."""
    e = _keyword_graph(spark, sf_dir)
    d = graph.callon(e, graph.louvain(e), _keyword_counts(spark, sf_dir)).select("community", "size", r6(F.col("centrality"), "centrality"), r6(F.col("density"), "density"), "label")
    return stats.median_split(cut(d), "centrality", "density")

