"""Round trips through every source and sink: tables are written in a format and read back, whole.

Files go to the shared folder; the SQL twins read the tables themselves.
"""

from __future__ import annotations

import io

from pyspark.sql import functions as F

from litloom.operators import knowledge, stats
from litloom.plans.networks import _BAG
from litloom.plans.reference import _EDGES, DERIVED, _country_graph, _country_vertices, derived, query
from litloom.runtime import shared_path, table
from litloom.sources import readers, writers

_EXPORT = ["title", "pub_year", "doi", "source_title", "document_type", "cited_by", "author_keywords"]


@query("SELECT " + ", ".join(f"nullif({c}, '') AS {c}" for c in _EXPORT) + " FROM papers")
def export_round_trip(spark, sf_dir):
    """[S1-S3, K2] Papers as a tabular export with its headings, read back as canonical columns; what is empty is missing."""
    at = shared_path(spark, "export")
    d = table(spark, sf_dir, "papers")
    named = d.select(*[F.col(c).alias(h) for c, h in readers.HEADINGS.items()])
    writers.write_csv(named, at, [*readers.HEADINGS.values(), "a column that isn't there"])
    return readers.read_tabular(spark, at).select(*_EXPORT)


@query("SELECT nullif(doi, '') AS doi, nullif(pub_year, '') AS pub_year, nullif(source_title, '') AS source_title FROM papers")
def pruned_export(spark, sf_dir):
    """[S2] Three columns of the export."""
    at = shared_path(spark, "export")
    writers.write_csv(table(spark, sf_dir, "papers").select(*[F.col(c).alias(h) for c, h in readers.HEADINGS.items()]), at, list(readers.HEADINGS.values()))
    return readers.read_tabular(spark, at, ["doi", "pub_year", "source_title"])


def _tagged(spark, sf_dir) -> str:
    """WoS rows as field-tagged files; returns their folder."""
    c = F.col
    line = lambda tag, v: F.when(v.isNotNull(), F.concat(F.lit(f"{tag} "), F.regexp_replace(v, r"\s+", " "), F.lit("\n"))).otherwise("")
    many = F.when(F.size("cr_list") > 0, F.concat(F.lit("CR "), F.array_join(F.transform("cr_list", lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), "\n   "), F.lit("\n"))).otherwise("")
    d = table(spark, sf_dir, "papers").filter("source_db = 'WoS'")
    body = F.concat(F.lit("PT J\n"), line("UT", c("wos_ut")), line("TI", c("title")), line("PY", c("pub_year")), line("DI", c("doi")), many, F.lit("ER\n"))
    at = shared_path(spark, "tagged")
    d.select(F.concat(F.lit("\n"), body)).write.text(at)
    return at


_TITLED = "source_db = 'WoS' AND trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')) <> ''"
_TAGGED_SQL = f"""SELECT trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, coalesce(trim(regexp_replace(doi, '\\s+', ' ', 'g')), '') AS doi, coalesce(trim(regexp_replace(wos_ut, '\\s+', ' ', 'g')), '') AS ut,
 nullif(regexp_extract(coalesce(pub_year, ''), '\\d{{4}}', 0), '') AS pub_year, coalesce(len(cr_list), 0)::INTEGER AS n_refs FROM papers WHERE {_TITLED}"""


@query(_TAGGED_SQL)
def tagged_round_trip(spark, sf_dir):
    """[S4-S6] WoS rows as field-tagged files, read by a glob, one task per file."""
    d = readers.tagged_rows(readers.read_tagged(spark, _tagged(spark, sf_dir) + "/*.txt"))
    return d.select("title", "doi", F.col("wos_ut").alias("ut"), "pub_year", F.size("cr_list").alias("n_refs"))


@query("SELECT count(*) AS n_records, sum(coalesce(len(cr_list), 0))::BIGINT AS n_refs FROM papers WHERE source_db = 'WoS'")
def tagged_source(spark, sf_dir):
    """[S4] The same files by the data source ``tagged``."""
    spark.dataSource.register(readers.TaggedSource)
    at = _tagged(spark, sf_dir)
    paths = sorted(r["f"] for r in spark.read.text(at).select(F.col("_metadata.file_path").alias("f")).distinct().collect())
    d = spark.read.format("tagged").option("paths", "\n".join(paths)).load()
    return d.agg(F.count("*").alias("n_records"), F.sum(F.coalesce(F.size(F.try_element_at("tags", F.lit("CR"))), F.lit(0))).alias("n_refs"))


@query("""SELECT paper_id, orientation, methodology, confidence FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY coding_id % 8 DESC, coding_id DESC) AS r FROM taxonomy_coding WHERE paper_id IS NOT NULL) WHERE r = 1""")
def codings_round_trip(spark, sf_dir):
    """[S7] Codings as JSON arrays in eight folders of files; of a paper in several the last file's row stays."""
    at = shared_path(spark, "codings")
    d = table(spark, sf_dir, "taxonomy_coding").filter("paper_id is not null").withColumn("b", F.col("coding_id") % 8)
    one = d.groupBy("paper_id", "b").agg(F.max_by(F.struct("orientation", "methodology", "confidence", "note"), "coding_id").alias("x")).select("b", F.struct("paper_id", "x.*").alias("x"))
    chunk = one.groupBy("b", F.pmod(F.xxhash64("x.paper_id"), F.lit(16)).alias("h")).agg(F.to_json(F.collect_list("x"), {"ignoreNullFields": "false"}).alias("value"))
    chunk.repartition("b", "h").write.partitionBy("b", "h").text(at)
    return readers.read_codings(spark, at + "/*/*/*.txt").select("paper_id", "orientation", "methodology", "confidence")


@query(f"WITH {_EDGES} SELECT src, dst, weight::INTEGER AS weight, 'COLLABORATES' AS relation FROM e")
def graph_document_round_trip(spark, sf_dir):
    """[K3, S8, S17] The country graph as one JSON document of nodes and edges, read back."""
    at = shared_path(spark, "graph") + "/graph.json"
    e = _country_graph(spark, sf_dir).select(F.col("src").alias("source"), F.col("dst").alias("target"), "weight", F.lit("COLLABORATES").alias("type"))
    n = _country_vertices(spark, sf_dir).select("id", F.col("id").alias("label"), F.lit("Country").alias("type"))
    writers.write_document(at, {"nodes": n, "edges": e})
    return readers.graph_document(spark, at)[1]


@query("SELECT paper_id, length(title)::INTEGER % 7 - 1 AS topic FROM papers WHERE title IS NOT NULL")
def assignments_round_trip(spark, sf_dir):
    """[S9, K2] A given assignment of topics as CSV, read back."""
    at = shared_path(spark, "assignments")
    writers.write_csv(table(spark, sf_dir, "papers").filter("title is not null").select("paper_id", (F.length("title") % 7 - 1).alias("topic")), at, ["paper_id", "topic"])
    return readers.read_assignments(spark, at)


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def embeddings_cache(spark, sf_dir):
    """[S10, S11, K1, K5] Vectors through a cache: built and written at the first call, read at the second."""
    at = shared_path(spark, "vectors")
    readers.read_through(spark, at, lambda: table(spark, sf_dir, "embeddings"))

    def never():
        raise AssertionError("the cache was there")

    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return readers.read_through(spark, at, never).select("vec_id", F.round(total, 4).alias("total"))


@query("SELECT paper_id AS id, doi, title, document_type AS type, CASE WHEN regexp_full_match(pub_year, '\\d{4}') THEN pub_year::INTEGER END AS year, source_title AS venue, (SELECT count(*) FROM papers) AS total FROM papers")
def works_round_trip(spark, sf_dir):
    """[S12] Papers as recorded pages of a cursor interface, read back as works."""
    at, c = shared_path(spark, "works"), F.col
    p = table(spark, sf_dir, "papers")
    n = p.count()
    year = F.when(c("pub_year").rlike(r"^\d{4}$"), c("pub_year").try_cast("int"))
    one = F.struct(c("paper_id").alias("id"), "doi", "title", c("document_type").alias("type"), year.alias("publication_year"), F.struct(F.struct(c("source_title").alias("display_name")).alias("source")).alias("primary_location"))
    pages = p.groupBy(F.pmod(F.xxhash64("paper_id"), F.lit(max(1, n // 200))).alias("b")).agg(F.collect_list(one).alias("results"))
    page = F.to_json(F.struct(F.struct(F.lit(n).alias("count"), F.lit(None).cast("string").alias("next_cursor")).alias("meta"), "results"))
    pages.select("b", page.alias("value")).repartition("b").write.partitionBy("b").text(at)  # one page per file
    return readers.works(spark, at + "/*/*.txt")


@query("SELECT 'steady' AS name, 'ok' AS status, 200.0::DOUBLE AS value, NULL::VARCHAR AS error UNION ALL SELECT 'flaky', 'ok', 3.0, NULL UNION ALL SELECT 'dead', 'error', NULL, 'OSError: down'")
def probes(spark, sf_dir):
    """[S13, K10] Probes of a recorded interface: one answers, one after two failures, one never; failures are recorded."""
    tries = {"n": 0}

    def opener(url, timeout):
        tries["n"] += 1
        if url == "dead" or (url == "flaky" and tries["n"] < 3):
            raise OSError("down")
        return io.BytesIO(b"200" if url == "steady" else str(tries["n"]).encode())

    def probe(url):
        def run():
            tries["n"] = 0
            return float(readers.fetch(url, opener=opener, wait=lambda s: None))

        return run

    return readers.probed(spark, {u: probe(u) for u in ("steady", "flaky", "dead")})


@query("SELECT 'e' || enriched_id AS cite_key, regexp_replace(title, '[{}\\s]+', ' ', 'g') AS title, pub_year::VARCHAR AS year FROM enriched_data WHERE title IS NOT NULL")
def bibtex_round_trip(spark, sf_dir):
    """[S14] Enriched records as BibTeX, read back."""
    at, c = shared_path(spark, "bibtex"), F.col
    d = table(spark, sf_dir, "enriched_data").filter("title is not null")
    entry = F.concat(F.lit("\n@ARTICLE{e"), c("enriched_id"), F.lit(",\n  title = {"), F.regexp_replace("title", r"[{}\s]+", " "), F.lit("},\n  year = {"), F.coalesce(c("pub_year").cast("string"), F.lit("")), F.lit("}\n}\n"))
    d.select(entry.alias("value")).write.text(at)
    b = readers.read_bibtex(spark, at)
    return b.select("cite_key", F.try_element_at("fields", F.lit("title")).alias("title"), F.nullif(F.try_element_at("fields", F.lit("year")), F.lit("")).alias("year"))


@query("SELECT " + ", ".join(f"nullif({c.split()[0]}::VARCHAR, '') AS {c.split()[0]}" for c in readers.ENRICHED.split(", ")) + " FROM enriched_data")
def enriched_round_trip(spark, sf_dir):
    """[S15] Enriched records as CSV, read back by position."""
    at = shared_path(spark, "enriched")
    cols = [c.split()[0] for c in readers.ENRICHED.split(", ")]
    writers.write_csv(table(spark, sf_dir, "enriched_data").select(*[F.col(c).cast("string") for c in cols]), at, cols)
    return readers.read_enriched(spark, at)


@query("SELECT line, count(*) AS n FROM (SELECT unnest(string_split(replace(text, chr(13), ' '), chr(10))) AS line FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def lines_round_trip(spark, sf_dir):
    """[S16] Texts as plain files, read back line by line."""
    at = shared_path(spark, "lines")
    table(spark, sf_dir, "documents").filter("text is not null").select(F.translate("text", "\r", " ").alias("value")).write.text(at)
    return readers.read_lines(spark, at).groupBy("line").agg(F.count("*").alias("n"))


@query(f"WITH {_BAG}, f AS (SELECT src, dst, min(relation) AS relation FROM bag WHERE left(src, 2) = 'I_' AND left(dst, 2) = 'C_' GROUP BY 1, 2) SELECT relation, count(*) AS n FROM f GROUP BY 1 UNION ALL SELECT 'node', count(DISTINCT x) FROM (SELECT src AS x FROM f UNION ALL SELECT dst FROM f)")
def graphml_round_trip(spark, sf_dir):
    """[K6, K7] Institutions and countries of the multigraph as GraphML, one edge per pair, counted in the file."""
    at = shared_path(spark, "graphml") + "/kg.graphml"
    e = knowledge.first_edges(knowledge.edges(derived(spark, sf_dir)).filter("src like 'I\\_%' and dst like 'C\\_%'"))
    v = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    writers.write_graphml(at, v, e.select("src", "dst", "relation"))
    line = F.col("line")
    kind = F.when(line.startswith("<node"), "node").when(line.startswith("<edge"), F.regexp_extract("line", r'<data key="e_relation">(\w+)</data>', 1))
    return stats.frequencies(readers.read_lines(spark, at).withColumn("relation", kind), "relation")


@query("SELECT * FROM (VALUES ('1', 10), ('2-3', 20), ('4+', NULL)) t(team, papers)")
def page_literals(spark, sf_dir):
    """[S17] Arrays written in a page, as a frame; a short row ends in nulls."""
    return readers.literals(spark, [("1", 10), ("2-3", 20), ("4+",)], "team string, papers int")


@query(f"WITH {DERIVED} SELECT year, count(*) AS n, year = 2026 AS partial FROM derived GROUP BY 1")
def figure_frame(spark, sf_dir):
    """[K8, P40] The frame behind the figure of papers per year."""
    return writers.plot_data(stats.frequencies(derived(spark, sf_dir), "year"), "year")


