"""Problem 3: the packed fields of papers, one row per value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litloom.operators.multivalue import add_values, infer_dialects
from litloom.runtime import table

# The packed columns of papers; True where a value may hold the delimiter itself.
PACKED = {"author_full_names": False, "author_keywords": False, "affiliations": False, "references_text": True}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the packed fields: one scan to infer, one to split them all."""
    papers = table(spark, sf_dir, "papers").select("record_id", "source_db", *PACKED)
    d = add_values(papers, {f: f"v_{f}" for f in PACKED}, "source_db", tuple(f for f, joined in PACKED.items() if joined))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"v_{f}").alias("v")) for f in PACKED]))
    d = d.select("record_id", each.alias("x")).select("record_id", "x.field_name", F.posexplode("x.v").alias("pos", "val"))
    return d.select("record_id", "field_name", (F.col("pos") + 1).cast("long").alias("pos"), "val")


def p3_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dialects that p3_found infers, one row per field, source and accepted delimiter."""
    papers = table(spark, sf_dir, "papers")
    rows = []
    for name, how in infer_dialects(papers, list(PACKED), "source_db", joined=tuple(f for f, joined in PACKED.items() if joined)).items():
        for s, x in sorted(how.items()):
            for kind, ds in (("strong", x.strong), ("weak", x.weak)):
                rows += [(name, s, d, kind, round(float(x.scores[d]), 6)) for d in ds]
    return spark.createDataFrame(rows, "field_name string, source_db string, delim string, strength string, score double")
