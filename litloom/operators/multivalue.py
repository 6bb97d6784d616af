"""Several values packed in one field.

A source packs several values into one string with delimiters of its own, and
often with more than one.  ``infer_delimiters`` scores candidate delimiters per
source on all rows: pieces must look like whole values of that source (type
regularity) and come in consistent numbers (piece-count consistency).
``split_values`` then cuts every text at the accepted delimiters, outside
quotes and brackets, and returns one row per value with its position.

Everything is a column expression: one pass, no shuffle for the split itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litloom.runtime import blank_trim, cut

# Candidate delimiters as (name, regular expression).
CANDIDATES = (
    (";", r";"),
    ("|", r"\|"),
    ("\n", r"\n"),
    ("·", r"\s*·\s*"),
    ("//", r"\s//\s"),
    ("&", r"\s&\s"),
    ("and", r"\sand\s"),
    (",", r","),
    ("\t", r"\t"),
    (" - ", r"\s-\s"),
    ("/", r"(?<!/)/(?!/)"),
    (":", r":\s"),
)
# Candidates that hardly occur inside a value.
STRONG = (";", "|", "\n", "·", "//")
# Particles that begin a family name in lower case.
PARTICLES = "van|von|de|del|della|di|da|dos|der|den|la|le|el|al"
QUOTED = r'"(?:[^"]++|"")*+"'
MOST_SENT = 100_000  # protected values that are sent to every task; a longer list is joined by key
MARK = "\u0001"  # stands for delimiters of several characters


@dataclass(frozen=True)
class Dialect:
    """How one source packs one field.

    strong: delimiters that always separate; weak: delimiters that also occur
    inside values and separate only in texts without a strong one.
    """

    strong: tuple[str, ...] = (";",)
    weak: tuple[str, ...] = ()
    joined: bool = False  # values may contain the first delimiter (references with several authors)
    scores: dict = field(default_factory=dict, compare=False, hash=False)


def _bare(text: Column) -> Column:
    """Text without what quotes or square brackets enclose."""
    return F.regexp_replace(text, QUOTED + r"|\[[^\]]*+\]", "Q")


def _shape(piece: Column) -> Column:
    """A coarse type of a piece: first and last character, comma, length."""

    def kind(c: Column) -> Column:
        return (
            F.when(F.lower(c) != F.upper(c), F.lit("a"))
            .when((c >= "0") & (c <= "9"), F.lit("9"))
            .otherwise(c)
        )

    n = F.length(piece)
    return F.concat(
        kind(F.substring(piece, 1, 1)),
        F.when(kind(F.substring(piece, -1, 1)).isin("a", "9"), F.lit("w")).otherwise(F.lit(".")),
        F.when(piece.contains(","), ",").otherwise("-"),
        F.when(n < 4, "0").when(n < 10, "1").when(n < 60, "2").otherwise("3"),
    )


def delimiter_scores(df: DataFrame, text: str | list[str], source: str | None = None) -> DataFrame:
    """Every candidate's score per field and source, over all rows.

    Returns ``field, source, delim, n_rows, regularity, consistency, score``;
    ``text`` is one column or several, which are read in one scan.
    ``regularity`` is the overlap of the shapes of a candidate's pieces with
    the shapes of texts that hold no strong candidate at all; ``consistency``
    falls with the standard deviation of the piece counts' logarithm and with
    its distance from that of all strong candidates together.  The scan
    aggregates before it moves anything; the result has at most fields x
    sources x candidates rows.  Null and empty texts do not count.
    """
    src = F.coalesce(F.col(source).cast("string"), F.lit("")) if source else F.lit("")
    fields = [text] if isinstance(text, str) else list(text)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("t")) for f in fields]))
    base = df.select(src.alias("source"), each.alias("x")).filter("x.t is not null")
    base = base.select("x.field", "source", _bare(blank_trim(F.col("x.t"))).alias("t")).filter("t <> ''")
    names = [c[0] for c in CANDIDATES]
    parts = [F.when(F.col("t").rlike(rx), F.struct(F.lit(n).alias("d"), F.split("t", rx).alias("p"))) for n, rx in CANDIDATES]
    own = F.when(
        ~F.col("t").rlike("[;|\n·]|\\s(//|&|and)\\s"),
        F.struct(F.lit("").alias("d"), F.array("t").alias("p")),
    )
    split = base.select("field", "source", F.explode(F.array(*parts, own)).alias("x")).filter("x is not null").select("field", "source", "x.d", "x.p")
    # One scan: the first piece of a row carries the row's own figures; empty pieces count only there.
    log_n = F.log(F.greatest(F.size(F.array_remove("p", "")), F.lit(1)))
    first, some = F.col("pos") == 0, F.col("piece") != ""
    each = split.select("field", "source", "d", log_n.alias("log_n"), F.posexplode("p")).select("field", "source", "d", "log_n", "pos", F.trim("col").alias("piece"))
    shapes = (
        each.filter(first | some)
        .groupBy("field", "source", "d", F.when(some, _shape(F.col("piece"))).otherwise("").alias("s"))
        .agg(
            F.count_if(some).alias("n"),
            F.sum(first.cast("long")).alias("rows"),
            F.sum(F.when(first, F.col("log_n"))).alias("sum_log"),
            F.sum(F.when(first, F.col("log_n") * F.col("log_n"))).alias("sum_sq"),
        )
        .repartition("field", "source")  # tallies only; serves every window below
    )
    # Texts without any strong candidate show what one value looks like; where
    # there are hardly any, the pieces of the most frequent strong candidate do.
    strong = F.col("d").isin(*STRONG)
    one, two = Window.partitionBy("field", "source"), Window.partitionBy("field", "source", "d")
    sized = shapes.withColumn("d_rows", F.sum("rows").over(two)).withColumn("share", F.col("n") / F.sum("n").over(two))
    ranked = sized.withColumn("singles", F.max(F.when(F.col("d") == "", F.col("d_rows"))).over(one))
    ranked = ranked.withColumn("top", F.max(F.when(strong, F.struct("d_rows", "d"))).over(one))
    few = F.greatest(F.col("top.d_rows") * 0.01, F.lit(10))
    enough = F.coalesce(F.col("singles") >= few, F.col("top").isNull())
    based = ranked.withColumn("model", F.when(enough, "").otherwise(F.col("top.d")))
    based = based.withColumn("pool", F.sum(F.when(strong, F.col("sum_log"))).over(one) / F.sum(F.when(strong, F.col("rows"))).over(one))
    against = based.withColumn("base", F.max(F.when(F.col("d") == F.col("model"), F.col("share"))).over(Window.partitionBy("field", "source", "s")))
    mean = F.sum("sum_log") / F.sum("rows")
    spread = F.sqrt(F.greatest(F.sum("sum_sq") / F.sum("rows") - mean * mean, F.lit(0.0)))
    off = F.abs(mean - F.coalesce(F.max("pool"), mean))
    return (
        against.filter(F.col("d").isin(*names))
        .groupBy("field", "source", F.col("d").alias("delim"))
        .agg(
            F.sum("rows").alias("n_rows"),
            F.sum(F.least("share", F.coalesce("base", F.lit(0.0)))).alias("regularity"),
            (F.exp(-off) / (1 + spread)).alias("consistency"),
        )
        .withColumn("score", F.col("regularity") * F.col("consistency"))
    )


def infer_dialects(
    df: DataFrame, texts: list[str], source: str | None = None, least_score: float = 0.33, least_rows: float = 0.002, joined: tuple[str, ...] = ()
) -> dict[str, dict[str, Dialect]]:
    """Per field one ``Dialect`` per source from ``delimiter_scores``, in one scan for all fields.

    A candidate is accepted from ``least_score`` on if at least a share of
    ``least_rows`` of the most frequent candidate's rows hold it.  The comma is
    weak wherever another candidate is accepted.  The driver receives one row
    per field, source and candidate.
    """
    found: dict[tuple[str, str], list] = {}
    for r in delimiter_scores(df, texts, source).collect():
        found.setdefault((r["field"], r["source"]), []).append(r)
    out: dict[str, dict[str, Dialect]] = {f: {} for f in texts}
    for (f, s), rs in found.items():
        most = max(r["n_rows"] for r in rs)
        good = {r["delim"]: r["score"] for r in rs if r["score"] >= least_score and r["n_rows"] >= least_rows * most}
        strong = tuple(d for d in sorted(good, key=lambda d: -good[d]) if d != ",")
        weak = (",",) if "," in good else ()
        out[f][s] = Dialect(strong if strong else weak, weak if strong else (), f in joined, {r["delim"]: r["score"] for r in rs})
    return out


def infer_delimiters(df: DataFrame, text: str, source: str | None = None, least_score: float = 0.33, least_rows: float = 0.002, joined: bool = False) -> dict[str, Dialect]:
    """``infer_dialects`` of one field."""
    return infer_dialects(df, [text], source, least_score, least_rows, (text,) if joined else ())[text]


def _pattern(delims: tuple[str, ...], joined: bool) -> str:
    """Regular expression whose group 1 is a value."""
    ones = "".join("\\" + d if d in "|\\^-]" else d for d in delims if len(d) == 1) + MARK
    quoted = rf'\s*+{QUOTED}(?=\s*?(?:[{ones}]|\z))'
    if not joined:
        return rf"(?U)({quoted}|(?:[^{ones}\[]++|\[[^\]]*+\]|\[)++)"
    hard = ones.replace(";", "")
    begin = rf"\s*+(?:(?:{PARTICLES})[ \p{{Lu}}])"
    plain = rf"(?:\s*+\p{{L}}[^,;{hard}\"]*+;)*[^;{hard}]++(?:;(?=\s*+\p{{Ll}})(?!{begin})[^;{hard}]*+)*+"
    return rf"(?U)({quoted}|{plain})"


def _clean(raw: Column) -> Column:
    """Blanks around and quotes that enclose all of a value removed."""
    whole = blank_trim(raw)
    return F.when(
        whole.startswith('"') & whole.endswith('"') & (F.length(whole) >= 2),
        blank_trim(F.replace(F.substr(whole, F.lit(2), F.length(whole) - 2), F.lit('""'), F.lit('"'))),
    ).otherwise(whole)


def values(text: Column, dialect: Dialect, keep_whole: Column | None = None) -> Column:
    """The array of values of ``text`` under ``dialect``; null for a null text.

    ``keep_whole``: a condition under which weak delimiters do not separate.
    """

    def pieces(t: Column, delims: tuple[str, ...], joined: bool) -> Column:
        for name, rx in CANDIDATES:
            if name in delims and len(name) > 1:
                t = F.regexp_replace(t, rx + r'(?=(?:[^"]*"[^"]*")*[^"]*\z)', MARK)
        return F.regexp_extract_all(t, F.lit(_pattern(delims, joined)), F.lit(1))

    got = pieces(text, dialect.strong, dialect.joined)
    if dialect.weak:
        rx = "|".join(r for n, r in CANDIDATES if n in dialect.strong)
        plain = ~_bare(text).rlike(rx)
        if keep_whole is not None:
            plain = plain & ~keep_whole
        got = F.when(plain, pieces(text, dialect.weak, False)).otherwise(got)
    return F.filter(F.transform(got, lambda v: _clean(v)), lambda v: v != "")


def protected_values(df: DataFrame, text: str, dialect: Dialect) -> DataFrame:
    """Values that hold a weak delimiter although they stand in a text with strong ones.

    They show which texts without a strong delimiter are one value ("policy,
    national").  One row per distinct lower-case value seen twice or more.
    """
    if not dialect.weak:
        return df.select(F.lit("").alias("whole")).limit(0)
    strong = "|".join(r for n, r in CANDIDATES if n in dialect.strong)
    v = F.explode(values(F.col(text), Dialect(dialect.strong, (), False))).alias("v")
    return (
        df.filter(F.col(text).contains(",") & F.col(text).rlike(strong))
        .select(v)
        .filter(F.col("v").contains(","))
        .groupBy(F.lower(F.regexp_replace("v", r"(?U)\s+", " ")).alias("whole"))
        .count()
        .filter("count >= 2")
        .select("whole")
    )


def _alike(how: dict[str, Dialect]) -> dict[Dialect, list[str]]:
    """Sources by dialect; the order of delimiters doesn't matter."""
    out: dict[Dialect, list[str]] = {}
    for s, x in how.items():
        out.setdefault(Dialect(tuple(sorted(x.strong)), x.weak, x.joined), []).append(s)
    return out


def add_values(
    df: DataFrame,
    columns: dict[str, str],
    source: str | None = None,
    joined: tuple[str, ...] = (),
    dialects: dict[str, dict[str, Dialect]] | None = None,
) -> DataFrame:
    """``df`` with an array column of values per packed column: ``columns`` maps text to new name.

    A null, empty or blank text gives an empty array.  Texts are read whole;
    the split needs no shuffle.  Dialects that aren't given are inferred in one
    scan for all columns; sources of one dialect share one expression.  Where a
    dialect has a weak delimiter, texts without a strong one are looked up
    among the protected values (a distinct list).
    """
    src = F.coalesce(F.col(source).cast("string"), F.lit("")) if source else F.lit("")
    out = df
    missing = [t for t in columns if t not in (dialects or {})]
    known = {**(infer_dialects(df, missing, source, joined=joined) if missing else {}), **(dialects or {})}
    for i, (text, name) in enumerate(columns.items()):
        how = _alike(known[text])
        t = F.coalesce(F.col(text).cast("string"), F.lit(""))
        keep, probe = None, f"_whole{i}"
        weak = {x: names for x, names in how.items() if x.weak}
        if weak:
            asks = F.lit(False)
            for x, names in weak.items():
                asks = asks | (src.isin(*names) & ~t.rlike("|".join(r for n, r in CANDIDATES if n in x.strong)))
            asks = asks & t.contains(",")
            key = F.lower(F.regexp_replace(blank_trim(t), r"(?U)\s+", " "))
            # Of the protected values only those that some text is asked for: a short list as a rule, and then sent to every task.
            whole = _any_protected(df.select(src.alias("_s"), F.col(text).alias("_t")), weak)
            whole = cut(whole.join(df.filter(asks).select(key.alias("whole")), "whole", "left_semi"))
            if whole.limit(MOST_SENT + 1).count() <= MOST_SENT:
                whole = F.broadcast(whole)
            # Texts that ask nothing spread over keys that no value has.
            own = F.concat(F.lit(MARK), F.xxhash64(t).cast("string"))
            out = out.withColumn(probe, F.when(asks, key).otherwise(own)).join(whole.select(F.col("whole").alias(probe), F.lit(True).alias(f"_keep{i}")), probe, "left")
            keep = F.coalesce(F.col(f"_keep{i}"), F.lit(False))
        expr = values(t, Dialect(joined=text in joined))
        for x, names in how.items():
            expr = F.when(src.isin(*names), values(t, x, keep)).otherwise(expr)
        out = out.withColumn(name, expr).drop(probe, f"_keep{i}")
    return out


def split_values(
    df: DataFrame,
    key: str,
    text: str,
    source: str | None = None,
    dialects: dict[str, Dialect] | None = None,
    joined: bool = False,
) -> DataFrame:
    """One row per value: ``key, pos, val``.

    pos starts at 1.  Null, empty and blank texts give no row; repeated rows
    give their values again; a text of one value gives that value.  Columns of
    ``df`` beyond those named are ignored, whatever their names.
    """
    src = F.col(source).cast("string") if source else F.lit("")
    d = df.select(F.col(key).alias("_k"), src.alias("_s"), F.col(text).alias("_t"))
    how = None if dialects is None else {"_t": dialects}
    d = add_values(d, {"_t": "_v"}, "_s", ("_t",) if joined else (), how)
    return d.select(F.col("_k").alias(key), F.posexplode("_v").alias("pos", "val")).select(
        key, (F.col("pos") + 1).cast("long").alias("pos"), "val"
    )


def _any_protected(df: DataFrame, dialects: dict[Dialect, list[str]]) -> DataFrame:
    """``protected_values`` of all sources together, as one distinct list; one part per dialect."""
    got = None
    for x, names in dialects.items():
        part = protected_values(df.filter(F.col("_s").isin(*names)), "_t", x)
        got = part if got is None else got.union(part)
    return got.distinct()
