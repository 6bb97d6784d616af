"""Texts cut off by field limits or in transfer.

Each text passes a stack automaton that follows quotes, brackets and markup
and looks for broken multibyte sequences, entities and escapes at the end; the
end itself is classed as a terminator, a closing structure (signature, list,
label line, heading ...), an ellipsis or nothing.  What a missing terminator
says is judged per source: by the source's share of unterminated texts, by the
lengths at which its unterminated texts pile up (the field limit), and by
closing phrases that always run the same.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litloom.runtime import cut

# Pairs of marks, and words that end with a full stop inside a sentence.
PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "„": "“"}
ABBREVIATIONS = ("i.e.", "e.g.", "i.", "e.", "al.", "cf.", "vs.", "fig.", "no.", "pp.", "p.", "dr.", "prof.", "approx.", "ca.", "z.", "z.b.", "d.", "d.h.", "bzw.", "p. ej.", "ej.")
VOID = ("br", "hr", "img", "p", "li", "input", "meta")
MARKS = re.compile(r'[()\[\]{}“”„«»"]|<(/?)([A-Za-z][A-Za-z0-9]*)\b[^<>]*?(/?)>')
TAIL = re.compile(r"(?:\s|</?[A-Za-z][^<>]*>)+\Z")
ELLIPSIS = re.compile(r"(?:…|\.\.\.|\[\s*(?:…|\.\.\.|more|cont(?:inued|\.)?|truncated)\s*\]|\((?:…|\.\.\.|more)\))\s*\Z", re.I)
BROKEN = re.compile(r"(?:�|&#?\w{0,8}|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|%[0-9A-Fa-f]?|<[/A-Za-z]?[^<>]*)\Z")
SENTENCE = re.compile(r"[.!?。？！](?:[\"”»’')\]]|</\w+>)*\Z")
# For the JVM: a word of four letters or more, its stop, closing marks and blanks at the end; and the words of that length that also stop inside a sentence or a mark.
WORD_STOP = r"(?:^|[^\p{L}\p{N}.])\p{L}{4,}[.!?][\"”»’')\]]*\s*\z"
SHORT_STOP = r"(?i)(?:prof|approx|cont)\.[\"”»’')\]]*\s*\z"
SPLIT = re.compile(r"(?<=[.!?…])[\"”»)\]]*\s+|\n+")
LABEL = re.compile(r"(?:[-*•–]\s+\S|—\s*\S|©|[A-Z][\w ]{1,24}:\s*\S|[A-Z]\w+ \d+\s*\|)")
SCHEMA = "open int, broken boolean, kind string, segment string, lead string, n_chars int, n_bytes int"  # segment: a hash of the last sentence, blank if it has fewer than three words


def _open_marks(text: str) -> int:
    """Marks that are opened and never closed; a straight quote closes itself, a stray closer is ignored."""
    stack: list[str] = []
    for m in MARKS.finditer(text):
        s = m.group(0)
        if m.group(2):
            name = m.group(2).lower()
            if m.group(1):
                if "<" + name in stack:
                    while stack.pop() != "<" + name:
                        pass
            elif not m.group(3) and name not in VOID:
                stack.append("<" + name)
        elif s == '"':
            if '"' in stack:
                while stack.pop() != '"':
                    pass
            else:
                stack.append('"')
        elif s == "“" and stack and stack[-1] == "“":
            stack.pop()  # closes „
        elif s in PAIRS:
            stack.append(PAIRS[s])
        elif s in stack:
            while stack.pop() != s:
                pass
    return len(stack)


def inspect(text: str | None) -> tuple:
    """What the automaton says of one text; kind is one of empty, sentence, closing, heading, ellipsis, none."""
    if text is None or not text.strip():
        return 0, False, "empty", "", "", 0, 0
    size = len(text), len(text.encode("utf-8", "replace"))
    body = TAIL.sub("", text)
    open_marks = _open_marks(body)
    broken = bool(BROKEN.search(body)) and not re.search(r"\d%\Z", body)
    parts = [p for p in SPLIT.split(body) if p and p.strip()]
    segment = parts[-1].strip() if parts else ""
    first = " ".join(segment.split()[:2])
    kind = "none"
    line = body.rsplit("\n", 1)[-1].strip()
    words = body.split()
    if ELLIPSIS.search(body):
        kind = "ellipsis"
    elif SENTENCE.search(body):
        last = words[-1].lower()
        cut_number = re.search(r"(?<!\d)\d{1,3}\.\Z", body) and not re.search(r"\b(?:1[5-9]|20)\d\d\.\Z", body)
        kind = "none" if last in ABBREVIATIONS or cut_number else "sentence"
    elif re.search(r"[.!?]\s*[(\[][^()\[\]]*[)\]]\Z", body):
        kind = "closing"  # a reference or remark in brackets after the last sentence
    elif "\n" in body.strip() and (LABEL.match(line) or (len(line.split()) <= 4 and all(w[:1].isupper() for w in line.split()))):
        kind = "closing"
    elif "\n" in body.strip() and len(line.split()) <= 9 and re.search(r"\b\d{1,2} [A-Z]\w+\b", line) and re.search(r"\b(?:19|20)\d\d\Z", line):
        kind = "closing"  # a line of dates
    elif re.match(r"[©—]", segment):
        kind = "closing"
    elif len(words) <= 9 and len(body) <= 90 and not re.search(r"[,;()\d]|\w[.!?]\s", body) and body[:1].isupper() and text[-1:].strip():
        kind = "heading"
    # The whole segment is compared, by its hash; two words are no phrase.
    phrase = hashlib.blake2b(segment.encode("utf-8", "replace"), digest_size=12).hexdigest() if len(segment.split()) >= 3 else ""
    return open_marks, broken, kind, phrase, first, *size


def _inspect_all(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([inspect(t) for t in texts], columns=["open", "broken", "kind", "segment", "lead", "n_chars", "n_bytes"])


def truncated(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    least_pile: int = 5,
    least_formula: int = 3,
    usual_share: float = 0.5,
) -> DataFrame:
    """``key, source, cut, reason, field_limit`` for every row.

    A text is cut if a mark stays open or a sequence is broken where the end
    lacks a terminator, if it ends in an ellipsis that isn't a closing phrase
    of the collection (one that follows its first two words in at least nine
    of ten unterminated ends, in ``least_formula`` different texts), if it
    ends in mid-sentence and less than ``usual_share`` of its source's texts
    do, or if a closing line ends exactly at the source's field limit: the
    length, in characters or bytes, at which most of its unterminated texts
    pile up (``least_pile`` or more, and five times their median per length, or
    half of all where the source usually ends its texts).
    Null, empty and blank texts are not cut.  A null source is a source of its
    own.  Equal texts get equal results in one source.  Whole texts are read.
    """
    look = F.pandas_udf(_inspect_all, SCHEMA)
    # A text that ends in a word and its stop is terminated, whatever stands open before: only the others need the automaton.
    # (An end of more than 64 letters, such as many blanks, goes there too.)
    t = F.col(text)
    end = F.substring(t, -64, 64)
    ends = F.coalesce(end.rlike(WORD_STOP) & ~end.rlike(SHORT_STOP), F.lit(False))
    seen = docs.select(F.col(key).alias("_k"), F.col(source).cast("string").alias("_s"), F.xxhash64(text).alias("_h"), ends.alias("_e"), look(F.when(~ends, t)).alias("_i"))
    # Read by four aggregations; the texts themselves are not kept.
    seen = cut(seen.select("_k", "_s", "_h", "_e", "_i.*").withColumn("kind", F.when(F.col("_e"), "sentence").otherwise(F.col("kind"))).drop("_e"))
    loose = F.col("kind").isin("none", "ellipsis")
    # The source's habit: its share of unterminated texts.
    habit = seen.filter("kind <> 'empty'").groupBy("_s").agg(F.avg(loose.cast("int")).alias("loose_share")).withColumnRenamed("_s", "_s2")
    # Field limits: piles of unterminated texts per source and length.
    ends = seen.filter(loose).select("_s", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("size")))).alias("u"))
    sizes = ends.groupBy("_s", "u.unit", "u.size").agg(F.count("*").alias("n"))
    w = Window.partitionBy("_s", "unit")
    tops = sizes.withColumn("usual", F.percentile_approx("n", F.lit(0.5)).over(w)).withColumn("all_n", F.sum("n").over(w))
    tops = tops.join(habit, F.col("_s").eqNullSafe(F.col("_s2")))
    half = (2 * F.col("n") >= F.col("all_n")) & (F.col("loose_share") <= usual_share)
    tops = tops.filter((F.col("n") >= least_pile) & ((F.col("n") >= 5 * F.col("usual")) | half))
    limits = tops.groupBy("_s").agg(
        F.max(F.when(F.col("unit") == "chars", F.struct("n", "size"))).alias("c"), F.max(F.when(F.col("unit") == "bytes", F.struct("n", "size"))).alias("b")
    )
    limits = limits.select(F.col("_s").alias("_s1"), F.col("c.size").alias("limit_chars"), F.col("b.size").alias("limit_bytes"))
    # Closing phrases: all unterminated ends with the same first two words run the same.
    tails = seen.filter(loose & (F.col("lead") != "")).groupBy("lead", "segment", "_h").agg(F.count("*").alias("c")).groupBy("lead", "segment").agg(F.count("*").alias("n"))
    lead = tails.groupBy("lead").agg(F.sum("n").alias("all_n"), F.max(F.struct("n", "segment")).alias("top"))
    formula = lead.filter((F.col("top.n") >= least_formula) & (F.col("top.n") >= 0.9 * F.col("all_n")) & (F.col("top.segment") != ""))
    formula = formula.select(F.col("top.segment").alias("segment"), F.lit(True).alias("formula"))
    d = seen.join(limits, F.col("_s").eqNullSafe(F.col("_s1")), "left").join(habit, F.col("_s").eqNullSafe(F.col("_s2")), "left")
    d = d.join(formula, "segment", "left")
    at_limit = (F.col("n_chars") == F.col("limit_chars")) | (F.col("n_bytes") == F.col("limit_bytes"))
    open_end = F.col("kind").isin("none", "ellipsis", "heading")
    reason = (
        F.when(F.col("kind") == "empty", None)
        .when(F.col("broken") & (F.col("kind") != "sentence"), "broken sequence")
        .when((F.col("open") > 0) & open_end, "open mark")
        .when((F.col("kind") == "ellipsis") & F.col("formula").isNull(), "ellipsis")
        .when((F.col("kind") == "none") & F.coalesce(at_limit, F.lit(False)), "field limit")
        .when((F.col("kind") == "none") & (F.col("loose_share") <= usual_share) & F.col("formula").isNull(), "no terminator")
        .when((F.col("kind") == "closing") & F.coalesce(at_limit, F.lit(False)), "field limit")
    )
    return d.withColumn("reason", reason).select(
        F.col("_k").alias(key), F.col("_s").alias(source), F.col("reason").isNotNull().alias("cut"), "reason", F.col("limit_chars").alias("field_limit")
    )


def truncation_report(found: DataFrame, source: str = "source") -> DataFrame:
    """Per source: texts, cut texts, their share and the field limit."""
    return found.groupBy(source).agg(
        F.count("*").alias("n_texts"),
        F.sum(F.col("cut").cast("long")).alias("n_cut"),
        F.avg(F.col("cut").cast("double")).alias("cut_share"),
        F.max("field_limit").alias("field_limit"),
    )
