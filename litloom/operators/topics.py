"""Topics: vectors, clusters with outliers, topic words, LDA sweeps and coherence.

Sentence models, UMAP and HDBSCAN are not part of Spark: precomputed vectors
are accepted, and hashed tf-idf, PCA and k-means with outliers by distance take
their place.  The result has the same form (id, topic, -1 for outliers) but is
not the same partition; see the README.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, PCA, CountVectorizer, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litloom.functions import text
from litloom.runtime import cut, shared_path


def token_lists(rows: DataFrame, key: str, body: str, two: bool = False) -> DataFrame:
    """[P34, P35] ``key, words``: tokens, with word pairs if ``two``; texts without a token are left out."""
    t = rows.select(key, text.tokens(F.col(body)).alias("words"))
    if two:
        t = t.select(key, F.concat("words", text.ngrams(F.col("words"), 2)).alias("words"))
    return t.filter(F.size("words") > 0)


def vocabulary(lists: DataFrame, key: str, min_df: int = 2) -> DataFrame:
    """[P35] ``term, uses, n_docs`` of terms in ``min_df`` documents or more; summed per document before anything moves on."""
    per = lists.select(key, F.explode("words").alias("term")).groupBy("term", key).agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("uses"), F.count("*").alias("n_docs")).filter(F.col("n_docs") >= min_df)


def vectors(lists: DataFrame, key: str, size: int = 1 << 12) -> DataFrame:
    """[M2] ``key, vector``: hashed tf-idf of length 1, in place of a sentence model."""
    tf = HashingTF(inputCol="words", outputCol="tf", numFeatures=size).transform(lists)
    idf = IDF(inputCol="tf", outputCol="w").fit(tf).transform(tf)
    return Normalizer(inputCol="w", outputCol="vector").transform(idf).select(key, "vector")


def reduced(vecs: DataFrame, key: str, k: int) -> DataFrame:
    """[M4] ``key, coords``: principal components, in place of UMAP."""
    return PCA(k=k, inputCol="vector", outputCol="p").fit(vecs).transform(vecs).select(key, vector_to_array("p").alias("coords"))


def clusters(vecs: DataFrame, key: str, k: int = 12, outliers: float = 0.1, smallest: int = 15, seed: int = 42) -> DataFrame:
    """[M5, M6] ``key, topic``: k-means; the share ``outliers`` farthest from their centre and clusters below ``smallest`` are -1.

    Fewer than three topics are tried once more with five clusters.
    """

    def once(n: int) -> DataFrame:
        model = KMeans(k=n, seed=seed, featuresCol="vector", predictionCol="c").fit(vecs)
        centres = model.clusterCenters()
        d = model.transform(vecs).select(key, "c", vector_to_array("vector").alias("v"))
        spark = vecs.sparkSession
        cs = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "c int, z array<double>")
        dist = F.aggregate(F.zip_with("v", "z", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        d = d.join(F.broadcast(cs), "c").select(key, "c", dist.alias("dist"))
        limit = d.agg(F.percentile_approx("dist", 1 - outliers).alias("limit"))
        size = d.groupBy("c").agg(F.count("*").alias("n"))
        d = d.join(F.broadcast(size), "c").join(F.broadcast(limit), F.lit(True))
        return cut(d.select(key, F.when((F.col("n") < smallest) | (F.col("dist") > F.col("limit")), -1).otherwise(F.col("c")).alias("topic")))

    got = once(k)
    if got.filter("topic >= 0").select("topic").distinct().count() < 3 and k > 5:
        got = once(5)
    return got


def topic_words(lists: DataFrame, assigned: DataFrame, key: str, k: int = 10) -> DataFrame:
    """[M7, P39] ``topic, words, label``: the k words of largest class tf-idf, tf x log(1 + A / f); ties by word."""
    w = lists.join(assigned, key).filter("topic >= 0").select("topic", F.explode("words").alias("word"))
    tf = w.groupBy("topic", "word").agg(F.count("*").alias("tf"))
    f = tf.groupBy("word").agg(F.sum("tf").alias("f"))
    size = tf.groupBy("topic").agg(F.sum("tf").alias("size"))
    mean = size.agg(F.avg("size").alias("a"))
    s = tf.join(f, "word").join(F.broadcast(size), "topic").join(F.broadcast(mean), F.lit(True))
    s = s.withColumn("score", F.col("tf") / F.col("size") * F.log(1 + F.col("a") / F.col("f")))
    r = s.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), "word"))).filter(F.col("r") <= k)
    out = r.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("r", "word"))).alias("x"))
    words = F.transform("x", lambda v: v["word"])
    return out.select("topic", words.alias("words"), text.topic_label(F.col("topic"), words).alias("label"))


def topic_years(assigned: DataFrame, years: DataFrame, key: str) -> DataFrame:
    """[M11, A17, F11] ``year, topic, n`` without outliers."""
    return assigned.filter("topic <> -1").join(years, key).groupBy("year", "topic").agg(F.count("*").alias("n"))


def window_counts(lists: DataFrame, vocab: list[str], window: int = 110) -> tuple[int, np.ndarray]:
    """[M10] How many sliding windows there are, and in how many every two words of a short list stand (a word with itself: its own).

    A text's windows are one small matrix of the words in them; each task sums up one table.
    """
    n = len(vocab)

    def run(batches):
        both, total, words = np.zeros((n, n)), 0, pa.array(vocab, pa.string())
        for b in batches:
            lists_ = b.column(0)
            ids = np.asarray(pc.fill_null(pc.index_in(lists_.flatten().cast(pa.string()), words), -1))
            ends = np.cumsum(np.asarray(pc.list_value_length(lists_)))
            for seq in np.split(ids, ends[:-1]):
                many = max(len(seq) - window + 1, 1)
                total += many
                at = np.flatnonzero(seq >= 0)
                u, col = np.unique(seq[at], return_inverse=True)
                step = np.zeros((many + 1, len(u)), np.float32)
                np.add.at(step, (np.maximum(at - window + 1, 0), col), 1)
                np.add.at(step, (np.minimum(at, many - 1) + 1, col), -1)
                seen = (np.cumsum(step[:-1], axis=0) > 0).astype(np.float32)
                both[np.ix_(u, u)] += seen.T @ seen
        yield pa.RecordBatch.from_pydict({"total": [total], "both": [both.tobytes()]}, schema=pa.schema([("total", pa.int64()), ("both", pa.binary())]))

    got = lists.select("words").mapInArrow(run, "total long, both binary").rdd.map(lambda r: (r["total"], np.frombuffer(r["both"])))
    total, both = got.treeReduce(lambda x, y: (x[0] + y[0], x[1] + y[1]))
    return max(1, total), both.reshape(n, n)


def coherence(lists: DataFrame, words: list[list[str]], window: int = 110) -> float:
    """[M10] c_v coherence: sliding windows, normalised pointwise mutual information, cosine with the topic's sum vector."""
    return coherences(lists, [words], window)[0]


def coherences(lists: DataFrame, models: list[list[list[str]]], window: int = 110) -> list[float]:
    """[M10] c_v coherence of each of several models; the windows of all are counted in one pass."""
    vocab = sorted({w for words in models for t in words for w in t})
    if not vocab:
        return [0.0 for _ in models]
    total, both = window_counts(lists, vocab, window)
    place = {w: i for i, w in enumerate(vocab)}

    def npmi(a: str, b: str) -> float:
        i, j = place[a], place[b]
        p, q = both[i, j] / total, both[i, i] / total * both[j, j] / total
        if not q:
            return 0.0
        return math.log((p + 1e-12) / q) / -math.log(p + 1e-12) if p < 1 else 1.0

    out = []
    for words in models:
        scores = []
        for t in words:
            rows = [[npmi(a, b) for b in t] for a in t]
            sums = [sum(c) for c in zip(*rows, strict=True)]
            ls = math.sqrt(sum(x * x for x in sums))
            for r in rows:
                lr = math.sqrt(sum(x * x for x in r))
                scores.append(sum(x * y for x, y in zip(r, sums, strict=True)) / (lr * ls) if lr and ls else 0.0)
        out.append(float(sum(scores) / max(1, len(scores))))
    return out


def _digamma(x: np.ndarray) -> np.ndarray:
    """The logarithmic derivative of the gamma function, for positive values."""
    shift = sum(1.0 / (x + i) for i in range(6))
    y = x + 6
    z = 1.0 / (y * y)
    return np.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z / 252)) - shift


def _expected(x: np.ndarray) -> np.ndarray:
    """exp of the expected logarithm under Dirichlet distributions, one per row."""
    x = x.astype(np.float64)
    return np.exp(_digamma(x) - _digamma(x.sum(1, keepdims=True))).astype(np.float32)


BATCH = 200  # texts whose variational parameters are found at once: their arrays stay in a core's cache
INNER, CHANGE = 4, 1e-3  # steps for one text in a pass (the next goes on from there), and the mean change at which it is settled


def _bags(lists: DataFrame, vocab: list[str]) -> DataFrame:
    """Texts in batches, as packed counts: ``id, sizes, word, n``; texts without a word of the vocabulary are left out."""
    size = len(vocab)

    def run(batches):
        from pyspark import TaskContext

        words, part, k = pa.array(vocab, pa.string()), TaskContext.get().partitionId(), 0
        for b in batches:
            lengths = np.asarray(pc.list_value_length(b.column(0)))
            ids = np.asarray(pc.fill_null(pc.index_in(b.column(0).flatten().cast(pa.string()), words), -1)).astype(np.int64)
            doc = np.repeat(np.arange(len(lengths)), lengths)[ids >= 0]
            code, n = np.unique(doc * size + ids[ids >= 0], return_counts=True)
            for first in range(0, len(lengths), BATCH):
                a, z = np.searchsorted(code, [first * size, (first + BATCH) * size])
                if z > a:
                    sizes = np.unique(code[a:z] // size, return_counts=True)[1]
                    yield pa.RecordBatch.from_pydict(
                        {"id": [f"{part}-{k}"], "sizes": [sizes.astype(np.int32).tobytes()], "word": [(code[a:z] % size).astype(np.int32).tobytes()], "n": [n[a:z].astype(np.float32).tobytes()]},
                        schema=pa.schema([("id", pa.string()), ("sizes", pa.binary()), ("word", pa.binary()), ("n", pa.binary())]),
                    )
                    k += 1

    return lists.select("words").mapInArrow(run, "id string, sizes binary, word binary, n binary")


def _settled(word, n, sizes, beta, gamma, alpha) -> np.ndarray:
    """Variational parameters of texts (topics in rows), each iterated until it changes no more, ``INNER`` times at most."""
    out, left, b = gamma.copy(), np.arange(len(sizes)), beta[:, word]
    for _ in range(INNER):
        doc = np.repeat(np.arange(len(left)), sizes)
        et = _expected(out[:, left].T).T
        r = n / (np.einsum("ij,ij->j", et[:, doc], b) + 1e-30)
        new = alpha + et * np.add.reduceat(b * r, np.cumsum(sizes) - sizes, axis=1)
        moves = np.abs(new - out[:, left]).mean(0) >= CHANGE
        out[:, left] = new
        if not moves.any():
            break
        if moves.mean() < 0.7:
            keep = moves[doc]
            left, sizes, b, n = left[moves], sizes[moves], b[:, keep], n[keep]
    return out


def _lda(bags: DataFrame, size: int, ks: list[int], passes: int, seed: int) -> dict[int, np.ndarray]:
    """Topics (in rows, weights of words) of an LDA model for each k by variational Bayes; a pass over the texts serves all models.

    A text's parameters go on from where the last pass left them, in files of
    the shared folder: each pass reads those of the last and writes its own.
    """
    spark, at = bags.sparkSession, shared_path(bags.sparkSession, "lda")
    rng = {k: np.random.default_rng([seed, k]) for k in ks}
    lam = {k: rng[k].gamma(100.0, 0.01, (k, size)) for k in ks}
    rows = bags.rdd

    def folder():
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/*", "file:///", at if ":" in at else f"file://{at}")))
        return fs, files, root

    for p in range(passes):
        shared = spark.sparkContext.broadcast({k: _expected(v) for k, v in lam.items()})

        def run(part, p=p, shared=shared):
            fs, files, root = folder()
            files.create_dir(f"{root}/{p % 2}", recursive=True)
            stats = {k: np.zeros((k, size)) for k in ks}
            for r in part:
                word, n, sizes = np.frombuffer(r["word"], np.int32), np.frombuffer(r["n"], np.float32), np.frombuffer(r["sizes"], np.int32)
                doc, gammas, done = np.repeat(np.arange(len(sizes)), sizes), None, []
                if p:
                    with files.open_input_file(f"{root}/{(p - 1) % 2}/{r['id']}") as f:
                        gammas = np.split(np.frombuffer(f.read(), np.float32).reshape(-1, len(sizes)), np.cumsum(ks)[:-1])
                for i, k in enumerate(ks):
                    beta = shared.value[k]
                    g = _settled(word, n, sizes, beta, gammas[i] if p else np.ones((k, len(sizes)), np.float32), np.float32(1 / k))
                    done.append(g)
                    et = _expected(g.T).T[:, doc]
                    w = n / (np.einsum("ij,ij->j", et, beta[:, word]) + 1e-30)
                    for t in range(k):
                        stats[k][t] += np.bincount(word, et[t] * w, size)
                with files.open_output_stream(f"{root}/{p % 2}/{r['id']}") as f:
                    f.write(np.concatenate(done).astype(np.float32).tobytes())
            yield stats

        stats = rows.mapPartitions(run).treeReduce(lambda x, y: {k: x[k] + y[k] for k in x})
        lam = {k: 1 / k + stats[k] * shared.value[k] for k in ks}
        shared.destroy()
    fs, files, root = folder()
    if files.get_file_info(root).type == fs.FileType.Directory:
        files.delete_dir(root)
    return lam


MOST_WEIGHTS = 1 << 20  # weights of the models that one pass fits together


def lda_sweep(lists: DataFrame, ks=range(3, 16), min_df: int = 2, max_df: float = 0.9, passes: int = 20, final_passes: int = 30, seed: int = 42, top: int = 10):
    """[M8, M9] ``(scores, topics)``: coherence per k, and the words of the best k fitted with more passes.

    A pass goes over all texts, for as many of the models as fit together.
    """
    spark = lists.sparkSession
    vocab = CountVectorizer(inputCol="words", outputCol="features", minDF=min_df, maxDF=max_df).fit(lists).vocabulary
    parts = max(2 * spark.sparkContext.defaultParallelism, lists.rdd.getNumPartitions())
    bags = cut(_bags(lists, vocab).repartition(parts))
    groups: list[list[int]] = []
    for k in ks:
        if groups and (sum(groups[-1]) + k) * len(vocab) <= MOST_WEIGHTS:
            groups[-1].append(k)
        else:
            groups.append([k])

    def words(lam: np.ndarray) -> list[list[str]]:
        return [[vocab[i] for i in np.argsort(-t, kind="stable")[:top]] for t in lam]

    fitted = {k: words(v) for g in groups for k, v in _lda(bags, len(vocab), g, passes, seed).items()}
    scores = list(zip(fitted, coherences(lists, list(fitted.values())), strict=True))
    best = max(scores, key=lambda s: (s[1], -s[0]))[0]
    topics = [(i, w, " ".join(w)) for i, w in enumerate(words(_lda(bags, len(vocab), [best], final_passes, seed)[best]))]
    return (
        spark.createDataFrame([(k, float(s), k == best) for k, s in scores], "k int, coherence double, best boolean"),
        spark.createDataFrame(topics, "topic int, words array<string>, line string"),
    )
