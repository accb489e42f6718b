"""Text features and text classification (FEA-13, TRN-11, SRC-09).

TF-IDF is computed as joins and aggregates over an exploded token table rather than a
driver-side vocabulary: tokens of whole texts are extracted with a JVM regex, document
frequencies and corpus counts are aggregates, the top-N vocabulary is a bounded top-k,
and the L2 norm is a per-document aggregate joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Tokens of two or more word characters (letters, digits, underscore; Unicode-aware).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
MAX_FEATURES = 10000
SPAM_LABEL = "spam"


def english_stop_words() -> list[str]:
    """Spark ML's built-in English stop-word list."""
    from pyspark.ml.feature import StopWordsRemover
    return StopWordsRemover.loadDefaultStopWords("english")


def tokens(df: DataFrame, doc_col: str, text_col: str, stop_words: Sequence[str] | None = None) -> DataFrame:
    """``doc, term`` one row per token occurrence (lower-cased, whole text).

    Texts are dealt by document, in tasks of bounded size: what is grouped by document and term moves no more."""
    from foldline.functions.ordered import by_key
    t = by_key(df.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("_text")), "doc").select("doc", F.explode(
        F.regexp_extract_all(F.lower(F.col("_text")), F.lit(TOKEN_PATTERN), 0)).alias("term"))
    if stop_words:
        t = t.where(~F.col("term").isin(list(stop_words)))
    return t


def term_counts(df: DataFrame, doc_col: str, text_col: str, stop_words: Sequence[str] | None = None) -> DataFrame:
    """``doc, term, tf``: raw term counts of whole texts, counted where the texts are."""
    return tokens(df, doc_col, text_col, stop_words).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def weights_from_counts(tf: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``doc, term, tf, idf, weight`` for the vocabulary's terms, L2-normalised per doc."""
    j = tf.join(F.broadcast(vocabulary.select("term", "idf")), "term")  # vocabulary <= max_features rows
    j = j.withColumn("_w", F.col("tf") * F.col("idf"))
    # a document has at most as many rows as the vocabulary
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("doc")))
    out = j.where("doc is not null").withColumn("_norm", norm)
    return out.select("doc", "term", F.col("tf").cast("long").alias("tf"), "idf",
                      (F.col("_w") / F.col("_norm")).alias("weight"))


def tfidf(df: DataFrame, doc_col: str, text_col: str, max_features: int = MAX_FEATURES,
          stop_words: Sequence[str] | None = None, vocabulary: DataFrame | None = None) -> DataFrame:
    """``doc, term, tf, idf, weight`` with smooth idf ln((1+n)/(1+df)) + 1 and L2-normalised rows.

    The vocabulary is the ``max_features`` most frequent terms (ties by term), unless a fitted
    ``vocabulary`` (``term, idf``) is passed — then unseen terms are ignored (transform mode).
    """
    tf = term_counts(df, doc_col, text_col, stop_words)
    if vocabulary is None:
        vocabulary = fit_vocabulary(df, tf, max_features)
    return weights_from_counts(tf, vocabulary)


def fit_vocabulary(docs: DataFrame | int, tf: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """``term, df, count, idf`` of the top ``max_features`` terms by corpus count (ties by term).

    ``docs`` is the document frame (counted) or the number of documents."""
    n_docs = docs if isinstance(docs, int) else docs.count()
    return _top_terms(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("count")), n_docs, max_features)


def _top_terms(stats: DataFrame, n_docs: int, max_features: int) -> DataFrame:
    """The vocabulary from ``term, df, count``."""
    top = stats.orderBy(F.col("count").desc(), "term").limit(max_features)  # bounded top-k
    idf = F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0
    return top.withColumn("idf", idf)


def labelled_text(df: DataFrame, label_col: str = "label", text_col: str = "text",
                  positive: str = SPAM_LABEL) -> DataFrame:
    """SRC-09: require label/text, drop nulls, binarise label (positive token → 1)."""
    missing = [c for c in (label_col, text_col) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    d = df.na.drop(subset=[label_col, text_col])
    lab = F.col(label_col)
    if dict(d.dtypes)[label_col] == "string":
        lab = F.when(F.lower(F.trim(lab)) == positive, 1).otherwise(0)
    return d.withColumn(label_col, lab.cast("int"))


def token_arrays(df: DataFrame, text_col: str, stop_words: Sequence[str] | None = None, out: str = "tokens") -> DataFrame:
    """``df`` with the tokens of its whole texts as an array (a null text has none)."""
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(TOKEN_PATTERN), 0)
    if stop_words:
        found = F.filter(found, lambda t: ~t.isin(list(stop_words)))
    return df.withColumn(out, found)


def vectorizer(vocabulary: DataFrame, input_col: str = "tokens"):
    """A ``PipelineModel`` from token arrays to L2-normalised TF-IDF ``features`` (term index = place in the sorted vocabulary, which has
    at most ``max_features`` rows). Texts without a term of the vocabulary get a zero vector."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors
    rows = vocabulary.select("term", "idf").orderBy("term").collect()
    counts = CountVectorizerModel.from_vocabulary([r["term"] for r in rows], inputCol=input_col, outputCol="_tf")
    weights = ElementwiseProduct(scalingVec=Vectors.dense([float(r["idf"]) for r in rows]), inputCol="_tf", outputCol="_tfidf")
    return PipelineModel([counts, weights, Normalizer(inputCol="_tfidf", outputCol="features", p=2.0)])


def text_cross_validation(df: DataFrame, doc_col: str, text_col: str, label_col: str, k: int = 5, seed: int = 42,
                          max_features: int = MAX_FEATURES, reg: float | None = None,
                          stop_words: Sequence[str] | None = None) -> DataFrame:
    """TRN-11: TF-IDF (vocabulary fitted per training fold) + logistic regression, stratified k-fold.

    Returns per-fold ``fold, n, accuracy, f1_macro, roc_auc, avg_precision, fit_time_sec``;
    all folds' predictions are scored in one grouped pass.
    """
    import time

    from pyspark.ml.classification import LogisticRegression

    from foldline.operators.metrics import evaluate
    from foldline.operators.splits import stratified_kfold

    from pyspark.ml.functions import vector_to_array

    from foldline.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    folds = stratified_kfold(df.select(doc_col, text_col, label_col), [doc_col], label_col, k=k, seeds=[seed])
    # tokenise every whole text once; folds reuse the stored tokens
    rows = token_arrays(folds, text_col, stop_words).select(F.col(doc_col).alias("doc"), "fold", F.col(label_col).cast("double").alias("label"),
                                                            "tokens").checkpoint()
    counts = rows.select("doc", "fold", F.explode("tokens").alias("term")).groupBy("doc", "fold", "term").agg(
        F.count(F.lit(1)).alias("tf"))
    # one row per term with both counts of every fold: a training vocabulary is a sum over the other folds
    of = lambda f, v: F.sum(F.when(F.col("fold") == f, v).otherwise(0))
    terms = counts.groupBy("term").agg(*[x for f in range(k) for x in (of(f, F.lit(1)).alias(f"d{f}"), of(f, F.col("tf")).alias(f"c{f}"))]).checkpoint()
    sizes = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}

    def one(g: int):
        n_train = sum(n for f, n in sizes.items() if f != g)
        others = lambda n: sum((F.col(f"{n}{f}") for f in range(k) if f != g), F.lit(0))
        seen = terms.select("term", others("d").alias("df"), others("c").alias("count")).where("df > 0")
        vectors = vectorizer(_top_terms(seen, n_train, max_features))
        train_set = vectors.transform(rows.where(F.col("fold") != g)).select("features", "label").cache()
        # L2 strength of C = 1 in the (sum-of-losses) primal form: regParam = 1 / (C · n_train)
        rp = reg if reg is not None else 1.0 / max(n_train, 1)
        t0 = time.time()
        model = LogisticRegression(maxIter=100, regParam=rp).fit(train_set)
        fit_s = time.time() - t0
        train_set.unpersist()
        p = model.transform(vectors.transform(rows.where(F.col("fold") == g))).select(
            F.lit(g).alias("fold"), F.col("label").cast("int").alias("y_true"),
            F.col("prediction").cast("int").alias("y_pred"), vector_to_array("probability")[1].alias("score"))
        return (g, fit_s), p.checkpoint()

    # independent folds are submitted concurrently; the cluster runs their jobs side by side
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=k) as pool:
        results = list(pool.map(one, range(k)))
    fit_times = [r[0] for r in results]
    preds = [r[1] for r in results]
    allp = preds[0]
    for p in preds[1:]:
        allp = allp.unionByName(p)
    m = evaluate(allp, ["fold"], "classification", score="score")
    ft = df.sparkSession.createDataFrame(fit_times, "fold int, fit_time_sec double")
    res = m.join(ft, "fold")
    return res
