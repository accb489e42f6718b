"""Which texts contain any token of a table (JOI-07), with one plan at any number of tokens.

Different texts are stored once and meet the tokens in ascending order of token length; a text that has one leaves. Tokens
shorter than ``MAX_GRAM`` are met whole: a text emits its distinct grams of exactly that length, so a meeting is a hit and no
token meets texts that merely share a part of it. Longer tokens are posted under one of their ``MAX_GRAM``-grams, the one
that the fewest tokens share, and each meeting is verified by ``contains``. At most ``MAX_GRAM`` rounds; the work grows with
the characters of texts and tokens, not with their product. Only token lists of at most ``BROADCAST_TOKENS`` are broadcast.

At most ``FEW_TOKENS`` tokens of ``FEW_CHARS`` characters in all need no grams: every text is searched for each of them as it is read.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.session import checkpoint_dir

MAX_GRAM = 16
SALTS = 4                      # copies of a long token list, so that a frequent gram of the texts is cut into several tasks
BROADCAST_TOKENS = 100_000
FEW_TOKENS = 64
FEW_CHARS = 10_000


def _grams(chars: Column, q: Column | int) -> Column:
    """Distinct grams of ``q`` characters (at most ``MAX_GRAM``) of an array of characters, in a time that grows with its length:
    the array is made once per row, as a lambda's argument, and a gram reads its own characters only."""
    def joined(c: Column, i: Column) -> Column:
        if isinstance(q, int):
            return F.concat(*[F.get(c, i + j) for j in range(q)])
        return F.concat_ws("", *[F.when(F.lit(j) < q, F.get(c, i + j)) for j in range(MAX_GRAM)])      # nulls are left out

    def of(c: Column) -> Column:
        n = F.size(c) - q + 1
        at = F.when(n >= 1, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: joined(c, i))

    return F.array_distinct(F.get(F.transform(F.array(chars), of), F.lit(0)))


def _gram_length(n: Column) -> Column:
    out = F.lit(1)
    q = 2
    while q <= MAX_GRAM:
        out = F.when(n >= q, F.lit(q)).otherwise(out)
        q *= 2
    return out


def token_postings(tokens: DataFrame) -> DataFrame:
    """``tok, q, gram`` for every non-empty token of ``tokens(tok)``: its rarest gram among all tokens."""
    t = _distinct_tokens(tokens).withColumn("q", _gram_length(F.length("tok")))
    long = t.select("tok", "q", F.explode(_grams(F.split("tok", ""), F.col("q"))).alias("gram"))
    shared = long.groupBy("q", "gram").agg(F.count(F.lit(1)).alias("n"))
    return long.join(shared, ["q", "gram"]).groupBy("tok", "q").agg(F.min(F.struct("n", "gram")).alias("best")).select(
        "tok", "q", F.col("best.gram").alias("gram"))


def _met(long: DataFrame, posted: DataFrame, n_posted: int, n_texts: int, how: str) -> DataFrame:
    """Equi-join of ``long(id, gram)`` and ``posted(gram, ...)``."""
    if n_posted <= BROADCAST_TOKENS:
        return long.join(F.broadcast(posted), "gram", how)
    salts = SALTS if n_texts > BROADCAST_TOKENS else 1
    long = long.withColumn("salt", F.pmod(F.col("id"), F.lit(salts)).cast("int"))
    posted = posted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # the sizes of exploded rows can't be estimated before they are made, so a broadcast is ruled out
    return long.join(posted.hint("merge"), ["gram", "salt"], how)


def _few(toks: DataFrame) -> list[str] | None:
    """All of ``toks(tok)`` if they are few and short, else nothing."""
    n, chars = toks.agg(F.count(F.lit(1)), F.sum(F.length("tok"))).first()
    return sorted(r["tok"] for r in toks.select("tok").collect()) if n <= FEW_TOKENS and (chars or 0) <= FEW_CHARS else None


def _with_any(texts: DataFrame, few: list[str]) -> DataFrame:
    found = reduce(operator.or_, [F.contains(F.col("value"), F.lit(t)) for t in few], F.lit(False))
    return texts.select("column_name", "value").where(found)


def columns_with_tokens(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """Distinct ``column_name`` of :func:`texts_with_tokens`; with few tokens, texts are neither stored nor shuffled for it."""
    checkpoint_dir(texts.sparkSession)
    toks = _distinct_tokens(tokens).checkpoint()
    few = _few(toks)
    hits = texts_with_tokens(texts, toks) if few is None else _with_any(texts, few)
    return hits.select("column_name").distinct()


def _distinct_tokens(tokens: DataFrame) -> DataFrame:
    return tokens.select(F.col("tok").cast("string").alias("tok")).where("tok <> ''").distinct()


def texts_with_tokens(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """Distinct ``column_name, value`` of ``texts(column_name, value)`` whose value contains a token of ``tokens(tok)``.

    Grams travel with the number of their text, not with the text."""
    checkpoint_dir(texts.sparkSession)
    toks = _distinct_tokens(tokens).withColumn("q", F.least(F.length("tok"), F.lit(MAX_GRAM))).checkpoint()
    few = _few(toks)
    if few is not None:
        return _with_any(texts, few).distinct()
    rounds = sorted((r["q"], r["n"]) for r in toks.groupBy("q").agg(F.count(F.lit(1)).alias("n")).collect())   # up to MAX_GRAM rows
    out = texts.select("column_name", "value").limit(0)
    if not rounds:
        return out
    rest = texts.select("column_name", "value").where("value <> ''").distinct().withColumn(
        "id", F.monotonically_increasing_id()).checkpoint()
    for q, n in rounds:
        n_texts = rest.count()
        if not n_texts:
            break
        now = toks.where(F.col("q") == q)
        long = rest.select("id", F.explode(_grams(F.split("value", ""), F.lit(q))).alias("gram"))
        if q < MAX_GRAM:
            hits = _met(long, now.select(F.col("tok").alias("gram")), n, n_texts, "left_semi").select("id").distinct()
        else:
            met = _met(long, token_postings(now).select("gram", "tok"), n, n_texts, "inner").select("id", "tok").distinct()
            candidates = met.groupBy("id").agg(F.collect_list("tok").alias("toks"))     # as many as the text has grams, about
            hits = rest.join(candidates.hint("merge"), "id").where(
                F.exists("toks", lambda t: F.contains(F.col("value"), t))).select("id")
        hits = hits.checkpoint()
        out = out.unionByName(rest.join(hits, "id", "left_semi").select("column_name", "value"))
        if q != rounds[-1][0]:
            rest = rest.join(hits, "id", "left_anti").checkpoint()
    return out
