"""Option scoring: vocabulary (P9), naive-Bayes fit/score (M1, W3), nearest
centroid (W4), softmax (W1), ranking (W2), decision assembly (P12),
continuation split (W5), answer-only masks (P8).

Scale notes
- Scoring never shuffles a text: tokens are exploded where the text is read,
  meet the model, and leave the task as one partial sum per class.
- The model table is (label, token) for tokens seen with a label; the score
  of unseen (label, token) pairs is a per-label constant folded in
  arithmetically, so the labels × vocabulary matrix is never materialised.
- The model is a written table of rows of bounded width (`token_key`). Its most frequent tokens, as
  many as ``HOT_BYTES`` hold, are broadcast; a larger model's rare tokens are joined by token, which
  moves their occurrences only: no frequent token is a key of a shuffle (`with_values`). Both parts
  read the tokens, so a larger model has them written once: texts are parsed and split a single time.
- Softmax/ranking windows are partitioned by item: a group is one item's
  options, bounded by the option count, never by data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbiter.functions.subquery import attach_classes, class_array, row_value
from arbiter.functions.text import tokens
from arbiter.operators.ordinal import ordinal_within
from arbiter.session import staged


def _cols(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


# ---- token tables -------------------------------------------------------------------

#: Bytes of a token table that are broadcast; tokens longer than TOKEN_BYTES stand for themselves by a digest.
HOT_BYTES, TOKEN_BYTES = 32 << 20, 64


def token_key(token: Column) -> Column:
    """A token, or "#" and the SHA-256 of a long one (tokens are letters and digits)."""
    return F.when(F.octet_length(token) <= TOKEN_BYTES, token).otherwise(F.concat(F.lit("#"), F.sha2(token, 256)))


def hot_and_cold(table: DataFrame, freq: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows of a table (_token, ...) with the highest ``freq`` that ``HOT_BYTES`` hold, and the others."""
    room = HOT_BYTES // (TOKEN_BYTES + 8 * (len(table.columns) + 4))
    octave = F.floor(F.log2(F.col(freq).cast("double")) * 4)
    at = table.groupBy(octave.alias("octave")).agg(F.count(F.lit(1)).alias("n"))  # 4 rows for each power of two
    least, held = None, 0
    counts = at.orderBy(F.desc("octave")).collect()
    for r in counts:
        if held + r["n"] > room:
            return table.where(octave >= least if least is not None else F.lit(False)), table.where(
                octave < least if least is not None else F.lit(True)
            )
        least, held = r["octave"], held + r["n"]
    return table, None


def with_values(
    rows: DataFrame, token: str, parts: tuple[DataFrame, DataFrame | None], freq: str, outer: bool = False
) -> DataFrame:
    """``rows`` with the columns of a written table (_token, freq, values) for their token; ``parts``: its `hot_and_cold`.

    Every row whose token the table has comes once with its values. With ``outer`` all rows come, and
    those of tokens outside the broadcast part once more without values: sums over values are the same.
    Each part reads ``rows``: with a cold part, callers write the token arrays first.
    """
    hot, cold = parts
    keyed = rows.withColumn("_token", token_key(F.col(token)))
    found = keyed.join(F.broadcast(hot.drop(freq).withColumn("_hot", F.lit(True))), "_token", "left")
    met = (found if outer else found.where("_hot")).drop("_token", "_hot")
    if cold is None:
        return met
    missed = found.where("_hot IS NULL AND _token IS NOT NULL").select("_token", *rows.columns)
    return met.unionByName(missed.join(cold.drop(freq), "_token").drop("_token"))


# ---- P9 vocabulary ------------------------------------------------------------------


def build_vocab(df: DataFrame, text: str) -> DataFrame:
    """(token, n, id) with ids 0.. by descending frequency, then token."""
    counts = (
        df.select(F.explode(tokens(text)).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = ordinal_within(counts.withColumn("_neg", -F.col("n")), [], ["_neg", "token"], out="id")
    return ranked.drop("_neg")


# ---- M1 / W3 naive Bayes ------------------------------------------------------------


def fit_nb(train: DataFrame, key: str = "rec_id", text: str = "state", label: str = "answer") -> dict[str, DataFrame]:
    """M1: multinomial naive Bayes with Laplace smoothing on the training rows.

    Returns ``priors`` (label, log_prior, default_logp) and ``model``
    (label, token, delta) where delta = ln((c+1)/(N+V)) − ln(1/(N+V)) = ln(c+1).
    """
    n_docs = train.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_label"))
    lt = (
        train.select(F.col(label).alias("label"), F.explode(tokens(text)).alias("token"))
        .groupBy("label", "token")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    # The model is a table, so scoring reads it instead of recomputing the fit in every branch.
    lt = staged(lt, "nb-counts")
    n_docs = staged(n_docs, "nb-labels")
    n_tokens = lt.groupBy("label").agg(F.sum("c").alias("N"))
    vocab = lt.select("token").distinct()
    v = vocab.agg(F.count(F.lit(1)).alias("V"))
    total = n_docs.agg(F.sum("n_label").alias("n_all"))
    priors = _priors(n_docs, n_tokens, v, total)
    model = lt.select("label", "token", "c", F.log(F.col("c") + 1).alias("delta"))
    return {"priors": priors, "model": model, "vocab": vocab}


def _priors(n_docs: DataFrame, n_tokens: DataFrame, v: DataFrame, total: DataFrame) -> DataFrame:
    p = n_docs.join(n_tokens, "label", "left")
    n = F.coalesce(F.col("N"), F.lit(0))
    return p.select(
        "label",
        F.log(F.col("n_label") / row_value(total)["n_all"]).alias("log_prior"),
        (-F.log(n + row_value(v)["V"])).alias("default_logp"),
    )


def score_nb(
    docs: DataFrame,
    fitted: dict[str, DataFrame],
    key: str | list[str] = "rec_id",
    text: str = "state",
    prior_only: bool = False,
) -> DataFrame:
    """(key columns, label, logp) = log prior + Σ over in-vocabulary token
    occurrences of ln P(token | label); tokens outside the vocabulary are ignored.

    Each vocabulary token carries a dense vector over the classes, vec[i] =
    ln P(token | class i). An item's scores are sums of those vectors: one column a
    class, added up before the only shuffle, which moves the key and the class sums.
    """
    keys = _cols(key)
    labels = fitted["priors"].select("label", "log_prior", "default_logp")
    if prior_only:
        return attach_classes(docs.select(*keys), labels).select(*keys, "label", F.col("log_prior").alias("logp"))
    classes = labels.orderBy("label").collect()  # the label set
    deltas = fitted["model"].groupBy("token").agg(
        F.map_from_entries(F.collect_list(F.struct("label", "delta"))).alias("deltas"), F.sum("c").alias("freq")
    )
    vec = [
        (F.lit(c["default_logp"]) + F.coalesce(F.col("deltas")[c["label"]], F.lit(0.0))).alias(f"_v{i}")
        for i, c in enumerate(classes)
    ]
    dense = staged(deltas.select(token_key(F.col("token")).alias("_token"), "freq", *vec), "nb-vectors")
    parts = hot_and_cold(dense, "freq")
    read = docs.select(*keys, tokens(text).alias("_tokens"))
    if parts[1] is not None:
        read = staged(read, "nb-tokens")
    # explode_outer keeps items without any token.
    found = read.select(*keys, F.explode_outer("_tokens").alias("token"))
    found = with_values(found, "token", parts, "freq", outer=True)
    sums = found.groupBy(*keys).agg(
        *[F.coalesce(F.sum(f"_v{i}"), F.lit(0.0)).alias(f"_s{i}") for i in range(len(classes))]
    )
    rows = [
        F.struct(F.lit(c["label"]).alias("label"), (F.lit(c["log_prior"]) + F.col(f"_s{i}")).alias("logp"))
        for i, c in enumerate(classes)
    ]
    if not rows:
        return sums.select(*keys, F.lit(None).cast("string").alias("label"), F.lit(0.0).alias("logp")).limit(0)
    return sums.select(*keys, F.explode(F.array(*rows)).alias("_r")).select(*keys, "_r.label", "_r.logp")


# ---- W4 centroids ----------------------------------------------------------------------


def centroids(train: DataFrame, vec: str = "embedding", label: str = "label") -> DataFrame:
    """(label, dim, c): class means per dimension, as DOUBLE."""
    return (
        train.select(F.col(label).alias("label"), F.posexplode(vec).alias("dim", "x"))
        .groupBy("label", "dim")
        .agg(F.avg(F.col("x").cast("double")).alias("c"))
    )


def score_centroid(items: DataFrame, cents: DataFrame, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(key, label, logp = dot(vector, centroid)).

    The centroid table (classes × dimensions, independent of the number of
    vectors) becomes one array of (label, centroid vector) values read by
    every task, so scoring is a projection: no join on the dimension index
    (which would put each dimension — a handful of keys — in one task).
    """
    per_class = cents.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("dim", "c"))).alias("_dc"))
    table = per_class.select("label", F.transform("_dc", lambda e: e["c"]).alias("centroid"))
    with_classes = items.select(key, F.col(vec).alias("_v"), class_array(table).alias("_classes"))
    dots = F.transform(
        "_classes",
        lambda cl: F.struct(
            cl["label"].alias("label"),
            F.aggregate(
                F.zip_with(F.col("_v"), cl["centroid"], lambda x, c: x.cast("double") * c),
                F.lit(0.0),
                lambda acc, t: acc + F.coalesce(t, F.lit(0.0)),
            ).alias("logp"),
        ),
    )
    return with_classes.select(key, F.explode(dots).alias("d")).select(key, "d.label", "d.logp")


# ---- W1 / W2 / P12 ------------------------------------------------------------------------


def softmax(scores: DataFrame, item: str | list[str], logp: str = "logp", digits: int = 6) -> DataFrame:
    """p = exp(lp − max) / Σ exp(lp − max) per item, rounded."""
    w = Window.partitionBy(*_cols(item))
    z = F.exp(F.col(logp) - F.max(logp).over(w))
    return scores.withColumn("_z", z).withColumn(
        "p", F.round(F.col("_z") / F.sum("_z").over(w), digits)
    ).drop("_z")


def rank_options(probs: DataFrame, item: str | list[str], pos: str = "pos") -> DataFrame:
    """Rank 1.. by p descending; ties keep option order."""
    w = Window.partitionBy(*_cols(item)).orderBy(F.col("p").desc(), F.col(pos))
    return probs.withColumn("rank", F.row_number().over(w))


def assemble_decision(ranked: DataFrame, item: str) -> DataFrame:
    """Top label, key, confidence, probability map and ranking per item."""
    opt = F.struct("rank", "label", "key", "p")
    agg = ranked.groupBy(item).agg(
        F.min_by(F.struct("label", "key", "p"), F.col("rank")).alias("top"),
        F.map_from_entries(F.collect_list(F.struct("label", "p"))).alias("probabilities"),
        F.sort_array(F.collect_list(opt)).alias("ranking"),
    )
    return agg.select(
        item,
        F.col("top.label").alias("label"),
        F.col("top.key").alias("key"),
        F.col("top.p").alias("confidence"),
        "probabilities",
        F.transform("ranking", lambda r: F.struct(r["label"].alias("label"), r["key"].alias("key"), r["p"].alias("p"))).alias("ranking"),
    )


# ---- W5 continuation ------------------------------------------------------------------------


def continuation(prompt_ids: Column, full_ids: Column) -> Column:
    """struct(shared, tail, error): tail = full after the longest common prefix."""
    diff = F.zip_with(prompt_ids, full_ids, lambda a, b: ~F.equal_null(a, b))
    first = F.array_position(diff, F.lit(True))
    shared = F.when(first == 0, F.least(F.size(prompt_ids), F.size(full_ids))).otherwise(first - 1)
    tail = F.slice(full_ids, shared + 1, F.greatest(F.size(full_ids) - shared, F.lit(0)))
    return F.struct(
        shared.alias("shared"),
        tail.alias("tail"),
        F.when(F.size(tail) == 0, F.lit("option produced no tokens")).alias("error"),
    )


# ---- P8 masks ---------------------------------------------------------------------------------


IGNORE = -100


def answer_mask(prompt_len: Column, ids: Column, max_len: int, full_loss: bool = False) -> Column:
    """Labels for a tokenised example (−100 = not supervised).

    ids are truncated to max_len; the first min(len(prompt), len(ids)) labels
    are masked; if that masks everything the last label is kept.
    """
    ids = F.slice(ids, 1, max_len)
    if full_loss:
        return ids
    n_mask = F.least(prompt_len, F.size(ids))
    labels = F.concat(
        F.array_repeat(F.lit(IGNORE), n_mask), F.slice(ids, n_mask + 1, F.greatest(F.size(ids) - n_mask, F.lit(0)))
    )
    all_masked = (F.size(labels) > 0) & F.forall(labels, lambda x: x == IGNORE)
    fixed = F.concat(F.slice(labels, 1, F.size(labels) - 1), F.array(F.element_at(ids, -1)))
    return F.when(all_masked, fixed).otherwise(labels)
