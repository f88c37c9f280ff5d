"""Toxicity by non-negative positive-unlabelled learning on hashed words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, types
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from lumenframe.llm import text as T

#: Hashed features; the trained model is this many floats and a constant, whatever the corpus.
FEATURES = 1 << 18
#: Bounds of the training sample: confirmed toxic rows, and unlabelled rows (expected number).
MOST_POSITIVE = 20_000
MOST_UNLABELLED = 60_000
#: Classifiers, each trained in a task of its own on its share of the sample; their margins are averaged.
BAGS = 4
THRESHOLD = 0.3
#: Features are screened: kept where the share of confirmed toxic rows with it is off the share of the
#: unlabelled rows by this many standard errors, and where so many sampled rows of a bag have it.
LEAST_Z, LEAST_DOCUMENTS = 4.0, 4
STEPS, RATE, DECAY = 600, 0.05, 2e-4
#: Marks that don't belong to a word.
MARKS = ".,;:!?\"'()[]{}<>*#$%&|/\\-_=+~^`"


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed lower-case words of each text, in a row, and the offsets of each text in them."""
    flat, bounds = T.words(texts)
    codes, distinct = T.coded(flat)
    plain = pc.utf8_trim(pc.utf8_lower(distinct), MARKS)
    hashes = np.fromiter((xxh32_intdigest(w.encode()) % FEATURES for w in plain.to_pylist()), np.int64, len(plain))
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    pairs = np.unique(rows * FEATURES + (hashes[codes] if len(codes) else np.zeros(0, np.int64)))
    return pairs % FEATURES, np.searchsorted(pairs, np.arange(len(bounds)) * FEATURES)


def margins(index: np.ndarray, bounds: np.ndarray, weights: np.ndarray, constant: float) -> np.ndarray:
    """Sum of the weights of each text's features and the constant."""
    sums = np.concatenate([[0.0], np.cumsum(weights[index], dtype=np.float64)])
    return sums[bounds[1:]] - sums[bounds[:-1]] + constant


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def nn_risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """Both parts of the risk from the scores of positive and unlabelled rows: prior * E+[l(z)], and Eu[l(-z)] - prior * E+[l(-z)], which isn't below 0 for a true prior."""
    toxic, clean = (lambda p: -np.log(np.maximum(p, 1e-12))), (lambda p: -np.log1p(-np.minimum(p, 1 - 1e-12)))
    return prior * toxic(zp).mean(), clean(zu).mean() - prior * clean(zp).mean()


def nn_gradient(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """What to follow by the margins of positive and unlabelled rows: the risk's gradient, or that of the second part backwards where it is negative."""
    if nn_risk(zp, zu, prior)[1] >= 0:
        return np.full(len(zp), -prior / len(zp)), zu / len(zu)
    return prior * zp / len(zp), -zu / len(zu)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, float]:
    """Weights and constant that minimise the non-negative risk with the logistic loss.

    Only features that pass the screen (LEAST_Z, LEAST_DOCUMENTS) get a weight.  The risk is prior * E+[l(z)] + max(0, Eu[l(-z)] - prior * E+[l(-z)]); where the second part
    is negative, its gradient is followed backwards, so that the classifier doesn't fit the
    unlabelled rows further (as the estimator's authors do).  Steps are Adam's, over all rows.
    At last the constant is set so that the mean score of the unlabelled rows is the prior.
    """
    count = lambda rows: np.bincount(np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), minlength=FEATURES)
    in_pos, in_unl = count(positive), count(unlabelled)
    usual = (in_unl + 1) / (len(unlabelled) + 2)
    z = (in_pos / len(positive) - usual) / np.sqrt(usual * (1 - usual) * (1 / len(positive) + 1 / len(unlabelled)))
    kept = np.flatnonzero((np.abs(z) >= LEAST_Z) & (in_pos + in_unl >= LEAST_DOCUMENTS))
    place = np.full(FEATURES, -1)
    place[kept] = np.arange(len(kept))
    pick = lambda rows: [p[p >= 0] for p in (place[r] for r in rows)]
    pos, unl = pick(positive), pick(unlabelled)
    w, b = np.zeros(len(kept)), float(np.log(prior / (1 - prior)))
    z = [(np.concatenate([*rows, np.zeros(0, np.int64)]), np.concatenate([[0], np.cumsum([len(r) for r in rows])])) for rows in (pos, unl)]
    moments = np.zeros((2, len(kept) + 1))
    for t in range(1, STEPS + 1):
        zp, zu = (sigmoid(margins(i, e, w, b)) for i, e in z)
        gp, gu = nn_gradient(zp, zu, prior)
        g = np.append(DECAY * w, gp.sum() + gu.sum())
        for (i, e), own in zip(z, (gp, gu), strict=True):
            g[:-1] += np.bincount(i, np.repeat(own, np.diff(e)), len(kept))
        moments = np.array([[0.9], [0.999]]) * moments + np.array([[0.1], [0.001]]) * np.array([g, g * g])
        step = RATE * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * moments[0] / (np.sqrt(moments[1]) + 1e-6)
        w, b = w - step[:-1], b - float(step[-1])
    # The constant that gives the unlabelled rows the class prior as their mean score.
    low, high, plain = -30.0, 30.0, margins(*z[1], w, 0.0)
    while high - low > 1e-6:
        b = (low + high) / 2
        low, high = (b, high) if sigmoid(plain + b).mean() < prior else (low, b)
    full = np.zeros(FEATURES)
    full[kept] = w
    return full, b


def held_out(id_: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, float] | None:
    """Train on ``df`` and the labels of rows that aren't held out; None where no row is confirmed toxic.

    At most MOST_POSITIVE confirmed rows (by hash of the id) and about MOST_UNLABELLED others, also by hash,
    make the sample; the class prior is the share of toxic rows among all labels outside the held-out
    part.  Only the BAGS trained models (FEATURES floats each) come to the driver.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
    prior = known.agg(F.avg(F.col("y").cast("double"))).first()[0]
    if not prior:
        return None
    prior = float(min(max(prior, 1e-4), 1 - 1e-4))
    toxic = known.filter("y = 1").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(MOST_POSITIVE)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(~held_out(F.col("id")))
    share = min(1.0, MOST_UNLABELLED / max(1, df.count()))
    drawn = F.pmod(F.xxhash64("id", F.lit("unlabelled")), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = docs.join(F.broadcast(toxic.withColumn("confirmed", F.lit(True))), "id", "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))
    own = F.pmod(F.xxhash64("id", F.lit("bag")), F.lit(BAGS)).cast("int")
    sample = sample.filter(F.col("confirmed") | drawn).select("confirmed", F.when(drawn, own).otherwise(-1).alias("own"), "text")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches):
            index, bounds = features(b.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(index.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("own"), b.column("confirmed"), lists], ["own", "confirmed", "words"])

    def learn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pos = list(rows.words[rows.confirmed])
        unl = list(rows.words[rows.own == rows.bag]) or pos
        if not pos:
            return pd.DataFrame({"weights": [], "constant": []})
        w, b = train(pos, unl, prior)
        return pd.DataFrame({"weights": [w.astype(np.float32).tobytes()], "constant": [b]})

    taken = sample.mapInArrow(take, "own int, confirmed boolean, words array<int>")
    # Every bag has all confirmed rows and its own share of the unlabelled ones.
    bags = taken.withColumn("bag", F.explode(F.when(F.col("confirmed"), F.sequence(F.lit(0), F.lit(BAGS - 1))).otherwise(F.array("own"))))
    models = bags.groupBy("bag").applyInPandas(learn, "weights binary, constant double").collect()
    if not models:
        return None
    return np.mean([np.frombuffer(m.weights, np.float32) for m in models], axis=0), float(np.mean([m.constant for m in models]))


def score(df: DataFrame, model: tuple[np.ndarray, float] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the columns score (0 to 1) and predicted added; all its columns are kept.

    Null texts count as empty (their score is the constant's); without a model every score is 0.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    kept = df.withColumn("_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches, "_text"):
            at = b.schema.get_field_index("_text")
            if held.value is None:
                p = np.zeros(b.num_rows)
            else:
                p = sigmoid(margins(*features(b.column(at)), *held.value))
            rest = [c for i, c in enumerate(b.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))],
                                             [*[n for n in b.schema.names if n != "_text"], "score", "predicted"])

    schema = types.StructType([*df.schema.fields, types.StructField("score", types.DoubleType()), types.StructField("predicted", types.IntegerType())])
    return kept.mapInArrow(rate, schema)


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on ``df`` and ``labels`` and score every row: the id, held_out, score, predicted.

    Rows that repeat an id are scored each for itself; null ids are never held out; an empty table gives an
    empty result.  Nothing but the text goes into a score.
    """
    model = fit(df, labels, id_col, text_col)
    out = score(df.select(id_col, text_col), model, id_col, text_col)
    return out.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), "score", "predicted")


def keep_clean(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that aren't predicted toxic, with the columns of ``df``.

    Null and empty texts have the constant's score, rows that repeat others go or stay with them, null ids count as any other, and
    without a confirmed toxic row, or without rows, nothing goes.
    """
    model = fit(df, labels, id_col, text_col)
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    plain = df.toDF(*names.values())
    return score(plain, model, names[id_col], names[text_col]).filter("predicted = 0").select(*[F.col(v).alias(k) for k, v in names.items()])
