"""Toxicity of texts by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Works on clip texts (``clip_id``, ``description``; user hints just as well) and on moderation labels (``clip_id``,
``toxic`` 0 or 1). Features are the distinct words, word pairs and pairs with one word between of a text, hashed.
Every coordinate has its own learning rate, and L1 leaves most weights at exactly 0, so that what is broadcast to
score all texts is a short list of (feature, weight).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written_once
from .batches import all_cores, mixed, slices

#: Bits of the hashed feature space; weights, and so the broadcast, are at most 12 bytes times 2 ** BITS.
BITS = 20
#: Labelled texts of the fit: about as many, chosen by the hash of their keys; texts of one learner, passes over them.
SAMPLE_TEXTS, LEARNER_TEXTS, EPOCHS = 40_000, 10_000, 4
#: Learning rate, its offset, and the strengths of L1 and L2.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.5
#: Words are runs of letters and digits, lower-cased: marks that stick to a word don't hide it.
_WORD = regex.compile(r"[^\W_]+")
_SEEDS = mixed(np.array([11, 12, 13], np.uint64))


@dataclass(frozen=True)
class Weights:
    """Weights other than 0 by feature number, and the constant."""

    features: np.ndarray  # int32, rising
    values: np.ndarray  # float64
    constant: float
    texts: int  # learned from


def fit_weights(
    texts: DataFrame, labels: DataFrame, key: str = "clip_id", text: str = "description", label: str = "toxic",
    sample_texts: int = SAMPLE_TEXTS,
) -> Weights:
    """Learn weights from labelled texts.

    Labels are 0 or 1 per key; rows without key or label don't count, and a key with both labels has the greater one.
    Of a key with several texts the smallest counts (null: empty). Beyond ``sample_texts`` labelled keys, those with
    the smallest hashes are the sample, about as many; its keys are broadcast, so texts are not shuffled for the join.
    The sample is dealt by hash to one learner per LEARNER_TEXTS, which sees its texts in order of their hashes,
    EPOCHS times; the learners' weights are averaged. Without labelled texts all weights are 0 (score 0.5).
    """
    spark = texts.sparkSession
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(
        F.max((F.col(label) > 0).cast("int")).alias("_label")
    )
    known = known.select(F.col(key).alias("_key"), "_label", F.xxhash64(key).alias("_hash"))
    count = known.count()
    bound = round(-(2**63) + 2.0**64 * min(1.0, sample_texts / max(count, 1)))
    sample = F.broadcast(known if count <= sample_texts else known.where(F.col("_hash") < min(bound, 2**63 - 1)))
    rows = texts.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(sample, "_key")
    one = rows.groupBy("_key", "_label", "_hash").agg(F.min("_text").alias("_text"))
    learners = max(1, -(-min(count, sample_texts) // LEARNER_TEXTS))
    examples = one.select("_hash", "_label", "_text").mapInArrow(
        lambda b: _examples(b, learners), "learner int, position bigint, label int, features array<int>"
    )
    learned = examples.groupBy("learner").applyInArrow(_learn, "feature int, value double, texts bigint")
    mean = learned.groupBy("feature").agg((F.sum("value") / learners).alias("value"), F.sum("texts").alias("texts"))
    pairs = written_once(mean).orderBy("feature").collect()  # at most 2 ** BITS + 1 rows
    constant = next((r for r in pairs if r.feature < 0), None)
    pairs = [r for r in pairs if r.feature >= 0]
    return Weights(
        np.array([r.feature for r in pairs], np.int32),
        np.array([r.value for r in pairs], np.float64),
        constant.value if constant else 0.0,
        constant.texts if constant else 0,
    )


def score_toxicity(texts: DataFrame, weights: Weights, key: str = "clip_id", text: str = "description") -> DataFrame:
    """``key``, ``score`` (0 to 1) and ``predicted`` (1 from a half on) of every whole text.

    Null and empty texts have no features: their score is that of the constant. Null keys stay; repeated rows give a
    result each; an empty table gives none; other columns are ignored whatever their names. Rows are independent and
    nothing is shuffled; memory is bounded by the weights, a slice of text and the longest text.
    """
    source = all_cores(texts.select(key, text), text)
    shared = texts.sparkSession.sparkContext.broadcast((weights.features, weights.values, weights.constant))
    kind = source.schema[0].dataType.simpleString()

    def run(batches):
        features, values, constant = shared.value
        table = np.zeros(1 << BITS, np.float64)
        table[features] = values
        used = table != 0
        for batch in slices(batches, 1):
            of, feature = _features(batch.column(1), used)
            total = constant + np.bincount(of, table[feature], batch.num_rows)
            score = _sigmoid(total)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [key, "score", "predicted"]
            )

    return source.mapInArrow(run, f"`{key}` {kind}, score double, predicted int")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def _features(column: pa.Array, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of every text as (text, feature) pairs in order; of ``used`` features only, if given."""
    import xxhash

    words = [_WORD.findall((x or "").lower()) for x in column.to_pylist()]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    number: dict[str, int] = {}
    at = np.fromiter((number.setdefault(w, len(number)) for x in words for w in x), np.int64, int(sizes.sum()))
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) for w in number), np.uint64, len(number))
    tokens = hashed[at]
    of = np.repeat(np.arange(len(words)), sizes)
    owners, found = [], []
    for gap, seed in enumerate(_SEEDS):  # single words, neighbours, neighbours but one
        if gap:
            same = of[gap:] == of[:-gap]
            owner, value = of[gap:][same], mixed(tokens[:-gap][same] * seed + tokens[gap:][same])
        else:
            owner, value = of, tokens
        feature = (value >> np.uint64(64 - BITS)).astype(np.int64)
        if used is not None:
            hit = used[feature]
            owner, feature = owner[hit], feature[hit]
        owners.append(owner)
        found.append(feature)
    pairs = np.unique((np.concatenate(owners) << BITS) | np.concatenate(found))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _examples(batches, learners: int) -> Iterator[pa.RecordBatch]:
    names = ["learner", "position", "label", "features"]
    for batch in slices(batches, 2):
        of, feature = _features(batch.column(2))
        position = mixed(np.asarray(batch.column(0)).view(np.uint64))
        offsets = np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array((position % np.uint64(learners)).astype(np.int32)),
                pa.array((position >> np.uint64(1)).astype(np.int64)),
                batch.column(1),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(feature.astype(np.int32))),
            ],
            names,
        )


def _learn(examples: pa.Table) -> pa.Table:
    """Follow the regularised leader through a learner's texts; its weights other than 0, the constant as feature -1."""
    examples = examples.sort_by([("position", "ascending"), ("label", "ascending")]).combine_chunks()
    label = np.asarray(examples.column("label"))
    lists = examples.column("features").combine_chunks()
    offsets, flat = np.asarray(lists.offsets), np.asarray(lists.values)
    pull, seen = np.zeros(1 << BITS), np.zeros(1 << BITS)  # the gradient sums of the method and of their squares
    bias_pull = bias_seen = 0.0
    for _ in range(EPOCHS):
        for lo, hi, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), label.tolist(), strict=True):
            at = flat[lo:hi]
            z, n = pull[at], seen[at]
            root = np.sqrt(n)
            w = _weights(z, root, L1)
            bias = float(_weights(bias_pull, bias_seen**0.5, 0.0))
            g = float(_sigmoid(w.sum() + bias)) - y
            grown = np.sqrt(n + g * g)
            pull[at] = z + g - (grown - root) / ALPHA * w
            seen[at] = n + g * g
            bias_pull += g - ((bias_seen + g * g) ** 0.5 - bias_seen**0.5) / ALPHA * bias
            bias_seen += g * g
    w = _weights(pull, np.sqrt(seen), L1)
    feature = np.flatnonzero(w)
    texts = np.zeros(len(feature) + 1, np.int64)
    texts[0] = len(label)
    return pa.table(
        {
            "feature": np.concatenate([[-1], feature]).astype(np.int32),
            "value": np.concatenate([[float(_weights(bias_pull, bias_seen**0.5, 0.0))], w[feature]]),
            "texts": texts,
        }
    )


def _weights(pull, root, l1: float):
    """Weights of the leader: 0 within the L1 strength, else by a rate of the coordinate's own."""
    return np.where(np.abs(pull) <= l1, 0.0, (np.sign(pull) * l1 - pull) / ((BETA + root) / ALPHA + L2))
