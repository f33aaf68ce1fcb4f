"""Quality classification: logistic regression over hashed word n-grams, trained with FTRL-proximal updates.

Words are runs of letters and digits (bytes of 0x80 and above count as letters) and runs of other visible
characters; case is kept. The n-grams are single words and pairs of neighbours, hashed to 2^bits places. One more place, of
its own, counts words that repeat one of the two words before them, whatever words they are. A document's vector holds the
logarithm of one plus each place's count, scaled to length one.

Training reads a bounded sample (about `most` rows, those of the smallest seeded hash), dealt by hash to
`shards` learners. Each passes over its rows `passes` times with FTRL updates, and the learners' weights are
averaged, so a task holds most / shards rows whatever the table's size.

Defined cases: null and empty texts have no n-grams and get the score of the bias alone. With no labelled rows all
weights are 0 and every score is 0.5. Repeated labels of a document all count. Extra columns are kept; score
replaces a column of this name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import mixed, slices, span_hashes, spans, utf8

BITS = 18
SAMPLE = 32_000
SHARDS = 4
SHARD_ROWS = 4000
PASSES = 3
THRESHOLD = 0.3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1

_KIND = np.full(256, 2, dtype=np.uint8)  # 0: between words, 1: letters and digits, 2: other visible characters
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1


def vectors(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row its sorted places and their values."""
    kind = _KIND[data]
    starts, ends, rows = spans(kind > 0, offsets, kind)
    one = span_hashes(data, starts, ends)
    down = np.uint64(64 - bits)
    two = mixed(one[:-1] * np.uint64(0xD6E8FEB86659FD93) + one[1:]) >> down
    same = [np.concatenate((one[k:] == one[: len(one) - k], np.zeros(min(k, len(one)), bool))) for k in (1, 2)]
    one = one >> down
    bounds = np.searchsorted(rows, np.arange(len(offsets)))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        again = sum(int(x[a : max(a, b - k)].sum()) for k, x in enumerate(same, 1))
        repeats = np.full(again, 1 << bits, np.uint64)
        places, n = np.unique(np.concatenate((one[a:b], two[a : max(a, b - 1)], repeats)).astype(np.int32), return_counts=True)
        values = np.log1p(n)
        out.append((places, values / max(1e-12, float(np.sqrt(values @ values)))))
    return out


class Learner:
    """Follow the regularised leader, per coordinate, over 2^bits places and `more` of their own; the last place is the bias."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, more: int = 0):
        self.z, self.n = np.zeros((1 << bits) + more + 1), np.zeros((1 << bits) + more + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, places: np.ndarray, values: np.ndarray, label: int) -> None:
        at, x = np.append(places, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(at)
        g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        before = self.n[at]
        self.n[at] = before + g * g
        self.z[at] += g - (np.sqrt(before + g * g) - np.sqrt(before)) / self.alpha * w


def sampled(labels: DataFrame, key: str, most: int = SAMPLE) -> DataFrame:
    """The rows of `labels` with the smallest seeded hashes of `key`, about `most` of them: a key's rows stay together."""
    n = labels.count()
    share = min(1.0, most / max(1, n))
    h = F.shiftrightunsigned(F.xxhash64(F.lit("ftrl"), F.col(key)), 11)  # 53 bits
    return labels.where(h < F.lit(int(share * (1 << 53))))


def shards_for(rows: int) -> int:
    """Learners for a sample of `rows`: few rows are not worth dividing."""
    return max(1, min(SHARDS, rows // SHARD_ROWS))


def train(labelled: DataFrame, text: str = "text", label: str = "label", key: str = "key", bits: int = BITS, shards: int = SHARDS, passes: int = PASSES) -> np.ndarray:
    """The averaged weights of learners over all rows of `labelled` (text, 0/1 label, key): a bounded sample, see sampled()."""
    sample = labelled.where(F.col(label).isin(0, 1)).select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("int").alias("label"), F.xxhash64(F.lit("order"), F.col(key)).alias("h"))

    def fit(rows: pa.Table) -> pa.Table:
        seen: list[tuple[int, tuple[np.ndarray, np.ndarray], int]] = []
        for batch in rows.select(["text", "label", "h"]).to_batches():
            data, offsets = utf8(batch.column(0))
            labels, keys = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, j in slices(offsets):
                own = vectors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bits)
                seen += zip(keys[i:j], own, labels[i:j], strict=True)
        seen.sort(key=lambda x: (x[0], x[2], len(x[1][0])))
        learner = Learner(bits, more=1)  # the repeats
        for _ in range(passes):
            for _, (places, values), y in seen:
                learner.learn(places, values, y)
        w = learner.weights()
        at = np.flatnonzero(w)
        # place -1 tells how many rows the learner saw
        return pa.table({"place": pa.array(np.append(at, -1), pa.int32()), "w": pa.array(np.append(w[at] * len(seen), 0.0)), "rows": pa.array(np.append(np.zeros(len(at), np.int64), len(seen)))})

    # a group a learner: `shards` of them, whatever the number of partitions
    fitted = sample.groupBy(F.pmod("h", F.lit(shards))).applyInArrow(fit, "place int, w double, rows long")
    # at most shards * (2^bits + 3) short rows, whatever the corpus
    got = fitted.groupBy("place").agg(F.sum("w").alias("w"), F.sum("rows").alias("rows")).toArrow()
    weights = np.zeros((1 << bits) + 2)
    places, w = got["place"].to_numpy(), got["w"].to_numpy()
    total = max(1, int(got["rows"].to_numpy().sum()))
    weights[places[places >= 0]] = w[places >= 0] / total
    return weights.astype(np.float32)


def score(documents: DataFrame, weights: np.ndarray, text: str = "text", bits: int = BITS) -> DataFrame:
    """`documents` with `score`: the probability of label 1, a sparse dot product a document."""
    kept = [c for c in documents.columns if c != "score"]
    schema = documents.select(*kept).schema.add("score", "double")
    shared = documents.sparkSession.sparkContext.broadcast(weights)  # 2^bits + 2 floats

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(np.float64)
        for batch in batches:
            data, offsets = utf8(batch.column(kept.index(text)))
            sums = np.full(len(offsets) - 1, w[-1])
            for i, j in slices(offsets):
                for k, (places, values) in enumerate(vectors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bits), i):
                    sums[k] += w[places] @ values
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1.0 / (1.0 + np.exp(-np.clip(sums, -35, 35))))], names=[*kept, "score"])

    return documents.select(*kept).mapInArrow(predict, schema)
