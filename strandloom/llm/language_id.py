"""Language identification by rank-order n-gram profiles.

A language's profile is the list of its most frequent character n-grams, most frequent first. A document's own
list is compared with each profile by out-of-place distance: the sum, over the document's n-grams, of how far
each one's rank lies from its rank in the profile (a missing one counts as the profile's length). The nearest
profile wins.

At most `MAX_LANGUAGES` profiles are learned; a table of more languages ends in an error.

Defined cases: text that is null or has no letter is `und` with score 0. Languages at equal distance go to the
smaller code. N-grams of equal count rank by their code. With no labelled training row there are no profiles and
every document is `und`. Extra columns are kept; lang_pred and score
replace columns of these names. Texts are read whole, in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import tidied

UNKNOWN = "und"
PROFILE = 400
LONGEST = 3
PIECE = 1 << 20
FLUSH = 1 << 20
MAX_LANGUAGES = 2000
SALTS = 64

_letter = np.zeros(0, dtype=bool)


def _letters() -> np.ndarray:
    global _letter
    if not len(_letter):
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letter


def _merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(codes) == 1:
        return codes[0], counts[0]
    every, at = np.unique(np.concatenate(codes), return_inverse=True)
    return every, np.bincount(at, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct letter n-grams of one to three characters and their counts.

    Letters are lower-cased and every run of other characters becomes one gap. A gram is packed 21 bits a
    character; it may begin or end with a gap but is never a gap alone.
    """
    codes, counts = [], []
    text = text or ""
    for at in range(0, len(text), PIECE):
        # two characters of overlap; a gram counts in the piece that it ends in
        back = min(at, LONGEST - 1)
        lead = text[at - back : at].lower()
        points = np.frombuffer((lead + text[at : at + PIECE].lower()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        points = np.where(_letters()[points], points, 0).astype(np.int64)
        own = np.arange(len(points)) >= len(lead)
        if at == 0:
            points, own = np.concatenate(([0], points)), np.concatenate(([False], own))
        if at + PIECE >= len(text):
            points, own = np.concatenate((points, [0])), np.concatenate((own, [True]))
        kept = np.ones(len(points), dtype=bool)
        kept[1:] = (points[1:] != 0) | (points[:-1] != 0)
        points, own = points[kept], own[kept]
        if not points.any():
            continue
        pairs = (points[:-1] << 21) | points[1:]
        grams = [points[own & (points != 0)], pairs[own[1:] & (pairs != 0)] | (1 << 61)]
        if len(points) > 2:
            grams.append(((pairs[:-1] << 21) | points[2:])[own[2:] & (points[1:-1] != 0)] | (1 << 62))
        every, n = np.unique(np.concatenate(grams), return_counts=True)
        codes.append(every)
        counts.append(n)
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes, counts = _merged(codes, counts)
    return codes, counts


def ranked(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The `most` most frequent codes, in order; ties by code."""
    if len(codes) > 4 * most:  # drop what cannot be among them before sorting
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))][:most]


def learn_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles of every language of `labelled`: counted over all its rows, `size` grams a language."""

    @tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for name, (codes, counts) in held.items():
                every, n = _merged(codes, counts)
                yield pa.record_batch({"lang": pa.array([name] * len(every), pa.string()), "gram": pa.array(every), "n": pa.array(n, pa.int64())})

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, n = gram_counts(value)
                if len(codes):
                    own = held.setdefault(name, ([], []))
                    own[0].append(codes)
                    own[1].append(n)
                    waiting += len(codes)
                    if waiting > FLUSH:
                        held.update({k: tuple([x] for x in _merged(*v)) for k, v in held.items()})
                        waiting = sum(len(v[0][0]) for v in held.values())
                        if waiting > FLUSH // 2:
                            yield from flush()
                            held, waiting = {}, 0
        yield from flush()

    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    totals = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # best of each salt first, so that no task ranks a language's whole vocabulary
    order = [F.desc("n"), F.asc("gram")]
    salted = Window.partitionBy("lang", "salt").orderBy(*order)
    best = totals.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(SALTS))).withColumn("r", F.row_number().over(salted)).where(F.col("r") <= size)
    top = best.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= size)
    found: dict[str, list[tuple[int, int]]] = {}
    for name, gram, r in top.select("lang", "gram", "r").toLocalIterator():
        found.setdefault(name, []).append((r, gram))
        if len(found) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages: is {lang} a language column?")
    return {name: np.array([g for _, g in sorted(found[name])], dtype=np.int64) for name in sorted(found)}


def identify(documents: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", size: int = PROFILE) -> DataFrame:
    """`documents` with lang_pred and score: 1 less the nearest profile's share of the greatest possible distance."""
    names = sorted(profiles)
    tables = [(profiles[n][np.argsort(profiles[n])], np.argsort(profiles[n])) for n in names]

    def nearest(value: str | None) -> tuple[str, float]:
        codes, counts = gram_counts(value)
        if not len(codes) or not names:
            return UNKNOWN, 0.0
        own = ranked(codes, counts, size)
        ranks = np.arange(len(own))
        away = []
        for grams, places in tables:
            if not len(grams):
                away.append(size * len(own))
                continue
            at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            away.append(int(np.where(grams[at] == own, np.minimum(np.abs(places[at] - ranks), size), size).sum()))
        best = int(np.argmin(away))
        return names[best], 1.0 - away[best] / (size * len(own))

    kept = [c for c in documents.columns if c not in ("lang_pred", "score")]
    schema = documents.select(*kept).schema.add("lang_pred", "string").add("score", "double")

    @tidied
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nearest(x) for x in batch.column(kept.index(text)).to_pylist()]
            columns = [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score"])

    return documents.select(*kept).mapInArrow(predict, schema)


def trained_on(documents: DataFrame, out: Column, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles of the rows of `documents` that are not held out."""
    return learn_profiles(documents.where(~out).select("text", "lang"), size=size)
