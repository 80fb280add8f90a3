"""Toxicity by compression distance: which of two zstandard dictionaries shortens a text's windows more."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.llm import grams
from jobweave.llm.labelled import fit_logistic, held_out, logistic, training_sample
from jobweave.llm.store import keyed, returning_memory

#: Labelled documents that the dictionaries and thresholds are learnt from, and the longest of them in characters.
SAMPLE_ROWS, SAMPLE_LONGEST = 4000, 100_000
#: Bytes of a window, and from one window to the next.
WINDOW, STEP = 256, 128
#: Bytes of the ordinary dictionary, and of what the toxic one has besides, at most.
DICTIONARY, TOXIC_BYTES = 8192, 2048
#: Lengths in bytes of the stretches that are counted in toxic and in ordinary texts.
STRETCHES = (6, 10, 16)
#: How far a stretch's counts must be from chance (twice the log-likelihood ratio) to make it toxic, besides what
#: the most extreme of as many stretches reaches by chance.
BEYOND_CHANCE = 4.0
#: A stretch goes into the dictionary if it is so telling, compared with the most telling one.
TELLING_SHARE = 0.15
#: Bytes of the sample that are hashed at a time, so that the driver's memory stays small.
PART_BYTES = 1 << 18
#: Highest window distances of a document that its score rests on.
TOP = 5

# what stands between words becomes a space, A-Z lower case
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def plain(text: str) -> bytes:
    return text.encode().translate(PLAIN)


@dataclass(frozen=True)
class Model:
    """Contents of the two dictionaries, and weights of a document's highest window distances."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


class Distances:
    """How many bytes the toxic dictionary saves over the ordinary one, for each window of a text.

    Both dictionaries begin with the ordinary part; the toxic one goes on with the
    toxic part, the other with as many zeros, so what both hold is found at the
    same distance. Literals are left as they are (the fastest strategy),
    so that a shared stretch of few bytes already counts.
    """

    def __init__(self, model: Model):
        self.ordinary, self.toxic = (self.compressor(model.ordinary + x) for x in (b"\0" * len(model.toxic), model.toxic))

    @staticmethod
    def compressor(content: bytes) -> zstandard.ZstdCompressor:
        entries = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        settings = zstandard.ZstdCompressionParameters(
            window_log=15, hash_log=15, chain_log=6, search_log=1, min_match=6, target_length=1, strategy=zstandard.STRATEGY_FAST,
            write_checksum=False, write_content_size=False, write_dict_id=False,
        )
        entries.precompute_compress(compression_params=settings)
        return zstandard.ZstdCompressor(dict_data=entries, compression_params=settings)

    def of(self, text: bytes) -> list[int]:
        ordinary, toxic = self.ordinary.compress, self.toxic.compress
        windows = [text[i : i + WINDOW] for i in range(0, max(1, len(text) - WINDOW + STEP), STEP)]
        return [len(ordinary(w)) - len(toxic(w)) for w in windows]

    def features(self, text: str | None) -> list[float]:
        """The highest distances, and the highest one times the logarithm of the number of windows.

        Of many windows some are high by chance; a text without any distance gets
        the same score whatever its length.
        """
        found = self.of(plain(text)) if text else []
        top = sorted(found, reverse=True)[:TOP]
        return [*top, *[0] * (TOP - len(top)), max(top, default=0) * math.log1p(len(found))]


def without_copies(texts: list[bytes]) -> list[int]:
    """Which texts share none of 12 MinHash values of 3-word shingles with an earlier one."""
    seen, out = set(), []
    for i, text in enumerate(texts):
        words = text.split()
        shingles = np.array([zlib.crc32(b" ".join(words[p : p + 3])) for p in range(max(1, len(words) - 2))], np.uint64)
        lows = grams.mix(shingles[:, None] * np.uint64(2**32 + 15) + np.arange(12, dtype=np.uint64)).min(axis=0).tolist()
        low = set(enumerate(lows))
        if not low & seen:
            out.append(i)
        seen |= low
    return out


def stretches_of(text: bytes, size: int) -> np.ndarray:
    """Hashes of all stretches of ``size`` bytes."""
    return grams.gram_hashes(grams.BYTE_VALUES[0][np.frombuffer(text, np.uint8)], size, grams.MULTIPLIERS[0])


def beyond_chance(toxic: np.ndarray, ordinary: np.ndarray, n_toxic: int, n_ordinary: int) -> np.ndarray:
    """Twice the log-likelihood ratio of document counts where toxic texts have a stretch eight times as often, else 0."""
    expected = (toxic + ordinary) * n_toxic / (n_toxic + n_ordinary)
    rest = toxic + ordinary - expected
    ratio = 2 * (toxic * np.log(toxic / expected) + np.where(ordinary > 0, ordinary * np.log(np.maximum(ordinary, 1) / rest), 0))
    much_oftener = (toxic + 0.5) / (n_toxic + 1) > 8 * (ordinary + 0.5) / (n_ordinary + 1)
    return np.where(much_oftener, ratio, 0.0)


def places_in(known: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where hashes stand in a sorted array, and whether they do."""
    if not len(known):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return at, known[at] == hashes


def telling(texts: list[bytes], others: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the stretches that ``texts`` share with each other far oftener than ``others`` have them; their scores."""
    own = np.concatenate([np.zeros(0, np.uint64), *(np.unique(stretches_of(t, size)) for t in texts)])
    known, count = np.unique(own, return_counts=True)
    known, count = known[count > 1], count[count > 1]
    against = np.zeros(len(known))
    for text in others:
        at, found = places_in(known, stretches_of(text, size))
        against[np.unique(at[found])] += 1
    score = beyond_chance(count.astype(float), against, len(texts), len(others))
    keep = score > BEYOND_CHANCE + 2 * np.log(max(1, len(known)))
    return known[keep], score[keep]


def toxic_part(texts: list[bytes], others: list[bytes]) -> bytes:
    """The telling stretches of toxic texts, the most telling last (next to the window).

    A stretch counts only where it is about as telling as all that overlap it: so
    what merely stands beside a telling word is left out.
    """
    scores, marks = [np.zeros(len(t)) for t in texts], []
    for size in STRETCHES:
        known, score = telling(texts, others, size)
        for number, text in enumerate(texts):
            at, found = places_in(known, stretches_of(text, size))
            places = np.flatnonzero(found)
            worth = score[at[places]]
            for j in range(size):
                scores[number][places + j] = np.maximum(scores[number][places + j], worth)
            marks.append((number, size, places, worth))
    chosen, kept = [np.zeros(len(t)) for t in texts], [[] for _ in texts]
    for number, size, places, worth in marks:
        best = np.max([scores[number][places + j] for j in range(size)], axis=0, initial=0) if len(places) else worth
        keep = worth >= best / 2
        for j in range(size):
            chosen[number][places[keep] + j] = np.maximum(chosen[number][places[keep] + j], worth[keep])
        kept[number] += [(p, size) for p in places[keep].tolist()]
    found: dict[bytes, tuple[float, frozenset[bytes]]] = {}
    for number, text in enumerate(texts):
        edges = np.flatnonzero(np.diff(chosen[number] > 0, prepend=False, append=False))
        starts = edges[::2]
        inside: dict[int, set[bytes]] = {}
        for p, size in kept[number]:
            inside.setdefault(int(np.searchsorted(starts, p, side="right")) - 1, set()).add(text[p : p + size])
        for i, (s, e) in enumerate(zip(starts.tolist(), edges[1::2].tolist(), strict=True)):
            found[text[s:e]] = float(chosen[number][s:e].max()), frozenset(inside[i])
    parts, size, have = [], 0, set()
    least = TELLING_SHARE * max((worth for worth, _ in found.values()), default=0.0)
    for part in sorted(found, key=lambda p: (-found[p][0], len(p), p)):
        if found[part][0] >= least and size + len(part) <= TOXIC_BYTES and not found[part][1] <= have:
            parts.append(part)
            size += len(part)
            have |= found[part][1]
    return b"".join(reversed(parts))


def ordinary_part(texts: list[bytes], segment: int = 64) -> bytes:
    """The segment of each part of the sample whose 6-byte stretches are commonest and not yet covered."""
    whole = np.frombuffer(b" ".join(texts), np.uint8)
    if len(whole) < 2 * segment:
        return whole.tobytes() + b" there was no ordinary text to learn from, so these words stand in for it"
    size, total = STRETCHES[0], len(whole) - STRETCHES[0] + 1
    # of the stretches of all texts one array is kept, sorted in place; those of a part are hashed again when it is its turn
    hashes = np.empty(total, np.uint64)
    for lo in range(0, total, PART_BYTES):
        part = whole[lo : lo + PART_BYTES + size - 1]
        hashes[lo : lo + PART_BYTES] = stretches_of(part.tobytes(), size)
    hashes.sort()
    first = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    known = hashes[first]
    del hashes
    starts = np.append(np.flatnonzero(first).astype(np.int32), np.int32(total))
    del first
    worth, out = np.diff(starts).astype(float), []
    del starts
    epoch = max(2 * segment, total * segment // DICTIONARY)
    for lo in range(0, total - segment, epoch):
        mine = np.searchsorted(known, stretches_of(whole[lo : lo + epoch + size - 1].tobytes(), size))
        sums = np.concatenate([[0.0], np.cumsum(worth[mine])])
        width = min(segment, len(mine))
        best = int(np.argmax(sums[width:] - sums[:-width]))
        worth[mine[best : best + width]] = 0
        out.append(whole[lo + best : lo + best + segment].tobytes())
    return b"".join(out)[:DICTIONARY]


def train(sample: list[tuple[str, int]]) -> Model:
    """Two dictionaries and the calibration of distances, from (text, toxic) pairs.

    The ordinary dictionary takes the commonest segments of ordinary texts. The
    toxic one takes, before the same, the stretches of bytes that toxic texts
    share with each other far beyond chance: words, phrases of ordinary words, or
    what stands between no blanks. Copies of a text count once, so that a copied
    toxic text does not bring in all it says.
    """
    texts = [plain(t) for t, _ in sample]
    different = without_copies(texts)
    toxic, ordinary = ([texts[i] for i in different if sample[i][1] == label] for label in (1, 0))
    dictionaries = Model(ordinary_part(ordinary), toxic_part(toxic, ordinary), ())
    distances = Distances(dictionaries)
    x = np.array([distances.features(t) for t, _ in sample], float).reshape(len(sample), TOP + 1)
    y = np.array([label for _, label in sample], float)
    weights = fit_logistic(x, y) if len(sample) else np.zeros(TOP + 2)
    return Model(dictionaries.ordinary, dictionaries.toxic, tuple(float(w) for w in weights))


@returning_memory
def scores_of(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    distances, weights = Distances(model), np.array(model.weights)
    for batch in batches:
        x = np.array([distances.features(t.as_py()) for t in batch.column("text")], float).reshape(len(batch), TOP + 1)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(logistic(x, weights))],
            names=[*(c for c in batch.schema.names if c != "text"), "score"],
        )


def toxicity(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, longest: int = SAMPLE_LONGEST) -> DataFrame:
    """key (doc_id, NO_ID for null), mark of the text, held_out and score of each document, one row per input row.

    Learnt from a bounded sample of ``labels.toxic``; every whole text is scored.
    A null or empty text has no windows and gets the score of no distance.
    Without labels of both kinds all scores are near that of the only kind (0.5
    without any).
    """
    model = train(training_sample(documents, labels, "toxic", rows, longest))
    out = keyed(documents).withColumn("held_out", held_out_key())
    return out.mapInArrow(lambda b: scores_of(b, model), "key long, mark long, held_out boolean, score double")


def toxic_score(model: Model) -> Callable[[Column], Column]:
    """Score of a text column; one set of dictionaries a task."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        distances, weights = Distances(model), np.array(model.weights)
        for part in texts:
            x = np.array([distances.features(t) for t in part], float).reshape(len(part), TOP + 1)
            yield pd.Series(logistic(x, weights))

    return score


def held_out_key() -> Column:
    return F.when(F.col("key") == -(2**63), F.lit(True)).otherwise(held_out("key"))
