"""Chroma audio fingerprints and the alignment of recordings.

A recording's spectrum is folded into twelve pitch classes for each frame. Filters, differences of rectangle sums taken
from an integral image over time and pitch class, are quantized to two bits each and packed into one 32-bit integer a
frame. Equal integers of two recordings vote for the offset between them; the best offset is confirmed by bit errors.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, materialize

RATE, FRAME, HOP = 4000, 512, 256
FILTERS, WIDEST = 16, 8
LOWEST_HZ, HIGHEST_HZ = 80.0, 1900.0


def wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    """A mono 16-bit PCM file."""
    data = samples.astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def samples_of(media: bytes | None) -> np.ndarray:
    """Samples of a mono or stereo 16-bit PCM file, channels averaged; none if it is null or no such file."""
    if not media or len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return np.zeros(0, np.float32)
    at, channels, bits = 12, 1, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt " and at + 24 <= len(media):
            form, channels, _, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if form != 1 or bits != 16 or not channels:
                return np.zeros(0, np.float32)
        if kind == b"data" and bits:
            body = media[at + 8 : at + 8 + size]
            x = np.frombuffer(body[: len(body) // (2 * channels) * 2 * channels], "<i2").astype(np.float32)
            return x.reshape(-1, channels).mean(1)
        at += 8 + size + size % 2
    return np.zeros(0, np.float32)


def _folding() -> np.ndarray:
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    fold = np.zeros((len(hz), 12), np.float32)
    for i in np.flatnonzero((hz >= LOWEST_HZ) & (hz <= HIGHEST_HZ)):
        fold[i, int(round(12 * np.log2(hz[i] / 440.0))) % 12] = 1
    return fold


_FOLD, _HANN = _folding(), np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Shares of the twelve pitch classes in each frame; silence has none."""
    if len(samples) < FRAME:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * _HANN
    power = np.abs(np.fft.rfft(frames)) ** 2 @ _FOLD
    total = power.sum(1, keepdims=True)
    return np.where(total > 0, power / np.maximum(total, 1e-9), 0)


def _shapes() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) of the filters by rule: kinds, places and sizes take turns."""
    return [(i % 4, (5 * i) % 12, 1 + (7 * i) % 4 + (i % 4 == 1), (2, 4, 6, 8)[(i // 2) % 4]) for i in range(FILTERS)]


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """One integer for each frame from which the widest filter fits: two bits, Gray-coded, of each filter."""
    image = chroma(samples)
    n = len(image) - WIDEST + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    image = np.concatenate([image, image], 1)  # pitch classes go round
    total = np.zeros((len(image) + 1, 25))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    t = np.arange(n)

    def area(frame: int, frames: int, first: int, classes: int) -> np.ndarray:
        a, b = t + frame, t + frame + frames
        return total[b, first + classes] - total[a, first + classes] - total[b, first] + total[a, first]

    out = np.zeros(n, np.int64)
    for kind, first, classes, frames in _shapes():
        half = frames // 2
        if kind == 0:  # earlier against later
            a, b = area(0, half, first, classes), area(half, half, first, classes)
        elif kind == 1:  # lower against upper
            low = max(1, classes // 2)
            a, b = area(0, frames, first, low), area(0, frames, first + low, low)
        elif kind == 2:  # crossed
            a = area(0, half, first, classes) + area(half, half, first + classes, classes)
            b = area(half, half, first, classes) + area(0, half, first + classes, classes)
        else:  # here against elsewhere
            a, b = area(0, frames, first, classes), area(0, frames, first + classes, 12 - classes) * classes / (12 - classes)
        level = np.digitize(np.log((a + 0.05) / (b + 0.05)), [-0.7, 0.0, 0.7])
        out = out << 2 | np.array([0, 1, 3, 2])[level]
    return out


#: Media files are handed to Python so many at a time.
FILES_AT_ONCE = 256


@contextmanager
def _few_at_once(spark: SparkSession) -> Iterator[None]:
    """Batches of FILES_AT_ONCE rows for what is run inside: files are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, FILES_AT_ONCE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fingerprints(media: DataFrame, key: str, column: str, phases: int = 1) -> DataFrame:
    """(key, phase, codes array of bigint) of a media column of WAV files, from `phases` starts inside a hop, equally spaced:
    one of several is near the grid of any recording that a file was cut from. Null, damaged and too short files have no codes."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k, m in zip(part[key], part[column]):
                sound = samples_of(m)
                rows += [(k, i, fingerprint(sound[HOP * i // phases :])) for i in range(phases)]
            yield pd.DataFrame(rows, columns=[key, "phase", "codes"])

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, column).mapInPandas(run, f"`{key}` {kind}, phase int, codes array<bigint>")


def align(queries: DataFrame, index: DataFrame, most_error: float = 0.25, least_frames: int = 8) -> DataFrame:
    """(query, item, offset, votes, frames, bit_error): queries (query, codes) aligned with the items of index (item, codes).

    Each pair of equal integers votes for an offset, the item's frame less the query's. Every offset with a vote is
    verified: it stands if the recordings overlap there in least_frames frames or more and at most most_error of the bits
    differ. Of those that stand the one with the most votes, then the fewest bit errors, then the smallest is given. Pairs
    without a common integer, and null or short recordings, give no row. Several rows of one recording should be brought
    together before.
    """

    def frames_of(frame: DataFrame, key: str, at: str) -> DataFrame:
        return frame.select(key, F.posexplode("codes").alias(at, "code"))

    left, right = frames_of(queries, "query", "qt"), frames_of(index, "item", "it")
    votes = left.join(right, "code").groupBy("query", "item", (F.col("it") - F.col("qt")).alias("offset")).agg(F.count("*").alias("votes"))
    voted = votes.groupBy("query", "item").agg(F.collect_list(F.struct("offset", "votes")).alias("voted"))
    both = voted.join(queries.select("query", F.col("codes").alias("q")), "query").join(index.select("item", F.col("codes").alias("c")), "item")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for query, item, voted, q, c in part[["query", "item", "voted", "q", "c"]].itertuples(index=False):
                best, q, c = None, np.asarray(q, np.int64), np.asarray(c, np.int64)
                for v in voted:
                    offset, n = v["offset"], v["votes"]
                    first, start = max(0, -offset), max(0, offset)
                    frames = min(len(q) - first, len(c) - start)
                    if frames < least_frames:
                        continue
                    wrong = int(np.bitwise_count(q[first : first + frames] ^ c[start : start + frames]).sum()) / (frames * 2 * FILTERS)
                    if wrong <= most_error and (best is None or (-n, wrong, offset) < best[0]):
                        best = (-n, wrong, offset), (query, item, offset, n, frames, wrong)
                if best:
                    rows.append(best[1])
            yield pd.DataFrame(rows, columns=["query", "item", "offset", "votes", "frames", "bit_error"])

    kinds = [f"{k} {f.schema[k].dataType.simpleString()}" for k, f in (("query", queries), ("item", index))]
    return both.select("query", "item", "voted", "q", "c").mapInPandas(run, f"{', '.join(kinds)}, offset int, votes bigint, frames int, bit_error double")


#: So many starts inside a hop, equally spaced, are tried for a clip.
PHASES = 8
_TONES = 36


def _tones() -> np.ndarray:
    t = np.arange(HOP) / RATE
    return np.stack([np.sin(2 * np.pi * 110 * 2 ** (i / 12) * t) + 0.3 * np.sin(4 * np.pi * 110 * 2 ** (i / 12) * t) for i in range(_TONES)]) * 9000


def _render(vec_id: object, vector: object, tones: np.ndarray) -> tuple[bytes, bytes | None]:
    """A recording and, for every 20th id, its clip."""
    x = np.nan_to_num(np.array([] if vector is None else vector, np.float64), nan=-1.0)
    notes = np.clip((x + 0.4) / 0.8 * _TONES, 0, _TONES - 1).astype(int)
    sound, n = tones[notes].reshape(-1), len(notes)
    if pd.isna(vec_id) or vec_id % 20:
        return wav(sound), None
    rng, rough = np.random.default_rng(abs(int(vec_id))), vec_id // 20 % 4 == 3  # every fourth clip is off the hop grid, with more noise
    at = n // 4 * HOP + (int(rng.integers(1, HOP)) if rough else 0)
    cut = sound[at : (n - n // 4) * HOP] * 0.6
    return wav(sound), wav(cut + rng.normal(0, 300 if rough else 20, len(cut)))


def melodies(vectors: DataFrame) -> DataFrame:
    """(vec_id, media, clip) from vectors (vec_id, embedding): every component sounds as one note of three octaves, HOP
    samples long; clip is the middle half of every 20th recording, softer and with some noise, else null; every fourth clip starts inside a
    hop and has more noise. A null or empty
    vector gives an empty recording, a null component the lowest note. Files are made a few hundred at a time."""
    tones = _tones()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for at in range(0, len(whole), 200):
                part = whole.iloc[at : at + 200]
                made = [_render(i, v, tones) for i, v in zip(part["vec_id"], part["embedding"])]
                yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "media": [m for m, _ in made], "clip": [c for _, c in made]})

    return vectors.select("vec_id", "embedding").mapInPandas(run, "vec_id bigint, media binary, clip binary")


def _sounds(vectors: DataFrame) -> DataFrame:
    """(vec_id, codes, clip) of the files that melodies() makes of vectors, one row for each row: the recording's codes, and the clip's from each of PHASES starts."""
    # A task makes some thousand files: what they are made from is small.
    spread = vectors.select("vec_id", "embedding").repartition(max(1, -(-vectors.count() // 2000)))
    media = materialize(melodies(spread).withColumn("file", F.monotonically_increasing_id()))
    with _few_at_once(vectors.sparkSession):
        codes = materialize(fingerprints(media, "file", "media"))
        starts = materialize(fingerprints(media.where("clip is not null"), "file", "clip", PHASES))
    clips = starts.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("phase", "codes"))).alias("of")).select("file", F.col("of.codes").alias("clip"))
    out = materialize(media.select("vec_id", "file").join(codes.drop("phase"), "file").join(clips, "file", "left").select("vec_id", "codes", "clip"))
    discard(media, codes, starts)
    return out


def search_clips(vectors: DataFrame) -> DataFrame:
    """Every clip of melodies() against all recordings: (vec_id, match_id, n_copies, offset, votes, frames, bit_error).

    A clip is fingerprinted from PHASES starts inside a hop, each aligned by itself; of a recording's alignments the one with
    the most votes is given, then the fewest bit errors, the smallest offset and the earliest start.
    Recordings with equal fingerprints are one class, named match_id by its smallest vec_id, of n_copies rows. A clip
    with no match, or of a null or short vector, gives one row with nulls, so each row whose id is divisible by 20
    appears. Repeated rows are one query. A vector of any length is one recording. Extra columns are not read. An empty table gives none.
    """
    sounds = _sounds(vectors)
    classes = materialize(sounds.where("vec_id is not null and size(codes) > 0").groupBy("codes").agg(F.min("vec_id").alias("item"), F.count("*").alias("n_copies")))
    asked = sounds.where("clip is not null").select("vec_id", "clip").distinct()
    forms = materialize(asked.groupBy("clip").agg(F.min("vec_id").alias("query")))
    starts = forms.select("query", F.posexplode("clip").alias("phase", "codes"))
    found = align(starts.select(F.concat_ws("|", "query", "phase").alias("query"), "codes"), classes.select("item", "codes"))
    found = found.select(*[F.split("query", "\\|")[i].cast("bigint").alias(c) for i, c in enumerate(("of", "phase"))], *found.columns[1:])
    order = F.struct(-F.col("votes"), "bit_error", "offset", "phase")
    found = found.groupBy(F.col("of").alias("query"), "item").agg(F.min_by(F.struct("offset", "votes", "frames", "bit_error"), order).alias("b")).select("query", "item", "b.*")
    found = found.join(classes.select("item", "n_copies"), "item")
    out = asked.join(forms, "clip").select("vec_id", "query").join(found, "query", "left")
    return out.select("vec_id", F.col("item").alias("match_id"), "n_copies", "offset", "votes", "frames", "bit_error")
