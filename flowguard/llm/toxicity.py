"""Toxicity by compression distance.

At each of three scales two zstandard dictionaries are trained, one on the windows of ordinary texts, one on those of toxic
texts that the first one hardly shortens. A text is scored by its windows: how many bytes fewer does a window take with the
toxic dictionary than with the ordinary one? From which saving a window counts as a hit is calibrated at each scale on
labelled texts that trained no dictionary, and so are the weights: those of words first, then what the other scales add. Windows are spelled in codes
by hash, so that a compressor, which cannot shorten a few plain letters, saves several bytes on what it knows:

- words, one four-byte code for each three characters, large dictionaries: is there a word that ordinary texts don't have?
- stems, one code for each six characters of every word of the running text, small dictionaries: what ordinary texts have
  too, but seldom, is not in theirs, so the share of hits in the text tells;
- phrases, one 16-byte code for each two neighbouring words of the running text; toxic ones train if two texts have them.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize, slices

_WORD = re.compile(r"[^\W\d_]+")
#: Codes in a window of a word, and how far the next window of a long word starts.
WINDOW, STEP = 32, 16
LEVEL = 3
#: Characters in a code of words and of stems.
SHORT, LONG = 3, 6
#: Bytes of the toxic and the ordinary dictionary of words and of stems.
WORD_BYTES, STEM_BYTES = (64 << 10, 1 << 20), (16 << 10, 32 << 10)
#: Bytes of the toxic dictionaries of phrases, of which one is chosen (the smaller, the more often a phrase must recur), and of the ordinary one.
PHRASE_BYTES, ORDINARY_PHRASES = (1 << 10, 4 << 10, 16 << 10, 64 << 10), 1 << 20
#: A toxic text's window trains the toxic dictionary if the ordinary one leaves at least so much of it, besides the frame.
LEFT, FRAME = 0.5, 9
#: Savings, in bytes, of which one for words and one for stems is chosen as the limit from which a window counts as a hit.
LIMITS, STEM_LIMITS = tuple(range(4, 25)), (4, 8, 12, 16, 20)
#: A phrase is a hit from this saving on.
PHRASE_HIT = 4
#: So many words' savings are kept in a task, longer ones than MOST_LETTERS are measured each time.
MOST_KNOWN, MOST_LETTERS = 500_000, 60


def spell(word: str, width: int = SHORT) -> bytes:
    """One four-byte code for each `width` characters of a word between blanks; a shorter one has one code."""
    w = f" {word} "
    return b"".join([zlib.crc32(w[i : i + width].encode("utf-8", "replace")).to_bytes(4, "little") for i in range(max(1, len(w) - width + 1))])


def _windows(word: str, width: int = SHORT) -> list[bytes]:
    spelled = spell(word, width)
    n = len(spelled) // 4
    return [spelled[4 * i : 4 * (i + WINDOW)] for i in range(0, max(1, n - WINDOW + STEP), STEP)]


def _running(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _words(text: str) -> set[str]:
    return set(_running(text))


def _code(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace"))


def _phrases(codes: np.ndarray) -> np.ndarray:
    """A number for each two neighbouring words, given the codes of all words in order."""
    return codes[:-1] << np.uint64(32) | codes[1:]


def _spelled_phrase(phrase: int) -> bytes:
    return hashlib.md5(phrase.to_bytes(8, "little")).digest()


def _spelled_phrases(phrases: np.ndarray) -> np.ndarray:
    """The codes of many phrases, 16 bytes in a row."""
    out = bytearray()
    for at in range(0, len(phrases), 1 << 16):
        out += b"".join(map(_spelled_phrase, phrases[at : at + (1 << 16)].tolist()))
    return np.frombuffer(out, np.uint8).reshape(-1, 16)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; of few samples their own bytes, which the library takes as one too."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sorted(set(samples)))[-size:]


def _packer(data: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(data) if data else None
    if d is not None:
        d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


@dataclass
class Dictionaries:
    """(toxic, ordinary) dictionaries of words and of stems; the phrases that are hits, sorted, and by which of the toxic dictionaries of phrases."""

    words: tuple[bytes, bytes]
    stems: tuple[bytes, bytes]
    phrases: np.ndarray
    hits: np.ndarray


class _Meter:
    """Savings of words, kept by word while they are few."""

    def __init__(self, given: Dictionaries):
        self.given = given
        self.pairs = [tuple(map(_packer, pair)) for pair in (given.words, given.stems)]
        self.known: dict[str, tuple[int, int, int]] = {}

    def _measure(self, word: str) -> tuple[int, int, int]:
        best = [max(len(ordinary.compress(w)) - len(toxic.compress(w)) for w in _windows(word, width)) for (toxic, ordinary), width in zip(self.pairs, (SHORT, LONG))]
        return best[0], best[1], _code(word)

    def saving(self, word: str) -> tuple[int, int, int]:
        """Of a word: the savings as a word and as stems, and its code."""
        if len(word) > MOST_LETTERS:
            return self._measure(word)
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= MOST_KNOWN:
                self.known.clear()
            found = self.known[word] = self._measure(word)
        return found

    def features(self, text: str) -> np.ndarray:
        """Of the different words the largest saving, the mean of the two largest, the number of windows from each of LIMITS
        on, and of words; of all stems the mean of savings above 0 and the share from each of STEM_LIMITS on; of the
        different phrases the number of hits by each of PHRASE_BYTES."""
        out = np.zeros(_LENGTH)
        running = _running(text)
        if running:
            different = {w: i for i, w in enumerate(dict.fromkeys(running))}
            table = np.array([self.saving(w) for w in different], np.int64)
            at = np.fromiter(map(different.__getitem__, running), np.int64, len(running))
            values = table[:, 0]
            two = np.sort(np.partition(values, -2)[-2:]) if len(values) > 1 else values
            out[0], out[1] = two[-1], two.mean()
            high = np.sort(values[values >= LIMITS[0]])
            out[2:_STEMS - 1] = len(high) - np.searchsorted(high, LIMITS)
            out[_STEMS - 1] = len(different)
            stems = table[at, 1]
            out[_STEMS] = np.maximum(stems, 0).mean()
            out[_STEMS + 1 : _PHRASES] = [(stems >= x).mean() for x in STEM_LIMITS]
            if len(self.given.phrases) and len(running) > 1:
                phrases = _phrases(table[at, 2].astype(np.uint64))
                place = np.minimum(np.searchsorted(self.given.phrases, phrases), len(self.given.phrases) - 1)
                out[_PHRASES:] = self.given.hits[np.unique(place[self.given.phrases[place] == phrases])].sum(0)
        return out


#: Where the parts of features() start.
_STEMS = 3 + len(LIMITS)
_PHRASES = _STEMS + 1 + len(STEM_LIMITS)
_LENGTH = _PHRASES + len(PHRASE_BYTES)


def _chosen(features: np.ndarray, limits: tuple[int, int, int]) -> np.ndarray:
    """What is weighed of features() with those of LIMITS, STEM_LIMITS and PHRASE_BYTES at these places."""
    hits = np.log1p(features[:, 2 + limits[0]])
    long = np.log1p(features[:, _STEMS - 1])
    stems = np.log1p(100 * features[:, _STEMS + 1 + limits[1]])
    phrases = np.log1p(features[:, _PHRASES + limits[2]])
    return np.stack([features[:, 0] / 10, features[:, 1] / 10, hits, hits - 0.25 * long, features[:, _STEMS], stems, phrases, phrases - 0.25 * long], 1)


#: So many of them are of words.
_OF_WORDS = 4


@dataclass
class Model:
    given: Dictionaries
    limits: tuple[int, int, int]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((_chosen(features, self.limits) - self.mean) / self.scale @ self.weights + self.bias, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, given: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; `given` is added to the logit and stays as it is."""
    x = np.c_[x, np.ones(len(x))]
    w, keep = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-3]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w + given, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _strange(packer: zstandard.ZstdCompressor, windows: set[bytes]) -> set[bytes]:
    return {w for w in windows if len(packer.compress(w)) - FRAME >= LEFT * len(w)}


def _samples(texts: list[list[bytes]], whole: bool) -> list[bytes]:
    return [s for t in texts if (s := b"".join(t))] if whole else [w for t in texts for w in t]


def _trained(ordinary: list[list[bytes]], toxic: list[list[bytes]], size: int, sizes: tuple[int, ...], whole: bool) -> tuple[bytes, list[bytes]]:
    """The ordinary dictionary and toxic ones of several sizes, of the windows of each text; a sample is a text's windows on end, or else one window."""
    plain = _dictionary(_samples(ordinary, whole), size)
    keep = _strange(_packer(plain), {w for t in toxic for w in t})
    samples = _samples([[w for w in t if w in keep] for t in toxic], whole)
    return plain, [_dictionary(samples, x) for x in sizes]


def _dictionaries(texts: list[str], toxic: list[int]) -> Dictionaries:
    # Words and phrases recur: each is kept and spelled once. What one scale needs is let go before the next.
    same: dict[str, str] = {}
    read = [[same.setdefault(w, w) for w in _running(t)] for t in texts]
    kinds = [[t for t, y in zip(read, toxic) if y == k] for k in (0, 1)]
    spelled = {w: _windows(w) for w in same}
    words = _trained(*[[[s for w in sorted(set(t)) for s in spelled[w]] for t in kind] for kind in kinds], WORD_BYTES[1], WORD_BYTES[:1], False)
    spelled = {w: _windows(w, LONG) for w in same}
    stems = _trained(*[[[s for w in t for s in spelled[w]] for t in kind] for kind in kinds], STEM_BYTES[1], STEM_BYTES[:1], True)
    del spelled
    code = {w: _code(w) for w in same}
    numbers = [[_phrases(np.array([code[w] for w in t], np.uint64)) for t in kind] for kind in kinds]
    del same, read, kinds, code
    # One text's phrase tells nothing: those that recur in toxic texts train.
    different, texts_of = np.unique(np.concatenate([np.unique(t) for t in numbers[1]]), return_counts=True)
    recur = different[texts_of > 1]
    every = np.unique(np.concatenate(numbers[0]))
    table = _spelled_phrases(every)
    usual_phrases = [[table[np.searchsorted(every, t)].tobytes()] for t in numbers[0]]
    # A phrase of no toxic text is not in a toxic dictionary and saves nothing.
    asked = {p: _spelled_phrase(p) for p in recur.tolist()}
    toxic_phrases = [[asked[p] for p in t[np.isin(t, recur)].tolist()] for t in numbers[1]]
    del numbers, every, table
    plain, bad = _trained(usual_phrases, toxic_phrases, ORDINARY_PHRASES, PHRASE_BYTES, True)

    def takes(data: bytes) -> np.ndarray:
        packer = _packer(data)
        return np.array([len(packer.compress(x)) for x in asked.values()], np.int64)

    usual = takes(plain)
    hits = np.stack([usual - takes(data) >= PHRASE_HIT for data in bad], 1)
    keep = hits.any(1)
    return Dictionaries((words[1][0], words[0]), (stems[1][0], stems[0]), recur[keep], hits[keep].astype(np.int64))


def fit(texts: list[str], toxic: list[int]) -> Model | None:
    """Two thirds of the texts train the dictionaries, each on the windows of its kind of text: the ordinary ones on all, the
    toxic ones on all of which the ordinary one leaves LEFT or more. The rest chooses the limits of a hit, by likelihood,
    and the weights; where the rest has texts of one kind only, as it may among a handful, all texts do. None without words
    in texts of both kinds among the two thirds."""
    learn, check = [i for i in range(len(texts)) if i % 3], [i for i in range(len(texts)) if i % 3 == 0]
    if {int(toxic[i]) for i in learn if _words(texts[i])} != {0, 1}:
        return None
    given = _dictionaries([texts[i] for i in learn], [int(toxic[i]) for i in learn])
    meter = _Meter(given)
    y = np.array([float(toxic[i]) for i in check])
    if not len(y) or y.min() == y.max():
        check, y = list(range(len(texts))), np.array(toxic, float)
    seen = np.array([meter.features(texts[i]) for i in check])

    def calibrated(limits: tuple[int, int, int]) -> tuple[float, Model]:
        x = _chosen(seen, limits)
        mean, scale = x.mean(0), x.std(0) + 1e-9
        x = (x - mean) / scale
        words, bias = _logistic(x[:, :_OF_WORDS], y, np.zeros(len(y)))
        # What words tell stands, and the other scales add to it: a long text with one such word has no share of stems.
        rest, more = _logistic(x[:, _OF_WORDS:], y, x[:, :_OF_WORDS] @ words + bias)
        model = Model(given, limits, mean, scale, np.r_[words, rest], bias + more)
        p = np.clip(model.score(seen), 1e-9, 1 - 1e-9)
        return float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum()), model

    # One choice after the other, the others as they are, until none gives more.
    best = calibrated((len(LIMITS) // 2, len(STEM_LIMITS) // 2, len(PHRASE_BYTES) // 2))
    while True:
        before = best[0]
        for scale, places in enumerate((LIMITS, STEM_LIMITS, PHRASE_BYTES)):
            for place in range(len(places)):
                tried = calibrated((*best[1].limits[:scale], place, *best[1].limits[scale + 1 :]))
                best = tried if tried[0] > best[0] + 1e-9 else best
        if best[0] <= before + 1e-9:
            return best[1]


#: Texts of the sample have together about so many bytes at most, by fewer rows; one text of more than LONGEST bytes teaches nothing.
MOST_BYTES, LONGEST = 48 << 20, 4 << 20


def train(documents: DataFrame, labels: DataFrame, learn: Column, toxic_rows: int = 3000, ordinary_rows: int = 7000, most_bytes: int = MOST_BYTES) -> Model | None:
    """A model of a bounded sample of the labelled rows that `learn`, a condition on doc_id, admits: about toxic_rows and
    ordinary_rows whole texts, or fewer that have most_bytes together, by hash of the id, for fitting alone. Rows without a
    label or text, or with one longer than LONGEST bytes, teach nothing."""
    pool = labels.where(learn & F.col("toxic").isNotNull()).select("doc_id", (F.col("toxic") == 1).cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / (1 << 40)
    part = lambda shares: F.col("place") < F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0])
    counts = {r["toxic"]: r["count"] for r in pool.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    shares = [min(1.0, n / counts[kind]) for kind, n in enumerate((ordinary_rows, toxic_rows))]
    chosen = pool.withColumn("place", place).where(part(shares))
    rows = materialize(documents.select("doc_id", "text").where(F.octet_length("text") <= LONGEST).join(F.broadcast(chosen), "doc_id").select("place", "toxic", "text"))
    bytes_of = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    less = min(1.0, most_bytes / max(1, bytes_of))
    rows, table = rows.where(part([x * less for x in shares])), rows
    found = sorted((r["text"], r["toxic"]) for r in rows.select("text", "toxic").collect())
    discard(table)
    order = np.random.default_rng(7).permutation(len(found))
    return fit([found[i][0] for i in order], [found[i][1] for i in order])


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of every row of documents (doc_id, text, ...): the probability, 0 to 1, that a text is toxic.

    All of a text is read and nothing else. Null, empty and wordless texts get the score of a text without any hit;
    without a model all scores are 0. Equal texts have equal scores; repeated ids and rows are scored each. Extra columns
    are not read. An empty table gives none.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        meter = _Meter(m.given) if m is not None else None
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                out = m.score(np.array([meter.features(t or "") for t in texts])) if meter is not None else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
