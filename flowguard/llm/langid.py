"""Language identification with a string kernel.

The blended-spectrum presence kernel of two texts counts the n-grams of one to three characters that both have, divided by
the geometric mean of what each has. Landmark texts and kernel ridge regression, one language against the rest, give
(Nyström) scores that are linear in the presence of n-grams; tasks score batches of texts by one matrix product each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize, small

_CODES = 0x110000
#: N-grams are numbered by hash in a table of 2^_BITS places.
_BITS = 20
_MIX = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    chars = [chr(i) for i in range(_CODES)]
    letter = np.array([c.isalpha() for c in chars])
    lower = np.arange(_CODES, dtype=np.int32)
    for i in np.flatnonzero(letter):
        low = chars[i].lower()
        if len(low) == 1:
            lower[i] = ord(low)
    return letter, lower


_known: list[tuple[np.ndarray, np.ndarray]] = []


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.int32)


def _letters() -> tuple[np.ndarray, np.ndarray]:
    if not _known:
        _known.append(_tables())
    return _known[0]


def _folded(text: str) -> np.ndarray:
    """A text's letters in lower case, each as its code point; runs of other characters are one 0 each."""
    letter, lower = _letters()
    codes = _codes(text)
    s = np.where(letter[codes], lower[codes], 0)
    return s[np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]] if len(s) else s


def _grams(text: str) -> np.ndarray:
    """Places of a text's n-grams of one, two and three characters."""
    s = np.r_[0, _folded(text), 0].astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        one = s * _MIX[0]
        two = one[:-1] + s[1:] * _MIX[1]
        three = two[:-1] + s[2:] * _MIX[2]
        return np.concatenate([(x ^ (x >> np.uint64(31))) * _MIX[1] >> np.uint64(64 - _BITS) for x in (one, two, three)]).astype(np.int64)


def _flags() -> np.ndarray:
    return np.zeros(1 << _BITS, bool)


#: The landmarks' coefficients are folded into weights of n-grams where those have at most so many numbers.
MOST_WEIGHTS = 1 << 24


@dataclass
class Model:
    """Landmarks by n-gram: those that have the n-gram grams[i] are marks[starts[i]:starts[i + 1]]; norms: the root of how many
    n-grams each landmark has. A text's scores are bias and its kernel with the landmarks times their coefficients. That is
    linear in presence, so with few languages weights, one row for each n-gram, stand for it."""

    grams: np.ndarray
    starts: np.ndarray
    marks: np.ndarray
    norms: np.ndarray
    languages: list[str]
    coefficients: np.ndarray | None = None
    bias: np.ndarray | None = None
    weights: np.ndarray | None = None

    def kernel(self, texts: list[str]) -> np.ndarray:
        """The kernel of each text with each landmark: only landmarks that share an n-gram are visited."""
        out = np.zeros((len(texts), len(self.norms)))
        for i, text in enumerate(texts):
            ids = np.unique(_grams(text))
            at = np.searchsorted(self.grams, ids)
            at = at[np.r_[self.grams, -1][at] == ids]
            count = self.starts[at + 1] - self.starts[at]
            where = np.repeat(self.starts[at] - np.cumsum(count) + count, count) + np.arange(count.sum())
            out[i] = np.bincount(self.marks[where], minlength=len(self.norms)) / (self.norms * np.sqrt(max(1, len(ids))))
        return out

    def features(self, texts: list[str], flags: np.ndarray) -> np.ndarray:
        """Which of the model's n-grams each text has, divided by the root of how many different ones it has at all. flags: scratch, left all false."""
        rows = np.zeros((len(texts), len(self.grams)), np.float32)
        for i, text in enumerate(texts):
            ids = _grams(text)
            flags[ids] = True
            rows[i] = flags[self.grams]
            rows[i] /= np.sqrt(max(1, int(np.count_nonzero(flags))))
            flags[ids] = False
        return rows

    def fold(self) -> None:
        """Weights in place of coefficients, if they are few."""
        if len(self.grams) * len(self.languages) > MOST_WEIGHTS:
            return
        of = np.repeat(np.arange(len(self.grams)), np.diff(self.starts))
        share = self.coefficients / self.norms[:, None]
        self.weights = np.stack([np.bincount(of, share[self.marks, k], len(self.grams)) for k in range(len(self.languages))], 1).astype(np.float32)

    def scores(self, texts: list[str], flags: np.ndarray | None = None) -> np.ndarray:
        if self.weights is not None:
            return self.features(texts, _flags() if flags is None else flags) @ self.weights + self.bias
        return self.kernel(texts) @ self.coefficients + self.bias


def fit(texts: list[str], languages: list[str], landmarks: int = 200, ridge: float = 0.05) -> Model:
    """Kernel ridge regression on the Nyström features of up to `landmarks` of the texts, spread evenly over them.

    Landmarks are kept as lists by n-gram and texts are gone through some at a time, so memory goes by the n-grams that
    landmarks have and by the square of the number of landmarks, not by texts or by landmarks times n-grams.
    """
    chosen = np.unique(np.linspace(0, len(texts) - 1, min(landmarks, len(texts))).astype(int))
    sets = [np.unique(_grams(texts[i])) for i in chosen]
    held, of = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
    order = np.argsort(held, kind="stable")
    grams, first = np.unique(held[order], return_index=True)
    norms = np.sqrt(np.maximum(1, [len(x) for x in sets]))
    model = Model(grams, np.r_[first, len(held)], of[order], norms, sorted(set(languages)))
    values, vectors = np.linalg.eigh(model.kernel([texts[i] for i in chosen]) + 1e-6 * np.eye(len(chosen)))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    number = np.searchsorted(np.array(model.languages), np.array(languages))
    model.bias = np.bincount(number, minlength=len(model.languages)) / len(texts)
    left, right = np.zeros((len(chosen), len(chosen))), np.zeros((len(chosen), len(model.languages)))
    for i in range(0, len(texts), 256):
        z = model.kernel(texts[i : i + 256]) @ root
        y = np.tile(-model.bias, (len(z), 1))
        y[np.arange(len(z)), number[i : i + 256]] += 1
        left += z.T @ z
        right += z.T @ y
    model.coefficients = root @ np.linalg.solve(left + ridge * len(texts) / 100 * np.eye(len(chosen)), right)
    model.fold()
    return model


#: At least so many rows of a language are learnt, as far as it has them; so many languages may be broadcast.
LEAST_ROWS, MOST_LANGUAGES = 10, 50_000


#: Texts of the sample have together about so many bytes at most, by fewer rows; one text of more than LONGEST bytes teaches nothing.
MOST_BYTES, LONGEST = 48 << 20, 4 << 20


def training_rows(documents: DataFrame, learn: Column, rows: int = 2000, most_bytes: int = MOST_BYTES) -> list[tuple[str, str]]:
    """About `rows` whole texts with their lang, or LEAST_ROWS of each language if that is more, of the rows that may be
    learnt from: as many of each language as there are, by hash of doc_id and text, for fitting alone; fewer of each where
    they would have more than most_bytes together. Sorted by lang."""
    size = F.octet_length("text")
    pool = documents.where(learn & F.col("lang").isNotNull() & (size <= LONGEST)).select("doc_id", "text", "lang")
    counts = materialize(pool.groupBy("lang").agg(F.count("*").alias("count"), F.sum(size).alias("bytes")))
    each = max(LEAST_ROWS, rows // max(1, counts.count()))
    share = F.least(F.lit(1.0), F.lit(each) / F.col("count"))
    less = min(1.0, most_bytes / max(1.0, counts.agg(F.sum(share * F.col("bytes"))).first()[0] or 1.0))
    shares = small(counts.select("lang", (share * less).alias("share")), MOST_LANGUAGES)
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    sample = pool.join(shares, "lang").where(place < F.col("share")).select("lang", "text").collect()
    discard(counts)
    return [(t, lang) for lang, t in sorted((r["lang"], r["text"]) for r in sample)]


def train(documents: DataFrame, learn: Column, rows: int = 2000, landmarks: int = 200) -> Model | None:
    """A model of the languages of the rows that `learn` admits; None if there are none. Each text is learnt whole and as
    one short passage, for short texts are asked too. There are at least two landmarks for each language."""
    sample = training_rows(documents, learn, rows)
    if not sample:
        return None
    texts, languages = [], []
    for i, (text, lang) in enumerate(sample):
        at = (i * 7919) % max(1, len(text) - 60)
        texts += [text, text[at : at + 60]]
        languages += [lang, lang]
    return fit(texts, languages, max(landmarks, 2 * len(set(languages))))


def identify(documents: DataFrame, model: Model | None, keep: list[str], batch_rows: int = 64) -> DataFrame:
    """The columns `keep` of documents with lang_pred and score for every row.

    Only the text is looked at, all of it. lang_pred is a learnt language, or und with score 0 if the text is null or has
    no letter, or if nothing could be learnt. score is the winning regression value, cut to 0..1; the first of tied
    languages by name wins. Repeated rows get equal results; a clash with the new columns' names is resolved in their
    favour. An empty table gives none.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    shared = documents.sparkSession.sparkContext.broadcast(model)
    needed = [*keep, *([] if "text" in keep else ["text"])]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*[f"`{c}`" for c in keep]).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        letter, _ = _letters()
        flags = _flags()
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                texts = [t or "" for t in part.column("text").to_pylist()]
                has = np.array([bool(letter[_codes(t)].any()) for t in texts])
                lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
                if m is not None and has.any():
                    s = m.scores([t for t, h in zip(texts, has) if h], flags)
                    lang[has] = np.array(m.languages, object)[s.argmax(1)]
                    score[has] = np.clip(s.max(1), 0, 1)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(lang.tolist(), pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return documents.select(*[f"`{c}`" for c in needed]).mapInArrow(run, f"{schema}, lang_pred string, score double")
