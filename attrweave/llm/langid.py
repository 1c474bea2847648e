"""Language identification: multinomial naive Bayes over hashed character n-grams.

The matrix of log-probabilities has a fixed size (buckets x languages) and is broadcast; whole texts are scored in
numpy batches as the product of a sparse matrix of n-gram counts with it. Besides the languages there is a class of
no language, in which every bucket is as likely as any other: a text that fits it best is rejected, as is one whose
languages can't be told apart.

Edge cases: a text that is null or shorter than the shortest n-gram has no language (null) and is rejected; of equal
scores the language first in the alphabet wins; repeated rows are judged alike; an empty table gives an empty table;
without any labelled row every text is rejected. Only the columns named are read, so further columns of any name
do no harm; filter_languages() returns all columns as they came.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrweave.llm.common import lean, slices, text_of

ORDERS = (2, 3, 4)
BITS = 16
#: Labelled rows per language that the classifier is fitted on, about.
TRAIN_PER_LANGUAGE = 500
#: Letters of a text beyond which it isn't fitted on, and the labels, the most frequent first, that are: the sample is bounded.
TRAIN_LETTERS, MOST_LABELS = 200_000, 1_000
#: Nats per n-gram by which the best language has to lead the second.
MIN_MARGIN = 0.005
#: Nats per n-gram by which the class of no language stays behind a uniform choice of buckets, so that numbers and
#: codes among words don't outweigh the words.
NO_LANGUAGE_BIAS = 1.0
_STEP = 500_000


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # (2 ** BITS + 1, languages) float32; the last row, all 0, is for positions without an n-gram


def _buckets(codes: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each code point but the last order - 1."""
    count = len(codes) - order + 1
    h = np.full(count, order * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
    for k in range(order):
        h = (h ^ codes[k : k + count]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
    return (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts in lower case, one after the other, and their lengths."""
    texts = [t.lower() for t in texts]
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))


def _grams(codes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first position, bucket of each position) of stretches of the codes; 2 ** BITS where a text ends too soon."""
    for order in ORDERS:
        for at in range(0, len(codes), _STEP):
            stop = min(at + _STEP, len(codes))
            piece = codes[at : stop + order - 1]
            ids = np.full(stop - at, 1 << BITS, dtype=np.int64)
            if len(piece) >= order:
                found = _buckets(piece, order)
                ids[: len(found)] = found
            last = ends[(ends > at) & (ends < stop + order)]
            for back in range(1, order):
                gone = last - back
                ids[gone[(gone >= at) & (gone < stop)] - at] = 1 << BITS
            yield at, ids


def fit(rows: list[tuple[str | None, str]], alpha: float = 0.5) -> Model:
    """A model of (text, language) rows."""
    languages = sorted({lang for _, lang in rows})
    counts = np.zeros((1 << BITS, len(languages)))
    for k, lang in enumerate(languages):
        codes, lengths = _codes([t or "" for t, x in rows if x == lang])
        for _, ids in _grams(codes, np.cumsum(lengths)):
            counts[:, k] += np.bincount(ids, minlength=(1 << BITS) + 1)[: 1 << BITS]
    logs = np.log((counts + alpha) / (counts.sum(axis=0) + alpha * (1 << BITS)))
    return Model(languages, np.vstack([logs, np.zeros(len(languages))]).astype(np.float32))


def score(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts, languages) log-likelihoods, and how many n-grams each text has."""
    codes, lengths = _codes(texts)
    ends = np.cumsum(lengths)
    totals, grams = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), dtype=np.int64)
    full = np.flatnonzero(lengths)
    firsts = (ends - lengths)[full]
    for at, ids in _grams(codes, ends):
        a, b = np.searchsorted(firsts, at, side="right") - 1, np.searchsorted(firsts, at + len(ids), side="left")
        cuts = np.maximum(firsts[a:b], at) - at
        for k in range(len(model.languages)):
            totals[full[a:b], k] += np.add.reduceat(model.logs[:, k][ids], cuts, dtype=np.float64)
        grams[full[a:b]] += np.add.reduceat((ids < 1 << BITS).astype(np.int64), cuts)
    return totals, grams


def decide(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: the number of the best class, its lead per n-gram, and whether it is a language."""
    totals, grams = score(model, texts)
    per = np.column_stack([totals / np.maximum(grams, 1)[:, None], np.full(len(grams), -BITS * np.log(2) - NO_LANGUAGE_BIAS)])
    best = per.argmax(axis=1)
    top = np.partition(per, -2, axis=1)[:, -2:] if per.shape[1] > 1 else np.zeros((len(grams), 2))
    return best, top[:, 1] - top[:, 0], (best < len(model.languages)) & (grams > 0)


def train(docs: DataFrame, label: str = "lang", text: str = "text", per_language: int = TRAIN_PER_LANGUAGE, key: str = "doc_id") -> Model:
    """Fits on about per_language rows of each label, picked by a hash of the key; see TRAIN_LETTERS and MOST_LABELS for bounds."""
    docs = docs.filter(F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in docs.groupBy(label).count().orderBy(F.desc("count"), label).limit(MOST_LABELS).collect()}
    if not counts:
        return Model([], np.zeros(((1 << BITS) + 1, 0), dtype=np.float32))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (str(lang), per_language / n)])[F.col(label).cast("string")]
    drawn = F.pmod(F.xxhash64(F.lit("langid"), F.col(key)), F.lit(1_000_000)) < share * 1_000_000
    rows = docs.filter(drawn & (F.length(text_of(docs, text)) <= TRAIN_LETTERS)).select(text_of(docs, text), F.col(label).cast("string")).collect()
    return fit([(r[0], r[1]) for r in rows]) if rows else Model([], np.zeros(((1 << BITS) + 1, 0), dtype=np.float32))


def identify(docs: DataFrame, model: Model | None = None, text: str = "text", key: str = "doc_id", min_margin: float = MIN_MARGIN, keep: list[str] = ()) -> DataFrame:
    """Columns key, the columns keep, language, margin, accepted: a row for each document.

    margin: nats per n-gram by which the language leads the second, or no language at all if that comes second.
    """
    model = model or train(docs, text=text, key=key)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BITS and the number of languages
    source = docs.select(F.col(key), *keep, text_of(docs, text).alias("__aw_text"))
    kept = source.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, "__aw_text"):
            best, margin, known = decide(m, batch.column(batch.num_columns - 1).to_pylist())
            accepted = known & (margin >= min_margin)
            names = pa.array([m.languages[b] if ok else None for b, ok in zip(best, known)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], names, pa.array(margin), pa.array(accepted)], names=[*kept, "language", "margin", "accepted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(lean(run), f"{schema}, language string, margin double, accepted boolean")


def filter_languages(docs: DataFrame, model: Model | None = None, languages: list[str] | None = None, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of docs, with their columns, whose language is told and, if given, among the languages.

    The verdict is made beside each row in one pass: no exchange.
    """
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, "text"):
            best, margin, known = decide(m, [t or "" for t in batch.column(at).to_pylist()])
            known &= margin >= min_margin
            if languages is not None:
                known &= np.isin(np.array([*m.languages, ""])[best], languages)
            yield batch.filter(pa.array(known))

    return docs.mapInArrow(lean(run), docs.schema)
