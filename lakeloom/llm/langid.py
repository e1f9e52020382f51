"""Language ID by inference over mixtures of languages.

Each language has a distribution over hashed byte trigrams, counted on labelled
rows. A document is a mixture: expectation-maximisation estimates the shares of
all languages from the trigram likelihoods. The set of languages is chosen by
penalised likelihood: of the nested sets of the largest shares, the one whose
likelihood, less a penalty for each further language, is best. Each document is
judged alone: its result depends on no other text of its block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm import words

BUCKETS = 1 << 16
#: Bytes of text whose mixtures over four languages are estimated at once: memory is some 150 bytes for each.
BLOCK = 256 << 10
#: ASCII other than letters counts as a space; capitals as small letters.
_FOLD = np.array([c | 0x20 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)], np.uint8)


def has_letter(text: str) -> bool:
    """Whether a text has a letter of any script (Unicode category L)."""
    return any(map(str.isalpha, text))


def trigrams(text: str) -> np.ndarray:
    """Buckets of a text's byte trigrams; runs of other characters are one space."""
    raw = _FOLD[np.frombuffer(f" {text} ".lower().encode("utf-8", "replace"), np.uint8)]
    space = raw == 0x20
    raw = raw[~(space & np.concatenate([[False], space[:-1]]))].astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.uint32)
    code = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    return (code * np.uint32(2654435761)) >> np.uint32(16)


@dataclass
class LanguageModel:
    names: list[str]
    #: log likelihood of each bucket (rows), by language (columns)
    logs: np.ndarray


@dataclass
class Mixture:
    """What a text is made of."""

    #: the chosen languages with their shares, largest first; none if undetermined
    shares: list[tuple[str, float]] = field(default_factory=list)
    #: share of the first language in the mixture of all languages
    score: float = 0.0
    #: log likelihood of the text in the chosen mixture, less that in uniform noise
    fit: float | None = None


def fit_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bound: int = 200_000, alpha: float = 0.05) -> LanguageModel:
    """Count trigrams by language on labelled rows.

    bound: rows to learn from, about. Beyond it rows are chosen by a hash of
    their id, evenly over the table. Counts are summed per partition before
    the shuffle. The model is bounded: 65,536 numbers for each language.
    Rows with a null text or label are not used; a table without labelled rows
    gives a model without languages.
    """
    known = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), F.col(lang_col).cast("string").alias("lang"))
    n = known.count()
    if n > bound:
        known = known.where(F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(1 << 20)) < int((1 << 20) * bound / n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for part in words.slices(b, "body"):
                for text, lang in zip(part.column("body").to_pylist(), part.column("lang").to_pylist()):
                    own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    got = trigrams(text)
                    if len(got) > BUCKETS // 8:
                        own += np.bincount(got, minlength=BUCKETS)
                    else:
                        np.add.at(own, got, 1)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], names=["lang", "bucket", "n"])

    counts = known.mapInArrow(words.tidy(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = np.array(counts["lang"].to_pylist(), object)
    names = sorted(set(langs.tolist()))
    logs = np.zeros((len(names), BUCKETS))
    buckets, n = counts["bucket"].to_numpy(), counts["n"].to_numpy()
    for i, name in enumerate(names):
        own = langs == name
        logs[i, buckets[own]] = n[own]
    logs = np.log((logs + alpha) / (logs.sum(axis=1, keepdims=True) + alpha * BUCKETS)) if names else logs
    return LanguageModel(names, np.ascontiguousarray(logs.T))


def _em(p: np.ndarray, n: np.ndarray, size: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares after some rounds of expectation-maximisation, and their log likelihoods.

    p: likelihoods of the documents' trigrams (rows, ``size`` of each document
    in turn) by language; n: how often they occur; share: what to start from.
    """
    start = np.cumsum(size) - size
    of = np.repeat(np.arange(len(size)), size)
    total = np.add.reduceat(n, start)
    for _ in range(rounds):
        part = p * share[of]
        part *= (n / np.maximum(part.sum(axis=1), 1e-300))[:, None]
        share = np.add.reduceat(part, start, axis=0) / total[:, None]
    return share, np.add.reduceat(n * np.log(np.maximum((p * share[of]).sum(axis=1), 1e-300)), start)


def mixtures(texts: list[str], model: LanguageModel, rounds: int = 12, penalty: float = 3.0, floor: float = 0.01) -> list[Mixture]:
    """The mixture of each text.

    rounds: of the estimate over all languages. penalty: a further language
    must gain this times the log of the number of trigrams. floor: languages
    with less of the whole mixture are not tried. A text's result is the same
    whatever texts are beside it.
    """
    out = [Mixture() for _ in texts]
    names = model.names
    docs, parts = [], []
    for i, text in enumerate(texts):
        if names and text and has_letter(text):
            got = trigrams(text)
            if len(got) > BUCKETS:
                n = np.bincount(got)
                parts.append((np.flatnonzero(n), n[n > 0]))
            else:
                parts.append(np.unique(got, return_counts=True))
            docs.append(i)
    if not docs:
        return out
    size = np.array([len(a) for a, _ in parts])
    bucket = np.concatenate([a for a, _ in parts])
    n = np.concatenate([c for _, c in parts]).astype(float)
    start = np.cumsum(size) - size
    total = np.add.reduceat(n, start)
    log = model.logs[bucket]
    alone = np.add.reduceat(n[:, None] * log, start, axis=0)
    shift = log.max(axis=1)
    p = np.exp(log - shift[:, None])
    shifted = np.add.reduceat(n * shift, start)
    whole, _ = _em(p, n, size, np.full((len(docs), len(names)), 1.0 / len(names)), rounds)
    rank = np.argsort(np.argsort(-whole, axis=1, kind="stable"), axis=1, kind="stable")
    # one language: the likeliest alone
    every = np.arange(len(docs))
    first = alone.argmax(axis=1)
    chosen = np.zeros_like(whole)
    chosen[every, first] = 1.0
    value = alone[every, first]
    fit = value.copy()
    several = (whole >= floor).sum(axis=1)
    for m in range(2, int(several.max()) + 1):
        tried = np.flatnonzero(several >= m)
        rows = np.repeat(several >= m, size)
        own = np.where(rank[tried] < m, whole[tried], 0)
        own, likely = _em(p[rows], n[rows], size[tried], own / own.sum(axis=1, keepdims=True), 4)
        likely += shifted[tried]
        worth = likely - penalty * (m - 1) * np.log(total[tried] + 1)
        better = worth > value[tried]
        value[tried[better]], fit[tried[better]] = worth[better], likely[better]
        chosen[tried[better]] = own[better]
    for d, i in enumerate(docs):
        order = [c for c in np.argsort(-chosen[d], kind="stable") if chosen[d, c] > 0]
        out[i] = Mixture([(names[c], float(min(1.0, chosen[d, c]))) for c in order], float(min(1.0, whole[d, order[0]])), float(fit[d] + total[d] * np.log(BUCKETS)))
    return out


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns of ``keep``, lang_pred, score (0 to 1), fit, languages and shares.

    score: share of lang_pred in the mixture of all languages. fit: how much
    likelier the text is in the chosen mixture than in uniform noise (a
    difference of logs); far below 0 it is in no learned language.

    Defined cases: a null text, or one without a letter, is ``und`` with score
    0, a null fit and no languages; so is any text if the model has none; of
    equally likely languages the first by name counts; null ids stay null;
    repeated rows are kept; an empty table gives an empty result; only the
    text decides.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in dict.fromkeys([id_col, *keep]) if c != text_col]
    source = df.select(F.col(text_col).cast("string").alias("_body"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(rest)))
    block = max(1, BLOCK * 4 // max(4, len(model.names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own in words.slices(b, "_body", block):
                found = mixtures(own.column("_body").to_pylist(), shared.value)
                got = [
                    pa.array([m.shares[0][0] if m.shares else "und" for m in found], pa.string()),
                    pa.array([m.score for m in found], pa.float64()),
                    pa.array([m.fit for m in found], pa.float64()),
                    pa.array([[x for x, _ in m.shares] for m in found], pa.list_(pa.string())),
                    pa.array([[x for _, x in m.shares] for m in found], pa.list_(pa.float64())),
                ]
                passed = own if text_col in keep else own.drop_columns(["_body"])
                yield pa.RecordBatch.from_arrays([*passed.columns, *got], names=[*passed.schema.names, "lang_pred", "score", "fit", "languages", "shares"])

    kinds = T.StructType(source.schema.fields[0 if text_col in keep else 1 :])
    for name, kind in (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("fit", T.DoubleType()), ("languages", T.ArrayType(T.StringType())), ("shares", T.ArrayType(T.DoubleType()))):
        kinds.add(name, kind)
    out = source.mapInArrow(words.tidy(run), kinds)
    passed = [F.col("_body" if c == text_col else f"_{rest.index(c)}").alias(c) for c in dict.fromkeys([id_col, *keep])]
    return out.select(*passed, "lang_pred", "score", "fit", "languages", "shares")


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
