"""Substring dedup by seed and extend over winnowed anchors.

A passage of ``min_words`` words that starts earlier somewhere else (smaller
document, or earlier in the same one) is removed wherever it comes again.

* Seed. Winnowing picks in each window of ``min_words`` words the least hash
  of its ``k``-word runs. Equal windows pick equal anchors, so each repeat of
  the length sought meets at an anchor: nothing is lost, and only about
  2 / (min_words - k + 2) of the positions travel.
* Extend. A row of an anchor holds a check value for each window it stands
  for, i.e. for each pair of a left and a right extension that reaches the
  length. Equal anchor and equal check: the match holds in both directions.
  Neighbouring matches join to maximal repeats when the words are marked.
* Hot passages. Each chunk of documents keeps the first of equal windows and
  marks the others on the spot, so an anchor sends one row a chunk at most and
  no pairs are made.

Identity is judged by an anchor hash of 64 bits and a check of 40 bits; word
sequences are not compared letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm import words
from lakeloom.session import n_partitions

_SENT = "bucket int, kind byte, doc long, code long, payload binary"
#: Buckets of anchors for each task; one is held at a time.
BUCKETS = 4
_NULL = np.iinfo(np.int64).min
_RUN = np.dtype([("doc", "<i8"), ("code", "<i8"), ("anchor", "<u8"), ("at", "<u4"), ("n", "<u4")])
_SPAN = np.dtype([("at", "<u4"), ("n", "<u4")])


def _spans(at: np.ndarray) -> bytes:
    """Sorted positions as runs."""
    cuts = np.flatnonzero(np.diff(at) != 1) + 1
    first = np.concatenate([[0], cuts])
    out = np.empty(len(first), _SPAN)
    out["at"] = at[first]
    out["n"] = np.diff(np.concatenate([first, [len(at)]]))
    return out.tobytes()


def _order(doc: np.ndarray, code: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.lexsort((at, code, doc))


def _sent(doc, code, spans, bucket=0):
    return {"bucket": bucket, "kind": 1, "doc": doc, "code": code, "payload": spans}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = [("bucket", pa.int32()), ("kind", pa.int8()), ("doc", pa.int64()), ("code", pa.int64()), ("payload", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds], names=[k for k, _ in kinds])


def _seed(min_words: int, k: int, n_buckets: int):
    def chunk(rows: list[tuple]) -> list[dict]:
        value, bounds = words.hash_texts([r[2] for r in rows])
        whole = words.fold(value, min_words)
        if not len(whole):
            return []
        size = np.diff(bounds)
        doc_of = np.repeat(np.arange(len(rows), dtype=np.int32), size)[: len(whole)]
        start = np.flatnonzero(np.arange(len(whole)) + min_words <= bounds[1:][doc_of])
        if not len(start):
            return []
        anchor = words.sliding_min(words.mix(words.fold(value, k)), min_words - k + 1)[start]
        doc_of, at = doc_of[start], (start - bounds[:-1][doc_of[start]]).astype(np.uint32)
        check = words.mix(whole[start] * words.U64(0x8CB92BA72F3D8DD7))
        docs = np.array([r[0] for r in rows], np.int64)
        codes = np.array([r[1] for r in rows], np.int64)
        rank = np.empty(len(rows), np.int64)
        rank[np.lexsort((codes, docs))] = np.arange(len(rows))
        place = (rank[doc_of] << 32) | at
        # The first of equal windows stays; the others are repeats already.
        key = anchor ^ (check >> words.U64(24)) * words.U64(0x9E3779B97F4A7C15)
        by = np.argsort(key, kind="stable")
        sorted_key = key[by]
        new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        group = np.cumsum(new) - 1
        least = np.minimum.reduceat(place[by], np.flatnonzero(new))
        first = np.empty(len(by), bool)
        first[by] = place[by] == least[group]
        out = []
        late = np.flatnonzero(~first)
        if len(late):
            # dealt by document: by anchor, the marks of a hot passage would all meet in one task
            deal = words.mix(docs.view(words.U64) ^ words.mix(codes.view(words.U64))) % words.U64(n_buckets)
            cut = np.flatnonzero(np.diff(doc_of[late])) + 1
            for part in np.split(late, cut):
                d = doc_of[part[0]]
                out.append(_sent(int(docs[d]), int(codes[d]), _spans(at[part]), int(deal[d])))
        own = np.flatnonzero(first)
        a, d, p = anchor[own], doc_of[own], at[own].astype(np.int64)
        cut = np.flatnonzero((a[1:] != a[:-1]) | (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)) + 1
        begin = np.concatenate([[0], cut])
        runs = np.empty(len(begin), _RUN)
        runs["doc"], runs["code"] = docs[d[begin]], codes[d[begin]]
        runs["anchor"], runs["at"] = a[begin], p[begin]
        runs["n"] = np.diff(np.concatenate([begin, [len(own)]]))
        bucket = (runs["anchor"] % words.U64(n_buckets)).astype(np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        sums = np.bincount(bucket, minlength=n_buckets)
        low = np.ascontiguousarray(check[own] & words.U64((1 << 40) - 1)).view(np.uint8).reshape(-1, 8)[:, :5]
        # windows in the order of their runs' buckets
        length = runs["n"][by_bucket].astype(np.int64)
        offset = np.repeat(begin[by_bucket] - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
        low = low[offset + np.arange(len(own))]
        at_run, at_win = 0, 0
        runs = runs[by_bucket]
        for b in np.flatnonzero(sums):
            r = runs[at_run : at_run + sums[b]]
            n = int(r["n"].sum())
            payload = len(r).to_bytes(4, "little") + r.tobytes() + low[at_win : at_win + n].tobytes()
            out.append({"bucket": int(b), "kind": 0, "doc": None, "code": None, "payload": payload})
            at_run, at_win = at_run + len(r), at_win + n
        return out

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        seen: set[tuple] = set()
        for b in batches:
            for part in words.slices(b, "body"):
                for doc, code, text in zip(*(part.column(c).to_pylist() for c in ("doc", "code", "body"))):
                    if text and (doc, code) not in seen:
                        seen.add((doc, code))
                        yield doc, code, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in words.batches(rows(batches)):
            out = chunk(group)
            if out:
                yield _batch(out)

    return run


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Find the windows that start earlier elsewhere, a bucket at a time; rows come sorted by bucket."""
    last, held = None, []
    for b in batches:
        kind = b.column("kind").to_numpy()
        done = b.filter(pa.array(kind == 1))
        if done.num_rows:
            yield done
        rest = b.filter(pa.array(kind == 0))
        for bucket, payload in zip(rest.column("bucket").to_pylist(), rest.column("payload").to_pylist()):
            if bucket != last and held:
                yield from _late(held)
                held = []
            last = bucket
            held.append(payload)
    if held:
        yield from _late(held)


def _late(payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Among the runs of one bucket, the windows whose equal starts earlier."""
    runs, checks = [], []
    for payload in payloads:
        n = int.from_bytes(payload[:4], "little")
        runs.append(np.frombuffer(payload, _RUN, n, 4))
        checks.append(np.frombuffer(payload, np.uint8, offset=4 + n * _RUN.itemsize).reshape(-1, 5))
    run = np.concatenate(runs)
    low = np.concatenate(checks)
    del runs, checks
    check = np.zeros((len(low), 8), np.uint8)
    check[:, :5] = low
    check = check.view(np.uint64).ravel()
    del low
    length = run["n"].astype(np.int64)
    of = np.repeat(np.arange(len(run), dtype=np.int32), length)
    # two windows agree if anchor and check agree
    key = run["anchor"][of] ^ words.mix(check)
    by = np.argsort(key, kind="stable").astype(np.int32 if len(key) < 2**31 else np.int64)
    sorted_key = key[by]
    same = sorted_key[1:] == sorted_key[:-1]
    twin = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    by = by[twin]
    del key, sorted_key, same, twin
    if not len(by):
        return
    step = np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length)
    r = of[by]
    anchor, value = run["anchor"][r], check[by]
    doc, code, at = run["doc"][r], run["code"][r], run["at"][r].astype(np.int64) + step[by]
    del step, of, check
    order = np.lexsort((at, code, doc, value, anchor))
    anchor, value, doc, code, at = anchor[order], value[order], doc[order], code[order], at[order]
    late = np.concatenate([[False], (anchor[1:] == anchor[:-1]) & (value[1:] == value[:-1])])
    doc, code, at = doc[late], code[late], at[late]
    if not len(doc):
        return
    order = _order(doc, code, at)
    doc, code, at = doc[order], code[order], at[order]
    cut = np.flatnonzero((doc[1:] != doc[:-1]) | (code[1:] != code[:-1])) + 1
    begin = np.concatenate([[0], cut])
    end = np.concatenate([cut, [len(doc)]])
    rows = []
    for s, e in zip(begin.tolist(), end.tolist()):
        rows.append(_sent(int(doc[s]), int(code[s]), _spans(at[s:e])))
        if len(rows) == 5000:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _mark(n: int, min_words: int, spans: list[bytes] | None) -> np.ndarray:
    """Which of a document's words stay."""
    edge = np.zeros(n + 1, np.int64)
    for payload in spans or ():
        s = np.frombuffer(payload, _SPAN)
        begin = s["at"].astype(np.int64)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + s["n"] + min_words - 1, -1)
    return np.cumsum(edge[:n]) == 0


def substring_dedup(df: DataFrame, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, keep_layout: bool = True, carry: bool = False) -> DataFrame:
    """Remove repeated passages of ``min_words`` words or more.

    Returns id_col, ``text`` (kept words joined by one space; with
    keep_layout, the text itself where nothing goes; null stays null),
    ``n_words`` and ``n_removed``; with carry, the columns of df with the new
    text in place of the old.

    Defined cases: a null text has no words; an empty one none either; a null
    id comes before all others; rows with the same id and the same text are
    one document, and each gets its result; rows with the same id but other
    texts are different documents, ordered by a hash of the text; an empty
    table gives an empty result; other columns are not looked at, or passed on.
    """
    if k is None:
        k = max(1, min(8, min_words // 2))
    parts = n_partitions(df.sparkSession)
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("doc"), F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)).alias("code"), F.col(text_col).cast("binary").alias("body"), *([F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text_col] or [F.lit(0)]).alias("rest")] if carry else []))
    dealt = docs.repartition(parts, "doc", "code")
    sent = dealt.mapInArrow(words.tidy(_seed(min_words, k, parts * BUCKETS)), _SENT)
    found = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(words.tidy(_extend), _SENT)
    spans = (
        found.select("doc", "code", "payload").repartition(parts, "doc", "code")
        .groupBy("doc", "code")
        .agg(F.collect_list("payload").alias("spans"))
    )
    joined = dealt.join(spans.hint("shuffle_hash"), ["doc", "code"], "left").select("doc", "body", "spans", *(["rest"] if carry else []))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in words.slices(whole, "body"):
                texts, n_words, n_removed = [], [], []
                for body, spans in zip(b.column("body").to_pylist(), b.column("spans").to_pylist()):
                    own = body.split() if body else []
                    n_words.append(len(own))
                    if not spans:
                        texts.append(body if keep_layout or body is None else b" ".join(own))
                        n_removed.append(0)
                        continue
                    stay = _mark(len(own), min_words, spans)
                    texts.append(b" ".join([w for w, keep in zip(own, stay.tolist()) if keep]))
                    n_removed.append(int(len(own) - stay.sum()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc"), pa.array(texts, pa.binary()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), *([b.column("rest")] if carry else [])],
                    names=["doc", "body", "n_words", "n_removed", *(["rest"] if carry else [])],
                )

    kinds = T.StructType().add("doc", "long").add("body", "binary").add("n_words", "long").add("n_removed", "long")
    if carry:
        done = joined.mapInArrow(words.tidy(finish), kinds.add(joined.schema["rest"]))
        return done.select(*[F.col("body").cast("string").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in df.columns])
    done = joined.mapInArrow(words.tidy(finish), kinds)
    return done.select(F.when(F.col("doc") != _NULL, F.col("doc")).alias(id_col), F.col("body").cast("string").alias("text"), "n_words", "n_removed")
