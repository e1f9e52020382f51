"""The registered queries that SQL cannot express, against plain computations on whole tables."""

import hashlib
import os
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pytest
import xxhash

public_tokenizers = pytest.importorskip("public_tokenizers")

from lakeloom.llm import registry  # noqa: E402
from lakeloom.session import table  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark, sf):
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    return {r.doc_id: r for r in table(spark, sf, "documents").collect()}


def test_op1_packing(spark, sf, docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = registry.op1_packing(spark, sf).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert set(pieces) == set(docs)
    for i, d in docs.items():
        ids, at = [*own.encode(d.text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(array("I", ids[at : at + r.length]).tobytes())
            at += r.length
        assert at == len(ids)
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 2048
    padded = sum(2048 for w in windows.values() if (n := sum(r.length for r in w)) & (n - 1))
    assert padded == 0


def test_op4_ann(spark, sf):
    rows = {r.vec_id: np.array(r.embedding, float) for r in table(spark, sf, "embeddings").collect()}
    ids = np.array(sorted(rows))
    unit = np.stack([rows[i] / np.sqrt(rows[i] @ rows[i]) for i in ids.tolist()])
    got = defaultdict(list)
    for r in registry.op4_ann(spark, sf).collect():
        a, b = rows[r.query_id], rows[r.vec_id]
        assert r.score == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-12)
        got[r.query_id].append((r["rank"], r.vec_id))
    assert set(got) == {i for i in rows if i % 50 == 0}
    hits = 0
    for q, found in got.items():
        assert [r for r, _ in sorted(found)] == [1, 2, 3, 4, 5]
        score = unit @ unit[np.searchsorted(ids, q)]
        score[np.searchsorted(ids, q)] = -2
        hits += len({i for _, i in found} & set(ids[np.lexsort((ids, -score))[:5]].tolist()))
    assert hits / (5 * len(got)) >= 0.9


def test_op6_simhash(spark, sf, docs):
    def fingerprint(text):
        own = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split()]
        runs = [b" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))] if own else []
        votes = [0] * 64
        for h in (xxhash.xxh64_intdigest(s, 42) for s in runs):
            for b in range(64):
                votes[b] += h >> b & 1
        return sum(1 << b for b in range(64) if 2 * votes[b] > len(runs))

    fp = {i: fingerprint(d.text) for i, d in docs.items()}
    root = {i: i for i in fp}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in fp:
        for b in fp:
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = {(i, f"{fp[i]:016x}", find(i)) for i in fp}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in registry.op6_simhash(spark, sf).collect()} == want


def test_op7_bpe(spark, sf, docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in registry.op7_bpe(spark, sf).collect()}
    for i, d in docs.items():
        ids = own.encode(d.text or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x).hexdigest()
        assert got.pop(i) == (len(ids), sha(array("I", ids).tobytes()), sha(own.decode(ids, skip_special_tokens=False).encode()))
    assert not got


def test_op9_langid(spark, sf, docs):
    got = {r.doc_id: r for r in registry.op9_langid(spark, sf).collect()}
    assert set(got) == set(docs)
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    known = {d.lang for i, d in docs.items() if i not in held}
    right = 0
    for i, r in got.items():
        assert r.held_out == (i in held) and 0 <= r.score <= 1
        letters = any(map(str.isalpha, docs[i].text or ""))
        assert (r.lang_pred in known) if letters else (r.lang_pred == "und")
        right += i in held and r.lang_pred == docs[i].lang
    assert right / len(held) > 0.95
