"""Text operators against brute force, with nulls, blanks, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
from array import array
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from lakeloom.llm import bpe, langid, packing, words  # noqa: E402
from lakeloom.llm.line_dedup import line_dedup  # noqa: E402
from lakeloom.llm import near_dedup as near  # noqa: E402
from lakeloom.llm.near_dedup import near_dedup  # noqa: E402
from lakeloom.llm.simhash import BKTree, BucketTree, simhash_components  # noqa: E402
from lakeloom.llm.substring_dedup import substring_dedup  # noqa: E402

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 9) or "") for _ in range(n))


def texts():
    rnd = random.Random(5)
    passage, base = prose(rnd, 60), prose(rnd, 150)
    out = [(1, base), (2, base), (3, base.replace("alpha", "ALPHA")), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "One"), (9, "a b")]
    out += [(10 + i, f"{prose(rnd, 30)}\n{passage}\n{prose(rnd, 25)}") for i in range(6)]
    near = base.split()
    for i in range(4):
        near[10 * i + 3] = f"edit{i}"
        out.append((20 + i, " ".join(near)))
    out += [(30, passage + " " + passage), (31, "é" * 50 + " ünï 日本 " + passage), (32, prose(rnd, 6000)), (None, base), (None, None), (2, base), (7, "other text of an id that repeats")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, 2, "r") for i, t in texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, doc string, code int, shard int, rest string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_word_hashes_do_not_depend_on_blocks():
    data = " ".join(f"w{i}" for i in range(3000)).encode()
    whole, at = words.hash_words(data)
    parts = [words.hash_words(b)[0] for b in words.blocks(data, 100)]
    assert whole.tolist() == [x for p in parts for x in p.tolist()] and len(set(whole.tolist())) == 3000
    v = whole[:50]
    assert words.sliding_min(v, 13).tolist() == [min(v[i : i + 13].tolist()) for i in range(38)]
    assert words.fold(v, 7)[3] == words.fold(v[3:], 7)[0] and len(words.fold(v, 51)) == 0


def brute_substring(rows, length):
    """rows in order; what each keeps."""
    seen, out = set(), []
    for _, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            if k in seen:
                gone[i : i + length] = [True] * length
            seen.add(k)
        out.append(b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def test_substring_dedup(docs):
    got = substring_dedup(docs, 20, keep_layout=False).collect()
    assert len(got) == len(texts())
    unique = [r for r in texts() if r[0] != 7 and not (r[0] == 2)] + [(2, dict(texts())[2])]
    unique.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    want = defaultdict(set)
    for (i, _), kept in zip(unique, brute_substring(unique, 20)):
        want[i].add(kept)
    for r in got:
        if r.doc_id != 7:
            assert (r.text or "") in want[r.doc_id], r.doc_id
    assert all(r.n_removed == r.n_words for r in got if r.doc_id in (2,))


@pytest.mark.parametrize("length", [2, 5, 50])
def test_substring_lengths(spark, length):
    rnd = random.Random(length)
    rows = [(i, " ".join(rnd.choice("abc") if length < 50 else rnd.choice(WORDS[:2]) for _ in range(rnd.randint(0, 160)))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(5)
    got = {r.doc_id: r.text or "" for r in substring_dedup(df, length, keep_layout=False).collect()}
    assert got == {i: k for (i, _), k in zip(rows, brute_substring(rows, length))}


def test_substring_carries_columns(docs, none):
    out = substring_dedup(docs, 20, carry=True)
    assert out.columns == docs.columns and out.count() == len(texts()) and {r.rest for r in out.collect()} == {"r"}
    assert substring_dedup(none, 20).count() == 0


def fingerprint(text):
    w = [x.lower() for x in (text or "").encode().split()]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("tree", [2048, 2])
def test_simhash(spark, docs, none, tree, monkeypatch):
    from lakeloom.llm import simhash

    monkeypatch.setattr(simhash.link_fingerprints, "__defaults__", (tree,))
    rows = texts()
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (fps[a] ^ fps[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    want = sorted(((rows[i][0], f"{fps[i]:016x}", least[root[i]]) for i in range(len(rows))), key=str)
    got = sorted((tuple(r) for r in simhash_components(docs).collect()), key=str)
    assert got == want
    assert simhash_components(none).count() == 0


def test_links_in_split_shards(spark):
    """Many fingerprints close to each other: shards are split, and no class is lost."""
    from lakeloom.llm.simhash import link_fingerprints
    from lakeloom.operators.components import connected_components

    rnd = random.Random(2)
    fps = {rnd.getrandbits(64) for _ in range(50)}
    for f in list(fps)[:6]:
        for _ in range(40):
            fps.add(f ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    values = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    links = link_fingerprints(spark.createDataFrame([(v,) for v in values], "fp long"), 2, tree=4)
    got = {r.node: r.component for r in connected_components(links).collect()}
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    mask = (1 << 64) - 1
    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) & mask).bit_count() <= 2 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert {v: got.get(v, v) for v in values} == {v: find(v) for v in values}


def test_bk_tree():
    rnd = random.Random(0)
    values = [rnd.getrandbits(16) for _ in range(300)]
    tree = BKTree()
    for v in values:
        tree.insert(v)
    for q in values[:40]:
        kept = set(tree.values)
        assert {tree.values[i] for i in tree.search(q, 3)} == {v for v in kept if (v ^ q).bit_count() <= 3}


def test_near_dedup(docs, none):
    got = near_dedup(docs)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert len(ids) == len(set(ids)) + (ids.count(7) == 2)
    rows = [(i, t) for i, t in texts()]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                same = sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
                if same:
                    root[a] = root[b] = min(root[a], root[b])
    want = sorted(min((rows[i][0] if rows[i][0] is not None else 10**9) for i in range(len(rows)) if root[i] == r) for r in set(root))
    assert sorted(i if i is not None else 10**9 for i in ids) == want
    assert near_dedup(none).count() == 0


def kept_by_brute_force(texts, similarity=0.8):
    """Least ids of the classes of texts linked at the similarity of their five-word shingles."""
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                links += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(i) for i in range(len(texts))}, links


@pytest.mark.parametrize("block", [3, 1024])
def test_near_dedup_of_hot_shards(spark, block, monkeypatch):
    """A large group of near copies that share a start, in chains, in blocks of three and whole."""
    rnd = random.Random(11)
    start = [f"s{k}" for k in range(40)]
    texts = [" ".join(start)]
    for g in range(3):
        own = start + [f"g{g}x{k}" for k in range(40)]
        for k in range(14):
            own = [w if i < 40 or rnd.random() > 0.02 else f"e{g}y{k}z{i}" for i, w in enumerate(own)]
            texts.append(" ".join(own))
    monkeypatch.setattr(near, "BLOCK", block)
    got = {r.doc_id for r in near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(5)).collect()}
    want, links = kept_by_brute_force(texts)
    assert got == want and links > 60 and len(want) > 3


def test_near_dedup_recall(spark):
    """Pairs between 0.8 and 0.85, each alone: candidates by min-hash and radius lose hardly any."""
    rnd = random.Random(12)
    texts = []
    for g in range(250):
        own = [f"g{g}x{k}" for k in range(rnd.randint(90, 200))]
        n = len(own) - 4
        texts += [" ".join(own), " ".join(own + [f"more{g}y{k}" for k in range(int(n * rnd.uniform(0.18, 0.25)))])]
    got = {r.doc_id for r in near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    want, links = kept_by_brute_force(texts)
    assert want <= got and links >= 240 and len(got - want) <= 0.02 * links


def test_bucket_tree():
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(20)]
    values = [b ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for b in base for _ in range(40)] + base[:1] * 200
    tree = BucketTree(np.array(values, np.uint64), leaf=16)
    for q in base + [0]:
        for radius in (0, 2, 22):
            got = tree.search(np.uint64(q), radius).tolist()
            assert sorted(got) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= radius]
            far = [(values[i] ^ q).bit_count() for i in got]
            assert far == sorted(far)
    assert len(BucketTree(np.zeros(0, np.uint64)).search(np.uint64(1), 3)) == 0


def test_near_dedup_of_long_texts(spark):
    """Pairs of over 512 shingles on both sides of the bound, too near for a sketch to tell."""
    rows, linked = [], 0
    for n in range(24):
        own = 180 + n
        shared = [f"s{n}x{k}" for k in range(1504)]
        rows += [(2 * n + side, " ".join(shared + [f"o{n}x{side}x{k}" for k in range(own)])) for side in (0, 1)]
        linked += 1500 / (1500 + 2 * own) >= 0.8
    assert 0 < linked < 24
    got = {r.doc_id for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id").collect()}
    want = {2 * n + side for n in range(24) for side in (0, 1) if side == 0 or 1500 / (1500 + 2 * (180 + n)) < 0.8}
    assert got == want


def drop_lines(rows, min_docs=3, levels=3):
    """Line dedup by brute force: {(id, text): kept lines}."""
    docs = sorted({(i, t) for i, t in rows if t is not None}, key=lambda d: (d[0] is not None, d[0] or 0))
    shape = {}
    for line in {x for _, t in docs for x in t.split("\n")}:
        t = tuple(line.replace("\t", " ").replace("\r", " ").split())
        if len(t) >= 4:
            t = tuple("<*>" if any(c in "0123456789" for c in w) else w for w in t)
            shape[line] = (t, (len(t), *t[:3])) if set(t) != {"<*>"} else (t, None)
        else:
            shape[line] = (t, ("short", t) if len(" ".join(t)) >= 16 else None)
    homes = defaultdict(set)  # documents of each sequence of tokens
    for d in docs:
        for line in d[1].split("\n"):
            if shape[line][1]:
                homes[shape[line]].add(d)
    nodes, template = defaultdict(set), {}
    for t, leaf in homes:
        nodes[leaf].add(t)
    for level in range(levels + 1):
        below = defaultdict(set)
        for node, lines in nodes.items():
            leaf = node if not level else node[0]
            if leaf[0] == "short" or len(lines) < 2 or sum(len(homes[t, leaf]) for t in lines) < min_docs:
                continue
            kinds, top = [], []
            for column in zip(*lines):
                weights = defaultdict(int)
                for w, t in zip(column, lines):
                    weights[w] += len(homes[t, leaf])
                kinds.append(len(weights))
                top.append(max(weights, key=lambda w: (weights[w], w.encode())))
            at = min((k, i) for i, k in enumerate(kinds) if k > 1)[1]
            for t in lines:
                if sum(map(str.__eq__, t, top)) >= 0.8 * len(t):
                    template[t, leaf] = (node, "*")
                else:
                    below[leaf, node, t[at]].add(t)
        nodes = below
    groups = defaultdict(set)
    for key, own in homes.items():
        groups[template.get(key, key)] |= own
    first = {g: min(own, key=docs.index) for g, own in groups.items() if len(own) >= min_docs}
    out = {}
    for d in docs:
        out[d] = [x for x in d[1].split("\n") if first.get(template.get(shape[x], shape[x]), d) == d or not shape[x][1]]
    return out


def test_line_dedup(spark, docs, none):
    rows = [(1, "x y z w\nmenu home about contact\nown line of one"), (2, "menu home about contact\nown line of two two"), (3, "menu home about contact\nshort"), (4, None), (5, ""), (None, "menu home about contact"), (2, "menu home about contact\nown line of two two")]
    rows += [(10 + i, f"page {i * 37} of 99 shown here\nunlike {' '.join(random.Random(i).sample(WORDS, 9))}") for i in range(4)]
    rows += [(20 + i, f"posted on the site by user {n} about one thing only today") for i, n in enumerate(["ann", "bob", "cy", "dee"])]
    rows += [(30 + i, f"All rights reserved.\n1 2 3 4\n  yes \nkey\t{i}  of the\trow\r\n版权所有未经许可不得转载或以任何方式使用\nend {i}") for i in range(4)]
    rows += [(-(1 << 63), "menu home about contact"), (40, "w" * 200_000 + " 1 " + "v" * 1000 + "1 x y"), (41, "\n".join(f"line {WORDS[k % 19]} {k} of a very long text" for k in range(3000)))]
    df = spark.createDataFrame([(i, t, "c", "d", 1) for i, t in rows], "doc_id long, text string, body string, gone string, _n_dropped int").repartition(3)
    out = line_dedup(df, carry=True)
    assert out.columns == ["_n_lines", "_n_dropped", "_text", "_row"]
    got = {(r._row.doc_id, r._row.text): r for r in out.collect()}
    want = drop_lines(rows)
    assert {k: r._text.split("\n") if r._text or len(want[k]) else [] for k, r in got.items() if k[1] is not None} == want
    assert all(r._n_lines == k[1].count("\n") + 1 and r._n_dropped == r._n_lines - len(want[k]) for k, r in got.items() if k[1] is not None)
    text = {k[0]: r._text for k, r in got.items()}
    assert text[None] == "menu home about contact" and text[-(1 << 63)] == ""  # the first of them stays
    assert text[1] == "x y z w\nown line of one" and text[3] == "short" and text[2] == "own line of two two"
    assert text[4] is None and got[4, None]._n_lines == 0 and text[5] == "" and got[5, ""]._n_lines == 1
    assert text[20] and all(text[20 + i] == "" for i in (1, 2, 3)) and text[31] == "1 2 3 4\n  yes \nend 1"
    assert out.count() == len(rows) and line_dedup(docs.limit(0)).count() == 0 and line_dedup(df).columns == ["doc_id", "text", "_n_lines", "_n_dropped"]


def test_line_dedup_of_families_in_one_leaf(spark):
    """Three families of lines with a variable field and the same three leading tokens and length."""
    names = ["ann", "bob", "cy", "dee", "eve", "flo", "gus", "hal", "ivy", "jo"]
    families = [("news about {} in our weekly section and archive", 10), ("post of {} from people that you may like", 5), ("book by {} with a cover that is blue", 4)]
    rows, at = [], 0
    for form, n in families:
        for name in names[:n]:
            rows.append((at, "read more here " + form.format(name)))
            at += 1
    got = {r.doc_id: r._n_dropped for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: int(i not in (0, 10, 15)) for i in range(19)}


def test_line_dedup_of_random_lines(spark):
    rnd = random.Random(8)
    words = ["a", "b", "c", "dd", "e1", "ü"]
    rows = [(i, "\n".join(" ".join(rnd.choices(words[: rnd.randint(1, 6)], k=rnd.randint(3, 8))) for _ in range(6))) for i in range(120)]
    got = {(r._row.doc_id, r._row.text): r._text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), carry=True).collect()}
    want = {k: "\n".join(v) for k, v in drop_lines(rows).items()}
    assert got == want and sum(map(len, want.values())) < 0.8 * sum(len(t) for _, t in rows)


def test_codecs_equal_the_library():
    from tokenizers import Tokenizer

    rnd = random.Random(3)
    odd = ["", " ", "a  b", " a", "a \n b", "ΑΣ ΣΑΣ", "İstanbul", "it's DON'T we'll'd", "12 ½ x²", "<|endoftext|> a<|startoftext|>b <|end", "éa", "日本語 テスト", "\x1c a\x1eb", " x ​", "a\x85b", "''' ...!!", "\x00"]
    odd += ["".join(rnd.choice("abcdeé'’ \n\t.,!12😀ñßΣσ <|>ABC") for _ in range(rnd.randint(1, 60))) for _ in range(500)]
    odd += ["".join(rnd.choice("aeinorstl") for _ in range(rnd.randint(1, 30))) for _ in range(500)]
    own = Tokenizer.from_file(WORD)
    for text, (ids, decoded) in zip(odd, bpe.WordCodec(WORD).run([t.encode() for t in odd])):
        want = own.encode(text, add_special_tokens=False).ids
        assert array("I", ids).tolist() == want and decoded.decode() == own.decode(want, skip_special_tokens=False), text
    own = Tokenizer.from_file(BYTE)
    for text, ids in zip(odd, bpe.ByteCodec(BYTE).run([t.encode() for t in odd])):
        assert array("I", ids).tolist() == own.encode(text, add_special_tokens=False).ids, text


def test_encode_decode(docs, none):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(WORD)
    got = bpe.encode_decode(docs, WORD).collect()
    want = sorted(((i, own.encode(t or "", add_special_tokens=False).ids) for i, t in texts()), key=str)
    assert sorted(((r.doc_id, array("I", bytes(r.ids)).tolist()) for r in got), key=str) == want
    assert bpe.encode_decode(none, WORD).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(BYTE)
    for size, n_open in ((2048, 64), (64, 2)):
        got = packing.pack_documents(docs, BYTE, size=size, n_open=n_open).collect()
        windows, whole = defaultdict(list), defaultdict(list)
        for r in got:
            windows[r.sequence_id].append(r)
            assert len(r.ids) == 4 * r.length > 0
        for w in windows.values():
            w.sort(key=lambda r: r.offset)
            n = 0
            for r in w:
                assert r.offset == n
                n += r.length
            assert n <= size and n & (n - 1) == 0  # full, or a power of two
        for r in sorted(got, key=lambda r: r.start):
            whole[r.doc_id].append(array("I", bytes(r.ids)).tolist())
        for i, t in texts():
            if i is not None and i not in (2, 7):
                assert [x for p in whole[i] for x in p] == [*own.encode(t or "", add_special_tokens=False).ids, 1]
        assert sum(r.length for r in got) == sum(len(own.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts())
    assert packing.pack_documents(none, BYTE).count() == 0


def test_packing_with_a_small_cache_gives_the_same_pieces(docs):
    columns = ["doc_id", "start", "length", "sequence_id", "offset", "ids"]
    few, many = (sorted(packing.pack_documents(docs, BYTE, size=128, cache=c).select(*columns).collect(), key=repr) for c in (20, 1_000_000))
    assert few == many


def mixture(text, logs, rounds=12, penalty=3.0, floor=0.01):
    """The mixture of one text by plain loops: (languages with shares, score)."""
    counts = defaultdict(int)
    for g in langid.trigrams(text).tolist():
        counts[g] += 1
    every, total = range(len(logs[0])), sum(counts.values())

    def fit(share):
        return sum(n * math.log(sum(s * math.exp(logs[g][c]) for c, s in share.items())) for g, n in counts.items())

    def em(share, rounds):
        for _ in range(rounds):
            new = dict.fromkeys(share, 0.0)
            for g, n in counts.items():
                parts = {c: s * math.exp(logs[g][c]) for c, s in share.items()}
                for c, x in parts.items():
                    new[c] += n * x / sum(parts.values()) / total
            share = new
        return share

    whole = em(dict.fromkeys(every, 1 / len(every)), rounds)
    rank = sorted(every, key=lambda c: (-whole[c], c))
    alone = max(every, key=lambda c: (fit({c: 1.0}), -c))
    best, value = {alone: 1.0}, fit({alone: 1.0})
    for m in range(2, sum(s >= floor for s in whole.values()) + 1):
        own = em({c: whole[c] / sum(whole[x] for x in rank[:m]) for c in rank[:m]}, 4)
        worth = fit(own) - penalty * (m - 1) * math.log(total + 1)
        if worth > value:
            best, value = own, worth
    first = min(best, key=lambda c: (-best[c], c))
    return best, whole[first]


def test_mixtures_equal_brute_force_in_any_block():
    rnd = random.Random(9)
    say = {f"l{k}": ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyzäöé", k=rnd.randint(2, 8))) for _ in range(60)] for k in range(8)}
    logs = np.zeros((langid.BUCKETS, 8))
    for k, own in enumerate(say.values()):
        np.add.at(logs[:, k], langid.trigrams(" ".join(rnd.choices(own, k=3000))), 1)
    model = langid.LanguageModel(list(say), np.log((logs + 0.05) / (logs.sum(axis=0) + 0.05 * langid.BUCKETS)))
    texts = [" ".join(w for own in rnd.sample(list(say.values()), rnd.choice([1, 1, 2, 3, 8])) for w in rnd.choices(own, k=rnd.choice([2, 8, 40]))) for _ in range(60)]
    texts.append(" ".join(w for own in say.values() for w in own))
    whole = langid.mixtures(texts, model)
    assert whole == [langid.mixtures([t], model)[0] for t in texts] == langid.mixtures(texts[::-1], model)[::-1]
    for t, m in zip(texts, whole):
        shares, score = mixture(t, model.logs)
        assert dict(m.shares) == pytest.approx({f"l{c}": s for c, s in shares.items()}) and m.score == pytest.approx(score)
    assert len(whole[-1].shares) == 8 and len({len(m.shares) for m in whole}) > 3  # no cap on languages


def test_language_mixtures(spark, none):
    say = {"en": "the weather is nice and the people are walking in the park with their children", "de": "das wetter ist schön und die leute gehen mit ihren kindern durch den großen park", "fr": "le temps est beau et les gens se promènent dans le parc avec leurs enfants"}
    rnd = random.Random(1)
    mix = lambda lang, n: " ".join(rnd.choice(say[lang].split()) for _ in range(n))
    rows = [(i, mix(lang, 40), lang) for i, lang in enumerate(list(say) * 20)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string").withColumn("score", F.lit("clash")).withColumn("_body", F.lit(1))
    model = langid.fit_languages(df)
    assert model.names == ["de", "en", "fr"]
    asked = [(1, mix("en", 30)), (2, mix("de", 30)), (3, mix("fr", 60) + " " + mix("en", 60)), (4, None), (5, ""), (6, "123 !? ½ ②"), (7, mix("fr", 20000)), (8, "x"), (None, mix("en", 9))]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(asked, "doc_id int, text string"), model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 7, None)] == ["en", "de", "fr", "en"]
    assert set(got[3].languages) == {"fr", "en"} and sum(got[3].shares) == pytest.approx(1)
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (4, 5, 6)) and got[8].lang_pred in model.names
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[1].fit > 0 and got[4].fit is None
    twice = spark.createDataFrame([(1, "la le", "x"), (1, "la le", "y"), (1, "la le", "x")], "doc_id int, text string, lang string")
    assert [(r.lang_pred, r.languages) for r in langid.identify(twice, langid.fit_languages(twice)).collect()] == [("x", ["x"])] * 3  # a tie: by name
    empty = langid.fit_languages(df.limit(0))
    assert empty.names == [] and [r.lang_pred for r in langid.identify(df, empty).limit(2).collect()] == ["und", "und"]
    assert hashlib.sha1(model.logs.tobytes()).digest() == hashlib.sha1(langid.fit_languages(df.repartition(7)).logs.tobytes()).digest()
