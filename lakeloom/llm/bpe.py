"""BPE encoding by prefix-sharing trie traversal, and decoding.

The last token of the encoding of each prefix of a word fixes the whole
encoding: the last token t of a prefix is the one whose left neighbour, the
last token of the prefix before t, forms a valid pair with it (a pair is valid
if its bytes encode to just that pair). Distinct words form a trie; a
depth-first walk hands these last-token states down, so what words share at
their start is computed once. The walk goes over the sorted words, which is
the trie's depth-first order, with the states of the current path on a stack:
memory is one path and the words of one batch.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import words

#: Cached chunks of a worker; beyond that the latest, and so mostly rare ones, go.
CACHE = 500_000
#: Pairs of tokens that a worker keeps judged, some 100 bytes each.
PAIRS = 1_000_000


def shrink(cache: dict, most: int = CACHE) -> None:
    """Drop the latest quarter of a full cache."""
    if len(cache) > most:
        while len(cache) > most * 3 // 4:
            cache.popitem()


def byte_alphabet() -> dict[int, str]:
    """Printable stand-ins for bytes: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TrieBPE:
    """A BPE model of merges, with or without a word-end suffix."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = "") -> None:
        self.vocab, self.suffix = vocab, suffix
        self.text = {i: t for t, i in vocab.items()}
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): r for r, m in enumerate(merges)}
        self.pairs: dict[int, bool] = {}
        self.own: dict[int, bool] = {}
        cut = len(suffix)
        self.inner = self._endings({t: i for t, i in vocab.items() if not (cut and len(t) > cut and t.endswith(suffix))})
        self.final = self._endings({t[:-cut]: i for t, i in vocab.items() if len(t) > cut and t.endswith(suffix)}) if cut else self.inner

    def symbols(self, token: str) -> list[str]:
        """Single characters, the last with the suffix if the token ends a word."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE: merge the leftmost pair of the least rank until none is left."""
        parts = list(symbols)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get((parts[i], parts[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stands(self, token: int) -> bool:
        """Whether a token's own text encodes to it."""
        got = self.own.get(token)
        if got is None:
            text = self.text[token]
            got = self.own[token] = self.merge(self.symbols(text)) == [text]
        return got

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens in a row are the encoding of their text."""
        a, b = self.text[left], self.text[right]
        return self.stands(left) and self.stands(right) and self.merge(self.symbols(a) + self.symbols(b)) == [a, b]

    @staticmethod
    def _endings(tokens: dict[str, int]) -> dict:
        """Tokens by their characters from the last to the first; a token's id is under 0."""
        top: dict = {}
        for text, i in tokens.items():
            node = top
            for c in reversed(text):
                node = node.setdefault(c, {})
            node[0] = i
        return top

    def _last(self, node: dict, word: str, end: int, path: list) -> tuple[int, int] | None:
        """Last token of word[:end] and its length, given the states of shorter prefixes."""
        found = []
        at = end
        while at:
            at -= 1
            node = node.get(word[at])
            if node is None:
                break
            token = node.get(0)
            if token is not None:
                found.append((token, end - at))
        for last in reversed(found):
            before = path[end - last[1]]
            if before is None:
                if last[1] == end and self.stands(last[0]):
                    return last
                continue
            key = before[0] << 20 | last[0]
            ok = self.pairs.get(key)
            if ok is None:
                shrink(self.pairs, PAIRS)
                ok = self.pairs[key] = self.fits(before[0], last[0])
            if ok:
                return last
        return None

    def encode(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Token ids of distinct non-empty words."""
        out = {}
        path: list = [None]  # path[d]: last token of the prefix of d characters
        before = ""
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word), len(path) - 1)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del path[shared + 1 :]
            inner = len(word) - 1 if self.suffix else len(word)
            for end in range(len(path), inner + 1):
                path.append(self._last(self.inner, word, end, path))
            last = self._last(self.final, word, len(word), path) if self.suffix else path[len(word)]
            ids, end = [], len(word)
            while last is not None:
                ids.append(last[0])
                end -= last[1]
                if not end:
                    break
                last = path[end]
            if end:  # no chain of valid pairs
                ids = [self.vocab[x] for x in self.merge([*word[:-1], word[-1] + self.suffix])][::-1]
            out[word] = tuple(reversed(ids))
            before = word
        return out


class WordCodec:
    """Encoder and decoder of a tokenizer file that drops white space and marks word ends."""

    _PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
    _PLAIN = re.compile(rb"[\x21-\x7e]+").fullmatch

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.bpe = TrieBPE(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.special = {x["content"].encode(): x["id"] for x in file["added_tokens"]}
        self.token = {**self.bpe.text, **{x["id"]: x["content"] for x in file["added_tokens"]}}
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None
        own = Tokenizer.from_file(path)
        self.normalize, self.split = own.normalizer.normalize_str, own.pre_tokenizer.pre_tokenize_str
        self.alphabet = byte_alphabet()
        self.ids: dict[bytes, bytes] = {}
        self.decoded: dict[bytes, bytes] = {}
        for text, i in self.special.items():
            self._keep(b" " + text, (i,))  # no chunk has a space, so these keys are free

    def _keep(self, chunk: bytes, ids: Iterable[int]) -> None:
        self.ids[chunk] = b"".join(i.to_bytes(4, "little") for i in ids)
        self.decoded[chunk] = "".join(f"{self.token[i]} " for i in ids).encode()

    def pieces(self, chunk: bytes) -> list[str]:
        """The words of a chunk in the byte alphabet, as the tokenizer's own steps give them."""
        if self._PLAIN(chunk):
            return self._PIECES.findall(chunk.decode().lower())
        text = self.normalize(chunk.decode("utf-8", "replace"))
        if text.isalpha():
            return ["".join(map(self.alphabet.__getitem__, text.encode()))]
        return [p for p, _ in self.split(text) if p]

    def chunks(self, body: bytes) -> list[bytes]:
        if b"<|" in body and self.cut:
            out = []
            for part in self.cut.split(body):
                out.extend([b" " + part] if part in self.special else part.split())
            return out
        return body.split()

    def learn(self, chunks: set[bytes]) -> None:
        """Encode the chunks that are not known yet."""
        shrink(self.ids)
        shrink(self.decoded)
        new = {c: self.pieces(c) for c in chunks if c not in self.ids}
        codes = self.bpe.encode({p for parts in new.values() for p in parts})
        for c, parts in new.items():
            self._keep(c, [i for p in parts for i in codes[p]])

    def run(self, bodies: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Per text: ids as little-endian unsigned 32-bit integers, and the decoded text."""
        own = [self.chunks(b) for b in bodies]
        self.learn(set().union(*own))
        ids, decoded = self.ids.__getitem__, self.decoded.__getitem__
        for chunks in own:
            yield b"".join(map(ids, chunks)), b"".join(map(decoded, chunks))[:-1]


_codecs: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    """The codec of a file; a worker keeps it."""
    if path not in _codecs:
        _codecs[path] = WordCodec(path)
    return _codecs[path]


def encode_decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts with a tokenizer file and decode the ids again.

    Returns id_col, ``ids`` (binary: little-endian unsigned 32-bit) and
    ``decoded`` (token texts joined by one space), one row per input row.

    Defined cases: a null or blank text gives no ids and an empty string; null
    ids stay null; repeated rows are kept; an empty table gives an empty
    result; other columns are not looked at. No shuffle: each row stays in its
    task, and a worker's cache of words is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for b in batches:
            for part in words.slices(b, "body", 4 << 20):
                done = list(own.run([x or b"" for x in part.column("body").to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array([i for i, _ in done], pa.binary()), pa.array([t for _, t in done], pa.binary())], names=["doc", "ids", "decoded"])

    out = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("body")).mapInArrow(words.tidy(run), "doc long, ids binary, decoded binary")
    return out.select(F.col("doc").alias(id_col), "ids", F.col("decoded").cast("string").alias("decoded"))


class _Loose(Exception):
    """A piece between spaces that is no chunk of its own."""


class _Chunks(dict):
    """Ids of the chunks met so far; a new one is encoded when it is asked for."""

    def __init__(self, codec: ByteCodec, lead: str) -> None:
        self.codec, self.lead = codec, lead

    def __missing__(self, chunk: bytes) -> bytes:
        if self.codec.loose(chunk) and self.lead:
            raise _Loose
        got = self[chunk] = self.codec.encode(chunk, self.lead)
        return got


class ByteCodec:
    """Ids of a byte-level tokenizer file, chunk by chunk from a cache.

    A chunk starts at a space that stands between two characters other than
    white space; the tokenizer's words never cross such a place.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.quick = self._ranks(path)
        self.head, self.tail = _Chunks(self, ""), _Chunks(self, " ")

    @staticmethod
    def _ranks(path: str):
        """An encoder by ranks, if the file's ids are in the order of its merges."""
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, merges = file["model"]["vocab"], file["model"]["merges"]
        joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
        if file["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or file["normalizer"] or any(vocab.get(t) != 256 + i for i, t in enumerate(joined)):
            return None
        byte = {c: b for b, c in byte_alphabet().items()}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items() if i < 256 + len(joined)}
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @staticmethod
    def loose(piece: bytes) -> bool:
        """Whether a piece between spaces is empty or has white space at an end."""
        if not piece:
            return True
        if 0x20 < piece[0] < 0x7F and 0x20 < piece[-1] < 0x7F:
            return False
        text = piece.decode("utf-8", "replace")
        return text[0].isspace() or text[-1].isspace() or text[0] == "\u180e" or text[-1] == "\u180e"

    def encode(self, chunk: bytes, lead: str = "") -> bytes:
        """Ids of a chunk. The rank library gives the same ids for Latin letters, and sooner."""
        text = lead + chunk.decode("utf-8", "replace")
        if self.quick and b"<|" not in chunk and (not chunk or max(chunk) < 0xCA):
            return array("I", self.quick(text)).tobytes()
        return array("I", self.own.encode(text, add_special_tokens=False).ids).tobytes()

    def _joined(self, pieces: list[bytes]) -> list[bytes]:
        """Chunks of pieces among which some are loose: those stay with their neighbours."""
        out, before = [], False
        for n, p in enumerate(pieces):
            now = self.loose(p)
            if n and (now or before):
                out[-1] += b" " + p
            else:
                out.append(p)
            before = now
        return out

    def run(self, bodies: list[bytes], most: int = 2 * CACHE) -> Iterator[bytes]:
        """Per text: ids as little-endian unsigned 32-bit integers. most: chunks that the cache keeps between texts."""
        for body in bodies:
            shrink(self.tail, most)
            if len(self.head) > most // 16:
                self.head.clear()
            pieces = body.split(b" ")
            try:
                if self.loose(pieces[0]) and len(pieces) > 1:
                    raise _Loose
                yield self.head[pieces[0]] + b"".join(map(self.tail.__getitem__, pieces[1:]))
            except _Loose:
                first, *rest = self._joined(pieces)
                yield self.head[first] + b"".join([self.tail[c] if c in self.tail or not self.loose(c) else self.encode(c, " ") for c in rest])


_byte_codecs: dict[str, ByteCodec] = {}


def byte_codec(path: str) -> ByteCodec:
    if path not in _byte_codecs:
        _byte_codecs[path] = ByteCodec(path)
    return _byte_codecs[path]
