"""Byte-pair encoding by speculation: greedy longest matches are proposed, checked pair by pair, and repaired where they fail.

Merges are applied in the order of their rank, and a token can only be merged after it was made. So a proposed sequence of
tokens is the encoding if each token encodes itself and no merge crosses a border between neighbours before both sides
are complete. Whether one does depends on the pair alone: on the parts along the border that the two tokens went through.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .textkernel import chunks, map_batches, utf8

END = "</w>"
# The pieces of text that are encoded one by one, and white space that is not part of any.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
# Code points (hexadecimal ranges) that the regex module takes for letters or digits and the tokenizers library for neither.
NEITHER = """
558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 a7f1-a7f1
ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11df1-11df1 16ea0-16eb8 16ebb-16ed3
16ff2-16ff3 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6
1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff
2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f 11de0-11de9 1246f-1246f 12475-1247f 12550-12686 16ff4-16ff6
"""
# First, last and lower case of the first, of capitals that Unicode got after version 15.1.
NEWER_CAPITALS = "1c89-1c89:1c8a a7cb-a7cb:264 a7cc-a7cc:a7cd a7ce-a7ce:a7cf a7d2-a7d2:a7d3 a7d4-a7d4:a7d5 a7da-a7da:a7db a7dc-a7dc:19b 10d50-10d65:10d70 16ea0-16eb8:16ebb"
_NEITHER = regex.compile("[" + "".join(f"{chr(int(a, 16))}-{chr(int(z, 16))}" for a, z in (x.split("-") for x in NEITHER.split())) + "]")
_LOWER = {int(a, 16) + k: int(b, 16) + k for x in NEWER_CAPITALS.split() for ends, b in [x.split(":")] for a, z in [ends.split("-")] for k in range(int(z, 16) - int(a, 16) + 1)}
_NEWER = regex.compile("[" + "".join(map(chr, _LOWER)) + "]")
#: Words that a worker remembers at most.
REMEMBERED = 300_000
_NEVER = np.iinfo(np.int32).max


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else the next code point from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Tables:
    """What encoding needs, built once on the driver from a tokenizer file and broadcast (its size is that of the vocabulary)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END:
            raise ValueError("a BPE vocabulary with word ends is needed")
        self.vocab: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {x["content"]: x["id"] for x in spec["added_tokens"]}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ids = np.array([(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        self.size = max(self.vocab.values(), default=0) + 1
        keys = ids[:, 0] * self.size + ids[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merge = {a * self.size + b: r for r, (a, b, _) in enumerate(ids.tolist())}  # a pair's rank
        self.made = ids[:, 2].tolist()  # and what it becomes
        # All beginnings of tokens, with the token that one is (-1 if none).
        self.begun = {}
        for name in self.vocab:
            stem = name.removesuffix(END)
            for k in range(1, len(stem) + 1):
                self.begun.setdefault(stem[:k], -1)
        self.begun |= self.vocab
        self.names = {v: k for k, v in (self.vocab | self.special).items()}
        made: dict[int, tuple[int, int, int]] = {}
        for r, (a, b, c) in enumerate(ids.tolist()):
            made.setdefault(c, (r, a, b))
        # For each token the parts along its right (0) and left (1) border, whole first, and the rank of the merge that uses each up.
        spines: tuple[list[list[int]], list[list[int]]] = ([], [])
        spent: tuple[list[list[int]], list[list[int]]] = ([], [])
        for t in range(self.size):
            for k in (0, 1):
                x, last, path, ranks = t, _NEVER, [], []
                while True:
                    path.append(x)
                    ranks.append(last)
                    if x not in made:
                        break
                    last = made[x][0]
                    x = made[x][2 - k]
                spines[k].append(path)
                spent[k].append(ranks)
        depth = max((len(p) for k in (0, 1) for p in spines[k]), default=1)
        self.spines = [np.array([p + [-1] * (depth - len(p)) for p in spines[k]], np.int64) for k in (0, 1)]
        self.spent = [np.array([p + [-1] * (depth - len(p)) for p in spent[k]], np.int64) for k in (0, 1)]
        self.depth = np.array([len(p) for p in spines[0]]), np.array([len(p) for p in spines[1]])
        self.sound = np.zeros(self.size, bool)  # tokens that their own text is encoded as
        for name, t in self.vocab.items():
            symbols = [*name[: -len(END)]] if name.endswith(END) and name != END else [*name]
            if name.endswith(END) and symbols:
                symbols[-1] += END
            self.sound[t] = all(s in self.vocab for s in symbols) and self.exact([self.vocab[s] for s in symbols]) == [t]

    def exact(self, ids: list[int]) -> list[int]:
        """Merge the pair of the least rank, the leftmost of equals, until none is left: a heap of pairs over a linked list of tokens."""
        get, size, n = self.merge.get, self.size, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k, (a, b) in enumerate(zip(ids, ids[1:])) if (r := get(a * size + b)) is not None]
        heapify(heap)
        while heap:
            rank, k = heappop(heap)
            j = after[k]
            if ids[k] < 0 or j >= n or get(ids[k] * size + ids[j]) != rank:
                continue  # one of the two has been merged since
            ids[k], ids[j] = self.made[rank], -1
            j = after[k] = after[j]
            if j < n:
                before[j] = k
                if (r := get(ids[k] * size + ids[j])) is not None:
                    heappush(heap, (r, k))
            i = before[k]
            if i >= 0 and (r := get(ids[i] * size + ids[k])) is not None:
                heappush(heap, (r, i))
        return [x for x in ids if x >= 0]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the texts of tokens a and b, side by side, are encoded as these two."""
        ok = np.ones(len(a), bool)
        for i in range(int(self.depth[0][a].max(initial=0))):
            for j in range(int(self.depth[1][b].max(initial=0))):
                x, y = self.spines[0][a, i], self.spines[1][b, j]
                key = x * self.size + y
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                rank = np.where((self.keys[at] == key) & (x >= 0) & (y >= 0), self.ranks[at], _NEVER)
                ok &= ~((rank < self.spent[0][a, i]) & (rank <= self.spent[1][b, j]) & (rank < _NEVER))
        return ok

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match of a word in stand-in letters; None if some part is in no token."""
        out, at, n, begun = [], 0, len(word), self.begun
        while at < n:
            token, end, stop = None, at, at + 1
            while stop < n and (found := begun.get(word[at:stop])) is not None:
                if found >= 0:
                    token, end = found, stop
                stop += 1
            if stop == n and (found := begun.get(word[at:] + END)) is not None:
                token, end = found, n
            if token is None:
                return None
            out.append(token)
            at = end
        return out

    def encode(self, words: list[str]) -> tuple[list[list[int]], int]:
        """Ids of each word in stand-in letters, and how many had to be merged exactly."""
        proposals = [self.propose(w) for w in words]
        good = np.array([p is not None and bool(self.sound[p].all()) for p in proposals], bool)
        index = [k for k in np.flatnonzero(good).tolist() if len(proposals[k]) > 1]
        if index:
            left = np.array([x for k in index for x in proposals[k][:-1]])
            right = np.array([x for k in index for x in proposals[k][1:]])
            owner = np.repeat(index, [len(proposals[k]) - 1 for k in index])
            pair, back = np.unique(left * self.size + right, return_inverse=True)
            bad = ~self.compatible(pair // self.size, pair % self.size)[back]
            good[owner[bad]] = False
        for k in np.flatnonzero(~good).tolist():
            letters = [*words[k]]
            letters[-1] += END
            proposals[k] = self.exact([self.vocab[x] for x in letters if x in self.vocab])
        return proposals, int((~good).sum())


def _in_latin_1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Coder:
    """Encodes texts with a memory of words, in one worker."""

    def __init__(self, tables: Tables):
        self.t = tables
        self.letters = _byte_letters()
        self.known: dict[str, tuple[bytes, str]] = {}
        self.special = regex.compile("|".join(map(regex.escape, sorted(tables.special, key=len, reverse=True)))) if tables.special else None
        self.repaired = 0

    def pieces(self, text: str) -> list[str]:
        """Words of the text in lower case; a special token is kept as it is, after a NUL."""
        if self.special is not None and "<|" in text:
            out, at = [], 0
            for m in self.special.finditer(text):
                out += self._plain(text[at : m.start()])
                out.append("\0" + m[0])
                at = m.end()
            return out + self._plain(text[at:])
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        # Lower case is taken character by character, so a sigma at a word's end is no special case.
        if text.isascii():
            return PIECES.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        if _in_latin_1(text):
            return PIECES.findall(text.lower())
        if _NEWER.search(text):
            text = text.translate(_LOWER)
        text = text.replace("Σ", "σ").lower()
        if _NEITHER.search(text):
            return [text[m.start() : m.end()] for m in PIECES.finditer(_NEITHER.sub("!", text))]
        return PIECES.findall(text)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = list(words)
        special = [w for w in new if w[0] == "\0" and w[1:] in self.t.special]
        new = [w for w in new if not (w[0] == "\0" and w[1:] in self.t.special)]
        for w in special:
            self.known[w] = self.t.special[w[1:]].to_bytes(4, "little"), w[1:]
        ids, repaired = self.t.encode(["".join(self.letters[x] for x in w.encode()) for w in new])
        self.repaired += repaired
        for w, x in zip(new, ids, strict=True):
            self.known[w] = np.array(x, "<u4").tobytes(), " ".join(self.t.names[k] for k in x)

    def code(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian 32-bit integers, and these decoded (token strings, spaces between)."""
        words = [self.pieces(x) for x in texts]
        self.learn(set().union(*words))
        known = self.known
        return [(b"".join([known[w][0] for w in ws]), " ".join([known[w][1] for w in ws])) for ws in words]


_coders: dict[str, Coder] = {}


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded text of each row of docs(doc_id, text); null texts are empty."""
    return _coded(docs, path, False)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of docs(doc_id, text, ...).

    Null texts are empty: no tokens, and the digests of nothing. Repeated rows, null ids and very long texts are rows like
    others; other columns are left out; without rows there are none.
    """
    return _coded(docs, path, True)


def _coded(docs: DataFrame, path: str, hashed: bool) -> DataFrame:
    with open(path, "rb") as f:
        name = hashlib.sha256(f.read()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(Tables(path))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" if hashed else f"doc_id {id_type}, ids array<int>, decoded string"

    def run(b):
        coder = _coders.get(name) or _coders.setdefault(name, Coder(shared.value))
        _, off = utf8(b.column(1))
        for i, j in chunks(off, 1 << 20):
            out = coder.code([x or "" for x in b.column(1).slice(i, j - i).to_pylist()])
            ids = b.column(0).slice(i, j - i)
            if hashed:
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(x) // 4 for x, _ in out], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x, _ in out]), pa.array([hashlib.sha256(x.encode()).hexdigest() for _, x in out])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([ids, pa.array([np.frombuffer(x, "<i4") for x, _ in out], pa.list_(pa.int32())), pa.array([x for _, x in out])], ["doc_id", "ids", "decoded"])

    return map_batches(docs.select("doc_id", "text"), run, schema)
