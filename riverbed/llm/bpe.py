"""BPE encoding and decoding with forced boundaries.

A merge can only build a token of the vocabulary. So two neighbouring symbols that never stand side by side inside any token can
never end up in one token: the place between them is a certain cut, and the merges on its two sides do not influence each other.
Words are cut there, the fragments are encoded on their own (and remembered), and their ids are concatenated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_by_worker, pieces, table


#: A rank behind all others.
NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class ForcedBoundaryBPE:
    """Encoder and decoder for a tokenizers JSON file: a BPE model with byte symbols, a word-end suffix and a Split pattern.

    remember bounds the number of words, and of fragments, whose ids are kept.
    """

    def __init__(self, spec: dict, remember: int = 150_000):
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.rank = {pair: k for k, pair in reversed([*enumerate(merges)])}
        self.symbols = byte_symbols()
        self.bytes_of = {s: b for b, s in enumerate(self.symbols)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # neighbouring symbols that occur inside some token; a last symbol carries the suffix as the merges see it
        self.joined: set[tuple[str, str]] = set()
        for token in self.vocab:
            parts = self._split(token)
            self.joined.update(zip(parts, parts[1:], strict=False))
        self.pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # the same pattern for texts below U+0250, whose letters, digits and spaces are the same in every Unicode version
        low = [chr(c) for c in range(0x250)]
        classes = {r"\p{L}": "L", r"\p{N}": "N"}
        parts = self.pattern.split("|")  # a class of letters may stand before literals that begin with none
        plain = "|".join(sorted(parts, key=lambda p: p != r"[\p{L}]+")) if r"[\p{L}]+" in parts and not any(p[0].isalpha() for p in parts) else self.pattern
        for name, kind in classes.items():
            plain = plain.replace(name, "".join(re.escape(c) for c in low if unicodedata.category(c)[0] == kind))
        self.find_plain = re.compile(plain.replace(r"\s", re.escape("".join(c for c in low if c in "\t\n\x0b\x0c\r\x85" or unicodedata.category(c)[0] == "Z")))).findall
        self.other = re.compile("[^\x00-\u024f]").search
        self.spec, self._library = spec, None
        self.remember = remember
        self.words: dict[str, bytes] = {}
        self.fragments: dict[tuple[str, ...], list[int]] = {}

    def _split(self, token: str) -> list[str]:
        """A token's symbols: its characters, the last one together with the suffix."""
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            stem = token[: -len(self.suffix)]
            return [*stem[:-1], stem[-1] + self.suffix]
        return [*token]

    def encode_fragment(self, symbols: tuple[str, ...]) -> list[int]:
        """Repeated merging of the best-ranked pair, leftmost first, over one fragment."""
        parts, rank = [*symbols], self.rank.get
        ranks = [rank(pair, NEVER) for pair in zip(parts, parts[1:])]  # noqa: B905
        while ranks and (best := min(ranks)) != NEVER:
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank((parts[k - 1], parts[k]), NEVER)
            if k < len(ranks):
                ranks[k] = rank((parts[k], parts[k + 1]), NEVER)
        return [self.vocab[p] for p in parts if p in self.vocab]

    def cut(self, word: str) -> list[tuple[str, ...]]:
        """The word's symbols, cut wherever two neighbours stand together inside no token."""
        symbols = [*word] if word.isascii() and word.isprintable() else [self.symbols[b] for b in word.encode()]
        symbols[-1] += self.suffix
        if self.joined.issuperset(zip(symbols, symbols[1:])):  # noqa: B905
            return [tuple(symbols)]
        out, begin = [], 0
        for k in range(1, len(symbols)):
            if (symbols[k - 1], symbols[k]) not in self.joined:
                out.append(tuple(symbols[begin:k]))
                begin = k
        return [*out, tuple(symbols[begin:])]

    def encode_word(self, word: str) -> bytes:
        """Ids of one word as little-endian 32-bit integers."""
        ids: list[int] = []
        for part in self.cut(word):
            found = self.fragments.get(part)
            if found is None:
                found = self.encode_long(part) if len(part) > 64 else self.encode_fragment(part)
                if len(part) <= 64:
                    if len(self.fragments) >= self.remember:
                        self.fragments.clear()
                    self.fragments[part] = found
            ids += found
        packed = array("I", ids).tobytes()
        if len(word) <= 64:
            if len(self.words) >= self.remember:
                self.words.clear()
            self.words[word] = packed
        return packed

    def encode_long(self, symbols: tuple[str, ...]) -> list[int]:
        """As encode_fragment, with a heap, for fragments of any length in n log n steps."""
        n, rank = len(symbols), self.rank.get
        parts: list[str | None] = [*symbols]
        right, left = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, k, parts[k], parts[k + 1]) for k in range(n - 1) if (r := rank((symbols[k], symbols[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = right[k]
            if parts[k] != a or j < 0 or parts[j] != b:
                continue  # one of the two has been merged since
            parts[k], parts[j] = a + b, None
            right[k] = right[j]
            if right[k] >= 0:
                left[right[k]] = k
            for x, y in ((left[k], k), (k, right[k])):
                if x >= 0 and y >= 0 and (r := rank((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [self.vocab[p] for p in parts if p is not None and p in self.vocab]

    def pieces(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised."""
        if self.other(text) is None:
            return self.find_plain(text.lower())
        if self._library is None:  # rarer characters: the library's own tables decide what is composed, lower case or a letter
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(json.dumps(self.spec))
        normal = self._library.normalizer.normalize_str(text)
        return [bytes(map(self.bytes_of.__getitem__, w)).decode() for w, _ in self._library.pre_tokenizer.pre_tokenize_str(normal)]

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a whole text, packed as little-endian unsigned 32-bit integers."""
        parts = [text] if self.special_split is None or "<|" not in text else self.special_split.split(text)
        out: list[bytes] = []
        get, encode = self.words.get, self.encode_word
        for k, part in enumerate(parts):
            if k % 2:
                out.append(array("I", [self.special[part]]).tobytes())
            elif part:
                out += [get(w) or encode(w) for w in self.pieces(part)]
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return array("I", self.encode_bytes(text or "")).tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokens with a space between them: the file names no decoder, so the library joins tokens just so."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def load(path: str | None = None, remember: int = 150_000) -> ForcedBoundaryBPE:
    """path: a tokenizers JSON file; by default the public word-end vocabulary that is installed on the machine."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return ForcedBoundaryBPE(json.load(f), remember)


def of_worker(path: str | None) -> ForcedBoundaryBPE:
    """The encoder of this Python worker: the words that one task has learned serve the next one."""
    return kept_by_worker(f"bpe {path}", lambda: load(path))


def encode_documents(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), ids: bool = True, digests: bool = False, text: str = "text") -> DataFrame:
    """Encode every whole text; one row in, one row out, nothing shuffled.

    keep: columns to carry. Added: n_tokens; with ids, token_ids array<int>; with digests, ids_sha256 and decoded_sha256 of the ids
    and of the text decoded from them. Null text counts as empty: no ids, the digests of nothing. Repeated rows stay; an empty table
    gives an empty table; other columns, whatever their names, are left behind. One batch of Arrow rows is held at a time, and the words
    remembered are bounded, so memory is set by the longest text.
    """
    fields = [f for f in docs.schema.fields if f.name in keep]
    extra = "n_tokens long" + ", token_ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), extra])
    names = [f.name for f in fields]

    def run(batches):
        bpe = of_worker(path)
        token_bytes = {i: t.encode() for i, t in bpe.tokens.items()}
        for batch in (x for whole in batches for x in pieces(whole, len(names))):
            n, lists, a, b = [], [], [], []
            for t in batch.column(len(names)):
                packed = bpe.encode_bytes(t.as_py() or "")
                found = array("I", packed)
                n.append(len(found))
                if ids:
                    lists.append(packed)
                if digests:
                    a.append(hashlib.sha256(packed).hexdigest())
                    b.append(hashlib.sha256(b" ".join(map(token_bytes.__getitem__, found))).hexdigest())
            columns = [*batch.columns[:-1], pa.array(n, pa.int64())]
            if ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(np.frombuffer(b"".join(lists), np.int32))))
            columns += [pa.array(x, pa.string()) for x in (a, b) if digests]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_tokens", *["token_ids"] * ids, *["ids_sha256", "decoded_sha256"] * digests])

    return docs.select(*[F.col(f"`{n}`") for n in names], F.col(text).alias("__text")).mapInArrow(run, schema)


def op6_bpe_forced_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count and the digests of its ids and of the decoded text."""
    return encode_documents(table(spark, sf_dir, "documents"), ids=False, digests=True)
