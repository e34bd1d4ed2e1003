"""BPE encoding and decoding: speculate and verify.

Words are encoded once per worker and kept in a bounded cache.  For the words of a batch that are new, greedy
longest match proposes tokens; a proposal is the BPE encoding of its word exactly if each adjacent pair of
tokens is compatible, i.e. if merging the pair's own text gives the pair back.  (A merge that crosses a
boundary first would cross it in the pair's text too, as merges inside a token don't depend on its
neighbours.)  Pair verdicts are memoised; the pairs of all new words are tested at once by a sorted-array
lookup, and only words with a failing pair are merged exactly.

The vocabulary file (tokenizers JSON: NFC, white space, lower case; split by a fixed pattern; byte level; word
ends) is read on the driver from a path parameter and broadcast: its size doesn't depend on the data.

Defined results: a null or empty text has no tokens and decodes to the empty string; each input row has one
output row; further input columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import KEPT, mapped, ship, slices, texts

END = "</w>"
#: Words, and pair verdicts, that a worker keeps at most, and about the bytes of its words.
CACHE, CACHE_BYTES = 500_000, 96 << 20
NEVER = 1 << 30
# White space, and the contractions that the vocabulary's splitting pattern names.
SPACE = r"\t-\r \x85\xa0  -     　"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_ASCII = re.compile(rf"{CONTRACTIONS}|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_FULL = regex.compile(rf"{CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")


# The only normaliser, splitting and model that this module encodes for, as files state them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTING = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
FLAGS = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": END, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def check_format(spec: dict) -> None:
    """Raises ValueError for a file that asks for anything else than this module does."""
    flags = {k: v for k, v in spec["model"].items() if k not in ("vocab", "merges")}
    for name, found, known in (("normalizer", spec.get("normalizer"), NORMALIZER), ("pre_tokenizer", spec.get("pre_tokenizer"), SPLITTING), ("model", flags, FLAGS)):
        if found != known:
            raise ValueError(f"the vocabulary file has another {name}")
    if spec.get("post_processor") or spec.get("decoder") or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("the vocabulary file has a post-processor, a decoder or added tokens of another kind")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A tokenizer from the JSON text of a vocabulary file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        check_format(spec)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.splits = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # each prefix of a token: the token's id, or -1 where it is a prefix alone
        self.prefixes = {t[:i]: -1 for t in self.vocab for i in range(1, len(t))} | self.vocab
        self.chars = byte_chars()
        self.words: dict[str, bytes] = {}
        self.held = 0  # bytes of the words and their ids, about
        self.pair_keys = np.empty(0, dtype=np.uint64)
        self.pair_ok = np.empty(0, dtype=bool)

    def split(self, text: str) -> list[str]:
        """Normalised words of a text without special tokens."""
        if text.isascii():
            return _ASCII.findall(text.lower())
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return _FULL.findall(text.replace("Σ", "σ").lower())

    def symbols(self, word: str) -> list[str]:
        out = [self.chars[b] for b in word.encode()]
        out[-1] += END
        return out

    def merged(self, symbols: list[str]) -> list[str]:
        """Exact merging, lowest rank first and leftmost of equals; long words with a heap over a linked list."""
        sym, n = list(symbols), len(symbols)
        if n <= 48:
            get = self.ranks.get
            ranks = [get(p, NEVER) for p in zip(sym, sym[1:], strict=False)]
            while ranks and (r := min(ranks)) != NEVER:
                i = ranks.index(r)
                sym[i] += sym.pop(i + 1)
                del ranks[i]
                if i < len(ranks):
                    ranks[i] = get((sym[i], sym[i + 1]), NEVER)
                if i:
                    ranks[i - 1] = get((sym[i - 1], sym[i]), NEVER)
            return sym
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := self.ranks.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = a + b, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := self.ranks.get((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, (r, i, sym[i], sym[k]))
            if (h := before[i]) >= 0 and (r := self.ranks.get((sym[h], sym[i]))) is not None:
                heapq.heappush(heap, (r, h, sym[h], sym[i]))
        return [s for s in sym if s]

    def greedy(self, symbols: list[str]) -> list[int]:
        """Longest-match proposal for a word's symbols; the last token carries the word end."""
        whole, get, out, at = "".join(symbols), self.prefixes.get, [], 0
        total = len(whole)
        n = total - len(END)
        while at < n:
            best, stop, end = -1, at, at + 1
            while end <= total and (t := get(whole[at:end])) is not None:
                if t >= 0 and (end <= n or end == total):
                    best, stop = t, end
                end += 1
            if stop == n:  # a word end needs its own token: give the last character back to it
                last = get(whole[n - 1 :])
                if stop - at > 1:
                    best = next(t for e in range(n - 1, at, -1) if (t := get(whole[at:e], -1)) >= 0 and (stop := e))
                else:
                    best, stop = last, total
            out.append(best)
            at = stop
        return out

    def pair_verdict(self, a: int, b: int) -> bool:
        left, right = self.tokens[a], self.tokens[b]
        tail = right.endswith(END)
        sym = [*left, *(right[: -len(END)] if tail else right)]
        if tail:
            sym[-1] += END
        return self.merged(sym) == [left, right]

    def verdicts(self, keys: np.ndarray) -> np.ndarray:
        """Compatibility of pairs (a << 32 | b), new ones computed and kept."""
        distinct = np.unique(keys)
        at = np.searchsorted(self.pair_keys, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        inside = at < len(self.pair_keys)
        known[inside] = self.pair_keys[at[inside]] == distinct[inside]
        fresh = distinct[~known]
        if len(fresh):
            if len(self.pair_keys) + len(fresh) > 4 * CACHE:
                self.pair_keys, self.pair_ok, fresh = self.pair_keys[:0], self.pair_ok[:0], distinct
            ok = np.fromiter((self.pair_verdict(int(k) >> 32, int(k) & 0xFFFFFFFF) for k in fresh), dtype=bool, count=len(fresh))
            merged = np.concatenate([self.pair_keys, fresh])
            order = np.argsort(merged, kind="stable")
            self.pair_keys, self.pair_ok = merged[order], np.concatenate([self.pair_ok, ok])[order]
        return self.pair_ok[np.searchsorted(self.pair_keys, keys)]

    def learn(self, words: list[str]) -> int:
        """Encode new words into the cache; returns how many had to be merged exactly."""
        symbols = [self.symbols(w) for w in words]
        proposals = [self.greedy(s) for s in symbols]
        lengths = np.fromiter(map(len, proposals), dtype=np.int64, count=len(words))
        flat = np.fromiter((t for p in proposals for t in p), dtype=np.uint64, count=int(lengths.sum()))
        ends = np.cumsum(lengths)
        good = np.ones(len(flat), dtype=bool)  # good[i]: tokens i and i+1 fit; a word's last is free
        inner = np.ones(len(flat), dtype=bool)
        inner[ends - 1] = False
        if inner.any():
            i = np.nonzero(inner)[0]
            good[i] = self.verdicts((flat[i] << np.uint64(32)) | flat[i + 1])
        fits = np.logical_and.reduceat(good, ends - lengths)
        ids, n_exact = flat.astype("<u4"), 0
        for w, s, fit, end, n in zip(words, symbols, fits.tolist(), ends.tolist(), lengths.tolist(), strict=True):
            if fit:
                self.words[w] = ids[end - n : end].tobytes()
            else:
                n_exact += 1
                self.words[w] = np.array([self.vocab[t] for t in self.merged(s)], dtype="<u4").tobytes()
        self.held += sum(map(len, words)) + 4 * len(flat) + 150 * len(words)
        return n_exact

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        parts: list[list] = []  # per text: its words, with the ids of special tokens as they stand
        new: set[str] = set()
        cache = self.words
        for text in batch:
            if self.splits and "<|" in text and self.splits.search(text):
                pieces = self.splits.split(text)
                words = [self.split(x) if i % 2 == 0 else self.special[x] for i, x in enumerate(pieces)]
                for w in words[::2]:
                    new.update(set(w).difference(cache))
                parts.append(words)
                continue
            words = self.split(text)
            new.update(set(words).difference(cache))
            parts.append(words)
        if len(cache) + len(new) > CACHE or self.held > CACHE_BYTES:
            cache.clear()
            self.held = 0
            for words in parts:
                for w in words:
                    new.update([w] if isinstance(w, str) else w if isinstance(w, list) else [])
        if new:
            self.learn(list(new))
        ids = cache.__getitem__

        def put(words: list) -> bytes:
            if words and not isinstance(words[0], str):
                return b"".join(b"".join(map(ids, w)) if isinstance(w, list) else np.array([w], dtype="<u4").tobytes() for w in words)
            return b"".join(map(ids, words))

        return [put(words) for words in parts]

    def decode(self, ids: bytes) -> str:
        """Tokens joined by blanks, as a tokenizer without a decoder gives them."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def plain(self, ids: bytes) -> str:
        """Readable text: bytes put together, word ends as blanks."""
        back = {c: b for b, c in enumerate(self.chars)}
        out = bytearray()
        for i in np.frombuffer(ids, dtype="<u4").tolist():
            token = self.tokens[i]
            if token in self.special:
                out += token.encode()
                continue
            out += bytes(back[c] for c in token.removesuffix(END))
            if token.endswith(END):
                out += b" "
        return out.decode(errors="replace")


_MODELS: dict[int, WordBpe] = {}


def model_of(text: str) -> WordBpe:
    """The worker's tokenizer for a vocabulary, kept until a task of another operator comes."""
    key = hash(text)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = WordBpe(text)
    KEPT["bpe"] = _MODELS.clear
    return _MODELS[key]


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids (binary: little-endian unsigned 32-bit ids), decoded (string, from the ids)."""
    spark = docs.sparkSession
    ship(spark)
    with open(path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model_of(vocabulary.value)
        for whole in batches:
            for batch in slices(whole, 1):
                ids = bpe.encode_batch(texts(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], names=["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.transform(mapped, run, "id long, ids binary, decoded string", "bpe").withColumnRenamed("id", id_col)


def op6_bpe(docs: DataFrame, path: str) -> DataFrame:
    return bpe_encode(docs, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
