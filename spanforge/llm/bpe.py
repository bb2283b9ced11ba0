"""BPE encoding and decoding by a pair occurrence index.

Every scan task splits its texts into words and encodes each distinct word once. The words of a block
lie in one array of linked symbols; an index maps each active merge rank to all positions of its pair in the
block. Ranks are applied in ascending order; each application updates the lists of the pairs that
appear beside the merged symbols. A merge makes a symbol of its own, so every pair that it can give rise to has a
higher rank, and one ascending pass equals the usual lowest-rank-first loop of each word.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import trim, trimmed

MEMO_WORDS = 150_000
BLOCK_CHARS = 2 << 20


def _latin() -> tuple[re.Pattern, re.Pattern, dict[int, str]]:
    """For texts of printable Latin-1 characters, spaces and line feeds, which NFC leaves alone: which they are, how they split into
    words (as the tokenizers file's pattern splits them) and their spelling in the byte alphabet."""
    chars = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))]
    kind = {c: unicodedata.category(c)[0] for c in chars}
    letters, digits, others = ("".join(re.escape(c) for c in chars if (kind[c] if kind[c] in "LN" else "-") == k) for k in "LN-")
    plain = re.compile(f"[{letters}{digits}{others} \n]*")
    split = re.compile(f"[{letters}]+|[{digits}]|'s|'t|'re|'ve|'m|'ll|'d|[{others}]+")
    odd = [b for b in range(256) if not (0x21 <= b < 0x7F or 0xA1 <= b < 0xAD or 0xAE <= b)]
    name = {b: chr(b) for b in range(256)} | {b: chr(256 + i) for i, b in enumerate(odd)}
    return plain, split, {ord(c): "".join(name[b] for b in c.encode()) for c in chars if c > "\x7f"}


LATIN, LATIN_WORDS, LATIN_BYTES = _latin()


class WordBPE:
    """A tokenizers file of kind BPE with word ends, read for encoding by a pair occurrence index."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.vocab: dict[str, int] = model["vocab"]
        made = [a + b for a, b in merges]
        if len(set(made)) != len(made):
            raise ValueError("two merges make one symbol: ascending ranks would not be exact")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tok = Tokenizer.from_file(path)
        self.normal, self.split = tok.normalizer, tok.pre_tokenizer
        self.names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        left = np.array([self.vocab[a] for a, _ in merges], np.int64)
        right = np.array([self.vocab[b] for _, b in merges], np.int64)
        self.left, self.right = left, right
        self.new = np.array([self.vocab[x] for x in made], np.int64)
        self.end = int(max(self.vocab.values())) + 1  # beside a word's first and last symbol; joins nothing
        self.width = self.end + 1
        keys = left * self.width + right
        self.order = np.argsort(keys)
        self.keys = np.append(keys[self.order], self.width**2)
        self.order = self.order.astype(np.uint16 if len(keys) <= 1 << 16 else np.int64)  # which numpy sorts by radix
        self.shown = pa.array([(" " + self.names.get(i, "")).encode() for i in range(max(self.names) + 1)], pa.binary())  # with a space before each symbol

    def ranked(self, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The positions whose pair some merge joins, and the pairs' ranks."""
        k = a * self.width + b
        i = np.searchsorted(self.keys, k)
        on = self.keys[i] == k
        return at[on], self.order[i[on]]

    def words_of(self, text: str) -> list[str | bytes | int]:
        """The words of a text: in Latin-1, or in the byte alphabet (as bytes, to tell them apart); special tokens as their ids."""
        if LATIN.fullmatch(text) and not any(s in text for s in self.special):
            return LATIN_WORDS.findall(text.lower())
        known: dict[str, list[str | bytes | int]] = {}
        out: list[str | bytes | int] = []
        for piece in text.replace("\n", " ").split(" "):
            if (own := known.get(piece)) is None:
                own = known[piece] = self._words_of(piece)
            out += own
        return out

    def _words_of(self, piece: str) -> list[str | bytes | int]:
        out: list[str | bytes | int] = []
        rest = piece
        while rest:
            at, name = min(((rest.find(s), s) for s in self.special if s in rest), default=(len(rest), ""), key=lambda x: (x[0], -len(x[1])))
            if plain := rest[:at]:
                if LATIN.fullmatch(plain):
                    out += LATIN_WORDS.findall(plain.lower())
                else:
                    out += [w.encode() for w, _ in self.split.pre_tokenize_str(self.normal.normalize_str(plain) if self.normal else plain)]
            if name:
                out.append(self.special[name])
            rest = rest[at + len(name) :]
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words after merging, and where each word's begin (one more entry at the end)."""
        vocab, suffix = self.vocab, self.suffix
        letters = "".join(words)
        code = np.frombuffer(letters.encode("utf-32-le"), "<u4")
        first, last = np.full((2, int(code.max()) + 1), -2, np.int64)
        for c in set(letters):
            first[ord(c)], last[ord(c)] = vocab.get(c, -2), vocab.get(c + suffix, -2)
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        ends = starts[1:] - 1
        tok = first[code]
        tok[ends] = last[code[ends]]
        n = len(tok)
        tok = np.append(tok, self.end)
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        nxt[ends], nxt[n], prv[starts[:-1]] = n, n, n
        for i in np.flatnonzero(tok == -2).tolist():  # symbols outside the vocabulary are dropped, as without an unknown token
            if prv[i] < n:
                nxt[prv[i]] = nxt[i]
            if nxt[i] < n:
                prv[nxt[i]] = prv[i]
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            """Index the pairs that begin at these positions under their ranks."""
            at, r = self.ranked(at, tok[at], tok[nxt[at]])
            if not len(r):
                return
            o = np.argsort(r, kind="stable")
            at, r = at[o], r[o]
            cut = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1).tolist()]
            for rank, i, j in zip(r[cut].tolist(), cut, [*cut[1:], len(r)], strict=True):
                if rank in index:
                    index[rank].append(at[i:j])
                else:
                    index[rank] = [at[i:j]]
                    heapq.heappush(heap, rank)

        note(np.flatnonzero(tok[:n] >= 0))
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)  # a position that is there twice is written twice
            a, b = self.left[rank], self.right[rank]
            at = at[tok[at] == a]
            gone = nxt[at]
            on = tok[gone] == b
            at, gone = at[on], gone[on]
            if not len(at):
                continue
            if a == b and len(at) > 1:  # runs of one symbol: from the left, without overlap
                at, taken, keep = np.sort(at), -1, []
                for p in at.tolist():
                    if p != taken:
                        keep.append(p)
                        taken = int(nxt[p])
                at = np.array(keep, np.int64)
                gone = nxt[at]
            follow = nxt[gone]
            tok[at], tok[gone] = self.new[rank], -1
            nxt[at], prv[follow] = follow, at
            near = np.concatenate([prv[at], at])
            near.sort()
            note(near[np.append(near[1:] != near[:-1], True)])
        alive = tok[:n] >= 0
        kept = np.concatenate([[0], np.cumsum(alive)])
        return tok[:n][alive], kept[starts]

    def encode_distinct(self, words: list[str | bytes], shown: bool) -> list[tuple[bytes, bytes]]:
        """The ids of each word (see words_of) as little-endian unsigned 32-bit integers and, if wanted, what they decode to, with a space before each symbol."""
        if not words:
            return []
        ids, at = self.encode_words([w.decode() if isinstance(w, bytes) else w if w.isascii() else w.translate(LATIN_BYTES) for w in words])

        def cut(raw: bytes, at: list[int]) -> list[bytes]:
            return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

        own = cut(ids.astype("<u4").tobytes(), (at * 4).tolist())
        if not shown or not len(ids):
            return [(x, b"") for x in own]
        _, offsets, raw = self.shown.take(pa.array(ids)).buffers()
        return list(zip(own, cut(raw.to_pybytes(), np.frombuffer(offsets, np.int32)[at].tolist()), strict=True))

    def decode(self, ids: bytes) -> str:
        """What the file's missing decoder gives: the symbols, joined by spaces."""
        return " ".join([self.names[i] for i in np.frombuffer(ids, "<u4").tolist()])


def encode_blocks(bpe: WordBPE, texts: Iterator[str | None], decoded: bool = False) -> Iterator[tuple[list[list[str | bytes | int]], dict]]:
    """Texts as words in blocks of bounded size (one text at least), with the ids of every word and, if wanted, what these decode to."""
    special = {i: (np.uint32(i).tobytes(), bpe.shown[i].as_py()) for i in bpe.special.values()}
    memo = dict(special)

    def done(block: list[list[str | bytes | int]]) -> None:
        new = set().union(*block).difference(memo)
        if len(memo) + len(new) > MEMO_WORDS:
            memo.clear()
            memo.update(special)
            new = set().union(*block).difference(memo)
        words = list(new)
        memo.update(zip(words, bpe.encode_distinct(words, decoded), strict=True))

    block, size = [], 0
    for text in texts:
        block.append(bpe.words_of(text or ""))
        size += len(text or "")
        if size >= BLOCK_CHARS:
            done(block)
            yield block, memo
            block, size = [], 0
            trim()
    if block:
        done(block)
        yield block, memo


def _encoder(path: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBPE(path)
        keys: list = []

        def texts():
            for b in batches:
                for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    keys.append(key)
                    yield text.as_py()

        for block, memo in encode_blocks(bpe, texts(), decoded):
            n, hashed, shas = [], [], []
            for words in block:
                own = list(map(memo.__getitem__, words))
                ids = b"".join([x for x, _ in own])
                n.append(len(ids) // 4)
                if decoded:
                    hashed.append(hashlib.sha256(ids).hexdigest())
                    shas.append(hashlib.sha256(b"".join([x for _, x in own])[1:]).hexdigest())
                else:
                    hashed.append(np.frombuffer(ids, "<u4").astype(np.int32))
            own = keys[: len(block)]
            del keys[: len(block)]
            cols = [pa.array(own, pa.int64()), pa.array(n, pa.int64())]
            if decoded:
                yield pa.RecordBatch.from_arrays([*cols, pa.array(hashed, pa.string()), pa.array(shas, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([*cols, pa.array(hashed, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids"])

    return trimmed(run)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (array of int) of each row's whole text; no special tokens are added.

    A null or empty text has no ids. Rows stay rows: repeated doc_ids are encoded each. Other columns are left
    out. Memory is bounded by a block of texts (2 Mi characters, or one text) and a memo of 150,000 words.
    """
    return docs.select("doc_id", "text").mapInArrow(_encoder(path or vocabulary(), False), "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows that hold ids; null ids decode to ''."""
    where = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBPE(where)
        for b in batches:
            texts = [bpe.decode(np.array(ids or [], "<u4").tobytes()) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, without moving the ids out of their task."""
    return docs.select("doc_id", "text").mapInArrow(_encoder(path or vocabulary(), True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe_encoding_and_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
