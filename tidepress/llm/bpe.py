"""Byte-level BPE by backtracking over longest matches, and decoding by an offset table."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import bound_batches, documents

#: The byte-level split; no piece ends inside a run that starts with one blank, so such runs are encoded by themselves.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_PLAIN = regex.compile(r"( ?\p{L}+)([^\s\p{L}\p{N}']*)").fullmatch


def _byte_letters() -> dict[str, int]:
    """The printable letter of each byte in the vocabulary file."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class BacktrackingBpe:
    """encode(text) and decode(ids) as the tokenizers library does with a byte-level file.

    Tokens are kept by rank: bytes first, then merges in order of priority. The automaton gives the tokens that start
    at each byte; the encoder takes the longest whose pair with the token before it is one that merging could leave
    side by side, else a shorter one, else it steps back and never ends a token there again. Every position is given
    up at most once, so the work is linear in the text for tokens of bounded length.
    """

    def __init__(self, path: str, keep: int = 600_000):
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        steps = [config["pre_tokenizer"] or {}, *((config["pre_tokenizer"] or {}).get("pretokenizers") or [])]
        split = [x for x in steps if x.get("type") == "ByteLevel"]
        if config["normalizer"] or len(steps) > 1 or not split or split[0].get("add_prefix_space") or not split[0].get("use_regex", True) or config["model"]["type"] != "BPE":
            raise ValueError(f"{path}: only byte-level BPE with the plain split and no normalizer is encoded here")
        if any(t.get(k) for t in config["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path}: added tokens that take blanks or whole words only aren't handled")
        letters = _byte_letters()
        vocab: dict[str, int] = config["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in config["model"]["merges"]]
        names = [t for t in sorted(letters, key=letters.get)] + [a + b for a, b in merges]
        if len(set(names)) != len(names):
            raise ValueError("two merges make one token")
        rank = {t: i for i, t in enumerate(names)}
        self.id_of = [vocab[t] for t in names]
        self.raw = [bytes(letters[c] for c in t) for t in names]
        self.split = [(i, i) for i in range(256)] + [(rank[a], rank[b]) for a, b in merges]
        self.pairs = {p: 256 + i for i, p in enumerate(self.split[256:])}
        self.compatible: dict[tuple[int, int], bool] = {}
        # A token that merging never makes of its own bytes can't be in a result.
        whole = [True] * 256
        for i, (a, b) in enumerate(self.split[256:], 256):
            whole.append(whole[a] and whole[b] and self._side_by_side(a, b, i))
        self.automaton = ahocorasick.Automaton()
        by_text: dict[str, int] = {}
        for i, r in enumerate(self.raw):
            if whole[i]:
                by_text[r.decode("latin-1")] = i
                self.automaton.add_word(r.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.lengths = [len(r) for r in self.raw]
        self.shorter = [-1] * len(names)
        for t, i in by_text.items():
            for n in range(len(t) - 1, 0, -1):
                if t[:n] in by_text:
                    self.shorter[i] = by_text[t[:n]]
                    break
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        table = {vocab[t]: self.raw[i] for t, i in rank.items()} | {i: t.encode() for t, i in self.special.items()}
        size = max(table) + 1
        self.text_of = OffsetTable([table.get(i, b"") for i in range(size)])
        self.digits_of = [str(i) for i in range(size)]
        self.keep, self.words, self.stems = keep, {}, {}

    def _side_by_side(self, a: int, b: int, limit: int = 1 << 31) -> bool:
        """Whether merging leaves the end of a and the start of b unmerged: undoes merges from the last to the first."""
        while True:
            if self.pairs.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, self.split[a][1]
                if a == limit:
                    limit, b = b + 1, self.split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.split[b][0]
                if b + 1 == limit:
                    limit, a = a, self.split[a][1]
                    if a == limit:
                        return True

    def piece(self, raw: bytes) -> list[int]:
        """Ranks of the tokens of one piece of the split."""
        n, lengths, shorter, known = len(raw), self.lengths, self.shorter, self.compatible
        longest = [-1] * n
        for end, t in self.automaton.iter(raw.decode("latin-1")):
            start = end + 1 - lengths[t]
            if longest[start] < 0 or lengths[longest[start]] < lengths[t]:
                longest[start] = t
        allowed, found, at = bytearray(b"\1" * (n + 1)), [], 0
        token = longest[0] if n else -1
        while token >= 0:
            last = found[-1] if found else -1
            while True:
                end = at + lengths[token]
                if allowed[end]:
                    ok = True
                    if last >= 0:
                        pair = (last, token)
                        ok = known.get(pair)
                        if ok is None:
                            ok = known[pair] = self._side_by_side(last, token)
                    if ok:
                        found.append(token)
                        at = end
                        token = longest[end] if end < n else -1
                        break
                if shorter[token] >= 0:
                    token = shorter[token]
                else:
                    allowed[at] = 0
                    found.pop()
                    at -= lengths[last]
                    token = last
                    break
        return found

    def _stem(self, piece: str) -> bytes:
        got = self.stems.get(piece)
        if got is None:
            ranks = self.piece(piece.encode())
            got = self.stems[piece] = np.array([self.id_of[r] for r in ranks], "<u4").tobytes()
        return got

    def _run(self, run: str) -> bytes:
        if m := _PLAIN(run):
            return self._stem(m[1]) + (self._stem(m[2]) if m[2] else b"")
        return b"".join(self._stem(p) for p in _SPLIT.findall(run))

    def _learn(self, new: set[str]) -> None:
        if len(self.stems) > self.keep:
            self.stems = dict(islice(self.stems.items(), self.keep // 2))
        if len(self.compatible) > 1 << 20:
            self.compatible.clear()
        for w in new:
            first, *lines = w.split("\n") if "\n" in w else (w,)
            self.words[w] = self._run(" " + first) + b"".join(self._stem("\n") + self._run(x) for x in lines)

    def _plain_text(self, text: str) -> bytes:
        """Text without special tokens. Runs are cut before single blanks only where no other space is near."""
        words = text.split(" ")
        if "" in words[1:] or any(b in text for b in ("\n\n", " \n", "\n ")) or text[-1:].isspace() or _ODD_SPACE(text):
            return b"".join(self._stem(p) if len(p) < 64 else self._long(p) for p in _SPLIT.findall(text))
        head, *rest = words
        if len(self.words) > self.keep:  # common words are met early: the earlier half stays
            self.words = dict(islice(self.words.items(), self.keep // 2))
        ids = list(map(self.words.get, rest))
        if None in ids:
            self._learn({w for w, x in zip(rest, ids, strict=True) if x is None})
            ids = list(map(self.words.__getitem__, rest))
        start = head.split("\n")
        first = (self._run(start[0]) if start[0] else b"") + b"".join(self._stem("\n") + self._run(x) for x in start[1:])
        return first + b"".join(ids)

    def _long(self, piece: str) -> bytes:
        return np.array([self.id_of[r] for r in self.piece(piece.encode())], "<u4").tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        parts = self.special_split.split(text) if self.special_split and any(s in text for s in self.special) else [text]
        raw = [np.array([self.special[p]], "<u4").tobytes() if i % 2 else self._plain_text(p) for i, p in enumerate(parts) if p]
        return np.frombuffer(b"".join(raw), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return self.text_of.join(ids)[0].decode("utf-8", "replace")


#: Space other than blanks and line ends: such texts are split by the expression itself.
_ODD_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search


class OffsetTable:
    """Bytes of all entries end to end; entry i is at offsets[i] to offsets[i + 1]."""

    def __init__(self, entries: list[bytes]):
        self.offsets = np.concatenate([[0], np.cumsum([len(e) for e in entries])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(entries), np.uint8)

    def join(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Their bytes end to end, and where each one ends."""
        starts = self.offsets[ids]
        sizes = self.offsets[ids.astype(np.int64) + 1] - starts
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        index = np.arange(total) + np.repeat(starts - ends + sizes, sizes)
        return self.blob[index].tobytes(), ends


_MODELS: dict[str, BacktrackingBpe] = {}


def model(path: str) -> BacktrackingBpe:
    if path not in _MODELS:
        _MODELS[path] = BacktrackingBpe(path)
    return _MODELS[path]


def encode_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """doc_id, ids array<int>. Null text: no ids. Null or repeated doc_ids are rows like any others."""
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(tokenizer)
        for batch in batches:
            found = [bpe.encode(t).view("<i4") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(spark: SparkSession, encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text: the inverse of encode_documents (null text comes back as empty). Null ids: empty text."""
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(tokenizer)
        for batch in batches:
            texts = [bpe.decode(np.array(i or [], np.int64)) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encodes and decodes every text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256, same_text.

    Null and empty texts have no ids; null and repeated doc_ids are rows like any others; an empty table gives no rows.
    """
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(tokenizer)
        sha = hashlib.sha256
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                ids = bpe.encode(t)
                text = bpe.decode(ids)
                digits = ",".join(map(bpe.digits_of.__getitem__, ids.tolist()))
                rows.append((len(ids), sha(digits.encode()).hexdigest(), sha(text.encode()).hexdigest(), text == (t or "")))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_()]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "same_text"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds))], names)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same_text boolean"
    )


def op2_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(spark, documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
