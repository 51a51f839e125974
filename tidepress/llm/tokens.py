"""Token ids of whole texts by the tokenizers library, each word encoded once for as long as it is remembered."""

from __future__ import annotations

import json
import os
import re
from itertools import islice

import numpy as np

#: The set-up whose tokens never reach over a blank: with it a text's ids are those of its words, one after another.
_WORDS = (
    ["NFC", "Replace", "Lowercase"],
    "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
)
#: Texts of these bytes in Latin-1 are cut into letters, digits and runs of marks before a dictionary is asked: none of
#: them changes under NFC, each has one lower-case byte, and blanks and line ends are their only space.
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)
_EASY = _LETTERS + b" \n.,"
_KNOWN = _LETTERS + b" \n0123456789" + _MARKS
_LOWER = bytes(32 if c == 10 else c + 32 if 65 <= c <= 90 or 0xC0 <= c <= 0xDE and c != 0xD7 else c for c in range(256))
_CUT = re.compile(b"([0-9]|[" + re.escape(_MARKS) + b"]+)")


def _pieces(text: str) -> list[bytes] | None:
    """Lower-case letters, single digits and runs of marks of the text in order; None for a text of other characters."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    if raw.translate(None, _EASY):
        if raw.translate(None, _KNOWN) or b"<|" in raw:
            return None
        return _CUT.sub(rb" \1 ", raw.translate(_LOWER)).split(b" ")
    if b".." in raw or b",," in raw or b".," in raw or b",." in raw:
        return _CUT.sub(rb" \1 ", raw.translate(_LOWER)).split(b" ")
    return raw.translate(_LOWER).replace(b".", b" . ").replace(b",", b" , ").split(b" ")


class WordEncoder:
    """encode(texts) gives the ids that the library gives for each whole text, as numpy arrays of uint32.

    keep bounds the remembered pieces, and so the memory; beyond it the later half is forgotten and encoded anew. Common
    words are met early, so the half that stays is what is asked for most.
    """

    def __init__(self, path: str, keep: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        vocab = config["model"]["vocab"]
        self.kind = np.dtype("<u2") if max(vocab.values()) < 65536 else np.dtype("<u4")
        steps = [x["type"] for x in (config["normalizer"] or {}).get("normalizers", [])]
        first = ((config["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.by_word = (steps, first.get("pattern", {}).get("Regex")) == _WORDS and config["post_processor"] is None
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.keep, self.words, self.pieces = keep, {}, {b"": b""}

    def _learn_pieces(self, new: list[bytes]) -> None:
        """Each is one pre-token, so in the ids of all of them joined by blanks each ends at its end-of-word token."""
        known, size = self.pieces, self.kind.itemsize
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode("latin-1")], add_special_tokens=False)[0].ids, self.kind)
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * size
            assert len(cuts) == len(part), "a piece isn't one pre-token"
            raw, at = ids.tobytes(), 0
            for piece, cut in zip(part, cuts.tolist(), strict=True):
                known[piece] = raw[at:cut]
                at = cut

    def _by_words(self, text: str) -> bytes:
        """Any text: what stands between blanks is encoded by the library as it is."""
        words = text.replace("\n", " ").split(" ")
        if len(self.words) > self.keep // 8:
            self.words.clear()
        new = list(set(words).difference(self.words))
        for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.words[w] = np.array(e.ids, self.kind).tobytes()
        return b"".join(map(self.words.__getitem__, words))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if not self.by_word:
            found = self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
            return [np.array(e.ids, "<u4") for e in found]
        out: list[np.ndarray] = []
        for i in range(0, len(texts), 256):
            if len(self.pieces) > self.keep:
                self.pieces = dict(islice(self.pieces.items(), self.keep // 2)) | {b"": b""}
            get, found, gaps, new = self.pieces.get, [], [], set()
            for t in texts[i : i + 256]:
                split = _pieces(t or "")
                if split is None:
                    found.append([self._by_words(t or "")])
                    continue
                ids = list(map(get, split))
                if None in ids:  # filled once the new pieces of all these texts are learned together
                    holes = [(k, split[k]) for k, x in enumerate(ids) if x is None]
                    new.update(x for _, x in holes)
                    gaps.append((ids, holes))
                found.append(ids)
            if new:
                self._learn_pieces(list(new))
            for ids, holes in gaps:
                for k, x in holes:
                    ids[k] = self.pieces[x]
            out += [np.frombuffer(b"".join(x), self.kind).astype("<u4") for x in found]
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each file and Python worker: workers serve many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
