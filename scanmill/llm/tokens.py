"""Token ids of whole texts by a public tokenizer file, encoded word by word with a bounded memory of words."""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections.abc import Iterable

import numpy as np

from .memory import remembered

DEFAULT_TOKENIZER = "word_bpe_49k.json"
#: splitting here never cuts a word of the tokenizer: its pattern has no white space inside a word
_CUT = re.compile("[ \t\n\r\f\v]+")
_UNSURE = re.compile("[\x1c-\x1f]")
#: words a worker remembers unless told otherwise, about 85 MB
_MEMORY = 400_000
#: pieces of words a worker remembers, about 30 MB
_PIECE_MEMORY = 200_000

# fixed values: how word_bpe_49k.json normalises and cuts texts
_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_CUTTER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}

#: words whose characters have one form only, so NFC leaves them alone and each lower-cases by itself
_PLAIN = re.compile("[!-~\xa1-\xac\xae-\xff]+").fullmatch
#: that cutter on such characters
_PIECES = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|"
    "[^\\sa-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+").findall


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Encodes texts as the tokenizer does, asking it once for each word while the word is remembered.

    Valid for tokenizers that drop white space and split at it first; the tests compare with whole texts.
    """

    def __init__(self, path: str, memory: int = _MEMORY):
        self.memory = memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        #: whether plain words may be cut here and handed to the tokenizer's model piece by piece
        self.cuts = rules["normalizer"] == _NORMALIZER and rules["pre_tokenizer"] == _CUTTER and rules["post_processor"] is None
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_chars = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xA1, 0x100)}
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}
        self.between_ids = self.tokenizer.encode("0", add_special_tokens=False).ids
        self.between = self.between_ids[0] if self.between_ids else -1

    def encode(self, texts: Iterable[str | None], end_id: int) -> list[bytes]:
        """Ids of each text and the end id, as little-endian bytes of :attr:`dtype`; a null text is empty."""
        collecting = gc.isenabled()
        gc.disable()  # what is made here has no cycles, and walks over so many small objects take as long as the work
        try:
            return self._encode(texts, np.array([end_id], dtype=self.dtype).tobytes())
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: Iterable[str | None], last: bytes) -> list[bytes]:
        cut = [(_CUT.split(t) if _UNSURE.search(t) else t.split()) if t else [] for t in texts]
        look = self.known.get
        parts = [list(map(look, words)) for words in cut]
        missing = {w for words, got in zip(cut, parts) if None in got for w, p in zip(words, got) if p is None}
        if missing:
            fresh = self._ask(missing)
            for words, got in zip(cut, parts):
                if None in got:
                    got[:] = [fresh[w] if p is None else p for w, p in zip(words, got)]
            # the words met first are the frequent ones: once the memory is full it stays as it is
            if len(self.known) < self.memory:
                self.known.update(fresh)
        return [b"".join(got) + last for got in parts]

    def _ask(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of each word. Plain words go to the tokenizer's model; others to the tokenizer, many at once, with a word between
        them that none of them holds."""
        out = self._cut([w for w in words if _PLAIN(w) and "<|" not in w]) if self.cuts else {}
        others = [w for w in words if w not in out and "0" not in w and "<|" not in w]
        for at in range(0, len(others), 256):
            part = others[at : at + 256]
            text = self.tokenizer.encode_batch_fast([" 0 ".join(part)], add_special_tokens=False)[0]
            ids = np.array(text.ids, dtype=self.dtype)
            ends = [*np.flatnonzero(ids == self.between).tolist(), len(ids)]
            if len(self.between_ids) != 1 or len(ends) != len(part):
                break
            start = 0
            for word, end in zip(part, ends):
                out[word] = ids[start:end].tobytes()
                start = end + 1
        rest = [w for w in words if w not in out]
        for got, word in zip(self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), rest):
            out[word] = np.array(got.ids, dtype=self.dtype).tobytes()
        return out

    def _cut(self, words: list[str]) -> dict[str, bytes]:
        """Ids of plain words: normalising and cutting them is most of the tokenizer's work, and simple on their characters."""
        model, chars, known, fresh = self.tokenizer.model.tokenize, self.byte_chars, self.pieces, {}
        code, out = "H" if self.dtype.itemsize == 2 else "I", {}
        for word in words:
            low, found = word.lower(), []
            for piece in [low] if low.isascii() and low.isalpha() else _PIECES(low):
                ids = known.get(piece) or fresh.get(piece)
                if ids is None:
                    ids = array(code, [t.id for t in model(piece if piece.isascii() else piece.translate(chars))]).tobytes()
                    fresh[piece] = ids
                found.append(ids)
            out[word] = found[0] if len(found) == 1 else b"".join(found)
        if len(known) < _PIECE_MEMORY:
            known.update(fresh)
        return out


def encoder(path: str, memory: int = _MEMORY) -> WordEncoder:
    """The worker's encoder for the file, which remembers as many words as any of its users asked for."""
    known = remembered("encoders")
    if path not in known:
        known[path] = WordEncoder(path, memory)
    known[path].memory = max(known[path].memory, memory)
    return known[path]
