"""Token ids of texts with the ``tokenizers`` library, and their end id.

The vocabulary's model works on one pre-token (a run of letters, one digit, a run of
marks) at a time, and pre-tokens repeat far more often than texts do.  Each task keeps
the model's ids of the pre-tokens it has seen (bounded) and asks the model for new ones.
Texts with anything that the normaliser might treat specially (control and uncommon
characters, special-token marks) go through the library's whole ``encode_batch``, and so
does every text if the vocabulary file names other steps than the ones known here.
"""

from __future__ import annotations

import json
import re

import numpy as np
import regex

END_ID = 1
# Fixed value: the pre-token pattern of the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKEN = regex.compile(PATTERN)
# The steps before the model that this module takes over from the library.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
# Entries that one task keeps (about 200 bytes each) before it starts afresh.
KEPT = 400_000
# Longer pre-tokens are encoded each time they occur.
KEPT_LENGTH = 48
_UNCOMMON = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0\xad\u0130\u0250-\U0010ffff]|<\\|")
_LOADED: dict[str, "TextEncoder"] = {}


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others
    for code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(rest)}


BYTE_LETTERS = byte_letters()


def known_steps(library) -> bool:
    """Whether a tokenizer's normaliser, pre-tokens, model and special tokens are those known here.
    Only these parts are looked at; the vocabulary itself is large."""
    parts = [None if part is None else json.loads(part.__getstate__()) for part in (library.normalizer, library.pre_tokenizer)]
    return (parts == [NORMALIZER, PRE_TOKENIZER] and type(library.model).__name__ == "BPE"
            and all(t.content.startswith("<|") for t in library.get_added_tokens_decoder().values()))


class TextEncoder:
    """``encode(texts)`` gives one little-endian uint32 byte string per text (no end id)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.known = known_steps(self.library)
        self.kept: dict[str, bytes] = {}  # ids of white-space pieces and of pre-tokens
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]

    def whole(self, texts: list[str]) -> list[bytes]:
        """The library's own way, text by text."""
        out = []
        for i in range(0, len(texts), 512):
            out += [np.array(e.ids, "<u4").tobytes()
                    for e in self.library.encode_batch_fast(texts[i:i + 512], add_special_tokens=False)]
        return out

    def forget(self) -> None:
        """At the end of a task: workers go on with other work."""
        self.kept = {}

    def token_ids(self, token: str) -> bytes:
        """Ids of one pre-token."""
        ids = self.kept.get(token)
        if ids is None:
            letters = token if token.isascii() else token.encode().decode("latin-1").translate(BYTE_LETTERS)
            ids = b"".join([self.id_bytes[t.id] for t in self.model.tokenize(letters)])
            if len(token) <= KEPT_LENGTH:
                self.kept[token] = ids
        return ids

    def piece_ids(self, piece: str) -> bytes:
        """Ids of one piece between white space."""
        if piece.isalpha():
            return self.token_ids(piece)
        ids = b"".join([self.token_ids(t) for t in PRE_TOKEN.findall(piece)])
        if len(piece) <= KEPT_LENGTH:
            self.kept[piece] = ids
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.known:
            return self.whole([t or "" for t in texts])
        out = []
        for text in texts:
            if not text:
                out.append(b"")
            elif _UNCOMMON.search(text):
                out += self.whole([text])
            else:
                if len(self.kept) > KEPT:
                    self.kept = {}
                split = text.lower().split()
                found = list(map(self.kept.get, split))
                try:
                    out.append(b"".join(found))
                except TypeError:  # some are new
                    out.append(b"".join([self.piece_ids(p) if x is None else x for p, x in zip(split, found)]))
        return out


def encoder(path: str) -> TextEncoder:
    """The encoder of a vocabulary file, one per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = TextEncoder(path)
    return _LOADED[path]


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def text_batches(texts: list, most: int = 1 << 22):
    """Index ranges of about ``most`` characters."""
    i, n = 0, len(texts)
    while i < n:
        j, size = i, 0
        while j < n and (j == i or size < most):
            size += len(texts[j] or "")
            j += 1
        yield i, j
        i = j
