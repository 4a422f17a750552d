"""Token ids of whole texts by a ``tokenizers`` file, with a memo of words.

For a vocabulary that drops white space (its ids of a text are those of its words, joined), each
word is encoded by the library once a worker and looked up from then on; invented or natural text
repeats most of its words. Any other vocabulary goes through ``encode_batch`` text by text.
"""

from __future__ import annotations

import os
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words and pieces held by a worker; a full memo is emptied, which costs time only.
MEMO_WORDS, MEMO_PIECES = 700_000, 700_000
_LOADED: dict[str, "Encoder"] = {}


def _byte_letters() -> list[str]:
    """The printable letter for each byte that byte-level vocabularies use."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters, extra = [""] * 256, 256
    for byte in range(256):
        if byte in plain:
            letters[byte] = chr(byte)
        else:
            letters[byte] = chr(extra)
            extra += 1
    return letters


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Encoder:
    """``ids(text)`` as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            shape = json.load(f)
        self.by_word = self._drops_space(shape)
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.letters = _byte_letters()
        self.model = self.library.model

    @staticmethod
    def _drops_space(shape: dict) -> bool:
        normal = shape.get("normalizer") or {}
        steps = [x.get("type") for x in normal.get("normalizers", [])]
        before = (shape.get("pre_tokenizer") or {}).get("pretokenizers", [])
        split = before[0] if before else {}
        return bool(
            steps == ["NFC", "Replace", "Lowercase"]
            and normal["normalizers"][1] == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
            and split.get("type") == "Split"
            and split.get("behavior") == "Removed"
            and split.get("invert")
            and split["pattern"].get("Regex", "").endswith("[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")
            and [x.get("type") for x in before[1:]] == ["ByteLevel"]
            and not before[1].get("add_prefix_space")
            and not before[1].get("use_regex")
            and not shape.get("post_processor")
        )

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [_packed(e.ids) for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _piece(self, letters: str) -> bytes:
        """Ids of a run of lower-case Latin letters or of one punctuation mark."""
        got = self.pieces.get(letters)
        if got is None:
            if len(self.pieces) >= MEMO_PIECES:
                self.pieces.clear()
            mapped = letters if letters.isascii() else "".join([self.letters[b] for b in letters.encode()])
            got = self.pieces[letters] = _packed([t.id for t in self.model.tokenize(mapped)])
        return got

    def _learn(self, missing: set[bytes]) -> None:
        hard = []
        for word in missing:
            text = word.decode("utf-8", "surrogatepass")
            core = text.rstrip(".,")
            tail = text[len(core) :]
            # runs of letters below U+0250 that are in composed form: no rule of the vocabulary splits them
            plain = core.isalpha() and (core.isascii() or (max(core) < "ɐ" and "İ" not in core and unicodedata.is_normalized("NFC", core)))
            if plain and len(tail) < 2:
                ids = self.pieces.get(low := core.lower()) or self._piece(low)
                self.words[word] = ids + self._piece(tail) if tail else ids
            else:
                hard.append((word, text))
        for (word, _), ids in zip(hard, self._plain([text for _, text in hard]), strict=True):
            self.words[word] = ids

    def ids(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text; null counts as empty."""
        if not self.by_word:
            for text in texts:
                yield self._plain([text or ""])[0]
            return
        known = self.words
        for text in texts:
            if not text:
                yield b""
                continue
            words = text.encode("utf-8", "surrogatepass").split()
            try:
                yield b"".join([known[w] for w in words])
            except KeyError:
                missing = {w for w in words if w not in known}
                if len(known) + len(missing) > MEMO_WORDS:
                    known.clear()
                    missing = set(words)
                self._learn(missing)
                yield b"".join([known[w] for w in words])


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
