"""Token ids of whole texts, equal to those of a ``tokenizers`` file, with words remembered.

The tokenizer has to part words at white space, as word-level ones do. Texts that hold one of its
special strings are encoded as they are. Plain words (Latin letters, then punctuation) that are new
are parted here and their parts given to the model itself, which spares the steps before it; all
other new words go through the whole tokenizer.
"""

from __future__ import annotations

import re

from tokenizers import Tokenizer

_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([^\sA-Za-z0-9'<\x80-\U0010ffff]*)")


def _byte_letters() -> dict[int, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [byte for byte in range(256) if byte not in plain]
    return {byte: 256 + place for place, byte in enumerate(others)}


class _Words(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class WordIds:
    """Ids as bytes of unsigned 32-bit little-endian numbers; at most ``room`` words are remembered."""

    def __init__(self, file: str, room: int = 300_000):
        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        self.room = room
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.words = _Words(self._word)
        self.parts = _Words(self._part)
        self.plain = self._parts_agree()

    def _parts_agree(self) -> bool:
        """Whether parting plain words here gives what the tokenizer gives, tried on all kinds of them."""
        tried = ("The", "naïve,", "ÉTÉ.", "a|b", "|", "Über!?", "x", "étée...", "#*$%&", "Ÿ", "WORDS;", "__a")
        return all(self._plain(w) in (None, self._whole(w)) for w in tried if _PLAIN.fullmatch(w))

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _part(self, part: str) -> bytes:
        spelled = part.encode().decode("latin-1").translate(self.letters)
        return _packed([token.id for token in self.model.tokenize(spelled)])

    def _plain(self, word: str) -> bytes | None:
        found = _PLAIN.fullmatch(word)
        if found is None:
            return None
        letters, rest = found[1].lower(), found[2]
        return (self.parts[letters] if letters else b"") + (self.parts[rest] if rest else b"")

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        ids = self._plain(text) if self.plain else None
        return self._whole(text) if ids is None else ids

    def of(self, content: bytes) -> bytes:
        if any(string in content for string in self.special):
            return self._whole(content.decode("utf-8", "replace"))
        if len(self.words) > self.room:
            self.forget()
        return b"".join(map(self.words.__getitem__, content.split()))

    def forget(self) -> None:
        """Let go of all words. A task does so at its end: its encoder is of no use to the next one of the worker,
        which unpickles one of its own, and would lie about until Python looks for cycles."""
        self.words.clear()
        self.parts.clear()


def _packed(ids: list[int]) -> bytes:
    return b"".join([number.to_bytes(4, "little") for number in ids])
