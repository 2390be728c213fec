"""A bounded memory of the pieces of text that a tokenizer encodes apart from each other."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import regex

#: Characters whose classes agree between the tokenizers library and the regex module:
#: ASCII but for the separators 0x1C to 0x1F, and Latin letters and signs up to U+024F.
PLAIN = regex.compile(r"[\n\t\r\x20-\x7e¡-ɏ]*")


#: Bytes that are in no ``PLAIN`` text: controls, and what begins a character beyond U+024F.
_ODD = np.zeros(256, bool)
_ODD[[*range(9), 11, 12, *range(14, 32), 127, *range(0xCA, 256)]] = True


def plain_bytes(data: np.ndarray) -> bool:
    """Whether UTF-8 bytes, of many texts at once, have ``PLAIN`` characters only; False may err."""
    if _ODD[data].any():
        return False
    at = np.flatnonzero((data[:-1] == 0xC2) | (data[:-1] == 0xC9))
    lead, second = data[at], data[at + 1]
    return not ((lead == 0xC2) & (second <= 0xA0) | (lead == 0xC9) & (second > 0x8F)).any()


class Memory(dict):
    """What each piece encodes to. ``fill`` encodes new pieces together; emptied when it gets large."""

    def __init__(self, fill: Callable[[list[str]], list], most: int = 300_000):
        super().__init__()
        self.fill, self.most = fill, most

    def learn(self, pieces: set[str]) -> None:
        """All of these are known afterwards, even if there are more of them than are kept."""
        new = [x for x in pieces if x not in self]
        if not new:
            return
        if len(self) + len(new) > self.most:
            self.clear()
            new = list(pieces)
        self.update(zip(new, self.fill(new)))


class Lazy(dict):
    """What each piece encodes to, found out when it is first asked for; ``trim`` keeps it bounded."""

    def __init__(self, find: Callable[[str], bytes], most: int):
        super().__init__()
        self.find, self.most = find, most

    def __missing__(self, piece: str) -> bytes:
        out = self[piece] = self.find(piece)
        return out

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()
