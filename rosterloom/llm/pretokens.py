"""Texts cut into pre-tokens, with a bounded memory of what each pre-token encodes to.

The libraries disagree with each other, by Unicode version, on the class of rare characters.  A text that
holds only characters of ``SAFE`` is cut by the pattern with its classes spelled out; for any
other text, or one that holds the text of a special token, ``cut`` gives None and the text is
left to the library.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

from rosterloom.llm.common import by_value

by_value(__name__)

# Code points on whose class (letter, digit, space) all libraries agree, that NFC leaves alone and whose
# lower case is one letter below U+02B0: below U+0230 without U+001C-U+001F (space or not) and U+0130.
SAFE = "\\x00-\\x1b\\x20-\\u012f\\u0131-\\u022f"
REMEMBERED = 300_000  # pre-tokens in a generation; a worker remembers the current and the last one


class PreTokens:
    """``known`` maps pre-tokens to what ``encode_many`` gives for them.

    When it is full a new generation begins; pre-tokens of the last one that occur again move on to it.
    """

    def __init__(self, pattern: str, encode_many: Callable[[Iterable[str]], dict], specials: Iterable[str] = (), lower: bool = False, limit: int = REMEMBERED):
        import re

        self.known: dict = {}
        self.older: dict = {}
        self.find, self.encode_many, self.lower, self.limit = class_pattern(pattern).findall, encode_many, lower, limit
        self.odd, self.specials = re.compile(f"[^{SAFE}]").search, tuple(specials)

    def cut(self, texts: list[str]) -> list[list[str] | None]:
        """The pre-tokens of each text, all of them known afterwards; None for texts that cannot be cut here."""
        cuts = [None if self.odd(t) or any(s in t for s in self.specials) else self.find(t.lower() if self.lower else t) for t in texts]
        seen = set()
        for words in cuts:
            if words is not None:
                seen.update(words)
        new = seen.difference(self.known)
        if len(self.known) + len(new) > self.limit:
            self.older, self.known, new = self.known, {}, seen
        if self.older:
            again = new & self.older.keys()
            self.known.update({w: self.older[w] for w in again})
            new = new - again
        if new:
            self.known.update(self.encode_many(new))
        return cuts


def text_parts(texts: pa.Array, size: int = 1 << 21) -> Iterator[tuple[int, list[str]]]:
    """(start, texts) of runs of about ``size`` bytes, so that only one run at a time is made Python strings.

    A null is an empty text; a text above the size is a run of its own.
    """
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, side="right")))
        yield start, [t or "" for t in texts.slice(start, stop - start).to_pylist()]
        start = stop


def class_pattern(pattern: str) -> re.Pattern:
    r"""``pattern`` for the standard module, with \p{L}, \p{N} and \s spelled out for ``SAFE`` and the lower case of it."""
    import re

    import regex

    safe = [c for c in map(chr, range(0x2B0)) if c >= "\u0230" or re.match(f"[{SAFE}]", c)]
    spelled = {k: "".join(f"\\u{ord(c):04x}" for c in safe if regex.match(k, c)) for k in (r"\p{L}", r"\p{N}", r"\s")}
    not_space = f"[^{spelled[r'\s']}]"
    out = pattern.replace(r"(?!\S)", f"(?!{not_space})")
    for k, chars in spelled.items():
        # inside a class the characters stand bare, outside they make one
        out = re.sub(r"\[([^\]]*)\]", lambda m: "[" + m[1].replace(k, chars) + "]", out)
    for k, chars in spelled.items():
        out = out.replace(k, f"[{chars}]")
    return re.compile(out)


def bytes_of_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
