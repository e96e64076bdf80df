"""Byte-level BPE by pre-token: texts are cut as the tokenizers library cuts them, each distinct piece is encoded by the library once."""

from __future__ import annotations

import os

import numpy as np
import regex
from tokenizers import Tokenizer

from .common import kept

# A task has one core; the library's threads would only spread its memory over their arenas.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The public pre-tokenization pattern of byte-level BPE files with use_regex.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose Unicode class may depend on a library's version; a text that holds one is cut by the library itself.
UNSURE = regex.compile(r"[՘-῿⁰-₟ꓐ-꯿\U00010000-\U0010FFFF]")
#: Distinct stretches a worker remembers; beyond it they are set aside, and those set aside before are forgotten.
REMEMBERED = 800_000


class PreTokenizer:
    """Cuts texts into pre-tokens and encodes pre-tokens; made once in each Python worker."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        form = repr(self.library.pre_tokenizer)
        if "ByteLevel" not in form or "add_prefix_space=False" not in form or self.library.normalizer is not None:
            raise ValueError("a byte-level tokenizer without prefix space and normalizer is needed")
        self.find = regex.compile(PATTERN).findall
        special = sorted(self.library.get_added_tokens_decoder().items(), key=lambda x: -len(x[1].content))
        self.special = {t.content: i for i, t in special}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    @classmethod
    def at(cls, path: str) -> PreTokenizer:
        return kept(cls.__name__, path, make=lambda: cls(path))

    def sure(self, text: str) -> bool:
        return text.isascii() or UNSURE.search(text) is None

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens in order; added special tokens inside the text are pieces of their own, as the library has it.

        A text of unsure characters is cut by the library's own pre-tokenizer, which is slower, any other by its pattern.
        """
        if not text:
            return []
        find = self.find if self.sure(text) else self.by_library
        if self.special and any(s in text for s in self.special):
            out = []
            for i, part in enumerate(self.cut.split(text)):
                if i % 2:
                    out.append(part)
                elif part:
                    out += find(part)
            return out
        return find(text)

    def by_library(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]


class TextEncoder:
    """Encodes whole texts with the library, each distinct stretch between single spaces and newlines once while it is remembered.

    Byte-level pre-tokenization always cuts before a space or around a newline that stands between two characters other
    than white space. So a text's ids are those of its stretches, each with the space or newline before it. Where a
    stretch is empty or begins or ends with white space, the library takes the text as a whole.
    """

    def __init__(self, path: str):
        cut = PreTokenizer(path)
        self.library, self.special = cut.library, cut.special
        self.newline = self._ids("\n")
        self.marks = {c: self._ids(c).tobytes() for c in ".,;:!?" if not any(c in s for s in self.special)}
        self.known: dict[str, bytes | None] = {}  # a stretch after a space, or a newline and a stretch; None: not by itself
        self.before: dict[str, bytes | None] = {}

    @classmethod
    def at(cls, path: str) -> TextEncoder:
        return kept(cls.__name__, path, make=lambda: cls(path))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, parts: list[str]) -> None:
        known, before, marks, new, marked = self.known, self.before, self.marks, {}, []
        for p in dict.fromkeys(parts):
            if p in known:
                continue
            if p in before:
                known[p] = before[p]
                continue
            body = p[1:] if p[:1] == "\n" else p
            if not body or body.strip() != body:
                known[p] = None
            elif body[-1] in marks and len(body) > 1 and body[-2] < "\u0250" and body[-2].isalpha():
                own = p[:-1]  # pre-tokens of letters end before a mark
                marked.append((p, own))
                if own not in known and own not in new:
                    if own in before:
                        known[own] = before[own]
                    else:
                        new[own] = None
            else:
                new[p] = None
        new = list(new)
        for i in range(0, len(new), 4000):  # many stretches in one text, told apart by the id of the newlines between them
            part = new[i : i + 4000]
            text = "".join([p if p[0] == "\n" else "\n " + p for p in part])
            ids = self._ids(text)
            starts = np.flatnonzero(ids == self.newline[0])
            if len(self.newline) == 1 and len(starts) == len(part) and not any(s in text for s in self.special):
                raw, ends = ids.tobytes(), [*(starts[1:] * 4).tolist(), 4 * len(ids)]
                for p, a, b in zip(part, (starts * 4).tolist(), ends, strict=True):
                    known[p] = raw[a if p[0] == "\n" else a + 4 : b]
            else:
                known.update((p, self._ids(p if p[0] == "\n" else " " + p).tobytes()) for p in part)
        for p, own in marked:
            known[p] = known[own] + marks[p[-1]]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers, equal to the library's."""
        if not text:
            return b""
        parts = text.replace("\n", " \n").split(" ")
        parts[0] = "\n" + parts[0]
        known = self.known
        try:
            found = list(map(known.__getitem__, parts))
        except KeyError:
            self._learn(parts)
            found = list(map(known.__getitem__, parts))
            if len(known) > REMEMBERED:
                self.before, self.known = known, {}
        try:
            return b"".join(found)[4:]
        except TypeError:
            return self._ids(text).tobytes()
