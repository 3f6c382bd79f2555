"""Token ids as the tokenizers library gives them for a byte-level BPE file, from the same vocabulary in tiktoken.

tiktoken gives the same ids for ordinary text and is several times faster; a special token's string inside a text is one
id for tokenizers' default, so texts are cut at such strings first. tests/llm compares both libraries."""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np

#: The letters, numbers and white space below U+0250, and the pattern of the file written for them. Its alternatives start
#: with different characters, so their order is free; the contractions come after the frequent letters.
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
LATIN = re.compile(rf" ?[{_L}]+| ?[{_N}]+|'(?:[stmd]|re|ve|ll)| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
BEYOND_LATIN = re.compile("[^\x00-\u024f]")


class ByteBpe:
    def __init__(self, path: str) -> None:
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        to_byte = {c: b for b, c in byte_alphabet().items()}
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in self.special}
        self.pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.encoding = tiktoken.Encoding(path, pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        self.marks = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or "(?!)")  # the longest first
        self.path = path
        self.pieces = regex.compile(self.pattern)

    def parts(self, text: str) -> list[tuple[str, int | None]]:
        """The text in parts without special strings, each with the id of the special string after it (None at the end)."""
        out: list[tuple[str, int | None]] = []
        done = 0
        for m in self.marks.finditer(text):
            out.append((text[done : m.start()], self.special[m[0]]))
            done = m.end()
        return [*out, (text[done:], None)]

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def ids(self, text: str) -> np.ndarray:
        if not self.has_special(text):
            return self.encoding.encode_to_numpy(text, disallowed_special=())
        out: list[np.ndarray] = []
        for part, special in self.parts(text):
            out.append(self.encoding.encode_to_numpy(part, disallowed_special=()))
            if special is not None:
                out.append(np.array([special], dtype=np.uint32))
        return np.concatenate(out)

    @functools.cached_property
    def library(self):  # noqa: ANN201
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def pre_tokens(self, part: str) -> list[str]:
        """Pre-tokens of a part without special strings. Latin texts take the fastest expression; texts with characters that
        Python's Unicode tables do not know, which the libraries' tables may class differently, go to the library."""
        if not BEYOND_LATIN.search(part):
            return LATIN.findall(part)
        if not any(unicodedata.category(c) == "Cn" for c in set(part)):
            return self.pieces.findall(part)
        return [part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]

    def n_pieces(self, pre_token: str) -> int:
        return len(self.encoding.encode_ordinary(pre_token))


def byte_alphabet() -> dict[int, str]:
    """Byte-level BPE writes bytes as printable characters: those that are printable stand for themselves, the others
    follow from U+0100 in order."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    """One instance a process, that is, a Python worker."""
    return ByteBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
