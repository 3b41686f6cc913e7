"""Pre-tokens of the public BPE vocabularies, and what they encode to.

A pre-token is a stretch of text whose merges do not depend on what stands around it. Texts of Latin
letters and common punctuation are split by a compiled pattern; any other text is split by the library's own
pre-tokenizer, so that both ways give the library's pre-tokens.
"""

import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property

# Parsed vocabularies and encoded pre-tokens are kept per worker; beyond this many the latter start anew.
CACHED_PRETOKENS = 500_000

# Characters whose classes the compiled patterns know: Latin letters with their blocks, dashes and quotes.
_KNOWN = [*range(0x250), *range(0x2010, 0x2028), 0x20AC]


def _char_class(starts: str) -> str:
    chosen = [c for c in _KNOWN if unicodedata.category(chr(c)).startswith(starts)]
    return "".join(f"\\u{c:04x}" for c in chosen)


_LETTERS, _NUMBERS = _char_class("L"), _char_class("N")
# The white space of Unicode among the known characters.
_SPACES = r"\t\n\x0b\x0c\r \x85\xa0"
_OTHER = re.compile(r"[^\x00-ɏ‐-‧€]")
# The split patterns of the two vocabularies.
_BYTE_SPLIT = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+"
    rf"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)
_WORD_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+"


class Pretokenizer:
    """Splits texts as a tokenizer file of the `tokenizers` library does, and encodes single pre-tokens.

    `pretokens(text)` gives strings; a special token that stands in the text is given as its id, as the
    library finds it by default.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None}))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_length = sorted(self.special, key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if by_length else None
        self.lower = spec["normalizer"] is not None
        self._split = re.compile(_WORD_SPLIT if self.lower else _BYTE_SPLIT).findall
        self._path = path
        self.model = spec["model"]

    @cached_property
    def _bare(self):
        """The library's tokenizer for single pre-tokens: nothing but the merges."""
        from tokenizers import Tokenizer

        with open(self._path, encoding="utf-8") as file:
            spec = json.load(file)
        alone = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        bare = spec | {"normalizer": None, "pre_tokenizer": alone, "added_tokens": [], "post_processor": None}
        return Tokenizer.from_str(json.dumps(bare | {"truncation": None, "padding": None}))

    def pretokens(self, text: str) -> Iterator[list[str] | int]:
        """Lists of pre-tokens, with the ids of special tokens between them."""
        for part in self._special.split(text) if self._special and "<|" in text else (text,):
            if part in self.special:
                yield self.special[part]
            elif part:
                yield self._plain(part)

    def _plain(self, text: str) -> list[str]:
        if not self.lower:
            if not _OTHER.search(text):
                return self._split(text)
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        # Among the known characters, lower case maps each character by itself.
        if not _OTHER.search(text) and (text.isascii() or unicodedata.is_normalized("NFC", text)):
            return self._split(text.lower())
        text = self.library.normalizer.normalize_str(text)
        if not _OTHER.search(text):
            return self._split(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def encode_pretokens(self, pretokens: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Each pre-token with the ids that the library gives it."""
        pretokens = list(pretokens)
        for start in range(0, len(pretokens), 4096):
            part = pretokens[start : start + 4096]
            for token, encoding in zip(part, self._bare.encode_batch(part, add_special_tokens=False), strict=True):
                yield token, encoding.ids
