"""Whole-text encoding with a tokenizer file, with a cache of white-space-delimited chunks.

The tokenizers split a text into pre-tokens before merging, and no pre-token reaches over the start of a
white-space run that follows other characters. So a text's ids are the ids of its chunks, one after another, and
each distinct chunk is encoded once. Chunks of plain letters, digits and signs go to the library's merge model
straight away; every other chunk goes through the library's full encoding.

The library takes the strings of a file's added tokens out of a text before all else, and each is one id: so does this.
With `special_as_text` they are ordinary text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import numpy as np

#: The white space of the tokenizers' patterns (Unicode White_Space).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LETTERS = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
SIGNS = r"""!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~"""

#: Characters of the chunks a worker remembers before it starts afresh: bounds its memory, never its results.
CACHE_CHARS = 4_000_000


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    spare = 256
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return table


class ChunkEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids as the tokenizer file does with add_special_tokens=False."""

    def __init__(self, path: str, cache: int = CACHE_CHARS, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.limit, self.cache, self.held = cache, {}, 0
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or (t["normalized"] and t["content"].lower() != t["content"]) for t in added):
            raise ValueError("no rule for added tokens that depend on the text around them")
        names = [t["content"] for t in added if not (special_as_text and t["special"])]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + ")") if names else None
        self.names, self.hint = {t["content"]: t["id"] for t in added}, "<|" if all(x.startswith("<|") for x in names) else ""
        kind = (spec["normalizer"] or {}).get("type"), (spec["pre_tokenizer"] or {}).get("type")
        shape = re.compile(r"[ \n]?[" + LETTERS + "0-9" + SIGNS + "]+")
        self.lower = kind[0] == "Sequence"
        if kind == ("Sequence", "Sequence"):  # lower case, white space dropped, one token a digit
            self.split, self.odd = None, re.compile(f"[^{LETTERS}0-9{SIGNS} \\n]").search
            self.parts = re.compile(f"[{LETTERS}]+|[0-9]|[{SIGNS}]+").findall
        elif kind == (None, "ByteLevel"):
            self.split = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
            self.odd = re.compile(f"[^{LETTERS}0-9{SIGNS} \\n]|[ \\n][ \\n]").search
            self.parts = re.compile(f"\\n| ?[{LETTERS}]+| ?[0-9]+| ?[{SIGNS}]+").findall
        else:
            raise ValueError(f"no chunk rule for a tokenizer of kind {kind}")
        self.simple = shape.fullmatch
        letters = byte_alphabet()
        spread = [" ", "\n", *map(chr, range(33, 127)), *map(chr, range(0xC0, 0x100))]
        self.spelling = {ord(c): "".join(letters[b] for b in c.encode()) for c in spread}
        self.merge = self.tokenizer.model.tokenize
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.wide = re.compile("[^\\x00-\\xff]").search

    def pieces(self, text: str) -> tuple[list[str], bool]:
        """Parts of a text that are encoded on their own, and whether each is one plain pre-token."""
        if self.split:
            if not self.odd(text) and text[-1] != " ":
                return self.parts(text), True
            return self.split(text), False
        if not self.wide(text):  # these letters have lower-case forms of one character each, whatever stands beside them
            text = text.lower()
            if not self.odd(text):
                return self.parts(text), True
        return text.replace("\n", " ").split(" "), False

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """ids of each whole text (null: empty), as bytes."""
        if self.held > self.limit:
            self.cache, self.held = {}, 0
        plain, mixed, split = set(), set(), []
        for t in texts:
            if t and self.special and self.hint in t and self.special.search(t):
                words = []
                for k, part in enumerate(self.special.split(t)):
                    if k % 2:
                        self.cache[part] = self.id_bytes[self.names[part]]
                        words.append(part)
                    elif part:
                        own, alone = self.pieces(part)
                        (plain if alone else mixed).update(own)
                        words += own
            else:
                words, alone = self.pieces(t) if t else ([], True)
                (plain if alone else mixed).update(words)
            split.append(words)
        cache, hard = self.cache, []
        id_bytes, merge, lower, spelling = self.id_bytes, self.merge, self.lower, self.spelling

        def ids_of(part: str) -> bytes:
            spelled = part.lower() if lower else part
            if part[0] <= " " or not part.isascii():
                spelled = spelled.translate(spelling)
            cache[part] = ids = b"".join([id_bytes[t.id] for t in merge(spelled)])
            return ids

        self.held += sum(map(len, plain.difference(cache))) + sum(map(len, mixed.difference(cache)))
        for w in plain.difference(cache):
            ids_of(w)
        for w in mixed.difference(cache):
            if self.simple(w):
                cache[w] = b"".join([cache.get(p) or ids_of(p) for p in self.parts(w)])
            else:
                hard.append(w)
        for at in range(0, len(hard), 5000):
            some = hard[at : at + 5000]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                cache[w] = np.array(e.ids, "<u4").tobytes()
        return [b"".join(map(cache.__getitem__, words)) for words in split]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker and file; a worker that runs several tasks keeps it."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
