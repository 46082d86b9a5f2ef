"""The lattice of vocabulary pieces over a batch of chunks, found with a suffix array.

A chunk is a run of spaces and the characters up to the next space or line end; no piece of the vocabularies read here
reaches over the start of such a chunk, so a text's best path, or the sum over its paths, is that of its chunks.

The chunks are laid end to end with a separator between them. All positions are sorted by the text that follows, to
the depth of the longest piece: a suffix array. Each piece is binary-searched for the range of suffixes that begin
with it; each suffix in the range is an edge of the lattice. The edges are sorted by position and relaxed in that
order: to the best admissible path, or by logaddexp to the sum over all.

Scores: the file gives each piece a score, which is minus the rank of its merge. An encoder of this kind merges the
neighbours of best score first, and that makes some neighbours impossible: two pieces can stand side by side only if the
merges inside them come before every merge across their border (MergeOrder). Every beginning of a text has one path
of such pairs, so an edge is relaxed only from a node whose last piece it can follow. The path found is the library's
encoding; a path by the plain sum of these scores is not (53 % of words alike), as ranks are no log probabilities.

Probabilities, for sums over all paths: by the law of Zipf and Mandelbrot rank r has the weight 1 / (r + shift). A character
that no piece spells is an edge of its UTF-8 bytes, as many tokens as bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

SPACE = "▁"
#: No character has this code point.
SEPARATOR = 0xFFFFFFFF
#: Characters of the chunks matched at once, which bounds the arrays of one suffix array.
MATCHED_CHARS = 400_000
#: A chunk longer than this is relaxed edge by edge instead of offset by offset; the results are the same.
LONG = 200

_chunk = re.compile("\n| *[^ \n]+| +")


def chunks_of(text: str) -> list[str]:
    """The chunks of a text; the marker character is a space to the library too."""
    return _chunk.findall(text.replace(SPACE, " ") if SPACE in text else text)


class Pieces:
    """Pieces of a SentencePiece file, with unigram scores."""

    def __init__(self, model_file: str, zipf_shift: float = 100.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = np.zeros(256, np.int64)
        plain = []
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[int(self.names[i][3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain.append(i)
        self.size, self.ids = n, np.array(plain, np.int64)
        self.texts = [self.names[i] for i in plain]
        self.given = np.array([sp.get_score(i) for i in plain])
        last = float(min((x for x in self.given if x > -1e8), default=0.0))
        rank = np.append(np.maximum(-self.given, 0.0), [1.0 - last] * 256)  # bytes come after the last merge
        weight = 1 / (rank + zipf_shift)
        logs = np.log(weight / weight.sum())
        self.scores, self.byte_score = logs[: len(plain)], float(logs[-1])
        self.longest = max(map(len, self.texts))
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        points = np.frombuffer("".join(t.ljust(self.longest, "\0") for t in self.texts).encode("utf-32-le"), "<u4")
        self.points = points.reshape(len(plain), self.longest)
        self.alphabet = np.unique(self.points)[1:]
        self.merges = MergeOrder(self.texts, (-self.given).tolist())
        #: The bytes that each id stands for in a text.
        self.spelled = [b""] * n
        for i, t in zip(plain, self.texts, strict=True):
            self.spelled[i] = t.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_id):
            self.spelled[i] = bytes([b])


class MergeOrder:
    """Which pieces can stand side by side when neighbours are merged in the order of rank, of equal ones the leftmost."""

    #: Answers that a worker remembers before it starts afresh: bounds its memory, never its results.
    REMEMBERED = 3_000_000

    def __init__(self, texts: list[str], ranks: list[float]):
        self.texts, self.width = texts, len(texts) + 1
        self.rank = dict(zip(texts, ranks, strict=True))
        self.known: dict[int, bool] = {}
        self.right_side: dict[str, list[tuple[str, float]]] = {}
        self.left_side: dict[str, list[tuple[str, float]]] = {}

    def merged(self, text: str) -> tuple[list[str], list[tuple[int, int, int]]]:
        """The pieces of a text by merging, and its merges as (start, middle, end)."""
        cuts, done = list(range(len(text) + 1)), []
        while len(cuts) > 2:
            found = [(r, i) for i in range(len(cuts) - 2) if (r := self.rank.get(text[cuts[i] : cuts[i + 2]])) is not None]
            if not found:
                break
            i = min(found)[1]
            done.append((cuts[i], cuts[i + 1], cuts[i + 2]))
            del cuts[i + 1]
        return [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], done

    def sides(self, text: str) -> tuple[list[tuple[str, float]], list[tuple[str, float]]]:
        """The parts at a piece's end and at its start, smallest first, each with the rank of the merge that ends it."""
        if text not in self.right_side:
            merges = self.merged(text)[1]
            for table, parts in (
                (self.right_side, [text[m:] for _, m, e in merges if e == len(text)]),
                (self.left_side, [text[:m] for b, m, _ in merges if b == 0]),
            ):
                ends = map(self.rank.__getitem__, [*parts[1:], text])
                table[text] = [*zip(parts, ends, strict=False), (text, float("inf"))]
        return self.right_side[text], self.left_side[text]

    def follows(self, a: str, b: str) -> bool:
        """Whether merging a + b gives a and b."""
        if SPACE * 2 in a or SPACE * 2 in b:  # runs of spaces share one rank, so only merging itself tells
            return self.merged(a + b)[0] == [a, b]
        left, right, i, j, rank = self.sides(a)[0], self.sides(b)[1], 0, 0, self.rank
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            across = rank.get(x + y)
            if across is not None and across < x_ends and across <= y_ends:
                return False
            if x_ends == y_ends == float("inf"):
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def may_follow(self, before: list[int], after: list[int]) -> list[bool]:
        """For numbers of pieces; -1 is the start of a chunk or a character without a piece, which anything may follow."""
        known, texts, width, out = self.known, self.texts, self.width, []
        if len(known) > self.REMEMBERED:
            known.clear()
        for a, b in zip(before, after, strict=True):
            if a < 0 or b < 0:
                out.append(True)
                continue
            ok = known.get(a * width + b)
            if ok is None:
                ok = known[a * width + b] = self.follows(texts[a], texts[b])
            out.append(ok)
        return out


@lru_cache(maxsize=4)
def pieces(model_file: str) -> Pieces:
    return Pieces(model_file)


def portions(chunks: list[str], size: int = MATCHED_CHARS) -> Iterator[list[str]]:
    """The chunks in lists of about so many characters."""
    ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1)
    start = 0
    while start < len(chunks):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, "right")))
        yield chunks[start:stop]
        start = stop


class Lattice:
    """Edges over a batch of chunks. Node p stands before character p of the joined text; a separator is its chunk's end node."""

    def __init__(self, vocabulary: Pieces, chunks: list[str]):
        self.vocabulary = v = vocabulary
        text = np.frombuffer(("\0".join(chunks) + "\0").encode("utf-32-le", "surrogatepass"), "<u4").copy()
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        self.starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])).astype(np.int64)
        self.ends, self.sizes = self.starts + sizes, sizes
        text[self.ends] = SEPARATOR
        self.text, self.n = text, len(text)
        present = v.alphabet[np.isin(v.alphabet, text, assume_unique=False)]
        codes = np.searchsorted(present, text)
        codes = np.where((codes < len(present)) & (present[np.minimum(codes, len(present) - 1)] == text) if len(present) else False, codes + 1, 0).astype(np.uint64)
        self.piece, self.at = self._match(present, codes)
        self._order(codes)

    def _keys(self, columns: list[np.ndarray], bits: int, fill: int = 0) -> list[np.ndarray]:
        """Columns of codes packed into as few 64-bit words as hold them, first character highest."""
        per_word, words = 62 // bits, []
        for first in range(0, len(columns), per_word):
            word = np.zeros(len(columns[0]), np.uint64)
            for k in range(per_word):
                word = (word << np.uint64(bits)) | (columns[first + k] if first + k < len(columns) else np.uint64(fill))
            words.append(word)
        return words

    def _match(self, present: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces that occur and where, piece by piece."""
        v = self.vocabulary
        if not len(present):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = np.searchsorted(present, v.points)
        known = present[np.minimum(own, len(present) - 1)] == v.points
        usable = np.flatnonzero((known | (v.points == 0)).all(1))
        own = np.where(v.points[usable] == 0, 0, own[usable] + 1).astype(np.uint64)
        depth = int(v.lengths[usable].max()) if len(usable) else 0
        if not depth:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bits = int(len(present) + 1).bit_length()
        top = (1 << bits) - 1
        padded = np.concatenate((codes, np.zeros(depth, np.uint64)))
        suffix = self._keys([padded[k : k + self.n] for k in range(depth)], bits)
        order = np.lexsort(suffix[::-1]) if len(suffix) > 1 else np.argsort(suffix[0], kind="stable")
        suffix = [w[order] for w in suffix]
        beyond = np.arange(depth)[None, :] >= v.lengths[usable][:, None]
        low = self._keys([own[:, k] for k in range(depth)], bits)
        high = self._keys([np.where(beyond[:, k], np.uint64(top), own[:, k]) for k in range(depth)], bits, top)
        first, last = self._bisect(suffix, low, False), self._bisect(suffix, high, True)
        many = last - first
        number = np.repeat(usable, many)
        ahead = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return number, order[np.repeat(first, many) + ahead]

    def _bisect(self, keys: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
        """Binary search for all wanted keys at once, over keys of several words."""
        low, high = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(keys[0]), np.int64)
        for _ in range(len(keys[0]).bit_length() + 1):
            mid = np.minimum((low + high) >> 1, len(keys[0]) - 1)
            less, equal = np.zeros(len(mid), bool), np.ones(len(mid), bool)
            for k, w in zip(keys, wanted, strict=True):
                x = k[mid]
                less |= equal & (x < w)
                equal &= x == w
            go = (less | equal if right else less) & (low < high)
            high = np.where(go | (low >= high), high, mid)
            low = np.where(go, mid + 1, low)
        return low

    def _order(self, codes: np.ndarray) -> None:
        """Add the edges of bytes for characters that no piece spells, then sort edges by offset in the chunk and length."""
        v = self.vocabulary
        length = v.lengths[self.piece]
        single = np.zeros(self.n, bool)
        single[self.at[length == 1]] = True
        lone = np.flatnonzero(~single & (self.text != SEPARATOR))
        self.lone = lone
        piece = np.concatenate((self.piece, np.full(len(lone), -1)))
        at, length = np.concatenate((self.at, lone)), np.concatenate((length, np.ones(len(lone), np.int64)))
        chunk = np.searchsorted(self.starts, at, "right") - 1
        offset = at - self.starts[chunk]
        long = self.sizes[chunk] > LONG
        self.long_edges = np.flatnonzero(long)
        self.long_edges = self.long_edges[np.lexsort((-length[self.long_edges], at[self.long_edges]))]
        short = np.flatnonzero(~long)
        width = v.longest + 1
        key = offset[short] * width + length[short]
        short = short[np.argsort(key, kind="stable")]
        key = offset[short] * width + length[short]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)])) if len(key) else np.zeros(1, np.int64)
        self.groups = [short[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.piece, self.at, self.length, self.to, self.offset = piece, at, length, at + length, offset
        point = self.text[lone]
        self.lone_bytes = 1 + (point >= 0x80).astype(np.int64) + (point >= 0x800) + (point >= 0x10000)

    def edge_scores(self, scores: np.ndarray, byte_score: float) -> np.ndarray:
        own = np.empty(len(self.piece))
        known = len(own) - len(self.lone)
        own[:known] = scores[self.piece[:known]]
        own[known:] = byte_score * self.lone_bytes
        return own

    def best_paths(self) -> list[np.ndarray]:
        """Ids of each chunk's admissible path."""
        last, back = np.full(self.n + 1, -1, np.int64), np.full(self.n + 1, -1, np.int64)
        may_follow = self.vocabulary.merges.may_follow
        for edges in self.groups:
            piece = self.piece[edges]
            edges = edges[np.array(may_follow(last[self.at[edges]].tolist(), piece.tolist()), bool)]
            back[self.to[edges]] = edges
            last[self.to[edges]] = self.piece[edges]
        for edge in self.long_edges.tolist():
            if may_follow([int(last[self.at[edge]])], [int(self.piece[edge])])[0]:
                back[self.to[edge]] = edge
                last[self.to[edge]] = self.piece[edge]
        at, used = self.ends[self.sizes > 0], []
        first = self.starts[self.sizes > 0]
        while len(at):
            edge = back[at]
            used.append(edge)
            at, first = self.at[edge], first
            going = at > first
            at, first = at[going], first[going]
        path = np.concatenate(used) if used else np.zeros(0, np.int64)
        path = path[np.argsort(self.at[path])]
        known = len(self.piece) - len(self.lone)
        many = np.ones(len(path), np.int64)
        lone = path >= known
        many[lone] = self.lone_bytes[path[lone] - known]
        ids = np.repeat(np.where(lone, 0, self.vocabulary.ids[np.where(lone, 0, self.piece[path])]), many)
        if lone.any():
            where = np.cumsum(many) - many
            for k in np.flatnonzero(lone):
                spelled = chr(self.text[self.at[path[k]]]).encode("utf-8", "surrogatepass")
                ids[where[k] : where[k] + many[k]] = self.vocabulary.byte_id[list(spelled)]
        tokens = np.bincount(np.searchsorted(self.starts, self.at[path], "right") - 1, weights=many, minlength=len(self.starts)).astype(np.int64)
        return np.split(ids, np.cumsum(tokens)[:-1])

    def _sum(self, score: np.ndarray, forward: bool) -> np.ndarray:
        """Log of the summed weight of all paths to each node, or from it to the chunk's end."""
        out = np.full(self.n + 1, -np.inf)
        out[self.starts if forward else self.ends] = 0
        source, target = (self.at, self.to) if forward else (self.to, self.at)
        for edges in self.groups if forward else reversed(self.groups):
            to = target[edges]
            out[to] = np.logaddexp(out[to], out[source[edges]] + score[edges])
        e = self.long_edges if forward else self.long_edges[::-1]
        for edge in e.tolist():
            out[target[edge]] = np.logaddexp(out[target[edge]], out[source[edge]] + score[edge])
        return out

    def totals(self, score: np.ndarray) -> np.ndarray:
        """Log of the summed weight of all segmentations of each chunk."""
        return self._sum(score, True)[self.ends]

    def expected(self, score: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Each edge's expected number of uses, with a weight for each chunk."""
        ahead, behind = self._sum(score, True), self._sum(score, False)
        chunk = np.searchsorted(self.starts, self.at, "right") - 1
        return np.exp(ahead[self.at] + score + behind[self.to] - ahead[self.ends][chunk]) * weight[chunk]
