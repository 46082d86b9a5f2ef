"""Token counts by dynamic programming over a trie of the distinct pre-tokens.

Each worker keeps a trie of the pre-tokens it has met. A node holds the forward score of its prefix, the sum of the
scores that the vocabulary file gives the pieces on its path, with the path's number of tokens and last piece. They are
computed once, when the node is made, from the nodes above it, so words that begin alike share the work; among the pieces that
end in a node the one is taken that may follow the last piece before it (lattice.MergeOrder), of which there is one. A
pre-token's terminal count is stored with it, and a document's count is the sum over its pre-tokens. The trie is begun again
between two pre-tokens when it outgrows `TRIE_NODES`: memory is bounded whatever the texts, and counts don't depend on what a
trie has met before.

Counts are those of the library's own encoding, and the lengths of what sentencepieces.py gives. No row leaves its
task: there is no shuffle. Null texts count null, empty texts 0.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common
from corpusloom.llm.lattice import SPACE, Pieces, chunks_of, pieces

TRIE_NODES = 700_000


class TokenTrie:
    """A trie of pre-tokens; node 0 is the empty prefix."""

    def __init__(self, vocabulary: Pieces):
        self.byte_score = float(vocabulary.given.min())
        self.merges = vocabulary.merges
        self.given = vocabulary.given.tolist()
        self.ends: dict[str, int] = {}  # every end of a piece; its number where it is a piece, else -1
        for t in vocabulary.texts:
            for k in range(1, len(t)):
                self.ends.setdefault(t[k:], -1)
        self.ends |= {t: i for i, t in enumerate(vocabulary.texts)}
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.tokens, self.last = [0.0], [0], [-1]
        self.terminal: dict[str, int] = {}

    def insert(self, word: str) -> int:
        child, score, tokens, last, ends, known = self.child, self.score, self.tokens, self.last, self.ends, self.merges.known
        width, may_follow = self.merges.width, self.merges.may_follow
        path, node, spelled = [0], 0, word.replace(" ", SPACE)
        for i, c in enumerate(spelled):
            found = child.get((node, c))
            if found is None:
                value, count, own = score[node], tokens[node], -1
                for start in range(i, -1, -1):
                    piece = ends.get(spelled[start : i + 1])
                    if piece is None:  # no piece ends like this, nor does a longer one
                        break
                    if piece >= 0:
                        above = path[start]
                        before = last[above]
                        ok = before < 0 or known.get(before * width + piece)
                        if ok or (ok is None and may_follow([before], [piece])[0]):
                            value, count, own = score[above] + self.given[piece], tokens[above] + 1, piece
                            break
                if own < 0:
                    n = len(c.encode("utf-8", "surrogatepass"))
                    value, count = score[node] + n * self.byte_score, tokens[node] + n
                found = child[node, c] = len(score)
                score.append(value)
                tokens.append(count)
                last.append(own)
            node = found
            path.append(node)
        self.terminal[word] = tokens[node]
        return tokens[node]

    def count(self, texts: list[str | None]) -> tuple[list[int | None], list[int | None]]:
        """Tokens and pre-tokens of each text."""
        out, words_of = [], []
        for t in texts:
            words = None if t is None else chunks_of(" " + t) if t else []
            total = None if words is None else 0
            for w in words or ():
                n = self.terminal.get(w)
                if n is None:
                    if len(self.score) > TRIE_NODES:
                        self.clear()
                    n = self.insert(w)
                total += n
            out.append(total)
            words_of.append(None if words is None else len(words))
        return out, words_of


_tries: dict[str, TokenTrie] = {}


def token_counts(docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and n_pretokens of every row."""
    common.ship(docs.sparkSession)

    def run(batches):
        trie = _tries.get(model_file) or _tries.setdefault(model_file, TokenTrie(pieces(model_file)))
        for batch in common.bounded(batches, "text"):
            tokens, words = trie.count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(words, pa.int64())], ["doc_id", "n_tokens", "n_pretokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_pretokens long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    import public_tokenizers

    return token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
