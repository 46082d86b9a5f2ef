"""Language-model scores: the marginal probability of a text over a lattice of words and subwords.

Tokens are the words [^\\x20\\x09-\\x0D]+ of the text with A-Z in lower case, then one end. A token's lattice has edges
for the whole token and the edges of every segmentation of its spelling into pieces of an existing unigram vocabulary;
the forward recursion sums them all in log space. With c the token's count and N all tokens in training, G the
lattice's probability of the spelling, and m of the i tokens before it in the text equal to it,

    B(token) = (1 - share) c / N + share G(token)        P(token | text before) = (strength B(token) + m) / (strength + i)

so a whole-token edge has the weight that training gives it, and one that grows where the text has used the token. The
product over a text is the marginal probability of the text when its own word distribution is drawn from a Dirichlet
distribution round B: a word that training doesn't know is spelled once and then expected again.

G generates a word as a first piece, then further pieces until a stop. Pieces have the weights that lattice.py derives
from the vocabulary file's own scores; they stay as they are, for the vocabulary is given and not trained. Training sets
the word edges, the chance that a word goes on after a piece (from the expected number of pieces, forward and backward sums
over all segmentations, of the distinct training words), and `share` and `strength`: of a grid the pair that makes the
training documents most likely, each scored by the counts of all others. G sums to 1 over words at most, so score is the
log10 of a proper probability of the text.

base_score uses add-one smoothing: log10((c + 1) / (N + V + 1)). It is a probability too, but one in which all unknown
words are a single token: it doesn't pay for their spelling.

Documents are dealt into blocks of bounded bytes by a hash of id and text, so that a block sends each of its distinct words
once and gets each word's figures back once. A document is scored at every point of the grid in the same pass, and the
point is chosen when all are summed. The word table grows with the corpus and stays distributed; only totals come to the
driver. Null texts are empty texts (the end alone); a null id counts as the empty string; repeated rows are documents of their
own; an empty table has no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common
from corpusloom.llm.lattice import SPACE, Lattice, Pieces, pieces, portions

RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SCORED = RESULT.removesuffix("score double") + "scores array<double>, others array<double>"
#: Tokens of the documents that are scored at once.
SCORED_TOKENS = 250_000
#: The grid of (share, strength).
GRID = [(share, strength) for share in (0.005, 0.02, 0.06, 0.15) for strength in (100.0, 300.0, 1000.0, 3000.0, 10000.0)]


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


class PieceModel:
    """Probabilities of first pieces, further pieces and the stop after each piece; `going` is the chance of no stop."""

    def __init__(self, vocabulary: Pieces, going: float = 0.5):
        first = np.array([t.startswith(SPACE) for t in vocabulary.texts])
        weight, byte = np.exp(vocabulary.scores), float(np.exp(vocabulary.byte_score))
        further = weight[~first].sum() + 256 * byte
        self.scores = np.log(weight / np.where(first, weight[first].sum(), further)) + np.where(first, 0.0, np.log(going))
        self.byte_score = float(np.log(byte / further) + np.log(going))
        self.stop = float(np.log1p(-going))

    def log_probability(self, lattice: Lattice) -> np.ndarray:
        return lattice.totals(lattice.edge_scores(self.scores, self.byte_score)) + self.stop


def spelled(words: list[bytes]) -> list[str]:
    return [SPACE + w.decode("utf-8", "surrogatepass") for w in words]


def block_words(docs: DataFrame) -> DataFrame:
    """(block, word, n): each block's distinct words and their number in its training documents."""

    def run(groups):
        counts: dict[bytes, int] = {}
        block = groups.column("block")[0].as_py()
        for doc_id, text in zip(groups.column("doc_id").to_pylist(), groups.column("text").to_pylist(), strict=True):
            words = words_of(text)
            if is_held_out(doc_id):
                for w in words:
                    counts.setdefault(w, 0)
            else:
                for w in words:
                    counts[w] = counts.get(w, 0) + 1
        return pa.table([pa.array([block] * len(counts), pa.int32()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["block", "word", "n"])

    return docs.groupBy("block").applyInArrow(run, "block int, word binary, n long")


def fit_going(words: DataFrame, model_file: str) -> float:
    """The chance that a word goes on after a piece, from the expected pieces of the distinct training words; two sums a task leave it."""

    def expect(batches):
        vocabulary = pieces(model_file)
        model, total = PieceModel(vocabulary), np.zeros(2)
        for batch in batches:
            for some in portions(spelled(batch.column("word").to_pylist())):
                lattice = Lattice(vocabulary, some)
                many = lattice.expected(lattice.edge_scores(model.scores, model.byte_score), np.ones(len(some)))
                known = len(many) - len(lattice.lone)
                total += many[:known].sum() + many[known:] @ lattice.lone_bytes, len(some)
        yield pa.RecordBatch.from_arrays([pa.array(total[:1]), pa.array(total[1:])], ["pieces", "words"])

    total = words.select("word").mapInArrow(expect, "pieces double, words double").agg(F.sum("pieces"), F.sum("words")).first()
    used, n = (x or 0.0 for x in total)
    return (used - n + 1) / (used + 2)


def spellings(words: DataFrame, model: PieceModel, model_file: str) -> DataFrame:
    """(word, c, spelled) for (word, c): the log probability of the spelling."""

    def run(batches):
        vocabulary = pieces(model_file)
        for batch in batches:
            found = [model.log_probability(Lattice(vocabulary, some)) for some in portions(spelled(batch.column("word").to_pylist()))]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(np.concatenate(found or [np.zeros(0)]))], ["word", "c", "spelled"])

    return words.mapInArrow(run, "word binary, c long, spelled double")


def block_scores(at: np.ndarray, doc: np.ndarray, c: np.ndarray, spelling: np.ndarray, n_train: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each document at every point of the grid, and the same by the counts of all other documents.

    at are the numbers of the tokens, ends included, of documents that lie end to end, doc the document of each token.
    c and spelling are by number; held marks documents that aren't counted in c.
    """
    starts = np.searchsorted(doc, np.arange(len(held)))
    order = np.lexsort((at, doc))  # stable: equal tokens of a document in their order
    first = np.ones(len(order), bool)
    first[1:] = (doc[order][1:] != doc[order][:-1]) | (at[order][1:] != at[order][:-1])
    run = np.flatnonzero(first)
    many = np.diff(np.append(run, len(order)))
    before, whole = np.empty(len(at)), np.empty(len(at))
    before[order] = np.arange(len(order)) - np.repeat(run, many)
    whole[order] = np.repeat(many, many)
    place = np.arange(len(at)) - starts[doc]
    size = np.bincount(doc, minlength=len(held))
    word, spell = c[at] / max(n_train, 1), spelling[at]
    rest = np.maximum(n_train - size[doc], 1)
    left = np.where(held[doc], c[at] / max(n_train, 1), (c[at] - whole) / rest)
    tiny = np.flatnonzero(spell < -600)  # spellings too unlikely for a sum outside log space
    linear = np.exp(spell)
    out = [], []
    for share, strength in GRID:
        below = np.add.reduceat(np.log(strength + place), starts)
        for found, known in zip(out, (word, left), strict=True):
            whole_word = strength * (1 - share) * known + before
            with np.errstate(divide="ignore"):
                value = np.log(whole_word + strength * share * linear)
                value[tiny] = np.logaddexp(np.log(whole_word[tiny]), np.log(strength * share) + spell[tiny])
            found.append(np.add.reduceat(value, starts) - below)
    return tuple(np.stack(x, 1) / np.log(10) for x in out)


def lm_scores(docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text", block_docs: int = 4000, block_bytes: int = 16 << 20) -> DataFrame:
    """RESULT of every row."""
    common.ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // block_docs), -(-size["bytes"] // block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    asked = common.stored(block_words(rows))
    words = common.stored(asked.groupBy("word").agg(F.sum("n").alias("c")))
    ends = rows.filter(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) != 2).count()
    train = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n_train, n_types = train["n"] + ends, train["v"] + (1 if ends else 0)
    end_share = (ends + 1) / (n_train + 2)
    model = PieceModel(pieces(model_file), fit_going(words.filter("c > 0"), model_file))
    given = asked.select("block", "word").join(spellings(words, model, model_file), "word")

    def score(docs: pa.Table, given: pa.Table) -> pa.Table:
        number = {w: i for i, w in enumerate(given.column("word").to_pylist())}
        c = np.append(given.column("c").to_numpy(), ends)
        spelling = np.append(given.column("spelled").to_numpy() + np.log1p(-end_share), np.log(end_share))
        ids, tokens, sizes = docs.column("doc_id").to_pylist(), [], []
        for text in docs.column("text").to_pylist():
            own = words_of(text)
            tokens.append(np.fromiter(map(number.__getitem__, own), np.int64, len(own)))
            tokens.append(np.array([len(number)]))
            sizes.append(len(own) + 1)
        at = np.concatenate(tokens or [np.zeros(0, np.int64)])
        held = np.array([is_held_out(i) for i in ids], bool)
        ends_at, parts, low = np.cumsum(sizes), [], 0
        while low < len(ids):  # some documents at a time: the arrays of a grid are many
            start = ends_at[low] - sizes[low]
            high = max(low + 1, int(np.searchsorted(ends_at, start + SCORED_TOKENS, "right")))
            some, doc = at[start : ends_at[high - 1]], np.repeat(np.arange(high - low), sizes[low:high])
            base = np.bincount(doc, np.log10((c[some] + 1) / (n_train + n_types + 1)), high - low)
            parts.append((*block_scores(some, doc, c, spelling, n_train, held[low:high]), base, np.bincount(doc, c[some] > 0, high - low)))
            low = high
        scores, others, base, known = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros((0, len(GRID))), np.zeros((0, len(GRID))), np.zeros(0), np.zeros(0))
        others[held] = 0
        listed = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(GRID), dtype=np.int32)), pa.array(x.ravel()))
        columns = [pa.array(ids, pa.int64()), pa.array(held), pa.array(sizes, pa.int64()), pa.array(known.astype(np.int64)), pa.array([n_train] * len(ids), pa.int64()), pa.array(base), listed(scores), listed(others)]
        return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "scores", "others"])

    scored = common.stored(rows.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(score, SCORED))
    sums = scored.agg(*(F.sum(F.col("others")[k]).alias(f"s{k}") for k in range(len(GRID)))).first()
    best = max(range(len(GRID)), key=lambda k: (sums[k] or 0.0, -k))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", F.col("scores")[best].alias("score"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of the training documents."""
    import public_tokenizers

    return lm_scores(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
