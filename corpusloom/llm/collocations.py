"""Collocations: the phrases of a corpus whose words stand together more often than their parts would, by stripes.

Texts are lower-cased (A-Z), split at punctuation and line ends into pieces and these at blanks into words. A stripe belongs
to a first word: how often it stands at all, and an associative counter of the words that follow it in a piece, each
with a counter of the words that follow both, and so on to `longest` words. A task makes the stripes of a portion of text at
a time, so that all counting that can be done there is done before anything is sent; stripes of one word are merged
elementwise behind a shuffle. A merged stripe gives all that is asked: its entries are the counts of the phrases that
extend a prefix, its total the count of the first word, and the largest entry below a prefix the most frequent longer
phrase that begins with it. Each count is sent once, and a prefix is spelled once for all its extensions.

The stripe of a frequent word is dealt into parts by a digest of the second word, more of them for a larger number of texts,
so that it meets in no single task. Which words these are is told from a sample of texts, up to HOT of them: the layout
depends on the sample, the result doesn't. Merging streams over the rows of a part and holds one part's distinct phrases and a
batch. Only phrases of `least` occurrences or more leave the merge. Parts of a phrase are at least as frequent
as the phrase, so what scores need is joined from these: single words, which are parts of very many phrases, by
common.small_join(), longer parts by equi-joins. These grow with the corpus and are merge joins always: Spark sizes a table by its
compressed files, and would broadcast one whose rows don't fit the driver.

A candidate is a phrase of 2 to `longest` words with a = f(phrase) >= least. Of its cuts the one of lowest score
floor(10^6 a^2 / (l r)) counts, of equal ones the first; a candidate goes if a longer one that contains its words has
`share` percent of its count or more. The most frequent of these is longer by one word, so no others are asked. Counts are
exact and products are taken in 38 digits, which holds up to 10^15 occurrences.

Null and empty texts have no words; a null language is `und`, and every language has its own counts. Repeated rows and
ties count as they stand. Phrases are ordered by their UTF-8 bytes. A language without candidates and an empty table have no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import common

#: Bytes of text that a task counts at once.
PORTION = 16 << 20
#: Texts of the sample that tells frequent words, most words that are dealt into parts, and their least share of a sample's words.
SAMPLE, HOT, HOT_SHARE = 4000, 4096, 1 / 4000
#: A byte that UTF-8 doesn't use stands between pieces.
BREAK = b"\xff"
TO_BREAKS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0dABCDEFGHIJKLMNOPQRSTUVWXYZ", BREAK * 10 + b"abcdefghijklmnopqrstuvwxyz")
MERGED = "kind int, lang string, phrase binary, f long"
#: Kinds of merged rows: a phrase's count, the largest count of its extensions, the words of a language.
COUNT, LARGEST, WORDS = 0, 1, 2


class Numbers(dict):
    """Numbers of words in the order they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def portions(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[str, bytes]]:
    """(lang, pieces) of about so many bytes; longer texts are cut between pieces."""
    held: dict[str, list[bytes]] = {}
    total = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            if not (text := text.as_py()):
                continue
            text = text.translate(TO_BREAKS)
            while len(text) > size and 0 < (cut := max(text.rfind(BREAK, 0, size), text.find(BREAK, size))):
                yield lang, text[:cut]
                text = text[cut + 1 :]
            held.setdefault(lang, []).append(text)
            total += len(text)
            if total >= size:
                yield from ((k, BREAK.join(v)) for k, v in held.items())
                held, total = {}, 0
    yield from ((k, BREAK.join(v)) for k, v in held.items())


@dataclass
class Level:
    """Words at one depth of stripes, those of a parent together: each parent's number of them, and their own counts."""

    size: np.ndarray
    words: list[bytes]
    n: np.ndarray


@dataclass
class Stripes:
    """Rows of (lang, first word, part) with the first word's count and the words that follow, level by level."""

    lang: pa.Array
    first: pa.Array
    part: np.ndarray
    total: np.ndarray
    levels: list[Level]


def schema(longest: int) -> str:
    """A row holds a level as its words, each ended by a line end, their counts, and from the second level on the number of words of each parent."""
    levels = "".join(f", w{k} binary, n{k} binary" + (f", k{k} binary" if k > 1 else "") for k in range(1, longest))
    return f"lang string, first binary, part int, total long{levels}"


def binary(data: bytes, ends: np.ndarray) -> pa.Array:
    """Values that lie end to end in data."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def encoded(stripes: Stripes) -> pa.Table:
    columns, names = [stripes.lang, stripes.first, pa.array(stripes.part, pa.int32()), pa.array(stripes.total, pa.int64())], ["lang", "first", "part", "total"]
    nodes = np.arange(1, len(stripes.part) + 1)  # end of each row's nodes on the level above
    for k, level in enumerate(stripes.levels, 1):
        before, ends = nodes, np.append(0, np.cumsum(level.size))[nodes]
        length = np.append(0, np.cumsum(np.fromiter(map(len, level.words), np.int64, len(level.words)) + 1))
        columns += [binary(b"\n".join([*level.words, b""]), length[ends]), binary(level.n.astype(np.int64).tobytes(), 8 * ends)]
        names += [f"w{k}", f"n{k}"]
        if k > 1:
            columns.append(binary(level.size.astype(np.int32).tobytes(), 4 * before))
            names.append(f"k{k}")
        nodes = ends
    return pa.table(columns, names=names)


def decoded(rows: pa.RecordBatch, longest: int) -> Stripes:
    levels = []
    for k in range(1, longest):
        text = b"".join(rows.column(f"w{k}").to_pylist())
        n = rows.column(f"n{k}").to_pylist()
        size = np.fromiter(map(len, n), np.int64, len(n)) // 8 if k == 1 else np.frombuffer(b"".join(rows.column(f"k{k}").to_pylist()), np.int32).astype(np.int64)
        levels.append(Level(size, text[:-1].split(b"\n") if text else [], np.frombuffer(b"".join(n), np.int64)))
    return Stripes(rows.column("lang"), rows.column("first"), rows.column("part").to_numpy(), rows.column("total").to_numpy(), levels)


def joined(some: list[Stripes]) -> Stripes:
    levels = [Level(np.concatenate([x.size for x in same]), [w for x in same for w in x.words], np.concatenate([x.n for x in same])) for same in zip(*(s.levels for s in some), strict=True)]
    return Stripes(pa.concat_arrays([s.lang for s in some]), pa.concat_arrays([s.first for s in some]), np.concatenate([s.part for s in some]), np.concatenate([s.total for s in some]), levels)


def last(stripes: Stripes) -> Stripes:
    """The last row alone."""
    levels, rows = [], 1
    for level in stripes.levels:
        size = level.size[len(level.size) - rows :]
        rows = int(size.sum())
        levels.append(Level(size, level.words[len(level.words) - rows :], level.n[len(level.n) - rows :]))
    return Stripes(stripes.lang[-1:], stripes.first[-1:], stripes.part[-1:], stripes.total[-1:], levels)


def split_words(pieces: bytes) -> list[bytes]:
    return pieces.replace(BREAK, b" " + BREAK + b" ").split()


def stripes_of(lang: str, pieces: bytes, longest: int, parts: int, hot: frozenset[bytes] = frozenset()) -> pa.Table:
    """The stripes of a portion, those of hot words in parts. The part that holds a first word's count is that of its own digest."""
    numbers = Numbers({BREAK: 0})
    words = split_words(pieces)
    at = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    del words
    vocabulary, width = list(numbers), len(numbers)
    many = np.ones(width, np.int64)
    many[[numbers[w] for w in hot if w in numbers]] = parts
    digest = np.fromiter(map(zlib.crc32, vocabulary), np.int64, width)
    total = np.bincount(at, minlength=width)
    total[0] = 0
    place = np.flatnonzero(at[:-1] * at[1:])
    # rows: first words and parts that have a follower, and those that hold a count
    row_of = at[place] * parts + digest[at[place + 1]] % many[at[place]]
    some = np.flatnonzero(total)
    home = digest % many
    rows = np.unique(np.concatenate((row_of, some * parts + home[some])))
    node, levels, parents = np.searchsorted(rows, row_of), [], len(rows)
    for k in range(1, longest):
        pairs, node, n = np.unique(node * width + at[place + k], return_inverse=True, return_counts=True)
        levels.append(Level(np.bincount(pairs // width, minlength=parents), [vocabulary[i] for i in (pairs % width).tolist()], n))
        parents = len(pairs)
        if k + 1 < longest:
            inside = place + k + 1 < len(at)
            inside[inside] = at[place[inside] + k + 1] > 0
            place, node = place[inside], node[inside]
    first, own = rows // parts, rows % parts
    return encoded(Stripes(pa.array([lang] * len(rows), pa.string()), pa.array([vocabulary[i] for i in first.tolist()], pa.binary()), own, np.where(own == home[first], total[first], 0), levels))


def merged(stripes: Stripes) -> Stripes:
    """One row for each (lang, first, part) of rows that are sorted by these: counters added elementwise."""
    new = np.ones(len(stripes.part), bool)
    keys = [stripes.lang.dictionary_encode().indices.to_numpy(), stripes.first.dictionary_encode().indices.to_numpy(), stripes.part]
    new[1:] = np.any([c[1:] != c[:-1] for c in keys], axis=0)
    node, starts, levels = np.cumsum(new) - 1, np.flatnonzero(new), []
    parents = len(starts)
    for level in stripes.levels:
        numbers = Numbers()
        word = np.fromiter(map(numbers.__getitem__, level.words), np.int64, len(level.words))
        vocabulary, width = list(numbers), max(1, len(numbers))
        pairs, node = np.unique(np.repeat(node, level.size) * width + word, return_inverse=True)
        n = np.zeros(len(pairs), np.int64)
        np.add.at(n, node, level.n)
        levels.append(Level(np.bincount(pairs // width, minlength=parents), [vocabulary[i] for i in (pairs % width).tolist()], n))
        parents = len(pairs)
    where = pa.array(starts)
    return Stripes(stripes.lang.take(where), stripes.first.take(where), stripes.part[starts], np.add.reduceat(stripes.total, starts), levels)


def results(stripes: Stripes, least: int, rows: int) -> pa.RecordBatch:
    """What the first so many rows of merged stripes say: counts of phrases, largest extensions, and words of each language."""
    out: list[tuple[np.ndarray, list[bytes], np.ndarray, int]] = []  # rows, phrases, numbers, kind
    first = stripes.first
    often = np.flatnonzero(stripes.total[:rows] >= least)
    out.append((often, first.take(pa.array(often)).to_pylist(), stripes.total[often], COUNT))
    row = np.arange(rows)
    for k, level in enumerate(stripes.levels):
        size = level.size[: len(row)]
        parent = np.repeat(np.arange(len(row)), size)
        n = level.n[: len(parent)]
        often = np.flatnonzero(n >= least)  # a phrase is no more frequent than its beginning, which is spelled
        if k:
            largest = np.zeros(len(row), np.int64)
            np.maximum.at(largest, parent[often], n[often])
            grown = np.flatnonzero(largest)
            out.append((row[grown], [spelled[i] for i in grown.tolist()], largest[grown], LARGEST))
            begun = [spelled[i] for i in parent[often].tolist()]
        else:
            begun = first.take(pa.array(parent[often])).to_pylist()
        spelled = {i: b"%b %b" % (p, level.words[i]) for i, p in zip(often.tolist(), begun, strict=True)}
        row = row[parent]
        out.append((row[often], list(spelled.values()), n[often], COUNT))
    langs = stripes.lang[:rows].dictionary_encode()
    of_lang = np.zeros(len(langs.dictionary), np.int64)
    np.add.at(of_lang, langs.indices.to_numpy(), stripes.total[:rows])
    lang = pa.concat_arrays([stripes.lang.take(pa.array(np.concatenate([r for r, *_ in out]))), langs.dictionary])
    phrase = pa.array([p for _, some, *_ in out for p in some] + [b""] * len(of_lang), pa.binary())
    kind = np.concatenate([*(np.full(len(r), k) for r, _, _, k in out), np.full(len(of_lang), WORDS)])
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), lang, phrase, pa.array(np.concatenate([*(f for _, _, f, _ in out), of_lang]))], ["kind", "lang", "phrase", "f"])


def merge(batches: Iterable[pa.RecordBatch], longest: int, least: int) -> Iterator[pa.RecordBatch]:
    """results() of rows sorted by lang, first and part; the last stripe of a batch goes on with the next batch."""
    held: Stripes | None = None
    for batch in batches:
        if batch.num_rows:
            own = decoded(batch, longest)
            whole = merged(own if held is None else joined([held, own]))
            held = last(whole)
            yield results(whole, least, len(whole.part) - 1)
    if held is not None:
        yield results(held, least, 1)


def hot_words(texts: DataFrame, n_texts: int) -> dict[str, frozenset[bytes]]:
    """Words of each language that are frequent in a sample of texts, HOT at most."""

    def count(batches):
        for lang, pieces in portions(batches, PORTION):
            words = split_words(pieces)
            found = [(w, n) for w, n in Counter(words).items() if w != BREAK and n >= len(words) * HOT_SHARE]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([w for w, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], ["lang", "word", "n"])

    sample = texts.sample(min(1.0, SAMPLE / max(1, n_texts)), seed=1)
    found = sample.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).orderBy(F.desc("n")).limit(HOT)
    out: dict[str, set[bytes]] = {}
    for r in found.collect():
        out.setdefault(r["lang"], set()).add(bytes(r["word"]))
    return {lang: frozenset(words) for lang, words in out.items()}


def counts(docs: DataFrame, longest: int, least: int, *, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(kind, lang, phrase, f): MERGED rows of the whole corpus; those of LARGEST and WORDS have still to be taken together."""
    common.ship(docs.sparkSession)
    n_texts = docs.count()
    parts = 16 << (n_texts >> 20).bit_length()
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"))
    hot = hot_words(texts, n_texts)

    def make(batches):
        for lang, pieces in portions(batches, PORTION):
            yield from stripes_of(lang, pieces, longest, parts, hot.get(lang, frozenset())).to_batches(max_chunksize=20_000)

    keys = ["lang", "first", "part"]
    stripes = texts.mapInArrow(make, schema(longest))
    return stripes.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: merge(batches, longest, least), MERGED)


def with_counts(rows: DataFrame, part: str, words: DataFrame, n_words: int, longer: DataFrame, name: str) -> DataFrame:
    """rows with the count of the phrase in the column `part`."""
    single = F.instr(part, " ") == 0
    one = rows.filter(single).withColumn("_key", F.struct(F.col("lang").alias("lang"), F.col(part).alias("phrase")))
    one = common.small_join(one, words.select(F.struct("lang", "phrase").alias("_key"), F.col("f").alias(name)), "_key", 16, F.xxhash64("phrase"), size=n_words)
    more = rows.filter(~single).join(longer.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)).hint("merge"), ["lang", part])
    columns = [*rows.columns, name]
    return one.select(*columns).union(more.select(*columns))


def collocations(docs: DataFrame, *, longest: int = 3, least: int = 10, share: int = 50, top: int | None = 2000, **named) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first `top` collocations, of all if it is None."""
    found = common.stored(counts(docs, longest, least, **named)).withColumn("phrase", F.col("phrase").cast("string"))
    phrases = found.filter(f"kind = {COUNT}").select("lang", "phrase", "f")
    words, longer = phrases.filter(F.instr("phrase", " ") == 0), phrases.filter(F.instr("phrase", " ") > 0)
    n_words = words.count()

    own = F.split("phrase", " ")
    candidates = longer.select("lang", "phrase", F.col("f").alias("a"))
    cuts = candidates.withColumns({"_words": own}).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("_words") - 1)))
    cuts = cuts.withColumns({"first": F.concat_ws(" ", F.slice("_words", F.lit(1), F.col("k"))), "rest": F.concat_ws(" ", F.slice("_words", F.col("k") + 1, F.size("_words")))}).drop("_words")
    cuts = with_counts(with_counts(cuts, "first", words, n_words, longer, "l"), "rest", words, n_words, longer, "r")
    score = F.expr("cast(a as decimal(16, 0)) * 1000000 * cast(a as decimal(15, 0)) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # the words of a phrase end a phrase longer by one, or begin it
    ended = longer.filter("size(split(phrase, ' ')) > 2").select("lang", F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("phrase"), "f")
    begun = found.filter(f"kind = {LARGEST}").select("lang", "phrase", "f")
    grown = ended.union(begun).groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = lowest.join(grown.hint("merge"), ["lang", "phrase"], "left").filter(f"most is null or 100 * most < {share} * a")
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    kept = kept.withColumn("rank", rank.cast("long")) if top is None else kept.withColumn("_rank", rank).filter(f"_rank <= {top}").withColumn("rank", F.col("_rank").cast("long"))
    totals = common.stored(found.filter(f"kind = {WORDS}").groupBy("lang").agg(F.sum("f").alias("n")))
    return common.small_join(kept, totals, "lang", 16, F.xxhash64("phrase")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same rows in SQL, from all words of all pieces.
ORACLE_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
f AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS size))
  GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
s AS (
  SELECT k.lang, k.phrase, a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(w[k + 1:k.size], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
g AS (
  SELECT lang, phrase, max(a) AS most
  FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE size = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE size = 3) GROUP BY ALL),
o AS (
  SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
  FROM b LEFT JOIN g USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first collocations of every language."""
    return collocations(common.table(spark, sf_dir, "documents"))
