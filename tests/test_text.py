"""Column functions on text, ids, paths and vectors."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.operators import chunking, embedding


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "folded"),
    [("Reunión", "reunion"), ("AÑO", "ano"), ("Ça va", "ca va"), ("a^b `c´ d·e", "ab c de"), ("ﬁx", "ﬁx"), ("é" + "́", "e"), ("Ḉ", "c"), ("", "")],
)
def test_fold(spark, text, folded):
    assert one(spark, T.fold_text(F.col("t")), t=text) == folded


@pytest.mark.parametrize(("word", "stem"), [("recetas", "recet"), ("panes", "pane"), ("flores", "flor"), ("mesa", "mesa"), ("casas", "casa"), ("as", "as"), ("pescado", "pescad"), ("marzo", "marz")])
def test_inflection(spark, word, stem):
    assert one(spark, T.fold_inflection(F.col("t")), t=word) == stem


def test_tokenize_keeps_order_and_repeats(spark):
    assert one(spark, T.tokenize(F.col("t")), t="Marzo, marzo: día 5 — Ωmega_x") == ["marz", "marz", "dia", "5", "ωmeg", "x"]


@pytest.mark.parametrize(("title", "slug"), [("Hello, World!", "hello-world"), ("  --  ", "untitled"), ("Çà & là", "ca-la"), ("x" * 100, "x" * 80), ("日本", "untitled")])
def test_slug(spark, title, slug):
    assert one(spark, T.slugify(F.col("t")), t=title) == slug


@pytest.mark.parametrize(("body", "want"), [("\r\n\na\r\nb \n\n", "a\nb"), ("", ""), ("x\u00a0 ", "x"), ("  kept", "  kept"), ("\n\n", "")])
def test_canonical_body(spark, body, want):
    got = one(spark, T.canonical_body(F.col("t")), t=body)
    assert got == want and one(spark, T.canonical_body(F.col("t")), t=got) == want


@pytest.mark.parametrize(("path", "safe"), [("a/b.md", True), ("", False), ("/a", False), ("C:/a", False), ("a//b", False), ("a/../b", False), ("./a", False), ("a\\b", False), ("a/..b", True)])
def test_safe_path(spark, path, safe):
    assert one(spark, T.is_safe_relative_path(F.col("t")), t=path) is safe


@pytest.mark.parametrize(("id_", "ms"), [("01ARZ3NDEKTSV4RRFFQ69G5FAV", 1469922850259), ("01ARZ3NDE", None), ("01ARZ3NDEI", None), ("0000000000", 0)])
def test_ulid(spark, id_, ms):
    assert one(spark, T.ulid_time(F.col("t")), t=id_) == ms


def test_ulid_round_trip(spark):
    ms = F.col("id") * 7919 * 86400123
    rows = spark.range(200).select(ms.alias("a"), T.ulid_time(T.ulid_encode_time(ms)).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows)


@pytest.mark.parametrize("title", ['a "b" c', "tab\there", "back\\slash", "\\n stays", "line\nend\r", "\x01\x1f", "", "é\\u00e9"])
def test_quotes_come_off_again(spark, title):
    assert one(spark, T.unquote(T.quote(F.col("t"))), t=title) == title


def slow_chunks(text, size, overlap):
    import re

    spans = [m.span() for m in re.finditer(r"[^\s﻿]+", text)]
    out, start = [], 0
    while spans:
        part = spans[start : start + size]
        out.append((len(out), text[part[0][0] : part[-1][1]], part[0][0], part[-1][1] - part[0][0]))
        if start + size >= len(spans):
            return out
        start += size - overlap
    return out


@pytest.mark.parametrize(("size", "overlap"), [(120, 24), (100, 20), (5, 2), (3, 0), (7, 6)])
def test_chunks_equal_a_plain_loop(spark, size, overlap):
    texts = ["", "   ", "one", "\n lead  in  two ", " ".join(f"w{i}" for i in range(500)), "a\u00a0b\u3000c\ufeffd e", " ".join("x" * (i % 5 + 1) for i in range(121)), "\n".join("ab" for _ in range(13))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {}
    for r in chunking.chunk_text(df, "t", ["i"], size, overlap).collect():
        got.setdefault(r["i"], []).append((r["idx"], r["text"], r["offset"], r["length"]))
    assert {k: sorted(v) for k, v in got.items()} == {i: slow_chunks(t, size, overlap) for i, t in enumerate(texts) if t.strip()}


def test_chunk_windows_must_move():
    with pytest.raises(ValueError):
        chunking.chunks(F.col("t"), 5, 5)


def test_three_hashing_embedders_agree(spark):
    texts = ["The cat sat", "", "año é 12 12 THE", "word " * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "note_id int, input string").repartition(2)
    by_expression = {r["note_id"]: r["v"] for r in df.select("note_id", V.hash_embed(F.col("input"), 16).alias("v")).collect()}
    by_model = {r["note_id"]: r["embedding"] for r in embedding.embed_chunks(df, embedding.HashingEmbedder(16)).collect()}
    by_join = {r["note_id"]: r["embedding"] for r in embedding.hash_embedded(df, 16, ["note_id"]).collect()}
    for i in range(4):
        assert by_expression[i] == pytest.approx(by_model[i]) and by_join[i] == pytest.approx(by_model[i])


def test_vectors(spark):
    assert one(spark, V.dot(F.col("a"), F.col("b")), a=[1.0, 2.0, 3.0], b=[4.0, 5.0]) == 14.0
    assert one(spark, V.l2_normalize(F.col("a")), a=[3.0, 4.0]) == [0.6, 0.8] and one(spark, V.l2_normalize(F.col("a")), a=[0.0, 0.0]) == [0.0, 0.0]


def test_composed_letters_of_all_planes(spark):
    import unicodedata

    from pyspark.sql import functions as F

    from corpusloom.functions import text as T

    rows = spark.createDataFrame([("がぎ ﬁne ﾊﾟ",), ("Ⅷ ﬁn ½ ｆｕｌｌ ① ㎏",), ("Crème brûlée",)], "t string")
    folded, slugs = zip(*((r["f"], r["s"]) for r in rows.select(T.fold_text(F.col("t")).alias("f"), T.slugify(F.col("t")).alias("s")).collect()), strict=True)
    assert folded[0].startswith("かき") and folded[2] == "creme brulee"
    plain = lambda t: "-".join("".join(c if c.isascii() and c.isalnum() else " " for c in "".join(x for x in unicodedata.normalize("NFKD", t) if not "̀" <= x <= "ͯ").lower()).split())
    assert list(slugs) == [plain(r["t"]) for r in rows.collect()]


def test_fold_looks_characters_up_once_each(spark):
    """All characters fold as by a class of diacritics after the table, without that class: it is asked range by range."""
    c = F.col("c")
    points = [cp for cp in range(1, 0x30000) if not 0xD800 <= cp < 0xE000]
    texts = spark.createDataFrame([("".join(map(chr, points[at : at + 64])),) for at in range(0, len(points), 64)], "c string")
    marks = "[" + "".join(f"\\x{{{ord(x):x}}}" for x in T._diacritics()) + "]"
    plain = F.when(~c.rlike(r"[^\x00-\x7f]"), F.lower(F.translate(c, "^`", ""))).otherwise(F.lower(F.regexp_replace(F.translate(c, *T._fold_table()), marks, "")))
    folded = texts.select(T.fold_text(c).alias("new"), plain.alias("old"))
    assert folded.filter("new <> old").count() == 0
    assert "regexp_replace" not in texts.select(T.fold_text(c))._jdf.queryExecution().optimizedPlan().toString()


def test_hashed_words_stay_in_their_task(spark):
    """Rows of one key are one vector, as the words of both; no row is made for a word, and a vector's length is computed once."""
    df = spark.createDataFrame([(1, "the cat"), (1, "sat the"), (2, None)], "note_id int, input string").repartition(2)
    out = embedding.hash_embedded(df, 16, ["note_id"])
    got = {r["note_id"]: r["embedding"] for r in out.collect()}
    whole = embedding.HashingEmbedder(16).embed(["the cat sat the", ""])
    assert got[1] == pytest.approx(whole[0]) and got[2] == whole[1] == [0.0] * 16
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("SQRT") == 1


def test_a_draw_names_its_steps_once(spark):
    """Steps of the generator are bound, so that no number is computed many times over: the expression stays small."""
    from corpusloom.operators import generate

    plan = spark.range(1).select(generate.draw(F.col("id"), 1))._jdf.queryExecution().analyzed().toString()
    assert plan.count("id#") < 10


def test_slugs_ask_no_class_of_thousands(spark):
    df = spark.createDataFrame([("\u00bd Fjord \u2460\u249c x\ufb01n \u01c4",), ("plain",), ("Ünï",), (None,)], "t string").select(T.slugify(F.col("t")).alias("s"))
    assert [r["s"] for r in df.collect()] == ["1-2-fjord-1-a-xfin-dz", "plain", "uni", None]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not any(len(part) > 200 for part in plan.split("RLIKE")[1:]) and "RLIKE(t" not in plan


def test_canonical_bodies_take_time_by_their_length(spark):
    """Ends are cut, white space inside stays; a long run of it isn't tried from each of its places."""
    import hashlib
    import time

    inner = "a" + " " * 400_000 + "b\r\n\n c"
    rows = [(inner + "　\r\n ﻿",), ("\r\n\n \n x\u0085 ",), ("\r\n\t\r\n",), ("",), (None,)]
    began = time.monotonic()
    got = [r[0] for r in spark.createDataFrame(rows, "body string").coalesce(1).select(T.content_fingerprint(F.lit("t"), F.col("body"))).collect()]
    assert time.monotonic() - began < 30
    want = [inner.replace("\r\n", "\n"), " \n x\u0085", "", ""]
    assert got == [*(hashlib.sha256(f"t\n\n{w}".encode()).hexdigest() for w in want), None]


def test_words_of_plain_and_other_texts_are_embedded_alike():
    import regex

    from corpusloom.functions.text import WORD
    from corpusloom.operators import embedding

    model, texts = embedding.HashingEmbedder(8), ["Plain text_of 12 a-b", "Straße ΑΒΓ naïve ４２", "", "plain ÎLE", "KK"]
    for kept in (embedding.MOST_CODES, -1):  # codes kept from batch to batch, and dropped
        embedding.MOST_CODES, most = kept, embedding.MOST_CODES
        got = [model.counts([t]).tolist()[0] for t in texts]
        embedding.MOST_CODES = most
        for text, row in zip(texts, got, strict=True):
            want = [0.0] * 8
            for word in regex.findall(WORD, text.lower()):
                code = embedding._Codes(8)[word]
                want[code // 2] += -1 if code % 2 else 1
            assert row == want
