"""Column functions on text, hashes, paths, ids and dates. All but stem() and folded_words() stay in the JVM."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The white space of the reading semantics, as a regular-expression class body.
WHITE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
WHITES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
WORD = r"[\p{L}\p{N}]+"
#: Fixed value: Crockford's base-32 alphabet.
BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _code_points() -> Iterator[str]:
    """All characters that Unicode can take apart: none lies beyond U+2FFFF."""
    return (chr(cp) for cp in range(0xA0, 0x30000) if not 0xD800 <= cp < 0xE000)


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Composed letters and the single base letter that is left of each without its marks."""
    source, target = [], []
    for c in _code_points():
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if base != c and len(base) == 1:
            source.append(c)
            target.append(base)
    return "".join(source), "".join(target)


@lru_cache(maxsize=1)
def _slug_table() -> tuple[str, str, str, str]:
    """Characters whose compatibility decomposition holds a plain letter or digit: those that become one character, with it,
    and those that become several and a JSON map of them. All others are no part of a slug."""
    source, target, longer = [], [], {}
    for c in _code_points():
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not "\u0300" <= x <= "\u036f")
        if base != c and any(x.isascii() and x.isalnum() for x in base):
            if len(base) == 1:
                source.append(c)
                target.append(base)
            else:
                longer[c] = base
    return "".join(source), "".join(target), "".join(longer), json.dumps(longer)


@lru_cache(maxsize=1)
def _diacritics() -> str:
    """All characters with the Diacritic property, from the Unicode data in Spark's own jars."""
    marks = SparkSession.getActiveSession()._jvm.com.ibm.icu.text.UnicodeSet("[:Diacritic:]")
    ranges = [(marks.getRangeStart(i), marks.getRangeEnd(i)) for i in range(marks.getRangeCount())]
    return "".join(chr(cp) for a, b in ranges for cp in range(a, b + 1))


@lru_cache(maxsize=1)
def _unmarked_table() -> tuple[str, str]:
    """_fold_table(), and after it the characters that go: diacritics, and letters of which nothing but one is left.

    One look-up a character: a class of the regular expressions is asked range by range, some hundred a character.
    """
    marks = _diacritics()
    kept = [(c, base) for c, base in zip(*_fold_table(), strict=True) if base not in marks]
    source = "".join(c for c, _ in kept)
    gone = dict.fromkeys([*(c for c, base in zip(*_fold_table(), strict=True) if base in marks), *(c for c in marks if c not in source)])
    return source + "".join(gone), "".join(base for _, base in kept)


def fold_text(c: Column) -> Column:
    """Lower case without accents; standing diacritics go too, so that the words around them join."""
    source, target = _unmarked_table()
    marked = F.lower(F.translate(c, source, target))
    ascii_only = ~c.rlike(r"[^\x00-\x7f]")  # most texts: spares them the look-up of every character
    return F.when(ascii_only, F.lower(F.translate(c, "^`", ""))).otherwise(marked)


def fold_inflection(t: Column) -> Column:
    """Without a plural ending, then without a final vowel, where four characters remain."""
    n = F.length(t)
    singular = F.when(F.endswith(t, F.lit("es")) & (n >= 6), F.left(t, n - 2)).when(F.endswith(t, F.lit("s")) & (n >= 5), F.left(t, n - 1)).otherwise(t)
    m = F.length(singular)
    return F.when(F.right(singular, F.lit(1)).isin("a", "o", "e") & (m >= 5), F.left(singular, m - 1)).otherwise(singular)


def stem(word: str) -> str:
    """fold_inflection() of a folded word."""
    if word.endswith("es") and len(word) >= 6:
        word = word[:-2]
    elif word.endswith("s") and len(word) >= 5:
        word = word[:-1]
    return word[:-1] if len(word) >= 5 and word[-1] in "aoe" else word


def words(c: Column) -> Column:
    return F.regexp_extract_all(fold_text(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def spaced(c: Column) -> Column:
    """Folded text whose characters beyond ASCII are letters and numbers alone, for folded_words(); a text of ASCII alone stays as it is."""
    c = F.coalesce(c, F.lit(""))
    folded = F.regexp_replace(F.lower(F.translate(c, *_unmarked_table())), r"[^\x00-\x7f\p{L}\p{N}]+", " ")
    return F.when(c.rlike(r"[^\x00-\x7f]"), folded).otherwise(c)


def folded_words(text: str) -> list[str]:
    """words() of a text that spaced() gives: all its bytes beyond ASCII are parts of words."""
    return text.encode().translate(_WORD_BYTES, b"^`").decode().split()


_WORD_BYTES = bytes(c if c >= 0x80 else ord(chr(c).lower()) if chr(c).isalnum() else 0x20 for c in range(256))


def tokenize(c: Column) -> Column:
    return F.transform(words(c), fold_inflection)


def trim_white(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WHITE}]+|[{WHITE}]+$", "")


def collapse(c: Column) -> Column:
    return trim_white(F.regexp_replace(fold_text(c), f"[{WHITE}]+", " "))


def slugify(c: Column) -> Column:
    source, target, several, table = _slug_table()
    spelled = F.from_json(F.lit(table), "map<string,string>")
    wide = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(spelled[x], x)), "")
    # one look-up a character: a class of the regular expressions would be asked character by character, thousands a letter
    whole = F.when(F.translate(c, several, "") != c, wide).otherwise(c)
    plain = F.lower(F.regexp_replace(F.translate(whole, source, target), r"[\u0300-\u036F]", ""))
    slug = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.left(slug, F.lit(80)) == "", "untitled").otherwise(F.left(slug, F.lit(80)))


def canonical_body(c: Column) -> Column:
    # cut from the ends: a pattern would be tried at every white space of the text
    return F.ltrim(F.rtrim(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit(WHITES)), F.lit("\n"))


def content_fingerprint(title: Column, body: Column) -> Column:
    return F.sha2(F.concat(title, F.lit("\n\n"), canonical_body(body)).cast("binary"), 256)


def note_path(title: Column, note_id: Column, created: Column) -> Column:
    return F.concat(F.lit("notes/"), F.date_format(created, "yyyy/MM"), F.lit("/"), slugify(title), F.lit("-"), note_id, F.lit(".md"))


def ulid_time(c: Column) -> Column:
    """Milliseconds in the first ten characters of a ULID; null for a short or bad one."""
    head = F.left(c, F.lit(10))
    digit = lambda x: F.instr(F.lit(BASE32), x).cast("long") - 1
    ms = F.aggregate(F.filter(F.split(head, ""), lambda x: x != ""), F.lit(0).cast("long"), lambda acc, x: acc * 32 + digit(x))
    return F.when((F.length(c) >= 10) & head.rlike(f"^[{BASE32}]{{10}}$"), ms)


def ulid_encode_time(ms: Column) -> Column:
    digits = [F.substring(F.lit(BASE32), (F.shiftright(ms, 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for k in range(9, -1, -1)]
    return F.concat(*digits)


def is_safe_relative_path(p: Column) -> Column:
    fine = ~F.startswith(p, F.lit("/")) & ~p.rlike("^[A-Za-z]:") & ~F.contains(p, F.lit("\\")) & F.forall(F.split(p, "/"), lambda s: ~s.isin("", ".", ".."))
    return F.coalesce((p != "") & fine, F.lit(False))


def recency_bucket(ts: Column, now: Column) -> Column:
    seconds = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(ts))
    unit = lambda size, name: F.concat(F.floor(seconds / size).cast("string"), F.lit(name))
    return F.when(seconds < 60, "just now").when(seconds < 3600, unit(60, "m ago")).when(seconds < 86400, unit(3600, "h ago")).when(seconds < 7 * 86400, unit(86400, "d ago")).otherwise(F.date_format(ts, "yyyy-MM-dd"))


def quote(c: Column) -> Column:
    """A header value in double quotes, with a backslash before what needs one."""
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, spelled in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(spelled))
    for code in [*range(9), 11, 12, *range(14, 32)]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(c.rlike(r'[\x00-\x1f"\\]'), out).otherwise(c), F.lit('"'))


def unquote(c: Column) -> Column:
    """quote() undone, escape by escape; text without quotes stays as it is."""
    inner = F.substring(c, F.lit(2), F.length(c) - 2)
    tokens = F.regexp_extract_all(inner, F.lit(r"\\u[0-9a-fA-F]{4}|\\[\s\S]|[^\\]+|\\"), F.lit(0))
    code = lambda t: F.decode(F.unhex(F.substring(t, 3, 4)), "UTF-16BE")
    plain = F.array_join(
        F.transform(
            tokens,
            lambda t: F.when(F.startswith(t, F.lit("\\u")) & (F.length(t) == 6), code(t)).when(t == "\\n", "\n").when(t == "\\r", "\r").when(t == "\\t", "\t").when(F.startswith(t, F.lit("\\")) & (F.length(t) == 2), F.substring(t, 2, 1)).otherwise(t),
        ),
        "",
    )
    return F.when((F.length(c) >= 2) & F.startswith(c, F.lit('"')) & F.endswith(c, F.lit('"')), plain).otherwise(c)
