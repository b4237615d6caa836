"""Problem 10: one consistent form for text that looks the same.

A longest-match transducer over grapheme clusters.  Its table is compiled once per Python worker from Unicode's own data (compatibility
decompositions, composition, general categories) and a fixed list of look-alike letters, and is checked for conflicts: every
cluster has one target, and no target is rewritten again.  A text is read once, from left to right: the longest cluster of the table that starts at the
current place is replaced, and letters that look like Latin ones are held back until the end of their word, which decides by the Latin letters that the
word has shown.  Pure ASCII text never leaves the JVM.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from disputo.runtime import cut, small

# Letters of other alphabets and the Latin letters they look like.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "Ӏ": "I", "Ү": "Y", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ү": "y",
    "к": "k", "Ѵ": "V", "ѵ": "v",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "α": "a", "ι": "i",
    "κ": "k", "ρ": "p", "υ": "u", "ϳ": "j", "σ": "o", "γ": "y",
    # Armenian
    "Օ": "O", "Տ": "S", "Լ": "L", "օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "զ": "q",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H",
    "Ꮐ": "G", "Ꮓ": "Z", "Ꮟ": "b", "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C",
    "Ꮲ": "P", "Ꮶ": "K", "Ꮷ": "d", "Ᏼ": "B",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F",
    "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y",
    "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
# Format characters that are visible (number signs and the like), so they stay.
VISIBLE_FORMATS = frozenset([*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD])
# Characters outside the category Cf that show nothing: joiners, fillers, variation selectors.
OTHER_INVISIBLE = frozenset([0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), 0x2065, 0x3164, *range(0xFE00, 0xFE10), 0xFFA0, *range(0xE0100, 0xE01F0)])
# Control characters that are line breaks or spaces.
LINE_BREAKS = {0x85: "\n", 0x2028: "\n", 0x2029: "\n"}
CONTROL_SPACES = {0x09: " ", 0x0B: " ", 0x0C: " "}


_LETTERS = {ord(a): b for a, b in LOOKALIKES.items()}
_LATIN = re.compile("[A-Za-z" + "".join(map(chr, (0xAA, 0xBA))) + f"{chr(0xC0)}-{chr(0x24F)}{chr(0x1E00)}-{chr(0x1EFF)}]")


def _hidden() -> dict[int, str]:
    """Characters that show nothing, or are spaces and line breaks: their target.  ValueError where two rules differ."""
    rules: dict[int, str] = {}

    def add(code: int, target: str) -> None:
        if rules.setdefault(code, target) != target:
            raise ValueError(f"U+{code:04X} has two targets")

    for code in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(code))
        if kind == "Cf" and code not in VISIBLE_FORMATS or code in OTHER_INVISIBLE:
            add(code, "")
        elif kind == "Zs" and code != 0x20:
            add(code, " ")
        elif kind == "Cc" and code not in LINE_BREAKS and code not in CONTROL_SPACES and code not in (0x0A, 0x0D):
            add(code, "")
    for code, target in (LINE_BREAKS | CONTROL_SPACES).items():
        add(code, target)
    return rules


_HIDDEN = _hidden()


def target(cluster: str) -> tuple[str, str]:
    """What a cluster becomes by Unicode's rules, and what it becomes in a word with Latin letters."""
    plain = unicodedata.normalize("NFKD", cluster.translate(_HIDDEN)).translate(_HIDDEN)
    return unicodedata.normalize("NFC", plain), unicodedata.normalize("NFC", plain.translate(_LETTERS))


def compile_table() -> dict[str, tuple[str, str]]:
    """Clusters and their two targets: all single characters that change, and all decompositions of characters that compose.

    Raises ValueError if a target would be rewritten itself (the form would not be stable), or if a look-alike has another rule
    already or does not stand for one Latin letter.
    """
    table: dict[str, tuple[str, str]] = {}
    for code in [*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x10000), *range(0x10000, 0x10200), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F300), *range(0x2F800, 0x2FA20)]:
        one = chr(code)
        if unicodedata.decomposition(one) or code in _HIDDEN or code in _LETTERS:
            table[one] = target(one)
            parts = unicodedata.normalize("NFD", one)
            if parts != one:
                table[parts] = target(parts)
    for code, letter in _LETTERS.items():
        if code in _HIDDEN or len(letter) != 1 or not (letter.isascii() and letter.isalpha()) or target(chr(code))[0] != chr(code):
            raise ValueError(f"look-alike U+{code:04X} conflicts")
    for cluster, pair in table.items():
        for out in pair:
            if table.get(out, (out, out))[0] != out or target(out)[0] != out:
                raise ValueError(f"target {out!r} of {cluster!r} is rewritten itself")
    return table


_TABLE = compile_table()
_MARKS = "".join(f"{chr(c)}" for c in range(0x300, 0x1F000) if unicodedata.category(chr(c)) in ("Mn", "Mc", "Me"))
_UNSEEN = "".join(re.escape(chr(c)) for c, t in _HIDDEN.items() if t == "" and c > 0x7F)
_ON_TOP = f"[{re.escape(_MARKS)}{chr(0xFF9E)}{chr(0xFF9F)}{_UNSEEN}]"
_HANGUL = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x1100, 0x11FF), (0x3131, 0x318E), (0xA960, 0xA97C), (0xAC00, 0xD7A3), (0xD7B0, 0xD7FB), (0xFFA1, 0xFFDC)))
#: A grapheme cluster: a character with the marks on it, whatever invisible characters stand between; letters of Hangul compose with those beside them.
_CLUSTER = re.compile(rf"(?s)(?:[{_HANGUL}]+|.){_ON_TOP}*")
_PART_OF_WORD = re.compile(rf"[\w{chr(0x300)}-{chr(0x36F)}]")
#: Runs that may need a rewrite: clusters that hold a character beyond ASCII, with the ASCII letters and digits around it.
_RUN = re.compile(r"[<=>0-9A-Za-z_]*[^\x00-\x7f][0-9A-Za-z_\x80-\U0010ffff]*")
_CONTROL = re.compile(r"[\x00-\x09\x0b\x0c\x0e-\x1f\x7f]")


@lru_cache(maxsize=1 << 15)
def _read(cluster: str) -> tuple[str, str, bool, bool]:
    """The longest match for a cluster: its two targets, whether it is part of a word, whether it shows a Latin letter."""
    if cluster.isascii():
        plain, latin = cluster, cluster
    else:
        plain, latin = _TABLE.get(cluster) or target(cluster)  # clusters with several marks, or hidden characters within, follow the same rules
    return plain, latin, bool(_PART_OF_WORD.match(plain)) or not plain, bool(_LATIN.search(plain))


@lru_cache(maxsize=1 << 16)
def _rewrite(run: str) -> str:
    """One pass over a run of text: the transducer's output."""
    out: list[str] = []
    word: list[tuple[str, str]] = []
    latin = False
    for cluster in _CLUSTER.findall(run):
        plain, other, within, shows = _read(cluster)
        if within:
            word.append((plain, other))
            latin |= shows
            continue
        out.extend(pair[latin] for pair in word)
        word, latin = [], False
        out.append(plain)
    out.extend(pair[latin] for pair in word)
    return "".join(out)


def form(text: str) -> str:
    """The one form of a text (plain Python; the Spark column is :func:`consistent_form`)."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if _CONTROL.search(text):
        text = text.translate(_HIDDEN)
    return text if text.isascii() else _RUN.sub(lambda m: _rewrite(m[0]), text)


@F.arrow_udf(T.StringType())
def _form_udf(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else form(t) for t in texts.to_pylist()], type=pa.string())


_form_udf = _form_udf.asNondeterministic()  # not repeated where filters are pushed down: each text is formed once


def consistent_form(text: Column | str) -> Column:
    """``text`` with compatibility forms as plain characters, accents composed, invisible characters gone,
    every kind of space a plain space, line breaks as ``\\n``, and letters of another alphabet inside a word with Latin
    letters as the Latin letters they look like.

    NULL gives NULL, an empty text an empty text; texts of any length are taken whole.  A word wholly in
    another alphabet stays as it is.  Only texts with a character outside printable ASCII go through Python.
    """
    text = F.col(text) if isinstance(text, str) else text
    odd = F.when(text.rlike(r"[^\x20-\x7e\n]"), text)
    return F.coalesce(_form_udf(odd), text)


def words(formed: Column | str) -> Column:
    """Words of a text in its consistent form: maximal runs of letters and digits, in lower case, in order."""
    formed = F.col(formed) if isinstance(formed, str) else formed
    return F.regexp_extract_all(F.lower(formed), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def form_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per record with letters or digits: ``key``, its form's 128-bit hash and its text's 128-bit hash.

    Records that are NULL, empty or without letters and digits are left out, as they show nothing to compare.
    A key that stands in several rows with one text is one record.  Other columns of ``df`` are not read.
    """
    formed = df.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("form", consistent_form("text"))
    return cut(
        formed.where(F.col("form").rlike(r"[\p{L}\p{N}]") & F.col("key").isNotNull())
        .select("key", *_hash128("form", "form"), *_hash128("text", "text"))
        .distinct()
    )


def _hash128(column: str, name: str) -> list[Column]:
    return [F.xxhash64(column).alias(f"{name}_1"), F.xxhash64(F.lit(7), F.col(column)).alias(f"{name}_2")]


def same_form_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (``key_a`` < ``key_b``) of records whose texts differ but have the same form.

    Works on classes: a class is a form and a text, so a text that a third of all rows share meets only
    the few other texts of its form, and identical copies are never compared with each other.  Pairs come
    out expanded because that is the result asked for; use :func:`form_groups` for one row per record.
    NULL, empty and letterless texts give no pair; ties and repeated rows give each pair once.
    """
    classes = form_classes(df, key, text)
    # forms with more than one text, found by one combined aggregate; only their records go on
    ends = classes.groupBy("form_1", "form_2").agg(*[f(c).alias(f"{n}_{c}") for c in ("text_1", "text_2") for n, f in (("low", F.min), ("high", F.max))])
    several = ends.where("low_text_1 <> high_text_1 OR low_text_2 <> high_text_2").select("form_1", "form_2")
    classes = cut(classes.join(small(several), ["form_1", "form_2"]))
    texts = classes.select("form_1", "form_2", "text_1", "text_2").distinct()
    a = texts.select("form_1", "form_2", F.col("text_1").alias("a1"), F.col("text_2").alias("a2"))
    b = texts.select("form_1", "form_2", F.col("text_1").alias("b1"), F.col("text_2").alias("b2"))
    variants = a.join(b, ["form_1", "form_2"]).where("a1 < b1 OR (a1 = b1 AND a2 < b2)")
    left = classes.select("form_1", "form_2", F.col("text_1").alias("a1"), F.col("text_2").alias("a2"), F.col("key").alias("x"))
    right = classes.select("form_1", "form_2", F.col("text_1").alias("b1"), F.col("text_2").alias("b2"), F.col("key").alias("y"))
    pairs = variants.join(left, ["form_1", "form_2", "a1", "a2"]).join(right, ["form_1", "form_2", "b1", "b2"])
    return pairs.where("x <> y").select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def form_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per record: ``key``, ``group_key`` (smallest key of its form), ``n_records`` and ``n_texts`` of the form."""
    classes = form_classes(df, key, text)
    groups = classes.groupBy("form_1", "form_2").agg(
        F.min("key").alias("group_key"), F.count(F.lit(1)).alias("n_records"), F.count_distinct("text_1", "text_2").alias("n_texts")
    )
    return classes.select("key", "form_1", "form_2").join(groups, ["form_1", "form_2"]).drop("form_1", "form_2")
