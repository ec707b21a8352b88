"""Visually identical text with different characters.

The skeleton of a text: decompose, replace every character by its prototype
from the look-alike table, decompose again. Texts look the same exactly if
their skeletons are equal. Prototypes: width forms and mathematical letters
stand for the plain character, every kind of blank for a space, line ends for
one kind of line end; invisible characters vanish; look-alike letters of other
scripts stand for the Latin letter. Ligatures, digraphs, Roman numerals, dot
leaders and Kangxi radicals stand for what Unicode's data says they are made of.

Kept apart, since a reader tells them apart: letters that merely resemble each
other within a script (O and 0, l and 1), other cases of a letter, letters
without their dot or accent (dotless i, Greek iota), small letters of other
scripts in the form of capitals or with another stroke (Cyrillic ka, te, em,
Greek alpha, kappa, eta, Cyrillic omega), small capitals, raised and lowered,
circled and squared signs, typographic quotes, and dashes of other lengths.

``same_look_pairs`` groups by skeleton without bringing a group together: the
texts are reduced to distinct (skeleton, text) classes with a map-side combine,
only skeletons with several texts go on, classes are paired, and members join
their class pair at the end. A text copied a million times is one class, so the
pairs that are formed are pairs of the result.

Defined cases: null texts have no skeleton; texts whose skeleton is blank are
in no pair; equal texts are no pair; an empty table gives no rows. Whole texts
are processed, whatever their length.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.session import materialize

# Letters of other scripts and the Latin letters that they look like.
LOOKALIKES = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V",
    "а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ү": "y",
    # Armenian
    "օ": "o", "Օ": "O", "ս": "u", "հ": "h", "ց": "g", "ո": "n",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Coptic
    "Ⲁ": "A", "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Latin letters of phonetic writing
    "ɡ": "g", "ɑ": "a",
    # hyphens, strokes, dots
    "‐": "-", "‑": "-", "−": "-", "˗": "-", "⁄": "/", "∕": "/", "∶": ":", "꞉": ":", "⋅": "·", "∙": "·", "‧": "·", "ʼ": "’",
}
#: Compatibility decompositions that keep the look: width forms, non-breaking forms, letters in another font.
LOOK_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<font>")
#: Kinds of characters whose other compatibility decompositions keep the look, by the first words of their names.
MADE_OF = ("KANGXI RADICAL", "ROMAN NUMERAL", "SMALL ROMAN NUMERAL", "HORIZONTAL ELLIPSIS", "TWO DOT LEADER", "ONE DOT LEADER", "MICRO SIGN", "ALEF SYMBOL", "BET SYMBOL", "GIMEL SYMBOL", "DALET SYMBOL")
LINE_ENDS = "\n\r\x0b\x0c\x85\u2028\u2029"
#: Characters without a look besides those of category Cf and Cc.
BLANK_MARKS = [(0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF)]
#: Visible signs within category Cf.
SHOWN = [(0x0600, 0x0605), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x08E2, 0x08E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD)]


def prototype(c: str) -> str:
    """What stands for a character in the skeleton; empty for invisible ones."""
    n = ord(c)
    if n < 128:
        return c if n >= 32 and n != 127 else "\n" if c in LINE_ENDS else " " if c == "\t" else ""
    if c in LINE_ENDS:
        return "\n"
    kind = unicodedata.category(c)
    if any(a <= n <= b for a, b in BLANK_MARKS) or kind == "Cc" or (kind == "Cf" and not any(a <= n <= b for a, b in SHOWN)):
        return ""
    if kind == "Zs":
        return " "
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    tag, _, rest = unicodedata.decomposition(c).partition(" ")
    if tag in LOOK_TAGS or (tag == "<compat>" and _made_of(c, rest)):
        return "".join(prototype(chr(int(x, 16))) for x in rest.split())
    return c


def _made_of(c: str, rest: str) -> bool:
    """Whether a compatibility decomposition only takes a ligature or a digraph apart, or is of a kind that keeps the look."""
    parts = [chr(int(x, 16)) for x in rest.split()]
    return unicodedata.name(c, "").startswith(MADE_OF) or (len(parts) > 1 and unicodedata.category(c)[0] == "L" and all(unicodedata.category(p)[0] in "LM" for p in parts))


class _Table(dict):
    """Prototypes by code point, worked out as characters turn up."""

    def __missing__(self, n: int) -> str:
        self[n] = out = prototype(chr(n))
        return out


_TABLE = _Table()
_CRLF = re.compile(r"\r\n")
_RUNS = re.compile(r" *\n *")


def skeleton(text: str) -> str:
    """The text's skeleton: equal for texts that look the same."""
    if text.isascii() and text.isprintable():
        return text.strip(" ")
    s = unicodedata.normalize("NFD", _CRLF.sub("\n", text)).translate(_TABLE)
    s = unicodedata.normalize("NFD", s)
    return _RUNS.sub("\n", s).strip(" \n")


def consistent_form(text: str | None) -> str | None:
    """The one form of a text, composed; None for null."""
    return None if text is None else unicodedata.normalize("NFC", skeleton(text))


def _digest(s: str) -> bytes:
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _look(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        keep, look, exact = [], [], []
        for i, t in enumerate(batch.column(1).to_pylist()):
            if t is None:
                continue
            s = skeleton(t)
            if s:
                keep.append(i)
                look.append(_digest(s))
                exact.append(_digest(t))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(look, pa.binary()), pa.array(exact, pa.binary())], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def looks(documents: DataFrame) -> DataFrame:
    """(doc_id, look, exact): 128-bit digests of each text's skeleton and of the text itself."""
    ddl = "doc_id long, look binary, exact binary"
    schema = _arrow(ddl)
    return documents.select("doc_id", "text").mapInArrow(lambda it: _look(it, schema), ddl)


def same_look_pairs(documents: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b): pairs of documents that look the same and differ in a character."""
    rows = materialize(looks(documents))
    classes = rows.groupBy("look", "exact").agg(F.count("*").alias("n"))
    several = classes.groupBy("look").agg(F.count("*").alias("k")).where("k > 1").select("look")
    texts = classes.select("look", "exact").join(several, "look", "left_semi")
    a, b = texts.withColumnRenamed("exact", "exact_a"), texts.withColumnRenamed("exact", "exact_b")
    pairs = a.join(b, "look").where("exact_a < exact_b").select("exact_a", "exact_b")
    left = rows.select(F.col("doc_id").alias("d_a"), F.col("exact").alias("exact_a"))
    right = rows.select(F.col("doc_id").alias("d_b"), F.col("exact").alias("exact_b"))
    return pairs.join(left, "exact_a").join(right, "exact_b").select(F.least("d_a", "d_b").alias("doc_id_a"), F.greatest("d_a", "d_b").alias("doc_id_b"))


def same_look_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_texts): every document with a skeleton that isn't blank, its class (the least doc_id that looks the same), and how many different texts look like that."""
    rows = materialize(looks(documents))
    texts = rows.groupBy("look", "exact").agg(F.min("doc_id").alias("least"))
    classes = texts.groupBy("look").agg(F.min("least").alias("class_id"), F.count("*").alias("n_texts"))
    return rows.join(classes, "look").select("doc_id", "class_id", "n_texts")


def consistent_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, form): the consistent form of every text; null for null."""
    ddl = "doc_id long, form string"
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [consistent_form(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string())], schema=schema)

    return documents.select("doc_id", "text").mapInArrow(run, ddl)
