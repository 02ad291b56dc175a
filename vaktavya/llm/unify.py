"""One form for texts that look alike, by SQL that runs in DuckDB inside of Arrow partitions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Latin letters and the letters of other scripts that look the same.
LOOKALIKES = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "F": "Ϝ", "G": "Ԍ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚᏦ",
    "L": "Ꮮ", "M": "МΜᎷ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "U": "Ս", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧ",
    "Y": "ҮΥ", "Z": "ΖᏃ", "a": "аα", "b": "Ьᖯ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "f": "ք", "g": "ɡց", "h": "һհ", "i": "іι", "j": "јϳ", "k": "κ",
    "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛզ", "s": "ѕ", "u": "υս", "v": "νѵ", "w": "ԝա", "x": "хχ", "y": "уγү", "z": "ᴢ",
}
#: Blocks whose letters stand in for Latin ones; two scripts that share letter shapes, 0x80 apart.
STAND_IN = r"\x{0370}-\x{03FF}\x{0400}-\x{052F}\x{0530}-\x{058F}\x{13A0}-\x{13FF}\x{0261}\x{1D22}\x{15AF}"
TELUGU, KANNADA = r"\x{0C00}-\x{0C7F}", r"\x{0C80}-\x{0CFF}"
#: Vowels that are put together of a letter and a sign, or of two signs, and the single character that looks the same.
SEQUENCES = {
    "अा": "आ", "अॆ": "ऄ", "उु": "ऊ", "एॅ": "ऍ", "एॆ": "ऎ", "एे": "ऐ", "अॉ": "ऑ", "आॅ": "ऑ", "अॊ": "ऒ", "आॆ": "ऒ", "अो": "ओ", "आे": "ओ", "अौ": "औ", "आै": "औ",
    "अॅ": "ॲ", "ाॅ": "ॉ", "ाॆ": "ॊ", "ाे": "ो", "ाै": "ौ",
    "অা": "আ", "ঋৃ": "ৠ", "ঌৢ": "ৡ",
    "અા": "આ", "અૅ": "ઍ", "અે": "એ", "અૈ": "ઐ", "અૉ": "ઑ", "આૅ": "ઑ", "અો": "ઓ", "આે": "ઓ", "અૌ": "ઔ", "આૈ": "ઔ", "ાૅ": "ૉ", "ાે": "ો", "ાૈ": "ૌ",
    "ఒౕ": "ఓ", "ఒౌ": "ఔ",
    "ಉಾ": "ಊ", "ಋಾ": "ೠ", "ಒೌ": "ಔ",
    "ഇൗ": "ഈ", "ഉൗ": "ഊ", "എെ": "ഐ", "ഒാ": "ഓ", "ഒൗ": "ഔ",
}
#: Characters without a shape, blanks of other widths, hyphens that look like the plain one.
INVISIBLE = (
    r"\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}"
    r"\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{E0000}-\x{E0FFF}"
)
BLANKS = "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 0x85, 0x2028, 0x2029]))
HYPHENS = "‐‑﹣－"


#: Bytes of text that DuckDB sees at a time.
BATCH_BYTES = 8_000_000


@cache
def viramas() -> str:
    """Signs that join Indic letters: combining class 9."""
    return "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.combining(c) == 9)


@cache
def compatibility() -> tuple[str, str, dict[str, str]]:
    """Characters with a compatibility form, and what of one character they stand for; those that stand for several."""
    one: dict[str, str] = {}
    many: dict[str, str] = {}
    for c in map(chr, range(sys.maxunicode + 1)):
        if unicodedata.decomposition(c).startswith("<") and c not in BLANKS and c not in HYPHENS:
            plain = unicodedata.normalize("NFKC", c)
            if plain != c and not any(0xAC00 <= ord(x) <= 0xD7A3 for x in plain):
                (one if len(plain) == 1 else many)[c] = plain
    return "".join(one), "".join(one.values()), many


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _class(chars: str) -> str:
    """A pattern class of these characters, runs folded to ranges."""
    points, parts = sorted(map(ord, set(chars))), []
    i = 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        parts.append(f"\\x{{{points[i]:X}}}" + (f"-\\x{{{points[j]:X}}}" if j > i else ""))
        i = j + 1
    return "".join(parts)


@cache
def setup_sql() -> list[str]:
    """DuckDB macros, one for each of STEPS."""
    froms = "".join(v for v in LOOKALIKES.values())
    tos = "".join(k * len(v) for k, v in LOOKALIKES.items())
    first, plain, many = compatibility()
    single = [(a, b) for a, b in zip(first, plain, strict=True)]
    listed = ", ".join(f"{_quoted(a)}: {_quoted(b)}" for a, b in [*single, *many.items()])
    upper = "".join(chr(o) for o in range(0xC00, 0xC80))
    lower = "".join(chr(o + 0x80) for o in range(0xC00, 0xC80))
    pairs = "t"
    for pair, one in SEQUENCES.items():
        pairs = f"replace({pairs}, '{pair}', '{one}')"
    count = lambda cls: f"len(regexp_replace(w, '[^{cls}]', '', 'g'))"
    return [
        f"SET VARIABLE forms = MAP {{{listed}}}",
        f"CREATE MACRO shown(t) AS regexp_replace(t, '([{_class(viramas())}][\\x{{200C}}\\x{{200D}}])|[{INVISIBLE}]', '\\1', 'g')",
        f"CREATE MACRO spaced(t) AS CASE WHEN regexp_matches(t, '[{_class(BLANKS + HYPHENS)}]') THEN "
        f"translate(t, {_quoted(BLANKS + HYPHENS)}, {_quoted(' ' * len(BLANKS) + '-' * len(HYPHENS))}) ELSE t END",
        f"CREATE MACRO plainly(t) AS CASE WHEN regexp_matches(t, '[{_class(first + ''.join(many))}]') THEN "
        "array_to_string(list_transform(string_split(t, ''), lambda c: coalesce(getvariable('forms')[c], c)), '') ELSE t END",
        f"CREATE MACRO latin(w) AS CASE WHEN regexp_matches(w, '[{STAND_IN}]') AND NOT regexp_matches(translate(w, {_quoted(froms)}, {_quoted(tos)}), '[{STAND_IN}]') "
        f"THEN translate(w, {_quoted(froms)}, {_quoted(tos)}) ELSE w END",
        f"CREATE MACRO twin(w) AS CASE WHEN regexp_matches(w, '[{TELUGU}]') AND regexp_matches(w, '[{KANNADA}]') THEN "
        f"CASE WHEN {count(TELUGU)} > {count(KANNADA)} THEN translate(w, {_quoted(lower)}, {_quoted(upper)}) ELSE translate(w, {_quoted(upper)}, {_quoted(lower)}) END ELSE w END",
        f"CREATE MACRO own(t) AS CASE WHEN regexp_matches(t, '[{STAND_IN}]|[{TELUGU}][{KANNADA}]|[{KANNADA}][{TELUGU}]') THEN "
        "array_to_string(list_transform(string_split(t, ' '), lambda w: twin(latin(w))), ' ') ELSE t END",
        f"CREATE MACRO whole(t) AS CASE WHEN regexp_matches(t, '{'|'.join(SEQUENCES)}') THEN {pairs} ELSE t END",
    ]


#: The mapping's steps, in order.
STEPS = ("shown", "spaced", "plainly", "own", "nfc_normalize", "whole")


def unifying_sql(columns: Sequence[str]) -> str:
    """SQL that maps the columns of a table ``texts``: a step sees what the one before it gave, so none is computed twice."""
    source = "texts"
    for step in STEPS:
        source = f"(SELECT {', '.join(f'{step}({c}) AS {c}' for c in columns)} FROM {source})"
    return f"SELECT * FROM {source}"


def connection():
    """An in-memory DuckDB of one thread with the macros."""
    import duckdb

    # without a folder to spill to: batches are small, and a worker's own disk isn't to be used
    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
    for sql in setup_sql():
        con.execute(sql)
    return con


def _bounded(batch: pa.RecordBatch, columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most BATCH_BYTES of text, one row at least."""
    if batch.num_rows < 2 or sum(batch.column(c).nbytes for c in columns) <= BATCH_BYTES:
        yield batch
    else:
        half = batch.num_rows // 2
        for part in (batch.slice(0, half), batch.slice(half)):
            # a slice counts the bytes of its own rows only
            yield from _bounded(part, columns)


def unify(df: DataFrame, *columns: str, suffix: str = "_unified") -> DataFrame:
    """``df`` with a column ``<name>_unified`` for each of ``columns``: the one form of texts that look alike.

    Invisible characters go, except a joiner right after a virama, which is spelling. Other blanks
    become U+0020; tabs and line breaks stay. Compatibility and full-width forms become plain ones,
    hyphens that look plain become ``-``. A word whose letters of a stand-in script all look like
    Latin ones becomes Latin; words that mix Telugu and Kannada take the script of more of their
    characters (Kannada in ties). Indic vowels put together of parts become the one letter or sign. The result is in NFC. Two texts are equal then and only then
    if they agree in all else; a text that has its one form comes back as it is.

    Null stays null, empty stays empty. Row order, other columns and repeats stay. A column of ``df``
    that has the name of a result column is replaced.
    """
    df = df.drop(*(c + suffix for c in columns))
    schema = T.StructType([*df.schema.fields, *(T.StructField(c + suffix, T.StringType()) for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connection()
        for batch in (part for whole in batches for part in _bounded(whole, columns)):
            texts = pa.table({f"c{i}": batch.column(c).cast(pa.large_string()) for i, c in enumerate(columns)})
            con.register("texts", texts)
            found = con.sql(unifying_sql(texts.column_names)).to_arrow_table()
            con.unregister("texts")
            arrays = [c.combine_chunks().cast(pa.string()) if c.num_chunks else pa.array([], pa.string()) for c in found.columns]
            arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *(c + suffix for c in columns)])

    return df.mapInArrow(run, schema)


def odd_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """The rows (``key``, ``text``, ``text_unified``) whose text isn't in its one form."""
    rows = df.select(*dict.fromkeys((key, text))).where(F.col(text).isNotNull())
    return unify(rows, text).where(F.col(text) != F.col(f"{text}_unified"))
