"""Evaluation passages inside of training documents."""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaktavya.llm.unify import INVISIBLE, KANNADA, LOOKALIKES, SEQUENCES, STAND_IN, TELUGU

#: Words in a row that make a leak.
WORDS = 10
#: Windows of items up to which they are sent to every executor; beyond, windows of documents that a filter of hashes lets through are joined.
BROADCAST_WINDOWS = 1_000_000
#: Bits of that filter, a power of two: 64 MB at most whatever the number of items. A tenth of the windows passes by chance at 50 million windows of items.
FILTER_BITS = 1 << 29
#: Factor of the hash of a window, which is a polynomial of the hashes of its words.
FACTOR = 0x9E3779B97F4A7C15


class Forms(dict):
    """Forms of words met so far."""

    def __init__(self, form: Callable[[str], str]) -> None:
        super().__init__()
        self.form = form

    def __missing__(self, word: str) -> str:
        if len(self) > 300_000:
            self.clear()
        found = self[word] = self.form(word)
        return found


class Folder:
    """Words of a text, without what p6 takes for looks: case, punctuation, blanks, invisible characters, look-alikes."""

    def __init__(self) -> None:
        import regex

        python = lambda cls: regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: rf"\U{int(m[1], 16):08X}", cls)
        self.unseen = regex.compile(f"[{python(INVISIBLE)}]+")
        self.stand_in = regex.compile(f"[{python(STAND_IN)}]")
        self.mixed = regex.compile(f"[{python(TELUGU)}][{python(KANNADA)}]|[{python(KANNADA)}][{python(TELUGU)}]")
        self.vowels = regex.compile("|".join(SEQUENCES))
        self.words = regex.compile(r"[\p{L}\p{M}\p{N}]+")
        self.latin = {ord(a): k for k, v in LOOKALIKES.items() for a in v}
        self.kannada = {o: o + 0x80 for o in range(0xC00, 0xC80)}
        self.known = Forms(self.word)

    def word(self, word: str) -> str:
        """One word's form."""
        if not word.isascii():
            word = unicodedata.normalize("NFKC", word)
            if self.stand_in.search(word):
                plain = word.translate(self.latin)
                word = word if self.stand_in.search(plain) else plain
            if self.mixed.search(word):
                word = word.translate(self.kannada)
            word = self.vowels.sub(lambda m: SEQUENCES[m.group()], unicodedata.normalize("NFC", word))
        return word.casefold()

    def said(self, text: str) -> tuple[list[str], str]:
        """Words of a text, and the text without invisible characters that they stand in."""
        if not text.isascii():
            text = self.unseen.sub("", text)
        return [self.known[w] for w in self.words.findall(text)], text

    def places(self, plain: str) -> list[tuple[int, int]]:
        """Where the words stand in a text without invisible characters."""
        return [m.span() for m in self.words.finditer(plain)]


def windows(words: list[str], n: int = WORDS) -> Iterator[str]:
    """Each run of n words."""
    for i in range(len(words) - n + 1):
        yield " ".join(words[i : i + n])


class Hashes(dict):
    """64-bit hashes of words met so far, and of windows of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found

    def of_windows(self, words: list[str], n: int) -> np.ndarray:
        """The hash of each run of n words."""
        size = len(words) - n + 1
        if size <= 0:
            return np.zeros(0, np.uint64)
        each = np.fromiter((self[w] for w in words), np.uint64, len(words))
        out = np.zeros(size, np.uint64)
        for k in range(n):
            out = out * np.uint64(FACTOR) + each[k : k + size]
        return out ^ (out >> np.uint64(31))


def _grams(items: list[tuple[int, str | None]], n: int) -> dict[str, tuple[int, ...]]:
    fold, found = Folder(), defaultdict(set)
    for item, text in items:
        for gram in windows(fold.said(text or "")[0], n):
            found[gram].add(item)
    return {g: tuple(sorted(i)) for g, i in found.items()}


def without_spans(text: str, places: list[tuple[int, int]], starts: Iterable[int], n: int) -> str:
    """A text without the windows of n words that begin at the words ``starts``, in order."""
    spans: list[list[int]] = []
    for i in starts:
        if spans and spans[-1][1] >= i:
            spans[-1][1] = i + n
        else:
            spans.append([i, i + n])
    clean, at = [], 0
    for a, b in spans:
        clean.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*clean, text[at:]])


def leaks(
    documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, n: int = WORDS,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """Rows (``key``, ``item_key``, n_windows, clean_text) of documents that hold n words in a row of an item.

    Words are compared without case, punctuation, blanks, line breaks and look-alike characters.
    Windows of the items form a hash set on every executor; the hash of each window of each document is looked
    up in it, and a hit is verified by its whole words. ``n_windows`` counts the
    document's windows that the item has. ``clean_text`` is the document without the spans of any
    item. If the items have more than ``broadcast_windows`` windows, only a filter of their hashes is sent; windows that
    it lets through are joined with those of the items by hash and words, and the rows are the same.

    Null, empty and short texts hold nothing and leak nothing. Repeated documents each come out;
    an item that repeats another comes out beside it. If both keys have one name, the item's is
    called ``item_<name>`` in the result.
    """
    item_column, item_key = item_key, item_key if item_key != key else f"item_{item_key}"
    wanted = items.select(F.col(item_column).alias("_item"), F.col(item_text).alias("_passage")).where("_passage IS NOT NULL")
    docs = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_text IS NOT NULL")
    kind, item_kind = dict(docs.dtypes)["_key"], dict(wanted.dtypes)["_item"]
    # blanks bound the words from above, and so the windows
    bound = wanted.agg(F.coalesce(F.sum(F.length("_passage")), F.lit(0))).first()[0]
    schema = f"{key} {kind}, {item_key} {item_kind}, n_windows int, clean_text string"
    if bound <= broadcast_windows * 8:
        grams = _grams([tuple(r) for r in wanted.collect()], n)
        hashes = Hashes()
        known = documents.sparkSession.sparkContext.broadcast((grams, np.unique(np.array([hashes.of_windows(g.split(" "), n)[0] for g in grams], np.uint64))))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fold, seen, (grams, sought) = Folder(), Hashes(), known.value
            for pdf in batches:
                rows = []
                for doc, body in zip(pdf["_key"], pdf["_text"], strict=True):
                    words, plain = fold.said(body)
                    hashed = seen.of_windows(words, n)
                    if not len(sought) or not len(hashed):
                        continue
                    at = np.searchsorted(sought, hashed)
                    hits: dict[int, int] = defaultdict(int)
                    starts = []
                    for i in np.flatnonzero(sought[np.minimum(at, len(sought) - 1)] == hashed).tolist():
                        # a hash is only a hint: the words decide
                        items = grams.get(" ".join(words[i : i + n]), ())
                        for item in items:
                            hits[item] += 1
                        if items:
                            starts.append(i)
                    if hits:
                        left = without_spans(plain, fold.places(plain), starts, n)
                        rows += [(doc, item, count, left) for item, count in sorted(hits.items())]
                yield pd.DataFrame(rows, columns=[key, item_key, "n_windows", "clean_text"])

        return docs.mapInPandas(run, schema)
    return _joined(docs, wanted, key, item_key, n, schema, item_kind)


def _filter_of(of_items: DataFrame, bits: int) -> np.ndarray:
    """A bit for each hash of a window of an item, packed; made of partial bitmaps on the executors."""
    # Spark's bitmaps count from 1, 32768 bits each
    place = F.col("_h").bitwiseAND(F.lit(bits - 1)) + 1
    parts = of_items.select(place.alias("p")).groupBy(F.bitmap_bucket_number(F.col("p")).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p"))).alias("m"))
    out = np.zeros(max(bits // 8, 4096), np.uint8)
    for r in parts.toLocalIterator():
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    return out


def _joined(docs: DataFrame, wanted: DataFrame, key: str, item_key: str, n: int, schema: str, item_kind: str) -> DataFrame:
    def of_item(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold, seen = Folder(), Hashes()
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["_item"], pdf["_passage"], strict=True):
                words = fold.said(t)[0]
                rows += zip([k] * len(words), seen.of_windows(words, n).view(np.int64).tolist(), windows(words, n), strict=False)
            yield pd.DataFrame(rows, columns=["_item", "_h", "_gram"])

    # text ids are 128 bits of a text, so repeated documents share their hits and each come out
    docs = docs.withColumn("_id", F.md5("_text"))
    of_items = wanted.mapInPandas(of_item, f"_item {item_kind}, _h bigint, _gram string").distinct()
    bits = FILTER_BITS
    sieve = docs.sparkSession.sparkContext.broadcast(_filter_of(of_items, bits))

    def of_doc(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold, seen, known = Folder(), Hashes(), sieve.value
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["_id"], pdf["_text"], strict=True):
                words = fold.said(t)[0]
                hashed = seen.of_windows(words, n)
                place = (hashed & np.uint64(bits - 1)).astype(np.int64)
                kept = np.flatnonzero((known[place >> 3] >> (place & 7).astype(np.uint8)) & 1).tolist()
                rows += [(k, i, h, " ".join(words[i : i + n])) for i, h in zip(kept, hashed[kept].view(np.int64).tolist(), strict=True)]
            yield pd.DataFrame(rows, columns=["_id", "_place", "_h", "_gram"])

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold = Folder()
        for pdf in batches:
            rows = []
            for doc, body, hits in zip(pdf["_key"], pdf["_text"], pdf["_hits"], strict=True):
                plain = fold.said(body)[1]
                left = without_spans(plain, fold.places(plain), sorted({i for h in hits for i in h["places"]}), n)
                rows += [(doc, h["_item"], len(h["places"]), left) for h in hits]
            yield pd.DataFrame(rows, columns=[key, item_key, "n_windows", "clean_text"])

    of_docs = docs.select("_id", "_text").mapInPandas(of_doc, "_id string, _place int, _h bigint, _gram string")
    hits = of_docs.join(of_items, ["_h", "_gram"]).groupBy("_id", "_item").agg(F.collect_set("_place").alias("places"))
    found = hits.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("_item", "places"))).alias("_hits"))
    return docs.join(found, "_id").select("_key", "_text", "_hits").mapInPandas(clean, schema)
