"""Per-document text statistics: one Arrow pass, all documents of a block at once over their code points."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the common-words table: it is fixed and small, and its words travel with the plan.
MAX_COMMON_WORDS = 10_000
#: Code points handled at once; a longer document is a block of its own.
BLOCK_CHARS = 400_000

SIZES = ("n_chars", "n_words", "n_lines")
#: The statistics that rules may test; the sizes above say nothing about what a text is.
SHARES = (
    "mean_word_length",
    "longest_run",
    "long_share",
    "repeat_ratio",
    "common_share",
    "symbol_ratio",
    "digit_ratio",
    "letter_ratio",
    "odd_ratio",
    "accent_ratio",
    "tag_ratio",
    "link_ratio",
    "hash_ratio",
    "number_share",
    "hard_share",
    "ends_share",
    "bullet_share",
    "cell_share",
    "mark_share",
    "shape_share",
    "bare_short_share",
    "short_lines",
    "bare_share",
    "distinct_share",
    "words_per_line",
    "commas_per_word",
)
FEATURES = SIZES + SHARES

_SPACE, _LETTER, _MARK, _NUMBER, _OTHER = range(5)
_INVISIBLE = "​‌‍‎‏⁠﻿­"
_CLOSERS, _ENDS = "\"'”»)]*_", ".!?…。！？"
_VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüýÿаеёиоуыэюя"
#: Marks that may divide a line into cells.
_CELL_MARKS = "\t|;,~=:/&"

_QUOTE = re.compile(r"(?m)^[ \t]*(?:[>|][ \t]?)+(?=[^\n]*[^|\s][ \t]*$)")
_SIGNATURE = re.compile(r"\n[>| \t]*(?:--[ \t]*\n(?:[>| \t]*_{5,}[ \t]*\n)?|_{5,}[ \t]*\n)[^\n]*\s*\Z")
_LIGHT = re.compile(r"(?i)\[/?(?:quote|color|url|b|i|u|size|img)(?:=[^\]\n]*)?\]|</?(?:blockquote|span|div|p|br|i|b|a|em|strong|font|u)\b[^>\n]*>|&(?:nbsp|amp|quot|lt|gt|#\d+);")
_TAGS = re.compile(r"(?i)</?(?!li\b|td\b|tr\b|th\b|table\b)[a-z][^>\n]*>|\[/?(?!list\b)[a-z]{1,8}(?:=[^\]\n]*)?\]|&(?:[a-z]{2,6}|#\d+);")
_LINKS = re.compile(r"(?i)https?://\S+|www\.\S+")
_HASH = re.compile(r"(?:^|\s)[#@][^\W_][\w]*")


def common_words(table: DataFrame) -> tuple[list[str], list[str]]:
    """(words of languages written with spaces, words of those without) from the fixed table of common words."""
    rows = table.where(F.col("word").isNotNull()).select(F.lower("word").alias("word")).distinct().orderBy("word").limit(MAX_COMMON_WORDS + 1).collect()
    if len(rows) > MAX_COMMON_WORDS:
        raise ValueError("too many common words for a literal set")
    words = [r["word"] for r in rows]
    dense = [w for w in words if any("぀" <= ch <= "ヿ" or "一" <= ch <= "鿿" for ch in w)]
    return [w for w in words if w not in set(dense)], dense


class Tables:
    """Look-up tables over code points, built once per process from the character database."""

    def __init__(self) -> None:
        n = 0x110000
        kind = np.full(n, _OTHER, dtype=np.uint8)
        lower = np.arange(n, dtype=np.uint32)
        first = {"L": _LETTER, "M": _MARK, "N": _NUMBER, "Z": _SPACE}
        for i in [*range(0xD800), *range(0xE000, 0x20000)]:
            ch = chr(i)
            kind[i] = first.get(unicodedata.category(ch)[0], _OTHER)
            low = ch.lower()
            if len(low) == 1:
                lower[i] = ord(low)
        kind[0x20000:0x32000] = _LETTER
        kind[[9, 10, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 0x85]] = _SPACE
        self.kind, self.lower = kind, lower
        self.dense = self._flags([(0x3040, 0x3100), (0x3400, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000)])
        self.wide = self.dense | self._flags([(0x3000, 0x3040), (0xFF00, 0xFFF0)])
        self.closer, self.end, self.vowel, self.hidden = (self._set(s) for s in (_CLOSERS, _ENDS, _VOWELS, _INVISIBLE))
        self.opener = self._set("\"'([{<@#¿¡…$€£«“„‘.,;:!?/\\%&")
        # What bytes of UTF-8 look like when each is read as a character: leading and continuing bytes.
        wrong = {bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xC0)} | {chr(b) for b in (*range(0x80, 0xC0), 0xC2, 0xC3, 0xC4, 0xC5, 0xD0, 0xD1, 0xE2, 0xE3, 0xFFFD)}
        self.odd = self._set("".join(wrong))
        self.accent = self._flags([(0xC0, 0xD7), (0xD8, 0xF7), (0xF8, 0x100)])
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, dtype=np.uint64))

    @staticmethod
    def _flags(ranges: list[tuple[int, int]]) -> np.ndarray:
        out = np.zeros(0x110000, dtype=bool)
        for a, b in ranges:
            out[a:b] = True
        return out

    def _set(self, chars: str) -> np.ndarray:
        out = np.zeros(0x110000, dtype=bool)
        out[[ord(c) for c in chars]] = True
        return out

    def hashes(self, codes: np.ndarray, starts: np.ndarray, place: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each word; place is the position of each character within its word."""
        with np.errstate(over="ignore"):
            mixed = (self.lower[codes].astype(np.uint64) + np.uint64(0x51ED27)) * self.power[place & 4095]
            return np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), starts) if len(starts) else np.zeros(0, dtype=np.uint64)


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _word_hash(word: str) -> int:
    c = _codes(word)
    return int(tables().hashes(c, np.array([0]), np.arange(len(c)))[0])


def word_hashes(words: list[str]) -> np.ndarray:
    """Sorted hashes of words, as statistics() takes them."""
    return np.unique(np.array([_word_hash(w) for w in words], dtype=np.uint64))


def _prepare(text: str) -> tuple[str, float, float, float]:
    """(text without quote marks, light markup and a closing signature, characters in tags, in links, hash words)."""
    tags = links = marks = 0
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "--" in text or "_____" in text:
        text = _SIGNATURE.sub("", text)
    if "<" in text or "[" in text or "&" in text:
        tags = sum(len(x) - x.count(" ") for x in _TAGS.findall(text))
    if ">" in text or "|" in text:
        text = _QUOTE.sub("", text)
    if tags:
        text = _LIGHT.sub("", text)
    if "://" in text or "www." in text.lower():
        links = sum(len(x) for x in _LINKS.findall(text))
    if "#" in text or "@" in text:
        marks = len(_HASH.findall(text))
    return text, tags, links, marks


def _modal_share(line_doc: np.ndarray, value: np.ndarray, use: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Per document the share of its lines that have the most frequent value, of the lines in ``use``."""
    out = np.zeros(len(lines))
    if use.any():
        key = np.stack([line_doc[use].astype(np.uint64), value[use].astype(np.uint64)], axis=1)
        order = np.lexsort((key[:, 1], key[:, 0]))
        key = key[order]
        first = np.ones(len(key), dtype=bool)
        first[1:] = (key[1:] != key[:-1]).any(axis=1)
        count = np.diff(np.append(np.flatnonzero(first), len(key)))
        np.maximum.at(out, key[first, 0].astype(np.int64), count)
    return np.where(lines >= 3, out / np.maximum(lines, 1), 0.0)


def statistics(texts: list[str | None], spaced: np.ndarray, dense: list[str]) -> np.ndarray:
    """A row of FEATURES for each text; ``spaced`` are the sorted hashes of common words, ``dense`` those without spaces."""
    t = tables()
    ready = [_prepare(x or "") for x in texts]
    n_docs = len(ready)
    codes = _codes("\n".join(r[0] for r in ready) + "\n")
    doc = np.repeat(np.arange(n_docs), [len(r[0]) + 1 for r in ready])
    shown = ~t.hidden[codes]
    if not shown.all():
        codes, doc = codes[shown], doc[shown]
    kind = t.kind[codes]
    space = kind == _SPACE
    newline = codes == 10
    line = np.cumsum(newline) - newline
    n_lines_all = int(line[-1]) + 1
    line_doc = np.zeros(n_lines_all, dtype=np.int64)
    line_doc[line] = doc
    at = np.arange(len(codes))
    solid = np.flatnonzero(~space)
    per_doc = lambda where, weight=None: np.bincount(doc[where], weight, n_docs)
    per_line = lambda where: np.bincount(line[where], minlength=n_lines_all)
    chars = per_doc(solid).astype(float)

    # Words: runs of letters, marks and numbers.
    inner = (kind == _LETTER) | (kind == _MARK) | (kind == _NUMBER)
    begin = inner.copy()
    begin[1:] &= ~inner[:-1]
    starts = np.flatnonzero(begin)
    member = np.flatnonzero(inner)
    word_of = np.cumsum(begin)[member] - 1
    rel = np.searchsorted(member, starts)
    hashes = t.hashes(codes[member], rel, member - starts[word_of]) if len(starts) else np.zeros(0, dtype=np.uint64)
    size = np.bincount(word_of, minlength=len(starts))
    letters_in = np.bincount(word_of, kind[member] == _LETTER, len(starts))
    digits_in = np.bincount(word_of, kind[member] == _NUMBER, len(starts))
    vowels_in = np.bincount(word_of, t.vowel[t.lower[codes[member]]], len(starts))
    dense_in = np.bincount(word_of, t.dense[codes[member]], len(starts)) > 0
    if len(spaced):
        place = np.minimum(np.searchsorted(spaced, hashes), len(spaced) - 1)
        hit = spaced[place] == hashes
    else:
        hit = np.zeros(len(starts), dtype=bool)
    word_line, word_doc = line[starts], doc[starts]
    thick = np.flatnonzero(t.dense[codes])
    thick_line = per_line(thick)
    n_line = np.bincount(word_line, minlength=n_lines_all) + thick_line // 2
    c_line = np.bincount(word_line, hit, n_lines_all)
    for w in dense if len(thick) else ():
        c = _codes(w)
        spot = np.flatnonzero(codes[: len(codes) - len(c) + 1] == c[0])
        for k in range(1, len(c)):
            spot = spot[codes[spot + k] == c[k]]
        c_line = c_line + np.bincount(line[spot], minlength=n_lines_all)
    n_words = np.bincount(word_doc, minlength=n_docs)
    total_words = np.bincount(line_doc, n_line, n_docs)
    total_common = np.bincount(line_doc, c_line, n_docs)

    # Lines: first and last visible character.
    real = per_line(solid) > 0
    lines = np.bincount(line_doc[real], minlength=n_docs)
    last = np.zeros(n_lines_all, dtype=np.int64)
    last[line[solid]] = solid
    first = np.zeros(n_lines_all, dtype=np.int64)
    first[line[solid[::-1]]] = solid[::-1]
    tail = last
    for _ in range(4):
        tail = np.where(t.closer[codes[tail]] & (tail > first), tail - 1, tail)
    ends = real & t.end[codes[tail]]
    ahead = lambda i, k: codes[np.minimum(i + k, len(codes) - 1)]
    blank = lambda i, k: (kind[np.minimum(i + k, len(codes) - 1)] == _SPACE) & (ahead(i, k) != 10)
    number = lambda i, k: (ahead(i, k) >= 48) & (ahead(i, k) <= 57)
    c0, c1, c2 = (ahead(first, k) for k in range(3))
    bullet = (kind[first] == _OTHER) & ~t.opener[c0] & blank(first, 1)
    p = first + (c0 == 40)
    d1 = number(p, 0)
    d2 = d1 & number(p, 1)
    d3 = d2 & number(p, 2)
    q = p + d1 + d2 + d3
    one_letter = ~d1 & (t.kind[ahead(p, 0)] == _LETTER) & (ahead(p, 1) == 41)
    q = np.where(one_letter, p + 1, q)
    bullet |= (d1 | one_letter) & ((ahead(q, 0) == 46) | (ahead(q, 0) == 41)) & blank(q, 1)
    bullet |= (c0 == 91) & ((c1 == 93) | ((c2 == 93) & ((c1 == 32) | (c1 == 42) | (c1 == 88) | (c1 == 120))))
    bullet |= (c0 == 60) & (c1 == 108) & (c2 == 105)
    few = c_line * 10 <= n_line

    # Marks that divide lines into cells, and how alike the lines of a document are in them.
    prev = np.concatenate([[10], codes[:-1]])
    prev_space = np.concatenate([[True], space[:-1]])
    next_space = np.concatenate([space[1:], [True]])
    gap = space & ~newline & prev_space & ~next_space & (prev != 10) & (at > first[line])
    leader = (codes == 46) & (prev == 46)
    leader &= ~(np.concatenate([codes[1:], [10]]) == 46)
    marks = np.zeros(n_lines_all)
    alike = np.zeros(n_docs)
    for ch in _CELL_MARKS:
        spots = np.flatnonzero(codes == ord(ch))
        if not len(spots):
            continue
        if ch in ",;/":
            inside = ~next_space[spots]
        elif ch == ":":
            inside = next_space[spots] | ~((kind[np.maximum(spots - 1, 0)] == _NUMBER))
        else:
            inside = np.ones(len(spots), dtype=bool)
        count = per_line(spots)
        alike = np.maximum(alike, _modal_share(line_doc, count, (count > 0) & few, lines))
        marks += np.bincount(line[spots[inside]], minlength=n_lines_all) * (2 if ch == "\t" else 1)
    gaps = per_line(np.flatnonzero(gap))
    alike = np.maximum(alike, _modal_share(line_doc, gaps, (gaps > 0) & few, lines))
    marks = marks + gaps + 2 * (per_line(np.flatnonzero(leader)) > 0)
    html = np.flatnonzero((codes == 47) & (prev == 60))
    html = html[(ahead(html, 1) == 116) & ((ahead(html, 2) == 100) | (ahead(html, 2) == 104))]
    marks = marks + 3 * per_line(html)
    rule_line = real & (n_line == 0)
    cells = ((marks >= 2) & few) | (rule_line & (last - first >= 5))
    # The shape of a line: its words as letters or numbers, in order.
    shape_code = np.where(digits_in > 0, 2, 1).astype(np.uint64)
    line_first = np.zeros(n_lines_all, dtype=np.int64)
    line_first[word_line[::-1]] = np.arange(len(starts))[::-1]
    in_line = np.minimum(np.arange(len(starts)) - line_first[word_line], 4095)
    with np.errstate(over="ignore"):
        shape = np.zeros(n_lines_all, dtype=np.uint64)
        np.add.at(shape, word_line, shape_code * t.power[in_line])
    has_number = np.bincount(word_line, digits_in > 0, n_lines_all) > 0
    n_plain = np.bincount(word_line, minlength=n_lines_all)

    # Runs without space, and repetitions of the same few characters.
    part = ~space & ~t.wide[codes]
    edge = part.copy()
    edge[1:] &= ~part[:-1]
    run_start = np.flatnonzero(edge)
    run_size = np.bincount(np.cumsum(edge)[part] - 1, minlength=len(run_start))
    longest = np.zeros(n_docs)
    np.maximum.at(longest, doc[run_start], run_size)
    repeated = np.zeros(n_docs)
    for k in (1, 2, 3, 4, 6):
        same = np.zeros(len(codes), dtype=bool)
        same[k:] = (codes[k:] == codes[:-k]) & ~newline[k:]
        same &= ~(space & prev_space)
        if k == 1:
            same &= ~space
        rise = same.copy()
        rise[1:] &= ~same[:-1]
        at_run = np.flatnonzero(rise)
        if not len(at_run):
            continue
        long = np.bincount(np.cumsum(rise)[same] - 1, minlength=len(at_run))
        keep = long >= 5 * k
        repeated = np.maximum(repeated, np.bincount(doc[at_run[keep]], long[keep] + k, n_docs))

    share = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), 0.0)
    letters = per_doc(np.flatnonzero(kind == _LETTER))
    plain_word = ~dense_in & (letters_in == size) & (size >= 4)
    bits = np.uint64(int(n_docs).bit_length())
    pairs = np.sort((word_doc.astype(np.uint64) << (np.uint64(64) - bits)) | (hashes >> bits))
    fresh = np.ones(len(pairs), dtype=bool)
    fresh[1:] = pairs[1:] != pairs[:-1]
    distinct = np.bincount((pairs[fresh] >> (np.uint64(64) - bits)).astype(np.int64), minlength=n_docs)
    line_sum = lambda x: np.bincount(line_doc, x, n_docs)
    full = np.array([len(x or "") for x in texts], dtype=float)
    commas = per_doc(np.flatnonzero((codes == 44) | (codes == 0x3001)))
    extra = np.array([r[1:] for r in ready], dtype=float).reshape(n_docs, 3)
    out = {
        "n_chars": full,
        "n_words": total_words,
        "n_lines": lines,
        "mean_word_length": share(letters, n_words),
        "longest_run": longest,
        "long_share": np.minimum(1, share(np.bincount(doc[run_start[run_size >= 16]], run_size[run_size >= 16], n_docs), chars)),
        "repeat_ratio": np.minimum(1, share(repeated, chars)),
        "common_share": share(total_common, total_words),
        "symbol_ratio": share(per_doc(np.flatnonzero(kind == _OTHER)), chars),
        "digit_ratio": share(per_doc(np.flatnonzero(kind == _NUMBER)), chars),
        "letter_ratio": share(letters, chars),
        "odd_ratio": share(per_doc(np.flatnonzero(t.odd[codes])), chars),
        "accent_ratio": share(per_doc(np.flatnonzero(t.accent[codes])), letters),
        "tag_ratio": np.where(extra[:, 0] > 0, extra[:, 0] / np.maximum(1, extra[:, 0] + chars), 0.0),
        "link_ratio": np.minimum(1, share(extra[:, 1], chars)),
        "hash_ratio": share(extra[:, 2], n_words),
        "number_share": share(np.bincount(word_doc, digits_in > 0, n_docs), n_words),
        "hard_share": share(np.bincount(word_doc, plain_word & (vowels_in * 5 < size), n_docs), np.bincount(word_doc, plain_word, n_docs)),
        "ends_share": share(line_sum(ends), lines),
        "bullet_share": share(line_sum(real & bullet & few), lines),
        "cell_share": share(line_sum(real & cells), lines),
        "mark_share": alike,
        "shape_share": _modal_share(line_doc, shape, real & has_number & few & (n_plain >= 2), lines),
        "bare_short_share": share(line_sum((c_line == 0) & (n_line > 0) & (n_line <= 6)), lines),
        "short_lines": np.minimum(line_sum((c_line == 0) & (n_line > 0) & (n_line <= 6)), 20.0),
        "bare_share": share(line_sum(real & (c_line == 0)), lines),
        "distinct_share": share(distinct, n_words),
        "words_per_line": share(total_words, lines),
        "commas_per_word": share(commas, total_words),
    }
    return np.column_stack([np.asarray(out[f], dtype=float) for f in FEATURES])


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about BLOCK_CHARS characters."""
    start = size = 0
    for i, x in enumerate(texts):
        size += len(x or "") + 1
        if size >= BLOCK_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def text_statistics(docs: DataFrame, common: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key and FEATURES, in one pass of Arrow batches over whole texts, without a shuffle.

    Lines are counted without blank ones and without quote marks in front; a signature at the end of the text (a line of
    dashes or underscores with one last line under it) is left out. n_chars counts the text as it is. n_words counts runs
    of letters and digits; in scripts without spaces two characters count as a word, and longest_run and long_share (the
    share of characters in runs of 16 or more) leave them out. repeat_ratio is the share of characters in repetitions of
    the same few, common_share that of words in the table of common words, number_share that of words with digits,
    hard_share that of words with hardly a vowel, ends_share that of lines that end in punctuation. bullet_share and
    cell_share are the shares of lines that begin with an item mark or are divided into cells and hold hardly a common
    word, bare_share that of lines without any common word, bare_short_share that of such lines with at most six words;
    short_lines is the number of those, 20 and more alike.
    mark_share and shape_share say how alike lines are: the share of the most frequent number of a dividing mark, or of
    the most frequent sequence of words and numbers, for texts of three lines or more. odd_ratio counts characters that
    wrongly decoded text is full of, accent_ratio letters with accents among the letters.

    Defined cases: NULL, empty and blank texts have 0 everywhere (but for n_chars); repeated rows stay repeated; an empty
    table of common words makes common_share 0; other columns are ignored.
    """
    words, dense = common_words(common)
    schema = docs.select(F.col(key)).schema
    for f in FEATURES:
        schema = schema.add(f, "double")
    spaced = word_hashes(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if not texts:
                continue
            values = np.concatenate([statistics(texts[a:b], spaced, dense) for a, b in blocks(texts)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(values[:, i])) for i in range(len(FEATURES))]], names=[key, *FEATURES])

    return docs.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)
