"""Noise in text from scanned pages: furniture, words cut at line ends, misread characters.

Lines of a page are labelled by a hidden Markov model whose states follow the layout from top to
bottom (running title, page number, body, running title, page number); Viterbi picks the labels from
layout features and from how often, and where, a line's key recurs in its book and in all books.
Misread words are those from which undoing one or two known confusions leads to a far more frequent
word. Counts cover every page; nothing but the page at hand is held by one task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

# What a scanner reads -> what may have been printed.
CONFUSIONS = {
    "0": "o", "1": "li", "5": "s", "9": "gq", "8": "b", "@": "a", "2": "z", "c": "e", "e": "c", "f": "t", "t": "f", "l": "i", "i": "l",
    "b": "h", "h": ("b", "li"), "|": "li", "$": "s", "6": "b", "rn": "m", "m": "rn", "vv": "w", "cl": "d", "d": ("cl",), "ii": "u", "ri": "n", "n": ("ri",), "u": ("ii", "n"), "v": "y", "li": "h", "ti": ("fi",), "fi": ("ti",), "nn": "m", "q": "g",
}
_LETTER_DIGITS = "IlOoSsZzBb|"
_NUMBER_MISREAD = re.compile(rf"(?=[^/.,]*[\d/.,])(?=.*[{_LETTER_DIGITS}])[\d{_LETTER_DIGITS}]+(?:[/.,][\d{_LETTER_DIGITS}]+)*")
_AS_DIGITS = str.maketrans(_LETTER_DIGITS, "11005522861")
_WITH_UNIT = re.compile(rf"([\d{_LETTER_DIGITS}/.,]+?)(lbs?|oz|l)")
_NUMBER = re.compile(r"\d+(?:[/.,]\d+)*")
_LITRES = re.compile(r"\d+(?:[.,/]\d+)?l")
_WORD = re.compile(r"[^\W_]+(?:[@$|'’][^\W_]+)*(?:-[^\W_]+(?:[@$|'’][^\W_]+)*)*@?|@[^\W_]+(?:-[^\W_]+)*")
_NUMERIC = re.compile(r"[\w|]+(?:[/.,][\w|]+)*")
_CUT = re.compile(r"([^\W_][\w@$|'’]*(?:-[\w@$|'’]+)*|@\w+)(-|‐|¬|\xad)[ \t\r]*$")
_FIRST = re.compile(r"\s*([\w@$|'’]+(?:-[\w@$|'’]+)*)")
_IMAGE = re.compile(r"\[IMAGE:.*\]\s*$")
_ROMAN = re.compile(r"(?=[ivxlc])(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", re.I)
_PAGE = re.compile(r"\W*(?:(?:page|p\.?|pg\.?|seite|s\.)\s*)?([0-9IlOoSZB|]{1,5}|[ivxlc]{1,8})\W*", re.I)
_LEADING = re.compile(r"^\W*([0-9IlOoSZB]{1,5}|[ivxlc]{1,8})(?:\s{2,}|\s*[|•·–-]\s+)(?=\S)", re.I)
_TRAILING = re.compile(r"(?<=\S)(?:\s{2,}|\s+[|•·–-]\s*)([0-9IlOoSZB]{1,5}|[ivxlc]{1,8})\W*$", re.I)
_SMALL = {"a", "an", "and", "the", "of", "in", "to", "with", "for", "from", "over", "on", "at", "by", "or"}
_FOLD = str.maketrans("015982@hcfi|q6", "olsgbzabetllgb")


def lines_of(text: str) -> list[str]:
    """Lines split at newlines only; a carriage return at the end stays in its line."""
    return text.split("\n")


def roman(text: str) -> int | None:
    t = text.lower()
    if not _ROMAN.fullmatch(t):
        return None
    values = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in t]
    return sum(-v if i + 1 < len(values) and v < values[i + 1] else v for i, v in enumerate(values))


def page_value(text: str) -> list[int]:
    """The values a page number may have as printed: as digits after confusions, or as a Roman numeral."""
    found = []
    t = text.translate(str.maketrans("IlOoSZB|", "11005281"))
    if t.isdigit():
        found.append(int(t))
    if (value := roman(text)) is not None:
        found.append(value)
    return found


def fold(text: str) -> str:
    """A key under which a text and its misread forms mostly agree."""
    t = text.lower()
    for a, b in (("ri", "n"), ("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("li", "h")):
        t = t.replace(a, b)
    return t.translate(_FOLD)


_SMALL_FOLDED = {fold(s) for s in _SMALL}


def title_key(line: str) -> tuple[str, list[str], str | None] | None:
    """(key, folded words, number at either end or None) of a line set like a title; else None."""
    t = line.strip()
    # most lines end here: no capital letter, or an end that no title has and no page number before it
    if not t or t == t.lower() or _IMAGE.match(t) or (t[-1] in ".,;:?!-¬\xad" and not _TRAILING.search(t)):
        return None
    if (m := _PAGE.fullmatch(t)) and page_value(m[1]):
        return None
    number = None
    for pattern in (_LEADING, _TRAILING):
        if (m := pattern.search(t)) and page_value(m[1]):
            number = m[1]
            t = (t[m.end():] if pattern is _LEADING else t[: m.start()]).strip()
            break
    words = re.findall(r"[\w@$|'’]+", t)
    if not words or not any(c.isalpha() for c in t) or t[-1] in ".,;:?!-¬\xad":
        return None
    long = [w for w in words if w.lower() not in _SMALL and fold(w) not in _SMALL_FOLDED]
    if not long or sum(w[0].isupper() or not w[0].isalpha() for w in long) < 0.75 * len(long) or not words[0][0].isupper() and words[0][0].isalpha():
        return None
    if all(not any(c.isalpha() for c in w) for w in long) or sum(w[0].isupper() for w in long) == 0:
        if not any(c.isupper() for c in t):
            return None
    folded = [fold(w) for w in words]
    return " ".join(folded), folded, number


def _edges(lines: list[str]) -> tuple[list[int], set[int]]:
    """(positions of lines that are not blank, those among the first two and last two of them)."""
    full = [i for i, line in enumerate(lines) if line.strip()]
    return full, {*full[:2], *full[-2:]}


def label_lines(lines: list[str], page_no: int | None, features: dict[int, tuple]) -> dict[int, str]:
    """Viterbi labels ('header', 'page', 'body') of the lines that are not blank.

    ``features``: line position -> (pages of the book with this key at an edge, edge uses of the key
    in all books, all uses of it, books with it at an edge, log odds of its words as a running title).
    """
    full, _ = _edges(lines)
    states = ("T", "N", "B", "M", "Q")  # top title, top number, body, bottom title, bottom number
    follow = {"T": "NB", "N": "TB", "B": "BMQ", "M": "Q", "Q": "M"}
    best: dict[str, tuple[float, str]] = {}
    for k, i in enumerate(full):
        top, bottom = k < 2, k >= len(full) - 2
        title = _title_score(lines[i], page_no, features.get(i), k == len(full) - 1 and len(full) > 1, k == 0 or k == len(full) - 1) if top or bottom else -50.0
        number = _number_score(lines[i], page_no, k == 0 or k == len(full) - 1) if top or bottom else -50.0
        step: dict[str, tuple[float, str]] = {}
        for s in states:
            if s in "TN" and not top or s in "MQ" and not bottom:
                continue
            score = 0.0 if s == "B" else title if s in "TM" else number
            if k == 0:
                options = [(0.0, "")] if s != "M" and s != "Q" or len(full) <= 2 else []
            else:
                options = [best[p] for p in best if s in follow[p]]
            if options:
                value, path = max(options)
                if s in "TN" and s in path or s in "MQ" and s in path:
                    continue
                step[s] = (value + score, path + s)
        best = step
    path = max(best.values())[1] if best else ""
    return {i: "header" if s in "TM" else "page" if s in "NQ" else "body" for i, s in zip(full, path)}


def _title_score(line: str, page_no: int | None, feature: tuple | None, last: bool, outer: bool) -> float:
    read = title_key(line)
    if read is None:
        return -20.0
    score = -2.0 + (1.0 if last else 0.0) + (0.0 if outer else -1.0)
    if read[2] is not None:
        score += 6.0 if page_no in page_value(read[2]) else 1.0
    if feature:
        in_book, edge, total, books, odds = feature
        share = edge / max(total, 1)
        if share >= 0.7:
            score += 3.0 * min(in_book - 1, 2) + (3.0 if books >= 3 and share >= 0.9 else 0.0)
        elif share < 0.5 and total >= 3:
            score -= 6.0
        score += max(-4.0, min(4.0, odds))
    return score


def _number_score(line: str, page_no: int | None, outer: bool) -> float:
    m = _PAGE.fullmatch(line.strip())
    if not m:
        return -20.0
    values, bare = page_value(m[1]), line.strip() == m[1]
    if not values:
        return -20.0
    if page_no in values:
        return 6.0 if outer or bare else 3.0
    return -3.0 if bare or not outer else 1.0


# Under this key a word and whatever confusions make of it agree: each confusion above keeps it.
_KEY_PARTS = str.maketrans({**dict.fromkeys("il1|hb86unrm", ""), "d": "e", "c": "e", "w": "vv", "y": "v", "t": "f", "q": "g", "9": "g", "0": "o", "5": "s", "$": "s", "@": "a", "2": "z"})


def confusion_key(word: str) -> str:
    return word.translate(_KEY_PARTS)


_RULES = [(seen, p) for seen, printed in CONFUSIONS.items() for p in (printed if isinstance(printed, tuple) or len(printed) < 2 or seen in ("1", "9", "|") else (printed,))]
_STARTS: dict[str, list[tuple[str, str]]] = {}
for _seen, _printed in _RULES:
    _STARTS.setdefault(_seen[0], []).append((_seen, _printed))


def may_be_misread(seen: str, printed: str, most: int = 2) -> bool:
    """Whether at most ``most`` confusions, one after the other along the word, turn ``printed`` into ``seen``."""
    states = {(0, 0, 0)}
    while states:
        grown = set()
        for i, j, n in states:
            while i < len(seen) and j < len(printed) and seen[i] == printed[j]:
                if n < most:
                    for a, b in _STARTS.get(seen[i], ()):
                        if seen.startswith(a, i) and printed.startswith(b, j):
                            grown.add((i + len(a), j + len(b), n + 1))
                i, j = i + 1, j + 1
            if i == len(seen) and j == len(printed):
                return seen != printed
            if n < most and i < len(seen):
                for a, b in _STARTS.get(seen[i], ()):
                    if seen.startswith(a, i) and printed.startswith(b, j):
                        grown.add((i + len(a), j + len(b), n + 1))
        states = grown
    return False


def read_number(token: str) -> str:
    """A misread number as printed: digits for the letters read in their place; a unit set close to it stays."""
    if (m := _WITH_UNIT.fullmatch(token)) and _NUMBER.fullmatch(head := m[1].translate(_AS_DIGITS)):
        return head + m[2]
    return token.translate(_AS_DIGITS)


def _body_words(line: str) -> tuple[list[str], list[tuple[int, str, str]]]:
    """(lower-case words, misread numbers: where each begins, as read, as printed)."""
    misread = []
    for m in _NUMERIC.finditer(line):
        t = m.group()
        if _NUMBER_MISREAD.fullmatch(t) and any(c.isdigit() for c in t) and not _LITRES.fullmatch(t):
            letters = [c for c in t if c.isalpha()]
            digits = [c for c in t if c.isdigit()]
            # a word such as 0il or 5o is a word's affair: a number starts or goes on as one
            if (len(digits) >= len(letters) or "/" in t or "." in t or "," in t) and read_number(t) != t:
                misread.append((m.start(), t, read_number(t)))
    return [w.lower() for w in _WORD.findall(line)], misread


_LONE = re.compile(r"\s*([IlZSOB|])(?:\s+[^\W\d_]|\s*[½⅓⅔¼¾⅛])")
_MIXED = re.compile(r"\s*[IlZSOB|]\s+(?:\d+/\d+\s|(?i:cups?|tsp|tbsp|teaspoons?|tablespoons?|oz|ounces?|fl|lbs?|pounds?|k?g|grams?|ml|cl|dl|l|litres?|liters?|sprigs?|cloves?|pinch)\b)")
_AMOUNT = re.compile(r"\s*(?:[\dIlZSOB|]+[\d./,IlZSOB ]*|a pinch|half|salt\b)")


def _pages(chunks: DataFrame, kind: str | None) -> DataFrame:
    rows = chunks.where(F.col("chunk_id").isNotNull() & F.col("text").isNotNull())
    if kind:
        rows = rows.where(F.upper("input_type") == kind)
    return rows.groupBy(F.col("chunk_id").cast("long").alias("chunk_id")).agg(
        F.min(F.struct(F.coalesce("source_id", F.lit("")).alias("source_id"), F.col("chunk_no").cast("int").alias("chunk_no"), "text")).alias("r")
    ).select("chunk_id", "r.source_id", "r.chunk_no", "r.text")


def title_features(pages: DataFrame) -> DataFrame:
    """(chunk_id, features): for the edge lines of every page set like titles, what label_lines needs."""

    def titles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for chunk, source, _, text in zip(*(c.to_pylist() for c in batch.columns)):
                lines = lines_of(text)
                full, edges = _edges(lines)
                outer = {full[0], full[-1]} if full else set()
                for i in full:
                    if read := title_key(lines[i]):
                        out.append((chunk, source, i, i in edges, i in outer, read[0], read[1]))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([
                    pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.bool_()),
                    pa.array(cols[4], pa.bool_()), pa.array(cols[5], pa.string()), pa.array(cols[6], pa.list_(pa.string())),
                ], ["chunk_id", "source_id", "at", "edge", "outer", "key", "words"])

    lines = cut(pages.mapInArrow(titles, "chunk_id long, source_id string, at int, edge boolean, outer boolean, key string, words array<string>"))
    book = lines.where("outer").groupBy("source_id", "key").agg(F.count(F.lit(1)).alias("in_book"))
    keys = book.groupBy("key").agg(F.sum("in_book").alias("n_edge"), F.count(F.lit(1)).alias("books")).join(
        lines.groupBy("key").agg(F.count(F.lit(1)).alias("n_all")), "key"
    )
    known = lines.join(book, ["source_id", "key"], "left").join(keys, "key", "left")
    title = F.col("outer") & (F.col("in_book") >= 2) & (F.col("n_edge") >= 0.9 * F.col("n_all"))
    other = ~F.col("edge") | (F.coalesce("n_edge", F.lit(0)) < 0.5 * F.coalesce("n_all", F.lit(1)))
    words = known.select(title.alias("title"), other.alias("other"), F.explode("words").alias("word")).groupBy("word").agg(
        F.log((F.count_if("title") + 0.5) / (F.count_if("other") + 0.5)).alias("odds")
    )
    edges = known.where("edge").select("chunk_id", "at", "in_book", "n_edge", "n_all", "books", F.explode("words").alias("word"))
    return edges.join(words, "word").groupBy("chunk_id", "at").agg(
        F.first("in_book").alias("in_book"), F.first("n_edge").alias("n_edge"), F.first("n_all").alias("n_all"), F.first("books").alias("books"), F.avg("odds").alias("odds")
    ).groupBy("chunk_id").agg(F.collect_list(F.struct(
        "at", F.coalesce("in_book", F.lit(1)).cast("int").alias("in_book"), F.coalesce("n_edge", F.lit(0)).cast("long").alias("n_edge"),
        F.coalesce("n_all", F.lit(1)).cast("long").alias("n_all"), F.coalesce("books", F.lit(1)).cast("long").alias("books"), "odds",
    )).alias("features"))


def label_pages(pages: DataFrame) -> DataFrame:
    """One row per line that is not blank: chunk_id, line_no from 1, label, the words of body lines,
    the misread numbers in it with what was printed, and for a line that ends in a cut the halves, where
    they begin in this line and the next, whether the word is capitalised, and the mark."""
    known = pages.join(title_features(pages), "chunk_id", "left").select("chunk_id", "chunk_no", "text", "features")
    schema = "chunk_id long, line_no int, label string, words array<string>, numbers array<struct<at:int,word:string,right:string>>, left string, right string, left_at int, right_at int, capital boolean, mark string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for chunk, page_no, text, features in zip(*(c.to_pylist() for c in batch.columns)):
                lines = lines_of(text)
                known = {f["at"]: (f["in_book"], f["n_edge"], f["n_all"], f["books"], f["odds"] or 0.0) for f in features or []}
                labels = label_lines(lines, page_no, known)
                body = [i for i in labels if labels[i] == "body"]
                follows = {a: b for a, b in zip(body, body[1:]) if b == a + 1}
                taken: set[int] = set()
                cuts: dict[int, tuple] = {}
                for i in body:
                    m = _CUT.search(lines[i])
                    if m and not _IMAGE.match(lines[i]):
                        right = _FIRST.match(lines[follows[i]]) if i in follows else None
                        cuts[i] = (m[1].lower(), right[1].lower() if right else None, m.start(1), right.start(1) if right else None, m[1][0].isupper(), m[2])
                        if right:
                            taken.add(follows[i])
                for i, label in labels.items():
                    if label != "body" or _IMAGE.match(lines[i]):
                        out.append((chunk, i + 1, label, None, None, *[None] * 6))
                        continue
                    line, before = lines[i], 0
                    if i in cuts:
                        line = line[: _CUT.search(line).start()]
                    if i in taken and (m := _FIRST.match(line)):
                        line, before = line[m.end():], m.end()
                    words, numbers = _body_words(line)
                    for at, t, right in numbers:
                        line = line[:at] + right + line[at + len(t):]
                    lone, mixed = _LONE.match(line), _MIXED.match(line)
                    if lone and not mixed:
                        at = body.index(i)
                        near = [lines[j] for j in body[max(at - 2, 0):at + 3] if j != i]
                        if not any(_AMOUNT.match(x) and not x.rstrip().endswith(".") for x in near) or line.rstrip().endswith("."):
                            lone = None
                    if (lone or mixed) and i not in taken:
                        at = len(line) - len(line.lstrip())
                        numbers.append((at, line[at], line[at].translate(_AS_DIGITS)))
                    out.append((chunk, i + 1, label, words, [dict(zip(("at", "word", "right"), (before + x[0], *x[1:]))) for x in numbers], *cuts.get(i, (None,) * 6)))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([
                    pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.list_(pa.string())),
                    pa.array(cols[4], pa.list_(pa.struct([("at", pa.int32()), ("word", pa.string()), ("right", pa.string())]))), pa.array(cols[5], pa.string()),
                    pa.array(cols[6], pa.string()), pa.array(cols[7], pa.int32()), pa.array(cols[8], pa.int32()), pa.array(cols[9], pa.bool_()), pa.array(cols[10], pa.string()),
                ], ["chunk_id", "line_no", "label", "words", "numbers", "left", "right", "left_at", "right_at", "capital", "mark"])

    return known.mapInArrow(run, schema)


def count_words(lines: DataFrame, clean: DataFrame) -> DataFrame:
    """(word, n, n_clean): uses of every word in the body lines and in the texts that were not scanned."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, int] = {}
            for text in batch.column(0).to_pylist():
                for w in _WORD.findall(text):
                    w = w.lower()
                    found[w] = found.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    scanned = lines.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("n_clean", F.lit(0).cast("long"))
    typed = clean.select("text").mapInArrow(words, "word string, n long").withColumn("n_clean", F.col("n"))
    return scanned.unionByName(typed).groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_clean").alias("n_clean"))


def correct_words(wanted: DataFrame, counts: DataFrame, ratio: int = 8, trusted: int = 2) -> DataFrame:
    """(word, right, n_right): for each wanted word the word it stands for, itself where it is sound.

    A word seen ``trusted`` times in unscanned text is sound. Another one is misread when undoing
    confusions leads to a word at least ``ratio`` times as frequent; the most frequent one is taken.
    Words without a sound reading are absent.
    """
    known = wanted.select("word").distinct().join(counts, "word", "left").select(
        "word", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_clean", F.lit(0)).alias("n_clean")
    )
    sound = known.where(F.col("n_clean") >= trusted).select("word", F.col("word").alias("right"), F.col("n").alias("n_right"))
    doubtful = known.where(F.col("n_clean") < trusted)

    likely = counts.where(((F.col("n_clean") >= trusted) | (F.col("n") >= 20)) & F.col("word").rlike(r"\p{L}{2}")).select(F.col("word").alias("other"), F.col("n").alias("n_other"))

    def keys(column: str):
        @F.pandas_udf("string")
        def key(words: pd.Series) -> pd.Series:
            return words.map(confusion_key)

        return key(column)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = [may_be_misread(w, o) for w, o in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield batch.filter(pa.array(yes, pa.bool_()))

    # words that share a key, and are about as long and as unlike as two confusions allow, are looked at closely
    met = doubtful.withColumn("key", keys("word")).join(likely.withColumn("key", keys("other")), "key").where(
        (F.col("word") != F.col("other")) & (F.col("n_other") >= ratio * F.greatest(F.col("n"), F.lit(1))) & (F.abs(F.length("word") - F.length("other")) <= 2) & (F.levenshtein("word", "other", 4) >= 0)
    )
    told = met.select("word", "other", "n_other").mapInArrow(tell, "word string, other string, n_other long")
    better = cut(told.groupBy("word").agg(F.max(F.struct("n_other", "other")).alias("b")).select("word", F.col("b.other").alias("right"), F.col("b.n_other").alias("n_right")))
    itself = doubtful.where("n >= 3").join(better, "word", "left_anti").select("word", F.col("word").alias("right"), F.col("n").alias("n_right"))
    return sound.unionByName(better).unionByName(itself)


def find_noise(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, fixes) over the PDF pages of chunks(chunk_id, source_id, chunk_no, text, input_type).

    found: chunk_id, line_no, kind in header, page, hyphen, char. fixes: chunk_id, line_no, at, word, right:
    every misread word (at null: wherever it stands in the line), misread number and misread half of a
    word cut at a line end (at: where it begins in the line; the halves together give the right word).
    Every line of kind char has a fix. Null texts give nothing, rows delivered twice count once; chunks
    of any other input type only lend their words.
    """
    lines = cut(label_pages(_pages(chunks, "PDF")))
    other = chunks.where(F.col("text").isNotNull() & (F.coalesce(F.upper("input_type"), F.lit("")) != "PDF"))
    counts = cut(count_words(lines, other))

    furniture = lines.where("label <> 'body'").select("chunk_id", "line_no", F.col("label").alias("kind"))
    cuts = lines.where("mark is not null").select(
        "chunk_id", "line_no", "left", "right", "left_at", "right_at", "capital", "mark", F.concat("left", "right").alias("joined"), F.concat("left", F.lit("-"), "right").alias("spelled")
    )
    halves = cuts.where("right is not null").select(F.explode(F.array("joined", "spelled")).alias("word"))
    rare = counts.where("n_clean < 2").select("word")
    readings = cut(correct_words(rare.unionByName(halves), counts))

    wrong = readings.where("word <> right").select("word", "right")
    misread = lines.select("chunk_id", "line_no", F.explode(F.array_distinct("words")).alias("word")).join(wrong, "word")
    numbers = lines.select("chunk_id", "line_no", F.explode("numbers").alias("s")).select("chunk_id", "line_no", "s.at", "s.word", "s.right")
    fixes = misread.select("chunk_id", "line_no", F.lit(None).cast("int").alias("at"), "word", "right").unionByName(numbers)

    one = readings.select(F.col("word").alias("joined"), F.col("right").alias("j_right"), F.col("n_right").alias("j_n"))
    two = readings.select(F.col("word").alias("spelled"), F.col("right").alias("s_right"), F.col("n_right").alias("s_n"))
    judged = cuts.join(one, "joined", "left").join(two, "spelled", "left").select(
        "chunk_id", "line_no", "left", "right", "left_at", "right_at", "capital",
        ((F.col("mark") != "-") | (F.coalesce("j_n", F.lit(0)) >= F.coalesce("s_n", F.lit(0)))).alias("is_cut"), "j_right", "s_right",
    )
    hyphens = judged.where("is_cut").select("chunk_id", "line_no", F.lit("hyphen").alias("kind"))
    # the right word is parted where the read one was; a hyphen that belongs to it stays in its line
    whole = judged.withColumn("whole", F.when(F.col("is_cut"), F.col("j_right")).otherwise(F.col("s_right"))).where("whole is not null")
    keep = F.when(F.endswith("whole", "right"), F.length("whole") - F.length("right")).when(F.startswith("whole", "left"), F.length("left")).otherwise(F.least(F.length("left"), F.length("whole") - 1))
    hyphen = F.length(F.expr("substring_index(whole, '-', size(split(left, '-')))"))
    parted = whole.withColumn("k", F.when(F.col("is_cut"), keep).otherwise(hyphen)).withColumn("new_left", F.expr("left(whole, k)")).withColumn(
        "new_right", F.expr("substring(whole, k + if(is_cut, 1, 2))")
    )
    cased = F.when(F.col("capital"), F.concat(F.upper(F.left("new_left", F.lit(1))), F.expr("substring(new_left, 2)"))).otherwise(F.col("new_left"))
    halves = parted.where("new_left <> left").select("chunk_id", "line_no", F.col("left_at").alias("at"), F.col("left").alias("word"), cased.alias("right")).unionByName(
        parted.where("new_right <> right").select("chunk_id", (F.col("line_no") + 1).alias("line_no"), F.col("right_at").alias("at"), F.col("right").alias("word"), F.col("new_right").alias("right"))
    )
    fixes = fixes.unionByName(halves)
    chars = fixes.select("chunk_id", "line_no", F.lit("char").alias("kind"))
    return furniture.unionByName(hyphens).unionByName(chars).distinct(), fixes.distinct()


def repair(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text): the pages as continuous paragraphs, without furniture, cuts, misread words and misread numbers."""
    found, fixes = find_noise(chunks)
    marks = found.where("kind <> 'char'").groupBy("chunk_id").agg(F.collect_list(F.struct("line_no", "kind")).alias("marks"))
    words = fixes.groupBy("chunk_id").agg(F.collect_list(F.struct("line_no", "at", "word", "right")).alias("fixes"))
    rows = _pages(chunks, "PDF").join(marks, "chunk_id", "left").join(words, "chunk_id", "left").select("chunk_id", "text", "marks", "fixes")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = [], []
            for chunk, text, marks, fixes in zip(*(c.to_pylist() for c in batch.columns)):
                keys.append(chunk)
                texts.append(rebuild_text(text, {(m["line_no"], m["kind"]) for m in marks or []}, {(f["line_no"], f["word"] if f["at"] is None else (f["at"], f["word"])): f["right"] for f in fixes or []}))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, pa.string())], ["chunk_id", "text"])

    return rows.mapInArrow(rebuild, "chunk_id long, text string")


def rebuild_text(text: str, marks: set[tuple[int, str]], fixes: dict[tuple[int, str | tuple[int, str]], str]) -> str:
    """Paragraphs of one page: prose lines run on, list lines and titles keep their own line.

    ``fixes``: (line number, word) -> right for every use of a word in the line, (line number, (at, word))
    -> right for what begins at that place of it.
    """
    paragraphs: list[str] = []
    placed: dict[int, list[tuple[int, int, str]]] = {}
    for (no, word), right in fixes.items():
        if isinstance(word, tuple):
            placed.setdefault(no, []).append((word[0], word[0] + len(word[1]), right))
    open_, glue = False, ""
    for no, line in enumerate(lines_of(text), 1):
        if (no, "header") in marks or (no, "page") in marks:
            continue
        if not line.strip():
            open_ = False
            continue

        edits = placed.get(no, [])
        for m in _WORD.finditer(line):
            right = fixes.get((no, m.group().lower()))
            if right is not None and not any(a < m.end() and m.start() < b for a, b, _ in placed.get(no, [])):
                edits = edits + [(*m.span(), right.capitalize() if m.group()[0].isupper() else right)]
        part = line
        for a, b, right in sorted(edits, reverse=True):
            part = part[:a] + right + part[b:]
        part = part.strip()
        cut_here = (no, "hyphen") in marks
        if cut_here:
            part = re.sub(r"[-‐¬\xad]\s*$", "", part)
        lone = title_key(line) is not None or _AMOUNT.match(line) is not None or _IMAGE.match(line.strip()) is not None
        # the second half of a cut word goes on with it, whatever its line looks like
        if open_ and paragraphs and not (lone and not glue and not _FIRST.match(part)):
            paragraphs[-1] += (glue if glue != " " else " ") + part if not paragraphs[-1].endswith("-") or glue == "" else part
        else:
            paragraphs.append(part)
        open_, glue = not lone or cut_here, "" if cut_here else " "
    return "\n\n".join(paragraphs)
