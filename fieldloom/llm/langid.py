"""Language ID by cross-parsing entropy.

For each language a bounded sample of labelled text is turned into a suffix automaton. A text is parsed greedily into
the longest phrases that occur in the sample: it follows the automaton's transitions as long as there are any, then a
phrase ends and the next one starts. The better a sample matches, the longer the matches and the fewer the phrases;
``phrases * log2(length of the longest sample) / text length`` estimates the cross entropy in bits a character, and the
language with the least wins.

Texts are lower-cased; every run of characters that aren't letters is one space, and a character that the samples don't
have is a phrase by itself. Texts are cut into segments, and all segments of an Arrow batch step through the automata side
by side as numpy vectors, one table look-up per character and language. A segment first starts as if a phrase began there;
then it is parsed again from the state in which the one before it ended, until both parses are in the same state, which
takes a few characters, and the difference of their phrases up to there is set right. So the cuts leave no trace.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fieldloom.llm.shared import free_name, without

#: Characters of a segment, those within which the two parses of one are expected to meet, and those parsed at once.
SEGMENT, MEET, AT_ONCE = 256, 32, 4_000_000
#: Bounds of the fit: labelled rows of each language, whole texts of at most SAMPLE_TEXT characters, SAMPLE_CHARS in all.
SAMPLE_ROWS, SAMPLE_TEXT, SAMPLE_CHARS = 96, 7_500, 30_000
_PHRASE = np.uint32(1 << 31)
_STATE = np.uint32((1 << 31) - 1)


@functools.cache
def _letters() -> np.ndarray:
    """True for code points that are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def normal(text: str) -> np.ndarray:
    """Code points of the text in lower case, with one space for each run of other characters than letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[points]
    if letter.all():
        return points
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:1] = letter[:1]
    return np.where(letter, points, 32)[keep]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    move: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(move)
        move.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = cur
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(move)
                move.append(dict(move[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return move


class Parser:
    """Counts phrases against all languages at once. Code 0 pads, code 1 is any character the samples don't have."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        points = {k: normal(samples[k]) for k in self.langs}
        seen = np.unique(np.concatenate([np.array([32], "<u4"), *points.values()]))
        self.width = len(seen) + 2
        self.code = np.ones(0x110000, np.uint8 if self.width < 256 else np.uint16)
        self.code[seen] = np.arange(2, self.width)
        # Of the longest sample for all: by its own length, a language with hardly any text would pay next to nothing.
        self.bits = np.log2(max(2, *map(len, points.values()), 2))
        self.tables = []
        for k in self.langs:
            move = suffix_automaton(self.code[points[k]].tolist())
            begin = np.full(self.width, _PHRASE)  # a phrase begins; where the sample has no such character, at once ends
            for c, to in move[0].items():
                begin[c] = _PHRASE | np.uint32(to * self.width)
            table = np.tile(begin, (len(move), 1))  # state 0 is both the root and the state without an open phrase
            for s, out in enumerate(move[1:], 1):
                for c, to in out.items():
                    table[s, c] = to * self.width
            table[:, 0] = 0  # padding begins nothing
            self.tables.append(table.ravel())

    def phrases(self, codes: list[np.ndarray]) -> np.ndarray:
        """The number of phrases of each text, given as codes, for each language."""
        sizes = np.array([len(c) for c in codes], np.int64)
        pieces = -(-sizes // SEGMENT)
        firsts = np.cumsum(pieces) - pieces
        rows = np.zeros((int(pieces.sum()), SEGMENT), self.code.dtype)
        flat = rows.ravel()
        for c, at in zip(codes, firsts.tolist(), strict=True):
            flat[at * SEGMENT : at * SEGMENT + len(c)] = c
        owner = np.repeat(np.arange(len(codes)), pieces)
        later = np.flatnonzero(np.arange(len(rows)) != firsts[owner]) if len(rows) else np.zeros(0, np.int64)
        out = np.zeros((len(codes), len(self.langs)))
        for k, table in enumerate(self.tables):
            out[:, k] = np.bincount(owner, self._counts(table, rows, later), len(codes))
        return out

    def _counts(self, table: np.ndarray, rows: np.ndarray, later: np.ndarray) -> np.ndarray:
        """The phrases that begin in each row; those of ``later`` go on from the row before them."""
        n = len(rows)
        end, count = np.zeros(n, np.uint32), np.zeros(n, np.int64)
        early, begun = np.zeros((MEET, n), np.uint32), np.zeros((MEET, n), np.uint16)
        for lo in range(0, n, 16384):
            hi = min(n, lo + 16384)
            state, total = np.zeros(hi - lo, np.uint32), np.zeros(hi - lo, np.uint32)
            for t, c in enumerate(np.ascontiguousarray(rows[lo:hi].T).astype(np.uint32)):
                got = table[state + c]
                total += got >> 31
                state = got & _STATE
                if t < MEET:
                    early[t, lo:hi], begun[t, lo:hi] = state, total
            end[lo:hi], count[lo:hi] = state, total
        left = later
        state, total = end[left - 1], np.zeros(len(left), np.uint32)
        for t in range(MEET):
            if not len(left):
                break
            got = table[state + rows[left, t]]
            total += got >> 31
            state = got & _STATE
            met = state == early[t, left]
            done = left[met]
            count[done] += total[met].astype(np.int64) - begun[t, done]
            left, state, total = left[~met], state[~met], total[~met]
        again = set(left.tolist())  # the few whose parses didn't meet soon are parsed whole, in order
        behind = set(later.tolist()) if again else set()
        while again:
            i = min(again)
            again.remove(i)
            count[i], last = _walk(table, int(end[i - 1]), rows[i].tolist())
            if last != end[i]:
                end[i] = last
                if i + 1 in behind:
                    again.add(i + 1)
        return count

    def rates(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character by text and language, and the number of normal characters of each text."""
        sizes, found, codes, held = [], [np.zeros((0, len(self.langs)))], [], 0
        for t in texts:
            codes.append(self.code[normal(t)])
            sizes.append(len(codes[-1]))
            held += sizes[-1]
            if held > AT_ONCE:
                found.append(self.phrases(codes))
                codes, held = [], 0
        if codes:
            found.append(self.phrases(codes))
        counts = np.array(sizes, np.int64)
        return np.concatenate(found) * self.bits / np.maximum(counts, 1)[:, None], counts


def _walk(table: np.ndarray, state: int, codes: list[int]) -> tuple[int, int]:
    """The phrases that begin while one row goes on from ``state``, and the state at its end."""
    get, begun, mask = table.item, 0, int(_STATE)
    for c in codes:
        got = get(state + c)
        if got > mask:
            begun += 1
            got &= mask
        state = got
    return begun, state


@functools.lru_cache(maxsize=2)
def parser_of(samples: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(dict(samples))


def _picked(df: DataFrame, key: str, text: str, lang: str, rows: int, most: int) -> dict[str, list[str]]:
    """``rows`` labelled texts of each language in hash order, whole ones of at most ``most`` characters."""
    order = Window.partitionBy("lang").orderBy("h", "t")
    some = df.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.char_length(text) <= most))
    some = some.select(F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(key).cast("string"), F.lit("sample")).alias("h"), F.col(text).alias("t"))
    picked = some.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= rows)
    # Of these few rows the driver gets no more characters than may be used, whichever of them are left out.
    so_far = F.sum(F.char_length("t")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    picked = picked.withColumn("before", F.coalesce(so_far, F.lit(0))).filter(F.col("before") <= 2 * SAMPLE_CHARS)
    by: dict[str, list[tuple[int, str]]] = {}
    for r in picked.collect():
        by.setdefault(r["lang"], []).append((r["at"], r["t"]))
    return {k: [t for _, t in sorted(v)] for k, v in by.items()}


def _joined(by: dict[str, list[str]], chars: int) -> dict[str, str]:
    """Whole texts in order, those left out that would make more than ``chars`` together (the first always stays)."""
    joined = {}
    for k, texts in by.items():
        taken, size = [], 0
        for t in texts:
            if not taken or size + len(t) < chars:
                taken.append(t)
                size += len(t) + 1
        joined[k] = " ".join(taken)
    return {k: t for k, t in joined.items() if any(c.isalpha() for c in t)}


def learn_samples(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS, most: int = SAMPLE_TEXT, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Sample text per language from labelled rows: whole texts of at most ``most`` characters out of ``rows`` rows in hash
    order, ``chars`` in all. About the same for every language the table has enough of, so that none has a head start."""
    return _joined(_picked(df, key, text, lang, rows, most), chars)


def _at(values: np.ndarray, ends: np.ndarray, share: float) -> float:
    """The quantile of ``values``, each as often as the sums ``ends`` rise there, between two as numpy does it."""
    spot = share * (ends[-1] - 1)
    low, high = (float(values[np.searchsorted(ends, i, side="right")]) for i in (int(spot), min(int(spot) + 1, ends[-1] - 1)))
    return low + (spot - int(spot)) * (high - low)


def usual_bits(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", least: int = 5) -> dict[str, float]:
    """Bits a character that text of each language may have: twice the median, or half more than the 99th percentile, of
    *all* labelled rows that are told right, to a thousandth of a bit. Texts are in two halves by their hash, and each is
    parsed whole against samples of the other half, so none against itself or its copies. Without ``least`` such rows a
    language has no bound."""
    rows = df.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).withColumn("_half", F.pmod(F.xxhash64(text), F.lit(2)))
    others = [learn_samples(rows.filter(F.col("_half") != half), key, text, lang) for half in (0, 1)]
    held = df.sparkSession.sparkContext.broadcast([tuple(sorted(x.items())) for x in others])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halves, names, out, bits = batch.column(2).to_numpy(), batch.column(0).to_pylist(), [], []
            for half, samples in enumerate(held.value):
                at = np.flatnonzero(halves == half)
                if not samples or not len(at):
                    continue
                parser, texts = parser_of(samples), batch.column(1)
                rates, sizes = parser.rates(texts[int(i)].as_py() for i in at)
                for i, rate, size in zip(at.tolist(), rates, sizes.tolist(), strict=True):
                    if size and parser.langs[k := int(rate.argmin())] == names[i]:
                        out.append(names[i])
                        bits.append(float(rate[k]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(bits, pa.float64())], ["lang", "bits"])

    told = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), "_half").mapInArrow(work, "lang string, bits double")
    counts = told.groupBy("lang", F.round(F.col("bits") * 1000).cast("long").alias("b")).count().collect()  # a few thousand a language
    by: dict[str, list[tuple[int, int]]] = {}
    for r in counts:
        by.setdefault(r["lang"], []).append((r["b"], r["count"]))
    out = {}
    for name, found in by.items():
        values, times = np.array(sorted(found)).T
        ends = np.cumsum(times)
        if ends[-1] >= least:
            out[name] = float(max(2 * _at(values, ends, 0.5), 1.5 * _at(values, ends, 0.99))) / 1000
    return out


def identify(df: DataFrame, samples: dict[str, str], text: str = "text", lang_column: str = "lang_pred", score_column: str = "score", bounds: dict[str, float] | None = None) -> DataFrame:
    """The table with the predicted language of each whole text and a score from 0 to 1.

    The score is ``b / (a + b)`` for the bits a character of the best language a and the runner-up b (1 if there is but
    one language), so 0.5 is a tie; ties go to the first language by name. A text that is null or has no letter is
    ``und`` with score 0, and so is one whose bits a character lie above the winner's in ``bounds``, where two phrases
    are free, as a short text has but few. Columns of the two names, in any case, are replaced; other columns don't pass
    through Python. Repeated rows are told each, an empty table gives none.
    """
    held = df.sparkSession.sparkContext.broadcast(tuple(sorted(samples.items())))  # bounded by SAMPLE_CHARS a language
    limit = bounds or {}
    type_ = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parser = parser_of(held.value) if held.value else None
        for batch in batches:
            langs, scores = ["und"] * len(batch), np.zeros(len(batch))
            rates, sizes = parser.rates(x.as_py() or "" for x in batch) if parser else (None, ())
            for i in np.flatnonzero(sizes).tolist():
                k = int(rates[i].argmin())
                if rates[i, k] - 2 * parser.bits / sizes[i] > limit.get(parser.langs[k], np.inf):
                    continue
                a, rest = rates[i, k], np.delete(rates[i], k)
                langs[i] = parser.langs[k]
                scores[i] = rest.min() / (a + rest.min()) if len(rest) else 1.0
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)], fields=list(type_))

    judge, out = F.arrow_udf(work, "lang string, score double"), free_name(df, "_told")
    told = df.select("*", judge(F.col(text)).alias(out))
    return told.select(*without(df, lang_column, score_column), F.col(f"{out}.lang").alias(lang_column), F.col(f"{out}.score").alias(score_column))


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")), F.lit(0)) % 4 == 2


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; see ``identify`` for odd rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    samples = learn_samples(docs.filter(~held_out()))
    out = identify(docs.select("doc_id", "text"), samples)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
