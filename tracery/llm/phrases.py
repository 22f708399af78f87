"""Collocations from vertical positional lists.

Documents are taken in chunks of bounded size where they are read; a chunk numbers its
words through.  A phrase's list holds the positions of the chunk at which it starts, so
the lengths of its lists add up to its exact frequency.  A phrase of m + 1 words starts
where one of m words starts and another starts one word later: the lists of a level are
merged by position, and neighbours give the lists of the next level, whose last word is
the adjacent word.

Only phrases that are frequent in the whole corpus are extended.  A chunk sends the
hashes and list lengths of its candidates, packed, to parts; a part adds them up and
answers which reach the threshold.  A clash of hashes can only keep a candidate that
need not be kept: at the end frequencies are summed by the phrases themselves.

The lists of a level are exchanged once, packed, a row for each chunk and language; the
passes over them read the same shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytescan import mixed
from .chunks import CHUNK_BYTES, answers, as_posts, leading_bits, messages, posts
from .common import written

POST = "chunk long, part long, keys binary, more binary"
LISTS = "chunk long, lang string, n long, phrases binary, sizes binary, at binary"
COUNTS = "lang string, part long, phrases binary, counts binary"
FREQUENCIES = "lang string, phrase string, f long"
TOTAL = -1
#: A byte that no UTF-8 text has: it ends a piece.
END = b"\xff"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_PLAIN = bytes.maketrans(_UPPER + b"\t" + b".,;:!?\x0a\x0b\x0c\x0d", _LOWER + b" " + END * 10)
_STEP = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers below 2**32, byte plane by byte plane, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def _joined(phrases: list[bytes]) -> bytes:
    """Phrases in one string; none holds a line end."""
    return zstandard.compress(b"\n".join(phrases), 1)


def _split(data: bytes) -> list[bytes]:
    whole = zstandard.decompress(data)
    return whole.split(b"\n") if whole else []


@dataclass
class Lists:
    """The lists of one language in one chunk, one after the other; phrases in the order of their bytes."""

    lang: str
    phrases: list[bytes]
    sizes: np.ndarray
    at: np.ndarray

    def row(self, chunk: int, n: int) -> tuple:
        gaps = np.diff(self.at, prepend=0)
        starts = np.cumsum(self.sizes) - self.sizes
        gaps[starts] = self.at[starts]
        return chunk, self.lang, n, _joined(self.phrases), _packed(self.sizes), _packed(gaps)

    @property
    def hashes(self) -> np.ndarray:
        seed = xxhash.xxh64_intdigest(self.lang.encode())
        return np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in self.phrases), np.uint64, len(self.phrases))

    def only(self, keep: np.ndarray) -> Lists:
        return Lists(self.lang, [p for p, yes in zip(self.phrases, keep.tolist(), strict=True) if yes], self.sizes[keep], self.at[np.repeat(keep, self.sizes)])


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([r[k] for r in rows], kinds[kind]) for k, (name, kind) in enumerate(fields)})


def _lists(table: pa.Table) -> list[Lists]:
    """The lists of a chunk, language by language."""
    out = []
    for lang, phrases, sizes, at in sorted(zip(*(table.column(c).to_pylist() for c in ("lang", "phrases", "sizes", "at")), strict=True)):
        counts, gaps = _unpacked(sizes), _unpacked(at)
        starts = np.cumsum(counts) - counts
        ends = np.cumsum(gaps)
        out.append(Lists(lang, _split(phrases), counts, ends - np.repeat(ends[starts] - gaps[starts], counts)))
    return out


def _stretches(texts: list[bytes]) -> Iterator[bytes]:
    """The texts with plain separators, each ended, cut between words into stretches of bounded size (a longer word stays whole)."""
    for text in texts:
        plain, lo = text.translate(_PLAIN), 0
        while lo < len(plain):
            hi = lo + _STEP
            if hi < len(plain):
                back = max(plain.rfind(b" ", lo, hi), plain.rfind(END, lo, hi))
                ahead = [x for x in (plain.find(b" ", hi), plain.find(END, hi)) if x >= 0]
                hi = back + 1 if back >= lo else min(ahead, default=len(plain))
            yield plain[lo:hi]
            lo = hi
        yield END


def _tokens(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """(distinct tokens, number of each token): the words of all texts in order, with ``END`` behind each piece."""
    parts, held, size = [], [], 0
    for stretch in _stretches(texts):
        held.append(stretch)
        size += len(stretch)
        if size >= _STEP:
            parts.append(pa.array(b" ".join(held).replace(END, b" \xff ").split(), pa.binary()))
            held, size = [], 0
    parts.append(pa.array(b" ".join(held).replace(END, b" \xff ").split(), pa.binary()))
    coded = pa.chunked_array(parts, pa.binary()).dictionary_encode().unify_dictionaries()
    names = coded.chunk(0).dictionary.to_pylist() if len(coded) else []
    return names, np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks])


def _word_lists(chunk_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The lists of all words, chunk by chunk of the texts of a task."""

    def of(texts: list[bytes], lang: str, chunk: int) -> tuple:
        words, codes = _tokens(texts)
        order = sorted((w, i) for i, w in enumerate(words) if w != END)
        rank = np.full(len(words), len(words), np.int64)
        rank[[i for _, i in order]] = np.arange(len(order))
        ranks = rank[codes]
        places = np.argsort(ranks, kind="stable")
        sizes = np.bincount(ranks, minlength=len(words))[: len(order)]
        n = int(sizes.sum())
        return Lists(lang, [w for w, _ in order], sizes, places[:n]).row(chunk, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        number, size = TaskContext.get().partitionId() << 32, 0

        def chunk() -> Iterator[pa.RecordBatch]:
            nonlocal number, size
            for lang in sorted(held):
                yield from _rows([of(held.pop(lang), lang, number)], LISTS).to_batches()
            number, size = number + 1, 0

        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                held.setdefault(lang.as_py(), []).append(text.as_py())
                size += len(held[lang.as_py()][-1])
                if size >= chunk_bytes:
                    yield from chunk()
        yield from chunk()

    return run


def _pairs(lists: Lists) -> tuple[np.ndarray, np.ndarray]:
    """(position, pair) where a phrase starts and another starts one word later."""
    owner = np.full(int(lists.at.max(initial=-1)) + 2, -1, np.int64)
    owner[lists.at] = np.repeat(np.arange(len(lists.phrases)), lists.sizes)
    first = np.flatnonzero((owner[:-1] >= 0) & (owner[1:] >= 0))
    return first, owner[first] * len(lists.phrases) + owner[first + 1]


def _of_pairs(lists: Lists, pairs: np.ndarray) -> np.ndarray:
    """Hashes of the phrases that pairs make."""
    own, n = lists.hashes, max(1, len(lists.phrases))
    return mixed(own[pairs // n] * _ODD + own[pairs % n])


def _asked(chunk: int, hashes: list[np.ndarray], counts: list[np.ndarray], bits: int) -> pa.Table:
    """Messages to the parts: hashes and list lengths of a chunk's candidates."""
    every, sizes = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(every)
    every, sizes = every[order], sizes[order]
    short = (every >> np.uint64(32 - bits)).astype(np.uint32).astype(np.int64)
    out = posts(0, every, bits, lambda lo, hi: (_packed(np.diff(short[lo:hi], prepend=0)), _packed(sizes[lo:hi])))
    return out.set_column(0, "chunk", pa.array([chunk] * out.num_rows, pa.int64()))


def _answered(hashes: list[np.ndarray], told: pa.Table, bits: int) -> list[np.ndarray]:
    """For each of a chunk's hashes whether its part said yes."""
    every = np.concatenate(hashes)
    order = np.argsort(every)
    yes = np.empty(len(every), bool)
    yes[order] = answers(told, len(every), bits, every[order])
    return np.split(yes, np.cumsum([len(h) for h in hashes])[:-1])


def _sent_on(told: pa.Table, chunk: int) -> list[tuple]:
    """Answers that pass through another round, so that a later pass has them too."""
    return [(chunk, -1 - chunk, np.int64(part).tobytes() + bits, None) for _, part, bits, _ in messages(told)]


def _rounds(told: pa.Table) -> tuple[pa.Table, pa.Table]:
    """(answers of the round before, answers of this round)."""
    mine = told.column("part").to_numpy() >= 0
    before = [(0, int(np.frombuffer(r[2][:8], np.int64)[0]), r[2][8:], None) for r in messages(told.filter(pa.array(~mine)))]
    return as_posts(before), told.filter(pa.array(mine))


def _adding(least: int) -> Callable[[pa.Table], pa.Table]:
    """A part adds up what chunks have of each hash and answers in the order of their questions."""

    def add(table: pa.Table) -> pa.Table:
        rows = list(messages(table))
        if not rows or rows[0][1] < 0:
            return table
        keys, counts = [np.cumsum(_unpacked(r[2])) for r in rows], [_unpacked(r[3]) for r in rows]
        _, which = np.unique(np.concatenate(keys), return_inverse=True)
        enough = np.bincount(which, np.concatenate(counts))[which] >= least
        told = np.split(enough, np.cumsum([len(k) for k in keys])[:-1])
        return _rows([(r[0], r[1], np.packbits(t).tobytes(), None) for r, t in zip(rows, told, strict=True) if t.any()], POST)

    return add


def _counts(lists: list[Lists], bits: int) -> pa.Table:
    """Phrases with the lengths of their lists, packed for the parts of their language."""
    out = []
    for x in lists:
        part = (x.hashes >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = [0, *(np.flatnonzero(np.diff(part[order])) + 1).tolist(), len(order)] if len(order) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own = order[lo:hi]
            out.append((x.lang, int(part[own[0]]), _joined([x.phrases[i] for i in own.tolist()]), _packed(x.sizes[own])))
    return _rows(out, COUNTS)


def _summed(least: int) -> Callable[[pa.Table], pa.Table]:
    """The phrases of a part that occur often enough, with their frequencies."""

    def run(table: pa.Table) -> pa.Table:
        sums: dict[bytes, int] = {}
        for phrases, counts in zip(table.column("phrases").to_pylist(), table.column("counts").to_pylist(), strict=True):
            for phrase, n in zip(_split(phrases), _unpacked(counts).tolist(), strict=True):
                sums[phrase] = sums.get(phrase, 0) + n
        lang = table.column("lang")[0].as_py()
        return _rows([(lang, p.decode(), n) for p, n in sums.items() if n >= least], FREQUENCIES)

    return run


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, most_words: int = 4, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f), (lang, n)): all phrases of up to ``most_words`` words that occur ``least`` times or more, and all words counted."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = leading_bits(total / 6)
    add = _adding(least)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    words = texts.mapInArrow(_word_lists(chunk_bytes), LISTS)

    def frequent(table: pa.Table, told: pa.Table) -> list[Lists]:
        every = _lists(table)
        return [x.only(yes) for x, yes in zip(every, _answered([x.hashes for x in every], told, bits), strict=True)]

    def longer(every: list[Lists], told: pa.Table) -> list[Lists]:
        """Lists of the next level: the pairs that are frequent."""
        found = []
        for x in every:
            first, pair = _pairs(x)
            found.append((first, *np.unique(pair, return_inverse=True, return_counts=True)))
        out = []
        for x, (first, distinct, which, counts), yes in zip(every, found, _answered([_of_pairs(x, f[1]) for x, f in zip(every, found, strict=True)], told, bits), strict=True):
            keep, n = yes[which], max(1, len(x.phrases))
            order = np.argsort(which[keep], kind="stable")
            names = [x.phrases[i] + b" " + x.phrases[j].rpartition(b" ")[2] for i, j in zip((distinct[yes] // n).tolist(), (distinct[yes] % n).tolist(), strict=True)]
            out.append(Lists(x.lang, names, counts[yes], first[keep][order]))
        return out

    def candidates(every: list[Lists], chunk: int) -> pa.Table:
        hashes, counts = [], []
        for x in every:
            distinct, n = np.unique(_pairs(x)[1], return_counts=True)
            hashes.append(_of_pairs(x, distinct))
            counts.append(n)
        return _asked(chunk, hashes, counts, bits)

    def packed(every: list[Lists], chunk: int) -> pa.Table:
        return _rows([x.row(chunk, 0) for x in every if x.phrases], LISTS)

    chunk_of = lambda table: table.column("chunk")[0].as_py()

    def ask_words(table: pa.Table) -> pa.Table:
        every = _lists(table)
        return _asked(chunk_of(table), [x.hashes for x in every], [x.sizes for x in every], bits)

    def ask_pairs(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows([], POST)
        asked = candidates(frequent(table, told), chunk_of(table))
        return pa.concat_tables([asked, _rows(_sent_on(told, chunk_of(table)), POST)])

    def keep_pairs(table: pa.Table, told: pa.Table) -> pa.Table:
        before, now = _rounds(told)
        return packed(longer(frequent(table, before), now), chunk_of(table)) if table.num_rows else _rows([], LISTS)

    def count_words(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows([], COUNTS)
        totals = [(lang, TOTAL, None, _packed(np.array([n >> 31, n & (1 << 31) - 1]))) for lang, n in zip(table.column("lang").to_pylist(), table.column("n").to_pylist(), strict=True)]
        return pa.concat_tables([_counts(frequent(table, told), bits), _rows(totals, COUNTS)])

    def ask_longer(table: pa.Table) -> pa.Table:
        return candidates(_lists(table), chunk_of(table))

    def keep_longer(table: pa.Table, told: pa.Table) -> pa.Table:
        return packed(longer(_lists(table), told), chunk_of(table)) if table.num_rows else _rows([], LISTS)

    def count(table: pa.Table) -> pa.Table:
        return _counts(_lists(table), bits)

    answer = lambda asked: asked.groupBy("part").applyInArrow(add, POST)
    with_told = lambda lists, told, f, schema: lists.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(f, schema)
    told = answer(words.groupBy("chunk").applyInArrow(ask_words, POST))
    counted = with_told(words, told, count_words, COUNTS)
    lists = None
    for m in range(2, most_words + 1):
        if m == 2:
            lists = with_told(words, answer(with_told(words, told, ask_pairs, POST)), keep_pairs, LISTS)
        else:
            lists = with_told(lists, answer(lists.groupBy("chunk").applyInArrow(ask_longer, POST)), keep_longer, LISTS)
        counted = counted.unionByName(lists.groupBy("chunk").applyInArrow(count, COUNTS))

    def sums(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() != TOTAL:
            return _summed(least)(table)
        n = sum(int(hi) << 31 | int(lo) for hi, lo in map(_unpacked, table.column("counts").to_pylist()))
        return _rows([(table.column("lang")[0].as_py(), None, n)], FREQUENCIES)

    f = written(counted.groupBy("lang", "part").applyInArrow(sums, FREQUENCIES), "frequencies")
    words_of = F.size(F.split("phrase", " "))
    return f.where("phrase is not null").select("lang", "phrase", words_of.alias("words"), "f"), f.where("phrase is null").select("lang", F.col("f").alias("n"))


def _part(words: Column, first: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, first, length), " ")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, most_words: int = 4, top: int = 2000, covered: int = 80, **options) -> DataFrame:
    """Return (lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two to ``most_words`` words of each language.

    A-Z are lower-cased; ``.,;:!?`` and line ends cut a text into pieces, spaces and tabs
    a piece into words.  ``n`` counts all words of the language, ``a`` the phrase, ``l``
    and ``r`` its two parts at the cut with the least score, floor(2000000 a / (l + r)).
    A phrase goes if a longer frequent one that holds it has ``covered`` percent of its
    count or more.  Equal scores go by ``a``, then by the phrase's bytes.

    A null text is empty and a null language is ``und``; repeated rows count each time; a
    language without frequent phrases, and an empty table, give no rows.  Other columns
    are ignored.  A chunk holds a longest text whole, as positions and distinct words.
    """
    f, n = phrase_counts(docs, text_col, lang_col, least, most_words, **options)
    phrases = f.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = phrases.select("lang", "phrase", "a", "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("w"), F.lit(1), F.col("k")).alias("left"), _part(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(f.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    inner = phrases.where("words > 2").select("lang", "a", "words", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    inner = inner.select("lang", "a", "m", "w", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("i"))
    held = inner.select("lang", _part(F.col("w"), F.col("i"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = scored.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (whole("longer") * 100 < whole("a") * covered))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase"))
    best = free.withColumn("rank", rank).where(F.col("rank") <= top).join(n, "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))
