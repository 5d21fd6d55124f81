"""Corpus-wide line dedup with a segment-partition edit join.

Lines with a word are duplicates when they are equal, or when their words differ by few edits:
a word put in, taken out or replaced is one edit.  How many are few grows with the length
(``Limits``): none under 8 words, one under 40, then one for each 20 words of the shorter line,
four at most.  Of each class (what such links connect) the occurrence with the smallest
(doc_id, line number) stays; the other lines go.

The edit join never compares all lines.  A line that may have t edits is cut into t + 1
segments of words; if at most t edits turn one line into another, some segment n of the shorter
occurs in the longer, behind n edits at most and before t - n at most.  So the first half of the
segments is told from the start of a line and the second half from its end, where the place of
segment n moves by min(n, t - n) at most.  Both lines give the same few pieces of each segment
(``offsets``), one pair of which stands at any such distance.  Segments are laid out by the upper
bits of a length (``rounded``), so a line has the layouts of its own length and of lengths up to
t less, which is mostly one.  What shares a key is first compared by counts of words in
16 classes, modulo 4: an edit moves them by 2 at most, so this drops no line that is near.  The
rest is verified by banded bit-parallel edit distance.

A key of up to PAIRED_ROWS lines yields its pairs.  Lines of a key of up to GROUP_ROWS are a
group: PIVOTS of them are paired with all of it, what these links connect is labelled, and then
only lines that are not yet connected are compared, in a band of the edit matrix, until nothing
is left to connect: the same classes, without all pairs.  A key with more lines is refined: the
matched piece is taken out and the remainders are joined in the same way under that key, up to LEVELS times, so
a common segment costs another scan and not the pairs of all lines that have it.  What is as
crowded after that shares most of its text; it is dealt out as pairs of blocks of lines, each
pair of blocks a group of its own, so no task holds more than two blocks.

Lines travel as 128-bit hashes; only texts of candidate lines, words of those in groups and
the documents themselves are shuffled.  Null texts stay null.  Blank lines stay.  Rows
that share an id and a text are one document: all such rows keep the same lines.  Null ids sort
first.  Very long lines are hashed whole.  All columns of the input are kept; helper columns
cannot clash, as rows are joined through columns of their own names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlore.llm.common import BASE, arrow_map, bitmap_of, in_bitmap, materialise, mix, read_table, shuffles_cleaned, slices, span_hashes, text_bytes, word_spans
from gridlore.llm.graph import connected_components


@dataclass(frozen=True)
class Limits:
    """Word edits between near lines: one for each ``words_an_edit`` words of the shorter line, from one to ``most``."""

    least: int = 8
    words_an_edit: int = 20
    most: int = 4

    def of(self, words):
        """Edits of lines with so many words; none under ``least``."""
        return np.where(np.asarray(words) < self.least, 0, np.clip(np.asarray(words) // self.words_an_edit, 1, self.most))


LIMITS = Limits()
PAIRED_ROWS = 64
GROUP_ROWS = 2048
PIVOTS = 1
LEVELS = 3
PAIR, GROUP, CROWD = range(3)
#: Hashes of lines that a worker remembers, to send a repeated line once; what was dropped is sent anew.
REMEMBERED_LINES = 100_000


def rounded(length: np.ndarray) -> np.ndarray:
    """Lengths with all bits but the upper three cleared."""
    low = np.maximum(np.frexp(np.asarray(length, float))[1] - 3, 0)
    return length >> low << low


def offsets(reach: int) -> list[int]:
    """Places of which some two differ by d, for each d up to ``reach``."""
    return [0, 1, 3] if reach == 3 else list(range(reach + 1))


def line_hash(line: bytes) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(line)
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def line_hashes(lines: list[bytes]) -> np.ndarray:
    """line_hash of each line, two longs a row."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), "<i8").reshape(-1, 2)


def texts_in(part: pa.RecordBatch) -> list[bytes | None]:
    """Texts as bytes: lines are cut, told from blank ones and hashed without decoding them."""
    return part.column("text").cast(pa.large_binary()).to_pylist()


def lines_of(text: bytes | None) -> list[bytes]:
    return text.split(b"\n") if text else []


def has_word(line: bytes) -> bool:
    return bool(line) and not line.isspace()


SEEN = np.ones(256, bool)
SEEN[[0x20, *range(0x09, 0x0E)]] = False


class LineWords:
    """Hashes of the words of some lines, end to end."""

    def __init__(self, lines: list[bytes]):
        data, offsets = text_bytes(pa.array(lines, pa.large_binary()))
        starts, ends, rows = word_spans(data, offsets, SEEN)
        self.words = span_hashes(data, starts, ends)
        self.length = np.bincount(rows, minlength=len(lines))
        self.start = np.cumsum(self.length) - self.length

    def of(self, n: int) -> np.ndarray:
        return self.words[self.start[n] : self.start[n] + self.length[n]]


# the two sides of the join, as keys


class Powers:
    """Powers of the base of a rolling hash modulo 2^64, and of its inverse."""

    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, size: int) -> None:
        if len(self.up) < size:
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size * 2, BASE)]))
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size * 2, self.inverse)]))


POWERS = Powers()


class Rolling:
    """Hashes of any span of a sequence of word hashes."""

    def __init__(self, words: np.ndarray):
        POWERS.grow(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum((words + np.uint64(1)) * POWERS.up[: len(words)], out=self.sums[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * POWERS.down[start]


def key_of(prefix: np.ndarray, layout: np.ndarray, t: int, n: int, piece: np.ndarray) -> np.ndarray:
    return mix(mix(piece + np.uint64(n)) + (layout * 64 + t).astype(np.uint64) * BASE + prefix)


class Views:
    """What is left of lines on their way through hot keys; at first, whole lines.

    A view behind a key meets others behind it, of which it may differ by ``edits``, those
    of the key; how many edits a whole line may have is told by its length.
    """

    def __init__(self, words, length, line, prefix=None, edits=None):
        self.words, self.length, self.line = words, length, line
        self.start = np.cumsum(length) - length
        self.prefix = np.zeros(len(length), np.uint64) if prefix is None else prefix
        self.edits = edits
        self.rolling = Rolling(words)

    def keys(self, limits: Limits) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
        """(views, keys, start, end, edits) of all pieces; each may be the shorter of two near lines or be up to its edits longer."""
        before = None
        for gap in range(limits.most + 1):
            short = np.maximum(self.length - gap, 0)
            edits, layout = limits.of(short) if self.edits is None else self.edits, rounded(short)
            new = (self.length >= gap) & (edits >= max(gap, 1))
            if before is not None:
                new &= (edits != before[0]) | (layout != before[1])
            before = edits, layout
            for t in range(max(gap, 1), limits.most + 1):
                on = np.flatnonzero(new & (edits == t))
                if len(on):
                    yield from self.made(on, layout[on], t)

    def made(self, on: np.ndarray, layout: np.ndarray, t: int):
        wide = layout // (t + 1)
        for n in range(t + 1):
            reach = min(n, t - n)
            first = n * wide if n <= t - n else self.length[on] - (t + 1 - n) * wide
            for offset in offsets(reach):
                a = first + np.minimum(offset, wide)
                b = a + np.maximum(wide - reach, 0)
                piece = self.rolling.span(self.start[on] + a, self.start[on] + b)
                yield on, key_of(self.prefix[on], layout, t, n, piece), a, b, t

    def behind(self, hot: np.ndarray, limits: Limits) -> Views:
        """Views without the piece of each key in the bitmap."""
        parts = []
        for on, key, a, b, t in self.keys(limits):
            hit = np.flatnonzero(in_bitmap(hot, key))
            parts.append((on[hit], key[hit], a[hit], b[hit], np.full(len(hit), t)))
        if not parts:
            return Views(self.words[:0], self.length[:0], self.line[:0])
        on, key, a, b, t = (np.concatenate(x) for x in zip(*parts, strict=True))
        length = self.length[on] - (b - a)
        place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        source = place + np.repeat(self.start[on], length) + np.where(place >= np.repeat(a, length), np.repeat(b - a, length), 0)
        return Views(self.words[source], length, self.line[on], key, t)


#: Words of lines that are refined, or compared within a group, together.
TOGETHER = 1 << 16


def refined(words: LineWords, limits: Limits, hot: list[np.ndarray]) -> Iterator[Views]:
    """The lines' views behind all hot keys, some lines at a time."""
    whole = Views(words.words, words.length, np.arange(len(words.length)))
    if not hot:
        yield whole
        return
    hits = [on[in_bitmap(hot[0], key)] for on, key, *_ in whole.keys(limits)]
    lines = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(words.length[lines]) // TOGETHER)) + 1
    for some in np.split(lines, cuts):
        if len(some):
            views = Views(np.concatenate([words.of(n) for n in some]), words.length[some], some)
            for bitmap in hot:
                views = views.behind(bitmap, limits)
            yield views


def profiles(words: LineWords) -> np.ndarray:
    """Counts of words in 16 classes, modulo 4, as 32 bits a line."""
    lines = len(words.length)
    classes = (words.words >> np.uint64(60)).astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(lines) * 16, words.length) + classes, minlength=16 * lines)
    return ((counts.reshape(-1, 16) & 3) << (2 * np.arange(16))).sum(axis=1).astype(np.uint32).view(np.int32)


CIRCLE = np.array([0, 1, 2, 1], np.uint8)
LANES = 2 * np.arange(16, dtype=np.uint32)


def lanes(profile: np.ndarray) -> np.ndarray:
    return ((profile.view(np.uint32)[:, None] >> LANES) & np.uint32(3)).astype(np.uint8)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At most the sum of differences of the counts, which is at most twice the edits."""
    return CIRCLE[(a - b) & 3].sum(axis=-1)


def new_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Lines with a word that this task has not met of late, with their hashes; the lowest bit is free."""
    seen: set[int] = set()
    for batch in batches:
        for part in slices(batch, "text"):
            lines = [x for text in texts_in(part) if text for x in text.split(b"\n") if x and not x.isspace()]
            hashes = line_hashes(lines)[:, 0] & -2
            new = []
            for n, h in enumerate(hashes.tolist()):
                if h not in seen:
                    seen.add(h)
                    new.append(n)
            if len(seen) > REMEMBERED_LINES:
                seen.clear()
            if new:
                yield [lines[n] for n in new], hashes[new]


def keys(docs: DataFrame, limits: Limits, hot: list[np.ndarray]) -> DataFrame:
    """(key, member, profile): member is the line's hash."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, member in new_lines(batches):
            words = LineWords(lines)
            profile = profiles(words)
            for views in refined(words, limits, shared.value):
                made = [(views.line[on], key) for on, key, *_ in views.keys(limits)]
                if made:
                    yield pa.RecordBatch.from_pydict(
                        {
                            "key": np.concatenate([k for _, k in made]).view(np.int64),
                            "member": np.concatenate([member[on] for on, _ in made]),
                            "profile": np.concatenate([profile[on] for on, _ in made]),
                        }
                    )

    return docs.select("text").mapInArrow(run, "key long, member long, profile int")


def candidates(keyed: DataFrame, paired: int, most: int, edits: int) -> DataFrame:
    """(kind, a, b): pairs a < b of lines that meet under a key, (key, line) of groups, (key, null) of crowds."""
    dealt = keyed.repartition("key").sortWithinPartitions("key")  # one long: Spark sorts it by radix

    def pairs(key: np.ndarray, member: np.ndarray, profile: np.ndarray) -> Iterator[pa.RecordBatch]:
        same = np.diff(key) == 0
        met = np.flatnonzero(np.append(same, False) | np.append(False, same))  # most keys have one line, which meets none
        if not len(met):
            return
        order = met[np.lexsort((member[met], key[met]))]
        key, member, profile = key[order], member[order], profile[order]
        new = np.concatenate([[True], (np.diff(key) != 0) | (np.diff(member) != 0)])
        key, member, profile = key[new], member[new], profile[new]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        sizes = np.diff(cuts)
        two = cuts[:-1][sizes == 2]
        left, right = [member[two]], [member[two + 1]]
        near = [apart(lanes(profile[two]), lanes(profile[two + 1])) <= 2 * edits]
        pivots: list[np.ndarray] = []
        for k in np.flatnonzero((sizes > 2) & (sizes <= most)):
            run = member[cuts[k] : cuts[k + 1]]
            lane = lanes(profile[cuts[k] : cuts[k + 1]])
            if len(run) > paired:
                x, y = np.repeat(np.arange(PIVOTS), len(run)), np.tile(np.arange(len(run)), PIVOTS)
                on = apart(lane[x], lane[y]) <= 2 * edits
                pivots.append(np.stack([run[x[on]], run[y[on]]]))
                continue
            x, y = np.triu_indices(len(run), 1)
            left.append(run[x])
            right.append(run[y])
            near.append(apart(lane[x], lane[y]) <= 2 * edits)
        a, b, close = (np.concatenate(x) for x in (left, right, near))
        a, b = (np.concatenate(x) for x in zip((a[close], b[close]), *pivots, strict=True))
        a, b = a[a != b], b[a != b]
        kinds = np.full(len(a), PAIR, np.int32)
        yield pa.RecordBatch.from_pydict({"kind": kinds, "a": np.minimum(a, b), "b": np.maximum(a, b)})
        grouped = np.repeat((sizes > paired) & (sizes <= most), sizes)
        if grouped.any():
            kinds = np.full(np.count_nonzero(grouped), GROUP, np.int32)
            yield pa.RecordBatch.from_pydict({"kind": kinds, "a": key[grouped], "b": member[grouped]})
        yield crowded(key[cuts[:-1][sizes > most]])

    def crowded(key: np.ndarray) -> pa.RecordBatch:
        kinds = np.full(len(key), CROWD, np.int32)
        return pa.RecordBatch.from_pydict({"kind": kinds, "a": key, "b": pa.nulls(len(key), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, held_profile = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        passing = None
        for batch in batches:
            key = np.concatenate([held_key, np.asarray(batch.column("key"))])
            member = np.concatenate([held, np.asarray(batch.column("member"))])
            profile = np.concatenate([held_profile, np.asarray(batch.column("profile"))])
            if passing is not None:
                n = int(np.searchsorted(key, passing, side="right"))
                key, member, profile = key[n:], member[n:], profile[n:]
            last = int(np.searchsorted(key, key[-1], side="left")) if len(key) else 0
            if last:
                yield from pairs(key[:last], member[:last], profile[:last])
            held, only = np.unique(member[last:], return_index=True)
            held_key, held_profile = key[last:][only], profile[last:][only]
            if len(held) > most:
                passing = held_key[0]
                yield crowded(held_key[:1])
                held_key, held, held_profile = held_key[:0], held[:0], held_profile[:0]
        if len(held):
            yield from pairs(held_key, held, held_profile)

    return dealt.mapInArrow(run, "kind int, a long, b long")


def crowd_rows(docs: DataFrame, limits: Limits, hot: list[np.ndarray]) -> DataFrame:
    """(key, member) of the lines with a key in the last bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, member in new_lines(batches):
            for views in refined(LineWords(lines), limits, shared.value[:-1]):
                for on, key, *_ in views.keys(limits):
                    hit = np.flatnonzero(in_bitmap(shared.value[-1], key))
                    yield pa.RecordBatch.from_pydict({"key": key[hit].view(np.int64), "member": member[views.line[on[hit]]]})

    return docs.select("text").mapInArrow(run, "key long, member long").distinct()


def words_of(texts: DataFrame) -> DataFrame:
    """(member, words) of the lines in ``texts``, words as 32-bit hashes; what they link is verified by the texts."""

    def run(part: pa.RecordBatch) -> dict:
        words = LineWords(texts_in(part))
        short = (words.words >> np.uint64(32)).astype(np.uint32)
        own = [short[a : a + n].tobytes() for a, n in zip(words.start, words.length, strict=True)]
        return {"member": part.column("line"), "words": pa.array(own, pa.binary())}

    return arrow_map(texts, run, "member long, words binary", "text")


def cross_pairs(texts: DataFrame, rows: DataFrame, roots: DataFrame, limits: Limits, most: int) -> DataFrame:
    """(a, b): pairs that connect what all links within the keys connect, beside those known by their roots."""
    labels = roots.select(F.col("node").alias("member"), "root")
    rooted = materialise(rows.join(labels, "member", "left").select("key", "member", F.coalesce("root", "member").alias("root")))
    sizes = rooted.groupBy("key").agg(
        F.ceil(F.count("*") / most).cast("int").alias("blocks"), F.min("root").alias("low"), F.max("root").alias("high")
    )
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    mixed = materialise(rooted.join(sizes.where("low <> high").drop("low", "high"), "key"))
    words = words_of(texts.join(mixed.select(F.col("member").alias("line")).distinct(), "line", "left_semi"))
    dealt = (
        mixed.join(words, "member")
        .withColumn("own", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(other))
        .where("own <> other or blocks = 1")
        .select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "member", "words", "root")
        .repartition("key", "x", "y")
        .sortWithinPartitions("key", "x", "y", "member")
    )

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("key", "x", "y", "member", "words", "root")), strict=True):
                if r[:3] != now:
                    if held:
                        yield connect(held, limits)
                    now, held = r[:3], []
                held.append(r[3:])
        if held:
            yield connect(held, limits)

    return dealt.mapInArrow(links, "a long, b long")


FAR = 60


def padded(lines: list[np.ndarray], lead: int, width: int) -> np.ndarray:
    out = np.zeros((len(lines), lead + width), np.uint32)
    for row, line in zip(out, lines, strict=True):
        row[lead : lead + len(line)] = line
    return out


def few_edits(one: list[np.ndarray], other: list[np.ndarray], limits: Limits) -> np.ndarray:
    """Whether one[n] and other[n] are near, for all n, in a band of each edit matrix."""
    size, length = (np.array([len(w) for w in side], np.int64) for side in (one, other))
    allowed = limits.of(np.minimum(size, length))
    out = np.zeros(len(one), bool)
    todo = np.flatnonzero(np.abs(size - length) <= allowed)
    if not len(todo):
        return out
    size, length, edits = size[todo], length[todo], limits.most
    longest = int(length.max())
    band = padded([one[n] for n in todo], edits, max(int(size.max()), longest) + edits)
    table = padded([other[n] for n in todo], 0, longest).T.copy()
    steps = np.arange(2 * edits + 1, dtype=np.int8)
    row = steps - edits
    cost = np.tile(np.where(row >= 0, row, FAR).astype(np.int8), (len(todo), 1))
    last = np.full(len(todo), FAR, np.int64)
    for j in range(1, longest + 1):
        turned = cost + (band[:, j - 1 : j + 2 * edits] != table[j - 1][:, None])
        turned[:, :-1] = np.minimum(turned[:, :-1], cost[:, 1:] + 1)
        if j <= edits:
            turned[:, edits - j], turned[:, : edits - j] = j, FAR
        cost = np.minimum(np.minimum.accumulate(turned - steps, axis=1) + steps, FAR).astype(np.int8)
        done = np.flatnonzero(length == j)
        if len(done):
            last[done] = cost[done, size[done] - j + edits]
    out[todo] = last <= allowed[todo]
    return out


def connect(held: list[tuple[int, bytes, int]], limits: Limits) -> pa.RecordBatch:
    """Links among these lines (member, words, root) that join different roots."""
    member = np.array([m for m, _, _ in held], np.int64)
    words = [np.frombuffer(w, np.uint32) for _, w, _ in held]
    _, root = np.unique([r for _, _, r in held], return_inverse=True)
    length = np.array(list(map(len, words)), np.int64)
    classes = np.concatenate([n * 128 + (w >> np.uint32(25)).astype(np.int64) for n, w in enumerate(words)])
    counts = np.minimum(np.bincount(classes, minlength=128 * len(words)).reshape(-1, 128), 100).astype(np.int8)
    order = np.argsort(np.bincount(root)[root], kind="stable")  # lines of small classes first
    left, right = [], []
    held_x: list[np.ndarray] = []
    held_y: list[np.ndarray] = []
    waiting = 0

    def link() -> None:
        xs, ys = np.concatenate(held_x), np.concatenate(held_y)
        close = few_edits([words[x] for x in xs], [words[y] for y in ys], limits)
        for x, y in zip(xs[close], ys[close], strict=True):
            if root[x] != root[y]:
                left.append(member[x])
                right.append(member[y])
                root[root == root[y]] = root[x]
        held_x.clear()
        held_y.clear()

    for place, x in enumerate(order):
        rest = order[place + 1 :]
        rest = rest[root[rest] != root[x]]
        edits = limits.of(np.minimum(length[x], length[rest]))
        on = np.abs(length[rest] - length[x]) <= edits
        rest, edits = rest[on], edits[on]
        rest = rest[np.abs(counts[rest] - counts[x]).sum(axis=1) <= 2 * edits]  # an edit moves the counts by 2 at most
        if not len(rest):
            continue
        held_x.append(np.full(len(rest), x))
        held_y.append(rest)
        waiting += len(rest) * length[x]
        if waiting >= TOGETHER:
            link()
            waiting = 0
    if held_x:
        link()
    a, b = np.array(left, np.int64), np.array(right, np.int64)
    return pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})


# verification


def within(a: Sequence, b: Sequence, edits: int) -> bool:
    """Whether at most ``edits`` edits of elements turn a into b, by a band of bits along the diagonal."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > edits:
        return False
    lead = 0
    while lead < len(b) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < len(b) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[lead : len(a) - tail], b[lead : len(b) - tail]
    gap = distance = len(a) - len(b)
    where: dict = {}
    for n, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << n
    width = 2 * edits + 1
    mask = (1 << width) - 1
    goal = 1 << (gap + edits)
    plus, minus = mask & (mask << edits), 0  # vertical steps of the column before, rows j - edits ... j + edits
    for j, c in enumerate(b):
        shift = j - edits
        same = where.get(c, 0)
        same = (same >> shift if shift >= 0 else same << -shift) & mask
        diagonal = ((((same & plus) + plus) ^ plus) | same | minus) & mask
        up = minus | (~(diagonal | plus) & mask)
        down = diagonal & plus
        if not diagonal & goal:
            distance += 1
            if distance > edits:
                return False
        moved = diagonal >> 1
        plus = (down | ~(moved | up)) & mask
        minus = moved & up
    return distance <= edits


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, text) of the lines whose hash is in ``wanted``, a frame of longs ``line``."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted, "line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, line in new_lines(batches):
            on = in_bitmap(shared.value, line)
            yield pa.RecordBatch.from_pydict(
                {"line": line[on], "text": pa.array([lines[i] for i in np.flatnonzero(on)], pa.binary())}
            )

    made = docs.select("text").mapInArrow(run, "line long, text binary")
    return made.groupBy("line").agg(F.min("text").alias("text"))


def near(a: str | bytes, b: str | bytes, limits: Limits) -> bool:
    x, y = ((t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t).split() for t in (a, b))
    return within(x, y, int(limits.of(min(len(x), len(y)))))


def verified(texts: DataFrame, pairs: DataFrame, limits: Limits) -> DataFrame:
    """(a, b) of the pairs within the edits of the shorter line; (line, text) has both."""
    left = texts.select(F.col("line").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("line").alias("b"), F.col("text").alias("b_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a_text").to_pylist(), batch.column("b_text").to_pylist()
            on = pa.array([near(x, y, limits) for x, y in zip(a, b, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(on)

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "a_text", "b_text")
    return both.mapInArrow(run, "a long, b long")


def near_links(docs: DataFrame, limits: Limits = LIMITS, paired: int = PAIRED_ROWS, most: int = GROUP_ROWS, levels: int = LEVELS) -> DataFrame:
    """(a, b): hashes of different lines of ``text`` that are near.

    All such pairs, but for those that only meet in keys of more than ``paired`` lines: these
    come as forests that connect the same lines.
    """
    pairs, rows, hot = None, None, []  # rows: (key, member) of groups
    for level in range(levels):
        met = materialise(candidates(keys(docs, limits, hot), paired, most, limits.most).distinct())
        found = met.where(f"kind = {PAIR}").select("a", "b")
        pairs = found if pairs is None else pairs.union(found).distinct()
        crowds = met.where(f"kind = {CROWD}")
        last = level + 1 == levels
        grouped = met.where(f"kind = {GROUP}").select(F.col("a").alias("key"), F.col("b").alias("member"))
        rows = grouped if rows is None else rows.union(grouped)
        if crowds.isEmpty():
            break
        hot.append(bitmap_of(crowds, "a"))
        if last:
            rows = rows.union(crowd_rows(docs, limits, hot))
    wanted = pairs.select(F.col("a").alias("line")).union(pairs.select("b")).union(rows.select("member"))
    texts = materialise(texts_of(docs, wanted))  # one more pass over the documents, whatever the lines are for
    links = materialise(verified(texts, pairs, limits))
    if rows.isEmpty():
        return links
    crossing = materialise(cross_pairs(texts, rows, connected_components(links), limits, most).distinct())
    return materialise(links.union(verified(texts, crossing, limits)).distinct())


# classes and removal


PLACE = "decimal(38,0)"


def place_of(doc: np.ndarray, line_no: np.ndarray) -> pa.Array:
    """(doc, line number) as one number in the same order: 128 bits, the low 32 of them the line."""
    raw = np.empty((len(doc), 2), np.int64)
    raw[:, 0] = (doc << np.int64(32)) | line_no
    raw[:, 1] = doc >> np.int64(32)
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(doc), [None, pa.py_buffer(raw.tobytes())])


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc, line_no, place, h1, h2) of every line with a word."""

    def run(part: pa.RecordBatch) -> dict:
        texts = [lines_of(text) for text in texts_in(part)]
        lines = [x for own in texts for x in own]
        count = np.array([len(own) for own in texts], np.int64)
        on = np.array([bool(x) and not x.isspace() for x in lines], bool)
        both = line_hashes([x for x, told in zip(lines, on.tolist(), strict=True) if told])
        docs = np.repeat(np.asarray(part.column("doc")).astype(np.int64), count)[on]
        numbers = (np.arange(len(lines)) - np.repeat(np.cumsum(count) - count, count))[on]
        return {"doc": docs, "line_no": numbers.astype(np.int32), "place": place_of(docs, numbers), "h1": both[:, 0], "h2": both[:, 1]}

    return arrow_map(docs.select("doc", "text"), run, f"doc long, line_no int, place {PLACE}, h1 long, h2 long", "text")


def duplicate_lines(docs: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """(doc, line_no, h1, first_doc, near): lines that are not the first of their class."""
    with shuffles_cleaned(docs.sparkSession):
        spots = materialise(occurrences(docs))
        lines = materialise(spots.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n")))
        roots = connected_components(near_links(docs, limits))
    classed = lines.withColumn("line", F.expr("h1 & -2L")).join(roots, F.col("line") == F.col("node"), "left")
    firsts = classed.where("root is not null").groupBy("root").agg(F.min("first").alias("class_first"))
    linked = classed.where("root is not null").join(firsts, "root").select("h1", "h2", F.col("class_first").alias("winner"), "first", "n")
    alone = classed.where("root is null").select("h1", "h2", F.col("first").alias("winner"), "first", "n")
    first_doc = F.expr(f"CAST((winner - pmod(winner, {1 << 32}BD)) div {1 << 32}BD AS LONG)")
    repeated = linked.union(alone).where("n > 1 or winner <> first").select("h1", "h2", "winner", first_doc.alias("first_doc"), (F.col("winner") != F.col("first")).alias("near"))
    return spots.join(repeated, ["h1", "h2"]).where("place <> winner").select("doc", "line_no", "h1", "first_doc", "near")


NULL_DOC = -(1 << 63)


def dedup_lines(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    limits: Limits = LIMITS,
) -> DataFrame:
    """df with duplicate lines taken out of its text, and a column line_dedup.

    line_dedup is a struct: n_lines (with a word), n_removed, n_near (of those, only nearly
    equal to a line that stays), first_docs (documents in which the removed lines stay).
    """
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_DOC))
    docs = df.select(doc.alias("doc"), F.col(text_col).cast("string").alias("text"))
    drops = (
        duplicate_lines(docs, limits)
        .groupBy("doc")
        .agg(
            F.collect_set(F.struct("line_no", "h1", "near")).alias("drops"),
            F.array_sort(F.collect_set(F.when(F.col("first_doc") != NULL_DOC, F.col("first_doc")))).alias("first_docs"),
        )
    )
    rest = [c for c in df.columns if c != text_col]
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias("_")).alias("row"), F.col(text_col).cast("string").alias("text"), doc.alias("doc"))
    joined = whole.join(drops, "doc", "left")
    schema = whole.select("row").schema.simpleString()[len("struct<row:") : -1]
    work = joined.select(
        "row",
        "text",
        F.coalesce("drops", F.array().cast("array<struct<line_no:int,h1:bigint,near:boolean>>")).alias("drops"),
        F.coalesce("first_docs", F.array().cast("array<bigint>")).alias("first_docs"),
    )

    def run(part: pa.RecordBatch) -> dict:
        texts, counts = [], []
        drops = part.column("drops")
        ends = np.cumsum(np.diff(np.asarray(drops.offsets))).tolist()
        flat = drops.flatten()
        number, h1, is_near = (flat.field(n).to_pylist() for n in range(3))
        start = 0
        for text, end in zip(texts_in(part), ends, strict=True):
            lines = lines_of(text)
            n_words = sum([bool(x) and not x.isspace() for x in lines])
            own = [k for k in range(start, end) if number[k] < len(lines)]
            hashes = line_hashes([lines[number[k]] for k in own])[:, 0].tolist()
            gone = {number[k]: is_near[k] for k, h in zip(own, hashes, strict=True) if h == h1[k]}
            start = end
            if gone:
                text = b"\n".join([x for n, x in enumerate(lines) if n not in gone])
            texts.append(text)
            counts.append((n_words, len(gone), sum(gone.values())))
        columns = np.array(counts, np.int64).reshape(-1, 3)
        return {
            "row": part.column("row"),
            "text": pa.array(texts, pa.binary()).cast(pa.string()),
            "n_lines": columns[:, 0],
            "n_removed": columns[:, 1],
            "n_near": columns[:, 2],
            "first_docs": part.column("first_docs"),
        }

    out = arrow_map(
        work,
        run,
        f"row {schema}, text string, n_lines long, n_removed long, n_near long, first_docs array<long>",
        "text",
    )
    return out.select(
        *[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns],
        F.struct("n_lines", "n_removed", "n_near", "first_docs").alias("line_dedup"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without duplicate lines; one row a document."""
    out = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        "line_dedup.n_lines",
        "line_dedup.n_removed",
        "line_dedup.n_near",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
        "line_dedup.first_docs",
    )
