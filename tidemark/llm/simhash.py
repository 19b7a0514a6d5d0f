"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into three segments of 22, 21 and 21 bits. If two fingerprints differ in at
most four bits, at most one segment differs in three or more, so at least one pair of segments differs in two
or less each; the keys of golay.py then agree in both. Each fingerprint therefore gives, for each of the three
pairs, all combinations of its segments' codeword indices (1 to 36). Rows that share a key are verified by
their bits. Equal fingerprints are one row before that. Of the links of a task's keys only a spanning forest
leaves it, and the forests of all tasks are thinned once more (`thinned`); a key with more than `block` fingerprints is cut finer and dealt out anew, see links_over.

Defined results: a null text counts as empty, an empty one has fingerprint zero and links like any other; null
ids count as larger than all others; repeated rows stay; rows that share an id but not the text are texts of their own;
an empty table gives no rows; columns other than the id and the text are not returned.

`near_copies` is the verified form: two texts are linked if their sets of `shingle`-word shingles have a Jaccard
similarity of `least` or more. Near copies at 0.8 differ in about 19 of 128 bits, so it takes the Golay keys of
`words` fingerprints (9 segments for 3), keeps pairs that differ in `distance` bits or less in 128 further ones,
and compares all texts of a candidate component by their shingle sets. Of unrelated pairs one in 10^12 is a
candidate, so components stay as small as the groups of similar texts are, up to 10^11 distinct texts or more. What
shares no key and is joined by no third text is not found; the README has the measured share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golay
from .arrays import mixed, slices, tidy, window_hashes, word_hashes
from .arrays import words as words_of
from .common import components, join_classes, text_of, written
from .bitmaps import filtered

SEED, SHINGLE, DISTANCE = 42, 4, 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
PAIRS = ((0, 1), (0, 2), (1, 2))
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64 values."""
    parts = text.lower().split()
    if not parts:
        return 0
    k = min(k, len(parts))
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype=np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        counts += np.unpackbits(h[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for i, j, data, offsets in slices(batch.column(1)):
            whole = data.tobytes()
            out += [fingerprint(whole[offsets[r - i] : offsets[r - i + 1]]) for r in range(i, j)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "fp"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(_fingerprints), f"doc_id {kind}, fp long")


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of these fingerprints."""
    bits = fps.view(np.uint64)
    index = [golay.keys((bits >> np.uint64(at)).astype(np.int64) & (1 << n) - 1) for at, n in SEGMENTS]
    rows, found = [], []
    for p, (a, b) in enumerate(PAIRS):
        both = (p << 24) + (index[a][:, :, None] << 12) + index[b][:, None, :]
        r, i, j = np.nonzero((index[a][:, :, None] >= 0) & (index[b][:, None, :] >= 0))
        rows.append(r)
        found.append(both[r, i, j])
    return np.concatenate(rows), np.concatenate(found).astype(np.int32)


def _keyed(batches):
    for batch in batches:
        fps = np.asarray(batch.column(0))
        for i in range(0, len(fps), 2_000):
            rows, found = keys_of(fps[i : i + 2_000])
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(fps[i : i + 2_000][rows])], ["key", "fp"])


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node reachable over the links i, j."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


FAN = 16


def _tree(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, its parent's row) for trees over the rows of equal labels in which no row has more than FAN children, so
    that no row stands in a hot share of the links."""
    order = np.argsort(label, kind="stable")
    first = np.flatnonzero(np.r_[True, label[order][1:] != label[order][:-1]])[: len(order)]
    begin = np.repeat(first, np.diff(np.r_[first, len(order)]))
    place = np.arange(len(order)) - begin
    child = place > 0
    return order[child], order[begin[child] + (place[child] - 1) // FAN]


def links_in_groups(group: np.ndarray, fps: np.ndarray, distance: int = DISTANCE, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by group; a spanning forest of the links within each group as (row, its parent's row). more: 64 further
    bits a row, which count like those of fps."""
    n = len(fps)
    ends = np.flatnonzero(np.r_[group[1:] != group[:-1], True]) + 1 if n else np.zeros(0, np.int64)
    end = np.repeat(ends, np.diff(np.r_[0, ends]))
    here, bits, label = np.arange(n), fps.view(np.uint64), np.arange(n)
    further = None if more is None else more.view(np.uint64)
    left, right, held, step = [label], [label], 0, 1
    while True:
        here = here[here + step < end[here]]
        if len(here):
            apart = np.bitwise_count(bits[here] ^ bits[here + step])
            if further is not None:
                apart += np.bitwise_count(further[here] ^ further[here + step])
            near = here[apart <= distance]
            near = near[label[near] != label[near + step]]
            left.append(near)
            right.append(near + step)
            held, step = held + len(near), step + 1
        if held > 500_000 or not len(here):
            label = _forest(np.concatenate(left), np.concatenate(right), n)
            left, right, held = [np.arange(n)], [label], 0
        if not len(here):
            break
    return _tree(label)


def _linker(block: int, final: bool, distance: int = DISTANCE):
    """Streams rows (key, fp, and more where given) sorted by all. Groups over `block` rows leave as (fp, key, number of
    blocks, more), unless final."""

    def run(batches):
        held, rows_held = [], 0

        def ready(parts):
            k, f, *more = (np.concatenate(c) for c in zip(*parts, strict=True))
            new = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in (k, f, *more)])][: len(k)]
            k, f, *more = (c[new] for c in (k, f, *more))
            cuts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            sizes = np.diff(np.r_[cuts, len(k)])
            hot = np.repeat(sizes > block, sizes) if not final else np.zeros(len(k), bool)
            few = f[~hot]
            rows, roots = links_in_groups(k[~hot], few, distance, *(c[~hot] for c in more))
            # Texts that are near meet under many keys: one forest stands for the links of all keys of a batch.
            ends, place = np.unique(few, return_inverse=True)
            few = ends
            rows, roots = _tree(_forest(place[rows], place[roots], len(ends)))
            blocks = np.repeat(-(-sizes // block), sizes)[hot].astype(np.int32)
            none = np.zeros(len(rows), np.int64)
            columns = [np.r_[few[rows], f[hot]], np.r_[few[roots], k[hot].astype(np.int64)], np.r_[none.astype(np.int32), blocks], *(np.r_[none, c[hot]] for c in more)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "blocks", "more"][: len(columns)])

        for batch in batches:
            columns = [np.asarray(c) for c in batch.columns]
            k = columns[0]
            if not len(k):
                continue
            last = int(np.searchsorted(k, k[-1]))  # the last key may go on in the next batch
            if last == 0 and held and held[-1][0][-1] == k[-1]:
                held.append(columns)
                rows_held += len(k)
                continue
            yield from ready([*held, [c[:last] for c in columns]])
            held, rows_held = [[c[last:] for c in columns]], len(k) - last
        if rows_held:
            yield from ready(held)

    return run


def _thin(batches):
    """(a, b) to links from each node to the smallest one that the task's links reach from it."""
    held, n = [], 0

    def least():
        ends, place = np.unique(np.concatenate([np.concatenate(c) for c in zip(*held, strict=True)]), return_inverse=True)
        label = _forest(place[:n], place[n:], len(ends))
        rows = np.flatnonzero(label != np.arange(len(ends)))
        return pa.RecordBatch.from_arrays([pa.array(ends[rows]), pa.array(ends[label[rows]])], ["a", "b"])

    for batch in batches:
        held.append([np.asarray(c) for c in batch.columns])
        n += len(batch)
        if n >= 1_000_000:
            yield least()
            held, n = [], 0
    if n:
        yield least()


def thinned(links: DataFrame) -> DataFrame:
    """Links (a, b) between longs, reduced to distinct ones (a > b) with the same components.

    A group of n near texts has up to a link a key for each text. They meet by their greater end, and a task keeps one a node, to
    the smallest node it reaches, which is one of a few in a dense group: n links a task at most, and hardly more than n in all."""
    ends = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return ends.repartition("a").mapInArrow(tidy(_thin), "a long, b long").distinct()


LINKS = "a long, b long, blocks int"


def linked(fps: DataFrame, block: int = 2_000) -> DataFrame:
    """fps: distinct fingerprints in column fp. Links (a, b) whose components are those of all links at DISTANCE or less."""
    return links_over(fps.select("fp").mapInArrow(tidy(_keyed), "key int, fp long"), block, DISTANCE)


def _finer(distance: int, more: bool = False):
    """Keys of hot keys' rows (a: fingerprint, b: key, and more where given): the bits are cut into distance + 1 parts, one
    of which has no error. No part goes over the border of two columns."""
    columns = ["a", "more"] if more else ["a"]
    parts = []
    for i, column in enumerate(columns):
        n = (distance + 1 + i) // len(columns)
        cuts = [64 * j // n for j in range(n + 1)]
        parts += [F.shiftrightunsigned(column, low).bitwiseAND(F.lit((1 << high - low) - 1)) for low, high in zip(cuts[:-1], cuts[1:], strict=True)]
    return F.explode(F.array(*[F.xxhash64("b", F.lit(i), p) for i, p in enumerate(parts)]))


def links_over(keyed: DataFrame, block: int, distance: int) -> DataFrame:
    """keyed: key, fp, and more, 64 further bits, where they count too. Links (a, b) between fp whose components are those
    of all links at `distance` or less under a common key.

    A key with more than `block` fingerprints is cut finer by exact parts of the fingerprint, and what stays that large,
    as copies that differ in few places do, is dealt out in pairs of blocks. Both lose nothing.
    """
    more = ["more"] if "more" in keyed.columns else []
    schema = LINKS + (", more long" if more else "")
    grouped = lambda df, final: df.repartition("key").sortWithinPartitions("key", "fp", *more).mapInArrow(tidy(_linker(block, final, distance)), schema)
    found = written(grouped(keyed, False), "links")
    links, hot = found.filter("blocks = 0").select("a", "b"), found.filter("blocks > 0")
    if hot.isEmpty():
        return thinned(links)
    found = written(grouped(hot.select(_finer(distance, bool(more)).alias("key"), F.col("a").alias("fp"), *more), False), "links")
    links, hot = links.union(found.filter("blocks = 0").select("a", "b")), found.filter("blocks > 0")
    # Each pair of blocks of a hot key is a group of its own; a fingerprint goes to all pairs that hold its block.
    mine = F.pmod(F.xxhash64("a", "b"), F.col("blocks")).cast("int")
    dealt = hot.select(F.col("b").alias("key"), F.col("a").alias("fp"), *more, mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "fp", *more)
    return thinned(links.union(grouped(dealt, True).select("a", "b")))


def rooted(classes: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """classes: key, least (an id, unique to no class). Links (a, b) between keys. (key, component): the smallest node
    (no id, least, key) reachable, as a struct; a class without links is its own."""
    node = F.struct(F.col("least").isNull().alias("none"), "least", F.col(key).alias("key"))
    named = classes.select(F.col(key).alias("key"), node.alias("node"))
    ends = links.join(named.select(F.col("key").alias("a"), F.col("node").alias("x")), "a").join(named.select(F.col("key").alias("b"), F.col("node").alias("y")), "b")
    groups = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    groups = groups.select(F.col("node.key").alias("key"), "component")
    return named.join(groups, "key", "left").select(F.col("key").alias(key), F.coalesce("component", "node").alias("component"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): the fingerprint as a long, and the smallest id reachable over links."""
    prints = written(fingerprints(df, id_col, text), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    of = rooted(classes, linked(classes), "fp").join(classes.select("fp", "n"), "fp")
    of = written(of.select("fp", "n", F.col("component.least").alias("component_id")), "roots")
    return join_classes(prints, of, "fp").select("doc_id", "fp", "component_id")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each document of a slice the sorted distinct 64-bit hashes of its k-word shingles, ASCII letters in lower case."""
    low = _LOWER[data]
    starts, ends, first = words_of(low, offsets)
    hashes = word_hashes(low, starts, ends)
    windows = window_hashes(hashes, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield np.unique(windows[a : b - k + 1] if b - a >= k else window_hashes(hashes[a:b], b - a) if b > a else hashes[:0])


def set_fingerprints(shingles: np.ndarray, words: int) -> np.ndarray:
    """`words` independent 64-bit SimHash fingerprints of a set of shingle hashes."""
    counts, salts = np.zeros(64 * words, np.int64), np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(0, len(shingles), 1 << 13):
        h = mixed(shingles[i : i + (1 << 13), None] ^ salts)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(counts * 2 > len(shingles), bitorder="little").view("<u8").astype(np.uint64)


def set_name(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a sorted set."""
    return xxhash.xxh128_digest(shingles.tobytes(), SEED)


def _set_prints(k: int, words: int):
    """(doc_id, tx, text) to (doc_id, tx, th, fp, more, words): th names the set, fp and more check candidates, words give keys."""

    def run(batches):
        for batch in batches:
            th, prints = [], []
            for _, _, data, offsets in slices(batch.column(2)):
                for s in shingle_sets(data, offsets, k):
                    th.append(set_name(s))
                    prints.append(set_fingerprints(s, words + 2))
            p = np.array(prints, np.uint64).reshape(-1, words + 2).view(np.int64)
            keys = pa.FixedSizeListArray.from_arrays(pa.array(p[:, 2:].ravel()), words).cast(pa.list_(pa.int64()))
            columns = [pa.array(th, pa.binary()), pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy()), keys]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "tx", "th", "fp", "more", "words"])

    return run


def _keyed_words(words: int):
    """(fp, more, words) to (key, fp, more) for the keys of all words."""

    def run(batches):
        for batch in batches:
            fps, more, all_words = np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.asarray(batch.column(2).flatten()).reshape(-1, words)
            for i in range(0, len(fps), 1_000):
                for w in range(words):
                    rows, found = keys_of(np.ascontiguousarray(all_words[i : i + 1_000, w]))
                    yield pa.RecordBatch.from_arrays([pa.array(found + np.int32(len(PAIRS) * w << 24)), pa.array(fps[i + rows]), pa.array(more[i + rows])], ["key", "fp", "more"])

    return run


def _sets(k: int):
    """text to (th, shingles)."""

    def run(batches):
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                sets = list(shingle_sets(data, offsets, k))
                yield pa.RecordBatch.from_arrays([pa.array(map(set_name, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["th", "shingles"])

    return run


def jaccard_forest(sets: list[np.ndarray], least: float) -> np.ndarray:
    """For each set (sorted, without repeats) the smallest index reachable over pairs with a Jaccard similarity of `least` or more."""
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    begin, label = np.cumsum(size) - size, np.arange(n)
    token = np.unique(np.concatenate(sets), return_inverse=True)[1] if n else np.zeros(0, np.int64)
    marked = np.zeros(len(token) + 1, bool)
    for i in range(n - 1):
        mine, after = token[begin[i] : begin[i] + size[i]], np.arange(i + 1, n)
        after = after[(label[after] != label[i]) & (np.minimum(size[after], size[i]) >= least * np.maximum(size[after], size[i])) & (size[after] > 0)]
        if not len(after) or not size[i]:
            continue
        marked[mine] = True
        ends = np.cumsum(size[after])
        flat = np.repeat(begin[after] - (ends - size[after]), size[after]) + np.arange(ends[-1])
        common = np.add.reduceat(marked[token[flat]].astype(np.int64), ends - size[after])
        marked[mine] = False
        near = after[common >= least * (size[after] + size[i] - common)]
        if len(near):
            joined = np.isin(label, np.r_[label[near], label[i]])
            label[joined] = label[joined].min()
    return label


def _verified(least: float):
    """Streams rows (grp, th, shingles) sorted by grp to links (a, b) between th."""

    def links(rows):
        label = jaccard_forest([np.frombuffer(s, np.uint64) for _, s in rows], least)
        ids = pa.array([t for t, _ in rows], pa.binary())
        return pa.RecordBatch.from_arrays([ids.take(pa.array(x)) for x in _tree(label)], ["a", "b"])

    def run(batches):
        now, rows = None, []
        for batch in batches:
            for g, t, s in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if g != now and rows:
                    yield links(rows)
                    rows = []
                now = g
                rows.append((t, s))
        if rows:
            yield links(rows)

    return run


def near_copies(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8, distance: int = 30, words: int = 3, block: int = 1_000) -> DataFrame:
    """(doc_id, component_id, tx, first): the smallest id reachable over pairs whose shingle sets have a Jaccard similarity of
    `least` or more, the xxhash64 of the text (null: empty), and whether the row is the one of its component to keep:
    that of the smallest id, and of rows with that id the one with the smallest hash of its set, then of its text. Rows
    that repeat id and text are alike in all columns."""
    kind = df.schema[id_col].dataType.simpleString()
    named = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text)).alias("tx"), F.col(text).alias("text"))
    prints = written(named.mapInArrow(tidy(_set_prints(shingle, words)), f"doc_id {kind}, tx long, th binary, fp long, more long, words array<long>"), "fingerprints")
    classes = written(prints.groupBy("th").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tx")).alias("first"), F.min("tx").alias("tx"), F.first("fp").alias("fp"), F.first("more").alias("more"), F.first("words").alias("words"), F.count("*").alias("n")), "classes")
    classes = classes.withColumn("least", F.col("first.doc_id"))
    keyed = classes.select("fp", "more", "words").distinct().mapInArrow(tidy(_keyed_words(words)), "key int, fp long, more long")
    groups = components(links_over(keyed, 2_000, distance))
    of = classes.join(groups, classes.fp == groups.node, "left").select("th", "tx", F.coalesce("component", "fp").alias("root"))
    several = written(of.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").withColumn("size", F.col("n")), "several")
    members = written(join_classes(of, several, "root"), "members")
    sets = filtered(named.select("text", "tx"), "tx", members.select("tx"), tidy(_sets(shingle)), "th binary, shingles binary").dropDuplicates(["th"])
    # Every two texts of a candidate component meet in a group: a component over `block` is dealt out in pairs of blocks.
    blocks = F.ceil(F.col("size") / block).cast("int")
    mine = F.pmod(F.xxhash64("th"), blocks).cast("int")
    dealt = members.join(sets, "th").select("root", "th", "shingles", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select(F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other")).alias("grp"), "th", "shingles")
    near = dealt.repartition("grp").sortWithinPartitions("grp").mapInArrow(tidy(_verified(least)), "a binary, b binary")
    of = written(rooted(classes, near, "th").join(classes.select("th", "first", "n"), "th").select("th", "component", "first", "n"), "roots")
    head = F.col("component.key").eqNullSafe(F.col("th")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tx") == F.col("first.tx"))
    return join_classes(prints.select("doc_id", "tx", "th"), of, "th").select("doc_id", F.col("component.least").alias("component_id"), "tx", head.alias("first"))
