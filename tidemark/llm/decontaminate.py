"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Texts are lower-cased and cut into words (ASCII punctuation and white space end a word). Every n-gram of an item is
a seed, however many documents have it: whether a document is contaminated depends on its own words alone, not on
how many copies of it there are. Rare is a seed that at most FEW items of a size have. A scan joins passages to items
over the rare seeds, groups the hits of a document and
an item by their diagonal, and aligns the item with the words around each group, then again with what is left on
both sides of a passage found. The score is the local alignment's share of the item's own score: edited and
reordered copies keep most of it. Hits on phrases that everyone writes are cheap: an alignment scores at most MATCH
for each word that both sides have, so a stretch with too few words of the item is passed over without loss.

A phrase that more items share leads to an item only where the item's rarest words stand nearby. By pigeonhole that
loses nothing within the bound of `contaminated`: an alignment of `least` of an item without any rare seed matches so many words of its L (`words_needed`)
that two or more of the L - words_needed + 2 rarest ones are among them, and it lies within (3 - 2 least) L words of any seed that
it holds. Then all words of the item are looked up there. Words are ordered by how often the items have them, so what a phrase
costs at one of its places follows the items that share further words with that place, not all items that share the phrase.

Test items are the stated query set. They are taken in blocks of about `block` items and `block_bytes` of text at most,
so what is broadcast has a bound; documents are never shuffled.

Defined results: null or empty texts and items have no words and match nothing, nor does an item of fewer than
`seed` words; equal items are reported one by one; repeated rows are reported as often as they occur; rows with
a null id keep it; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays

MATCH, MISMATCH, GAP = 2, -1, -1
_WORD_BYTE = np.isin(np.arange(256), [*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)])
_TABLE_BITS = 20
FEW = 64  # a seed is rare if no more items of a size (a power of two) have it
NEARBY = 2  # rarest words that have to stand near a seed that is not rare
SITE = 16  # places of such seeds within so many words are looked at together
_PAIRS = 1 << 20  # pairs of a place and a word, or an item, that are looked at together


@dataclass(frozen=True)
class Shared:
    """Seeds that are not rare. A run is one seed in the items of one size; a member is an item of a run."""

    first: np.ndarray  # where the runs of each n-gram begin
    size: np.ndarray  # of each run
    reach: np.ndarray  # of each size: words before and after a seed that an alignment can cover
    member: np.ndarray  # run * items + item, sorted
    member_first: np.ndarray  # where each member's places begin
    place: np.ndarray
    keys: np.ndarray  # rarest words, with their item's size (sorted)
    key_first: np.ndarray  # where each one's items begin
    item: np.ndarray
    times: np.ndarray  # how often the word is among the item's rarest ones
    table: np.ndarray  # of the low bits of all rarest words
    seeds: np.ndarray  # of each item: how many of its n-grams are not rare
    needed: np.ndarray  # of each item: words that have to be near


@dataclass(frozen=True)
class Items:
    """Test items as arrays: ids, word hashes with offsets, and n-grams (sorted) with where rare ones occur."""

    ids: list
    words: np.ndarray
    first: np.ndarray
    grams: np.ndarray
    gram_first: np.ndarray  # where each n-gram's places begin
    item: np.ndarray
    place: np.ndarray
    shared: Shared

    def table(self) -> np.ndarray:
        return _table(self.grams)


def _table(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _TABLE_BITS, bool)
    out[_low(hashes)] = True
    return out


def _low(hashes: np.ndarray) -> np.ndarray:
    return hashes & np.uint64((1 << _TABLE_BITS) - 1)


def _firsts(counts: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(counts)].astype(np.int64)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the row before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _ranges(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of first[row], first[row] + 1, ... n[row] of them."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _pieces(n: np.ndarray) -> Iterator[slice]:
    """Slices of rows of which each has n of something: about _PAIRS together, or a row."""
    ends, i = np.cumsum(n), 0
    while i < len(n):
        done = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + _PAIRS, side="right")))
        yield slice(i, j)
        i = j


def _sized(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A word's hash together with a size."""
    return arrays.mixed(words + size.astype(np.uint64) * np.uint64(arrays.BASES[0]))


def _hashed(data, offsets):
    starts, ends, first = arrays.words(data, offsets, ~_WORD_BYTE)
    return arrays.word_hashes(data, starts, ends), first


def items_of(ids: list, texts: list, seed: int, least: float = 0.5) -> Items:
    """texts: lower-cased."""
    column = pa.array([t or "" for t in texts], pa.string())
    hashes, firsts, at = [], [0], 0
    for _, _, data, offsets in arrays.slices(column):
        h, first = _hashed(data, offsets)
        hashes.append(h)
        firsts += (first[1:] + at).tolist()
        at += len(h)
    words, first = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.array(firsts)
    lengths = np.diff(first)
    size = np.frexp(np.maximum(lengths, 1))[1].astype(np.int64)
    grams = arrays.window_hashes(words, seed)
    where = np.flatnonzero(arrays.window_starts(first, seed, len(words)))
    item = np.searchsorted(first, where, side="right") - 1
    order = np.lexsort((where, size[item], grams[where]))
    where, item = where[order], item[order]
    gram, place = grams[where], where - first[item]
    unique, of_gram = np.unique(gram, return_inverse=True)
    new = _changes(gram, size[item])
    run = np.cumsum(new) - 1
    often = np.bincount(run[_changes(run, item)], minlength=new.sum()) > FEW
    rare = ~often[run]
    gram_first = _firsts(np.bincount(of_gram[rare], minlength=len(unique)))

    runs = np.flatnonzero(new)[often]
    code = (np.cumsum(often) - 1)[run[~rare]] * len(ids) + item[~rare]
    begin = np.flatnonzero(_changes(code))
    # The rarest words of the items that have such seeds.
    seeds = np.bincount(item[~rare], minlength=len(ids))
    needed = np.maximum(np.maximum(least * lengths, words_needed(lengths, seeds, seed, least)), seed)
    needed = np.ceil(needed - 1e-9).astype(np.int64)
    some = np.unique(item[~rare])
    row, token = _ranges(first[some], lengths[some])
    _, word, times = np.unique(words[token], return_inverse=True, return_counts=True)
    order = np.lexsort((word, times[word], row))
    row, token = row[order], token[order]  # rows stay together, so a token's rank is its distance from its row's first
    chosen = np.arange(len(row)) - _firsts(lengths[some])[row] < (lengths - needed + NEARBY)[some][row]
    owner, key = some[row[chosen]], words[token[chosen]]
    table, key = _table(key), _sized(key, size[owner])
    order = np.lexsort((owner, key))
    owner, key = owner[order], key[order]
    pair = np.flatnonzero(_changes(key, owner))
    times, owner, key = np.diff(np.r_[pair, len(key)]), owner[pair], key[pair]
    keys, counts = np.unique(key, return_counts=True)
    longest = np.zeros(64, np.int64)
    np.maximum.at(longest, size, lengths)
    shared = Shared(
        np.searchsorted(of_gram[runs], np.arange(len(unique) + 1)), size[item[runs]], np.ceil((3 - 2 * least) * longest).astype(np.int64),
        code[begin], np.r_[begin, len(code)], place[~rare], keys, _firsts(counts), owner, times, table, seeds, needed,
    )
    return Items(ids, words, first, unique, gram_first, item[rare], place[rare], shared)


def hits(items: Items, table: np.ndarray, hashes: np.ndarray, first: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(word position, n-gram) of all n-grams of the items in a slice of documents."""
    grams = arrays.window_hashes(hashes, seed)
    if not len(grams) or not len(items.grams):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(table[grams & np.uint64((1 << _TABLE_BITS) - 1)])
    place = np.minimum(np.searchsorted(items.grams, grams[at]), len(items.grams) - 1)
    same = items.grams[place] == grams[at]
    at, place = at[same], place[same]
    document = np.searchsorted(first, at, side="right") - 1
    whole = at + seed <= first[document + 1]
    return at[whole], place[whole]


def _words_in(items: Items, item: np.ndarray, around: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How many of the words of each item are around its place. around: words with the number of the place (sorted, not empty)."""
    of, token = _ranges(items.first[item], np.diff(items.first)[item])
    key = _sized(items.words[token], place[of])
    there = around[np.minimum(np.searchsorted(around, key), len(around) - 1)] == key
    return np.bincount(of[there], minlength=len(item))


def enough_words(items: Items, item: np.ndarray, hashes: np.ndarray, low: np.ndarray, high: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Whether `need` words of the item are among those from low to high, for each of many stretches (as most_common, but words may be used twice)."""
    out = np.zeros(len(item), bool)
    for some in _pieces(high - low + np.diff(items.first)[item]):
        row, word = _ranges(low[some], (high - low)[some])
        around = np.unique(_sized(hashes[word], row))
        out[some] = _words_in(items, item[some], around, np.arange(some.stop - some.start)) >= need[some]
    return out


def near_rare_words(items: Items, at: np.ndarray, gram: np.ndarray, hashes: np.ndarray, first: np.ndarray, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word position, item, place in the item) of the hits on seeds that are not rare, where the item's rarest words are near."""
    shared, n_items = items.shared, len(items.ids)
    row, run = _ranges(shared.first[gram], np.diff(shared.first)[gram])
    if not len(run):
        return
    at, size = at[row], shared.size[run]
    document = np.searchsorted(first, at, side="right") - 1
    order = np.lexsort((at, document, size))
    at, run, size, document = at[order], run[order], size[order], document[order]
    begin = np.flatnonzero(_changes(size, document, at // SITE))  # of each site, its first hit
    hit_first, reach = np.r_[begin, len(at)], shared.reach[size[begin]]
    low = np.maximum(first[document[begin]], at[begin] - reach)
    high = np.minimum(first[document[begin] + 1], at[hit_first[1:] - 1] + seed + reach)
    listed = np.flatnonzero(shared.table[_low(hashes)])
    from_, to = np.searchsorted(listed, low), np.searchsorted(listed, high)
    for part in _pieces(high - low):
        # Words near each site that are among the rarest of an item of this size, once each.
        site, word = _ranges(from_[part], (to - from_)[part])
        key = _sized(hashes[listed[word]], size[begin[part]][site])
        found = np.minimum(np.searchsorted(shared.keys, key), len(shared.keys) - 1)
        same = shared.keys[found] == key
        site, found = np.divmod(np.unique(site[same] * len(shared.keys) + found[same]), len(shared.keys))
        n = np.bincount(site, np.diff(shared.key_first)[found], minlength=part.stop - part.start).astype(np.int64)
        edge = np.searchsorted(site, np.arange(len(n) + 1))
        row, word = _ranges(low[part], (high - low)[part])
        around = np.unique(_sized(hashes[word], row))  # all words near each site
        for piece in _pieces(n):
            span = slice(edge[piece.start], edge[piece.stop])
            of, posting = _ranges(shared.key_first[found[span]], np.diff(shared.key_first)[found[span]])
            pair, times = site[span][of] * n_items + shared.item[posting], shared.times[posting]
            order = np.argsort(pair)
            starts = np.flatnonzero(_changes(pair[order]))
            near = np.add.reduceat(times[order], starts) if len(starts) else starts
            pair = pair[order][starts][near >= NEARBY]
            for some in _pieces(np.diff(items.first)[pair % n_items]):
                place, item = np.divmod(pair[some], n_items)
                good = _words_in(items, item, around, place) >= shared.needed[item]
                place, item = place[good] + part.start, item[good]
                of, hit = _ranges(hit_first[place], np.diff(hit_first)[place])
                code = run[hit] * n_items + item[of]
                member = np.minimum(np.searchsorted(shared.member, code), len(shared.member) - 1)
                same = shared.member[member] == code
                of, hit, member = of[same], hit[same], member[same]
                each, begin_at = _ranges(shared.member_first[member], np.diff(shared.member_first)[member])
                yield at[hit][each], item[of][each], shared.place[begin_at]


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over word hashes: (best score, start, end) in words."""

    def best(a, b):
        slope, row, top, end = GAP * np.arange(len(b) + 1), np.zeros(len(b) + 1, np.int64), 0, 0
        for w in a:
            new = np.zeros_like(row)
            new[1:] = row[:-1] + np.where(b == w, MATCH, MISMATCH)
            new = np.maximum(np.maximum(new, row + GAP), 0)
            row = np.maximum.accumulate(new - slope) + slope
            if (m := int(row.max())) > top:
                top, end = m, int(row.argmax())
        return top, end

    top, end = best(item, words)
    back = best(item[::-1], words[:end][::-1])[1] if top else 0
    return top, end - back, end


def most_common(item: np.ndarray, words: np.ndarray) -> int:
    """How many words an alignment can match at most: those that both have, as often as both have them."""
    known, times = np.unique(item, return_counts=True)
    place = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return int(np.minimum(np.bincount(place[known[place] == words], minlength=len(known)), times).sum())


def passages(item: np.ndarray, words: np.ndarray, least: float, need: float = 0.0) -> Iterator[tuple[float, int, int]]:
    """(score, start, end) of the best alignment of `least` or more of the item, and of those before and after it.
    need: words that such an alignment is known to match, where that is more than `least` asks for."""
    need = max(need, least * len(item))
    stack = [(0, len(words))]
    while stack:
        low, high = stack.pop()
        if high - low < need or most_common(item, words[low:high]) < need:
            continue
        top, start, end = align(item, words[low:high])
        if top < MATCH * least * len(item):
            continue
        yield top / (MATCH * len(item)), low + start, low + end
        stack += [(low, low + start), (low + end, high)]


def words_needed(length: int, hits: int, seed: int, least: float) -> float:
    """Words that an alignment of `least` of an item of this length matches, if it holds so many of the item's n-grams.

    m words in r stretches have m - (seed - 1) r n-grams or more, and the r - 1 edits or more between the stretches leave
    2m - (r - 1) >= 2 least length. Both together bound m from below."""
    k = seed - 1
    return (2 * least * length * k - k - hits) / (2 * k - 1) if k else 0.0


def _matched(shared, seed: int, least: float, id_type: str):
    def run(batches):
        items, table = shared.value
        for batch in batches:
            rows, found = [], []
            for i, _, data, offsets in arrays.slices(batch.column(1)):
                hashes, first = _hashed(data, offsets)
                at, gram = hits(items, table, hashes, first, seed)
                if not len(at):
                    continue
                row, flat = _ranges(items.gram_first[gram], np.diff(items.gram_first)[gram])
                followed = [(at[row], items.item[flat], items.place[flat]), *near_rare_words(items, at, gram, hashes, first, seed)]
                position, item, place = (np.concatenate(x) for x in zip(*followed, strict=True))
                if not len(position):
                    continue
                document = np.searchsorted(first, position, side="right") - 1
                diagonal = position - place
                order = np.lexsort((diagonal, item, document))
                document, item, diagonal = document[order], item[order], diagonal[order]
                size = np.diff(items.first)[item]
                slack = size // 2 + 2
                new = np.r_[True, (np.diff(document) != 0) | (np.diff(item) != 0) | (np.diff(diagonal) > slack[1:])]
                cuts = np.flatnonzero(new)
                pairs = np.flatnonzero(np.r_[True, (np.diff(document) != 0) | (np.diff(item) != 0)])
                total = np.repeat(np.diff(np.r_[pairs, len(item)]), np.diff(np.r_[pairs, len(item)]))  # hits of the document and the item
                a, b = cuts, np.r_[cuts[1:], len(new)] - 1
                d, k = document[a], item[a]
                low = np.maximum(first[d], diagonal[a] - slack[a])
                high = np.minimum(first[d + 1], diagonal[b] + size[a] + slack[a])
                need = np.maximum(words_needed(size[a], total[a] + items.shared.seeds[k], seed, least), least * size[a])  # hits that were not followed count
                for g in np.flatnonzero(enough_words(items, k, hashes, low, high, need)).tolist():
                    words = items.words[items.first[k[g]] : items.first[k[g] + 1]]
                    for score, start, end in passages(words, hashes[low[g] : high[g]], least, float(need[g])):
                        at_word = int(low[g] - first[d[g]])
                        rows.append(i + int(d[g]))
                        found.append((items.ids[k[g]], score, at_word + start, at_word + end))
            if rows:
                # A passage found from two groups of seeds is reported once: the better one, then the first.
                best: dict = {}
                for r, f in zip(rows, found, strict=True):
                    if (r, f[0], f[2]) not in best or best[r, f[0], f[2]][1] < f[1]:
                        best[r, f[0], f[2]] = f
                keys = sorted(best, key=lambda x: (x[0], str(x[1]), x[2]))
                got = [best[x] for x in keys]
                ids = batch.column(0).take(pa.array([x[0] for x in keys], pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([g[0] for g in got], id_type), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.int64())],
                    ["doc_id", "item_id", "score", "start_word", "end_word"],
                )

    return run


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", seed: int = 3, least: float = 0.5, block: int = 50_000, block_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): every place where a document holds at least `least` of an item.

    Some n-gram of the item has to be left. An alignment of m words with d edits has m / (d + 1) words or more between
    edits, so with seeds of three words every place is found that holds over 1/2 + 1 / L of an item of L words by
    changed and left out words, and every one that holds over 3/4 + 1 / 2L whatever the edits are. What has a foreign word
    after every second word of the item, or more, can be missed below that.
    """
    sc = docs.sparkSession.sparkContext
    named = items.select(F.col(item_id).alias("item_id"), F.lower(F.coalesce(item_text, F.lit(""))).alias("text"))
    lower = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.coalesce(text, F.lit(""))).alias("text"))
    kinds = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes) | dict(named.select("item_id").dtypes)
    schema = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, score double, start_word long, end_word long"
    size = named.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // block), -(-size["bytes"] // block_bytes))
    out = None
    for b in range(blocks):
        part = named.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        got = items_of(part["item_id"].to_pylist(), part["text"].to_pylist(), seed, least)
        found = lower.mapInArrow(_matched(sc.broadcast((got, got.table())), seed, least, part["item_id"].type), schema)
        out = found if out is None else out.union(found)
    return out
