"""Secret scans with corpus-wide ownership frequency.

A scan finds spans of known shapes in every text (the base kinds) and weaker candidates: long tokens with letters
and digits next to nothing that names them. The values of both are judged by who owns them: their hashes are
aggregated over distinct repositories and owners. A value that several owners or many repositories have is a copied example; a value that
one owner alone has, in few repositories, is live-looking. Base spans stay whatever comes out; a weak candidate is reported, as a span of
kind `owned`, if it is live-looking. Aggregation goes over distinct (value, owner, repository) first, so a value in a
third of all rows is a few rows by then.

Defined results: a null text counts as empty; a null owner is an owner of its own; spans of one kind never
overlap; an empty text has no spans; repeated rows have equal results; an empty table gives no rows; columns
other than those named are not returned.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import slices, tidy
from .common import join_classes, written

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_NAMES = tuple(n.encode() for n in NAMES)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIXED = re.compile(r"[A-Za-z0-9_-]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST, MIXED_LEAST = 6, 20, 24, 20
KINDS = ("assign", "access", "hex", "owned")
_HEX_BYTE = np.isin(np.arange(256), list(b"0123456789abcdef"))
_MIXED_BYTE = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-"))
SCANNED = "spans array<struct<kind:string,start:int,end:int,hash:long>>, weak array<struct<start:int,end:int,hash:long>>"


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


def valued_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, hash of the value) of the base kinds in code points, by start, then kind."""
    low = text.lower()
    found = []
    if any(n in low for n in NAMES):
        found += [("assign", m.start(), m.end(), _hash(m[2])) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), _hash(m[0])) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [("hex", m.start(), m.end(), _hash(m[0])) for m in HEX.finditer(text) if len(m[0]) >= HEX_LEAST]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds in code points, by start, then kind."""
    return [s[:3] for s in valued_spans(text)]


def weak_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, hash) of long tokens with letters, of one case or both, and digits that touch no base span.

    Tokens come by their starts and base spans are sorted by theirs, so one walk over both is enough."""
    found, at, reach = [], 0, 0  # reach: the furthest end of the base spans that start before the token's end
    for m in MIXED.finditer(text):
        t = m[0]
        if len(t) < MIXED_LEAST or not any(c.isdigit() for c in t) or not any(c.isalpha() for c in t):
            continue
        while at < len(base) and base[at][1] < m.end():
            reach, at = max(reach, base[at][2]), at + 1
        if reach <= m.start():
            found.append((m.start(), m.end(), _hash(t)))
    return found


def _runs(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, least: int) -> np.ndarray:
    """Which documents have a run of at least `least` bytes of this kind."""
    out = np.zeros(len(offsets) - 1, bool)
    if len(data):
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = kind[data]
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = turns[::2], turns[1::2]
        # A run over a document's end is cut by the exact scan; here it may only say yes too often.
        long = ends - starts >= least
        first = np.searchsorted(offsets, starts[long], side="right") - 1
        last = np.searchsorted(offsets, ends[long] - 1, side="right") - 1
        out[first] = out[last] = True
        for a, b in zip(first[last > first + 1], last[last > first + 1], strict=True):
            out[a:b] = True
    return out


def _scan(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, weak = [], []
            for i, j, data, offsets in slices(batch.column(at)):
                long = _runs(data, offsets, _HEX_BYTE, HEX_LEAST) | _runs(data, offsets, _MIXED_BYTE, MIXED_LEAST)
                whole = data.tobytes()
                for r in range(j - i):
                    raw = whole[offsets[r] : offsets[r + 1]]
                    low = raw.lower()
                    if not long[r] and not any(n in low for n in _NAMES):  # AKIA... of 20 is a long run
                        spans.append([])
                        weak.append([])
                        continue
                    text = raw.decode()
                    valued = valued_spans(text)
                    base = [s[:3] for s in valued]
                    spans.append([dict(zip(("kind", "start", "end", "hash"), s, strict=True)) for s in valued])
                    weak.append([dict(zip(("start", "end", "hash"), s, strict=True)) for s in weak_spans(text, base)] if long[r] else [])
            span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.int64())]))
            other = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("hash", pa.int64())]))
            names = [n for k, n in enumerate(batch.schema.names) if k != at]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + [pa.array(spans, span), pa.array(weak, other)], [*names, "spans", "weak"])

    return run


def scanned(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns in keep, with spans and weak candidates of each text."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_tidemark_text")).mapInArrow(tidy(_scan(len(keep))), f"{kinds}, {SCANNED}")


#: A value in more repositories than that is a copied example, also where one owner alone has it.
MOST_REPOSITORIES = 10


def ownership(candidates: DataFrame, most_owners: int = 1, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """candidates: hash, owner, repository. One row a hash: n (its places), owners, repositories (of all owners), live (at most so many of both)."""
    held = candidates.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    owners = held.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return owners.groupBy("hash").agg(F.sum("n").alias("n"), F.count("*").alias("owners"), F.sum("repositories").alias("repositories")).withColumn("live", (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories))


def _each(found: DataFrame) -> DataFrame:
    """One row for each occurrence of a value: of the spans, and of weak candidates as kind `owned`."""
    weak = F.transform("weak", lambda s: F.struct(F.lit("owned").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hash"].alias("hash")))
    return found.select("row", "owner", "repository", F.explode(F.concat("spans", weak)).alias("c")).select("row", "owner", "repository", "c.*")


def secret_spans(df: DataFrame, id_col: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "lang", most_owners: int = 1) -> DataFrame:
    """(id, base, spans, owners, repositories, live): base and spans are arrays of (kind, start, end) by start, then kind.

    spans adds the live-looking weak candidates to base; owners, repositories and live have an entry for each of the
    spans: how many owners and repositories have its value in the whole table, and whether it looks live."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    named = df.select(F.col(id_col).alias("id"), none(owner).alias("owner"), none(repository).alias("repository"), F.col(text).alias("text"))
    found = written(scanned(named, "text", ["id", "owner", "repository"]).withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = _each(found)
    # A value that many rows have stays where they are, and its verdict goes there.
    judged = join_classes(each, written(ownership(each, most_owners), "ownership"), "hash").filter("kind <> 'owned' OR live")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("rank")
    listed = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", rank, "kind", "end", "owners", "repositories", "live"))).alias("all"))
    short = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    columns = lambda c: [short(c).alias("spans"), *[c.getField(n).alias(n) for n in ("owners", "repositories", "live")]]
    # Only rows that have values take part in the join.
    clean = (F.size("spans") == 0) & (F.size("weak") == 0)
    none_of = F.array().cast("array<struct<start:int,rank:long,kind:string,end:int,owners:long,repositories:long,live:boolean>>")
    plain = found.filter(clean).select("id", short("spans").alias("base"), *columns(none_of))
    rest = found.filter(~clean).join(listed, "row", "left").select("id", short("spans").alias("base"), F.coalesce("all", none_of).alias("all"))
    return plain.union(rest.select("id", "base", *columns(F.col("all"))))


def _redact(batches):
    for batch in batches:
        out = []
        for t, spans in zip(batch.column(batch.schema.get_field_index("text")), batch.column(batch.schema.get_field_index("_spans")), strict=True):
            text, at, parts = t.as_py(), 0, []
            for s in sorted(spans.as_py() or [], key=lambda s: (s["start"], -s["end"])):
                if s["end"] <= at:
                    continue
                parts += [text[at : max(at, s["start"])], f"<|{s['kind']}|>"]
                at = s["end"]
            out.append(text if not parts else "".join(parts) + text[at:])
        names = [n for n in batch.schema.names if n != "_spans"]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else batch.column(batch.schema.get_field_index(n)) for n in names], names)


def redacted(df: DataFrame, owner: str = "source", repository: str = "lang", most_owners: int = 1) -> DataFrame:
    """df (with a column text) with every span replaced by `<|kind|>`; overlapping spans give one mark each, all else stays."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    # The row travels as one struct, so that no column's name can clash.
    packed = df.select(F.struct(*df.columns).alias("doc"), none(owner).alias("owner"), none(repository).alias("repository"), F.col("text").alias("text"))
    found = written(scanned(packed, "text", ["doc", "owner", "repository"]).withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = _each(found)
    live = written(ownership(each, most_owners).filter("live").select("hash", "n"), "ownership")
    owned = join_classes(each.filter("kind = 'owned'"), live, "hash").groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("owned"))
    clean = (F.size("spans") == 0) & (F.size("weak") == 0)
    short = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    all_of = F.concat(short, F.coalesce("owned", F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    rest = found.filter(~clean).join(owned, "row", "left").select("doc", F.col("doc.text").alias("text"), all_of.alias("_spans"))
    done = rest.mapInArrow(_redact, f"doc {df.select(F.struct(*df.columns).alias('doc')).schema['doc'].dataType.simpleString()}, text string")
    done = done.select(*[F.col("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in df.columns])
    return found.filter(clean).select("doc.*").union(done)
