"""The registered queries over the smallest tables against plain Python, and against their SQL where they have it."""

import base64
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash

from tidemark.llm import decontaminate, queries, quality_model, quality_rules

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows_of(spark, name):
    rows = queries.queries()[name](spark, SF).collect()
    return {r.doc_id: r for r in rows}, rows


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_registered():
    assert [k.split("_")[0] for k in queries.queries()] == [f"op{n}" for n in range(1, 14)]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in got.collect())


def test_op1(spark, docs):
    """Every document is aligned with every item."""
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    hashed = lambda t: decontaminate._hashed(np.frombuffer(t.lower().encode(), np.uint8), np.array([0, len(t.lower().encode())]))[0]
    held = {k: hashed(t or "") for k, t in items.items()}
    want = set()
    for i, r in docs.items():
        words = hashed(r.text or "")
        for k, item in held.items():
            if len(item) > 2 and len(words) and decontaminate.most_common(item, words) >= len(item) / 2 and decontaminate.align(item, words)[0] >= len(item):
                want.add((i, k))
    got = {(r.doc_id, r.item_id) for r in rows_of(spark, "op1_seeded_alignment")[1]}
    assert want and got <= want and len(got) >= 0.9 * len(want)


def test_op2(spark, docs):
    got, rows = rows_of(spark, "op2_hypergeometric_shards")
    assert {i: (r.size, r.text_crc32) for i, r in got.items()} == {i: (len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for i, r in docs.items()}
    shards = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(16)}
    sizes = [len(v) for v in shards.values()]
    assert sum(sizes) == len(docs) == len(rows) and max(sizes) - min(sizes) <= 1 and all(v == list(range(len(v))) for v in shards.values())
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_op4(spark, docs):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, r in docs.items():
        ids = encoding.encode_ordinary(r.text or "")
        want[i] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha((r.text or "").encode()))
    assert {i: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for i, r in rows_of(spark, "op4_distinct_word_bpe")[0].items()} == want


def test_op5(spark, docs):
    """Scores are those of the trees on each text, and rank held-out labels."""
    got, rows = rows_of(spark, "op5_quality_trees")
    assert len(rows) == len(docs) and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    trees = queries.quality_trees(spark, SF, table)

    def walk(x):  # one tree after another, a node at a time
        total = trees.start
        for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(x[feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    for i, r in list(docs.items())[:60]:
        raw = (r.text or "").encode()
        assert abs(walk(quality_model.statistics(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]) - got[i].score) < 1e-9
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    scored = {r.doc_id: r for r in queries.op5_quality_trees(spark, "/root/testdata/sf0.01").collect()}
    held = [(scored[i].score, y) for i, y in labels.items() if y is not None and i in scored and scored[i].held_out]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(good) > 10 and len(bad) > 10 and auc >= 0.97


def test_op6(spark, docs):
    from tokenizers import Tokenizer

    library, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, {}
    for i in sorted(docs):
        ids = [*library.encode(docs[i].text or "", add_special_tokens=False).ids, 2]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {i: (r.start, r.n_tokens, r.ids_crc32) for i, r in rows_of(spark, "op6_token_files")[0].items()} == want


def test_op7(spark, docs):
    """kept by rules written anew, whatever the order."""
    got, rows = rows_of(spark, "op7_rule_cascade")
    assert len(rows) == len(docs)
    for i, d in docs.items():
        text = d.text or ""
        words, r = WORD.findall(text), got[i]
        lines = [x for x in text.split("\n") if WORD.search(x)]
        count = lambda shape: len(re.findall(shape, text))  # noqa: B023, E731
        n, chars = len(words), sum(map(len, words))
        grams = [tuple(words[k : k + 5]) for k in range(n - 4)]
        seen = {}
        for g in grams:
            seen[g] = seen.get(g, 0) + 1
        repeated = len({k + j for k, g in enumerate(grams) if seen[g] > 1 for j in range(5)})
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, count("[#*$%&|<>]"), len(lines) - len(set(lines)), repeated)
        base = n < 10 or 100 * repeated > 20 * n
        fails = count("[#*$%&|<>]") > 0.1 * n or chars < 3 * n or chars > 10 * n or len(lines) - len(set(lines)) > 0.3 * len(lines) or count("[A-Z]") > 0.3 * chars or count("!") > 0.25 * n or count("[0-9]") > 0.3 * chars
        assert (r.base_failed, r.kept) == (base, not base and not fails)


def test_rule_order_is_steady(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    orders = [[r.name for r in quality_rules.ordered(df)] for df in (table, table, table.repartition(7))]
    assert orders[0] == orders[1] == orders[2] and sorted(orders[0]) == sorted(r.name for r in quality_rules.RULES)
    rules = quality_rules.RULES
    named = [
        {r.doc_id: r.rejected_by for r in quality_rules.cascade(quality_rules.measured(table), order, rules).select("doc_id", "rejected_by").collect()} for order in (rules, rules[::-1])
    ]
    assert named[0] == named[1] and any(named[0].values())


def test_op8(spark):
    """Base spans by their shapes, and who owns each value, counted over the whole table."""
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    shapes = (
        ("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[1]) >= 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    )
    token = re.compile("[A-Za-z0-9_-]{20,}")
    held, base, weak = {}, {}, {}
    for i, r in docs.items():
        text = r.text or ""
        base[i] = sorted((m.start(), k, name, m.end(), m[1] if name == "assign" else m[0]) for k, (name, shape, fits) in enumerate(shapes) for m in shape.finditer(text) if fits(m))
        long = [m for m in token.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
        weak[i] = [(m.start(), 3, "owned", m.end(), m[0]) for m in long if all(m.end() <= s[0] or m.start() >= s[3] for s in base[i])]
        for s in base[i] + weak[i]:
            held.setdefault(s[4], set()).add((r.source, r.lang))
    assert any(base.values())
    rows = queries.op8_owned_secrets(spark, sf).collect()
    got, verdicts = {r.doc_id: r for r in rows}, set()
    assert len(rows) == len(docs)
    for i in docs:
        r, listed = got[i], lambda spans: ",".join(f"{name}:{a}:{b}" for a, _, name, b, _ in spans)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[2] == k for s in base[i]) for k in ("assign", "access", "hex")] and r.base_sha256 == sha(listed(base[i]).encode())
        owners = {s[4]: len({o for o, _ in held[s[4]]}) for s in base[i] + weak[i]}
        live = {v: owners[v] == 1 and len(held[v]) <= 10 for v in owners}
        want = sorted(base[i] + [s for s in weak[i] if live[s[4]]])
        joined = lambda f: ",".join(str(f(s[4])).lower() for s in want)  # noqa: B023, E731
        assert (r.spans, r.owners, r.repositories, r.live) == (listed(want), joined(owners.get), joined(lambda v: len(held[v])), joined(live.get))
        verdicts |= set(live.values())
    assert True in verdicts


def test_op9(spark, docs):
    words = {i: (r.text or "").encode().split() for i, r in docs.items()}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][j : j + 13]), i)
    got = rows_of(spark, "op9_lempel_ziv_repeats")[0]
    for i, w in words.items():
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), int(gone.sum()), sha(kept))


def test_op10(spark, docs):
    prints = {}
    for i, r in docs.items():
        w = (r.text or "").encode().lower().split()
        shingles = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], np.uint64)
        prints[i] = sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {i: (f"{p:016x}", find(i)) for i, p in prints.items()}
    assert {i: (r.fingerprint, r.component_id) for i, r in rows_of(spark, "op10_golay_simhash")[0].items()} == want


def test_op13(spark, docs):
    """Every id of every document is in one piece, and sequences are as many as best-fit decreasing needs."""
    from tokenizers import Tokenizer

    from tidemark.llm import packing

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows, want, sizes = queries.queries()["op13_bulk_best_fit"](spark, SF).collect(), set(), []
    for i, r in docs.items():
        ids, at = [*library.encode(r.text or "", add_special_tokens=False).ids, 2], 0
        first = len(ids) % 1024 or 1024
        for p, end in enumerate(range(first if len(ids) > 1024 else len(ids), len(ids) + 1, 1024)):
            want.add((i, p, at, end - at, zlib.crc32(np.array(ids[at:end], "<u4").tobytes())))
            sizes.append(end - at)
            at = end
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all([o for o, _ in sorted(v)] == [0, *np.cumsum([n for _, n in sorted(v)])[:-1]] and sum(n for _, n in v) <= 1024 for v in held.values())
    assert len(held) == packing.new_sequences(np.bincount(sizes, minlength=1025), np.zeros(1025, int))
