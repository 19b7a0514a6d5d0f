"""Token files of tables with a hot id, parts by size, and reading by ranges."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import functions as F

from tidemark.llm import token_files

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def library_ids(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    return [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def checked(spark, rows, **how):
    """The parts of the rows' token files, after all that was read back is compared with the library's ids."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    folder, parts = token_files.write(df, TOKENIZER, 2, **how)
    got = sorted(token_files.read(spark, folder, parts).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)
    want = [(str(i), ids) for (i, _), ids in zip(rows, library_ids([t for _, t in rows]), strict=True)]
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == sorted(want)
    return folder, parts.collect()


def test_a_third_of_the_rows_under_one_id(spark):
    """Equal rows, different texts with one head, and null ids: none of them makes one task the largest by far."""
    hot = [(7, "same words again")] * 600
    for mine in (hot, [(7, f"a head that is the same, then {i}") for i in range(600)], [(None, None)] * 600):
        _, parts = checked(spark, mine + [(1_000 + i, f"text number {i}") for i in range(1_200)], parts=9)
        assert len(parts) == 9 and max(r.n_docs for r in parts) < 2 * 1_800 / 9


def test_parts_follow_the_size_of_the_table(spark):
    rows = [(i, f"text number {i} " * 20) for i in range(400)]
    few, many = (checked(spark, rows, part_bytes=n)[1] for n in (1 << 30, 500))
    assert len(few) == int(spark.conf.get("spark.sql.shuffle.partitions")) < len(many)
    same = lambda parts: (sum(r.n_docs for r in parts), sum(r.n_tokens for r in parts))
    assert same(few) == same(many)


def test_order_within_an_id(spark):
    """By the head of the text, then by its hash, whatever the parts are."""
    rows = [(1, f"{c} {'x' * 20} {i}") for c in "ba" for i in range(30)]
    folder, _ = checked(spark, rows, parts=4)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.xxhash64("text"))
    want = sorted(((r.text[: token_files.HEAD], r.hash), r.text) for r in df.collect())
    names = sorted(f.path for f in pafs.LocalFileSystem().get_file_info(pafs.FileSelector(token_files._file_system(folder)[1])) if f.path.endswith(".tokens"))
    written = np.concatenate([np.fromfile(n, "<u2") for n in names]).tolist()
    assert written == [x for ids in library_ids([t for _, t in want]) for x in ids]


def test_ranges_elsewhere_than_on_a_local_disk(spark, monkeypatch):
    """A file system that can't be mapped is read range by range, with the same result."""
    rows = [(i, f"text number {i} " * (i % 7)) for i in range(300)]
    folder, parts = checked(spark, rows, parts=2)
    batch = pa.RecordBatch.from_arrays([pa.array([r[c] for r in parts]) for c in ("part", "base", "n_docs")], ["part", "base", "n_docs"])
    read = lambda: pa.Table.from_batches(token_files._reader(folder, "<u2", lambda ids: ids.tolist(), ["ids"])([batch])).to_pydict()
    mapped = read()
    local, root = token_files._file_system(folder)
    monkeypatch.setattr(token_files, "_file_system", lambda _: (pafs.SubTreeFileSystem("/", local), root))
    monkeypatch.setattr(token_files, "CHUNK", 64)
    assert read() == mapped and len(mapped["ids"]) == 300
