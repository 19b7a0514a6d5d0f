"""Distinct counts that merge, and archives that are read member by member."""

import zipfile

from pyspark.sql import functions as F
from test_table_functions import PAGE

from tidemark.operators import distinct
from tidemark.sources import files, large_archives
from tidemark.sources.decode import packed


def test_distinct_counts_merge(spark):
    rows = [(k, f"u{i % (50 + 10 * k)}", i % 7 if i % 5 else None) for k in range(4) for i in range(200)] + [(None, "u1", 3)] * 3
    df = spark.createDataFrame(rows, "k int, who string, what int").repartition(5)
    parts, numbers, states = [df.filter("k <= 1"), df.filter("k > 1 OR k IS NULL")], None, []
    for part in parts:
        before, numbers = numbers, distinct.dictionary(part, ["who", "what"], numbers)
        states.append(distinct.state(part, ["k"], ["who", "what"], numbers))
        if before is not None:  # numbers stay
            assert before.exceptAll(numbers).isEmpty()
    held = numbers.collect()
    assert len({(r.measure, r.number) for r in held}) == len({(r.measure, r.value) for r in held}) == len(held)
    want = {k: (len({w for x, w, _ in rows if x == k}), len({v for x, _, v in rows if x == k and v is not None})) for k in (None, 0, 1, 2, 3)}
    assert {r.k: (r.n_who, r.n_what) for r in distinct.counts(distinct.merged(states, ["k"]), ["k"], ["who", "what"]).collect()} == want
    total = distinct.counts(distinct.merged([*states, states[0]], []), [], ["who", "what"]).first()
    assert tuple(total) == (80, 7)
    empty = df.limit(0)
    assert distinct.counts(distinct.state(empty, ["k"], ["who"], distinct.dictionary(empty, ["who"])), ["k"], ["who"]).collect() == []


def test_members_are_dealt_by_bytes(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(300):
            z.writestr(f"{i}.html", PAGE.replace("1 000", str(i)))
        z.writestr("dir/", "")
        z.writestr("note.txt", "x" * 5_000)
        z.writestr("inner.zip", packed("b.htm", PAGE.encode()))
        z.writestr("bad.zip", b"no archive")
    (tmp_path / "broken.zip").write_bytes(b"broken")
    (tmp_path / "empty.zip").write_bytes(b"PK\x05\x06" + b"\0" * 18)
    listed = large_archives.directory(spark, str(tmp_path))
    assert listed.filter("error IS NULL").count() == 303 and listed.filter("error IS NOT NULL").count() == 1
    lots = large_archives.dealt(listed, task_bytes=4_000)
    sizes = [r.b for r in lots.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("packed").alias("b")).collect()]
    assert len(sizes) > 4 and sum(sizes) == listed.agg(F.sum("packed")).first()[0]
    got = large_archives.table_rows(spark, str(tmp_path), task_bytes=4_000).collect()
    good = {(r.member, r.ordinal): r.cells for r in got if not r.error}
    assert len(good) == 602 and good["7.html", 0] == ["Name", "7"] and good["inner.zip!b.htm", 1] == ["x"]
    assert sorted((r.path.split("/")[-1], r.member) for r in got if r.error) == [("a.zip", "bad.zip"), ("broken.zip", None)]
    # A whole archive is the same as by rows of binaryFile.
    with zipfile.ZipFile(tmp_path / "c.ZIP", "w") as z:
        z.writestr("x.html", PAGE)
    one = large_archives.table_rows(spark, str(tmp_path), "c.ZIP")
    other = files.archive_rows(files.payloads(spark, str(tmp_path), "c.ZIP"))
    assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))


def test_a_damaged_member_is_its_own_error(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_STORED) as z:
        for i in range(3):
            z.writestr(f"{i}.html", PAGE)
    raw = (tmp_path / "a.zip").read_bytes()
    at = raw.index(b"1 000", raw.index(b"1 000") + 1)  # in the second member
    (tmp_path / "a.zip").write_bytes(raw[:at] + b"9" + raw[at + 1 :])
    got = large_archives.table_rows(spark, str(tmp_path)).collect()
    assert sorted({r.member for r in got if not r.error}) == ["0.html", "2.html"] and [(r.member, "CRC" in r.error) for r in got if r.error] == [("1.html", True)]
