import csv
import io
import random

from vetch.sources import delimited as D
from vetch.sources import packet as P
from vetch.sources.office import cell_name


def test_splits_by_brute_force(spark, tmp_path):
    rng, files = random.Random(5), {}
    for k in range(40):
        alphabet = 'ab,"\n' if k % 2 else 'ab,,\n\n"'
        files[f"f{k}.csv"] = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400)))
    files["plain.csv"] = "﻿a,b\r\n1,\r\n\r\n" + "x,y,z\n" * 300
    files["quoted.csv"] = 'k,"said ""so"", she\nand\n\nthen",z\n' * 60
    files["open.csv"] = 'a,b\n5" pipe,c\nd,"never closed\n' + "e,f\n" * 50
    for name, text in files.items():
        (tmp_path / name).write_text(text, newline="")
    kept = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in kept:
            spark.conf.set(c, "64" if "max" in c else "0")
        lines = D.lines(spark, str(tmp_path), "csv")
        assert lines.select("path", "split").distinct().count() > 3 * len(files)
        got = {(r["path"].rpartition("/")[2], r["row"], r["cell"]): r["value"] for r in D.cells(D.records(lines)).collect()}
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    want = {}
    for name, text in files.items():
        for r, row in enumerate(csv.reader(io.StringIO(text.removeprefix("﻿"), newline="\n")), 1):
            want.update({(name, r, cell_name(r, c)): v for c, v in enumerate(row, 1)})
    # A quote that is open at the end takes the file's last line end along, which Spark's lines don't show.
    assert {k: v.rstrip("\n") for k, v in got.items()} == {k: v.rstrip("\n") for k, v in want.items()}


def test_wide_rows_are_named_as_in_a_sheet(spark):
    row = spark.createDataFrame([("p", 1, ",".join(map(str, range(1, 1501))))], "path string, row long, record string")
    assert all(r["cell"] == cell_name(1, int(r["value"])) for r in D.cells(row).collect())


def test_files_of_one_name_stay_apart(spark, tmp_path):
    for folder in ("a", "b c"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x+1.md").write_text("# One\n\nText.\n")
        (tmp_path / folder / "y.CSV").write_text("a,b\n1,2\n")
    (tmp_path / "none.tsv").write_text("\n")
    rows = P.inspect(P.scan(spark, str(tmp_path)), str(tmp_path)).collect()
    assert {r["name"] for r in rows} == {"a/x+1.md", "b c/x+1.md", "a/y.CSV", "b c/y.CSV", "none.tsv"}
    assert sorted((r["cell"], r["text"]) for r in rows if r["name"] == "b c/y.CSV") == [("A1", "a"), ("A2", "1"), ("B1", "b"), ("B2", "2")]
    assert [r["kind"] for r in rows if r["name"] == "none.tsv"] == [None] and len({r["source_id"] for r in rows}) == 5


def test_quoted_records_stay_in_spark(spark):
    """No record whose quotes stand where the format has them goes through the csv module; all cells are the module's."""
    regular = ['1,en,"said ""so"", she\nand\n"', '"a","",b', '"""x"""', '"",', ',"a,b",c,', '"p\r\nq",r', '"x"']
    astray = ['5" pipe,c', '"a"b,c', 'a,"never closed', '"a" ,b', 'q"",r', '"\x01",b', '"\x02"']
    rng = random.Random(8)
    mixed = ["".join(rng.choice('ab,,""') for _ in range(rng.randint(1, 12))) for _ in range(400)]
    rows = [("p", k, r) for k, r in enumerate(regular + astray + mixed, 1)]
    got = {(r["row"], r["cell"]): r["value"] for r in D.cells(spark.createDataFrame(rows, "path string, row long, record string")).collect()}
    want = {(k, cell_name(k, c)): v for _, k, r in rows for c, v in enumerate(next(csv.reader(io.StringIO(r, newline="\n"))), 1)}
    assert got == want
    regular = spark.createDataFrame([(r, r in regular) for r in regular + astray], "record string, regular boolean")
    parted = regular.select("regular", (~D._parted(D.F.col("record"), ",").contains(D.ASTRAY)).alias("stays"), "record").collect()
    assert all(r["stays"] for r in parted if r["regular"]) and not any(r["stays"] for r in parted if r["record"] in ('5" pipe,c', '"a"b,c', '"a" ,b', 'q"",r'))
