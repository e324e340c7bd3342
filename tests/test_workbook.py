"""Workbooks written, read back and compared; commits, aborts and foreign files."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import workbook as W
from tallyloom.sources import workbook as S

LINES = "stall string, product string, quantity int"
FAULTS = "parent_label string, product string, sales_attr1 string, sales_attr2 string, quantity long, remark string, reason string"


def rows_of(df):
    return sorted((r.book, r.sheet, r.row, [c or "" for c in r.cells]) for r in df.collect())


@pytest.fixture(scope="module")
def report(spark):
    lines = spark.createDataFrame([("S/1", "=a&b<c>", 2), ("S/1", " 中文\n二 ", 1), ("T", "x\x01y", None), (None, '"q"', 7)], LINES)
    faults = spark.createDataFrame([("面单 2", "p", "", "", None, "r", "quantity"), ("面单 1", "", "", "", 3, "", "product")], FAULTS)
    return lines, faults


@pytest.mark.parametrize("mode", W.MODES)
def test_modes_read_back_equal(spark, tmp_path, report, mode):
    lines, faults = report
    books = W.report_books(lines, faults, "stall", ["product"], {"product": F.col("product"), "pieces": F.col("quantity")}, mode)
    S.write_workbooks(books, f"file://{tmp_path}/out")
    got = S.read_workbooks(spark, f"file://{tmp_path}/out", rangeRows=1)
    clean = lambda rows: [(b.replace("/", "_"), s.replace("/", "_"), n, [c.replace("\x01", "") for c in cells]) for b, s, n, cells in rows]
    want = [(b, s, n, cells) for b, s, n, cells in clean(rows_of(books))]
    trim = lambda rows: sorted((b, s, n, cells[: max((i + 1 for i, c in enumerate(cells) if c), default=0)]) for b, s, n, cells in rows)
    assert trim(rows_of(got)) == trim(want)
    assert sorted(os.listdir(tmp_path / "out")) == sorted({f"{b}.xlsx" for b, *_ in want} | {"_temporary"})
    assert {s for _, s, _, _ in want} >= {"exceptions"} and len({b for b, *_ in want}) == (4 if mode == "stall_workbooks" else 1)
    (first,) = [cells for b, s, n, cells in want if s == "exceptions" and n == 2]
    assert first[0] == "面单 1" and first[-1] == "product"


def test_overwrite_append_and_failing_tasks(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    book = lambda name, n: spark.range(n).select(F.lit(name).alias("book"), F.lit("s").alias("sheet"), (F.col("id") + 1).alias("row"), F.array(F.col("id").cast("string")).alias("cells"))
    S.write_workbooks(book("a", 3), path)
    S.write_workbooks(book("b", 2), path, "append")
    assert S.read_workbooks(spark, path).groupBy("book").count().orderBy("book").collect() == [("a", 3), ("b", 2)]
    with pytest.raises(Exception, match="two books of one name"):
        S.write_workbooks(book("a", 9), path, "append")
    bad = book("c", 4).withColumn("row", F.when(F.col("row") == 3, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("row")))
    with pytest.raises(Exception, match="broken"):
        S.write_workbooks(bad, path)
    assert S.read_workbooks(spark, path).count() == 5 and os.listdir(tmp_path / "out/_temporary") == []
    S.write_workbooks(book("d", 1), path)
    assert [r.book for r in S.read_workbooks(spark, path).collect()] == ["d"]
    S.write_workbooks(book("e", 0), path)
    assert S.read_workbooks(spark, path).count() == 0


def foreign(path, images):
    """A book with shared strings, numbers, gaps and anchored images, as other programs write them."""
    main, rels, pkg = S.MAIN, S.RELS, S.PACKAGE
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rels}"><sheets><sheet name="one &amp; two" sheetId="1" r:id="rId9"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pkg}/relationships"><Relationship Id="rId9" Type="t" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>a</t></si><si><r><t>b</t></r><r><t>c</t></r></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="AA2"><v>4.5</v></c></row><row r="5"><c r="A5" t="s"><v>1</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/_rels/s.xml.rels", f'<Relationships xmlns="{pkg}/relationships"><Relationship Id="rId1" Type="d" Target="../drawings/d.xml"/></Relationships>')
        anchor = lambda i, row: f'<x:oneCellAnchor><x:from><x:col>2</x:col><x:row>{row}</x:row></x:from><x:pic><a:blip r:embed="rId{i}"/></x:pic></x:oneCellAnchor>'
        z.writestr("xl/drawings/d.xml", f'<x:wsDr xmlns:x="{S.DRAWING}" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="{rels}">' + "".join(anchor(i, row) for i, (row, _) in enumerate(images)) + "</x:wsDr>")
        z.writestr("xl/drawings/_rels/d.xml.rels", f'<Relationships xmlns="{pkg}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="i" Target="../media/{i}.png"/>' for i in range(len(images))) + "</Relationships>")
        for i, (_, body) in enumerate(images):
            z.writestr(f"xl/media/{i}.png", body)


def test_foreign_books_and_images(spark, tmp_path):
    foreign(tmp_path / "a.xlsx", [(0, b"one"), (4, b"two")])
    foreign(tmp_path / "b.xlsx", [(0, b"one"), (4, b"other")])
    got = rows_of(S.read_workbooks(spark, f"file://{tmp_path}/a.xlsx"))
    assert got == [("a", "one & two", 2, ["", "a", *[""] * 24, "4.5"]), ("a", "one & two", 5, ["bc"])]
    a, b = (S.read_workbooks(spark, f"file://{tmp_path}/{n}.xlsx", content="images").withColumn("book", F.lit("x")) for n in "ab")
    assert sorted((r.row, r.col, r.kind, r.n) for r in W.image_diff(a, b).collect()) == [(5, 3, "added", 1), (5, 3, "missing", 1)]
    assert W.image_diff(a, a).count() == 0


def test_diff_of_moved_changed_and_missing(spark):
    schema = "book string, sheet string, row long, cells array<string>"
    left = [("k", "s", 1, ["h", "i", ""]), ("k", "s", 2, ["a", "1"]), ("k", "s", 3, ["b", "2"]), ("k", "s", 4, ["b", "2"]), ("k", "s", 5, ["c", "3", None]), ("k", "s", 7, ["", " "]), ("k", "t", 1, ["only"])]
    right = [("k", "s", 1, ["h", "i"]), ("k", "s", 2, ["b", "2"]), ("k", "s", 3, ["a", "1", " "]), ("k", "s", 4, ["b", "2"]), ("k", "s", 5, ["c", "4", "x"]), ("k", "s", 6, ["new"])]
    got = W.workbook_diff(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()
    assert sorted((r.sheet, r.kind, r.row, r.col or 0, r.left_value or "", r.right_value or "", r.moved_to or 0) for r in got) == [
        ("s", "added", 5, 3, "", "x", 0), ("s", "added", 6, 1, "", "new", 0), ("s", "changed", 5, 2, "3", "4", 0), ("s", "moved", 2, 0, "", "", 3), ("s", "moved", 3, 0, "", "", 2), ("t", "missing", 1, 1, "only", "", 0),
    ]
    assert W.workbook_diff(spark.createDataFrame(left, schema), spark.createDataFrame(left, schema)).count() == 0


def test_column_names():
    assert [S.column_name(n) for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(S.column_number(S.column_name(n) + "7") == n for n in range(2000))
