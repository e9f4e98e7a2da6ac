import base64
import contextlib
import sys
import types
import uuid

import pytest

from tablewright.operators import merge, normalize, quality, reconcile, rows
from tablewright.plans.convert import convert
from tablewright.schema import CELLS, PAGES, RAW_TABLES
from tablewright.sinks import csvtext, naming, report, workbook
from tablewright.sources import adapters, config, files, images, pages, responses
from tablewright.streaming.staging import stage_cells


def cells_of(spark, table, doc="d", names=None):
    out = [(doc, 1, 1, i, j, (names or [f"c{k}" for k in range(len(r))])[j], v) for i, r in enumerate(table) for j, v in enumerate(r)]
    return spark.createDataFrame(out, CELLS)


def judge(spark, table):
    return quality.table_quality(cells_of(spark, table)).first()


def test_quality_thresholds(spark):
    assert judge(spark, [["a"]] * 4).single_column and not judge(spark, [["a"], ["b"], ["c"]]).single_column
    assert judge(spark, [[str(i), "x"] for i in range(71)]).row_explosion
    assert judge(spark, [[str(i)] * 13 for i in range(51)]).row_explosion and not judge(spark, [[str(i)] * 12 for i in range(51)]).row_explosion
    assert not judge(spark, [["a", "b"]] * 7 + [["a", None]] * 3).uneven_columns
    assert not judge(spark, [[str(i), None, None, None, "x"] for i in range(19)]).mostly_empty
    assert not judge(spark, [[str(i), "x"] for i in range(8)] + [["0", "x"]] * 2).duplicate_rows
    assert judge(spark, [[str(i), "x"] for i in range(7)] + [["0", "x"]] * 3).duplicate_rows
    assert not judge(spark, [["a", "b"]] * 5).duplicate_rows
    assert judge(spark, [["一丁丂", "x"], ["y", "z"]]).garbled and not judge(spark, [["été à", "x"]]).garbled


def test_quality_of_whole_texts_and_many_rows(spark):
    """Rows that differ late, garbled signs late in a cell, nulls beside the word None; against counts in Python."""
    long = "x" * 500
    table = [[long + str(i % 7), None if i % 3 else "None"] for i in range(40)] + [[long + "ééé\u4e00\u4e01\u4e02", "y"]]
    got = judge(spark, table)
    shown = [tuple("None" if v is None else v for v in r) for r in table]
    assert (got.n_rows, got.n_cols, got.n_cells, got.n_filled, got.n_distinct) == (41, 2, 82, 41 + 14 + 1, len(set(shown)))
    assert got.n_mode == max(26, 15) and got.n_sampled == 20 + 7 and got.n_garbled == 0
    assert judge(spark, table[::-1]).n_garbled == 1
    assert judge(spark, [[None, None]] * 3).n_sampled == 0


def test_islands(spark):
    t = [("d", p, 1, n, None if p == 1 else "detail", ["Row_Type", "Col1"]) for p, n in ((1, 3), (2, 3), (3, 3), (5, 3), (6, 4))]
    df = spark.createDataFrame(t, "doc_id string, page_no int, table_no int, n_cols int, first_row_type string, header array<string>")
    assert [r.island for r in merge.merge_islands(df).orderBy("page_no").collect()] == [1, 1, 1, 2, 3]


def test_detail_ranges(spark):
    data = [("d", 1, 1, i, t) for i, t in enumerate(["HEADER", "DETAIL", "DETAIL", "ROLLUP", "ROLLUP"])]
    got = rows.detail_ranges(spark.createDataFrame(data, "doc_id string, page_no int, table_no int, row_no int, row_type string")).orderBy("row_no").collect()
    assert [(r.row_no, r.first_detail, r.last_detail) for r in got] == [(3, 1, 2), (4, None, None)]


def test_reconcile(spark):
    source = spark.createDataFrame([("d", "Rent 2020 1,000 (50) 5%"), ("e", "no digits")], "doc_id string, text string")
    table = cells_of(spark, [["1,000"], ["(50)"], ["5"]])
    compared = reconcile.compare(reconcile.page_numbers(source), reconcile.cell_numbers(table))
    docs = spark.createDataFrame([("d", True), ("e", True), ("f", False)], "doc_id string, has_text boolean")
    s = {r.doc_id: r for r in reconcile.summary(compared, docs).collect()}
    assert (s["d"].source_numbers, s["d"].table_numbers, s["d"].matches, s["d"].accuracy, s["d"].gate) == (5, 3, 3, 60.0, "review")
    assert {r.num for r in reconcile.missing(compared).collect()} == {202.0, 0.0} and reconcile.extra(compared).isEmpty()
    assert (s["e"].status, s["e"].accuracy) == ("completed", 0.0) and s["f"].status == "skipped"


def test_drop_empty(spark):
    got = normalize.drop_empty(cells_of(spark, [["a", None, ""], [None, None, None], ["b", None, "c"]])).collect()
    assert sorted((r.row_no, r.col_no, r.value) for r in got) == [(0, 0, "a"), (0, 2, ""), (2, 0, "b"), (2, 2, "c")]


@pytest.mark.parametrize(("text", "want"), [
    ("```\na,b\n1,2\n```", [["a", "b"], ["1", "2"]]), ("```\na,b\n1,2\n3,4", [["a", "b"], ["1", "2"]]), ("a,b\n1\n1,2,3\nNA,x", [["a", "b"], ["1", None], [None, "x"]]), ("", None), ('a\n"x\ny"', [["a"], ["x\ny"]]),
])
def test_responses(spark, text, want):
    df = spark.createDataFrame([("d", 1, text)], "doc_id string, page_no int, csv_text string")
    got = responses.parse_responses(df).collect()
    assert (got[0].rows if got else None) == want


def test_sheet_names(spark):
    df = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("b", 1, 2), ("b", 1, 1)], "doc_id string, page_no int, table_no int")
    assert sorted(r.sheet for r in naming.sheet_names(df).collect()) == ["Page1_Table1", "Page1_Table1_2", "Page1_Table2", "Sheet1"]


def test_workbook_round_trip(spark, tmp_path):
    table = [["=1+1", "a<b>&\"c\""], ["é", None]]
    notes = spark.createDataFrame([("d", 1, "See below")], "doc_id string, page_no int, note string")
    books = workbook.workbooks(cells_of(spark, table, names=["n", "m"]), notes)
    workbook.write_workbooks(books, str(tmp_path))
    got = workbook.read_workbook((tmp_path / "d.xlsx").read_bytes())
    assert got["Sheet1"] == [["n", "m"], ["=1+1", "a<b>&\"c\""], ["é"]]
    assert got["Notes"] == [["Page", "Note"], ["Page 1", "See below"]]


def test_notes_go_by_page_and_table(spark):
    """Pages 1 to 12, two tables on a page with notes in the same row, and two notes on a page without rows."""
    noted = [("d", p, t, 0, f"note {p}.{t}") for p in range(12, 0, -1) for t in (2, 1)]
    notes = spark.createDataFrame(noted, "doc_id string, page_no int, table_no int, row_no int, note string")
    got = workbook.read_workbook(workbook.workbooks(cells_of(spark, [["a"]]), notes).first().content)["Notes"]
    assert got == [["Page", "Note"], *([f"Page {p}", f"note {p}.{t}"] for p in range(1, 13) for t in (1, 2))]
    plain = workbook.workbooks(cells_of(spark, [["a"]]), notes.select("doc_id", "page_no", "note")).first().content
    assert workbook.read_workbook(plain)["Notes"] == got


def test_numbers_are_numbers(spark):
    table = [["12", "007", "1,000", "x", "-0.5", "12345678901234567", None], ["3.25", "8", "5", "4", None, "1", "2"]]
    got = workbook.read_workbook(workbook.workbooks(cells_of(spark, table)).first().content)["Sheet1"]
    assert got[1:] == [[12, "007", "1,000", "x", -0.5, "12345678901234567"], [3.25, "8", "5", "4", None, "1", 2]]


def test_files_are_written_from_tasks(spark, tmp_path, monkeypatch):
    from tablewright.sinks import files as sink

    rows = spark.createDataFrame([(f"file:{tmp_path}/{i % 3}/f{i}.bin", bytearray(b"x" * i)) for i in range(20)], "path string, content binary").repartition(4)
    sink.write_files(rows)
    sink.write_files(rows)  # again: replaced
    assert sorted(p.stat().st_size for p in tmp_path.rglob("*") if p.is_file()) == list(range(20))
    monkeypatch.setattr(sink, "_store", lambda path: 1 / 0)  # no client for this store: the driver writes
    sink.write_files(rows.selectExpr("replace(path, '/f', '/g') AS path", "content"))
    assert len([p for p in tmp_path.rglob("g*.bin")]) == 20
    sink.write_files(rows.limit(0))


def test_scan_files(spark, tmp_path):
    for n in ("a.pdf", "b.PNG", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert sorted((r.path.rsplit("/", 1)[1], r.kind) for r in files.scan_files(spark, str(tmp_path)).collect()) == [("a.pdf", "pdf"), ("b.PNG", "image")]
    marked = spark.createDataFrame([("/x/d.pdf:Zone.Identifier",), ("/x/d.pdf",)], "path string")
    assert [r.path for r in files.convertible(marked).collect()] == ["/x/d.pdf"]
    with pytest.raises(FileNotFoundError):
        files.scan_files(spark, str(tmp_path / "none"))


def test_broken_files_fail_no_job(spark):
    def reader(content):
        if content == b"bad":
            raise ValueError("broken")
        return [(1, content.decode(), 0)]

    df = spark.createDataFrame([("a", bytearray(b"ok")), ("b", bytearray(b"bad"))], "path string, content binary")
    got = {r.doc_id: (r.text, r.error) for r in pages.read_pages(df, reader).collect()}
    assert got == {"a": ("ok", None), "b": (None, "ValueError: broken")}
    tables = pages.read_tables(df, lambda c, how: [(1, 1, [["h"], [c.decode()]])] if how else [])
    assert sorted(r.doc_id for r in tables.collect()) == ["a", "b"]

    def partly(content, how):
        yield 1, 1, [["h"], ["1"]]
        yield 1, 2, ValueError("this table alone")
        yield 1, 3, [["h"], ["3"]]
        if content == b"bad":
            raise OSError("and then the file")

    got = sorted((r.doc_id, r.table_no or 0, r.error) for r in pages.read_tables(df, partly).collect())
    assert got == [(d, t, None if t else "ValueError: this table alone") for d in ("a", "b") for t in (0, 1, 3)]


def test_live_and_replayed_answers(spark):
    def extractor(image, page):
        if page == 2:
            raise TimeoutError("slow")
        return f"a\n{image.decode()}{page}"

    shots = spark.createDataFrame([("d", 1, bytearray(b"x")), ("d", 2, bytearray(b"y"))], "doc_id string, page_no int, image binary")
    live = pages.extract_live(shots, extractor, 2)
    assert sorted((r.page_no, r.csv_text, r.error) for r in live.collect()) == [(1, "a\nx1", None), (2, None, "TimeoutError: slow")]
    assert [r.page_no for r in pages.replay(shots, live.where("error is null")).collect()] == [1]


def test_csv(spark, tmp_path):
    csvtext.write_csv(cells_of(spark, [["a,b", None], ['say "x"', "line\nbreak"]], names=["n", "m"]), str(tmp_path / "csv"))
    lines = [p.read_text() for p in (tmp_path / "csv").glob("*.csv")]
    assert [p.name for p in (tmp_path / "csv").iterdir()] == ["d_p1_t1.csv"] and lines == ['n,m\n"a,b",\n"say ""x""","line\nbreak"\n']


def test_report(spark):
    source = spark.createDataFrame([("d", "1 2 x"), ("e", "3")], "doc_id string, text string")
    compared = reconcile.compare(reconcile.page_numbers(source), reconcile.cell_numbers(cells_of(spark, [["1"], ["5"]])))
    docs = spark.createDataFrame([("d", True), ("e", True), ("f", False)], "doc_id string, has_text boolean")
    got = {r.doc_id: r.report for r in report.reports(reconcile.summary(compared, docs), compared).collect()}
    assert "| 2 | 2 | 1 | 50.00% |" in got["d"] and "## Missing" in got["d"] and "| 5.00 | 0 | 1 |" in got["d"] and "Skipped" in got["f"]


def test_shrink():
    """The limit is that of the base64 text, which is longer than the bytes by a third."""
    sizes = []

    def encode(w, h):
        sizes.append((w, h))
        return b"x" * (w * h * 8)

    out = pages.shrink(2000, 1000, pages.text_size(12_000_000), encode)
    assert pages.text_size(len(out)) <= pages.MAX_BYTES and sizes[0] == (1030, 515)
    assert len(base64.b64encode(out)) == pages.text_size(len(out))
    close = pages.shrink(1000, 1000, pages.MAX_BYTES + 4, lambda w, h: b"x" * int(pages.MAX_BYTES * 0.9 * w * h / 810_000))
    assert len(base64.b64encode(close)) <= pages.MAX_BYTES
    assert pages.shrink(10, 10, 5, encode) is None


def test_pictures_are_turned_and_shrunk(monkeypatch):
    """With a stand-in for the picture library: mode, turn, resampling and the limit."""
    calls = []

    class Picture:
        LANCZOS = "lanczos"

        def __init__(self, mode="P", size=(4000, 2000)):
            self.mode, self.size = mode, size

        def convert(self, mode):
            calls.append(("convert", mode))
            return Picture(mode, self.size)

        def rotate(self, degrees, expand):
            calls.append(("rotate", degrees, expand))
            return Picture(self.mode, self.size[::-1])

        def resize(self, size, how):
            calls.append(("resize", how))
            return Picture(self.mode, size)

        def save(self, out, kind):
            out.write(b"p" * (self.size[0] * self.size[1]))

    library = type("Library", (), {"LANCZOS": "lanczos", "open": staticmethod(lambda data: Picture())})
    monkeypatch.setattr(images, "Image", library)
    out = images.prepare(b"", lambda data: -90)
    assert calls[:2] == [("convert", "RGB"), ("rotate", -90, True)] and ("resize", "lanczos") in calls
    assert len(base64.b64encode(out)) <= pages.MAX_BYTES
    assert pages.orientation_of("Rotate: 270\nOrientation confidence: 3.1") == -270 and pages.orientation_of("Rotate: 270\nOrientation confidence: 0.9") == 0 and pages.orientation_of("") == 0


def test_render_pages(spark):
    def renderer(content, zoom):
        yield 1, content + str(zoom).encode()
        yield 2, None
        if content == b"b":
            raise ValueError("page 3")

    df = spark.createDataFrame([("a", bytearray(b"a")), ("b", bytearray(b"b"))], "path string, content binary")
    got = sorted((r.doc_id, r.page_no or 9, bytes(r.image or b""), r.error) for r in pages.render_pages(df, renderer, lambda image: image.upper()).collect())
    assert [(d, p, i) for d, p, i, _ in got] == [("a", 1, b"A4"), ("a", 2, b""), ("b", 1, b"B4"), ("b", 2, b""), ("b", 9, b"")] and got[-1][3] == "ValueError: page 3"


def test_adapters(monkeypatch):
    """The optional readers, with stand-ins for their libraries."""
    found = lambda rows: types.SimpleNamespace(extract=lambda: rows if rows else 1 / 0)
    sheet = types.SimpleNamespace(extract_text=lambda: "text", images=[1, 2], find_tables=lambda how: [found([["a"], ["1"]]), found(None)])
    monkeypatch.setitem(sys.modules, "pdfplumber", types.SimpleNamespace(open=lambda f: contextlib.nullcontext(types.SimpleNamespace(pages=[sheet]))))
    assert list(adapters.pdf_pages(b"")) == [(1, "text", 2)]
    (_, _, rows), (_, t, error) = adapters.pdf_tables(b"", {})
    assert rows == [["a"], ["1"]] and t == 2 and isinstance(error, ZeroDivisionError)

    class Pages(list):
        __enter__ = lambda self: self
        __exit__ = lambda self, *a: None

    page = types.SimpleNamespace(get_pixmap=lambda matrix: types.SimpleNamespace(tobytes=lambda kind: f"{kind}{matrix}".encode()))
    monkeypatch.setitem(sys.modules, "fitz", types.SimpleNamespace(open=lambda stream, filetype: Pages([page, None]), Matrix=lambda x, y: (x, y)))
    assert list(adapters.pdf_pictures(b"", 4)) == [(1, b"png(4, 4)"), (2, None)]
    assert adapters.by_model(lambda prompt, image, most: f"{len(prompt) > 100} {image} {most}")(b"i", 1) == "True b'i' 4096"


def test_convert(spark):
    p = spark.createDataFrame([("/a.pdf", 1, "Rent 10 total 20 and " + "x" * 50, 0), ("/b.pdf", 1, "", 1)], PAGES)
    text = spark.createDataFrame([("/a.pdf", 1, 1, [["Row_Type", "Category", "Y"], ["DETAIL", "Rent", "10"], ["ROLLUP", "Total", "20"]])], RAW_TABLES)
    vision = spark.createDataFrame([("/b.pdf", 1, 1, [["Row_Type", "A", "B"], ["HEADER", "5 (", "7)"]]), ("/b.pdf", 2, 1, [["Row_Type", "Col1", "Col2"], ["DETAIL", "8", "9"]])], RAW_TABLES)
    c = convert(p, text, vision)
    assert {r.doc_id: r.route for r in c.routes.collect()} == {"/a.pdf": "text", "/b.pdf": "vision"}
    b = sorted((r.page_no, r.row_no, r.col_no, r.col_name, r.value) for r in c.cells.where("doc_id = '/b.pdf'").collect())
    assert b == [(1, 0, 0, "Row_Type", "HEADER"), (1, 0, 1, "A", "5"), (1, 0, 2, "B", "(7)"), (1, 1, 0, "Row_Type", "DETAIL"), (1, 1, 1, "A", "8"), (1, 1, 2, "B", "9")]
    s = {r.doc_id: (r.accuracy, r.status) for r in c.summary.collect()}
    assert s["/a.pdf"] == (100.0, "completed") and s["/b.pdf"][1] == "skipped"
    lone = convert(p.limit(0), text, vision.limit(0))
    assert [tuple(r) for r in lone.routes.collect()] == [("/a.pdf", "text")] and lone.cells.count() == 6 and lone.summary.first().status == "skipped"


def test_stage_cells(spark, tmp_path):
    cells_of(spark, [["a", "b"]]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CELLS).parquet(str(tmp_path / "in"))
    stage_cells(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_config(monkeypatch):
    monkeypatch.delenv(config.KEY_VARIABLE, raising=False)
    with pytest.raises(ValueError):
        config.get_api_key()
    monkeypatch.setenv(config.KEY_VARIABLE, " k ")
    assert config.get_api_key() == "k" and config.get_model_name("m") == "m"


def test_clean_cells(spark):
    got = normalize.clean_cells(cells_of(spark, [["10,947 (", "3,094)(", "578)(", "173"]])).orderBy("col_no").collect()
    assert [r.value for r in got] == ["10,947", "(3,094)", "(578)", "(173)"]


def test_convert_directory(spark, tmp_path):
    from tablewright.plans.batch import convert_directory

    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, data in (("a.pdf", b"text"), ("sub/b.pdf", b"scan"), ("c.pdf", b"bad"), ("d.png", b"shot"), ("e.pdf", b"none")):
        (tmp_path / "in" / name).write_bytes(data)

    def page_reader(content):
        if content == b"bad":
            raise ValueError("broken")
        return [(1, "Rent 10 and Total 10", int(content == b"scan"))]

    def table_reader(content, how):
        return [(1, 1, [["Row_Type", "Category", "Y"], ["DETAIL", "Rent", "10"], ["ROLLUP", "Total", "10"]])] if content == b"text" and not how else []

    here = f"file:{tmp_path}/in"
    answers = spark.createDataFrame([(f"{here}/sub/b.pdf", 1, "A,B\n5 (,7"), (f"{here}/d.png", 1, "```\nX,Y\n1,2\n```")], "doc_id string, page_no int, csv_text string")
    status = convert_directory(spark, f"{tmp_path}/in", f"file:{tmp_path}/out", f"file:{tmp_path}/staging", page_reader, table_reader, answers, recursive=True)
    got = {r.path.rsplit("/", 1)[1]: r.status for r in status.collect()}
    assert got == {"a.pdf": "success", "b.pdf": "success", "c.pdf": "failed", "d.png": "success", "e.pdf": "no_tables"}
    assert sorted(p.relative_to(tmp_path / "out").as_posix() for p in (tmp_path / "out").rglob("*.xlsx")) == ["a_pdf.xlsx", "d_png.xlsx", "sub/b_pdf.xlsx"]
    assert workbook.read_workbook((tmp_path / "out/sub/b_pdf.xlsx").read_bytes())["Sheet1"] == [["A", "B"], [5, "(7)"]]
    assert sorted(p.name for p in (tmp_path / "out").rglob("*_validation.md")) == ["a_pdf_validation.md", "b_pdf_validation.md"]
    assert "| 2 | 2 | 2 | 100.00% |" in (tmp_path / "out/a_pdf_validation.md").read_text()


def test_live_extraction_is_saved_and_not_repeated(spark, tmp_path):
    """Documents for vision are rendered and asked for, picture files too; a second run asks nothing."""
    from tablewright.plans.batch import convert_directory, convert_file

    (tmp_path / "in").mkdir()
    for name, data in (("scan.pdf", b"scan"), ("text.pdf", b"text"), ("shot.png", b"shot")):
        (tmp_path / "in" / name).write_bytes(data)
    log = tmp_path / "calls"
    log.mkdir()

    def extractor(image, page):
        (log / f"{image.decode()}-{page}-{uuid.uuid4().hex}").touch()
        if page == 3:
            raise TimeoutError("slow")
        return f"A,B\n{page},{image.decode()}"

    readers = {
        "page_reader": lambda content: [(1, "Rent 10 and Total 10", int(content == b"scan"))],
        "table_reader": lambda content, how: [(1, 1, [["Row_Type", "Y"], ["DETAIL", "10"], ["ROLLUP", "10"]])] if content == b"text" else [],
    }
    live = {"renderer": lambda content, zoom: [(n, content) for n in (1, 2, 3, 4, 5)], "extractor": extractor, "concurrency": 2, "save_every": 2}
    run = lambda: {r.path.rsplit("/", 1)[1]: (r.status, r.n_tables) for r in convert_directory(spark, f"{tmp_path}/in", f"file:{tmp_path}/out", f"file:{tmp_path}/staging", **readers, **live).collect()}
    want = {"scan.pdf": ("success", 4), "text.pdf": ("success", 1), "shot.png": ("success", 1)}
    assert run() == want and len(list(log.iterdir())) == 6 and len(list((tmp_path / "staging/answers").glob("batch=*"))) >= 2
    sheets = workbook.read_workbook((tmp_path / "out/scan_pdf.xlsx").read_bytes())
    assert sheets["Page4_Table1"] == [["A", "B"], [4, "scan"]] and len(sheets) == 4
    assert convert_file(spark, f"{tmp_path}/in/text.pdf", f"file:{tmp_path}/one", f"file:{tmp_path}/staging2", **readers).endswith("/one/text_pdf.xlsx")
    assert workbook.read_workbook((tmp_path / "one/text_pdf.xlsx").read_bytes())["Sheet1"][1] == ["DETAIL", 10]


PLUGS = """
def pages(content):
    if content == b"broken":
        raise ValueError("broken")
    return [(1, "Rent 10 Total 10", int(content == b"scan"))]


def tables(content, how):
    return [(1, 1, [["Row_Type", "Y"], ["DETAIL", "10"], ["ROLLUP", "10"]])] if content == b"text" else []
"""


def test_command_converts(spark, tmp_path, capsys, monkeypatch):
    from tablewright import cli

    (tmp_path / "plugged_readers.py").write_text(PLUGS)
    monkeypatch.syspath_prepend(str(tmp_path))
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, data in (("a.pdf", b"text"), ("deep/b.pdf", b"scan"), ("c.pdf", b"broken"), ("notes.txt", b"-")):
        (tmp_path / "in" / name).write_bytes(data)
    spark.createDataFrame([(f"file:{tmp_path}/in/deep/b.pdf", 1, "A,B\n1,2")], "doc_id string, page_no int, csv_text string").write.parquet(str(tmp_path / "answers"))
    plugs = ["--pages", "plugged_readers:pages", "--tables", "plugged_readers:tables"]
    assert cli.main([f"{tmp_path}/in", "-o", f"file:{tmp_path}/out", "-r", "--answers", str(tmp_path / "answers"), *plugs]) == 1
    said = capsys.readouterr().out
    assert "1 failed, 2 success" in said and "ValueError: broken" in said
    made = sorted(p.relative_to(tmp_path / "out").as_posix() for p in (tmp_path / "out").rglob("*") if p.suffix in (".xlsx", ".md"))
    assert made == ["a_pdf.xlsx", "a_pdf_validation.md", "deep/b_pdf.xlsx", "deep/b_pdf_validation.md"]
    assert cli.main([f"{tmp_path}/in/a.pdf", *plugs, "--staging", f"file:{tmp_path}/s"]) == 0 and (tmp_path / "in/a_pdf.xlsx").exists() and (tmp_path / "in/a_pdf_validation.md").exists()
    assert cli.main([f"{tmp_path}/in", "--list", *plugs[:2]]) == 0 and "text\t" in capsys.readouterr().out
    (tmp_path / "none").mkdir()
    assert cli.main([f"{tmp_path}/none", "-o", f"file:{tmp_path}/out2", *plugs]) == 2
