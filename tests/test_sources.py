"""Strict records against a character-wise reader, layouts of printed pages, coercion."""

import datetime as dt
import uuid
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillweave.config.errors import ExtractionError, InputError, ProfileError
from tillweave.config.profile import find_profile
from tillweave.functions import columns as C
from tillweave.operators import integrity
from tillweave.sources import layout as L
from tillweave.sources import strict_records as S
from tillweave.sources.csv_files import read_export, read_text_frame
from tillweave.sources.quoted_scan import scan_records


def reference_fields(raw):
    """Fields of a record one character at a time; None where the quoting is broken."""
    raw = raw[:-1] if raw.endswith("\r") else raw
    fields, i = [], 0
    while True:
        if raw[i : i + 1] == '"':
            out, i = "", i + 1
            while True:
                if i >= len(raw):
                    return None
                if raw[i] == '"' and raw[i + 1 : i + 2] == '"':
                    out, i = out + '"', i + 2
                elif raw[i] == '"':
                    i += 1
                    break
                else:
                    out, i = out + raw[i], i + 1
            if i < len(raw) and raw[i] != ",":
                return None
        else:
            j = raw.find(",", i)
            j = len(raw) if j < 0 else j
            out, i = raw[i:j], j
        fields.append(out)
        if i >= len(raw):
            return fields
        i += 1


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='a",\n\r\x00 ', min_size=1, max_size=14).filter(lambda r: r.strip("\r\n")))
def test_split_record(raw):
    assert S.split_record(raw) == reference_fields(raw)


@pytest.mark.parametrize(
    "text, value",
    [("5", "5"), (" -1.50 ", "-1.50"), ("(2.5)", "-2.5"), ("(-2)", "2"), ("+3", "3"), ("1 234.5", "1234.5"), (".5", "0.5"), ("7.", "7"), ("", None), (" - ", None)]
    + [(x, "bad") for x in ("--1", "1,000", "1e3", "NaN", "inf", "0x1F", "1.234", "5-", "(5", "1.2.3", "−5", "٣", ".")],
)
def test_money(text, value, spark):
    if value == "bad":
        with pytest.raises(S.FieldError):
            S.money(text)
    else:
        assert S.money(text) == (None if value is None else Decimal(value))
    row = spark.range(1).select(C.parse_money(F.lit(text), "").alias("v"), C.money_is_bad(F.lit(text), "").alias("bad")).first()
    if text != ".":
        assert row.bad == (value == "bad") and row.v == (None if value in (None, "bad") else Decimal(value))


HEAD = "Type,Product,Started Date,Completed Date,Description,Amount,Fee,Currency,State,Balance"


def record(date="2024-01-02 03:04:05", amount="1.00", balance="2.00", description="Shop"):
    return f"T,C,{date},,{description},{amount},0,EUR,DONE,{balance}"


def test_records(spark):
    raws = [
        (HEAD, None), (None, None), ("", None), ("\r", None), (record(), ""), (record() + "\r", ""), (record(description='"a ""b"",\nc"'), ""), (record(date=" "), ""), (record(balance="-"), ""),
        (record(description='"open'), "quoting"), (record(description='"x"y') + ",", "quoting"), (record() + ",", "column_count"), (record(date="2024-02-30 00:00:00"), "bad_date"), (record(date="2024-02-03"), "bad_date"),
        (record(date="x", amount="x"), "bad_date"), (record(amount=""), "bad_amount"), (record(amount="NaN", balance="y"), "bad_amount"), (record(balance="1,5"), "column_count"), (record(balance='"1,5"'), "bad_balance"), (record(description="z" * 300_000), ""),
    ]
    df = spark.createDataFrame([(i, "f.csv", 1 if r == HEAD else i + 1, r) for i, (r, _) in enumerate(raws)], "line_id long, source_file string, line_no int, raw string").withColumn("reason", F.lit(1))
    parsed = S.parse_records(df)
    assert {r.line_id: r.reason for r in S.rejected(parsed).collect()} == {i: w for i, (_, w) in enumerate(raws) if w}
    good = {r.line_id: r for r in S.accepted(parsed).collect()}
    assert set(good) == {i for i, (_, w) in enumerate(raws) if w == ""}
    assert good[6].description == 'a "b",\nc' and good[4].amount == Decimal("1.00") and good[7].date is None and good[8].balance is None
    assert S.parse_records(df.limit(0)).count() == 0


def test_numbers_of_any_length_parse(spark):
    rows = [(1, "f", 2, record(amount="9" * 17)), (2, "f", 3, record(amount="9" * 40))]
    parsed = {r.line_id: (r.reason, r.amount) for r in S.parse_records(spark.createDataFrame(rows, "line_id long, source_file string, line_no int, raw string")).collect()}
    assert parsed == {1: (None, Decimal("9" * 17)), 2: (None, None)}


FIELD = st.one_of(st.text(alphabet='a", \r', max_size=6).filter(lambda t: not t.startswith('"') and "," not in t), st.text(alphabet='a,\n" \r', max_size=8).map(lambda t: '"' + t.replace('"', '""') + '"'))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(FIELD, min_size=1, max_size=3).map(",".join).filter(lambda r: r not in ("", "\r")), min_size=1, max_size=30), st.sampled_from([7, 23, 1 << 20]), st.booleans())
def test_records_are_those_of_the_whole_file_wherever_it_is_split(spark, tmp_path, records, split, gaps):
    path = tmp_path / f"{uuid.uuid4().hex}.csv"
    path.write_bytes(("\n\n" if gaps else "\n").join(records).encode())
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for key, value in zip(keys, (split, 1)):
        spark.conf.set(key, value)
    try:
        got = sorted((r.record, r.raw, r.source_file) for r in scan_records(spark, str(path)).collect())
    finally:
        for key in keys:
            spark.conf.unset(key)
    assert got == [(i, r, path.name) for i, r in enumerate(records, 1)]


def test_records_of_files(spark, tmp_path):
    content = HEAD + "\n" + record(description='"two\nlines"') + "\n\n" + record(description='bare "quote" inside') + "\n" + record(description='"never ends') + "\nmore"
    (tmp_path / "f.csv").write_text(content)
    (tmp_path / "g.csv").write_text("")
    got = S.read_records(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.line_id, r.line_no, r.source_file) for r in got] == [(1, 1, "f.csv"), (2, 2, "f.csv"), (3, 5, "f.csv"), (4, 6, "f.csv")]
    parsed = S.parse_records(S.read_records(spark, str(tmp_path)))
    assert {r.line_id: r.reason for r in parsed.collect()} == {2: None, 3: None, 4: "quoting"}


def test_text_frames_of_ragged_files(spark, tmp_path):
    """Short rows are filled with blanks, surplus cells go, empty lines have no place; columns may be asked for."""
    (tmp_path / "r.csv").write_text('\ufeffa,b,c\n1\n\n"x\ny",2,3,4\n,,\n \n', encoding="utf-8")
    frame = read_text_frame(spark, str(tmp_path / "r.csv"), ["a", "c"])
    assert [tuple(r) for r in frame.orderBy("ord").collect()] == [("1", "", "", 0), ("x\ny", "2", "3", 1), ("", "", "", 2), (" ", "", "", 3)]
    with pytest.raises(InputError, match="d"):
        read_text_frame(spark, str(tmp_path / "r.csv"), ["a", "d"])
    (tmp_path / "many").mkdir()
    for name in ("b 1", "a"):
        (tmp_path / "many" / f"{name}.csv").write_text(f"x,y\n{name},1\n{name},2\n")
    assert [(r.x, r.y) for r in read_text_frame(spark, str(tmp_path / "many")).orderBy("ord").collect()] == [("a", "1"), ("a", "2"), ("b 1", "1"), ("b 1", "2")]
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ExtractionError, match="header"):
        read_export(spark, str(tmp_path / "e.csv"), find_profile("revolut_current"))


X = {"date": 40, "description": 110, "out": 340, "in": 420, "balance": 500}
HEADERS = [("Date", 40), ("Transaction", 110), ("details", 170), ("Payments", 340), ("-", 382), ("out", 390), ("Payments", 420), ("-", 462), ("in", 470), ("Balance", 500)]


def words(pages, file="s.pdf", pitch=14.0):
    """A word table of pages of rows of field texts, printed below a header."""
    out = []
    for p, rows in enumerate(pages, 1):
        flow = 0
        for text, x in HEADERS:
            out.append((file, p, 595.0, 842.0, flow, text, float(x), x + 6.0 * len(text), 80.0))
            flow += 1
        for k, row in enumerate(rows):
            y = row.get("y", 100.0 + k * pitch)
            for f, x in X.items():
                for n, w in enumerate(str(row.get(f, "")).split()):
                    out.append((file, p, 595.0, 842.0, flow, w, x + 14.0 * n, x + 14.0 * n + 10, y))
                    flow += 1
    return out


WORDS = "source_file string, page int, page_width double, page_height double, flow_idx int, text string, x0 double, x1 double, top double"
BOI = find_profile("boi_current")


def parsed(spark, pages):
    return integrity.coerce(L.raw_rows(spark.createDataFrame(words(pages), WORDS), BOI), BOI).orderBy("row").collect()


def test_layout_round_trip(spark):
    first = [
        {"date": "11 Sep 2025", "description": "Peat and turf", "out": "41.07", "balance": "1,309.93"},
        {"description": "delivered to"},
        {"description": "the upper byre"},
        {"description": "Wool sold", "in": "1,200.00"},
        {"description": "BALANCE FORWARD", "balance": "2,509.93"},
    ]
    second = [{"date": "12 Sep 2025", "description": "Ferry", "out": "9.93"}, {"description": "Fine undone", "out": "(2.00)"}]
    got = parsed(spark, [first, second])
    assert [(r.date, r.description, r.amount, r.balance, r.page, r.row) for r in got] == [
        (dt.date(2025, 9, 11), "Peat and turf delivered to the upper byre", Decimal("-41.07"), Decimal("1309.93"), 1, 1),
        (dt.date(2025, 9, 11), "Wool sold", Decimal("1200.00"), Decimal("2509.93"), 1, 2),
        (dt.date(2025, 9, 12), "Ferry", Decimal("-9.93"), Decimal("2500.00"), 2, 4),
        (dt.date(2025, 9, 12), "Fine undone", Decimal("2.00"), Decimal("2502.00"), 2, 5),
    ]


def test_table_ends_at_a_wide_gap(spark):
    rows = [{"date": "11 Sep 2025", "description": name, "out": "2.40"} for name in ("Rope", "Tar", "Nails", "Oakum")] + [{"description": "Printed in Leith", "out": "3", "y": 411.0}]
    # The height of the last line before the gap is where the table ends, so that line itself is out.
    assert [r.description for r in parsed(spark, [rows])] == ["Rope", "Tar", "Nails"]


def test_header_must_be_there(spark):
    df = spark.createDataFrame([w for w in words([[{"description": "X"}]]) if w[5] != "Balance"], WORDS)
    with pytest.raises(ExtractionError):
        L.check_layout(df, BOI)
    L.check_layout(spark.createDataFrame(words([[{"description": "X"}]]), WORDS), BOI)


def test_strategies_and_extractors_can_be_added(spark, tmp_path):
    """A new alignment, end of table and merging by name, and pages read from files by an extractor."""
    from tillweave.config.profile import parse_profile
    from tillweave.config.strategies import ALIGNS, EXTRACTORS, MULTILINES, TABLE_ENDS
    from tillweave.sources.csv_files import read_words

    spec = lambda: {
        "meta": {"name": "own", "institution": "O", "country": "IE", "source": "pdf"}, "page_detect": {}, "balance": {}, "rows": {"multiline": "reversed"}, "table_end": {"strategy": "third_line"},
        "columns": [{"header": "When", "field": "date", "align": "left_edge"}, {"header": "What", "field": "description", "align": "quarter"}, {"header": "Sum", "field": "amount", "align": "right_edge"}],
    }
    with pytest.raises(ProfileError):
        parse_profile(spec())
    try:
        ALIGNS.add("quarter")(lambda left, right: left.x1 + (right.x0 - left.x1) / 4)
        TABLE_ENDS.add("third_line")(lambda page: sorted(page.lines)[3])
        MULTILINES.add("reversed")(lambda lines: lines[::-1])
        EXTRACTORS.add("pgs")(lambda content: [(1, 300.0, 400.0, i, *w) for i, w in enumerate(eval(content))])
        page = [("When", 10.0, 30.0, 5.0), ("What", 70.0, 90.0, 5.0), ("Sum", 150.0, 170.0, 5.0)]
        page += [(t, x, x + 4, y) for y, row in ((20.0, ("1", "a", "5")), (30.0, ("2", "b", "6")), (40.0, ("3", "c", "7"))) for t, x in zip(row, (12.0, 45.0, 180.0))]
        (tmp_path / "x.pgs").write_text(repr(page))
        words = read_words(spark, str(tmp_path / "x.pgs"))
        profile = parse_profile(spec())
        assert [tuple(b) for b in L.column_bounds(words, profile).first().bounds] == [("date", 0.0, 40.0), ("description", 40.0, 170.0), ("amount", 170.0, 300.0)]
        assert [(r.date, r.description, r.amount, r.row, r.source_file) for r in L.raw_rows(words, profile).orderBy("row").collect()] == [("2", "b", "6", 1, "x.pgs"), ("1", "a", "5", 2, "x.pgs")]
        with pytest.raises(ValueError):
            ALIGNS.add("quarter")(len)
    finally:
        for registry, name in ((ALIGNS, "quarter"), (TABLE_ENDS, "third_line"), (MULTILINES, "reversed"), (EXTRACTORS, "pgs")):
            registry.pop(name, None)


def test_terms(spark):
    df = spark.createDataFrame([("a.b a.b axb",), (None,), ("A.B",)], "text string")
    count = lambda **k: {r.term: (r.hits, r.texts) for r in L.term_counts(df, ["a.b", "q\\E"], **k).collect()}
    assert count()["a.b"] == (2, 1) and count()["q\\E"] == (0, 0) and count(ignore_case=True)["a.b"] == (3, 2)
    assert L.read_terms(["x"], [" x ", "# no", "", "y"]) == ["x", "y"]
