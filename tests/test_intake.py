"""Files, imports, rules and rate pages: the cases the bulk fixture does not hold."""

from __future__ import annotations

import json
import random
from dataclasses import replace
from datetime import date, datetime
from types import SimpleNamespace

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from remitra.config import values
from remitra.config.loader import Config, load_config, purpose_name_frame, report_line_frame
from remitra.operators import imports as I
from remitra.operators import rates as K
from remitra.operators import rules as R
from remitra.operators.clean import clean
from remitra.operators.dims import report_line_for, resolve_alias
from remitra.session import shared_dir
from remitra.sources import files, records, sinks


@pytest.fixture
def extracts(tmp_path):
    """A positional year with nanoseconds, a header year whose Use is empty, a CSV, and noise."""
    when = [datetime(2025, 3, 1, 13, 45), None]
    (tmp_path / "Receive").mkdir()
    (tmp_path / "Payment" / "nested").mkdir(parents=True)
    pq.write_table(pa.table({
        "Hash_ID": ["n1", "n2"], "Date_of_Transaction": pa.array(when, pa.timestamp("ns")),
        "Use": ["Yes", None], "Source_Year": [2025, 2025], "Amount_USD": [1.5, None],
        "RecipientName_ AccountNumber": ["x", None],
    }), tmp_path / "Receive" / "R_2025.parquet")
    pq.write_table(pa.table({
        "Hash_ID": ["e1"], "Date_of_Transaction": pa.array([datetime(2024, 1, 2)], pa.timestamp("us")),
        "Use": pa.array([None], pa.null()), "Extra": [7],
    }), tmp_path / "Receive" / "R_2024.parquet")
    (tmp_path / "Payment" / "P_2023.csv").write_text(
        'Hash_ID,Banks,Date_of_Transaction,Amount_USD\nc1," b ",2023-05-06 07:08:09,12.5\nc2,,bad,x\nc3,"two\nlines",bad,1\n'
    )
    for name in ("~$P_2023.csv", "notes.txt", "nested/P_1999.parquet"):
        (tmp_path / "Payment" / name).write_text("x")
    return f"file://{tmp_path}"


def test_discover(spark, extracts):
    names = [p.rsplit("/", 1)[-1] for flow in ("Payment", "Receive") for p in files.discover(spark, extracts, flow)]
    assert names == ["P_2023.csv", "R_2024.parquet", "R_2025.parquet"]
    assert files.discover(spark, extracts, "Nowhere") == []
    assert files.overlapping_stems(["a/x.csv", "a/x.parquet", "a/y.csv"]) == ["x"]


def test_union_of_awkward_files(spark, extracts):
    raw = files.union_flows(spark, extracts, strict=False)
    rows = {r["Hash_ID"]: r for r in raw.collect()}
    assert rows["n1"]["Date_of_Transaction"] == datetime(2025, 3, 1, 13, 45)
    assert rows["n1"]["Use"] == "Yes" and rows["e1"]["Use"] is None and rows["e1"]["Extra"] == "7"
    assert rows["n1"]["RecipientName_ AccountNumber"] == "x"
    assert rows["c1"]["Amount_USD"] == 12.5 and rows["c2"]["Date_of_Transaction"] is None
    assert rows["c3"]["Banks"] == "two\nlines" and rows["c3"]["Amount_USD"] == 1.0
    assert {r["_flow"] for r in rows.values()} == {"Payment", "Receive"}
    tx = {r["Hash_ID"]: r for r in clean(raw).collect()}
    assert set(tx) == {"n1", "e1", "c1"}
    assert tx["c1"]["bank"] == "b" and tx["c1"]["yr"] == 2023 and tx["c1"]["flow"] == "Payment"


def test_nothing_is_lost_in_silence(spark, extracts, tmp_path):
    with pytest.raises(ValueError, match=r"P_2023.csv Amount_USD \(1\), P_2023.csv Date_of_Transaction \(2\)"):
        files.union_flows(spark, extracts)
    rejects = files.read_flows(spark, extracts).rejects.collect()
    assert {(r.file, r.line, r.field, r.filed) for r in rejects} == {
        ("P_2023.csv", 3, "Date_of_Transaction", "bad"), ("P_2023.csv", 3, "Amount_USD", "x"), ("P_2023.csv", 4, "Date_of_Transaction", "bad"),
    }
    for field, cell in (("Amount_USD", '"1,234.50"'), ("Exchange_Rates_Kip", "abc"), ("Date_of_Submission", "32/01/2025"), ("Source_Year", "x")):
        (tmp_path / "Payment" / "P_2023.csv").write_text(f"Hash_ID,{field}\nc1,{cell}\nc2,\n")
        with pytest.raises(ValueError, match=rf"no known format: P_2023.csv {field} \(1\)"):
            files.union_flows(spark, extracts)
    (tmp_path / "Payment" / "P_2023.csv").write_text("Hash_ID,Date_of_Transaction\nc1,31/12/2025\nc2,2025-12-30\n")
    with pytest.raises(ValueError, match="no known format"):
        files.union_flows(spark, extracts)
    raw = files.union_flows(spark, extracts, date_formats=["dd/MM/yyyy"])
    days = {r["Hash_ID"]: r["Date_of_Transaction"] for r in raw.collect()}
    assert days["c1"] == datetime(2025, 12, 31) and days["c2"] == datetime(2025, 12, 30)
    pq.write_table(pa.table({"Hash_ID": ["p", "q"], "Amount_USD": ["7.5", "seven"]}), tmp_path / "Payment" / "P_2023.parquet")
    with pytest.warns(UserWarning, match="P_2023"), pytest.raises(ValueError, match=r"P_2023.parquet Amount_USD \(1\)"):
        files.union_flows(spark, extracts, date_formats=["dd/MM/yyyy"])
    read = files.read_parquet_canonical(spark, [f"{extracts}/Payment/P_2023.parquet"])
    assert [tuple(r) for r in read.rejects.collect()] == [("P_2023.parquet", 2, "Amount_USD", "seven")]
    (tmp_path / "Payment" / "P_2022.xlsx").write_text("x")
    with pytest.raises(ValueError, match="P_2022.xlsx"):
        files.union_flows(spark, extracts)


def plain_records(text):
    """Records of a CSV text and the line each begins at, character by character."""
    found, record, line, first, state = [], "", 1, 1, "start"
    for ch in text:
        if ch == "\n" and state != "quoted":
            found.append((first, record))
            record, line, state = "", line + 1, "start"
            first = line
            continue
        line += ch == "\n"
        record += ch
        if state == "quoted":
            state = "quote" if ch == '"' else state
        elif ch == '"' and state in ("start", "quote"):
            state = "quoted"
        else:
            state = "start" if ch == "," else "plain"
    return found + ([(first, record)] if record else [])


def batches(chunks, draw):
    for start, lines in chunks:
        size = draw.randint(1, 5)
        for low in range(0, len(lines), size):
            part = lines[low : low + size]
            yield pa.RecordBatch.from_arrays([pa.array(["f"] * len(part)), pa.array([start] * len(part)), pa.array(part, pa.string())], ["file", "start", "value"])


def test_records_of_any_splits(monkeypatch):
    draw = random.Random(1)
    for _ in range(4000):
        text = "head\n" + "".join(draw.choices(['"', ",", "a", "\n", '""', " "], weights=[3, 2, 3, 3, 1, 1], k=draw.randint(0, 60)))
        lines = text.removesuffix("\n").split("\n")
        borders = [0, *sorted(draw.sample(range(1, len(lines) + 1), min(len(lines), draw.randint(0, 4)))), len(lines)]
        chunks = [(low, lines[low:high]) for low, high in zip(borders, borders[1:], strict=False) if low < high]
        starts = records.chain([note for part in records.follow(batches(chunks, draw)) for note in part.to_pylist()])
        monkeypatch.setattr(records, "HELD_CHARS", draw.choice([1, 10, 1_000_000]))
        rows = []
        for tasks in [chunks] if draw.random() < 0.5 else [[chunk] for chunk in chunks]:
            cutter = records._Cutter(starts)
            for batch in batches(tasks, draw):
                for file, start, part in records._runs(batch):
                    if cutter.at != (file, start):
                        cutter.enter(file, start)
                    cutter.add(part)
                rows += cutter.taken().to_pylist()
            cutter.leave()
            rows += cutter.taken().to_pylist()
        got = {}
        for row in sorted(rows, key=lambda r: (r["line"], r["piece"] or 0)):
            got[row["line"]] = row["text"] if row["line"] not in got else got[row["line"]] + "\n" + row["text"]
        want = {line: record for line, record in plain_records(text.removesuffix("\n")) if line > 1 and record.strip()}
        assert {line: record for line, record in got.items() if record.strip()} == want, text


def test_csv_files_with_line_breaks_are_split(spark, tmp_path):
    cells = [f'bank "{k}",\nx\n\n"{"y" * (k % 500)}' if k % 3 else f"plain {k}" for k in range(20_000)]
    cells[700] = "z\n" * 150_000
    lines = ["\ufeffHash_ID,Banks,\"Amount_USD\""] + [f"{k},\"{c.replace(chr(34), chr(34) * 2)}\",{k}.5" for k, c in enumerate(cells)]
    (tmp_path / "broken.csv").write_text("\r\n".join(lines) + "\r\n", newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        path = f"file://{tmp_path}/broken.csv"
        notes = records.notes_of(spark, [path])
        assert len(notes) > 20 and sum(s.record is not None for s in records.chain(notes).values()) > 10
        assert records.pieces_of(spark, [path], notes).rdd.getNumPartitions() > 20
        read = files.read_csv_canonical(spark, [path])
        rows = {r.Hash_ID: (r.Banks, r.Amount_USD) for r in read.rows.collect()}
        assert rows == {str(k): (c, k + 0.5) for k, c in enumerate(cells)} and read.rejects.isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_records_that_do_not_fit(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\nHash_ID,Banks,Amount_USD\n1,a,1\n\n2,b\n3,c,3,more\n4,5" pipe,4\n5,"d" e,5\n6,"open\n7,f,7\n')
    read = files.read_csv_canonical(spark, [f"file://{tmp_path}/a.csv"])
    rows = {r.Hash_ID: (r.Banks, r.Amount_USD) for r in read.rows.collect()}
    assert rows["1"] == ("a", 1.0) and rows["2"] == ("b", None) and rows["3"] == ("c", 3.0) and rows["4"] == ('5" pipe', 4.0)
    assert rows["5"][1] == 5.0 and set(rows) == {"1", "2", "3", "4", "5", "6"}
    assert {(r.line, r.field, r.filed) for r in read.rejects.collect()} == {(5, None, "2,b"), (6, None, "3,c,3,more"), (9, None, '6,"open\n7,f,7')}
    (tmp_path / "b.csv").write_text('Hash_ID,Banks\n')
    assert files.read_csv_canonical(spark, [f"file://{tmp_path}/b.csv"]).rows.count() == 0
    (tmp_path / "c.csv").write_text("Hash_ID,Banks\r1,a\r2,b\r", newline="")
    with pytest.raises(ValueError, match="carriage return"):
        files.read_csv_canonical(spark, [f"file://{tmp_path}/c.csv"])


def test_an_unknown_header_stops_the_import(spark, ws):
    flow = files.direction_of(F.col("file"), F.col("sheet"))
    names = purpose_name_frame(spark, Config())
    with pytest.raises(ValueError, match="five_headers.xlsx"):
        I.import_by_header(ws.cells, ws.raw, names, flow)
    report = I.import_report(ws.cells)
    assert report.agg(F.sum("n")).first()[0] == ws.cells.count()


def test_ids_keep_fractions_of_a_second(spark):
    import hashlib

    row = {"Flow": "Receive", "file": "f", "row_no": 7, "Banks": "B", "Reference_Number": None, "Amount_Transferred": 1.5,
           "Currency_Code": "USD", "Purpose_Code": "01"}
    for when in (datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5, 60)):
        df = spark.createDataFrame([(*row.values(), when)], "Flow string, file string, row_no long, Banks string, Reference_Number string,"
                                   " Amount_Transferred double, Currency_Code string, Purpose_Code string, Date_of_Transaction timestamp_ntz")
        text = f"Receive|f|7|B|None|{when}|1.5|USD|01"
        assert I.hash_id(df).first()["Hash_ID"] == hashlib.sha1(text.encode()).hexdigest()[:24]


def test_no_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.union_flows(spark, f"file://{tmp_path}")


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == shared_dir(spark)

    def session(**settings):
        conf = {key.replace("_", "."): value for key, value in settings.items()}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, default=None: conf.get(k, default)))

    assert shared_dir(session(spark_checkpoint_dir="hdfs://x/y/", spark_master="yarn")) == "hdfs://x/y"
    with pytest.raises(ValueError):
        shared_dir(session(spark_master="yarn"))


def test_lag_counts_calendar_days(spark):
    df = spark.sql("SELECT timestamp_ntz'2020-01-01 23:00:00' AS a, timestamp_ntz'2020-01-02 01:00:00' AS b")
    from remitra.functions.dates import lag_days

    assert df.select(lag_days(F.col("a"), F.col("b"))).first()[0] == 1


def test_config_overrides(tmp_path):
    (tmp_path / "name_blocklist.json").write_text(json.dumps({"names": [" anon ", "null"]}))
    (tmp_path / "bank_officers.json").write_text(json.dumps({"officers": {"A": "x"}, "names_lo": {}}))
    (tmp_path / "report_lines.json").write_text(json.dumps({
        "bankOwnRule": {"namePatterns": ["BANK"]},
        "lines": [{"id": "b", "order": 2, "codes": ["02"], "lo": "b", "en": "b"},
                  {"id": "a", "order": 1, "codes": ["01"], "catchAll": True, "lo": "a", "en": "a"}],
    }))
    config = load_config(str(tmp_path))
    assert "ANON" in config.blocklist and set(values.PLACEHOLDER_NAMES) <= set(config.blocklist)
    assert [line[0] for line in config.report_lines] == ["a", "b"]
    assert config.report_lines[1][2] == "financial"
    assert config.own_patterns == ["BANK"] and config.bank_aliases == values.BANK_ALIASES


def test_large_lookups(spark):
    names = {f"{k:06d}": {"lo": f"n{k}"} for k in range(20_000)}
    official = purpose_name_frame(spark, Config(purpose_names=names))
    df = spark.createDataFrame([("019999", None), ("999999", None)], "Pur_5 string, Purpose_Name string")
    assert {r["Purpose_Name"] for r in I.purpose_name(df, official).collect()} == {"n19999", None}


def test_longest_prefix(spark):
    lines = [("one", 1, "g", False, ["01", "0102"], False, "", ""), ("two", 2, "g", False, ["0101"], False, "", ""),
             ("three", 3, "g", False, ["0101", "03"], False, "", ""), ("rest", 4, "g", False, [], True, "", ""),
             ("last", 5, "g", False, ["9"], False, "", "")]
    codes = spark.createDataFrame([("010101",), ("0102",), ("0199",), ("03",), ("77",)], "code string")

    def found(lines):
        frame = report_line_frame(spark, Config(report_lines=lines))
        return {r["code"]: r["line_ix"] for r in report_line_for(codes, frame).collect()}

    # Of equally long prefixes the first line wins; without a catch-all the last line takes the rest.
    assert found(lines) == {"010101": 1, "0102": 0, "0199": 0, "03": 2, "77": 3}
    assert found([line[:5] + (False,) + line[6:] for line in lines])["77"] == 4


def test_alias_is_one_hop(spark):
    df = spark.createDataFrame([("AB",), ("CD",), ("EF",)], "key string")
    got = resolve_alias(df, {"a-b": "c.d", "cd": "EF"}, "key")
    assert sorted(r["key"] for r in got.collect()) == ["CD", "EF", "EF"]


def test_mode_tie_goes_to_the_lower_value(spark):
    df = spark.createDataFrame([("1", "b"), ("1", "a"), ("2", "b"), ("2", "b"), ("2", "a")], "Pur_5 string, Move_Fund string")
    assert {r["Pur_5"]: r["usual"] for r in I.move_fund_map(df).collect()} == {"1": "a", "2": "b"}


def test_skips_add_up(ws):
    low, high = date(1997, 1, 1), date(1998, 12, 31)
    rows = I.map_positions(ws.book, "Payment")
    report = {r["outcome"]: r["n"] for r in I.skip_report(rows, low, high).collect()}
    assert sum(report.values()) == ws.book.filter("sheet = 'Payment'").count()
    assert report["kept"] == I.filter_rows(rows, low, high).count()
    assert set(report) == {"kept", "undated", "out_of_range", "template"}


RULE_CASES = [
    # bank, flow, country, purpose, sector, name, remark -> purpose, m2, use
    (("ICBC", "Receive", "TH", "05010401", None, None, None), ("05010401", "No", "Deposit")),
    (("icbcv", "Payment", "TH", "050204", None, None, None), ("050204", "Yes", "Re_Deposit")),
    (("LDB", "Receive", "TH", "05020401", None, None, None), ("05020401", "Yes", "No")),
    (("BCEL", "Receive", "KR", "05020401", None, None, None), ("0301", "Yes", "Yes")),
    ((None, "Receive", "TH", "05020401", None, None, None), ("05020401", "Yes", "No")),
    (("BOC", "Receive", "TH", "05010504", "02", None, None), ("05010504", "No", "No")),
    (("BOC", "Payment", "TH", "050105", None, None, None), ("02020", "Yes", "Yes")),
    (("BOC", "Payment", "TH", "05010504", None, None, None), ("05010504", "Yes", "No")),
    (("LDB", "Payment", "TH", "05020301", None, None, None), ("050103", "No", "FX")),
    (("LDB", "Payment", "TH", "050104", None, None, "Move fund"), ("050104", "No", "No")),
    (("LDB", "Payment", "TH", "050104", None, None, None), ("0404", "Yes", "Yes")),
    (("LDB", "Payment", "TH", "07", None, None, "clearing"), ("07", "Yes", "Yes")),
    (("LDB", "Receive", "TH", "07", None, None, "clearing"), ("07", "No", "Yes")),
    (("OPD", "Receive", "TH", "010302", None, None, None), ("010302", "No", "No")),
    (("OPD", "Receive", "TH", "01", None, None, None), ("01", "No", "Yes")),
    (("BCEL", "Receive", "TH", "01", None, "Moneygram Ltd", None), ("01", "No", "No")),
    (("LDB", "Receive", "TH", "01", None, "Moneygram Ltd", None), ("01", "Yes", "Yes")),
    (("BOC", "Payment", "TH", "01", "0301", None, "loan repayment"), ("01", "Yes", "Repayment_BOC")),
    (("ICBCV", "Payment", "TH", "01", "02", None, "Loan 7"), ("01", "Yes", "Loan_ICBCV")),
    (("LDB", "Payment", "TH", "01", "02", None, "forfeiting, repay"), ("01", "Yes", "Repayment_ICBCV")),
    (("LDB", "Payment", "TH", None, None, None, None), (None, "Yes", "Yes")),
]


def test_rules(spark):
    data = [(i, *case) for i, (case, _) in enumerate(RULE_CASES)]
    df = spark.createDataFrame(
        data, "i int, bank string, flow string, country string, purpose string, sector string, name string, remark string"
    )
    got = R.use_flag(R.m2_flag(R.purpose_transform(df))).orderBy("i").select("final_purpose", "m2_rule", "use_rule")
    assert [tuple(r) for r in got.collect()] == [expected for _, expected in RULE_CASES]


def test_slips_in_rule_files_are_errors(tmp_path):
    good = {"id": "a", "purposePrefix": ["05"], "action": "keep"}
    use = {"value": "Yes", "default": True}
    for document, where in [
        ({"purposeTransfrom": {}}, "unknown purposeTransfrom"), ({"purposeTransform": {"rules": [{**good, "purposePrefx": ["x"]}]}}, "purposePrefx"),
        ({"purposeTransform": {"rules": [good, good]}}, "id of its own"), ({"purposeTransform": {"rules": [{**good, "action": "set"}]}}, "needs a code"),
        ({"purposeTransform": {"rules": [{**good, "purposePrefix": "05"}]}}, "list of texts"), ({"purposeTransform": {"rules": [{**good, "flow": "In"}]}}, "flow"),
        ({"m2Flag": {"setNo": [{}]}}, "no condition"), ({"m2Flag": {"setNo": [{"bank": 7}]}}, "a text"), ({"useFlag": {"rules": [use, use]}}, "follow the default"),
        ({"useFlag": {"rules": [{"value": "No", "flow": "both"}]}}, "last rule"), ({"useFlag": {"rules": [{"value": "x", "anyOf": [{"default": True}]}, use]}}, "unknown default"),
        ({"duplicates": {"tierA": {"keys": ["bnak"]}}}, "unknown bnak"), ({"duplicates": {"tierA": {"keys": ["bank"], "minReferenceLength": "4"}}}, "whole number"),
        ({"exchangeRate": {"bands": {"USD": {"min": 3, "max": 2}}}}, "in this order"), ({"exchangeRate": {"usdPerUsdBand": {"low": 1}}}, "unknown low"),
    ]:
        (tmp_path / "bop_rules.json").write_text(json.dumps(document))
        with pytest.raises(ValueError, match=where):
            load_config(str(tmp_path))


def test_a_rule_file_may_leave_sections_out(spark, tmp_path):
    (tmp_path / "bop_rules.json").write_text(json.dumps({
        "_README": ["x"], "exchangeRate": {"_note": [], "bands": {"usd": {"min": 1, "max": 2}}, "manualOverrideSheet": "s"}, "manualOverrides": {"a": 1}}))
    config = load_config(f"file://{tmp_path}", spark)
    assert config.rules == replace(Config().rules, rate_bands=[("USD", 1.0, 2.0)]) and load_config(str(tmp_path)).rules == config.rules
    with pytest.raises(ValueError, match="unknown condition"):
        R.condition({"purposPrefix": ["05"]})


def test_flag_rules_can_read_the_filed_purpose(spark):
    df = spark.createDataFrame([("LDB", "Payment", "TH", "050203", None, None, None)],
                               "bank string, flow string, country string, purpose string, sector string, name string, remark string")
    df = R.purpose_transform(df)
    assert R.use_flag(df).first()["use_rule"] == "FX"
    assert R.use_flag(df, purpose="purpose").first()["use_rule"] == "Yes"


def test_own_account(spark):
    df = spark.createDataFrame([("Lao Viet Co",), ("boc trading",), ("bocx",), (None,), ("a.z",)], "n string")
    got = df.select(R.bank_own(F.col("n"), values.OWN_PATTERNS)).collect()
    assert [r[0] for r in got] == [True, True, False, False, False]


def test_page_dates(spark):
    pages = ["on 1/2/2024 and 2024-03-04", "3-4-2024 1/2/2024", "x 11/12/2023", "none"]
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    assert [r[0] for r in df.select(K.page_date(F.col("html"))).collect()] == ["2024-03-04", "3-4-2024", "11/12/2023", ""]


def test_implausible_dollar_rates_drop_their_source(spark):
    rates = spark.createDataFrame(
        [("a", "USD", 22000.0, 22100.0), ("a", "THB", 600.0, 610.0), ("b", "USD", 22.0, 22100.0),
         ("b", "THB", 600.0, 610.0), ("c", "THB", 600.0, 610.0)],
        "source string, code string, buy double, sell double",
    )
    assert {r["source"] for r in K.sane_sources(rates).collect()} == {"a"}


def test_character_references(spark):
    cells = "<td>USD</td><td>US&#8211;Dollar &eacute;&#xA0;&amp;lt;</td><td>22,000</td><td>22,100</td>"
    page = [("a", "en", "u", f"2024-01-02<table><tr>{cells}</tr></table>")]
    df = spark.createDataFrame(page, "source string, style string, url string, html string")
    row = K.rates_table(df).first()
    assert (row["name"], row["buy"], row["sell"], row["date"]) == ("US\u2013Dollar \u00e9 &lt;", 22000.0, 22100.0, "2024-01-02")
    plan = K.rates_table(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") + plan.count("Scan") == 1


def test_published_rates_survive_an_empty_run(spark, tmp_path):
    rates = spark.createDataFrame([("a", "USD", 1.0)], "source string, code string, buy double")
    out = f"file://{tmp_path}/rates"
    assert sinks.write_rates(rates, out)
    assert not sinks.write_rates(rates.filter("buy > 2"), out)
    assert sinks.read_rates(spark, out).count() == 1
