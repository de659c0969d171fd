"""Test inputs made from the driver tables.

Statements marked as shared run unchanged in Spark and in the checking engine,
so both sides see the same rows; everything after them is written twice.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remitra.config.loader import Config
from remitra.plans.build import Build
from remitra.session import prepare, shared_dir, stage

#: Rows in a zipped extract, which one task reads.
ZIPPED_ROWS = 500_000

TABLES = ("lineitem", "orders", "customer", "supplier", "nation", "documents", "pages")

# Twenty purpose codes of six characters: goods codes, ordinary codes, an unknown one,
# a padded two-character one and one of five characters.
CODES = (
    "010107010105010102010109010110010301020101030101040101050101050201050102050103050104"
    "050105050206070101990101    0202020 "
)

# Shared.
RAW = f"""
SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', l_returnflag,
              l_linestatus, copy) AS Hash_ID,
  CASE WHEN l_partkey % 211 = 0 THEN NULL
       WHEN l_partkey % 3 = 0 THEN concat('Bank-', l_suppkey % 12)
       WHEN l_partkey % 3 = 1 THEN concat('BANK', l_suppkey % 12)
       ELSE concat(' bank ', l_suppkey % 12) END AS Banks,
  CASE WHEN (l_partkey % 20 IN (0, 1, 2)) = (l_returnflag = 'R') THEN 'Payment'
       ELSE 'Receive' END AS _flow,
  CASE WHEN l_partkey % 10 = 3 THEN ' ' END AS Flow,
  CASE WHEN l_partkey % 10 = 5 THEN CAST(year(l_shipdate) AS BIGINT) END AS Source_Year,
  l_shipdate AS Date_of_Transaction,
  CASE WHEN l_partkey % 50 = 0 THEN NULL
       ELSE l_shipdate + (l_partkey % 45 - 3) * INTERVAL '1' DAY END AS Date_of_Submission,
  concat('', l_orderkey) AS Reference_Number,
  substr('{CODES}', 1 + CAST(6 * (l_partkey % 20) AS INT), 6) AS Pur_5,
  CASE WHEN l_partkey % 9 = 0 THEN NULL
       ELSE concat('Purpose ', l_partkey % 20, '/', l_suppkey % 2) END AS Purpose_Name,
  CASE WHEN l_quantity = 1 THEN NULL ELSE n_name END AS Country_Code,
  CASE l_linenumber WHEN 1 THEN 'USD' WHEN 2 THEN 'THB' WHEN 3 THEN 'CNY' WHEN 4 THEN 'LAK'
       WHEN 5 THEN 'EUR' WHEN 6 THEN ' usd' END AS Currency_Code,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL
       WHEN l_partkey % 2 = 0 THEN concat(substr(o_orderpriority, 3), ': note')
       ELSE substr(o_orderpriority, 3) END AS Transfer_Method,
  CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE concat('L', l_partkey % 30) END AS LSIC_Code,
  CASE WHEN l_suppkey % 17 = 0 THEN 'NULL' WHEN l_suppkey % 19 = 0 THEN NULL
       ELSE c_name END AS Transferor_Name,
  CASE WHEN l_partkey % 23 = 0 THEN '0010-0182 6211' WHEN l_partkey % 29 = 0 THEN NULL
       ELSE s_name END AS Recipient_Name,
  CASE WHEN l_partkey % 6 = 0 THEN ' ' ELSE concat('T', o_custkey) END AS Transferor_TIN,
  CASE WHEN l_partkey % 8 = 0 THEN NULL ELSE concat('R', l_suppkey) END AS Recipient_TIN,
  CASE WHEN l_partkey % 10 = 0 THEN '' ELSE 'invoice' END AS Supporting_Documents,
  l_extendedprice AS Amount_Transferred,
  l_extendedprice * 20000e0 AS Amount_Kip,
  CASE WHEN l_partkey % 301 = 0 THEN NULL WHEN l_partkey % 307 = 0 THEN 0e0
       WHEN l_partkey % 311 = 0 THEN -l_extendedprice
       ELSE l_extendedprice * l_quantity END AS Amount_USD,
  CASE WHEN l_partkey % 97 = 0 THEN 680e0
       ELSE CASE l_linenumber WHEN 2 THEN 650e0 WHEN 3 THEN 2900e0 WHEN 4 THEN 1e0
                 WHEN 5 THEN 23000e0 ELSE 21000e0 END * (1e0 + l_discount / 10e0)
       END AS Exchange_Rates_Kip,
  CASE WHEN l_partkey % 401 = 0 THEN NULL WHEN l_partkey % 397 = 0 THEN 900e0
       ELSE 20000e0 + 100e0 * l_quantity END AS Exchange_Rates_USD,
  CASE WHEN l_linestatus = 'O' THEN 'Yes' WHEN l_partkey % 7 = 0 THEN 'FX' ELSE 'No' END AS Use,
  CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_returnflag = 'A' THEN 'No' ELSE 'Yes' END AS M2,
  CASE WHEN l_partkey % 13 = 0 THEN 'No' ELSE 'Yes' END AS Move_Fund,
  concat('file_', year(l_shipdate)) AS Source_File,
  CAST(l_orderkey * 10 + l_linenumber + 10 AS BIGINT) AS row_no
FROM (SELECT *, '' AS copy FROM {{lineitem}}
      UNION ALL
      SELECT *, '-r' AS copy FROM {{lineitem}} WHERE l_orderkey % 5 = 0 AND l_suppkey % 5 = 0) l
JOIN {{orders}} ON o_orderkey = l_orderkey
JOIN {{customer}} ON c_custkey = o_custkey
JOIN {{supplier}} ON s_suppkey = l_suppkey
JOIN {{nation}} ON n_nationkey = s_nationkey
"""

# Shared. Inputs of the declared rules: every condition is met by some rows.
RULE_INPUT = """
SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', l_returnflag,
              l_linestatus) AS id,
  CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS row_no,
  CASE l_suppkey % 7 WHEN 0 THEN 'ICBCV' WHEN 1 THEN 'ICBC' WHEN 2 THEN 'BOC' WHEN 3 THEN 'BCEL'
       WHEN 4 THEN 'OPD' WHEN 5 THEN 'LDB' END AS bank,
  CASE WHEN l_returnflag = 'R' THEN 'Payment' ELSE 'Receive' END AS flow,
  CASE WHEN l_quantity > 25 THEN 'KR' ELSE 'TH' END AS country,
  CASE l_partkey % 23 WHEN 0 THEN '050104' WHEN 1 THEN '050204' WHEN 2 THEN '05020401'
       WHEN 3 THEN '050105' WHEN 4 THEN '05010504' WHEN 5 THEN '050203' WHEN 6 THEN '05020301'
       WHEN 7 THEN '050103' WHEN 8 THEN '05010302' WHEN 9 THEN '07' WHEN 10 THEN '0302010301'
       WHEN 11 THEN '010302' WHEN 12 THEN '050205' WHEN 13 THEN '05020503' WHEN 14 THEN '010107'
       WHEN 15 THEN '050201' WHEN 16 THEN '020101' WHEN 17 THEN '0404' WHEN 18 THEN '030101'
       WHEN 19 THEN '05010502' WHEN 20 THEN '990101' WHEN 21 THEN '050206' END AS purpose,
  CASE l_linenumber WHEN 1 THEN '0201' WHEN 2 THEN '0301' WHEN 3 THEN '01' WHEN 4 THEN '04' END
    AS sector,
  CASE WHEN l_partkey % 5 = 0 THEN 'MoneyGram Intl' WHEN l_partkey % 5 = 1 THEN s_name END AS name,
  CASE l_orderkey % 9 WHEN 0 THEN 'move fund to branch' WHEN 1 THEN 'Clearing house'
       WHEN 2 THEN 'foreign exchange' WHEN 3 THEN 'FORFEITING fee' WHEN 4 THEN 'repay tranche'
       WHEN 5 THEN 'principal due' WHEN 6 THEN 'loan 17' WHEN 7 THEN '' END AS remark,
  l_extendedprice AS amount
FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey
"""

# Shared. Manual corrections for some rows, one per direction and row.
OVERRIDES = """
SELECT flow, row_no, min(CASE WHEN row_no % 2 = 0 THEN '0601' END) AS purpose,
  min(CASE WHEN row_no % 3 = 0 THEN 1e0 END) AS amount
FROM ({rules}) r WHERE row_no % 7 = 0 GROUP BY flow, row_no
"""

# Shared. Bank spellings that need the declared aliases.
ALIAS_INPUT = """
SELECT DISTINCT concat(CASE l_suppkey % 6 WHEN 0 THEN 'Sacom-bank' WHEN 1 THEN 'icbc' WHEN 2 THEN 'A.Y.B'
  WHEN 3 THEN 'AYB VC' WHEN 4 THEN 'ICB ' ELSE concat('bank ', l_suppkey) END,
  CASE WHEN l_partkey % 2 = 0 THEN '.' ELSE '' END) AS spelling FROM {lineitem}
"""

EN_HEADERS = [
    ("Banks", "Bank"), ("Users", "User"), ("Date_of_Transaction", " Date of  Transaction"),
    ("Date_of_Submission", "DATE OF SUBMISSION"), ("Reference_Number", "Reference Number"),
    ("Transferor_Name", "Transferor Name"), ("Recipient_Name", "Recipient Name"),
    ("Purpose_Code", "Purpose Code"), ("Purpose_Name", "Purpose Name"), (None, "Banks"),
    ("Country_Code", "Country Code"), ("Transfer_Method", "Transfer Method"),
    ("Currency_Code", "Currency Code"), ("Amount_Transferred", "Amount Transferred"),
    ("Amount_USD", "Amount USD"), ("Exchange_Rates_Kip", "Exchange Rate Kip"),
    (None, "Branch remarks"), ("Recipient_TIN", "Recipient TIN"),
]
LO_HEADERS = [
    ("Currency_Code", "ລະຫັດສະກຸນເງິນ"), ("Amount_USD", "ຈຳນວນເງິນເປັນໂດລາ"),
    ("Banks", "ທະນາຄານ"), ("Date_of_Submission", "ວັນເດືອນປີ ສົ່ງຂໍ້ມູນ"),
    ("Date_of_Transaction", "ວັນເດືອນປີ  ເຮັດທຸລະກຳ "), ("Users", "ຜູ້ໃຊ້ງານ"),
    ("Purpose_Name", "ຊື່ຈຸດປະສົງ"), ("Purpose_Code", "ລະຫັດຈຸດປະສົງ"),
    ("Transferor_Name", "ຊື່ຜູ້ໂອນ"), ("Recipient_Name", "ຊື່ຜູ້ຮັບ"),
    ("Reference_Number", "ເລກທີ່ໃບອ້າງອີງ"), (None, "ທະນາຄານ"),
    ("Country_Code", "ລະຫັດປະເທດ"), ("Transfer_Method", "ວິທີການໂອນ"),
    ("Amount_Transferred", "ຈຳນວນເງິນທີ່ໂອນ"), ("Exchange_Rates_Kip", "ອັດຕາແລກປ່ຽນເປັນກີບ"),
    (None, "ໝາຍເຫດ"), ("Recipient_TIN", "ເລກປະຈຳຕົວຜູ້ເສຍອາກອນຜູ້ຮັບ"),
]
POSITION_FIELDS = {
    0: "Banks", 2: "Date_of_Transaction", 3: "Date_of_Submission", 4: "Reference_Number",
    6: "Transferor_Name", 12: "Purpose_Code", 13: "Country_Code", 14: "Transfer_Method",
    15: "Currency_Code", 16: "Amount_Transferred", 23: "Confirmed", 24: "Pur_2_Filed",
    25: "Amount_USD", 26: "M2", 27: "Use",
}


def _filed(raw: DataFrame) -> DataFrame:
    """Raw rows as an export would show them, before they become text cells."""
    return raw.withColumns({
        "Purpose_Code": F.trim("Pur_5"),
        "Confirmed": F.concat(F.trim("Pur_5"), F.lit("01")),
        "Pur_2_Filed": F.when(F.col("row_no") % 3 == 0, F.substring("Pur_5", 1, 2)),
        "Users": F.lit("clerk"),
    })


def _cell(field: str | None, plain: bool) -> Column:
    if field is None:
        return F.lit("ignored")
    if field == "Date_of_Transaction":
        # Some dates are filed as free text and make the row undated.
        return F.when(F.col("row_no") % 13 == 0, F.lit("pending")).otherwise(
            F.date_format(field, "yyyy-MM-dd HH:mm:ss")
        )
    if field == "Date_of_Submission":
        return F.date_format(field, "yyyy-MM-dd HH:mm:ss")
    if field in ("Amount_Transferred", "Amount_USD"):
        money = F.format_number(field, 2)
        return F.replace(money, F.lit(","), F.lit("")) if plain else money
    if field == "Exchange_Rates_Kip":
        return F.when(F.col("row_no") % 17 == 0, F.lit("n/a")).otherwise(F.col(field).cast("string"))
    if field in ("Transferor_Name", "Reference_Number") and not plain:
        return F.concat(F.lit("'"), F.col(field))
    return F.col(field)


def _write_csv(rows: DataFrame, path: str, **options) -> None:
    rows.write.options(**options).csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


class Workspace(Build):
    """The build over the test inputs of one driver folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = prepare(spark)
        self.folder = folder
        super().__init__(raw=None, config=Config())
        self.raw = self._raw()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def shared(self, statement: str, **more: DataFrame) -> DataFrame:
        used = {t: self.table(t) for t in TABLES if f"{{{t}}}" in statement}
        return self.spark.sql(statement, **used, **more)

    def _raw(self) -> DataFrame:
        """The rows of ``RAW``, each line moved once, by its order, before its columns are made.

        Orders get their customers first, and a line its copy after the joins. The
        tables meet by inner joins, so the rows are the same.
        """
        sellers, nations = self.table("supplier").select("s_suppkey", "s_name", "s_nationkey"), self.table("nation").select("n_nationkey", "n_name")
        buyers = self.table("customer").select("c_custkey", "c_name")
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(buyers, F.col("c_custkey") == F.col("o_custkey"))
        # One small file is one task, so lines are spread even where orders are broadcast.
        lines = self.table("lineitem").repartition("l_orderkey").join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
        again = (F.col("l_orderkey") % 5 == 0) & (F.col("l_suppkey") % 5 == 0)
        copies = F.when(again, F.array(F.lit(""), F.lit("-r"))).otherwise(F.array(F.lit("")))
        lines = lines.join(sellers, F.col("s_suppkey") == F.col("l_suppkey")).join(nations, F.col("n_nationkey") == F.col("s_nationkey"))
        joined = lines.withColumn("copy", F.explode(copies))
        return self.spark.sql(RAW.partition("\nFROM (")[0] + "\nFROM {joined}", joined=joined)

    @cached_property
    def written(self) -> DataFrame:
        """``raw`` as a table, for extracts that read it several times."""
        return stage(self.raw, "raw")

    @cached_property
    def rules(self) -> DataFrame:
        return self.shared(RULE_INPUT)

    @cached_property
    def overrides(self) -> DataFrame:
        return self.shared(OVERRIDES.replace("({rules})", "{rules}"), rules=self.rules)

    @cached_property
    def root(self) -> str:
        """Extracts in three layouts: without a column, complete, and as CSV."""
        import uuid

        root = f"{shared_dir(self.spark)}/extracts-{uuid.uuid4().hex}"
        year = F.year("Date_of_Transaction")
        for flow in ("Payment", "Receive"):
            # Cells with line breaks, quotes and commas, some of them beyond the border of a record's first line.
            number = F.col("row_no").cast("string")
            note = F.concat(F.lit('paid "in full",\nsee '), number, F.lit('\n\n"'), number, F.lit('"\n, end'))
            rows = self.written.filter(F.col("_flow") == flow).withColumn(
                "Additional_Information", F.when(F.col("row_no") % 3 == 0, note).otherwise(number)
            ).drop("_flow", "row_no")
            early = rows.filter(year <= 1997).drop("Move_Fund").withColumn("M2", F.lit(None).cast("int"))
            early.write.parquet(f"{root}/{flow}/early.parquet")
            rows.filter(year.between(1998, 2000)).write.parquet(f"{root}/{flow}/middle.parquet")
            _write_csv(rows.filter(year > 2000), f"{root}/{flow}/late.csv")
            rows.limit(1).write.json(f"{root}/{flow}/notes.json")
        return root

    @cached_property
    def filed_root(self) -> str:
        """CSV extracts as clerks file them, zipped: some typed cells hold something else.

        Plain text is some seven times the rows as a table. A zipped file is one
        split, so none gets too long; ``root`` has plain files of many splits.
        """
        import uuid

        root = f"{shared_dir(self.spark)}/filed-{uuid.uuid4().hex}"
        number = F.col("row_no")
        day = F.date_format("Date_of_Transaction", "yyyy-MM-dd HH:mm:ss")
        rows = self.written.withColumns({
            "Date_of_Transaction": F.when(number % 13 == 0, "pending").when(number % 29 == 0, "31/02/1998").otherwise(day),
            "Date_of_Submission": F.when(number % 31 == 0, "soon").otherwise(F.col("Date_of_Submission").cast("string")),
            "Amount_USD": F.when(number % 10 == 3, "1,234.50").when(number % 37 == 0, " ").otherwise(F.col("Amount_USD").cast("string")),
            "Exchange_Rates_Kip": F.when(number % 17 == 0, "n/a\n(see note)").otherwise(F.col("Exchange_Rates_Kip").cast("string")),
            "Source_Year": F.when(number % 19 == 0, "FY98").otherwise(F.col("Source_Year").cast("string")),
        })
        for flow in ("Payment", "Receive"):
            mine = rows.filter(F.col("_flow") == flow).drop("_flow")
            _write_csv(mine, f"{root}/{flow}/all.csv", compression="gzip", maxRecordsPerFile=ZIPPED_ROWS)
        return root

    @cached_property
    def replaced(self):
        """The store of all years, 1998 first with half its even rows left out, then 1998 sent again in full."""
        import uuid

        from remitra.plans.yearly import YearStore

        store = YearStore(self.spark, f"{shared_dir(self.spark)}/store-{uuid.uuid4().hex}")
        rows = self.written.withColumns({"Flow": F.col("_flow"), "Source_Year": F.coalesce("Source_Year", F.year("Date_of_Transaction").cast("long"))})
        store.replace(rows.filter("Source_Year <> 1998 OR row_no % 2 = 1"))
        store.replace(rows.filter("Source_Year = 1998"))
        return store.build()

    @cached_property
    def whole_run(self) -> str:
        """Folder of the tables published by one run over both kinds of export: years to 1998 by header, later ones by position."""
        import uuid
        from datetime import date

        from remitra.plans.whole import Exports, import_and_publish
        from remitra.sources.files import direction_of

        out = f"{shared_dir(self.spark)}/whole-{uuid.uuid4().hex}"
        year = F.regexp_extract("file", r"(\d{4})\.xlsx$", 1)
        early = self.cells.filter((year == "") | (year <= "1998"))
        exports = Exports(early, self.book, self.written, date(1999, 1, 1), date(2010, 12, 31), refuse=False)
        import_and_publish(exports, direction_of(F.col("file"), F.col("sheet")), self.config, out, ("month", "ts_line", "banks_with_officers"), self.overrides)
        return out

    @cached_property
    def cells(self) -> DataFrame:
        """Cells of header-matched exports: one file per direction and year, two layouts."""
        rows = _filed(self.written.filter("NOT Hash_ID LIKE '%-r'"))
        layouts = {"Payment": ("out", EN_HEADERS), "Receive": ("in", LO_HEADERS)}
        whole = None
        for flow, (word, headers) in layouts.items():
            mine = rows.filter(F.col("_flow") == flow).withColumns({
                "file": F.concat(
                    F.lit(f"money_transfer_{word}_detail_"), F.year("Date_of_Transaction"), F.lit(".xlsx")
                ),
                "sheet": F.lit("Sheet1"),
            })
            cells = F.array(*[_cell(field, False).cast("string") for field, _ in headers])
            # The last column is cut off where it is empty, as exports do.
            cut = F.when(F.col("Recipient_TIN").isNull(), F.slice(cells, 1, len(headers) - 1))
            data = mine.select("file", "sheet", "row_no", cut.otherwise(cells).alias("cells"))
            files = mine.select("file", "sheet").distinct()
            template = [F.when(F.lit(f == "Banks"), "Format") .when(
                F.lit(f == "Date_of_Transaction"), "2000-01-01 00:00:00").otherwise("x") for f, _ in headers]
            top = [F.array(F.lit("Monthly report")), F.array(*[F.lit(h) for _, h in headers]),
                   F.array(*template)]
            for number, line in enumerate(top, start=1):
                data = data.unionByName(
                    files.select("file", "sheet", F.lit(number).cast("long").alias("row_no"), line.alias("cells"))
                )
            whole = data if whole is None else whole.unionByName(data)
        # A file with five known headers, which must be refused.
        few = rows.filter("row_no % 100 = 11").select(
            F.lit("five_headers.xlsx").alias("file"), F.lit("Sheet1").alias("sheet"), "row_no",
            F.array(*[_cell(f, False).cast("string") for f, _ in EN_HEADERS[:5]]).alias("cells"),
        )
        head = few.select("file", "sheet").distinct().select(
            "file", "sheet", F.lit(2).cast("long").alias("row_no"),
            F.array(*[F.lit(h) for _, h in EN_HEADERS[:5]]).alias("cells"),
        )
        return stage(whole.unionByName(few).unionByName(head), "cells")

    @cached_property
    def book(self) -> DataFrame:
        """Cells of the positional workbook: two sheets of one file."""
        rows = _filed(self.written.filter("NOT Hash_ID LIKE '%-r'"))
        whole = None
        for sheet, flow in (("Recieve", "Receive"), ("Payment", "Payment")):
            party = {8: "Recipient_Name"} if sheet == "Recieve" else {11: "Recipient_Name"}
            fields = {**POSITION_FIELDS, **party, 11 if sheet == "Recieve" else 9: "LSIC_Code"}
            cells = F.array(*[
                _cell(fields[i], True).cast("string") if i in fields else F.lit(None).cast("string")
                for i in range(28)
            ])
            mine = rows.filter(F.col("_flow") == flow).select(
                F.lit("database.xlsm").alias("file"), F.lit(sheet).alias("sheet"), "row_no",
                cells.alias("cells"),
            )
            whole = mine if whole is None else whole.unionByName(mine)
        return stage(whole, "book")

    @cached_property
    def rate_pages(self) -> DataFrame:
        """The web pages, each with a rate table whose numbers follow from the page number."""
        buy = F.lit(14000) + (F.col("page_id") * 137) % 30000
        english = F.col("page_id") % 2 == 1
        number = lambda n: F.when(english, F.format_number(n, 2)).otherwise(
            F.translate(F.format_number(n, 2), ",.", ".,")
        )
        small = lambda t: F.when(english, F.lit(t)).otherwise(F.lit(t.replace(".", ",")))
        row = lambda *cells: F.concat(
            F.lit("<tr class='r'>"),
            *[F.concat(F.lit("<td align=right> "), c, F.lit("</td>\n")) for c in cells], F.lit("</tr>"),
        )
        text = F.lit
        table = F.concat(
            F.lit("<p>2024-03-"), F.format_string("%02d", F.col("page_id").cast("int") % 28 + 1), F.lit("</p>"),
            F.lit("<TABLE border=1>"), row(text("No."), text("<b>BUY</b>"), text("SELL")),
            row(text("1"), text("USD 50-100"), text("US&nbsp;Dollar"), number(buy), number(buy + 100)),
            row(text("2"), text("USD 5-20"), text("US&#xA0;Dollar"), number(buy - 50), number(buy + 150)),
            row(text("3"), text("THB"), text("Thai  Baht"), small("673.20"), small("686.07")),
            # A row number and one rate are two numbers, so they count as buy and sell.
            row(text("4"), text("CNY"), text("Yu&#97;n &#8211; R&eacute;nminbi"), number(F.lit(2900))),
            row(text("EUR"), text("Euro"), number(F.lit(24000))),
            F.lit("</TABLE><table><tr><td>EUR</td><td>1</td><td>2</td></tr></table>"),
        )
        return self.table("pages").select(
            F.col("page_id").cast("string").alias("source"), "url",
            F.when(english, "en").otherwise("eu").alias("style"),
            F.concat(table, F.col("html")).alias("html"),
        )


_open: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, folder: str) -> Workspace:
    """One workspace per session and folder, so that shared tables are written once."""
    key = (spark.conf.get("spark.app.id"), folder)
    if key not in _open:
        _open[key] = Workspace(spark, folder)
    return _open[key]
