"""A small workbook, written here, read back and calculated."""

import datetime
import io
import zipfile

import pytest

from plumbline.errors import GuardRefused
from plumbline.functions.values import date_text, run_value, tag_text, traced, variable
from plumbline.operators.workbooks import Workbook
from plumbline.sources.xlsx import read_workbook

SHEET = """<worksheet xmlns="x"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>day</t></is></c><c r="D1" t="str"><v>hours</v></c></row>
<row r="2"><c r="A2"><v>1</v></c><c r="B2"><v>90</v></c><c r="C2" s="1"><v>45292</v></c><c r="D2"><f>B2/60</f><v>1.5</v></c></row>
<row r="3"><c r="A3"><v>2</v></c><c r="B3" t="e"><v>#N/A</v></c><c r="C3" s="1"><v>45293</v></c><c r="D3"><v>9</v></c></row>
<row r="4"><c r="A4"><v>3</v></c></row></sheetData></worksheet>"""
TABLE = """<table xmlns="x" name="runs" displayName="runs" ref="A1:D4" totalsRowCount="1"><tableColumns count="4"><tableColumn id="1" name="id" totalsRowFunction="sum"/>
<tableColumn id="2" name="mins"/><tableColumn id="3" name="day"/><tableColumn id="4" name="hours"><calculatedColumnFormula>runs[[#This Row],[mins]]/60</calculatedColumnFormula></tableColumn></tableColumns></table>"""


def workbook():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="x"><definedNames><definedName name="rate">0.5</definedName></definedNames></workbook>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="x"><si><t>id</t></si><si><r><t>mi</t></r><r><t>ns</t></r></si></sst>')
        z.writestr("xl/styles.xml", '<styleSheet xmlns="x"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", SHEET)
        z.writestr("xl/worksheets/_rels/sheet1.xml.rels", '<Relationships xmlns="r"><Relationship Id="a" Type="http://x/table" Target="../tables/table1.xml"/></Relationships>')
        z.writestr("xl/tables/table1.xml", TABLE)
    out.seek(0)
    return out


def test_workbook(spark):
    book = read_workbook(workbook())
    t = book.tables["runs"]
    assert t.columns == ["id", "mins", "day", "hours"] and t.totals == {"id": "sum"} and book.names == {"rate": "0.5"} and book.order() == ["runs"]
    assert t.typed_over == {"hours": [1]}
    rows = t.frame(spark).collect()
    assert [tuple(r) for r in rows] == [(1.0, 90.0, datetime.date(2024, 1, 1), 1.5), (2.0, None, datetime.date(2024, 1, 2), 9.0)]
    made = Workbook({"runs": t.frame(spark)}, {"runs": ["id"]}).typed_over("runs", "hours", t.formulas["hours"], {2.0: 9.0})
    assert [r.hours for r in made.orderBy("id").collect()] == [1.5, 9.0]


def test_no_workbook():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x", "y")
    with pytest.raises(GuardRefused):
        read_workbook(out)


def test_values():
    assert run_value(max, 1, 2).args == (2,) and traced()[-1] == ("max", 2)
    assert variable("day", default="a", values={"day": "b"}).args == ("b",) and variable("day", default="a").args == ("a",)
    assert date_text("2024-01-02") == "'2024-01-02'" and tag_text("it's") == r"'it\'s'" and tag_text(5, quoted=False) == "5"
    with pytest.raises(GuardRefused):
        variable("a b", default=1)


CACHE = """<pivotCacheDefinition xmlns="x"><cacheSource type="worksheet"><worksheetSource name="sales"/></cacheSource><cacheFields>
<cacheField name="shop"><sharedItems><s v="a"/><s v="b"/><s v="c"/><m/></sharedItems></cacheField>
<cacheField name="day"><sharedItems><d v="2024-01-01T00:00:00"/></sharedItems><fieldGroup par="4" base="1"><rangePr groupBy="months"/></fieldGroup></cacheField>
<cacheField name="price"><sharedItems/></cacheField><cacheField name="the count"><sharedItems/></cacheField>
<cacheField name="Years" databaseField="0"><fieldGroup base="1"><rangePr groupBy="years"/></fieldGroup></cacheField>
<cacheField name="each" formula="price/'the count' -1" databaseField="0"/>
<cacheField name="kind"><sharedItems><s v="x"/><s v="y"/><s v="z"/></sharedItems></cacheField>
<cacheField name="kinds" databaseField="0"><fieldGroup base="6"><discretePr><x v="0"/><x v="0"/><x v="1"/></discretePr><groupItems><s v="xy"/><s v="z"/></groupItems></fieldGroup></cacheField>
</cacheFields></pivotCacheDefinition>"""
FIELDS = '<pivotFields><pivotField><items><item x="0"/><item x="1"/><item x="2" h="1"/><item x="3"/></items></pivotField>' + "<pivotField/>" * 5 + '<pivotField><items><item x="0"/><item x="1"/><item x="2"/></items></pivotField><pivotField/></pivotFields>'
PIVOT = f"""<pivotTableDefinition xmlns="x" name="by shop" cacheId="1">{FIELDS}<rowFields><field x="0"/><field x="4"/><field x="-2"/></rowFields><colFields><field x="7"/></colFields>
<dataFields><dataField name="total" fld="2"/><dataField name="rows" fld="2" subtotal="count"/><dataField name="each one" fld="5"/></dataFields></pivotTableDefinition>"""
SHOWN = f"""<pivotTableDefinition xmlns="x" name="shares" cacheId="1">{FIELDS.replace(' h="1"', "")}<rowFields><field x="0"/></rowFields>
<dataFields><dataField name="share" fld="2" showDataAs="percentOfTotal"/><dataField name="less a" fld="2" showDataAs="difference" baseField="0" baseItem="0"/></dataFields></pivotTableDefinition>"""
BEST = f"""<pivotTableDefinition xmlns="x" name="best" cacheId="1">{FIELDS.replace(' h="1"', "")}<rowFields><field x="0"/></rowFields><pageFields><pageField fld="6" item="1"/></pageFields>
<dataFields><dataField name="total" fld="2"/></dataFields><filters><filter fld="0" type="count" iMeasureFld="0"><autoFilter><filterColumn><top10 val="1" top="1"/></filterColumn></autoFilter></filter></filters></pivotTableDefinition>"""
SLICER = '<slicerCacheDefinition xmlns="x" sourceName="kind"><pivotTables><pivotTable name="by shop"/></pivotTables><data><tabular><items><i x="0" s="1"/><i x="2" s="1"/><i x="1"/></items></tabular></data></slicerCacheDefinition>'
TIMELINE = '<timelineCacheDefinition xmlns="x" sourceName="day"><pivotTables><pivotTable name="by shop"/></pivotTables><state><selection startDate="2024-01-01T00:00:00" endDate="2025-06-30T00:00:00"/></state></timelineCacheDefinition>'
SECTION = 'section Section1;\n[Note="a;b"] shared Big = let // one; two\n A = Table.SelectRows(runs, each [t] <> "a;b") in A;\nshared #"The ""best""" = let B = Table.SelectRows(Big, each [v] > 1) in B;'


def with_pivots(bad=""):
    import base64
    import struct

    package, out = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(package, "w") as z:
        z.writestr("Formulas/Section1.m", SECTION)
    mashup = base64.b64encode(struct.pack("<II", 0, len(package.getvalue())) + package.getvalue() + b"rest").decode()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="x"/>')
        for i, part in enumerate((PIVOT, SHOWN, BEST, SHOWN.replace('name="shares"', 'name="odd"').replace('baseItem="0"', 'baseItem="1048828"'))):
            z.writestr(f"xl/pivotTables/pivotTable{i}.xml", part)
            z.writestr(f"xl/pivotTables/_rels/pivotTable{i}.xml.rels", '<Relationships xmlns="r"><Relationship Type="http://x/pivotCacheDefinition" Target="../pivotCache/pivotCacheDefinition1.xml"/></Relationships>')
        z.writestr("xl/pivotCache/pivotCacheDefinition1.xml", CACHE)
        z.writestr("xl/slicerCaches/slicerCache1.xml", SLICER)
        z.writestr("xl/timelineCaches/timelineCache1.xml", TIMELINE)
        z.writestr("customXml/item1.xml", f'<?xml version="1.0" encoding="utf-16"?><DataMashup xmlns="q">{bad or mashup}</DataMashup>'.encode("utf-16"))
    out.seek(0)
    return out


def test_pivots_and_queries_of_a_workbook(spark):
    from plumbline.operators.power_query import PowerQuery

    book = read_workbook(with_pivots())
    day = datetime.date
    sales = spark.createDataFrame([("a", day(2024, 1, 5), 10.0, 2.0, "x"), ("a", day(2024, 2, 5), 5.0, 1.0, "z"), ("a", day(2025, 7, 1), 99.0, 1.0, "x"), ("b", day(2025, 6, 30), 7.0, 0.0, "x"), ("c", day(2024, 1, 1), 1.0, 1.0, "x"), (None, day(2024, 1, 1), 3.0, 2.0, "z"), ("b", day(2024, 1, 1), 50.0, 2.0, "y")], "shop string, day date, price double, `the count` double, kind string")
    assert {n: (p.source, p.pivot is None) for n, p in book.pivots.items()} == {"by shop": ("sales", False), "shares": ("sales", False), "best": ("sales", False), "odd": ("sales", True)}
    assert "previous" in book.pivots["odd"].note
    got = book.pivots["by shop"].pivot.lower(sales)
    assert got.columns == ["shop", "Years", "kinds", "total", "rows", "each one"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("a", 2024, "xy", 10.0, 1, 4.0), ("a", 2024, "z", 5.0, 1, 4.0), ("b", 2025, "xy", 7.0, 1, None), (None, 2024, "z", 3.0, 1, 0.5)], key=repr)
    shares = {r.shop: (r.share, r["less a"]) for r in book.pivots["shares"].pivot.lower(sales).collect()}
    assert shares["b"] == (pytest.approx(57 / 175), 57.0 - 114.0) and shares["a"][1] == 0
    assert list(map(tuple, book.pivots["best"].pivot.lower(sales).collect())) == [("b", 50.0)]
    assert list(book.queries) == ["Big", 'The "best"']
    runs = spark.createDataFrame([("a;b", 9), ("c", 1), ("d", 2)], "t string, v int")
    assert [r.t for r in PowerQuery({"runs": runs}, book.queries).run(book.queries['The "best"']).collect()] == ["d"]
    for bad in ("????", "AAAA"):
        with pytest.raises(GuardRefused, match="queries"):
            read_workbook(with_pivots(bad))
