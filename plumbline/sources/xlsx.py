"""Workbooks as Excel saves them: tables with their rows, column formulas, totals and defined names, pivot tables with what
slicers and timelines leave of them, and Power Query's queries, read with the standard library. Rows become DataFrames with
types from the values; dates are told by the cells' number formats."""

from __future__ import annotations

import base64
import binascii
import datetime
import io
import posixpath
import re
import struct
import zipfile
from dataclasses import dataclass, field, replace
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

from plumbline.errors import GuardRefused
from plumbline.operators.pivots import Field, Pivot, Value
from plumbline.sources.formulas import FormulaError, parse

#: Built-in number formats that show dates. Fixed values.
_DATES = frozenset([14, 15, 16, 17, 22])
_REF = re.compile(r"([A-Z]+)(\d+)")
_ERRORS = frozenset(["#N/A", "#VALUE!", "#REF!", "#DIV/0!", "#NUM!", "#NAME?", "#NULL!"])
#: Summaries and ways of showing, as pivot tables name them in files. Fixed values.
_SUMMARIES = {"sum": "sum", "count": "count", "countNums": "count numbers", "average": "average", "max": "max", "min": "min", "product": "product", "stdDev": "stddev", "stdDevp": "stddevp", "var": "var", "varp": "varp"}
_SHOWN = {"percentOfTotal": "% of total", "percentOfRow": "% of row", "percentOfCol": "% of column", "runTotal": "running total", "difference": "difference", "percentDiff": "% difference", "percent": "% of", "index": "index", "rankAscending": "rank", "rankDescending": "rank down"}
#: Base items that stand for the previous and the next item. Fixed values.
_NEIGHBOURS = frozenset([1048828, 1048829])


@dataclass
class SheetTable:
    name: str
    columns: list[str]
    rows: list[list]
    formulas: dict[str, str] = field(default_factory=dict)  # of columns
    typed_over: dict[str, list[int]] = field(default_factory=dict)  # rows without the column's formula
    totals: dict[str, str] = field(default_factory=dict)  # function of the Total Row, by column

    def frame(self, spark: SparkSession, key: str | None = None) -> DataFrame:
        """The rows; a column is double, date, boolean or, if its values are of several kinds, string. Errors are NULL.
        key: a column with the row's number, from 0."""
        kinds = []
        for i in range(len(self.columns)):
            seen = {type(r[i]) for r in self.rows if r[i] is not None and r[i] not in _ERRORS}
            kinds.append("double" if seen and seen <= {int, float} else "date" if seen == {datetime.date} else "boolean" if seen == {bool} else "string")
        made = {"double": float, "string": str}
        rows = [tuple(None if v is None or v in _ERRORS else made.get(k, lambda x: x)(v) for v, k in zip(r, kinds, strict=True)) for r in self.rows]
        ddl = ", ".join(f"`{c}` {k}" for c, k in zip(self.columns, kinds, strict=True))
        return spark.createDataFrame(rows, ddl) if key is None else spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"`{key}` long, {ddl}")


@dataclass
class SheetPivot:
    """A pivot table over a table or a range, or why it is not read."""

    name: str
    source: str
    pivot: Pivot | None
    note: str = ""


@dataclass
class Book:
    tables: dict[str, SheetTable]
    names: dict[str, str]
    pivots: dict[str, SheetPivot] = field(default_factory=dict)
    queries: dict[str, str] = field(default_factory=dict)  # of Power Query, by name

    def order(self) -> list[str]:
        """Tables so that each comes after those its formulas read; a loop is refused."""
        from plumbline.operators.lineage import run_order

        reads: dict[str, set[str]] = {}
        for t in self.tables.values():
            found = {c for f in t.formulas.values() for c in _tables(parse(f))}
            reads[t.name] = {x for x in found if x in self.tables and x != t.name}
        return run_order(reads)


def _tables(tree: tuple) -> set[str]:
    own = {tree[1]} if tree[0] in ("cell", "name") and tree[1] else set()
    return own | {n for x in tree[1:] for y in (x if isinstance(x, list) else [x]) if isinstance(y, tuple) and y for n in _tables(y)}


def _bare(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _all(e: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [x for x in e.iter() if _bare(x) == name]


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def read_workbook(source) -> Book:
    """A path or a file of an .xlsx workbook."""
    with zipfile.ZipFile(source) as z:
        names = set(z.namelist())
        if "xl/workbook.xml" not in names:
            raise GuardRefused("this is no .xlsx workbook.")
        xml = lambda n: ElementTree.fromstring(z.read(n))
        shared = ["".join(t.text or "" for t in _all(s, "t")) for s in _all(xml("xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in names else []
        dates: set[int] = set()
        if "xl/styles.xml" in names:
            styles = xml("xl/styles.xml")
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in _all(styles, "numFmt")}
            shown = next((x for x in styles if _bare(x) == "cellXfs"), [])
            dates = {i for i, x in enumerate(shown) if (k := int(x.get("numFmtId", 0))) in _DATES or re.search("[ymd]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(k, "")), re.I)}
        book = xml("xl/workbook.xml")
        defined = {d.get("name"): d.text or "" for d in _all(book, "definedName")}
        tables: dict[str, SheetTable] = {}

        def related(part: str, kind: str) -> list[str]:
            folder, _, name = part.rpartition("/")
            rels = f"{folder}/_rels/{name}.rels"
            found = [r.get("Target") for r in xml(rels) if r.get("Type", "").endswith("/" + kind)] if rels in names else []
            return [t[1:] if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t)) for t in found]

        for sheet in sorted(n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
            if parts := related(sheet, "table"):
                cells, written = _cells(xml(sheet), shared, dates)
                for p in parts:
                    t = _table(xml(p), cells, written)
                    tables[t.name] = t
        pivots = {}
        for part in sorted(n for n in names if re.fullmatch(r"xl/pivotTables/[^/]+\.xml", n)):
            for cache in related(part, "pivotCacheDefinition"):
                made = _pivot(xml(part), _Cache(xml(cache)), [xml(n) for n in sorted(names) if re.match(r"xl/(slicerCaches|timelineCaches)/[^/]+\.xml$", n)])
                pivots[made.name] = made
        queries: dict[str, str] = {}
        for n in sorted(x for x in names if re.fullmatch(r"customXml/item\d+\.xml", x)):
            root = xml(n)
            if _bare(root) == "DataMashup":
                queries |= members(_mashup(root.text or ""))
        return Book(tables, defined, pivots, queries)


def _cells(sheet: ElementTree.Element, shared: list[str], dates: set[int]) -> tuple[dict, set]:
    """Values by (row, column), and where formulas are."""
    values, formulas = {}, set()
    for c in _all(sheet, "c"):
        letters, row = _REF.fullmatch(c.get("r")).groups()
        at = (int(row), _column(letters))
        kind, v, text = c.get("t", "n"), None, next((x.text for x in c if _bare(x) == "v"), None)
        if any(_bare(x) == "f" for x in c):
            formulas.add(at)
        if kind == "inlineStr":
            v = "".join(t.text or "" for t in _all(c, "t"))
        elif text is not None:
            if kind == "s":
                v = shared[int(text)]
            elif kind == "b":
                v = text == "1"
            elif kind in ("str", "e"):
                v = text
            else:
                v = float(text)
                if int(c.get("s", 0)) in dates:
                    v = datetime.date(1899, 12, 30) + datetime.timedelta(days=int(v))
        values[at] = v
    return values, formulas


def _table(part: ElementTree.Element, cells: dict, formulas: set) -> SheetTable:
    (c0, r0), (c1, r1) = [_REF.fullmatch(x).groups() for x in part.get("ref").split(":")]
    first, last, left = int(r0) + int(part.get("headerRowCount", 1)), int(r1) - int(part.get("totalsRowCount", 0)), _column(c0)
    columns = _all(part, "tableColumn")
    out = SheetTable(part.get("displayName") or part.get("name"), [c.get("name") for c in columns], [[cells.get((r, left + i)) for i in range(_column(c1) - left + 1)] for r in range(first, last + 1)])
    for i, c in enumerate(columns):
        f = next((x.text for x in c if _bare(x) == "calculatedColumnFormula"), None)
        if f:
            out.formulas[c.get("name")] = f
            out.typed_over[c.get("name")] = [r - first for r in range(first, last + 1) if (r, left + i) not in formulas]
        if c.get("totalsRowFunction"):
            out.totals[c.get("name")] = c.get("totalsRowFunction")
    return out


def _value(e: ElementTree.Element) -> object:
    """A shared item: text, number, day, truth value, or None for blanks and errors."""
    v = e.get("v")
    match _bare(e):
        case "n":
            return float(v)
        case "b":
            return v in ("1", "true")
        case "d":
            at = datetime.datetime.fromisoformat(v)
            return at if at.time() != datetime.time() else at.date()
        case "m" | "e":
            return None
    return v


def _within(e: ElementTree.Element, *path: str) -> list[ElementTree.Element]:
    """Children of children by name."""
    found = [e]
    for name in path:
        found = [x for f in found for x in f if _bare(x) == name]
    return found


class _Cache:
    """A pivot cache's fields: names, items, groupings, formulas and calculated items."""

    def __init__(self, part: ElementTree.Element):
        source = next(iter(_all(part, "worksheetSource")), None)
        self.source = "" if source is None else source.get("name") or f"{source.get('sheet')}!{source.get('ref')}"
        self.fields = _within(part, "cacheFields", "cacheField")
        self.names = [f.get("name") for f in self.fields]
        self.items = [[_value(x) for s in _within(f, "sharedItems") for x in s] for f in self.fields]
        self.made = _within(part, "calculatedItems", "calculatedItem")

    def group(self, i: int) -> ElementTree.Element | None:
        return next(iter(_within(self.fields[i], "fieldGroup")), None)

    def field(self, i: int) -> Field:
        group = self.group(i)
        if group is None:
            return Field(self.names[i])
        of = int(group.get("base", i))
        column, name = self.names[of], None if of == i else self.names[i]
        for r in _within(group, "rangePr"):
            by = r.get("groupBy", "range")
            if by == "range":
                return Field(column, name, bins=tuple(float(r.get(k, d)) for k, d in (("startNum", 0), ("endNum", 0), ("groupInterval", 1))))
            if by not in ("years", "quarters", "months", "days") or float(r.get("groupInterval", 1)) != 1:
                raise GuardRefused(f"{self.names[i]} is grouped by {by}.")
            return Field(column, name, by)
        called = [_value(x) for g in _within(group, "groupItems") for x in g]
        groups: dict[str, tuple] = {}
        for value, x in zip(self.items[of], _within(group, "discretePr", "x"), strict=True):
            g = called[int(x.get("v"))]
            groups[g] = (*groups.get(g, ()), value)
        return Field(column, name, groups={g: v for g, v in groups.items() if v != (g,)})

    def formula(self, text: str) -> str:
        """A calculated field as SQL over sums."""
        quoted: list[str] = []
        held = re.sub(r"'((?:[^']|'')*)'", lambda m: (quoted.append(m[1].replace("''", "'")), f"quoted_{len(quoted) - 1}_")[1], text)

        def sql(t: tuple) -> str:
            match t:
                case ("num", x):
                    return repr(x)
                case ("name", n):
                    name = quoted[int(m[1])] if (m := re.fullmatch(r"quoted_(\d+)_", n)) else n
                    column = next((c for c in self.names if c.lower() == name.lower()), None)
                    if column is not None:
                        return f"sum_{column}"
                case ("neg", x):
                    return f"(-{sql(x)})"
                case ("op", "/", a, b):
                    return f"try_divide({sql(a)}, {sql(b)})"
                case ("op", "+" | "-" | "*" as sign, a, b):
                    return f"({sql(a)} {sign} {sql(b)})"
            raise GuardRefused(f"the calculated field {text} is not translated.")

        return sql(parse(held))


def _pivot(part: ElementTree.Element, cache: _Cache, controls: list[ElementTree.Element]) -> SheetPivot:
    name = part.get("name")
    try:
        return SheetPivot(name, cache.source, _read_pivot(part, cache, controls))
    except (GuardRefused, FormulaError) as e:
        return SheetPivot(name, cache.source, None, str(e))


def _read_pivot(part: ElementTree.Element, cache: _Cache, controls: list[ElementTree.Element]) -> Pivot:
    fields = _within(part, "pivotFields", "pivotField")
    rows, columns = ([cache.field(int(f.get("x"))) for f in _within(part, side, "field") if int(f.get("x")) >= 0] for side in ("rowFields", "colFields"))

    def item(i: int, k: int) -> object:
        """The k-th item of a pivot field, as the cache's value."""
        return cache.items[i][int(_within(fields[i], "items", "item")[k].get("x"))]

    def plain(i: int) -> str:
        if cache.group(i) is not None:
            raise GuardRefused(f"{cache.names[i]} is filtered and grouped; only filters of ungrouped fields are read.")
        return cache.names[i]

    values = []
    for d in _within(part, "dataFields", "dataField"):
        i = int(d.get("fld"))
        shown = next((x.get("pivotShowAs") for x in d.iter() if x.get("pivotShowAs")), None) or d.get("showDataAs", "normal")
        v = Value(d.get("name"), cache.names[i], _SUMMARIES[d.get("subtotal", "sum")])
        if text := cache.fields[i].get("formula"):
            v = replace(v, column=None, formula=cache.formula(text))
        if shown != "normal":
            if shown not in _SHOWN:
                raise GuardRefused(f"{v.name} is shown as {shown}.")
            v = replace(v, show=_SHOWN[shown])
            if v.show in ("running total", "rank", "rank down", "difference", "% difference", "% of"):
                b = int(d.get("baseField"))
                v = replace(v, base=cache.field(b).output)
                if v.show in ("difference", "% difference", "% of"):
                    k = int(d.get("baseItem"))
                    if k in _NEIGHBOURS:
                        raise GuardRefused(f"{v.name} is compared with the previous or the next item.")
                    v = replace(v, item=item(b, k))
        values.append(v)
    keep: dict[str, tuple] = {}
    drop: dict[str, tuple] = {}
    between: dict[str, tuple] = {}
    top = None
    chosen = {int(f.get("fld")): int(f.get("item")) for f in _within(part, "pageFields", "pageField") if f.get("item")}
    for i, f in enumerate(fields):
        hidden = tuple(cache.items[i][int(x.get("x"))] if cache.group(i) is None else x for x in _within(f, "items", "item") if x.get("h") == "1" and x.get("x"))
        if i in chosen:
            keep[plain(i)] = (item(i, chosen[i]),)
        elif hidden:
            drop[plain(i)] = hidden
    for f in _within(part, "filters", "filter"):
        best = next(iter(_all(f, "top10")), None)
        if best is None or f.get("type") != "count" or not f.get("iMeasureFld") or best.get("percent") == "1":
            raise GuardRefused(f"a filter of the kind {f.get('type')} is not read.")
        by = values[int(f.get("iMeasureFld"))]
        if by.how != "sum" or by.formula or by.show or top:
            raise GuardRefused("the top items are read by one sum only.")
        top = (plain(int(f.get("fld"))), int(float(best.get("val"))) * (-1 if best.get("top") == "0" else 1), by.column)
    for c in controls:
        if part.get("name") not in {p.get("name") for p in _within(c, "pivotTables", "pivotTable")} or c.get("sourceName") not in cache.names:
            continue
        i = cache.names.index(c.get("sourceName"))
        marks = _within(c, "data", "tabular", "items", "i")
        if any(m.get("s") != "1" for m in marks):
            keep[plain(i)] = tuple(v for m in marks if m.get("s") == "1" for v in [cache.items[i][int(m.get("x"))]] if plain(i) not in keep or v in keep[plain(i)])
        for s in _within(c, "state", "selection"):
            between[cache.names[i]] = tuple(datetime.datetime.fromisoformat(s.get(k)).date() for k in ("startDate", "endDate"))
    items: dict[str, dict[str, str]] = {}
    for m in cache.made:
        for r in _all(m, "reference"):
            i = int(r.get("field"))
            for x in _within(r, "x"):
                items.setdefault(cache.field(i).output, {})[cache.items[i][int(x.get("v"))]] = m.get("formula")
    return Pivot(tuple(rows), tuple(columns), tuple(values), keep, drop, between, top, items)


def _mashup(text: str) -> str:
    """The queries' source from the package that a workbook holds: version, length, then a zip archive."""
    try:
        data = base64.b64decode("".join(text.split()), validate=True)
        version, size = struct.unpack_from("<II", data)
        with zipfile.ZipFile(io.BytesIO(data[8 : 8 + size])) as z:
            return z.read("Formulas/Section1.m").decode("utf-8-sig")
    except (binascii.Error, struct.error, zipfile.BadZipFile, KeyError, UnicodeDecodeError) as e:
        raise GuardRefused(f"the workbook's queries cannot be read: {e}.") from e


_PIECE = re.compile(r'#?"(?:[^"]|"")*"|//[^\r\n]*|/\*.*?\*/|.', re.S)
_MEMBER = re.compile(r'\s*(?:\[.*?\]\s*)?(?:shared\s+)?(#"(?:[^"]|"")*"|[^\W\d][\w.]*)\s*=(.*)', re.S)


def members(text: str) -> dict[str, str]:
    """The named expressions of a section."""
    parts, depth = [""], 0
    for m in _PIECE.finditer(text):
        x = m[0]
        if x.startswith(("//", "/*")):
            x = " "
        depth += (x in "([{") - (x in ")]}")
        if x == ";" and not depth:
            parts.append("")
        else:
            parts[-1] += x
    found = (_MEMBER.fullmatch(p) for p in parts)
    return {(n[2:-1].replace('""', '"') if (n := m[1]).startswith("#") else n): m[2].strip() for m in found if m}
