"""SQL scripts: split, classified, ordered by what they read and write, folded, and run."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.errors import GuardRefused

_PIECE = re.compile(r"""--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|;|[^;'"`/-]+|.""", re.S)
_TAG = re.compile(r"""['"]?<PARM="([^"]+)"\s*/>['"]?""")
_CTE = re.compile(r"(?:\bWITH|,)\s+(\w+)\s+AS\s*\(", re.I)


def split_statements(text: str) -> list[str]:
    """Statements between semicolons that are outside quotes and comments."""
    out, held = [], []
    for m in _PIECE.finditer(text):
        if m[0] == ";":
            out.append("".join(held))
            held = []
        else:
            held.append(m[0])
    out.append("".join(held))
    return [s.strip() for s in out if _bare(s).strip()]


def _bare(text: str) -> str:
    """Without comments."""
    return "".join("" if m[0].startswith(("--", "/*")) and len(m[0]) > 1 else m[0] for m in _PIECE.finditer(text))


def _masked(text: str) -> tuple[str, list[str]]:
    """Without comments, and with texts as marks that hold no letters of names; and the texts."""
    out, texts = [], []
    for m in _PIECE.finditer(_bare(text)):
        if m[0][0] in "'\"":
            out.append(f"\x00{len(texts)}\x00")
            texts.append(m[0])
        else:
            out.append(m[0])
    return "".join(out).strip(), texts


def _unmasked(text: str, texts: list[str]) -> str:
    return re.sub("\x00(\\d+)\x00", lambda m: texts[int(m[1])], text)


def _name(text: str) -> str:
    return text.replace("`", "").lower()


@dataclass(frozen=True)
class Part:
    text: str
    kind: str  # create_as, create, insert, set, query, drop or other
    writes: str | None
    reads: frozenset[str]
    temporary: bool = False
    targets: tuple[str, ...] = ()  # every table that is written: an INSERT from one FROM may write several


_CREATE = re.compile(r"CREATE\s+(?:OR\s+REPLACE\s+)?((?:GLOBAL\s+)?TEMP(?:ORARY)?\s+)?(?:EXTERNAL\s+)?(?:TABLE|VIEW)\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.`]+)", re.I)
_AS = re.compile(r"\bAS\s*(?=\(?\s*(?:SELECT|WITH)\b)", re.I)
_INSERT = re.compile(r"\bINSERT\s+(INTO|OVERWRITE)\s+(?!(?:LOCAL\s+)?DIRECTORY\b)(?:TABLE\s+)?([\w.`]+)(?:\s+PARTITION\s*\(([^()]*)\))?(?:\s+IF\s+NOT\s+EXISTS)?(?:\s*\(([^()]*)\)(?=\s*(?:SELECT|WITH|VALUES|FROM|\()))?", re.I)
_DROP = re.compile(r"DROP\s+(?:TABLE|VIEW)\s+(?:IF\s+EXISTS\s+)?([\w.`]+)\s*(?:PURGE)?$", re.I)


def classify(text: str) -> Part:
    bare, _ = _masked(text)
    kind, writes, temporary, targets = "other", None, False, ()
    if m := _CREATE.match(bare):
        kind = "create_as" if _AS.search(bare) else "create"
        writes, temporary = m[2], bool(m[1])
    elif found := _INSERT.findall(bare):
        kind, writes, targets = "insert", found[0][1], tuple(_name(x[1]) for x in found)
    elif m := _DROP.match(bare):
        kind, targets = "drop", (_name(m[1]),)
    elif re.match(r"SET\b", bare, re.I):
        kind = "set"
    elif re.match(r"(SELECT|WITH|FROM|VALUES|\()", bare, re.I):
        kind = "query"
    own = {x.lower() for x in _CTE.findall(bare)}
    found = (_name(x) for x in re.findall(r"\b(?:FROM|JOIN)\s+([\w.`]+)", bare, re.I))
    writes = writes and _name(writes)
    return Part(text, kind, writes, frozenset(x for x in found if x not in own), temporary, targets or ((writes,) if writes else ()))


def in_order(parts: Iterable[Part]) -> list[Part]:
    """Readers after writers, otherwise as given; a loop is refused. Where a table is written before and after its reader,
    the reader means what was written before."""
    parts = list(parts)
    writers: dict[str, list[int]] = {}
    for i, p in enumerate(parts):
        for t in p.targets if p.kind != "drop" else ():
            writers.setdefault(t, []).append(i)
    out, state = [], {}

    def visit(i: int, path: tuple[int, ...]) -> None:
        if state.get(i) == 2:
            return
        if state.get(i) == 1:
            raise GuardRefused("the statements read each other in a loop: " + ", ".join(parts[k].writes or "?" for k in path[path.index(i) :]))
        state[i] = 1
        for t in sorted(parts[i].reads):
            earlier = [k for k in writers.get(t, ()) if k < i]
            for k in earlier or writers.get(t, ()):
                if k != i:
                    visit(k, (*path, i))
        for t in parts[i].targets:
            for k in writers.get(t, ()):  # a table is created before it is filled, and filled before it is dropped
                if k < i:
                    visit(k, (*path, i))
        state[i] = 2
        out.append(parts[i])

    for i in range(len(parts)):
        visit(i, ())
    return out


def fill_tags(text: str, values: Mapping[str, object]) -> tuple[str, dict]:
    """Script tags <PARM="X"/> as named parameters, for spark.sql(text, args)."""
    used: dict = {}

    def one(m: re.Match) -> str:
        if m[1] not in values:
            raise GuardRefused(f"the script tag {m[1]} has no value.")
        used[m[1]] = values[m[1]]
        return f":{m[1]}"

    return _TAG.sub(one, text), used


#: Words that may follow a table in FROM and are no name for it. Fixed words of the dialect.
_AFTER = "AS|ON|USING|WHERE|GROUP|HAVING|ORDER|LIMIT|JOIN|INNER|LEFT|RIGHT|FULL|CROSS|SEMI|ANTI|NATURAL|UNION|INTERSECT|EXCEPT|MINUS|LATERAL|TABLESAMPLE|CLUSTER|DISTRIBUTE|SORT|WINDOW|INSERT|SELECT|PIVOT|UNPIVOT|QUALIFY"


class Batch:
    """A script's tables as frames, by name, while it runs; nothing outside the session is written."""

    def __init__(self, spark: SparkSession, tags: Mapping[str, object]):
        self.spark, self.tags = spark, tags
        self.tables: dict[str, DataFrame] = {}
        self.queries: dict[str, DataFrame] = {}

    @staticmethod
    def view(name: str) -> str:
        return name.replace(".", "__")

    def keep(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df
        df.createOrReplaceTempView(self.view(name))

    def sql(self, masked: str, texts: list[str]) -> DataFrame:
        """Runs a query; the script's tables with a database in their names are read by their views."""
        for name in sorted((n for n in self.tables if "." in n), key=len, reverse=True):
            part = r"\s*\.\s*".join(f"`?{re.escape(x)}`?" for x in name.split("."))
            short = name.rsplit(".", 1)[1]
            masked = re.sub(rf"(?<![\w.`]){part}\s*\.\s*(?=[\w`])", f"{short}.", masked, flags=re.I)
            masked = re.sub(rf"(?<![\w.`]){part}(?![\w.`(])(?!\s+AS\b)(?=(\s+(?!(?:{_AFTER})\b)[A-Za-z_`])?)", lambda m, n=name, s=short: self.view(n) + ("" if m[1] else f" AS {s}"), masked, flags=re.I)
            masked = re.sub(rf"(?<![\w.`]){part}(?![\w.`(])(?=\s+AS\b)", self.view(name), masked, flags=re.I)
        text, args = fill_tags(_unmasked(masked, texts), self.tags)
        return self.spark.sql(text.strip().removesuffix(";"), args=args or None)

    def known(self, name: str) -> DataFrame | None:
        """A target as it is so far: of the script, or the catalog's."""
        if name in self.tables:
            return self.tables[name]
        return self.spark.table(name) if self.spark.catalog.tableExists(name) else None

    def create(self, p: Part, masked: str, texts: list[str]) -> None:
        if m := re.search(r"\bLIKE\s+([\w.`]+)\s*$", masked, re.I):
            like = self.known(_name(m[1]))
            if like is None:
                raise GuardRefused(f"{p.writes} is to be like {m[1]}, which is not known.")
            return self.keep(p.writes, like.limit(0))
        rest = masked[_CREATE.match(masked).end() :]
        columns = _within(rest)
        if columns is None:
            raise GuardRefused(f"{p.writes} is created without columns.")
        parts = [columns]
        if m := re.search(r"\bPARTITIONED\s+BY\s*", rest, re.I):
            by = _within(rest[m.end() :])
            if by and re.match(r"\s*`?\w+`?\s+\w", by):
                parts.append(by)
        if p.writes not in self.tables or not re.search(r"\bIF\s+NOT\s+EXISTS\b", masked, re.I):
            self.keep(p.writes, self.spark.createDataFrame([], _unmasked(", ".join(parts), texts)))

    def insert(self, masked: str, texts: list[str]) -> None:
        found = list(_INSERT.finditer(masked))
        prefix = masked[: found[0].start()]
        ends = [m.start() for m in found[1:]] + [len(masked)]
        # Every branch reads the tables as they are before the statement.
        made = [(m, self.sql(prefix + " " + masked[m.end() : end], texts)) for m, end in zip(found, ends, strict=True)]
        for m, df in made:
            self.write(_name(m[2]), m[1].upper() == "OVERWRITE", m[3], m[4], df, texts)

    def write(self, name: str, overwrite: bool, partition: str | None, listed: str | None, df: DataFrame, texts: list[str]) -> None:
        """Rows into a table, by position or by the columns listed. OVERWRITE replaces the table, the named partition, or
        the partitions that the rows fill."""
        old = self.known(name)
        spec = [x.strip() for x in (partition or "").split(",") if x.strip()]
        fixed = {_name(k.strip()): fill_tags(_unmasked(v.strip(), texts), self.tags) for k, eq, v in (x.partition("=") for x in spec) if eq}
        moving = [_name(x) for x in spec if "=" not in x]
        columns = [c.lower() for c in old.columns] if old is not None else None
        if listed:
            names = [_name(x.strip()) for x in listed.split(",")]
        elif columns is not None:
            names = [c for c in columns if c not in fixed and c not in moving] + moving
        else:
            names = [c.lower() for c in df.columns]
        if len(names) != len(df.columns):
            raise GuardRefused(f"INSERT gives {len(df.columns)} columns for {len(names)} of {name}: {', '.join(names)}.")
        df = df.toDF(*names)
        for k, (v, args) in fixed.items():
            value = self.spark.sql(f"SELECT {v} AS v", args=args or None).first()[0]
            df = df.withColumn(k, F.lit(value))
        if columns is not None:
            if extra := [c for c in df.columns if c not in columns]:
                raise GuardRefused(f"{name} has no column {', '.join(extra)}.")
            types = {c.lower(): t for c, t in old.dtypes}
            df = df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(types[c]).alias(c) for c in columns])
            old = old.toDF(*columns)
            if not overwrite:
                df = old.unionByName(df)
            elif moving:
                keys = [*fixed, *moving]
                filled = df.select(*[F.col(f"`{k}`").alias(f"__{k}") for k in keys]).distinct()
                on = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"__{k}")) for k in keys])
                df = old.join(filled, on, "left_anti").unionByName(df)
            elif fixed:
                there = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.expr(v)) for k, (v, _) in fixed.items()])
                df = old.where(~there).unionByName(df)
        self.keep(name, df)

    def run(self, p: Part) -> None:
        masked, texts = _masked(p.text)
        match p.kind:
            case "create_as":
                self.keep(p.writes, self.sql(masked[_AS.search(masked).end() :], texts))
            case "create":
                self.create(p, masked, texts)
            case "insert":
                self.insert(masked, texts)
            case "query":
                self.queries[f"query_{len(self.queries) + 1}"] = self.sql(masked, texts)
            case "set":
                self.spark.sql(_unmasked(masked, texts))
            case "drop" if p.targets[0] in self.tables:
                self.spark.catalog.dropTempView(self.view(p.targets[0]))
                del self.tables[p.targets[0]]
            case "drop" if re.search(r"\bIF\s+EXISTS\b", masked, re.I) and not self.spark.catalog.tableExists(p.targets[0]):
                pass
            case _:
                raise GuardRefused(f"a script may not run {' '.join(masked.split()[:3])}.", "it changes what is outside the script.", "run it by itself with unchecked_sql()")


def _within(text: str) -> str | None:
    """What the first brackets hold, if the text begins with them."""
    text = text.lstrip()
    if not text.startswith("("):
        return None
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if not depth:
            return text[1:i]
    return None


def run_batch(spark: SparkSession, text: str, tags: Mapping[str, object] | None = None) -> dict[str, DataFrame]:
    """Runs a script in the order its tables need; its tables are frames, which Catalyst folds into their readers.

    INSERT INTO appends and INSERT OVERWRITE replaces the table or the partitions, by position or by listed columns, from
    one FROM into several tables too. A statement that would change what is outside the script is refused. Returns the
    frames by table, and queries as query_1 and so on.
    """
    batch = Batch(spark, tags or {})
    for p in in_order(map(classify, split_statements(text))):
        batch.run(p)
    return batch.tables | batch.queries
