"""Run a registered query and its SQL twin and compare them row for row."""

from __future__ import annotations

import glob
import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def oracle(sf: str = SF):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf: str = SF) -> tuple[bool, str]:
    got = fn(spark, sf)
    rows = [tuple(r) for r in got.collect()]
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    if sorted(names) != sorted(got.columns):
        return False, f"columns {sorted(got.columns)} != {sorted(names)}"
    want = _rows(expected.fetchall(), names)
    have = _rows(rows, got.columns)
    types = dict(zip(names, [str(d[1]) for d in con.execute(sql).description]))
    kinds = {f.name: f.dataType.simpleString() for f in got.schema.fields}
    notes = _type_notes(kinds, types)
    if have != want:
        wants, haves = set(want), set(have)
        only_have = [r for r in have if r not in wants][:3]
        only_want = [r for r in want if r not in haves][:3]
        return False, f"{len(have)} vs {len(want)} rows; spark {only_have} sql {only_want} {notes}"
    return not notes, f"{len(have)} rows {notes}"


FAMILIES = {
    "bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "string": {"VARCHAR"},
    "boolean": {"BOOLEAN"},
}


def _type_notes(kinds, types) -> str:
    bad = [
        f"{n}:{k}/{types[n]}" for n, k in kinds.items()
        if types[n].upper() not in FAMILIES.get(k, {types[n].upper()})
    ]
    return f"types {bad}" if bad else ""
