"""Text sources and sinks of tables: JSON dumps, YAML or JSON objects, aligned text tables."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterable, Iterator
from typing import Any, TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T




def plain(value: Any) -> Any:
    """A value as JSON knows it; what can't be shown becomes a text that says so."""
    try:
        if hasattr(value, "asDict"):
            value = value.asDict()
        if isinstance(value, dict):
            return {str(k): plain(v) for k, v in value.items()}
        if isinstance(value, (list, tuple)):
            return [plain(v) for v in value]
        if isinstance(value, (bytes, bytearray)):
            return base64.b64encode(value).decode()
        json.dumps(value)
        return value
    except (TypeError, ValueError):
        return str(value)


def objects(table, frame: DataFrame) -> Iterator[dict]:
    for r in frame.toLocalIterator():
        yield {c: r[c] for c in table.spec.columns}


def write_json(reader, out: TextIO, tables: Iterable | None = None) -> None:
    """One object: table name to its objects in order of primary key, tables in order of registration."""
    out.write("{\n")
    for k, t in enumerate(tables if tables is not None else reader.engine.tables()):
        out.write(("," if k else "") + f"  {json.dumps(t.name)}: [\n")
        for n, obj in enumerate(objects(t, reader.all(t))):
            out.write(("    ," if n else "    ") + safe_json(obj) + "\n")
        out.write("  ]\n")
    out.write("}\n")


def safe_json(obj: Any) -> str:
    """JSON of an object; a failing serializer gives a text with its error in the object's place."""
    try:
        own = getattr(obj, "to_json", None)
        return own() if own else json.dumps(plain(obj))
    except Exception as e:  # the dump goes on
        return json.dumps(f"marshalling failed: {e}")


def json_rows(table, frame: DataFrame) -> DataFrame:
    """A JSON text for each row, for dumps that are too large for the driver."""
    return frame.select(F.to_json(F.struct(*table.spec.columns)).alias("json"))


def parse_scalar(text: str) -> Any:
    text = text.strip()
    if text[:1] in "\"[{":
        return json.loads(text)
    if text[:1] == "'" and text[-1:] == "'":
        return text[1:-1].replace("''", "'")
    if text in ("", "~", "null"):
        return None
    if text in ("true", "false"):
        return text == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse_yaml(text: str) -> dict:
    """An object of the flat kind that the shell reads: scalars, lists and maps one level deep, JSON values. Full YAML where a library for it is installed."""
    try:
        import yaml

        return yaml.safe_load(text)
    except ImportError:
        pass
    out: dict[str, Any] = {}
    key = None
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if key is not None and (m := re.match(r"\s*- (.*)$", line)):
            if not isinstance(out[key], list):
                out[key] = []
            out[key].append(parse_scalar(m[1]))
        elif key is not None and (m := re.match(r"\s+([\w.-]+):\s*(.*)$", line)):
            if not isinstance(out[key], dict):
                out[key] = {}
            out[key][m[1]] = parse_scalar(m[2])
        elif m := re.match(r"([\w.-]+):\s*(.*)$", line):
            key = m[1]
            out[key] = parse_scalar(m[2])
        else:
            raise ValueError(f"can't read the line {line!r}")
    return out


def coerce(schema: T.StructType, obj: dict) -> dict:
    """An object's values in the table's types; unknown fields raise."""
    known = {f.name.lower(): f for f in schema.fields}
    if missing := [k for k in obj if k.lower() not in known]:
        raise ValueError(f"unknown fields: {', '.join(missing)}")
    out: dict[str, Any] = dict.fromkeys(schema.fieldNames())
    for k, v in obj.items():
        f = known[k.lower()]
        if v is not None and isinstance(f.dataType, T.StringType):
            v = str(v)
        out[f.name] = v
    return out


def read_objects(table, text: str) -> list[dict]:
    """The objects of a file: YAML or JSON documents with --- between."""
    parts = [p for p in re.split(r"(?m)^---\s*$", text) if p.strip()]
    return [coerce(table.spec.schema, parse_yaml(p)) for p in parts]


def cells(table, obj: dict) -> list[str]:
    if table.spec.row:
        return table.spec.row(obj)
    return [", ".join(map(str, v)) if isinstance(v, list) else "" if v is None else str(v) for v in obj.values()]


def header(table) -> list[str]:
    return list(table.spec.header) if table.spec.header else table.spec.columns


def aligned(lines: list[list[str]]) -> str:
    widths = [max(len(r[k]) for r in lines) for k in range(len(lines[0]))]
    return "".join("   ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() + "\n" for r in lines)


def write_objects(table, frame: DataFrame, out: TextIO, columns: list[str] | None = None, form: str = "table") -> None:
    """Rows as an aligned table (of some columns if asked), YAML documents or JSON lines."""
    if form not in ("table", "yaml", "json"):
        raise ValueError(f"unknown format {form!r}")
    if columns and form != "table":
        raise ValueError("columns can be chosen for tables only")
    found = objects(table, frame)
    if form == "table":
        names = header(table)
        at = {n.lower(): k for k, n in enumerate(names)}
        if columns and (missing := [c for c in columns if c.lower() not in at]):
            raise KeyError(f"unknown columns: {', '.join(missing)}")
        pick = [at[c.lower()] for c in columns] if columns else range(len(names))
        out.write(aligned([[r[k] for k in pick] for r in [names, *(cells(table, o) for o in found)]]))
    else:
        for k, obj in enumerate(found):
            if form == "json":
                out.write(safe_json(obj) + "\n")
            else:
                out.write("---\n" * bool(k) + "".join(f"{n}: {json.dumps(plain(v))}\n" for n, v in obj.items()))


