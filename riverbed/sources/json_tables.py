"""Tables out of captured JSON: explicit schemas, alias keys, recursive walks."""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts whose Python objects are held at once; beyond them a task holds Arrow columns only.
TEXTS_AT_ONCE = 256
WALKED = "array<struct<path:string,key:string,value:string,depth:int>>"
_WALKED = pa.list_(pa.struct([("path", pa.string()), ("key", pa.string()), ("value", pa.string()), ("depth", pa.int32())]))
OBJECTS = "array<struct<path:string,object:string>>"
_OBJECTS = pa.list_(pa.struct([("path", pa.string()), ("object", pa.string())]))


def read_state(spark: SparkSession, path: str, schema: str, rows: str = "listings", missing: DataFrame | None = None) -> DataFrame:
    """Rows of a state document. A document that can't be read raises an error; it doesn't count as an empty state.

    Only where there is no document at all are the rows of ``missing`` returned, if they are given.
    """
    if missing is not None:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return missing
    docs = spark.read.schema(f"{rows} array<struct<{schema}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return docs.select(F.explode(rows).alias("r")).select("r.*")


def items_of(body, places=("$.data.items", "$.data.list", "$.data.data", "$.data", "$.items", "$.list")) -> Column:
    """The first place of a payload that holds a list, as an array of variants."""
    parsed = F.try_parse_json(body)
    return F.coalesce(*[F.try_variant_get(parsed, p, "array<variant>") for p in places])


def field(variant: Column, *aliases: str, kind: str = "string") -> Column:
    """The first alias that the object has."""
    return F.coalesce(*[F.try_variant_get(variant, f"$.{a}", kind) for a in aliases])


def explode_items(df: DataFrame, body: str, fields: dict[str, tuple[str, ...]], keep: list[str]) -> DataFrame:
    """A row for each item of each payload, with its place and the named fields; payloads without a list give none."""
    rows = df.select(*keep, F.posexplode(items_of(F.col(body))).alias("place", "item"))
    return rows.select(*keep, "place", *[field(F.col("item"), *aliases).alias(name) for name, aliases in fields.items()])


def embedded_scripts(html, kinds=("__NEXT_DATA__", "application/json", "application/ld\\+json")) -> Column:
    """Bodies of the JSON script blocks of a page."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<script[^>]*(?:{'|'.join(kinds)})[^>]*>(.*?)</script>"), F.lit(1))


_TOKEN = re.compile(r"""[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|true\b|false\b|null\b|NaN\b|-?Infinity\b))""", re.ASCII)


def _deep_value(text: str):
    """The value of a JSON text, by a stack of open objects and lists: for texts nested too deep for a recursive parser."""
    at, n = 0, len(text.rstrip(" \t\n\r"))
    stack: list = []  # open objects and lists
    keys: list = []  # for each the key that waits for its value
    expect, value = "value", None  # value; first: or an end; key; firstkey: or an end; colon; more: a comma or an end; done
    while at < n:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no JSON at {at}")
        mark, string, plain = m.groups()
        at = m.end()
        if mark and mark in "{[" and expect in ("value", "first"):
            stack.append({} if mark == "{" else [])
            keys.append(None)
            expect = "firstkey" if mark == "{" else "first"
            continue
        if mark == ":" and expect == "colon":
            expect = "value"
            continue
        if mark == "," and expect == "more":
            expect = "key" if isinstance(stack[-1], dict) else "value"
            continue
        if string and expect in ("key", "firstkey"):
            keys[-1], expect = json.loads(string), "colon"
            continue
        if mark == "}" and expect in ("firstkey", "more") and isinstance(stack[-1], dict) or mark == "]" and expect in ("first", "more") and isinstance(stack[-1], list):
            value = stack.pop()
            keys.pop()
        elif (string or plain) and expect in ("value", "first"):
            value = json.loads(string or plain)
        else:
            raise ValueError(f"not expected at {m.start()}")
        if not stack:
            expect = "done"
        else:
            if isinstance(stack[-1], dict):
                stack[-1][keys[-1]] = value
            else:
                stack[-1].append(value)
            expect = "more"
    if expect != "done":
        raise ValueError("the text ends too early")
    return value


def _parsed(text: str | None):
    """A list of the text's value; of none for null, an empty text or one that isn't JSON."""
    if not text:
        return []
    try:
        try:
            return [json.loads(text)]
        except RecursionError:
            return [_deep_value(text)]
    except ValueError:
        return []


def _compact(node) -> str:
    try:
        return json.dumps(node, ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        pass
    out, left = [], [(None, node)]  # pieces to write as they stand, and values
    while left:
        piece, value = left.pop()
        if piece is not None:
            out.append(piece)
        elif isinstance(value, dict):
            left.append(("}", None))
            for k, (key, item) in reversed(list(enumerate(value.items()))):
                left += [(None, item), ("," * (k > 0) + json.dumps(key, ensure_ascii=False) + ":", None)]
            out.append("{")
        elif isinstance(value, list):
            left.append(("]", None))
            for k, item in reversed(list(enumerate(value))):
                left.append((None, item))
                if k:
                    left.append((",", None))
            out.append("[")
        else:
            out.append(json.dumps(value, ensure_ascii=False))
    return "".join(out)


def _inside(node, path: str, widest: int) -> Iterator[tuple[str, str, object]]:
    """Path, key and value of what an object or list holds, of a list the first ``widest``."""
    if isinstance(node, dict):
        return ((f"{path}.{k}", k, v) for k, v in node.items())
    return ((f"{path}[{k}]", str(k), v) for k, v in enumerate(node[:widest]))


def _walk(node, deepest: int, widest: int) -> Iterator[tuple[str, str, str, int]]:
    """Leaves in the text's order; open objects and lists stand on a stack."""
    left = [_inside(node, "$", widest)] if isinstance(node, dict | list) else []
    while left:
        for at, key, value in left[-1]:
            if not isinstance(value, dict | list):
                yield at, key, value if isinstance(value, str) else json.dumps(value), len(left)
            elif len(left) < deepest:
                left.append(_inside(value, at, widest))
                break
        else:
            left.pop()


def _by_parts(body, of: Callable[[str | None], list[dict]], kind: str, made: pa.DataType) -> Column:
    """What ``of`` gives for each text, a few of them at once: a batch's results are never all Python objects."""

    @F.arrow_udf(kind)
    def run(bodies: pa.Array) -> pa.Array:
        parts = [pa.array([of(text) for text in bodies.slice(k, TEXTS_AT_ONCE).to_pylist()], made) for k in range(0, len(bodies), TEXTS_AT_ONCE)]
        return pa.concat_arrays(parts) if parts else pa.array([], made)

    return run(body)


def walk_json(body, deepest: int = 16, widest: int = 500, distinct: int | None = None) -> Column:
    """All scalar leaves of a JSON text: path, key, value and depth; none for text that isn't JSON.

    ``deepest`` and ``widest`` bound the walk as the extraction rules ask; objects below or behind them aren't visited. Texts
    may be nested to any depth. With ``distinct`` a pair of path and value comes once, and the walk ends with so many of them.
    """

    def walked(text: str | None) -> list[dict]:
        rows: dict = {}
        for node in _parsed(text):
            for p, k, v, d in _walk(node, deepest, widest):
                rows.setdefault((p, v) if distinct else len(rows), {"path": p, "key": k, "value": v, "depth": d})
                if len(rows) == distinct:
                    break
        return list(rows.values())

    return _by_parts(body, walked, WALKED, _WALKED)


def _objects(node, deepest: int, widest: int) -> Iterator[tuple[str, str]]:
    """Objects in the text's order, outer ones before those inside."""
    if isinstance(node, dict):
        yield "$", _compact(node)
    left = [_inside(node, "$", widest)] if isinstance(node, dict | list) and deepest > 0 else []
    while left:
        for at, _, value in left[-1]:
            if isinstance(value, dict):
                yield at, _compact(value)
            if isinstance(value, dict | list) and len(left) < deepest:
                left.append(_inside(value, at, widest))
                break
        else:
            left.pop()


def json_objects(body, deepest: int = 16, widest: int = 500, most: int | None = None) -> Column:
    """Every object of a JSON text with its path, outer ones first; at most ``most``, where a report asks for so many."""

    def found(text: str | None) -> list[dict]:
        objects = itertools.chain.from_iterable(_objects(x, deepest, widest) for x in _parsed(text))
        return [{"path": p, "object": o} for p, o in itertools.islice(objects, most)]

    return _by_parts(body, found, OBJECTS, _OBJECTS)


def matching_leaves(leaves: Column, key_pattern: str, value_pattern: str = ".*") -> Column:
    return F.filter(leaves, lambda x: x["key"].rlike(f"(?i){key_pattern}") & x["value"].rlike(value_pattern))


def objects_with(leaves: Column, wanted: Column) -> Column:
    """Paths of the objects of which a scalar value holds the text, in either case."""
    holds = F.filter(leaves, lambda x: F.contains(F.lower(x["value"]), F.lower(wanted)) & ~x["path"].rlike(r"\]$"))
    return F.array_distinct(F.transform(holds, lambda x: F.regexp_replace(x["path"], r"\.[^.]*$", "")))


def product_string(c, pair: str = "~", parts: str = "=") -> Column:
    """``k1=v1~k2=v2`` as a map; pieces without a value go."""
    pieces = F.filter(F.split(c, re.escape(pair)), lambda x: F.contains(x, F.lit(parts)))
    cut = lambda x: F.struct(F.substring_index(x, parts, 1), F.substring(x, F.instr(x, parts) + len(parts), F.length(x)))
    keys = F.transform(pieces, lambda x: cut(x))
    return F.map_from_entries(F.filter(keys, lambda e: e["col2"] != ""))
