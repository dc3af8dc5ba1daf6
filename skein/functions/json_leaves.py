"""Long tables of JSON leaves. Depth and width limits belong to the semantics: see the presets."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Walk:
    """How deep and wide a document is read; ``whole_lists`` keeps lists of plain values as one leaf, ``ends`` makes
    nulls, empty objects and lists, and what lies too deep leaves without a value."""

    depth: int
    items: int
    whole_lists: bool = False
    ends: bool = False


#: Recorded responses, linked data, candidate search, suggestions.
FLATTEN = Walk(depth=8, items=3, whole_lists=True)
LINKED_DATA = Walk(depth=4, items=1, whole_lists=True)
CANDIDATES = Walk(depth=12, items=25)
SUGGESTIONS = Walk(depth=12, items=30)
#: Keys of objects twelve levels deep, those without a value too.
ENTITIES = Walk(depth=13, items=20, ends=True)

LEAVES = "array<struct<pos: int, path: string, depth: int, value: string>>"


def _plain(value) -> bool:
    return isinstance(value, (str, int, float)) and not isinstance(value, bool)


def _text(value) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _leaves(body: str | None, walk: Walk) -> list[tuple]:
    try:
        todo = [("", 0, json.loads(body))] if body else []
    except ValueError:
        return []
    found: list[tuple] = []
    while todo:
        path, depth, value = todo.pop()
        if isinstance(value, list) and not (walk.whole_lists and value and all(map(_plain, value))):
            # where lists of plain values are leaves, plain values in mixed lists are none
            children = [(f"{path}[{i}]", v) for i, v in enumerate(value[: walk.items]) if not walk.whole_lists or isinstance(v, (dict, list))]
        elif isinstance(value, dict):
            children = [(f"{path}.{k}" if path else k, v) for k, v in value.items()]
        else:
            if value is not None or walk.ends:
                found.append((len(found), path, depth, None if value is None else _text(value)))
            continue
        if walk.ends and (not children or depth >= walk.depth):
            found.append((len(found), path, depth, None))
        elif depth < walk.depth:
            todo.extend((p, depth + 1, v) for p, v in reversed(children))
    return found


def leaves(body: Column, walk: Walk) -> Column:
    """Leaves of a JSON text in document order; null and malformed bodies have none."""

    @F.pandas_udf(LEAVES)
    def read(batch: pd.Series) -> pd.Series:
        return batch.map(lambda b: _leaves(b, walk))

    return read(body)


def leaf_table(bodies: DataFrame, keys: list[str], body_col: str, walk: Walk) -> DataFrame:
    """One row per leaf: the keys, pos, path, depth, value."""
    return bodies.select(*keys, F.explode(leaves(F.col(body_col), walk)).alias("leaf")).select(*keys, "leaf.*")


# What in an address tells configuration and tracking from data.
CONFIG_URL = "(?i)translation|localisation|config|feature-flag|analytics|tracking"


def flatten_responses(requests: DataFrame, keys: list[str], walk: Walk = FLATTEN, most_bytes: int = 20_000, parts: int | None = None) -> DataFrame:
    """Leaves of a page's JSON responses (columns url, body, seq): configuration-like and larger bodies are left out, a
    URL counts once (its first body), and of equal paths the later body's value stands. With ``parts`` the leaves of a page meet in that many parts, for tables whose
    leaves are too many for the session's own number."""
    from pyspark.sql import Window as W

    fits = (F.octet_length("body") <= most_bytes) & ~F.col("url").rlike(CONFIG_URL)
    first = F.row_number().over(W.partitionBy(*keys, "url").orderBy("seq"))
    once = requests.where(fits).withColumn("nth", first).where("nth = 1")
    table = leaf_table(once, [*keys, "seq"], "body", walk)
    if parts:
        table = table.repartition(parts, *keys)
    last = F.max_by(F.struct("seq", "pos", "depth", "value"), F.struct("seq", "pos"))
    return table.groupBy(*keys, "path").agg(last.alias("l")).select(*keys, "path", "l.*")


def array_paths(table: DataFrame, keys: list[str], most_depth: int = 3) -> DataFrame:
    """Arrays of objects found among leaves: (keys, array_path, items), outermost index as the item number."""
    prefix = F.regexp_extract("path", r"^(.*?)\[(\d+)\]\.", 1)
    item = F.regexp_extract("path", r"^(.*?)\[(\d+)\]\.", 2)
    found = table.select(*keys, prefix.alias("array_path"), item.alias("item")).where("item != ''")
    shallow = F.size(F.split("array_path", r"\.")) <= most_depth
    return found.where(shallow).groupBy(*keys, "array_path").agg(F.count_distinct("item").alias("items"))


def by_path(json_text: Column, path: Column) -> Column:
    """Value at a dot path (``a.b[0].c``, a column) as text; null where it leads nowhere or the body is no JSON."""
    return F.try_variant_get(F.try_parse_json(json_text), F.concat(F.lit("$."), path), "string")


def stable_json(text: Column) -> Column:
    """JSON text with sorted keys: equal for documents that differ in key order only."""
    return F.to_json(F.try_parse_json(text))


#: How deep objects and lists are entered for their keys, and how many of them.
KEY_DEPTH, KEY_NODES = 10, 50_000


def _keys(body: str | None) -> list[str]:
    try:
        todo = [(json.loads(body), 0)] if body else []
    except ValueError:
        return []
    keys: dict[str, None] = {}
    entered = 0
    while todo and entered <= KEY_NODES:
        value, depth = todo.pop()
        if not isinstance(value, (dict, list)) or depth > KEY_DEPTH:
            continue
        entered += 1
        if isinstance(value, dict):
            keys.update((k.lower(), None) for k in value)
            value = value.values()
        todo.extend((v, depth + 1) for v in reversed(list(value)))
    return list(keys)


def key_set(body: Column) -> Column:
    """Distinct lower-case keys of a document, those of empty and null values too."""

    @F.pandas_udf("array<string>")
    def read(bodies: pd.Series) -> pd.Series:
        return bodies.map(_keys)

    return read(body)


def object_url(json_text: Column) -> Column:
    """The address an object names: its url, contentUrl or @id."""
    document = F.try_parse_json(json_text)
    return F.coalesce(*[F.try_variant_get(document, p, "string") for p in ("$.url", "$.contentUrl", "$['@id']")])
