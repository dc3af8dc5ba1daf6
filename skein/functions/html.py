"""Page text and embedded data by expressions; the node table of a page by one batch reader."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Sequence
from functools import reduce
from html import unescape
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .text import SPACES, unicode_form
from .urls import joined_url

_HIDDEN = r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>"


def visible_text(html: Column, keep_comments: bool = False) -> Column:
    """Text without comments, scripts, styles and tags, collapsed."""
    body = html if keep_comments else F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, _HIDDEN, " "), r"<[^>]+>", " "), r"\s+", " "))


def clean_html(html: Column) -> Column:
    """Markup that can hold content: no comments, scripts, styles, drawings, head metadata."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), r"(?is)<(script|style|svg|noscript|head)\b[^>]*>.*?</\1\s*>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?i)<(link|meta)\b[^>]*>", ""), r"\s+", " "))


# The named entities that page text uses; ``&amp;`` comes last.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&reg;", "®"), ("&trade;", "™"), ("&copy;", "©"), ("&#39;", "'"), ("&amp;", "&")]


def decode_entities(text: Column, numeric: bool = False) -> Column:
    """Named entities as characters; numbered ones too if asked for, which takes the batches through Python."""
    if numeric:

        @F.pandas_udf("string")
        def unescaped(batch: pd.Series) -> pd.Series:
            return batch.map(lambda t: t if t is None or "&" not in t else unescape(t))

        return unescaped(text)
    for entity, mark in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(mark))
    return text


_MARKS = "[®™©℠℗]"


def shown_key(text: Column, fold: bool = False) -> Column:
    """Comparison form of shown text: entities decoded, symbol marks joined to the words around them, lower case,
    collapsed; compatibility-folded if asked for (which takes the batches through Python)."""
    joined = F.regexp_replace(F.regexp_replace(decode_entities(text), rf"{SPACES}(?={_MARKS})", ""), rf"({_MARKS}){SPACES}", "$1")
    shaped = unicode_form(joined, "NFKC") if fold else joined
    return F.lower(F.trim(F.regexp_replace(shaped, SPACES, " ")))


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def page_heading(html: Column) -> Column:
    """Text of the first h1, null without one."""
    inner = F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)
    text = visible_text(inner)
    return F.when(text != "", text)


def structured_data(html: Column) -> Column:
    """struct<ld_json, next_data, initial_state, meta>: bodies as JSON text; what is no JSON is dropped."""
    bodies = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    next_data = F.regexp_extract(html, r"(?is)<script[^>]*id=[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script>", 1)
    state = F.regexp_extract(html, r"(?s)window\.__(?:INITIAL_STATE|PRELOADED_STATE|NUXT|APP_DATA)__\s*=\s*(\{.*?\})\s*;?\s*</script>", 1)
    valid = lambda body: F.when(F.try_parse_json(body).isNotNull(), F.trim(body))
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    pairs = F.transform(
        tags,
        lambda t: F.struct(
            F.regexp_extract(t, r"(?i)\b(?:property|name)=[\"']([^\"']*)[\"']", 1).alias("key"),
            F.regexp_extract(t, r"(?i)\bcontent=[\"']([^\"']*)[\"']", 1).alias("value"),
        ),
    )
    named = F.filter(pairs, lambda p: p["key"] != "")
    keys = F.array_distinct(F.transform(named, lambda p: p["key"]))
    meta = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(named, lambda p: p["key"] == k), -1)["value"]))
    return F.struct(
        F.array_compact(F.transform(bodies, valid)).alias("ld_json"),
        valid(next_data).alias("next_data"),
        valid(state).alias("initial_state"),
        meta.alias("meta"),
    )


def links(html: Column) -> Column:
    """Anchors in page order: array of struct<href, text>."""
    anchors = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0))
    return F.transform(
        anchors,
        lambda a: F.struct(
            decode_entities(F.regexp_extract(a, r"(?i)\bhref=[\"']([^\"']*)[\"']", 1)).alias("href"),
            visible_text(a).alias("text"),
        ),
    )


_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NODES = "array<struct<tag: string, xpath: string, attrs: map<string,string>, address: string>>"
NODE_SCHEMA = "pos int, parent int, tag string, xpath string, attrs map<string,string>, text string"


# most tags: lower case, quoted values without entities, an element whose text the parser reads like any other
_PLAIN_ATTRIBUTE = re.compile(r' ([a-z][a-z-]*)="([^"&<>]*)"')
_PLAIN_TAG = re.compile(r'<(a|b|body|div|footer|h[1-6]|header|html|img|li|main|nav|p|section|span|table|td|tr|ul)((?: [a-z][a-z-]*="[^"&<>]*")*)>')

#: Elements that a reader hands on at once, and characters of a page that it takes at once.
NODE_ROWS, PIECE = 4_096, 1 << 20


class _Nodes(HTMLParser):
    """Open elements form a stack; a closing tag closes up to its own element, if open at all. Closed elements are complete
    and wait in ``done`` to be handed on."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.done, self.open, self.counts, self.seen = [], [], [{}], 0

    def updatepos(self, i, j):
        return j  # nobody asks for lines

    def parse_starttag(self, i):
        plain = _PLAIN_TAG.match(self.rawdata, i)
        if not plain:
            return super().parse_starttag(i)
        self.handle_starttag(plain[1], _PLAIN_ATTRIBUTE.findall(plain[2]) if plain[2] else [])
        return plain.end()

    def handle_starttag(self, tag, attrs):
        known = self.counts[-1]
        known[tag] = known.get(tag, 0) + 1
        parent = self.open[-1] if self.open else None
        path = (parent["xpath"] if parent else "") + f"/{tag}[{known[tag]}]"
        row = {"pos": self.seen, "parent": parent["pos"] if parent else None, "tag": tag, "xpath": path, "attrs": {k: v or "" for k, v in attrs}, "text": []}
        self.seen += 1
        if tag in _VOID:
            self.done.append(row)
        else:
            self.open.append(row)
            self.counts.append({})

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth]["tag"] == tag:
                self.done += self.open[depth:]
                del self.open[depth:], self.counts[depth + 1 :]
                return

    def handle_data(self, data):
        if self.open:
            self.open[-1]["text"].append(data)


def _nodes_of(page: str | None) -> Iterator[dict]:
    reader, page = _Nodes(), page or ""
    for low in range(0, len(page), PIECE):
        reader.feed(page[low : low + PIECE])
        yield from reader.done
        reader.done = []
    yield from reader.open


def nodes(pages: DataFrame, id_col: str, html_col: str, base_col: str | None = None) -> DataFrame:
    """One row per element of each page: id, pos, parent, tag, xpath (every step numbered), attrs, own text. Elements leave a
    task as they are closed, some thousand at a time, so that its memory grows neither with the pages of a batch nor with
    the elements of a page.

    With ``base_col``, the page's address, one row per page instead, with its elements that have attributes as an array ``nodes`` of
    (tag, xpath, attrs, address: its href joined with the page's), for steps that look at a page by itself and would move its
    elements together again; a page without any has an empty one."""
    types = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            elements = ((n, e) for n, page in enumerate(batch.column(1)) for e in _nodes_of(page.as_py()))
            while held := list(itertools.islice(elements, NODE_ROWS)):
                made = [[e[c] for _, e in held] for c in ("pos", "parent", "tag", "xpath")]
                made += [[list(e["attrs"].items()) for _, e in held], ["".join(e["text"]) for _, e in held]]
                own = batch.column(0).take(pa.array([n for n, _ in held]))
                yield pa.RecordBatch.from_arrays([own, *(pa.array(c, type=t) for c, t in zip(made, types))], names)

    def read_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, held, joined, ends = 0, [], [], [0]
            for n, (page, base) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()), 1):
                told = [e for e in _nodes_of(page) if e["attrs"]]
                held += told
                joined += [joined_url(e["attrs"]["href"].strip(" ") if "href" in e["attrs"] else None, base) for e in told]
                ends.append(len(held))
                if len(held) >= NODE_ROWS or n == batch.num_rows:
                    sizes = pa.array(list(itertools.accumulate((len(e["attrs"]) for e in held), initial=0)), pa.int32())
                    pairs = [[x for e in held for x in part(e["attrs"])] for part in (dict.keys, dict.values)]
                    attrs = pa.MapArray.from_arrays(sizes, *(pa.array(x, pa.string()) for x in pairs))
                    made = pa.StructArray.from_arrays([*(pa.array([e[c] for e in held], pa.string()) for c in ("tag", "xpath")), attrs, pa.array(joined, pa.string())], ["tag", "xpath", "attrs", "address"])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, n - low), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)], [id_col, "nodes"])
                    low, held, joined, ends = n, [], [], [0]

    own = StructField(id_col, pages.schema[id_col].dataType)
    if base_col is not None:
        return pages.select(id_col, html_col, base_col).mapInArrow(read_together, StructType([own, *StructType.fromDDL(f"nodes {NODES}").fields]))
    names = [id_col, "pos", "parent", "tag", "xpath", "attrs", "text"]
    schema = StructType([own, *StructType.fromDDL(NODE_SCHEMA).fields])
    return pages.select(id_col, html_col).mapInArrow(read, schema)


def own_text(node_text: Column) -> Column:
    text = F.trim(F.regexp_replace(node_text, SPACES, " "))
    return F.when(text != "", text)


def matches_xpath(xpath: str) -> Column:
    """Condition on the node table's ``xpath`` and ``attrs`` for a path of the supported kind: steps ``/tag``,
    ``//tag``, ``tag[n]``, and on the last step ``[@a="v"]`` or ``[contains(@a, "v")]``. A closing ``/@attr`` or
    ``/text()`` names what to read and is ignored here (see ``xpath_value``)."""
    import re

    path = re.sub(r"/(@[\w-]+|text\(\))$", "", xpath)
    tests = []
    last = re.search(r"\[(?:@([\w-]+)=[\"']([^\"']*)[\"']|contains\(@([\w-]+),\s*[\"']([^\"']*)[\"']\))\]$", path)
    if last:
        path = path[: last.start()]
        name, value = last[1] or last[3], last[2] or last[4]
        attribute = F.col("attrs")[name]
        tests.append(attribute == value if last[1] else F.contains(attribute, F.lit(value)))
    found = F.col("xpath").rlike(f"^{_steps(path)}$")
    for test in tests:
        found = found & F.coalesce(test, F.lit(False))
    return found


def _steps(path: str) -> str:
    """The pattern of the numbered paths that the steps of ``path`` stand for."""
    import re

    pattern = ""
    for gap, tag, number in re.findall(r"(//?)([\w-]+|\*)(?:\[(\d+)\])?", path):
        name = r"[\w-]+" if tag == "*" else re.escape(tag)
        pattern += (r"(?:/[\w-]+\[\d+\])*" if gap == "//" else "") + f"/{name}" + (rf"\[{number}\]" if number else r"\[\d+\]")
    return pattern


def xpath_value(xpath: str) -> Column:
    """What the path reads of a matching node: an attribute or its own text."""
    if "/@" in xpath:
        return F.col("attrs")[xpath.rsplit("/@", 1)[1]]
    return own_text(F.col("text"))


def probe_xpaths(node_table: DataFrame, id_col: str, paths: list[str]) -> DataFrame:
    """(id, xpath, matches, value): for each page and path the number of nodes and the first non-empty value."""
    # every node is held against all paths in one pass, so pages are read once
    tests = [F.when(matches_xpath(p), F.struct(F.lit(p).alias("path"), xpath_value(p).alias("value"))) for p in dict.fromkeys(paths)]
    hits = node_table.select(id_col, "pos", F.explode(F.filter(F.array(*tests), lambda h: h.isNotNull())).alias("hit")).select(id_col, "pos", "hit.*")
    first = F.min(F.when(F.col("value").isNotNull(), F.struct("pos", "value")))
    return hits.groupBy(id_col, F.col("path").alias("xpath")).agg(F.count("*").alias("matches"), first["value"].alias("value"))


def extract_rows(node_table: DataFrame, id_col: str, row_path: str, fields: dict[str, str]) -> DataFrame:
    """Rows of a list: for each node of ``row_path`` in page order, the first non-empty value of each field's path, which
    begins at the row (``./a/@href``, ``.//span``, ``.`` for the row itself). Rows without any value go; ``item``
    numbers those that stay from 0. A node inside nested rows belongs to the innermost."""
    import re

    from pyspark.sql import Window as W

    steps = re.sub(r"\[(?:@|contains\()[^\]]*\]$", "", row_path)
    rows = node_table.where(matches_xpath(row_path)).select(id_col, F.col("xpath").alias("row_xpath"))
    prefix = F.regexp_extract("xpath", rf"^({_steps(steps)})(?=/|$)", 1)
    inside = node_table.withColumn("row_xpath", prefix).where("row_xpath <> ''").join(rows, [id_col, "row_xpath"])
    inside = inside.withColumn("xpath", F.substr("xpath", F.length("row_xpath") + 1))
    values = []
    for name, field in fields.items():
        relative = field.removeprefix(".")
        own = re.sub(r"^/(@[\w-]+|text\(\))$", "", relative) == ""
        here = (F.col("xpath") == "") if own else matches_xpath(relative)
        value = xpath_value(relative)
        values.append(F.min(F.when(here & value.isNotNull() & (value != ""), F.struct("pos", value.alias("value"))))["value"].alias(name))
    found = inside.groupBy(id_col, "row_xpath").agg(F.min("pos").alias("row_pos"), *values)
    kept = found.where(F.coalesce(*[F.col(f"`{n}`") for n in fields]).isNotNull())
    nth = F.row_number().over(W.partitionBy(id_col).orderBy("row_pos")) - 1
    return kept.select(id_col, nth.alias("item"), *[F.col(f"`{n}`") for n in fields])


def extracted(xpath: str) -> Column:
    """What a path reads of a matching node as a field's value: never of scripts and styles, no text that looks like code or is
    longer than 5,000 characters, without the words of shop buttons and names around it; null if nothing is left."""
    value = xpath_value(xpath)
    if "/@" not in xpath:
        value = F.when(~(value.startswith("{") | value.startswith("[{") | value.startswith("function ")) & (F.length(value) <= 5000), value)
    named = F.trim(F.regexp_replace(F.regexp_replace(value, r"(?i)^Visit the\s+", ""), r"(?i)\s+Store$", ""))
    plain = F.trim(F.regexp_replace(F.regexp_replace(named, r"(?i)^(Shop|Buy|Order|Get)\s+(now|it|this)?\s*", ""), SPACES, " "))
    return F.when(~F.col("xpath").rlike(r"/(script|style|noscript)\[") & ~plain.isin("", "undefined", "null"), plain)


def extract_page(node_table: DataFrame, id_col: str, row_path: str, fields: dict[str, str], lists: Sequence[str] = ()) -> DataFrame:
    """One row for a page about one thing. A field's path is read from the first node of ``row_path``, if there is one; if
    that gives nothing, from the whole page (``./a`` as ``/a``, ``.//a`` as ``//a``, ``a`` as ``//a``). Paths that begin
    with ``/`` always mean the whole page. A field has the value of the first matching node, even if that is none; fields
    in ``lists`` are arrays of the values of all matching nodes in page order, null if there is none. Pages without any
    value have no row."""
    first = node_table.where(matches_xpath(row_path)).groupBy(id_col).agg(F.min_by("xpath", "pos").alias("row_xpath"))
    placed = node_table.join(first, id_col, "left").withColumn("page_xpath", F.col("xpath"))
    inside = (F.col("xpath") == F.col("row_xpath")) | F.col("xpath").startswith(F.concat("row_xpath", F.lit("/")))
    near, far, read = {}, {}, {}
    for n, (name, path) in enumerate(fields.items()):
        relative = path.removeprefix(".") if path.startswith(".") else f"/{path}"
        whole = path if path.startswith("/") else path.removeprefix(".") if path.startswith(".") else f"//{path}"
        itself = re.sub(r"^/(@[\w-]+|text\(\))$", "", relative) == ""
        on_row = (F.col("xpath") == "") if itself else matches_xpath(relative)
        near[f"_near{n}"] = F.lit(False) if path.startswith("/") else F.coalesce(F.col("inside") & on_row, F.lit(False))
        far[f"_far{n}"] = F.lit(False) if itself else matches_xpath(whole)
        read[f"_value{n}"] = extracted(whole)
    # the tests of one kind see the path from the row, those of the other the path from the page
    rowed = placed.withColumns({"inside": inside, "xpath": F.when(inside, F.substr("xpath", F.length("row_xpath") + 1))}).withColumns(near)
    tested = rowed.withColumn("xpath", F.col("page_xpath")).withColumns({**far, **read})
    gathered = []
    for n, name in enumerate(fields):
        value = F.struct("pos", F.col(f"_value{n}").alias("value"))
        for test in (f"_near{n}", f"_far{n}"):
            if name in lists:
                hits = F.array_sort(F.collect_list(F.when(F.col(test) & F.col(f"_value{n}").isNotNull(), value)))
                gathered.append(F.when(F.size(hits) > 0, F.transform(hits, lambda h: h["value"])).alias(test))
            else:
                gathered.append(F.min(F.when(F.col(test), value))["value"].alias(test))
    told = tested.groupBy(id_col).agg(*gathered)
    named = [F.coalesce(f"_near{n}", f"_far{n}").alias(name) for n, name in enumerate(fields)]
    return told.select(id_col, *named).where(reduce(lambda a, b: a | b, [F.col(f"`{name}`").isNotNull() for name in fields]))


def search_value(node_table: DataFrame, id_col: str, expected: DataFrame, most: int = 3) -> DataFrame:
    """Nodes whose own text equals an expected value (id, field, value), up to ``most`` paths each, in page order."""
    from pyspark.sql import Window as W

    text = F.lower(own_text(F.col("text")))
    found = node_table.select(id_col, "pos", "xpath", text.alias("key")).join(
        expected.select(id_col, "field", F.lower(F.col("value")).alias("key")), [id_col, "key"]
    )
    order = W.partitionBy(id_col, "field").orderBy("pos")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select(id_col, "field", "xpath", "n")


def xpath_contains_value(xpath: Column, value: Column) -> Column:
    """A path that quotes the value it is to find proves nothing."""
    return F.coalesce((F.length(F.trim(value)) > 0) & F.contains(F.lower(xpath), F.lower(F.trim(value))), F.lit(False))


def volatile_value(value: Column) -> Column:
    """An attribute value that a site's next build or another product changes: a state or small number, a version or long
    number, a generated id or class name, or a run in which letters and digits mix (a word with a number at one end is
    a name)."""
    v = F.trim(value)
    runs = F.filter(F.split(v, "[^A-Za-z0-9]+"), lambda r: F.length(r) >= 5)
    digits = lambda r: F.regexp_count(r, F.lit("[0-9]"))
    hashed = F.exists(runs, lambda r: (digits(r) >= 2) & (F.length(r) - digits(r) >= 2) & ~r.rlike("^[A-Za-z]+[0-9]+$") & ~r.rlike("^[0-9]+[A-Za-z]+$"))
    told = v.rlike(r"(?i)^(true|false|yes|no|on|off|null|undefined|\d{1,4})$") | v.rlike(r"\d+\.\d+|\d{5,}|^:[A-Za-z][A-Za-z0-9]*:$|^(css|sc|jsx|jss|emotion)-[A-Za-z0-9]{4,}$")
    return (v != "") & (told | hashed)


def looks_volatile(xpath: Column) -> Column:
    """Some quoted literal of the path, or one of its words, is volatile."""
    literals = F.filter(F.transform(F.regexp_extract_all(xpath, F.lit('"([^"]*)"'), F.lit(1)), F.trim), lambda x: x != "")
    return F.exists(literals, lambda x: volatile_value(x) | F.exists(F.split(x, r"\s+"), volatile_value))


def canonical_xpath(xpath: Column) -> Column:
    """One spelling: double quotes, no blanks around operators."""
    tidy = F.regexp_replace(F.trim(xpath), r"\s*([=,\[\]()|])\s*", "$1")
    return F.replace(tidy, F.lit("'"), F.lit('"'))
