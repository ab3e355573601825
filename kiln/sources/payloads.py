"""Landed API payloads -> rows (SRC-08..SRC-15).

A payload table has one row per landed response document (a JSON text
column).  Documents are parsed once into VARIANT and navigated with
``try_variant_get``; no Python touches a row.  Documents are independent,
so the work is split by document across all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD = "record"
UNFIT = "_unfit"  # holds a document's text if a part of it contradicts its types


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def path_to_jsonpath(path: str) -> str:
    """'a.b.c' -> '$.a.b.c' (an empty path is the document root)."""
    return "$" + "".join(f".{p}" for p in path.split(".") if p)


def records_at(node: Column) -> Column:
    """ARRAY<VARIANT> of the records at an already-extracted path node:
    missing key / non-object on the way -> empty; list -> its elements;
    object or scalar -> a one-element list."""
    as_list = F.try_variant_get(node, "$", "array<variant>")
    empty = F.array().cast("array<variant>")
    return F.when(node.isNull() | F.is_variant_null(node), empty).when(as_list.isNotNull(), as_list).otherwise(F.array(node))


def extract_path(df: DataFrame, json_col: str, path: str, keep: list[str] | None = None) -> DataFrame:
    """SRC-08: one row per record found at the dotted ``path``; the record is
    a VARIANT column named ``record``.  Unparseable documents yield no rows.

    Parsing, the path walk and the record list are separate projections so
    each document is parsed exactly once (the optimizer does not duplicate
    non-trivial expressions across projections)."""
    keep = keep or []
    doc = df.select(*keep, F.try_parse_json(F.col(json_col)).alias("_doc"))
    node = doc.select(*keep, F.try_variant_get("_doc", path_to_jsonpath(path), "variant").alias("_node"))
    return node.select(*keep, F.explode(records_at(F.col("_node"))).alias(RECORD))


def node_text(json_col, path: str) -> Column:
    """The JSON text at the dotted ``path`` of a document; NULL if it isn't there or the document can't be parsed."""
    parts = [p for p in path.split(".") if p]
    schema = "string"
    for name in reversed(parts):
        schema = f"struct<`{name}`: {schema}>"
    node = F.from_json(_c(json_col), schema)
    for name in parts:
        node = node[name]
    return node


def element_texts(text) -> Column:
    """The JSON texts of a list's elements; an object or scalar is a list of one, a missing node an empty one."""
    t = _c(text)
    one, none = F.array(t), F.array().cast("array<string>")
    return F.when(t.isNull(), none).when(F.startswith(F.ltrim(t), F.lit("[")), F.coalesce(F.from_json(t, "array<string>"), one)).otherwise(one)


def typed_doc(json_col, path: str, element: str) -> Column:
    """A document parsed once, the node at ``path`` as a list of ``element``; see ``fits`` and ``node_of``."""
    parts = [p for p in path.split(".") if p]
    schema = f"array<{element}>"
    for name in reversed(parts[1:]):
        schema = f"struct<`{name}`: {schema}>"
    return F.from_json(_c(json_col), f"struct<`{parts[0]}`: {schema}, `{UNFIT}`: string>", {
        "columnNameOfCorruptRecord": UNFIT, "allowNonNumericNumbers": "false"})  # NaN is left to the parse step by step


def fits(doc: Column) -> Column:
    """Whether nothing in the document contradicted the types of ``typed_doc``."""
    return doc.isNotNull() & doc[UNFIT].isNull()


def node_of(doc: Column, path: str) -> Column:
    for name in [p for p in path.split(".") if p]:
        doc = doc[name]
    return doc


def text_fields(names: tuple[str, ...]) -> str:
    return "struct<" + ", ".join(f"`{n}`: string" for n in names) + ">"


def opened(fields: Column, derive, *more: Column) -> Column:
    """Each record as its named fields (``f``) and what ``derive`` makes of them (``d``), both made once."""
    return F.transform(fields, lambda f: F.struct(*more, f.alias("f"), derive(f).alias("d")))


def text_at(doc: Column, listed, texts: Column) -> Column:
    """The text of element ``_at`` of what ``listed`` takes from ``doc``; of ``texts`` if the document doesn't fit its types."""
    return F.get(F.get(F.transform(F.array(doc), lambda d: F.when(fits(d), listed(d)).otherwise(texts)), F.lit(0)), F.col("_at"))


def open_records(df: DataFrame, json_col: str, path: str, names: tuple[str, ...], derive, cut, keep: list[str] | None = None) -> DataFrame:
    """SRC-08 for records with known fields: one row per record found at ``path`` (not empty).

    The record's named fields are text (``f``); ``derive`` adds columns made of them (``d``).  Both are
    made where the list is exploded, so neither a filter on them nor a projection makes them again.
    A document whose node is a list of objects is parsed once; in any other, step by step, an
    object or scalar is a list of one.  ``raw`` is the record's own text; it is cut out again, and only
    where ``cut`` of the record holds, else NULL."""
    keep = keep or []
    docs = df.select(*keep, _c(json_col).alias("_text"), typed_doc(json_col, path, text_fields(names)).alias("_doc"))
    texts = element_texts(node_text("_text", path))
    doc = F.col("_doc")
    found = F.when(fits(doc), opened(node_of(doc, path), derive)).otherwise(
        opened(F.transform(texts, lambda r: F.from_json(r, text_fields(names))), derive))
    raw = F.when(cut(F.col("_r")), text_at(typed_doc("_text", path, "string"), lambda d: node_of(d, path), texts))
    return docs.select(*keep, "_text", F.posexplode(found).alias("_at", "_r")).select(
        *keep, F.struct(raw.alias("raw"), "_r.f", "_r.d").alias(RECORD))


def field(name: str, dtype: str = "string", rec: str = RECORD) -> Column:
    """Typed field of a record; a value that cannot be cast is NULL."""
    return F.try_variant_get(F.col(rec), path_to_jsonpath(name), dtype)


def null_suppressed(text) -> Column:
    """SRC-09: a bare ``*`` value (suppressed number) becomes JSON null."""
    return F.regexp_replace(_c(text), r":\s*\*\s*(?=[,}\]])", ": null")


def combine_pages(pages: DataFrame, endpoint: str, page_key: list[str], payload: str) -> DataFrame:
    """SRC-10: rows of every landed page, taken from ``results`` or else
    ``data``; the pages of an endpoint stop at its first empty page (that
    page and every later one are dropped).

    The stop point is a per-endpoint ``min`` over empty pages (partially
    aggregated), joined back: no per-endpoint sort or collect.
    """
    doc = F.try_parse_json(F.col(payload))
    res = F.try_variant_get(doc, "$.results", "array<variant>")
    dat = F.try_variant_get(doc, "$.data", "array<variant>")
    recs = F.coalesce(res, dat, F.array().cast("array<variant>"))
    p = pages.select(endpoint, *page_key, recs.alias("_recs"))
    key = F.struct(*[F.col(k) for k in page_key])
    stops = p.filter(F.size("_recs") == 0).groupBy(endpoint).agg(F.min(key).alias("_stop"))
    kept = p.join(stops, endpoint, "left").filter(F.col("_stop").isNull() | (key < F.col("_stop")))
    return kept.select(endpoint, *page_key, F.posexplode("_recs").alias("position", RECORD))


def melt_panel(df: DataFrame, id_cols: list[str], value_cols: list[str], sep: str = "|") -> DataFrame:
    """SRC-12: a wide price panel whose columns are ``<field><sep><ticker>``
    -> long rows (ids..., ticker, one column per field).

    Every row yields its tickers by itself (``inline``), so nothing is shuffled and repeated
    ids stay rows of their own; a field that a ticker has no column for is NULL.
    """
    dtype = dict(df.dtypes)
    parts = {c: c.split(sep, 1) for c in value_cols}
    fields = sorted({f for f, _ in parts.values()})
    kind = {f: next(dtype[c] for c in value_cols if parts[c][0] == f) for f in fields}
    column = {(t, f): c for c, (f, t) in parts.items()}
    rows = [
        F.struct(F.lit(t).alias("ticker"), *[
            (F.col(f"`{column[t, f]}`") if (t, f) in column else F.lit(None)).cast(kind[f]).alias(f) for f in fields
        ])
        for t in sorted({t for t, _ in column})
    ]
    return df.select(*id_cols, F.inline(F.array(*rows)))


def flatten_search(df: DataFrame, json_col: str) -> DataFrame:
    """SRC-14: museum search payload -> (manifest_id, title, object_type,
    date, media_count, first_media_id); missing text -> ''."""
    doc = F.try_parse_json(F.col(json_col))
    media = F.try_variant_get(doc, "$.media", "array<variant>")

    def txt(p):
        return F.coalesce(F.try_variant_get(doc, p, "string"), F.lit(""))

    return df.select(
        txt("$.id").alias("manifest_id"),
        txt("$.title").alias("title"),
        txt("$.objectType").alias("object_type"),
        txt("$.date").alias("date"),
        F.coalesce(F.size(media), F.lit(0)).cast("int").alias("media_count"),
        F.coalesce(F.try_variant_get(F.try_element_at(media, F.lit(1)), "$.id", "string"), F.lit("")).alias("first_media_id"),
    )


def flatten_bindings(df: DataFrame, url_col: str, title_col: str, order_col: str) -> DataFrame:
    """SRC-15: result bindings -> (id = last URL path segment, title),
    de-duplicated by id keeping the first binding (smallest ``order_col``)."""
    ident = F.substring_index(F.regexp_replace(F.col(url_col), "/+$", ""), "/", -1)
    rows = df.select(ident.alias("id"), F.col(title_col).alias("title"), F.col(order_col).alias("_o"))
    return rows.groupBy("id").agg(F.min_by("title", "_o").alias("title"))


# ---------------------------------------------------------------- SRC-13
# Default markup of the comic page cards (fixed values): a card is a
# "tfs-comic js-comic" block, the image is its lazy-load <img> (data-src,
# alt) and the caption its <figcaption>.
CARD_BLOCK = r'(?is)<div\b[^>]*class="[^"]*\btfs-comic\b[^"]*"[^>]*>.*?</figure>'
IMG_SRC = r'(?is)<img\b[^>]*\bdata-src\s*=\s*"([^"]*)"'
IMG_ALT = r'(?is)<img\b[^>]*\balt\s*=\s*"([^"]*)"'
CAPTION = r"(?is)<figcaption\b[^>]*>(.*?)</figcaption>"


def extract_cards(pages: DataFrame, id_col: str, html_col: str, card: str = CARD_BLOCK, image: str = IMG_SRC,
                  alt: str = IMG_ALT, caption: str = CAPTION) -> DataFrame:
    """SRC-13: the ordered cards of a raw HTML page.

    Positions count every card of the page (1-based); a card without an
    image URL is skipped but keeps its slot, so positions show the gap.
    Alt text and caption are trimmed, blank -> NULL, tags stripped from the
    caption.  All with built-in regex functions, one pass per page row.
    """
    blocks = F.regexp_extract_all(F.col(html_col), F.lit(card), 0)
    cards = pages.select(id_col, F.posexplode(blocks).alias("_pos", "_block"))

    def blank_null(c):
        return F.nullif(F.trim(c), F.lit(""))

    out = cards.select(
        id_col,
        (F.col("_pos") + 1).alias("position"),
        blank_null(F.regexp_extract("_block", image, 1)).alias("image_url"),
        blank_null(F.regexp_extract("_block", alt, 1)).alias("alt_text"),
        blank_null(F.regexp_replace(F.regexp_extract("_block", caption, 1), "<[^>]*>", "")).alias("caption"),
    )
    return out.filter(F.col("image_url").isNotNull())
