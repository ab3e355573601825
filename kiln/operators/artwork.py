"""Museum manifest parsing (ART-*).

A manifest is one JSON document per row.  Every field is derived inside the
row with VARIANT navigation and array higher-order functions (``transform``,
``filter``, ``aggregate``), so parsing needs no shuffle at all: a manifest's
metadata list is part of its own row and never grouped with other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.operators.sinks import insert_ignore

BASE_URL = "https://ids.si.edu"
IMAGE_SUFFIX = "/full/full/0/default.jpg"

# Metadata label synonyms (lower-cased) -> artwork column.
LABEL_MAP = {
    "title": "title",
    "artist": "artist",
    "maker": "artist",
    "creator": "artist",
    "medium": "medium",
    "technique": "medium",
    "material and technique": "medium",
    "dimensions": "dimensions_text",
    "measurements": "dimensions_text",
    "date": "date_text",
    "date created": "date_text",
    "period": "period",
    "dynasty": "period",
    "place of origin": "origin",
    "origin": "origin",
    "geography": "origin",
    "object type": "artwork_type",
    "type": "artwork_type",
    "classification": "artwork_type",
    "description": "description",
    "summary": "description",
    "collection": "collection",
    "data source": "data_source",
    "museum": "data_source",
    "repository": "data_source",
    "credit line": "credit_line",
    "credit": "credit_line",
    "accession number": "accession_number",
    "id number": "accession_number",
    "artist/maker": "artist",
    "material": "medium",
    "rights statement": "metadata_usage",
    "metadata usage": "metadata_usage",
}
MAPPED_COLUMNS = sorted(set(LABEL_MAP.values()))
LOCATION_CLASS = "Provenance Location Statement"
BIOGRAPHY_CLASS = "Provenance Biography"


def _label_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in LABEL_MAP.items() for x in kv])


def _first(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(1))


def _last(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(-1))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def norm_value(v: Column, text: Column | None = None) -> Column:
    """ART-03: list -> non-empty parts joined by '; ' (language objects give
    their '@value'); object -> its '@value'; scalar -> text; blank -> NULL.

    ``text`` is the value cast to string when the caller already has it.
    Plain scalars (text not starting with '[' or '{') skip the structural
    checks entirely."""
    if text is None:
        text = F.try_variant_get(v, "$", "string")
    arr = F.try_variant_get(v, "$", "array<variant>")
    parts = F.transform(
        arr,
        lambda x: F.when(_is_object(x), F.coalesce(F.try_variant_get(x, "$['@value']", "string"), F.lit("")))
        .otherwise(F.coalesce(F.try_variant_get(x, "$", "string"), F.lit(""))),
    )
    joined = F.array_join(F.filter(parts, lambda p: p != ""), "; ")
    obj = F.coalesce(F.try_variant_get(v, "$['@value']", "string"), F.lit(""))
    structural = F.when(arr.isNotNull(), joined).when(_is_object(v), obj).otherwise(text)
    head = F.substring(F.ltrim(text), 1, 1)
    out = F.when(F.coalesce(~head.isin("[", "{"), F.lit(False)), text).otherwise(structural)
    return F.nullif(F.trim(out), F.lit(""))


MANIFEST_SCHEMA = (
    "struct<`@id`: string, label: variant, description: variant, attribution: variant, license: string, "
    "seeAlso: variant, sequences: variant, metadata: array<struct<label: string, value: variant>>>"
)


def parse_manifest_doc(text: Column) -> Column:
    """One typed parse of a manifest: the fixed top-level fields typed, the
    heterogeneous ones kept as VARIANT."""
    return F.from_json(text, MANIFEST_SCHEMA)


def metadata_items(metadata: Column) -> Column:
    """ARRAY<STRUCT<label, key, value>> from a parsed metadata list: the
    trimmed label, its lower-cased key and the normalised value."""
    items = F.coalesce(metadata, F.array().cast("array<struct<label: string, value: variant>>"))
    s1 = F.transform(items, lambda x: F.struct(F.trim(F.coalesce(x["label"], F.lit(""))).alias("label"), x["value"].alias("v"),
                                               F.try_variant_get(x["value"], "$", "string").alias("text")))
    return F.transform(
        s1,
        lambda z: F.struct(z["label"].alias("label"), F.lower(z["label"]).alias("key"),
                           norm_value(z["v"], z["text"]).alias("value")),
    )


def map_labels(items: Column) -> dict[str, Column]:
    """ART-01: first non-empty value per target column (synonyms merged)."""
    lm = _label_map()

    def is_col(c):
        return lambda x: (F.try_element_at(lm, x["key"]) == F.lit(c)) & x["value"].isNotNull()

    return {col: _first(F.filter(items, is_col(col)))["value"] for col in MAPPED_COLUMNS}


def multi_values(items: Column, key: str) -> Column:
    """All non-empty values of one label, in order (ART-02)."""
    return F.transform(F.filter(items, lambda x: (x["key"] == key) & x["value"].isNotNull()), lambda x: x["value"])


def exhibitions(entries: Column) -> Column:
    """ART-05: 'Name (dates)' -> {name, dates}; no match -> dates NULL."""
    pat = r"^(.*?)\s*\(([^)]+)\)\s*$"
    return F.transform(
        entries,
        lambda e: F.when(
            e.rlike(pat),
            F.struct(F.trim(F.regexp_extract(e, pat, 1)).alias("name"), F.trim(F.regexp_extract(e, pat, 2)).alias("dates")),
        ).otherwise(F.struct(F.trim(e).alias("name"), F.lit(None).cast("string").alias("dates"))),
    )


def pg_array_literal(arr: Column) -> Column:
    """Text[] literal: '{"a","b"}' with '"' doubled; empty -> NULL."""
    quoted = F.transform(arr, lambda s: F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))
    return F.when(F.size(arr) > 0, F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}")))


def _profile(p: Column) -> Column:
    arr = F.try_variant_get(p, "$", "array<variant>")
    first_useful = _first(
        F.filter(
            F.transform(
                arr,
                lambda x: F.when(_is_object(x), F.try_variant_get(x, "$['@id']", "string")).otherwise(
                    F.try_variant_get(x, "$", "string")
                ),
            ),
            lambda s: s.isNotNull(),
        )
    )
    return F.when(arr.isNotNull(), first_useful).when(~_is_object(p), F.nullif(F.try_variant_get(p, "$", "string"), F.lit("")))


def _see_also(s: Column) -> Column:
    arr = F.try_variant_get(s, "$", "array<variant>")
    first = F.try_variant_get(s, "$[0]", "variant")
    from_list = F.when(_is_object(first), F.try_variant_get(first, "$['@id']", "string")).otherwise(
        F.try_variant_get(first, "$", "string"))
    return (
        F.when(arr.isNotNull(), F.when(F.size(arr) > 0, from_list))
        .when(_is_object(s), F.try_variant_get(s, "$['@id']", "string"))
        .otherwise(F.try_variant_get(s, "$", "string"))
    )


def parse_manifests(df: DataFrame, json_col: str, keep: list[str] | None = None) -> DataFrame:
    """One artwork row per manifest document (ART-01..05 together)."""
    # Each stage is its own projection so the parsed document and the item
    # list are computed once per row and then referenced, not re-derived.
    base = df.select(*(keep or []), parse_manifest_doc(F.col(json_col)).alias("_doc"))
    base = base.select(*(keep or []), "_doc", metadata_items(F.col("_doc.metadata")).alias("_items"))
    d = F.col("_doc")
    items = F.col("_items")
    mapped = map_labels(items)
    manifest_id = F.substring_index(F.regexp_replace(F.coalesce(d["@id"], F.lit("")), "/+$", ""), "/", -1)
    canvas = F.try_variant_get(d["sequences"], "$[0].canvases[0]", "variant")
    resource = F.try_variant_get(canvas, "$.images[0].resource", "variant")
    service = F.try_variant_get(resource, "$.service['@id']", "string")
    fallback_service = F.concat(F.lit(BASE_URL + "/ids/iiif/"), manifest_id)
    has_service = service.isNotNull()
    topics = multi_values(items, "topic")
    exh = exhibitions(multi_values(items, "exhibition history"))
    out = base.select(
        *(keep or []),
        manifest_id.alias("manifest_id"),
        F.coalesce(d["@id"], F.concat(F.lit(BASE_URL + "/ids/manifest/"), manifest_id)).alias("manifest_url"),
        F.coalesce(mapped["title"], norm_value(d["label"]), F.lit("")).alias("title"),
        *[mapped[c].alias(c) for c in MAPPED_COLUMNS if c not in ("title", "description")],
        F.coalesce(mapped["description"], norm_value(d["description"])).alias("description"),
        _last(multi_values(items, "guid")).alias("ark_guid"),
        F.when(F.size(topics) > 0, topics).alias("topics"),
        pg_array_literal(topics).alias("topics_literal"),
        F.when(F.size(exh) > 0, exh).alias("exhibitions"),
        F.when(F.size(exh) > 0, F.to_json(exh)).alias("exhibition_history"),
        F.when(has_service, service).when(F.length(manifest_id) > 0, fallback_service).alias("iiif_service_url"),
        _profile(F.try_variant_get(resource, "$.service.profile", "variant")).alias("iiif_profile"),
        F.when(has_service, F.concat(service, F.lit(IMAGE_SUFFIX)))
        .when(F.length(manifest_id) > 0, F.concat(fallback_service, F.lit(IMAGE_SUFFIX)))
        .otherwise(F.try_variant_get(resource, "$['@id']", "string")).alias("image_url"),
        F.try_variant_get(canvas, "$.width", "int").alias("image_width"),
        F.try_variant_get(canvas, "$.height", "int").alias("image_height"),
        F.lit("image/jpeg").alias("image_format"),
        _see_also(d["seeAlso"]).alias("api_url"),
        norm_value(d["attribution"]).alias("attribution"),
        d["license"].alias("license_url"),
        F.to_json(d["metadata"]).alias("raw_metadata"),
    )
    return out


# ---------------------------------------------------------------- ART-06
def _plain_number(digits: Column) -> Column:
    """Digits without leading zeros: equal as numbers of any length."""
    return F.regexp_replace(digits, "^0+(?=.)", "")


def provenance_chain(df: DataFrame, json_col: str, keep: list[str]) -> DataFrame:
    """ART-06: 'Provenance' entries before 'Notes:' pair up as (date header,
    holder detail); an odd trailing entry is ignored; '[n]' markers are
    stripped from the holder and resolved against the footnotes after
    'Notes:' (a repeated footnote number: the later one wins), joined by '; '.
    One output row per pair, exploded from the row's own array."""
    meta = F.from_json(F.col(json_col), "struct<metadata: array<struct<label: string, value: variant>>>")
    staged = df.select(*keep, meta.alias("_doc"))
    # only the 'Provenance' items are normalised (a manifest has many others)
    prov = F.filter(F.coalesce(F.col("_doc.metadata"), F.array().cast("array<struct<label: string, value: variant>>")),
                    lambda x: F.trim(F.coalesce(x["label"], F.lit(""))) == "Provenance")
    staged = staged.select(*keep, metadata_items(prov).alias("_items"))
    staged = staged.select(*keep, F.transform(
        F.filter("_items", lambda x: x["value"].isNotNull()), lambda x: x["value"]
    ).alias("_entries"))
    df = staged
    entries = F.col("_entries")
    notes_at = F.array_position(F.transform(entries, lambda e: F.trim(e)), "Notes:")
    n = F.size(entries)
    chain = F.when(notes_at > 0, F.slice(entries, 1, notes_at - 1)).otherwise(entries)
    notes = F.when(notes_at > 0, F.slice(entries, notes_at + 1, n)).otherwise(F.array().cast("array<string>"))
    foot_pat = r"^\[(\d+)\]\s*(.*)"
    footnotes = F.transform(
        F.filter(notes, lambda e: e.rlike(foot_pat)),
        lambda e: F.struct(_plain_number(F.regexp_extract(e, foot_pat, 1)).alias("k"),
                           F.trim(F.regexp_extract(e, foot_pat, 2)).alias("v")),
    )
    base = df.select(*keep, chain.alias("_chain"), footnotes.alias("_fn"))
    pairs = F.when(F.size("_chain") >= 2, F.sequence(F.lit(0), F.floor((F.size("_chain") - 2) / 2).cast("int")))
    rows = base.select(*keep, "_chain", "_fn", F.explode(pairs).alias("_k"))
    detail = F.element_at("_chain", F.col("_k") * 2 + 2)
    refs = F.transform(F.regexp_extract_all(detail, F.lit(r"\[(\d+)\]"), 1), _plain_number)
    resolved = F.filter(
        F.transform(refs, lambda r: _last(F.filter(F.col("_fn"), lambda f: f["k"] == r))["v"]),
        lambda v: v.isNotNull(),
    )
    return rows.select(
        *keep,
        (F.col("_k") + 1).cast("int").alias("sequence_order"),
        F.trim(F.regexp_replace(detail, r"\s*\[\d+\]", "")).alias("holder_name"),
        F.element_at("_chain", F.col("_k") * 2 + 1).alias("holder_dates"),
        F.lit(None).cast("string").alias("location"),
        F.nullif(F.array_join(resolved, "; "), F.lit("")).alias("acquisition_notes"),
    )


# ---------------------------------------------------------------- ART-07
def ownership(df: DataFrame, json_col: str, keep: list[str]) -> DataFrame:
    """ART-07: linked-art ownership list -> ordered rows: holder label, first
    time-span text, location / biography notes by class (later note of a
    class wins)."""
    doc = F.try_parse_json(F.col(json_col))
    acqs = F.coalesce(F.try_variant_get(doc, "$.changed_ownership_through", "array<variant>"),
                      F.array().cast("array<variant>"))
    rows = df.select(*keep, F.posexplode(acqs).alias("_pos", "_acq"))
    a = F.col("_acq")
    notes = F.transform(
        F.coalesce(F.try_variant_get(a, "$.part_of[0].referred_to_by", "array<variant>"), F.array().cast("array<variant>")),
        lambda x: F.struct(
            F.coalesce(F.try_variant_get(x, "$.classified_as[0]._label", "string"), F.lit("")).alias("cls"),
            F.coalesce(F.try_variant_get(x, "$.content", "string"), F.lit("")).alias("content"),
        ),
    )

    def by_class(c):
        return _last(F.filter(notes, lambda x: x["cls"] == c))["content"]

    return rows.select(
        *keep,
        (F.col("_pos") + 1).cast("int").alias("sequence_order"),
        F.coalesce(F.try_variant_get(a, "$.transferred_title_to[0]._label", "string"), F.lit("")).alias("holder_name"),
        F.try_variant_get(a, "$.part_of[0].timespan.identified_by[0].content", "string").alias("holder_dates"),
        by_class(LOCATION_CLASS).alias("location"),
        by_class(BIOGRAPHY_CLASS).alias("acquisition_notes"),
    )


# ---------------------------------------------------------------- ART-08
def load_provenance(artworks: DataFrame, provenance: DataFrame, existing: DataFrame, manifest_key: str = "manifest_id",
                    artwork_key: str = "artwork_id", order: str | None = None) -> DataFrame:
    """ART-08: attach parsed provenance rows to their parent artwork by
    manifest id (one join instead of a lookup per record); rows whose parent
    is missing are skipped; rows already stored for (artwork, sequence) are
    ignored (insert-if-absent).  Returns the rows to append."""
    parents = artworks.select(F.col(manifest_key).alias("_mid"), F.col(artwork_key))
    j = provenance.join(parents, F.col(manifest_key) == F.col("_mid"), "inner").drop("_mid")
    cols = [artwork_key, "sequence_order", "holder_name", "holder_dates", "location", "acquisition_notes"]
    rows = j.select(*cols, *([order] if order else []))
    return insert_ignore(existing, rows, [artwork_key, "sequence_order"], order=order).select(*cols)
