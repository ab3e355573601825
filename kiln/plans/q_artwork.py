"""ART-* queries: one museum manifest document per ``part`` row."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.operators import artwork as A
from kiln.plans import common as C
from kiln.plans.registry import query


def _item(label, value_json):
    return F.concat(F.lit(f'{{"label":"{label}","value":'), value_json, F.lit("}"))


def _js(c):
    """JSON string literal of a column."""
    j = F.to_json(F.array(c))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def _manifests(t):
    p = C.spread(t.part)  # a million parts are a few MB, one or two tasks
    pk = F.col("p_partkey").cast("string")
    w1 = F.split("p_name", " ")[0]
    w2 = F.try_element_at(F.split("p_name", " "), F.lit(2))
    items = [
        _item("Title", _js(F.col("p_name"))),
        _item("Maker", _js(F.col("p_brand"))),
        _item("Artist", _js(F.col("p_type"))),
        _item("Medium", F.concat(F.lit('[{"@value":'), _js(F.col("p_type")), F.lit('},"ink",""]'))),
        _item("Dimensions", F.concat(F.lit('{"@value":'), _js(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" cm "))), F.lit("}"))),
        _item("Date", F.lit('""')),
        _item("Topic", _js(w1)),
        _item("topic", F.coalesce(_js(w2), F.lit("null"))),
        _item("Exhibition History", _js(F.concat(F.col("p_brand"), F.lit(" Show (19"), F.col("p_size").cast("string"), F.lit(")")))),
        _item("Exhibition History", F.lit('"Untitled"')),
        _item("GUID", _js(F.concat(F.lit("ark:/a"), pk))),
        _item("GUID", _js(F.concat(F.lit("ark:/b"), pk))),
        _item("Credit Line", _js(F.concat(F.lit("Gift of "), F.col("p_brand")))),
        _item("Accession Number", F.col("p_size").cast("string")),
    ]
    service = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('"https://ids.si.edu/ids/iiif/S'), pk, F.lit('"'))).otherwise(F.lit("null"))
    see_also = (
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit('[{"@id":"https://api/'), pk, F.lit('"}]')))
        .when(F.col("p_size") % 3 == 1, F.concat(F.lit('{"@id":"https://api/'), pk, F.lit('"}')))
        .otherwise(F.concat(F.lit('"https://api/'), pk, F.lit('"')))
    )
    doc = F.concat(
        F.lit('{"@id":"https://ids.si.edu/ids/manifest/FS-'), pk, F.lit('/"'),
        F.lit(',"label":'), _js(F.col("p_name")),
        F.lit(',"metadata":['), F.concat_ws(",", *items), F.lit("]"),
        F.lit(',"sequences":[{"canvases":[{"width":'), (F.col("p_size") * 10).cast("string"),
        F.lit(',"height":'), (F.col("p_size") * 20).cast("string"),
        F.lit(',"images":[{"resource":{"@id":"img-'), pk, F.lit('","service":{"@id":'), service,
        F.lit(',"profile":["http://iiif.io/api/image/2/level1.json",{"@id":"x"}]}}}]}]}]'),
        F.lit(',"seeAlso":'), see_also,
        F.lit(',"attribution":[{"@value":"Smithsonian"},{"@value":""}]'),
        F.lit(',"license":"http://rights/'), F.col("p_brand"), F.lit('"}'),
    )
    return p.select("p_partkey", doc.alias("manifest"))


def _parsed(spark, d):
    return A.parse_manifests(_manifests(C.TW(spark, d)), "manifest", ["p_partkey"])


@query(
    "art_labels",
    """
SELECT p_partkey, 'FS-' || p_partkey AS manifest_id, p_name AS title, p_brand AS artist, p_type || '; ink' AS medium,
       CAST(p_size AS VARCHAR) || ' cm' AS dimensions_text, CAST(NULL AS VARCHAR) AS date_text,
       'Gift of ' || p_brand AS credit_line, CAST(p_size AS VARCHAR) AS accession_number
FROM part""",
)
def art_labels(spark, d):
    return _parsed(spark, d).select("p_partkey", "manifest_id", "title", "artist", "medium", "dimensions_text",
                                    "date_text", "credit_line", "accession_number")


@query(
    "art_topics",
    """
SELECT p_partkey, list_filter([string_split(p_name, ' ')[1], string_split(p_name, ' ')[2]], lambda x: x IS NOT NULL AND x <> '') AS topics,
       'ark:/b' || p_partkey AS ark_guid
FROM part""",
)
def art_topics(spark, d):
    return _parsed(spark, d).select("p_partkey", "topics", "ark_guid")


@query(
    "art_norm_value",
    "SELECT p_partkey, p_type || '; ink' AS medium, CAST(p_size AS VARCHAR) || ' cm' AS dimensions_text, "
    "'Smithsonian' AS attribution, p_name AS title FROM part",
)
def art_norm_value(spark, d):
    return _parsed(spark, d).select("p_partkey", "medium", "dimensions_text", "attribution", "title")


@query(
    "art_image",
    """
SELECT p_partkey,
  CASE WHEN p_size % 2 = 0 THEN 'https://ids.si.edu/ids/iiif/S' || p_partkey ELSE 'https://ids.si.edu/ids/iiif/FS-' || p_partkey END AS iiif_service_url,
  'http://iiif.io/api/image/2/level1.json' AS iiif_profile,
  CASE WHEN p_size % 2 = 0 THEN 'https://ids.si.edu/ids/iiif/S' || p_partkey ELSE 'https://ids.si.edu/ids/iiif/FS-' || p_partkey END
    || '/full/full/0/default.jpg' AS image_url,
  p_size * 10 AS image_width, p_size * 20 AS image_height, 'https://api/' || p_partkey AS api_url,
  'http://rights/' || p_brand AS license_url
FROM part""",
)
def art_image(spark, d):
    return _parsed(spark, d).select("p_partkey", "iiif_service_url", "iiif_profile", "image_url", "image_width",
                                    "image_height", "api_url", "license_url")


@query(
    "art_exhibitions",
    """
SELECT p_partkey, 1 AS pos, p_brand || ' Show' AS name, '19' || p_size AS dates FROM part
UNION ALL SELECT p_partkey, 2, 'Untitled', NULL FROM part""",
)
def art_exhibitions(spark, d):
    p = _parsed(spark, d)
    return p.select("p_partkey", F.posexplode("exhibitions").alias("pos", "e")).select(
        "p_partkey", (F.col("pos") + 1).alias("pos"), "e.name", "e.dates")


def _provenance_docs(t):
    li = t.lineitem
    y = F.year("l_shipdate").cast("string")
    no_notes = F.col("l_returnflag") == "A"
    ents = [
        F.concat(F.lit("From "), y),
        F.concat(F.lit("Holder "), F.col("l_partkey").cast("string"), F.lit(" [1]")),
        F.concat(F.lit("To "), y),
        F.concat(F.lit("Dealer "), F.col("l_suppkey").cast("string"), F.lit(" [2] [3]")),
        F.lit("odd trailing entry"),
    ]
    notes = [
        F.lit("Notes:"),
        F.concat(F.lit("[1] first note "), F.col("l_orderkey").cast("string")),
        F.lit("[2] early"),
        F.concat(F.lit("[2] late "), F.col("l_linenumber").cast("string")),
        F.lit("[9] unused"),
    ]

    def item(c):
        return F.concat(F.lit('{"label":"Provenance","value":'), _js(c), F.lit("}"))

    body = F.concat_ws(",", *[item(c) for c in ents])
    tail = F.concat_ws(",", *[item(c) for c in notes])
    meta = F.when(no_notes, body).otherwise(F.concat(body, F.lit(","), tail))
    doc = F.concat(F.lit('{"metadata":[{"label":"Title","value":"x"},'), meta, F.lit("]}"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", doc.alias("manifest"))


@query(
    "art_provenance",
    """
SELECT l_orderkey, l_linenumber, 1 AS sequence_order, 'Holder ' || l_partkey AS holder_name,
       'From ' || year(l_shipdate) AS holder_dates, CAST(NULL AS VARCHAR) AS location,
       CASE WHEN l_returnflag = 'A' THEN NULL ELSE 'first note ' || l_orderkey END AS acquisition_notes
FROM lineitem
UNION ALL
SELECT l_orderkey, l_linenumber, 2, 'Dealer ' || l_suppkey, 'To ' || year(l_shipdate), NULL,
       CASE WHEN l_returnflag = 'A' THEN NULL ELSE 'late ' || l_linenumber END
FROM lineitem""",
)
def art_provenance(spark, d):
    docs = _provenance_docs(C.TW(spark, d))
    return A.provenance_chain(docs, "manifest", ["l_orderkey", "l_linenumber"])


def _linked_art(t):
    o = t.orders

    def note(cls, content):
        return F.concat(F.lit('{"classified_as":[{"_label":"'), F.lit(cls), F.lit('"}],"content":'), _js(content), F.lit("}"))

    acq1 = F.concat(
        F.lit('{"transferred_title_to":[{"_label":'), _js(F.concat(F.lit("cust "), F.col("o_custkey").cast("string"))),
        F.lit('}],"part_of":[{"timespan":{"identified_by":[{"content":'), _js(F.date_format("o_orderdate", "yyyy")),
        F.lit('},{"content":"ignored"}]},"referred_to_by":['),
        note(A.LOCATION_CLASS, F.lit("old place")), F.lit(","),
        note(A.LOCATION_CLASS, F.col("o_orderpriority")), F.lit(","),
        note(A.BIOGRAPHY_CLASS, F.col("o_orderstatus")), F.lit("]}]}"),
    )
    acq2 = F.lit('{"transferred_title_to":[],"part_of":[]}')
    doc = F.concat(F.lit('{"changed_ownership_through":['), acq1, F.lit(","), acq2, F.lit("]}"))
    return o.select("o_orderkey", doc.alias("linked_art"))


@query(
    "art_ownership",
    """
SELECT o_orderkey, 1 AS sequence_order, 'cust ' || o_custkey AS holder_name, strftime(o_orderdate, '%Y') AS holder_dates,
       o_orderpriority AS location, o_orderstatus AS acquisition_notes FROM orders
UNION ALL
SELECT o_orderkey, 2, '', NULL, NULL, NULL FROM orders""",
)
def art_ownership(spark, d):
    return A.ownership(_linked_art(C.TW(spark, d)), "linked_art", ["o_orderkey"])


@query(
    "art_load",
    """
WITH prov AS (
  SELECT 'M' || l_orderkey AS manifest_id, l_linenumber AS sequence_order, 'Holder ' || l_partkey AS holder_name,
         'From ' || year(l_shipdate) AS holder_dates, l_returnflag AS acquisition_notes FROM lineitem),
firsts AS (SELECT manifest_id, sequence_order,
                  arg_min(holder_name, holder_name || '|' || holder_dates || '|' || acquisition_notes) AS holder_name,
                  arg_min(holder_dates, holder_name || '|' || holder_dates || '|' || acquisition_notes) AS holder_dates,
                  arg_min(acquisition_notes, holder_name || '|' || holder_dates || '|' || acquisition_notes) AS acquisition_notes
           FROM prov GROUP BY ALL),
parents AS (SELECT 'M' || o_orderkey AS manifest_id, o_orderkey AS artwork_id FROM orders WHERE o_orderstatus <> 'P'),
rows AS (SELECT p.artwork_id, f.sequence_order, f.holder_name, f.holder_dates, CAST(NULL AS VARCHAR) AS location,
                f.acquisition_notes FROM firsts f JOIN parents p USING (manifest_id))
SELECT * FROM rows r
WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = r.artwork_id AND x.l_linenumber = r.sequence_order
                  AND x.l_returnflag = 'R')""",
)
def art_load(spark, d):
    t = C.TW(spark, d)
    li = t.lineitem
    prov = li.select(
        F.concat(F.lit("M"), F.col("l_orderkey").cast("string")).alias("manifest_id"),
        F.col("l_linenumber").alias("sequence_order"),
        F.concat(F.lit("Holder "), F.col("l_partkey").cast("string")).alias("holder_name"),
        F.concat(F.lit("From "), F.year("l_shipdate").cast("string")).alias("holder_dates"),
        F.lit(None).cast("string").alias("location"),
        F.col("l_returnflag").alias("acquisition_notes"),
    )
    parents = t.orders.filter(F.col("o_orderstatus") != "P").select(
        F.concat(F.lit("M"), F.col("o_orderkey").cast("string")).alias("manifest_id"), F.col("o_orderkey").alias("artwork_id"))
    existing = li.filter(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("artwork_id"), F.col("l_linenumber").alias("sequence_order")).distinct()
    # duplicates inside the batch: the first arrival is the smallest (holder, dates, notes)
    arrival = F.concat_ws("|", "holder_name", "holder_dates", "acquisition_notes")
    return A.load_provenance(parents, prov.withColumn("_arrival", arrival), existing, order="_arrival")
