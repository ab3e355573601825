"""Unit tests of operator semantics on small inline frames (golden values
follow the behaviour documented for the reference's transforms)."""

from __future__ import annotations

import datetime as dt
import fnmatch
import random
import re
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kiln.functions import scalars as S
from kiln.operators import artwork as A
from kiln.operators import feeds as FD
from kiln.operators import reports as R
from kiln.operators import schema as P
from kiln.operators import sinks as K
from kiln.sources import payloads as PL


# ---------------------------------------------------------------- names, globs
@pytest.mark.parametrize(
    "raw,clean",
    [("Product Name", "product_name"), ("123numeric", "col_123numeric"), ("  Price ($) ", "price"),
     ("a--b__c", "a_b_c"), ("Größe", "größe"), ("x.y", "x_y")],
)
def test_sanitize_name(raw, clean):
    assert P.sanitize_name(raw) == clean


def test_sanitize_errors(spark):
    with pytest.raises(ValueError, match="empty"):
        P.sanitize_name("!!!")
    df = spark.createDataFrame([(1, 2)], "`A B` int, `a_b` int")
    with pytest.raises(ValueError, match="both sanitise"):
        P.sanitize_columns(df)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab.*?[]!_x1", max_size=8), st.text(alphabet="ab.x1-_", max_size=8))
def test_glob_translation_matches_fnmatch(pattern, name):
    assert bool(re.match(S.glob_to_regex(pattern), name)) == fnmatch.fnmatchcase(name, pattern)


def test_glob_and_regex_on_spark(spark):
    df = spark.createDataFrame([("report_1.pdf",), ("data.csv",), (".hidden",), ("x.tmp",)], "n string")
    got = {r.n: r.g for r in df.select("n", S.glob_test("n", "*.pdf").alias("g")).collect()}
    assert got == {"report_1.pdf": True, "data.csv": False, ".hidden": False, "x.tmp": False}
    bad = df.select(S.regex_test("n", "([bad").alias("r")).first().r
    assert bad.is_valid is False and bad.error.startswith("Invalid regex")
    ok = df.select(S.regex_test("n", r"(\w+)_(\d)").alias("r")).collect()[0].r
    assert ok.matches and ok.match_text == "report_1" and ok.groups == ["report", "1"]


# ---------------------------------------------------------------- scalars
def test_parse_and_format(spark):
    df = spark.createDataFrame(
        [("2026-01-15", "1,000,000", 5.0), ("", "999,500.50", 75.0), ("bad", "n/a", 4500.0), (None, None, None)],
        "d string, n string, s double",
    )
    rows = df.select(S.parse_date("d").alias("d"), S.parse_numeric("n").alias("n"),
                     S.format_duration("s").alias("f")).collect()
    assert [r.d for r in rows] == [dt.date(2026, 1, 15), None, None, None]
    assert [r.n for r in rows] == [1000000.0, 999500.5, None, None]
    assert [r.f for r in rows] == ["5.0s", "1m 15s", "1h 15m", "N/A"]


def test_first_truthy_and_truncate(spark):
    df = spark.createDataFrame([("", "b", 0.0, 2.0), ("a", "b", 1.5, 2.0), (None, None, None, None)],
                               "a string, b string, x double, y double")
    r = df.select(S.first_truthy("a", "b").alias("s"), S.first_truthy("x", "y").alias("n")).collect()
    assert [(x.s, x.n) for x in r] == [("b", 2.0), ("a", 1.5), (None, None)]
    t = spark.createDataFrame([("abcdefghij",), ("abc",)], "t string").select(S.truncate_text("t", 8).alias("t"))
    assert [x.t for x in t.collect()] == ["abcde...", "abc"]


def test_array_literal_doubles_quotes(spark):
    df = spark.createDataFrame([(["landscape", 'say "hi"'],)], "a array<string>")
    assert df.select(S.array_literal("a").alias("x")).first().x == '{"landscape","say ""hi"""}'


# ---------------------------------------------------------------- inference
@pytest.mark.parametrize(
    "values,expected",
    [
        (["1", "abc"], "INTEGER"),  # non-numeric text ignored once a number is seen
        (["100.00", "7"], "INTEGER"),  # integral floats count as integers
        (["t", "FALSE"], "BOOLEAN"),
        (["true", "1"], "INTEGER"),
        (["1.5", "2"], "NUMERIC(12,2)"),
        (["3000000000"], "BIGINT"),
        ([None, ""], "TEXT"),
        (["x" * 60], "VARCHAR(100)"),
        (["x" * 300], "TEXT"),
        (["hello"], "VARCHAR(50)"),
    ],
)
def test_infer_types_ladder(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    assert P.infer_types(df).first().inferred_type == expected


# ---------------------------------------------------------------- alignment
def test_strategies(spark):
    target = spark.createDataFrame([], "id int, name string").schema
    src = spark.createDataFrame([(1, "a", "x")], "id int, name string, extra string")
    rows, evolved = P.align_auto_add(src, target)
    assert evolved.fieldNames() == ["id", "name", "extra"] and rows.first().extra == "x"
    assert P.align_ignore_extra(src, target).columns == ["id", "name"]
    with pytest.raises(ValueError, match="extra"):
        P.align_strict(src, target)
    assert P.align_strict(src.drop("extra"), target).count() == 1


def test_convert_keeps_original_on_failure(spark):
    df = spark.createDataFrame([("12.5",), ("abc",), (None,)], "v string")
    out = P.convert(df, {"v": "double"}).collect()
    assert [(r.v, r.v__raw) for r in out] == [(12.5, None), (None, "abc"), (None, None)]


# ---------------------------------------------------------------- payloads and feeds
def _records(spark, payload: str, path: str):
    return PL.extract_path(spark.createDataFrame([(payload,)], "payload string"), "payload", path)


def test_extract_path_shapes(spark):
    def n(doc, path="data.results.items"):
        return _records(spark, doc, path).count()

    assert n('{"data":{"results":{"items":[{"id":1,"value":"a"},{"id":2,"value":"b"}]}}}') == 2
    assert n('{"data":{"results":{"items":{"id":1}}}}') == 1
    assert n('{"data":{"results":{"items":7}}}') == 1
    assert n('{"data":{"results":[]}}') == 0
    assert n('{"data":1}') == 0
    assert n("not json") == 0


def test_null_suppressed(spark):
    df = spark.createDataFrame([('{"a": *, "b": [1, * ], "c": "*x"}',)], "t string")
    fixed = df.select(PL.null_suppressed("t").alias("t")).first().t
    # only object values are suppressed; array elements and text are kept
    assert fixed == '{"a": null, "b": [1, * ], "c": "*x"}'


def test_feed_golden_values(spark):
    soma = FD.soma_holdings(_records(spark, '{"soma":{"holdings":[{"asOfDate":"2026-01-01","cusip":"912828ZZ1",'
                                             '"parValue":"1,000,000","currentFaceValue":"999,500.50"}]}}',
                                    "soma.holdings")).first()
    assert soma.par_value == Decimal("1000000.00") and soma.current_face_value == Decimal("999500.50")
    repo = FD.repo_operations(_records(spark, '{"repo":{"operations":[{"operationType":"Reverse Repo",'
                                             '"operationDate":"2026-01-02","termCalenderDays":1}]}}',
                                      "repo.operations")).first()
    assert repo.operation_type == "reverserepo" and repo.award_rate is None
    fx = FD.fx_swaps(_records(spark, '{"fxSwaps":{"operations":[{"operationDate":"2026-01-01","maturityDate":'
                                     '"2026-01-08","currency":"EUR","usdAmount":100.5}]}}', "fxSwaps.operations")).first()
    assert fx.term_days == 7 and fx.currency_code == "EUR" and fx.swap_date == dt.date(2026, 1, 1)
    sl = FD.securities_lending(_records(spark, '{"seclending":{"operations":[{"loanDate":"2026-01-02",'
                                              '"returnDate":"2026-01-04","totalParAmtAccepted":0,"parAmount":5}]}}',
                                       "seclending.operations")).first()
    assert sl.term_days == 2 and sl.par_amount == Decimal("5.00")
    rr = FD.reference_rates(_records(spark, '{"refRates":[{"type":"SOFR","effectiveDate":"2026-01-02",'
                                            '"percentRate":5.31},{"type":"EFFR"}]}', "refRates"))
    assert [r.rate_type for r in rr.collect()] == ["SOFR"]


def test_guide_sheets_use_first_object_only(spark):
    doc = ('{"guidesheet":{"si":[{"reportWeeksFromDate":"2026-01-05","title":"SI","details":['
           '{"secType":"Note","cusip":"A"},{"secType":"Bond","cusip":"B"}]},'
           '{"reportWeeksFromDate":"2026-02-05","details":[{"cusip":"C"}]}]}}')
    out = FD.guide_sheets(spark.createDataFrame([(doc,)], "p string"), "p").collect()
    assert [(r.cusip, r.publication_date, r.guide_type) for r in out] == [
        ("A", dt.date(2026, 1, 5), "SI"), ("B", dt.date(2026, 1, 5), "SI")]
    no_date = '{"guidesheet":{"si":[{"details":[{"cusip":"A"}]}]}}'
    assert FD.guide_sheets(spark.createDataFrame([(no_date,)], "p string"), "p").count() == 0


def test_sonia_parses_day_month_year(spark):
    recs = spark.createDataFrame([('{"date":"02 Jan 2026","rate":"4.7012"}',), ('{"date":"03 Jan 2026","rate":"n/a"}',)],
                                 "payload string")
    out = FD.sonia_rates(PL.extract_path(recs, "payload", "")).collect()
    assert [(r.effective_date, r.rate_percent) for r in out] == [(dt.date(2026, 1, 2), Decimal("4.7012"))]


def test_ohlc_candles_grouped_by_coin(spark):
    ticks = spark.createDataFrame(
        [("btc", dt.datetime(2026, 1, 1, 23, 0), 1, 10.0), ("btc", dt.datetime(2026, 1, 2, 1, 0), 2, 12.0),
         ("btc", dt.datetime(2026, 1, 1, 12, 0), 3, 8.0)], "coin string, ts timestamp_ntz, id int, p double")
    p = F.col("p")
    r = FD.ohlc(ticks, ["coin"], "ts", "id", p, p, p, p).first()
    assert (r.open, r.high, r.low, r.close, r.price_date) == (
        Decimal("8.000000"), Decimal("12.000000"), Decimal("8.000000"), Decimal("12.000000"), dt.date(2026, 1, 2))


# ---------------------------------------------------------------- artwork
def test_norm_value_shapes(spark):
    docs = [
        '{"metadata":[{"label":"Medium","value":[{"@value":"ink"},{"@value":""},"silk"]}]}',
        '{"metadata":[{"label":"Medium","value":{"@value":"  paper "}}]}',
        '{"metadata":[{"label":"Medium","value":"  "}, {"label":"Technique","value":"oil"}]}',
    ]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id int, m string")
    out = {r.id: r.medium for r in A.parse_manifests(df, "m", ["id"]).collect()}
    assert out == {0: "ink; silk", 1: "paper", 2: "oil"}


def test_provenance_chain_golden(spark):
    doc = ('{"metadata":['
           '{"label":"Provenance","value":"To 1909"},'
           '{"label":"Provenance","value":"Charles Lang Freer, purchased in 1909 [1]"},'
           '{"label":"Provenance","value":"From 1909 to 1919"},'
           '{"label":"Provenance","value":"Freer Gallery of Art [2] [3]"},'
           '{"label":"Provenance","value":"trailing"},'
           '{"label":"Provenance","value":"Notes:"},'
           '{"label":"Provenance","value":"[1] See Original Panel List."},'
           '{"label":"Provenance","value":"[2] Transferred."}]}')
    out = A.provenance_chain(spark.createDataFrame([(1, doc)], "id int, m string"), "m", ["id"]).orderBy(
        "sequence_order").collect()
    assert [(r.sequence_order, r.holder_dates, r.holder_name, r.acquisition_notes) for r in out] == [
        (1, "To 1909", "Charles Lang Freer, purchased in 1909", "See Original Panel List."),
        (2, "From 1909 to 1919", "Freer Gallery of Art", "Transferred."),
    ]


def test_exhibitions_and_topics(spark):
    doc = ('{"@id":"https://x/ids/manifest/FS-1/","metadata":[{"label":"Topic","value":"pine"},'
           '{"label":"topic","value":"crane"},{"label":"Exhibition History","value":"Masterpieces (1990-1991)"},'
           '{"label":"Exhibition History","value":"Untitled show"}]}')
    r = A.parse_manifests(spark.createDataFrame([(doc,)], "m string"), "m").first()
    assert r.manifest_id == "FS-1" and r.topics == ["pine", "crane"] and r.topics_literal == '{"pine","crane"}'
    assert [(e.name, e.dates) for e in r.exhibitions] == [("Masterpieces", "1990-1991"), ("Untitled show", None)]


# ---------------------------------------------------------------- SQL guard and reports
@pytest.mark.parametrize(
    "sql,ok",
    [("SELECT 1", True), ("  select *\n from t", True), ("SELECT 'update' AS x", False),
     ("DELETE FROM t", False), ("WITH a AS (SELECT 1) SELECT * FROM a", False), ("SELECT 1 -- c", True)],
)
def test_select_guard(sql, ok):
    assert (R.text_refusal(sql) is None) == ok


def test_strict_guard_refuses_comments():
    assert "comments" in R.text_refusal("SELECT 1 -- c", template=True)
    assert "LOAD_FILE" in R.text_refusal("SELECT LOAD_FILE('x')", template=True)
    assert R.text_refusal("SELECT 1 INTO\n OUTFILE 'x'", template=True) and R.text_refusal(None)


@pytest.mark.parametrize(
    "sql,ok",
    [("SELECT id FROM guarded", True), ("SELECT 'Command' AS c FROM guarded g WHERE id IN (SELECT max(id) FROM guarded)", True),
     ("SELECT * FROM (WITH t AS (SELECT id FROM guarded) SELECT * FROM t)", True), ("SELECT * FROM range(3)", True),
     ("SELECT * FROM text.`/etc/hostname`", False), ("SELECT * FROM no_such_view", False),
     ("SELECT (SELECT max(value) FROM text.`/etc/hostname`) AS v", False),
     ("SELECT * FROM (WITH t AS (SELECT * FROM csv.`/x`) SELECT * FROM t)", False),
     ("SELECT java_method('java.lang.System', 'getProperty', 'user.name')", False),
     ("SELECT upper(reflect('java.lang.System', 'getProperty', 'user.name')) FROM guarded", False),
     ("SELECT TRANSFORM(id) USING 'cat' FROM guarded", False)],
)
def test_plan_guard(spark, sql, ok):
    spark.range(2).createOrReplaceTempView("guarded")
    if ok:
        R.run_select(spark, sql).collect()
    else:
        with pytest.raises(R.QueryRejected):
            R.run_select(spark, sql)


def test_report_blocks_continue_after_failures(spark):
    tpl = "{{SQL:SELECT 1 AS a}} x {{SQL:DROP TABLE t}} {{SQL:SELECT missing_col FROM range(1)}} {{SQL:\nSELECT 2 AS b}}"
    res = R.report(spark, tpl)
    assert [b.error is None for b in res] == [True, False, False, True]
    assert res[3].frame.first().b == 2


# ---------------------------------------------------------------- writes
def test_upsert_and_insert_ignore(spark):
    tgt = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, name string, v int")
    src = spark.createDataFrame([(2, "B", None, 1), (2, "BB", 21, 2), (3, "c", 30, 1)], "k int, name string, v int, seq int")
    merged = {r.k: (r.name, r.v) for r in K.upsert(tgt, src.drop("seq").withColumn("seq", F.lit(0)).drop("seq"),
                                                   ["k"]).collect()}
    assert merged[1] == ("a", 10) and merged[3] == ("c", 30)
    latest = {r.k: (r.name, r.v) for r in K.upsert(tgt, src, ["k"], update_cols=["name", "v"], order="seq").collect()}
    assert latest[2] == ("BB", 21)
    new = K.insert_ignore(tgt, src, ["k"], order="seq").collect()
    assert [(r.k, r.name) for r in new] == [(3, "c")]


def test_archive_names_with_existing(spark):
    files = spark.createDataFrame([(1, "r.csv"), (2, "r.csv"), (3, "s.csv")], "id int, file_name string")
    archived = spark.createDataFrame([("r.csv",)], "file_name string")
    out = {r.id: r.archive_name for r in K.archive_names(files, "file_name", ["id"], F.lit(0), archived).collect()}
    assert out == {1: "r_1.csv", 2: "r_2.csv", 3: "s.csv"}


def _model_archive(names, archived):
    """The first of a name keeps it if free; each other takes the lowest number nobody holds, in order."""
    held, out = set(names) | set(archived), []
    seen, used = set(), set()
    for n in names:
        if n not in seen and n not in archived:
            pick = n
        else:
            stem, dot, ext = n.rpartition(".") if "." in n else (n, "", "")
            k = 1
            while f"{stem}_{k}{dot}{ext}" in held | used:
                k += 1
            pick = f"{stem}_{k}{dot}{ext}"
        seen.add(n)
        used.add(pick)
        out.append(pick)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_archive_names_never_collide(spark, seed):
    rnd = random.Random(seed)
    pool = ["r.csv", "r_1.csv", "r_2.csv", "r_4.csv", "r_01.csv", "r_1_1.csv", "s", "s_1", "s_3", "t.tar.gz", ".x", ".x_1",
            "r_99999999999999999999.csv"]
    names = ["r.csv", "r_1.csv", "r.csv"] + rnd.choices(pool, k=40)
    archived = rnd.sample(pool, 4) + ["r_7.csv", "r_7.csv"]
    files = spark.createDataFrame(list(enumerate(names)), "id int, file_name string")
    got = K.archive_names(files, "file_name", ["id"], F.floor(F.col("id") / 7),
                          spark.createDataFrame([(n,) for n in archived], "file_name string"))
    got = [r.archive_name for r in got.orderBy("id").collect()]
    assert got == _model_archive(names, archived)
    assert len(set(got)) == len(got) and not set(got) & set(archived)


def test_attachment_match(spark):
    df = spark.createDataFrame([("Report.CSV",), ("report.csv",), ("a[0.txt",), (None,)], "n string")

    def hits(pattern):
        return [r.hit for r in df.select(S.attachment_match("n", pattern).alias("hit")).collect()]

    assert hits("*.csv") == [False, True, False, False]  # a glob minds case
    assert hits("^report") == [True, True, False, False]
    assert hits("[0") == [False, False, True, False]
    assert hits("") == [True, True, True, False]


def test_purge_exports_then_keeps_the_rest(spark):
    from kiln.session import staging_dir

    df = spark.createDataFrame([(1, dt.datetime(2026, 1, 1)), (2, dt.datetime(2026, 2, 1)), (3, None)], "id int, ts timestamp_ntz")
    exported, kept = K.purge(df, "ts", 10, "2026-02-05 00:00:00", staging_dir(spark, "purged"), staging_dir(spark, "kept"), "1")
    assert [r.id for r in spark.read.option("header", True).csv(exported).collect()] == ["1"]
    assert sorted(r.id for r in spark.read.parquet(kept).collect()) == [2, 3]


def test_csv_line_quotes_message(spark):
    df = spark.createDataFrame([(1, 'say "hi"', None)], "id int, message string, x string")
    assert K.csv_line(df, ["message"]).first().csv_line == '1,"say ""hi""",'


def test_keyset_paging_equals_offset_paging(spark):
    from kiln.operators import opslog as O

    df = spark.range(0, 200).select(F.col("id"), (F.col("id") % 7).alias("grp"))
    order = [("grp", True), ("id", False)]
    pages, after = [], None
    for _ in range(5):
        page = O.keyset_page(df, order, after, 30).collect()
        pages.extend((r.grp, r.id) for r in page)
        after = (page[-1].grp, page[-1].id)
    offset = [(r.grp, r.id) for r in O.page(df, [F.col("grp").desc(), F.col("id").asc()], 0, 150).collect()]
    assert pages == offset


def test_series_break_choice():
    assert FD.series_break(["SBN2022", "SBN2024"]) == "SBN2022"
    assert FD.series_break([]) == "SBN2024" and FD.series_break(None) == "SBN2024"


# ---------------------------------------------------------------- falsy values, patterns, blobs, upserts, feeds
def test_first_truthy_follows_the_type(spark):
    df = spark.sql("SELECT '0' AS t, '' AS e, cast(0 AS decimal(10,2)) AS d, 0.0D AS f, false AS b, 10 AS n")
    r = df.select(S.first_truthy("e", "t").alias("t"), S.first_truthy("d", F.lit(5)).cast("int").alias("d"),
                  S.first_truthy("f", F.lit(2.0)).alias("f"), S.first_truthy("b", F.lit(True)).alias("b"),
                  S.first_truthy("n", F.lit(1)).alias("n")).first()
    assert tuple(r) == ("0", 5, 2.0, True, 10)


def test_patterns_are_checked_by_the_engine_that_matches(spark):
    assert S.validate_regex("(?P<n>b)") and S.validate_regex("[") and S.validate_regex("(?<n>b)") is None
    r = spark.sql("SELECT 'abc' AS t").select(S.regex_test("t", "(?P<n>b)").alias("r")).first().r
    assert not r.is_valid and not r.matches and r.error


def test_blob_type_parses_xml(spark):
    df = spark.createDataFrame([("<?xml version='1.0'?><a><b></a>",), ("<?xml version='1.0'?><a><b/></a>",)], "t string")
    assert [r[0] for r in df.select(P.blob_type("t")).collect()] == ["TEXT", "XML"]


def test_upsert_keeps_null_outside_update_columns(spark):
    t = spark.createDataFrame([(1, None, "x")], "k int, a string, b string")
    s = spark.createDataFrame([(1, "new", "y"), (2, "new", "z")], "k int, a string, b string")
    got = sorted(tuple(r) for r in K.upsert(t, s, ["k"], update_cols=["b"]).collect())
    assert got == [(1, None, "y"), (2, "new", "z")]


@pytest.mark.parametrize("feed,transform", [("soma", "soma_holdings"), ("repo", "repo_operations"), ("mbs", "agency_mbs"),
                                            ("fx_swaps", "fx_swaps"), ("sec_lending", "securities_lending"),
                                            ("treasury", "treasury_operations")])
def test_feeds_reject_bad_dates_and_keep_blanks(spark, feed, transform):
    last = FD.DATE_FIELDS[feed][-1]
    docs = spark.createDataFrame([('{"%s":"%s"}' % (last, v),) for v in ("2026-01-02", "", "soon")], "d string")
    recs = docs.select(F.try_parse_json("d").alias("record"))
    assert getattr(FD, transform)(recs).count() == 2
    assert [r.raw_record for r in FD.date_rejects(recs, feed).collect()] == ['{"%s":"soon"}' % last]
