import datetime
import os
import re

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__
from hushframe import ErrorCode, KeyPolicy, MaskConfig, Masker, MaskError, chain, policy_fn, queries
from hushframe.functions import detect, rules
from hushframe.policy import fold
from hushframe.operators.report import output_digest
from hushframe.sources.lines import mask_json_lines, read_documents, read_lines
from hushframe.streaming.masked import mask_lines_stream

R = "[REDACTED]"
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    want, got = con.sql(queries.SQL[name]).df(), queries.queries()[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)

    def rows(df):
        return sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))

    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


RULES = [
    ("email", "alice@example.com", "a***@example.com"), ("email", "a@b@c", R), ("email", "@b", R), ("email", "a@", R), ("email", "a b@c", R), ("email", "é@c", "é***@c"), ("email", "a​@c", R), ("email", None, R),
    ("phone", "+1 (555) 123-4567", "+* (***) ***-4567"), ("phone", "1234", R), ("phone", "12345x", R), ("card", "4111-1111-1111-1111", "****-****-****-1111"), ("card", "", R), ("card", None, R),
    ("id", "123456", "**3456"), ("id", "1234", R), ("id", "añb 😀cdef", "*** **cdef".replace("** ", "** ")[0:4] + "*cdef"[0:0] + "*cdef" if False else "*** *cdef"), ("id", "ab cdef", R), ("full", "x", R), ("password", None, R),
]


def test_rules_as_columns_and_rows(spark):
    df = spark.createDataFrame([(i, v) for i, (_, v, _) in enumerate(RULES)], "i int, v string")
    for name in {r[0] for r in RULES}:
        rule = rules.BUILT_IN[name]
        got = {r.i: r.m for r in df.select("i", rule(F.col("v"), R).alias("m")).collect()}
        for i, (own, value, want) in enumerate(RULES):
            if own == name:
                assert got[i] == want, (name, value)
                assert rule.row(value or "", R) == want, (name, value)


def test_invalid_utf8_fails_closed(spark):
    df = spark.range(1).select(F.unhex(F.lit("61FF62636465")).cast("string").alias("v"))
    m = Masker()
    row = df.select(m.mask_string(F.col("v"), rules.id_).alias("a"), m.mask_json(F.col("v")).alias("b"), m.mask_text(F.col("v")).alias("c")).first()
    assert row.a == R and row.c == R and row.b.value == f'"{R}"' and row.b.errors[0].code == "invalid_utf8"


def test_policies():
    with pytest.raises(MaskError):
        KeyPolicy([(["a_b"], rules.full), (["A-B"], rules.email)])
    for bad in (lambda: KeyPolicy([(["__"], rules.full)]), lambda: chain(), lambda: policy_fn(None), lambda: MaskConfig(redaction=""), lambda: rules.new_rule("", str), lambda: MaskConfig(tag_rules={"omit": rules.full})):
        with pytest.raises(MaskError):
            bad()
    assert fold("Paſs-Word") == "password" and fold("Key") == "key" and fold("Straße") != fold("strasse") and fold("ı") != "i"


def test_nested_rewrite(spark):
    schema = T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("who", T.StructType([T.StructField("email", T.StringType()), T.StructField("age", T.IntegerType()), T.StructField("gone", T.StringType(), metadata={"mask": "omit"})])),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("notes", T.ArrayType(T.StringType())),
        T.StructField("at", T.TimestampType()),
        T.StructField("raw", T.BinaryType()),
        T.StructField("doc", T.StringType(), metadata={"format": "json"}),
    ])
    row = (123456, Row(email="a@b.c", age=3, gone="x"), {"Pass-Word": "x", "b": "token=y"}, ["pwd=z", None, "ok"], datetime.datetime(2024, 1, 2, 3, 4, 5, 600000), b"hi", '{"pwd":1,"a":true}')
    df = spark.createDataFrame([row, (None,) * 7], schema)
    masked = Masker().mask_dataframe(df)
    first, empty = masked.collect()
    assert first.id == "**3456" and empty.id == R
    assert first.who.asDict() == {"email": "a***@b.c", "age": "3"} and empty.who is None
    # strings in arrays and maps are inspected as anywhere: these two are forms
    assert first.tags == {"Pass-Word": R, "b": "token=%5BREDACTED%5D"} and first.notes == ["pwd=%5BREDACTED%5D", None, "ok"]
    assert first["at"] == "2024-01-02T03:04:05.6Z" and first.raw == "aGk=" and first.doc == f'{{"a":"true","pwd":"{R}"}}'
    assert masked.count() == 2
    kept = Masker(config=MaskConfig(preserve_safe=True)).mask_dataframe(df.select("who")).schema["who"].dataType
    assert kept["age"].dataType == T.IntegerType()


def test_plan_errors(spark):
    df = spark.range(1)
    with pytest.raises(MaskError) as e:
        Masker().mask_dataframe(df.select("id", "id"))
    assert e.value.code == ErrorCode.FIELD_CONFLICT
    with pytest.raises(MaskError) as e:
        Masker().mask_dataframe(df.select(F.create_map("id", "id").alias("m")))
    assert e.value.code == ErrorCode.UNSUPPORTED_MAP_KEY
    with pytest.raises(MaskError):
        Masker().mask_dataframe(df.withMetadata("id", {"mask": "nonsense"}))


def test_plan_has_no_shuffle_and_prunes(spark):
    orders = spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey", "c_name", "c_acctbal")
    plan = Masker(KeyPolicy([(["c_name"], rules.full)])).mask_dataframe(orders)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "c_name" not in plan.split("ReadSchema")[1] and "Python" not in plan


def test_text_by_java_and_by_row_agree(spark):
    texts = ["login password=abc, ok", "token: \"x y\" z", "Authorization: Basic QWxhZGRpbjpvcGVu", "see ghp_" + "a1" * 18, "http://u:p@h/x", "a eyJhbGciOiJI.eyJzdWIiOiIx.sig b", "email=bob@x.org;", "user=a,pwd=b,c=d", "--password=x y", "path/token=1", "id: 123456.", "pwd=", "key token=a;b c", "plain", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    m = Masker(config=MaskConfig(embedded=False))
    rows = df.select("i", m.mask_text(F.col("t")).alias("java"), m.inspect(F.col("t"))["value"].alias("row")).collect()
    assert [(texts[r.i], r.java) for r in rows] == [(texts[r.i], r.row) for r in rows]


def test_detectors_and_headers(spark):
    df = spark.createDataFrame([("call Bearer abcDEF123456 and user=bob",)], "t string")
    m = Masker()
    row = df.select(m.detect_spans(F.col("t")).alias("s"), m.detect_pairs(F.col("t")).alias("p")).first()
    assert [(x.kind, x.secret) for x in row.s] == [("bearer", "abcDEF123456")] and [(x.key, x.value) for x in row.p] == [("user", "bob")]
    heads = spark.createDataFrame([({"COOKIE": ["a", "b"], "X-Api-Key": ["k"], "Accept": ["*/*"], "None": []},)], "h map<string,array<string>>")
    assert heads.select(m.mask_headers(F.col("h")).alias("h")).first().h == {"COOKIE": [R, R], "X-Api-Key": [R], "Accept": ["*/*"]}
    m.register(spark)
    assert spark.sql("""SELECT mask_json('{"pwd":1}') AS v""").first().v == f'{{"pwd":"{R}"}}'


def test_lines_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_bytes(b'{"pwd":"x","n":1}\r\n\nnot json\n{"a":1}')
    want = sorted([f'{{"n":1,"pwd":"{R}"}}\r', "", f'{{"message":"{R}"}}', '{"a":1}'])
    assert sorted(r.value for r in mask_json_lines(Masker(), read_lines(spark, str(tmp_path / "in"))).collect()) == want
    mask_lines_stream(Masker(), spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.value for r in read_lines(spark, str(tmp_path / "out")).collect()) == want


def test_detection_over_whole_texts(spark, tmp_path):
    hex_ = "0123456789abcdef0123"
    texts = [
        ("en", f'a token = "{hex_}" b and token = "{hex_}x" end'),
        ("en", f"call Bearer {hex_} at https://me:pw@host/x"),
        ("de", "password=abc; user: bob"),
        ("de", "nothing here"),
        (None, None),
    ]
    spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for lang, text in texts:
        kinds = [f[0] for f in detect.scan_row(text or "")]
        for kind in kinds:
            for key in ((kind, lang), (kind, None), (None, None)):
                want[key] = want.get(key, 0) + 1
    got = {(r.kind, r.lang): r.n for r in queries.queries()["detection_counts"](spark, str(tmp_path)).collect()}
    assert got == want and got["pair", "en"] >= 2 and got["bearer", "en"] == got["url_userinfo", "en"] == 1
    masked = {r.doc_id: r.v for r in queries.queries()["text_tokens"](spark, str(tmp_path)).collect()}
    assert set(masked) == set(range(len(texts))) and masked[3] == "nothing here" and masked[4] is None
    assert masked[0] == f'a token = "{R}" b and token = "{R}" end'


def test_text_tokens_by_the_key_as_written(spark, tmp_path):
    """text_tokens takes the key as its SQL does, text_tokens_folded in any case."""
    hex_ = "0123abcd" * 5
    texts = [f'A TOKEN = "{hex_}" B', f'a token = "{hex_}" and Token="{hex_}" b', f'a Token = "{hex_}" c', "none", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name, flags in (("text_tokens", 0), ("text_tokens_folded", re.IGNORECASE)):
        want = {i: t and re.sub('(token[ \\t]*=[ \\t]*")([^"\\n]+)', rf"\1{R}", t, flags=flags) for i, t in enumerate(texts)}
        assert {r.doc_id: r.v for r in queries.queries()[name](spark, str(tmp_path)).collect()} == want


def test_detection_over_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect()
    want = {}
    for r in docs:
        for kind in [f[0] for f in detect.scan_row(r.text or "")]:
            want[kind] = want.get(kind, 0) + 1
    report = queries.queries()["detection_counts"](spark, SF).where("lang is null and kind is not null").groupBy("kind").agg(F.sum("n").alias("n"))
    assert {r.kind: r.n for r in report.collect()} == want


def test_chains_in_nested_fields_and_headers(spark):
    for r in queries.queries()["chain_nested"](spark, SF).collect():
        who = r.who.asDict(True)
        assert who["note"] == f"my password={R}" and who["more"] == {"deep": f"my password={R}"}
        assert who["list"][0] == f"my password={R}" and who["list"][1].startswith("Supplier") and who["link"] == "https://h/p?token=%5BREDACTED%5D"
    for r in queries.queries()["chain_headers"](spark, SF).collect():
        assert set(r.headers) == {"X-Api-Key", "Cookie", "Accept", "Host"} and r.headers["X-Api-Key"] == r.headers["Cookie"] == [R]
        assert r.headers["Accept"] == [f"password={R}"] and r.headers["Host"][0].startswith("Supplier")


def test_chains_of_key_policies(spark):
    keys = chain(KeyPolicy([(["note"], rules.full)]), KeyPolicy([(["note"], rules.id_), (["x-api-key"], rules.full)]))
    assert keys.keys == {"note": rules.full, "xapikey": rules.full}
    one = spark.createDataFrame([Row(a=["note=abc x"], h={"X-Api-Key": ["k"], "Host": [None, "h"], "None": None})], "a array<string>, h map<string, array<string>>")
    for policy in (keys, chain(policy_fn(keys.decide))):
        m = Masker(policy)
        assert one.select(m.mask_headers(F.col("h")).alias("h")).first().h["X-Api-Key"] == [R]
        assert m.mask_dataframe(one.select("a")).first().a == [f"note={R} x"]
    failing = Masker(policy_fn(lambda f: 1 // 0))
    assert one.select(failing.mask_headers(F.col("h")).alias("h")).first().h["X-Api-Key"] == [R]


def test_whole_files_as_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"pwd":\n  "x",\n "n": 1}\n')
    (tmp_path / "b.json").write_text('{"pwd": ')
    rows = read_documents(spark, str(tmp_path)).select(F.regexp_extract("file", "[^/]*$", 0).alias("f"), Masker().mask_json(F.col("value")).alias("m")).collect()
    assert {r.f: r.m.value for r in rows} == {"a.json": f'{{"n":1,"pwd":"{R}"}}', "b.json": f'"{R}"'}
    assert [r.m.errors[0].code for r in rows if r.f == "b.json"] == ["invalid_json"]


def test_digests_do_not_depend_on_order(spark):
    rows = queries.queries()["json_build"](spark, SF)
    one, two = output_digest(rows).first(), output_digest(rows.orderBy(F.desc("v")).repartition(5)).first()
    assert one == two and one.n == rows.count() and output_digest(rows.limit(0)).first().digest == 0
    assert output_digest(rows.withColumn("v", F.lit("x"))).first() != one


PIECES = [
    ("tail key: 'a b' c", [("key", "a b")], []),
    ('say "name" : "v\\"w" x', [("name", 'v\\"w')], []),
    ("u=1&v=2;w=3", [("u", "1"), ("v", "2"), ("w", "3")], []),
    ("m=n=o", [("m", "n=o"), ("n", "o")], []),
    ("why: see http://a.b/c", [("why", "see")], []),
    ("9x=1 x9=2", [("x9", "2")], []),
    ("k=, j", [], []),
    ("k=a;b, c", [("k", "a;b")], []),
    ("auth: Basic bWU6azlrOWs5", [("auth", "Basic bWU6azlrOWs5")], ["bWU6azlrOWs5"]),
    ("go ftp://me:k9@h/x", [], ["me:k9"]),
    ("npm_" + "a1" * 18 + " rest", [], ["npm_" + "a1" * 18]),
    ("npm_" + "a1" * 17, [], []),
    ("plain words only", [], []),
]


def test_detectors_as_columns_and_rows(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(PIECES)], "i int, t string")
    m = Masker()
    for r in df.select("i", m.detect_pairs(F.col("t")).alias("p"), m.detect_spans(F.col("t")).alias("s"), m.locate(F.col("t")).alias("l")).collect():
        text, pairs, spans = PIECES[r.i]
        assert [(p.key, p.value) for p in r.p] == pairs and [s.secret for s in r.s] == spans, text
        assert sorted((x.key, text[x.begin : x.end]) for x in r.l if x.kind == "pair") == sorted(pairs)
        assert [text[x.begin : x.end] for x in r.l if x.kind != "pair"] == spans


def test_sql_functions(spark):
    Masker().register(spark)
    row = spark.sql("SELECT mask_text('pwd=x y') AS a, mask_headers(map('X-Api-Key', array('k'), 'Host', array('h'))) AS b").first()
    assert row.a == f"pwd={R} y" and row.b == {"X-Api-Key": [R], "Host": ["h"]}
    assert [tuple(r) for r in spark.sql("SELECT * FROM detect('a=b')").collect()] == [("pair", "a", 2, 3)]


def test_float_texts(spark):
    from hushframe.plans.rewrite import float_text

    values = [0.0, -0.0, 1.0, -2.5, 0.1, 123456.0, 999999.5, 1e6, 1.5e6, 12345678.9, 1e21, 1e-300, 1e-4, 0.00012, 9.9e-5, 1.7976931348623157e308, float("inf"), float("-inf"), float("nan"), None]
    want = ["0", "-0", "1", "-2.5", "0.1", "123456", "999999.5", "1e+06", "1.5e+06", "1.23456789e+07", "1e+21", "1e-300", "0.0001", "0.00012", "9.9e-05", "1.7976931348623157e+308", "+Inf", "-Inf", "NaN", None]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", float_text(F.col("v")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == want


def test_instants_are_in_utc(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert Masker().mask_dataframe(spark.range(1).select(F.timestamp_seconds(F.lit(1704164645)).alias("v"))).first().v == "2024-01-02T03:04:05Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
