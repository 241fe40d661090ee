"""Typed frames: documents at any depth, errors and budgets of rows, policies that are functions, and the encoder."""

import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe import NO_OPINION, OMIT, Decision, Field, KeyPolicy, MaskConfig, MaskError, Masker, chain, default_policy, policy_fn
from hushframe.functions import documents, rules
from hushframe.operators.logs import mask_log_records

R = "[REDACTED]"
S = T.StringType()
DOCUMENTS = ['{"a":{"credentials":["hunter2"]}}', '[{"pwd":1}]', "https://h/p?token=x&a=1", "pwd=x&b=2", "say password=x", "Bearer abcdefgh1", "plain", "", None, '{"pwd":', "a://", "{}", "é{", "x" * 40]


def nested():
    rng = random.Random(4)
    item = T.StructType([T.StructField("doc", S), T.StructField("list", T.ArrayType(T.ArrayType(S))), T.StructField("map", T.MapType(S, T.ArrayType(S)))])
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("plain", S), T.StructField("items", T.ArrayType(item)), T.StructField("by", T.MapType(S, S))])
    pick = lambda: rng.choice(DOCUMENTS)
    rows = []
    for k in range(60):
        items = [None if rng.random() < 0.1 else Row(doc=pick(), list=[None if rng.random() < 0.2 else [pick() for _ in range(rng.randrange(3))] for _ in range(rng.randrange(3))], map={key: [pick()] for key in ("token", "k", "deep")}) for _ in range(rng.randrange(4))]
        rows.append((k, pick(), rng.choice([None, items, items]), rng.choice([None, {"pwd": pick(), "n": pick(), "User-Id": "12345678"}])))
    return rows, schema


@pytest.mark.parametrize("policy", [default_policy(), chain(policy_fn(lambda f: NO_OPINION), default_policy())])
def test_strings_in_containers_are_inspected_as_at_the_top(spark, policy):
    rows, schema = nested()
    masker = Masker(policy)
    inspect = lambda v: None if v is None else documents.run(policy, masker.config, documents.Operation.inspect, v, R)[0]
    got = {int(r.id[-4:].replace("*", "")) if r.id != R else None: r for r in masker.mask_dataframe(spark.createDataFrame(rows, schema).withColumn("id", F.col("id") + 1_000_000)).collect()}
    for k, plain, items, by in rows:
        r = got[k]
        assert r.plain == inspect(plain)
        assert (r.items is None) == (items is None) and (r.by is None) == (by is None)
        for x, y in zip(items or [], r.items or []):
            if x is None:
                assert y is None
                continue
            assert y.doc == inspect(x.doc) and y.list == [None if z is None else [inspect(v) for v in z] for z in x.list]
            assert y.map["token"] == R and y.map["k"] == json.dumps([inspect(v) for v in x.map["k"]], separators=(",", ":"), ensure_ascii=False).replace("&", "\\u0026").replace("null", "null")
        if by:
            assert r.by == {"pwd": R, "n": inspect(by["n"]), "User-Id": "****5678"}


def test_the_document_is_the_frame_encoded(spark):
    rows, schema = nested()
    df = spark.createDataFrame(rows, schema)
    for config in (MaskConfig(), MaskConfig(preserve_safe=True)):
        masker = Masker(KeyPolicy([(["pwd"], rules.full)]), config)
        frame = masker.mask_dataframe_checked(df.select("id", "plain", "items")).collect()
        wrong = [r for r in frame if r.errors]
        texts = [json.loads(r.value) for r in masker.rows_to_json(df.select("id", "plain", "items")).collect()]
        assert wrong == [] and len(texts) == len(frame)

        def shown(v):
            if isinstance(v, Row):
                return {k: shown(x) for k, x in v.asDict().items() if k not in ("errors", "map")}
            return [shown(x) for x in v] if isinstance(v, list) else v

        def without(v):
            return {k: without(x) for k, x in v.items() if k != "map"} if isinstance(v, dict) else [without(x) for x in v] if isinstance(v, list) else v

        assert [without(t) for t in texts] == [shown(r) for r in frame]


def test_encoder(spark):
    schema = "b struct<z: boolean, a: double, f: float, s: string, d: decimal(9,2), t: timestamp, raw: binary>"
    import datetime

    rows = [((True, 1e7, 0.1, 'a"\\<&>\u2028\n\x01\x1f/é', None, datetime.datetime(2024, 1, 2, 3, 4, 5), b"hi"),), ((None, None, None, None, None, None, None),), (None,)]
    df = spark.createDataFrame(rows, schema)
    text = '"a\\"\\\\\\u003c\\u0026\\u003e\\u2028\\n\\u0001\\u001f/é"'
    assert [r.value for r in Masker().rows_to_json(df).collect()][0] == '{"b":{"a":"1e+07","d":null,"f":"0.1","raw":"aGk=","s":' + text + ',"t":"2024-01-02T03:04:05Z","z":"true"}}'
    safe = Masker(config=MaskConfig(preserve_safe=True))
    got = [r.value for r in safe.rows_to_json(df).collect()]
    assert got == ['{"b":{"a":10000000,"d":null,"f":0.1,"raw":"aGk=","s":' + text + ',"t":"2024-01-02T03:04:05Z","z":true}}', '{"b":{"a":null,"d":null,"f":null,"raw":null,"s":null,"t":null,"z":null}}', '{"b":null}']
    assert [documents.encode_string(r[0][3]) for r in rows[:1]] == [text]
    bad = spark.createDataFrame([(float("nan"),), (float("inf"),), (-0.0,), (123456789.5,)], "v double")
    assert [r.value for r in safe.rows_to_json(bad).collect()] == [f'"{R}"', f'"{R}"', '{"v":-0}', '{"v":123456789.5}']
    assert [r.value for r in Masker().rows_to_json(bad).collect()] == ['{"v":"NaN"}', '{"v":"+Inf"}', '{"v":"-0"}', '{"v":"1.234567895e+08"}']


def test_errors_of_rows(spark):
    def fails(value):
        raise ValueError(value)

    masker = Masker(KeyPolicy([(["n"], rules.new_rule("own", fails))]), MaskConfig(max_depth=3))
    deep = '{"a":{"b":{"c":{"d":1}}}}'
    df = spark.createDataFrame([(1, "x", [deep], {"n": "1", "k": "2"}), (2, "y", ["fine"], None)], "i int, n string, docs array<string>, by map<string, string>")
    one, two = masker.mask_dataframe_checked(df, "why").orderBy("i").collect()
    assert sorted((e.code, e.path, e.rule) for e in one.why) == [("depth_limit", "$[docs][]" + "[a][b][c]", ""), ("rule_failure", "$[by][*]", "own"), ("rule_failure", "$[n]", "own")]
    assert one.n == R and one.docs == [R] and one.by == {"n": R, "k": "2"}
    assert [e.path for e in two.why] == ["$[n]"] and two.docs == ["fine"]
    with pytest.raises(MaskError):
        masker.mask_dataframe_checked(df, "docs")


def test_budgets_of_rows(spark):
    df = spark.createDataFrame([(1, [Row(a=1, b=["x"] * k)], {str(j): j for j in range(k)}) for k in range(5)], "i int, items array<struct<a: int, b: array<string>>>, by map<string, int>")
    masker = Masker(KeyPolicy([]), MaskConfig(max_nodes=11))
    # i 1, items 1 + element 1 + a 1 + b 1 + k, by 1 + k
    assert [(r.i, r["items"] is None, [e.code for e in r.errors]) for r in masker.mask_dataframe_checked(df).collect()] == [("1", False, [])] * 3 + [(R, True, ["node_limit"])] * 2
    assert [r.value[0] for r in masker.rows_to_json(df).collect()] == ["{", "{", "{", '"', '"']
    assert len(Masker(KeyPolicy([]), MaskConfig(max_nodes=1)).mask_dataframe(df.select("i", F.lit(1).alias("j"))).where(f"i = '{R}'").collect()) == 5


def test_functions_judge_map_keys(spark):
    def judge(f: Field):
        return OMIT if f.key == "drop" else Decision(rules.id_) if f.path.endswith("[who]") else 1 // (f.key != "bad") and NO_OPINION

    df = spark.createDataFrame([({"drop": "a", "who": "12345678", "bad": "x", "free": "password=1 x", "none": None},), (None,)], "m map<string, string>")
    one, two = Masker(chain(policy_fn(judge), default_policy())).mask_dataframe_checked(df).collect()
    assert one.m == {"who": "****5678", "bad": R, "free": f"password={R} x", "none": None} and [e.code for e in one.errors] == ["policy_failure"]
    assert two.m is None and two.errors == []
    with pytest.raises(MaskError):  # a policy that raises for a column's name fails when the plan is built
        Masker(policy_fn(lambda f: 1 // 0)).mask_dataframe(df)


def test_tags_of_log_fields(spark):
    kind = T.StructType([T.StructField("doc", S, True, {"format": "json"}), T.StructField("g", T.StructType([T.StructField("a", S, True, {"mask": "full"}), T.StructField("b", S, True, {"mask": "omit"})])), T.StructField("level", S, True, {"mask": "full"})])
    (r,) = mask_log_records(Masker(), spark.createDataFrame([('{"pwd":1}', ("x", "y"), "z")], kind)).collect()
    assert r.doc == f'{{"pwd":"{R}"}}' and r.g == Row(a=R, b=R) and r.level == R
