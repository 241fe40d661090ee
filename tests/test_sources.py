"""Reading with a bound, writing masked lines in batches and streams, digests, SQL functions."""

import json

import pytest
from pyspark.sql import functions as F

from hushframe import KeyPolicy, MaskConfig, Masker
from hushframe.functions import rules
from hushframe.operators.report import output_digest
from hushframe.sources.lines import mask_documents, read_documents, read_lines, write_lines, write_records
from hushframe.streaming.masked import write_lines_stream

R = "[REDACTED]"


def test_long_files_are_not_read(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"pwd":"x"}')
    (tmp_path / "b.json").write_bytes(b'{"pwd":"' + b"x" * 5_000_000 + b'"}')
    (tmp_path / "c.json").write_bytes(b'{"pwd":"\xff"}')
    (tmp_path / "d.json").write_text("")
    masker = Masker(config=MaskConfig(max_input_bytes=1_000))
    rows = mask_documents(masker, spark, str(tmp_path)).collect()
    got = {r.file.rsplit("/", 1)[-1]: (r.value, [e.code for e in r.errors]) for r in rows}
    bad = f'"{R}"'
    assert got == {"a.json": (f'{{"pwd":"{R}"}}', []), "b.json": (bad, ["input_limit"]), "c.json": (bad, ["invalid_utf8"])}  # Spark's sources give no row for an empty file
    plan = read_documents(spark, str(tmp_path), 1_000)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,1000)" in plan  # the scan opens no longer file
    assert read_documents(spark, str(tmp_path), 1_000).where("too_long").count() == 1


LINES = ['{"msg":"hi","password":"x","tokenCauses":[1]}', "", "no json", '{"a":1}\r']


@pytest.mark.parametrize("diagnostics", [False, True])
def test_written_lines(spark, tmp_path, diagnostics):
    df = spark.createDataFrame([(t,) for t in LINES], "line string").coalesce(1)
    masker = Masker()
    want = [f'{{"msg":"hi","password":"{R}","tokenCauses":' + (f'"{R}"}}' if diagnostics else "[1]}"), "", f'{{"message":"{R}"}}', '{"a":1}\r']
    write_lines(masker, df, str(tmp_path / "out"), "line", diagnostics)
    assert sorted(r.value for r in read_lines(spark, str(tmp_path / "out")).collect()) == sorted(want)
    # a stream, written and read back; the second call has nothing left to do
    df.write.text(str(tmp_path / "in"))
    for _ in range(2):
        stream = read_lines(spark, str(tmp_path / "in"), stream=True)
        write_lines_stream(masker, stream, str(tmp_path / "streamed"), str(tmp_path / "log"), diagnostics=diagnostics).awaitTermination()
    assert sorted(r.value for r in read_lines(spark, str(tmp_path / "streamed")).collect()) == sorted(want)


def test_written_records(spark, tmp_path):
    df = spark.createDataFrame([(1, ("u", "p"), ["token=x y"])], "n int, who struct<name: string, password: string>, notes array<string>")
    write_records(Masker(), df, str(tmp_path / "out"))
    (r,) = read_lines(spark, str(tmp_path / "out")).collect()
    assert json.loads(r.value) == {"n": "1", "notes": [f"token={R} y"], "who": {"name": "u", "password": R}}


# Documents whose masked texts must not change, and their digest under four markers.
PINNED = [
    '{"password":"p","email":"d@e.fg","count":42,"big":123456789012345678901234567890}', '{"a":"<i>&\\"q\\"\\\\s\\b\\f\\n\\r\\t\\u0000","u":"Привет 世界 😀"}', '{"nested":{"token":"t","arr":[1,true,null,"s",{"card":"5500005555555559"}]}}',
    '{"dup":"first","dup":"second","z":1,"a":2,"M":3}', '{"e":1e309,"n":-0.0,"x":1E+09}', '  {"phone":"+7 (999) 888-77-66"}  ', "[]", "{}", "null", '"plain"', "123", '{"bad":}', '{tok":1}', '{"unterminated":"x', "", "[" * 40 + "]" * 40,
]
DIGEST = "33363323502436145309"


def masked_under_four_markers(spark, documents):
    docs = spark.createDataFrame(list(enumerate(documents)), "i int, t string")
    every = None
    for marker in ("[REDACTED]", "***", '<"&>', "🔒"):
        m = Masker(config=MaskConfig(redaction=marker))
        url = m.mask_url(F.concat(F.lit("https://u:p@h/p?token=t&keep=1&i="), F.col("i").cast("string"), F.lit("#f")))["value"]
        headers = F.to_json(m.mask_headers(F.create_map(F.lit("Authorization"), F.array(F.lit("Bearer x")), F.lit("Accept"), F.array("t"))))
        own = docs.select("i", m.mask_json(F.col("t"))["value"].alias("json"), m.inspect(F.col("t"))["value"].alias("text"), url.alias("url"), headers.alias("headers"))
        every = own if every is None else every.unionAll(own)
    return every


def test_pinned_digest(spark):
    got = output_digest(masked_under_four_markers(spark, PINNED), 15).first()
    assert (got.n, got.digest) == (64, DIGEST)
    changed = output_digest(masked_under_four_markers(spark, [PINNED[0].replace("42", "43"), *PINNED[1:]]), 15).first()
    assert changed.digest != DIGEST


def test_digests_of_parts_add_up(spark):
    df = spark.range(1000).withColumn("x", F.col("id") * 7)
    whole, a, b = (int(output_digest(d, 15).first().digest) for d in (df, df.where("id < 300"), df.where("id >= 300")))
    assert whole == a + b > 1 << 60


def test_sql(spark):
    masker = Masker(KeyPolicy([(["pwd"], rules.full)]))
    masker.register(spark)
    spark.createDataFrame([("pwd=x Bearer abcdefgh1", {"Cookie": ["a"], "Host": ["h"]}), ("nothing", None), (None, {})], "t string, h map<string, array<string>>").createOrReplaceTempView("sql_texts")
    found = spark.sql("SELECT t, f.kind, f.begin FROM sql_texts LATERAL VIEW inline(locate(t)) f AS kind, key, begin, end").collect()
    assert sorted((r.kind, r.begin) for r in found) == [("bearer", 13), ("pair", 4)]
    assert [r.kind for r in spark.sql("SELECT kind FROM sql_texts, LATERAL detect(t)").collect()] == ["pair", "bearer"]
    rows = spark.sql("SELECT mask_text(t) AS t, mask_headers(h) AS h FROM sql_texts").collect()
    assert [(r.t, r.h) for r in rows] == [(f"pwd={R} Bearer {R}", {"Cookie": [R], "Host": ["h"]}), ("nothing", None), (None, {})]
