"""Paths of payloads are counted in one walk, of the payloads that Spark can read."""

import time

from pyspark.sql import functions as F

from tidemark.operators import normalize


def test_odd_payloads(spark):
    texts = [
        '{"a.b":{"c":1},"a":{"b.c":"x"}}', '{"\U0001f600.b":{"c":1},"\U0001f600":{"b.c":"x"},"\uffff":{"":1},"\uffff.":"s"}', '{"":{"a":1},"a":"s"}',
        r'{"\ud800":1,"\ud801":"x","q\"\\":{"\u00e9":null}}', '{"a":1,"a":2}', '{"a":1} rest', " \t\r\n{\"w\":[{\"x\":1}]}", "[{\"x\":1}]", '"{"', "null", "", "{", "{'a':1}",
        '{"n":1e400,"m":' + "9" * 900 + ',"i":-0,"f":1.50,"d":1E-7}', '{"n":NaN}', '{"t":true,"v":null,"e":{},"l":[]}', None,
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "data string")
    got = {r["path"]: (r["count"], r["types"]) for r in normalize.field_inference(rows).collect()}
    assert got == {
        "a.b": (1, ["object"]), "a": (3, ["number", "object", "string"]), "a.b.c": (1, ["string"]),
        "\U0001f600.b": (1, ["object"]), "\U0001f600": (1, ["object"]), "\U0001f600.b.c": (1, ["string"]),
        "\uffff": (1, ["object"]), "\uffff.": (1, ["string"]), "": (1, ["object"]),
        "?": (1, ["number"]), 'q"\\': (1, ["object"]), 'q"\\.\u00e9': (1, ["null"]), "w": (1, ["array"]),
        **{key: (1, ["number"]) for key in "nmifd"}, "t": (1, ["boolean"]), "v": (1, ["null"]), "e": (1, ["object"]), "l": (1, ["array"]),
    }


def test_deep_payloads_take_time_by_their_length(spark):
    def seconds(rows):
        data = F.concat(F.lit('{"a":' * 300), F.col("id").cast("string"), F.lit("}" * 300))
        events = spark.range(0, rows, 1, 4).select(data.alias("data"))
        started = time.perf_counter()
        found = normalize.field_inference(events).collect()
        assert len(found) == 300 and {r["count"] for r in found} == {rows}
        return time.perf_counter() - started

    seconds(4)
    assert seconds(1_000) < 5
