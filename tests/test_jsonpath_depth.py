import json

from pyspark.sql import functions as F

from tessera.plans import jsonpath


def test_descent_has_no_last_level(spark):
    deep = {"x": 0}
    for i in range(1, 31):
        deep = {"x": i, "in": [deep] if i % 2 else deep}
    docs = spark.createDataFrame([(1, json.dumps(deep)), (2, '{"x": "[{"}'), (3, "5"), (4, None)], "id int, t string").withColumnRenamed("t", "doc")
    got = jsonpath.count(docs, F.col("doc"), "$..x", ["id"], "n").collect()
    assert {r.id: r.n for r in got if r.n} == {1: 31, 2: 1}
