from pyspark.sql import functions as F
from pyspark.sql import types as T

from apilattice.operators import detect
from apilattice.plans import facade
from apilattice.sources import schemas


def test_json_schema_of_each_kind_of_type():
    inner = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.ArrayType(T.DoubleType()))])
    made = schemas.json_schema(T.StructType([T.StructField("camelName", inner), T.StructField("m", T.MapType(T.StringType(), T.BooleanType()), False), T.StructField("d", T.DecimalType(5, 2)), T.StructField("t", T.TimestampType())]))
    assert made == {
        "type": "object", "required": ["m"],
        "properties": {
            "camelName": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"type": "number"}}}},
            "m": {"type": "object", "additionalProperties": {"type": "boolean"}}, "d": {"type": "number"}, "t": {"type": "string"},
        },
    }


def test_json_schema_ends_at_its_depth(spark):
    deep = T.StringType()
    for _ in range(30):
        deep = T.ArrayType(deep)
    made, depth = schemas.json_schema(deep), 0
    while made:
        made, depth = made["items"], depth + 1
    assert depth == 10
    index = spark.createDataFrame([], schemas.INDEX).schema
    assert set(schemas.json_schema(index)["properties"]) == {"package", "version", "containers", "dependencies", "diagnostics"}


def test_auxiliary_folders(spark):
    roots = {"": False, "src": False, "samples": True, "a/tests/b": True, "Tests/x": False, "testing": False, "a/docs": True, "samples-dev/x": True, "__tests__": True}
    rows = spark.createDataFrame([(r,) for r in [*roots, None]], "root string").select("root", detect.under_auxiliary(F.col("root")).alias("x")).collect()
    assert {r.root: r.x for r in rows if r.root is not None} == roots
    assert [r.x for r in rows if r.root is None] == [None]


def test_a_language_is_a_row_of_rules(spark):
    """What each language adds, and that a new one is an entry of its own."""
    assert set(facade.LANGUAGES) == {"dotnet", "java", "typescript", "javascript", "python", "go"}
    key = lambda language: spark.range(1).select(facade.LANGUAGES[language].key(F.lit("Ab"))).first()[0]
    assert key("dotnet") == "ab" and key("java") == "Ab"
    own = facade.Language("own", any_case=True)
    assert spark.range(1).select(own.key(F.lit("XY"))).first()[0] == "xy" and own.root_rule is facade.LANGUAGES["java"].root_rule
