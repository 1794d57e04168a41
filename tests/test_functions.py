import pytest
from pyspark.sql import functions as F

from apilattice.functions import classify, text


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize("sig, want", [("Task<Foo> Run(Bar_1 b)", ["Task", "Foo", "Run", "Bar_1", "b"]), ("", []), (None, []), ("1a b 1a", ["1a", "b"]), ("é·ß", ["é", "ß"])])
def test_tokens(spark, sig, want):
    df = spark.createDataFrame([(sig,)], "s string")
    assert df.select(text.tokens(F.col("s"))).first()[0] == want


@pytest.mark.parametrize("s, want", [("a.b.C d", ["a.b.C", "C", "d"]), (".x x.", ["x", "x."]), ("List<p.Q>", ["List", "p.Q", "Q"])])
def test_type_tokens(spark, s, want):
    assert one(spark, text.type_tokens(F.lit(s))) == want


def test_names(spark):
    assert one(spark, text.normalize_type(F.lit("Map<String>[]"))) == "Map"
    assert one(spark, text.normalize_type(F.lit("int[]"))) == "int"
    assert one(spark, text.last_segment(F.lit("a.b.c"))) == "c"
    assert one(spark, text.strip_imports(F.lit('import("x/y").Foo<T>'))) == "Foo"


@pytest.mark.parametrize("ret, language, want", [("CompletableFuture<Blob>", "java", "Blob"), ("Flow.Publisher<A<B>>", "java", "A<B>"), ("List<A>", "java", "List<A>"), ("Coroutine[Any, Any, Foo]", "python", "Foo"), ("Awaitable[Foo]", "python", "Foo"), ("Promise<Foo<A>>", "typescript", "Foo<A>"), ("Promise<A>|Promise<B>", "typescript", "Promise<A>|Promise<B>"), ("(*Client, error)", "go", "Client"), ("[]*Item", "go", "Item")])
def test_unwrap(spark, ret, language, want):
    assert one(spark, text.unwrap_async(F.lit(ret), language)) == want


def test_scrub(spark):
    secret = "a" * 40
    rows = [("sk-" + "A1" * 12, "[REDACTED]"), (f"token = \"{secret}\"", 'token = "[REDACTED]"'), ("Bearer abc.def", "Bearer [REDACTED]"), ("nothing here", "nothing here"), ("ghp_" + "x" * 36, "[REDACTED]")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert df.where(text.scrub_secrets(F.col("t")) != F.col("want")).count() == 0
    known = text.known_secrets({"MY_KEY": "longsecret", "MY_TOKEN": "short", "OTHER": "longsecret2"})
    assert known == ("longsecret",)
    assert one(spark, text.scrub_secrets(F.lit("x longsecret y"), known)) == "x [REDACTED] y"


@pytest.mark.parametrize("path, want", [("../a b/c", "a_b/c.py"), (None, "Sample.py"), ("x.txt", "x.py"), ("d\\e.py", "d/e.py"), ("..", "Sample.py")])
def test_sanitize(spark, path, want):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(text.sanitize_path(F.col("p"), ".py")).first()[0] == want


def test_percent_is_half_even(spark):
    assert one(spark, text.percent(F.lit(49), F.lit(400))) == 12.2
    assert one(spark, text.percent(F.lit(1), F.lit(0))) == 0.0


def test_diagnostic_key_keeps_nulls(spark):
    assert one(spark, text.diagnostic_key(F.lit("a"), F.lit(None), F.lit("c"))) == "a||c"


@pytest.mark.parametrize("path, want", [("src/Attestation/x.cs", False), ("src/My.Tests.csproj", True), ("src/My.Tests/x.cs", False), ("sdk-test/p.json", True), ("a/Samples/b", True), ("a/b/tests.py", True)])
def test_test_paths(spark, path, want):
    assert one(spark, text.is_test_path(F.lit(path))) is want


@pytest.mark.parametrize("line, name, language, want", [("import my_sdk.x", "my-sdk", "python", True), ("from my.sdk import a", "my-sdk", "python", True), ("import my_sdk2", "my-sdk", "python", False), ("import {a} from '@x/y/sub'", "@x/y", "typescript", True), ("const a = require(\"../lib\")", "lib", "javascript", True), ("let a = '@x/y'", "@x/y", "typescript", False), ("import static com.a.B;", "com.a", "java", True), ('x "github.com/a/b/c"', "github.com/a/b", "go", True), ("using Foo.Bar;", "foo", "dotnet", True), ("using FooBar;", "Foo", "dotnet", False)])
def test_imports(spark, line, name, language, want):
    assert one(spark, text.imports_library(F.lit(line), name, language)) is want


def test_versions_and_conditions(spark):
    rows = spark.createDataFrame([("1.10.0",), ("1.9.9",), ("x",), ("2.0-beta",)], "v string")
    assert rows.orderBy(text.semver_key(F.col("v")).desc()).first()[0] == "2.0-beta"
    assert one(spark, text.condition_rank(F.lit("import"))) == 2
    assert one(spark, text.condition_rank(F.lit("edge"))) == 100
    assert one(spark, text.language_of(F.lit("C#"))) == "dotnet"


def test_summary(spark):
    long_ = "w" * 200
    assert one(spark, text.summary_line(F.lit(f"<summary>{long_}</summary>"))) == "w" * 147 + "..."
    assert one(spark, text.summary_line(F.lit("first\nsecond"), "python")) == "first"


def test_classification(spark):
    schema = "name string, kind string, base string, entry_point boolean, is_error boolean, members array<struct<name: string, kind: string, ret: string, sig: string, modifiers: array<string>>>"
    method, prop = ("Run", "method", "void", "()", ["public"]), ("P", "property", "int", None, None)
    rows = [("C", "class", None, True, None, [method]), ("E", "class", "System.Exception", None, True, []), ("M", "class", None, None, None, [prop]), ("O", "class", None, None, None, [method])]
    df = spark.createDataFrame(rows, schema)
    assert [r[0] for r in df.orderBy("name").select(classify.truncation_priority("dotnet")).collect()] == [0, 1, 2, 3]
    assert [r[0] for r in df.orderBy("name").select(classify.is_error("python")).collect()] == [False, True, False, False]
