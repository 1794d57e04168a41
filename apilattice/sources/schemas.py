"""Declared schemas; nothing is inferred."""

from __future__ import annotations

PARAM = "struct<name: string, type: string, default: string, modifier: string>"
MEMBER = f"struct<name: string, id: string, kind: string, sig: string, ret: string, doc: string, is_static: boolean, is_async: boolean, deprecated: boolean, modifiers: array<string>, params: array<{PARAM}>>"
TYPE = f"struct<name: string, id: string, kind: string, base: string, supers: array<string>, embeds: array<string>, entry_point: boolean, deprecated: boolean, is_error: boolean, doc: string, values: array<string>, referenced_types: array<string>, members: array<{MEMBER}>>"
FUNCTION = "struct<name: string, id: string, sig: string, ret: string, doc: string, deprecated: boolean>"
CONTAINER = f"struct<name: string, condition: string, condition_chain: array<string>, export_path: string, types: array<{TYPE}>, functions: array<{FUNCTION}>>"
DEPENDENCY = "struct<package: string, is_stdlib: boolean, types: array<struct<name: string, kind: string>>>"
DIAGNOSTIC = "struct<id: string, text: string, level: int, target_type: string, target_member: string>"
INDEX = f"package string, version string, containers array<{CONTAINER}>, dependencies array<{DEPENDENCY}>, diagnostics array<{DIAGNOSTIC}>"
CROSS_LANGUAGE = "packageId string, ids map<string, string>"
FILES = "package_id string, rel_path string, ext string, size bigint, mtime_ticks bigint"
MESSAGE = "jsonrpc string, id string, method string, params string, result string, error string"
SAMPLE = "name string, description string, code string, filePath string"


def json_schema(schema, most: int = 10) -> dict:
    """A JSON schema of a Spark type, names as they are, at most ``most`` levels deep."""
    from pyspark.sql import types as T

    if most == 0:
        return {}
    if isinstance(schema, T.StructType):
        return {"type": "object", "properties": {f.name: json_schema(f.dataType, most - 1) for f in schema.fields}, "required": [f.name for f in schema.fields if not f.nullable]}
    if isinstance(schema, T.ArrayType):
        return {"type": "array", "items": json_schema(schema.elementType, most - 1)}
    if isinstance(schema, T.MapType):
        return {"type": "object", "additionalProperties": json_schema(schema.valueType, most - 1)}
    if isinstance(schema, T.BooleanType):
        return {"type": "boolean"}
    if isinstance(schema, T.IntegralType):
        return {"type": "integer"}
    return {"type": "number"} if isinstance(schema, T.NumericType) else {"type": "string"}
