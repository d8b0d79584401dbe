"""JSON Schemas of outputs: a subset of draft 2020-12, light schemas compiled to Columns, inference from outputs, and where a schema comes from."""

from __future__ import annotations

import json
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.operators.gates import _problems

KINDS = {"integer": "integer", "int": "integer", "number": "number", "float": "number", "boolean": "boolean", "bool": "boolean", "text": "text"}


def is_json_schema(spec) -> bool:
    """Whether a schema is a JSON Schema, not a light one."""
    return isinstance(spec, dict) and ("$schema" in spec or spec.get("type") == "object" or "properties" in spec or "required" in spec)


def type_name(spec) -> str:
    """What a light schema's value asks for."""
    if isinstance(spec, (list, tuple)):
        return "categorical"
    return "nested" if isinstance(spec, dict) else KINDS.get(spec, "any") if isinstance(spec, str) else "any"


def _is(value, kind: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return {
        "object": isinstance(value, dict), "array": isinstance(value, list), "string": isinstance(value, str), "boolean": isinstance(value, bool), "null": value is None,
        "number": number, "integer": number and float(value).is_integer(),
    }.get(kind, True)


def _same(a, b) -> bool:
    """Equality of JSON values: true is not 1."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    return a == b


def violations(value, spec, root=None, path: str = "$") -> list[str]:
    """Paths and keywords that a value breaks.

    Known: type, enum, const, numeric and length bounds, multipleOf, pattern, items, prefixItems, contains, uniqueItems,
    properties, patternProperties, additionalProperties, propertyNames, required, dependentRequired, allOf, anyOf, oneOf, not,
    if/then/else, and local $ref. Others are passed over.
    """
    root = spec if root is None else root
    if isinstance(spec, bool):
        return [] if spec else [f"{path}: false"]
    out: list[str] = []
    if "$ref" in spec:
        to = root
        for part in spec["$ref"].lstrip("#").strip("/").split("/"):
            if part:
                to = to[part.replace("~1", "/").replace("~0", "~")]
        out += violations(value, to, root, path)
    say = lambda word, ok: out.append(f"{path}: {word}") if not ok else None
    kinds = spec.get("type")
    if kinds is not None:
        say("type", any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)))
    if "enum" in spec:
        say("enum", any(_same(value, v) for v in spec["enum"]))
    if "const" in spec:
        say("const", _same(value, spec["const"]))
    if _is(value, "number"):
        for word, ok in (("minimum", lambda b: value >= b), ("maximum", lambda b: value <= b), ("exclusiveMinimum", lambda b: value > b), ("exclusiveMaximum", lambda b: value < b), ("multipleOf", lambda b: abs(value / b - round(value / b)) < 1e-9)):
            if word in spec:
                say(word, ok(spec[word]))
    if isinstance(value, str):
        for word, ok in (("minLength", lambda b: len(value) >= b), ("maxLength", lambda b: len(value) <= b), ("pattern", lambda b: re.search(b, value) is not None)):
            if word in spec:
                say(word, ok(spec[word]))
    if isinstance(value, list):
        first = spec.get("prefixItems", [])
        for i, (v, s) in enumerate(zip(value, first, strict=False)):
            out += violations(v, s, root, f"{path}[{i}]")
        if "items" in spec:
            for i, v in enumerate(value[len(first) :], len(first)):
                out += violations(v, spec["items"], root, f"{path}[{i}]")
        for word, ok in (("minItems", lambda b: len(value) >= b), ("maxItems", lambda b: len(value) <= b), ("uniqueItems", lambda b: not b or all(not _same(v, w) for i, v in enumerate(value) for w in value[:i]))):
            if word in spec:
                say(word, ok(spec[word]))
        if "contains" in spec:
            say("contains", any(not violations(v, spec["contains"], root) for v in value))
    if isinstance(value, dict):
        for k in spec.get("required", []):
            say(f"required {k}", k in value)
        for k, more in spec.get("dependentRequired", {}).items():
            say(f"dependentRequired {k}", k not in value or all(m in value for m in more))
        for word, ok in (("minProperties", lambda b: len(value) >= b), ("maxProperties", lambda b: len(value) <= b)):
            if word in spec:
                say(word, ok(spec[word]))
        patterns = spec.get("patternProperties", {})
        for k, v in value.items():
            if "propertyNames" in spec:
                out += violations(k, spec["propertyNames"], root, f"{path}.{k}")
            known = k in spec.get("properties", {})
            if known:
                out += violations(v, spec["properties"][k], root, f"{path}.{k}")
            for p, s in patterns.items():
                if re.search(p, k):
                    known = True
                    out += violations(v, s, root, f"{path}.{k}")
            if not known and "additionalProperties" in spec:
                rest = violations(v, spec["additionalProperties"], root, f"{path}.{k}")
                out += [f"{path}.{k}: additionalProperties"] if spec["additionalProperties"] is False else rest
    for s in spec.get("allOf", []):
        out += violations(value, s, root, path)
    if "anyOf" in spec:
        say("anyOf", any(not violations(value, s, root) for s in spec["anyOf"]))
    if "oneOf" in spec:
        say("oneOf", sum(not violations(value, s, root) for s in spec["oneOf"]) == 1)
    if "not" in spec:
        say("not", bool(violations(value, spec["not"], root)))
    if "if" in spec:
        branch = "else" if violations(value, spec["if"], root) else "then"
        if branch in spec:
            out += violations(value, spec[branch], root, path)
    return out


def validated(df: DataFrame, text: str, spec: dict, strict: bool = True, extra: bool = True) -> DataFrame:
    """df with schema_parsed, schema_pass and schema_problems under a JSON Schema or a light one; the root must be an object."""

    @F.pandas_udf("parsed boolean, problems array<string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                value = json.loads(t)
            except (TypeError, ValueError, RecursionError):
                out.append((False, ["$: not JSON"]))
                continue
            if not isinstance(value, dict):
                out.append((True, ["$: not an object"]))
            elif is_json_schema(spec):
                out.append((True, violations(value, spec)))
            else:
                out.append((True, _problems(value, spec, "", strict, extra)))
        return pd.DataFrame(out, columns=["parsed", "problems"])

    out = df.withColumn("_s", run(F.col(text)))
    return out.withColumn("schema_parsed", F.col("_s.parsed")).withColumn("schema_problems", F.col("_s.problems")).withColumn("schema_pass", F.size("_s.problems") == 0).drop("_s")


def summary(df: DataFrame) -> DataFrame:
    """One row: rows, parse and valid rates, and the most frequent problems."""
    top = df.select(F.explode("schema_problems").alias("p")).groupBy("p").count().orderBy(F.desc("count"), "p").limit(5)
    top = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), F.col("p")))), lambda s: F.concat(s["p"], F.lit(" x"), (-s["c"]).cast("string"))), "; ").alias("problems"))
    rates = df.agg(F.count("*").alias("n"), F.avg(F.col("schema_parsed").cast("double")).alias("parse_rate"), F.avg(F.col("schema_pass").cast("double")).alias("valid_rate"), F.count_if(~F.col("schema_pass")).alias("invalid"))
    return rates.crossJoin(F.broadcast(top))  # one row


def light_column(text: Column, spec: dict, strict: bool = True) -> Column:
    """A light schema as a Column, without Python: whether an object's text holds what it asks for, extra keys allowed."""
    v = F.try_parse_json(text)
    ok = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return ok & _light(v, spec, "$", strict)


def _light(v: Column, spec: dict, path: str, strict: bool) -> Column:
    ok = F.lit(True)
    for k, s in spec.items():
        at = f"{path}.{k}"
        x = F.try_variant_get(v, at, "variant")
        kind = F.schema_of_variant(x)
        as_text = F.try_variant_get(v, at, "string")
        if isinstance(s, dict):
            one = kind.startswith("OBJECT") & _light(v, s, at, strict)
        elif isinstance(s, (list, tuple)):
            one = as_text.isin(*map(str, s))
        else:
            one = {
                "text": (kind == "STRING") & (as_text != ""), "integer": kind == "BIGINT", "number": kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), "boolean": kind == "BOOLEAN",
            }.get(KINDS.get(s, ""), F.lit(True))
        ok = ok & F.when(x.isNull(), F.lit(not strict)).otherwise(F.coalesce(one, F.lit(False)))
    return ok


def _node(rows: list[dict], ratio: float, choices: int, depth: int, deepest: int = 2) -> dict:
    held = Counter(k for r in rows for k in r)
    out: dict = {}
    for k in sorted(k for k, c in held.items() if c / max(len(rows), 1) >= ratio):
        values = [r[k] for r in rows if r.get(k) is not None]
        nested = [v for v in values if isinstance(v, dict)]
        if values and len(nested) >= 0.7 * len(values) and depth < deepest:
            out[k] = _node(nested, ratio, choices, depth + 1, deepest) or "text"
            continue
        texts = [t for v in values if (t := str(v).strip())]
        kinds = sorted(set(texts))
        few = 1 < len(kinds) <= choices and len(kinds) / max(len(texts), 1) <= 0.25
        out[k] = kinds if few or (len(kinds) == 1 and len(texts) >= 3) else "text"
    return out


#: Objects that a schema is inferred from, by a hash of their text.
SAMPLE_ROWS = 20_000


def infer(df: DataFrame, text: str, ratio: float = 0.90, choices: int = 8, objects: float = 0.30, rows: int = SAMPLE_ROWS) -> tuple[dict | None, float]:
    """A light schema of the keys that nearly all objects hold, and the share of objects; none below a share of them.

    Choices where there are few kinds of value, a constant where there is one, objects two deep; from at most `rows` rows.
    """
    v = F.try_parse_json(F.col(text))
    x = df.select(F.col(text).alias("t"), F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)).alias("o"))
    share = x.agg(F.avg(F.col("o").cast("double"))).first()[0] or 0.0
    if share < objects:
        return None, share
    sample = [json.loads(r.t) for r in x.where("o").select("t").orderBy(F.xxhash64("t"), "t").limit(rows).collect()]  # a bounded sample
    return _node(sample, ratio, choices, 0) or None, share


def resolve(df: DataFrame, text: str, path: str | None = None, inline: str | None = None, default: dict | None = None, **kw) -> tuple[dict | None, str]:
    """The schema to hold outputs against, and where it comes from: a file, a text, a default, the outputs themselves, or none."""
    if path:
        raw = "\n".join(r.value for r in df.sparkSession.read.text(path).collect())  # one schema
        return json.loads(raw), f"file {path}"
    if inline:
        return json.loads(inline), "inline"
    if default:
        return dict(default), "default"
    spec, share = infer(df, text, **kw)
    return spec, "inferred" if spec else f"none ({share:.2f} of the outputs are objects)"


def closed(conflicts: dict[str, set[str]]) -> dict[str, set[str]]:
    """Conflicts made mutual; everything conflicts with itself."""
    out = {k: {k, *v} for k, v in conflicts.items()}
    for k, v in conflicts.items():
        for other in v:
            out.setdefault(other, {other}).add(k)
    return out


# Instructions that can't be followed together.
CONFLICTS = {
    "change_case:english_capital": {"change_case:english_lowercase"},
    "detectable_format:json_format": {"detectable_format:title", "detectable_format:number_bullet_lists", "startend:quotation", "startend:end_checker", "combination:two_responses"},
    "combination:two_responses": {"detectable_format:constrained_response", "startend:quotation"},
    "detectable_format:constrained_response": {"startend:end_checker", "startend:quotation"},
    "startend:quotation": {"startend:end_checker"},
}
