"""The output contract as a tree, and a walk over documents of any shape that lists every violation with its path.

Documents are parsed as VARIANT, so a wrong type, a missing field, a null and an unknown field are told apart, where a fixed
schema would read them all as null. The walk is one expression built from the tree and stays in the JVM: objects are read as
maps, arrays element by element; nothing is read twice for another field.

Kinds: not_json, wrong_document (an evaluation report), missing, null, type, unknown, value (outside what the field allows),
bounds (an event outside the recording), order (an event that begins before the one ahead of it).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VIOLATION = "array<struct<path:string,kind:string,told:string>>"


@dataclass(frozen=True)
class Scalar:
    """kind: string, number, integer or boolean. allowed: a test of the value, as a string, that says what it wants."""

    kind: str
    allowed: Callable[[Column], Column] | None = None
    wants: str = ""


@dataclass(frozen=True)
class Part:
    of: Scalar | Listed | Fields
    required: bool = True
    nullable: bool = False


@dataclass(frozen=True)
class Listed:
    of: Scalar | Listed | Fields


@dataclass(frozen=True)
class Fields:
    """An object. closed: other fields are violations."""

    parts: dict[str, Part] = field(default_factory=dict)
    closed: bool = True


def _share(x: Column) -> Column:
    return x.cast("double").between(0, 1)


EVENT = Fields(
    {
        "description": Part(Scalar("string")),
        "start_s": Part(Scalar("number")),
        "end_s": Part(Scalar("number")),
        "confidence": Part(Scalar("number", _share, "0 to 1")),
        "evidence": Part(Scalar("string"), required=False),
        "partial": Part(Scalar("boolean"), required=False),
        "source_windows": Part(Listed(Scalar("integer")), required=False),
    }
)
RUN = Fields(
    {
        "model": Part(Scalar("string")),
        "backend": Part(Scalar("string", lambda x: x.isin("vllm", "stub"), "vllm or stub"), required=False),
        **{name: Part(Scalar("number")) for name in ("sample_fps", "window_s", "stride_s", "elapsed_s")},
        **{name: Part(Scalar("integer")) for name in ("windows", "model_calls")},
        "stub": Part(Scalar("boolean"), required=False),
    }
)
RESULT = Fields(
    {
        "video": Part(Scalar("string")),
        "duration_s": Part(Scalar("number")),
        "queries": Part(Listed(Scalar("string"))),
        "events": Part(Listed(EVENT), required=False),
        "run": Part(RUN),
        "polls": Part(Listed(Fields(closed=False)), required=False, nullable=True),
    }
)
#: What an evaluation report has, and a result has not.
REPORT_FIELDS = ("predictions", "overall")
EDGE_S = 1e-6


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _none() -> Column:
    return F.array().cast(VIOLATION)


def _one(path: Column, kind: str, told: Column | str) -> Column:
    told = F.lit(told) if isinstance(told, str) else told
    return F.array(F.struct(path.alias("path"), F.lit(kind).alias("kind"), told.alias("told")))


def _type_of(v: Column) -> Column:
    """string, number, integer, boolean, list or object of a variant that is neither missing nor null."""
    name = F.schema_of_variant(v)
    whole = name.isin("BIGINT", "INT", "SMALLINT", "TINYINT")
    number = whole | name.isin("DOUBLE", "FLOAT") | F.startswith(name, F.lit("DECIMAL"))
    integral = F.try_variant_get(v, "$", "double") == F.floor(F.try_variant_get(v, "$", "double"))
    kinds = F.when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(whole | (number & integral), "integer").when(number, "number")
    return kinds.when(F.startswith(name, F.lit("ARRAY")), "list").otherwise("object")


def walk(v: Column, contract: Scalar | Listed | Fields, path: Column) -> Column:
    """Violations of a variant that is neither missing nor null."""
    wrong = lambda want: _one(path, "type", F.concat(F.lit(f"{want}, not "), _type_of(v)))
    if isinstance(contract, Scalar):
        kind = _type_of(v)
        fits = kind.isin("number", "integer") if contract.kind == "number" else kind == contract.kind
        if contract.allowed is None:
            return F.when(fits, _none()).otherwise(wrong(contract.kind))
        ok = F.coalesce(contract.allowed(F.try_variant_get(v, "$", "string")), F.lit(False))
        return F.when(~fits, wrong(contract.kind)).when(ok, _none()).otherwise(_one(path, "value", contract.wants))
    if isinstance(contract, Listed):
        at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        item = lambda x, i: F.when(F.is_variant_null(x), _one(at(i), "null", "a value")).otherwise(walk(x, contract.of, at(i)))
        return _let(F.try_variant_get(v, "$", "array<variant>"), lambda a: F.when(a.isNull(), wrong("list")).otherwise(F.flatten(F.transform(a, item))))

    def fields(m: Column) -> Column:
        found = []
        for name, part in contract.parts.items():
            own, x = F.concat(path, F.lit(f".{name}")), F.element_at(m, F.lit(name))
            missing = _one(own, "missing", "a value") if part.required else _none()
            null = _none() if part.nullable else _one(own, "null", "a value")
            found.append(F.when(~F.map_contains_key(m, name), missing).when(F.is_variant_null(x), null).otherwise(walk(x, part.of, own)))
        if contract.closed:
            others = F.array_except(F.map_keys(m), F.array(*[F.lit(n) for n in contract.parts]))
            found.append(F.transform(others, lambda k: F.struct(F.concat(path, F.lit("."), k).alias("path"), F.lit("unknown").alias("kind"), F.lit("no such field").alias("told"))))
        return F.when(m.isNull(), wrong("object")).otherwise(F.concat(*found) if found else _none())

    return _let(F.try_variant_get(v, "$", "map<string,variant>"), fields)


def _invariants(v: Column) -> Column:
    """Events outside the recording and out of order, as far as their times are numbers."""
    def time(x: Column, name: str) -> Column:
        return _let(F.try_variant_get(x, f"$.{name}", "variant"), lambda y: F.when(_type_of(y).isin("number", "integer"), F.try_variant_get(y, "$", "double")))

    spans = F.transform(F.try_variant_get(v, "$.events", "array<variant>"), lambda x: F.struct(time(x, "start_s").alias("s"), time(x, "end_s").alias("e")))
    at = lambda i: F.concat(F.lit("$.events["), i.cast("string"), F.lit("]"))
    last = time(v, "duration_s") + EDGE_S

    def rules(a: Column) -> Column:
        outside = F.transform(a, lambda x, i: F.when(F.coalesce((x["s"] < 0) | (x["e"] > last), F.lit(False)), _one(at(i), "bounds", "inside the recording")).otherwise(_none()))
        before = lambda x, i: F.get(a, i - 1)
        late = F.transform(a, lambda x, i: F.when((i > 0) & F.coalesce((x["s"] < before(x, i)["s"]) | ((x["s"] == before(x, i)["s"]) & (x["e"] < before(x, i)["e"])), F.lit(False)), _one(at(i), "order", "by start, then end")).otherwise(_none()))
        return F.coalesce(F.concat(F.flatten(outside), F.flatten(late)), _none())

    return _let(spans, rules)


def violations(docs: DataFrame, text: str = "text", contract: Fields = RESULT, invariants: bool = True) -> DataFrame:
    """docs' other columns with path, kind and told (what the contract wants) of every violation of each document."""
    v, root = F.col("_v"), F.lit("$")
    has = lambda name: F.variant_get(v, f"$.{name}", "variant").isNotNull()
    report = has(REPORT_FIELDS[0]) & has(REPORT_FIELDS[1])
    whole = walk(v, contract, root)
    found = F.concat(whole, _invariants(v)) if invariants else whole
    rules = F.when(v.isNull(), _one(root, "not_json", "a JSON document")).when(F.is_variant_null(v), _one(root, "null", "a value")).when(report, _one(root, "wrong_document", "a result, not an evaluation report")).otherwise(found)
    parsed = docs.withColumn("_v", F.try_parse_json(text))
    return parsed.withColumn("_x", F.explode(rules)).select(*[c for c in docs.columns if c != text], "_x.*")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """filename and text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"), F.col("value").alias("text"))
