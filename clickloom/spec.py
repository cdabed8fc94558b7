"""Feature specifications: plain declarations, checked when they are made."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The type names a specification may use, in its own spelling.
TYPE_NAMES = {
    "Int": T.IntegerType(),
    "Float32": T.FloatType(),
    "String": T.StringType(),
    "IntVec": T.ArrayType(T.IntegerType()),
    "Float32Vec": T.ArrayType(T.FloatType()),
    "StringVec": T.ArrayType(T.StringType()),
    "MapStringFloat32": T.MapType(T.StringType(), T.FloatType()),
    "MapIntFloat32": T.MapType(T.IntegerType(), T.FloatType()),
}
ALIASES = {
    "int": "Int",
    "int32": "Int",
    "float": "Float32",
    "float32": "Float32",
    "str": "String",
    "string": "String",
}
WIDE = ("int64", "long", "float64", "double")


def type_name(name: str) -> str:
    """Canonical type name; 64-bit and unknown names are refused."""
    if name.lower() in WIDE:
        raise ValueError(f"{name}: 64-bit types are not allowed in a specification")
    canonical = ALIASES.get(name.lower(), name)
    if canonical not in TYPE_NAMES:
        raise ValueError(f"unknown type {name!r}; known: {sorted(TYPE_NAMES)}")
    return canonical


def spark_type(name: str) -> T.DataType:
    return TYPE_NAMES[type_name(name)]


def const_type(value: Any) -> str:
    """Type name of a constant; lists must be non-empty and of one type."""
    if isinstance(value, bool) or isinstance(value, Mapping):
        raise ValueError(f"constant {value!r} has an unsupported type")
    if isinstance(value, str):
        return "String"
    if isinstance(value, int):
        return "Int"
    if isinstance(value, float):
        return "Float32"
    if isinstance(value, (list, tuple)) and value:
        kinds = {const_type(v) for v in value}
        if len(kinds) == 1 and not next(iter(kinds)).endswith("Vec"):
            return kinds.pop() + "Vec"
    raise ValueError(f"constant {value!r} has an unsupported type")


@dataclass(frozen=True)
class DenseField:
    """A number, or a vector of ``size`` numbers, with an optional transform.

    ``bucketize`` counts the ``bounds`` up to the number; without any, equal-mass
    ``buckets`` are fitted.
    """

    name: str
    default: float = 0.0
    op: str | None = None
    p: float | None = None
    q: float | None = None
    size: int = 1
    generation: int = 2
    transform: Callable[[Column], Column] | None = None
    buckets: int = 10
    bounds: tuple[float, ...] = ()


@dataclass(frozen=True)
class CategoryField:
    """One category per row; an empty ``vocab`` is fitted from data."""

    name: str
    default: Any = ""
    vocab: tuple = ()
    min_cnt: int = 1
    oov_equals_default: bool = True
    before_vocab: str | None = None
    share: str | None = None
    group: str = "default"


@dataclass(frozen=True)
class TokensField:
    """Several categories joined by ``sep``; cut or padded to ``max_len``."""

    name: str
    default: str = ""
    sep: str = " "
    max_len: int = 9
    vocab: tuple = ()
    min_cnt: int = 1
    weight: str | None = None
    pooling: str = "mean"
    share: str | None = None
    group: str = "default"
    pad_first: bool = True


@dataclass(frozen=True)
class VectorField:
    """A pretrained vector written as delimited text."""

    name: str
    dim: int
    sep: str = ","


Field = DenseField | CategoryField | TokensField | VectorField


@dataclass(frozen=True)
class Source:
    """Where a profile value comes from: join role, profile number, column."""

    key_type: str
    pid: int
    column: str
    no_cache: bool | None = None


KEY_TYPES = ("user_id", "item_id", "item_owner_id", "ctx")


@dataclass(frozen=True)
class ProfileField:
    """One column fetched from a profile and the feature made of it.

    ``expr`` is a function of no arguments that returns a Column over the
    fetched columns; ``None`` passes the value through unchanged.
    """

    name: str
    default: Any
    datatype: str
    source: Source | None = None
    expr: Callable[[], Column] | None = None
    expr_text: str | None = None
    consts: Mapping[str, Any] | None = None
    out: str | None = None

    def __post_init__(self):
        kind = type_name(self.datatype)
        want = {
            str: ("String",),
            int: ("Int", "Float32"),
            float: ("Int", "Float32"),
            list: ("Vec",),
            tuple: ("Vec",),
            dict: ("Map",),
        }.get(type(self.default))
        if want is None or not any(w in kind if w in ("Vec", "Map") else w == kind for w in want):
            raise ValueError(f"{self.name}: default {self.default!r} does not fit {kind}")
        if self.source is not None and self.source.key_type not in KEY_TYPES:
            raise ValueError(f"{self.name}: unknown key type {self.source.key_type!r}")
        if self.expr is None and kind.startswith("Map"):
            raise ValueError(f"{self.name}: a map cannot be a feature without an expression")
        if self.expr is None and (self.consts or self.out or self.expr_text):
            raise ValueError(f"{self.name}: constants and output name need an expression")
        if self.consts is not None:
            if not self.consts:
                raise ValueError(f"{self.name}: pass None instead of empty constants")
            for key, value in self.consts.items():
                const_type(value)
                if self.expr_text is not None and key not in self.expr_text:
                    raise ValueError(f"{self.name}: constant {key!r} is not used")

    @property
    def output(self) -> str:
        return self.out or self.name

    def column(self) -> Column:
        return (F.col(self.name) if self.expr is None else self.expr()).alias(self.output)


def check_names(names: Sequence[str], what: str) -> None:
    seen, twice = set(), []
    for n in names:
        if n in seen:
            twice.append(n)
        seen.add(n)
    if twice:
        raise ValueError(f"{what} listed more than once: {sorted(set(twice))}")


@dataclass(frozen=True)
class DeclaredColumn:
    """One declared output column with its storage type."""

    out: str
    dtype: str
    expr: str | None = None


# Storage types of a dataset document.
STORAGE_TYPES = {
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "float32": T.FloatType(),
    "string": T.StringType(),
    "vector": T.ArrayType(T.FloatType()),
}


@dataclass(frozen=True)
class DatasetSpec:
    """Labels, features and pass-through columns of one dataset."""

    labels: tuple[DeclaredColumn, ...]
    features: tuple[DeclaredColumn, ...]
    passthrough: tuple[DeclaredColumn, ...] = ()
    versions: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self):
        check_names([c.out for c in self.labels], "labels")
        check_names([c.out for c in self.features], "features")
        for c in self.columns():
            if c.dtype not in STORAGE_TYPES:
                raise ValueError(f"{c.out}: unknown storage type {c.dtype!r}")

    def columns(self) -> tuple[DeclaredColumn, ...]:
        return self.labels + self.features + self.passthrough

    def choose(
        self, labels: Sequence[str], features: Sequence[str] | str, with_user: bool = True
    ) -> "DatasetSpec":
        """A narrower copy in the requested order; this spec stays as it is."""
        if isinstance(features, str):
            features = self.versions[features]
        check_names(labels, "labels")
        check_names(features, "features")

        def pick(wanted, known, what):
            by_name = {c.out: c for c in known}
            missing = [w for w in wanted if w not in by_name]
            if missing:
                raise KeyError(f"{what} not in the specification: {missing}")
            return tuple(by_name[w] for w in wanted)

        rest = self.passthrough
        if with_user and "user_id" not in [c.out for c in rest] and "user_id" not in features:
            rest = rest + (DeclaredColumn("user_id", "string", "str(user_id)"),)
        return replace(
            self,
            labels=pick(labels, self.labels, "labels"),
            features=pick(features, self.features, "features"),
            passthrough=rest,
        )

    def to_struct_type(self) -> T.StructType:
        return T.StructType([T.StructField(c.out, STORAGE_TYPES[c.dtype], True) for c in self.columns()])

    def to_json(self) -> str:
        as_list = lambda cols: [
            {"out": c.out, "expr": c.expr or c.out, "feature_column": {"dtype": c.dtype}} for c in cols
        ]
        return json.dumps(
            {
                "label": as_list(self.labels),
                "features": as_list(self.features),
                "field": as_list(self.passthrough),
            }
        )

    @staticmethod
    def from_json(text: str) -> "DatasetSpec":
        doc = json.loads(text)

        def cols(key):
            return tuple(DeclaredColumn(d["out"], d["feature_column"]["dtype"], d.get("expr")) for d in doc.get(key, []))

        return DatasetSpec(cols("label"), cols("features"), cols("field"))


def online_document(fields: Sequence[ProfileField], version: int = 1) -> dict:
    """Serving document: ``schema`` by name and the ordered ``features``.

    Version 2 writes a positive profile number into the column text as
    ``"pid:column"``.
    """
    check_names([f.name for f in fields], "profile fields")
    schema, features = {}, []
    for f in fields:
        if f.source is not None:
            source: dict[str, Any] = {"key_type": f.source.key_type}
            if version == 1:
                source["pid"] = f.source.pid
                source["field"] = f.source.column
            else:
                source["field"] = f"{f.source.pid}:{f.source.column}" if f.source.pid > 0 else f.source.column
            if f.source.no_cache is not None:
                source["no_cache"] = f.source.no_cache
            schema[f.name] = {"type": type_name(f.datatype), "default": f.default, "source": source}
        entry: dict[str, Any] = {"expr": f.expr_text or f.name, "out": f.output}
        if f.consts:
            entry["consts"] = {
                k: {"value": list(v) if isinstance(v, tuple) else v, "type": const_type(v)}
                for k, v in f.consts.items()
            }
        features.append(entry)
    doc: dict[str, Any] = {"schema": schema, "features": features}
    return {"version": 2, **doc} if version == 2 else doc


def fields_from_document(doc: Mapping, exprs: Mapping[str, Callable[[], Column]] | None = None) -> list[ProfileField]:
    """Profile fields of a serving document, either version.

    Features whose expression is their own name pass through.  Every other
    feature takes its Column function from ``exprs`` by output name.
    """
    exprs = exprs or {}
    left = dict(doc["schema"])
    out: list[ProfileField] = []

    def source_of(name: str) -> dict[str, Any]:
        entry = left.pop(name)
        s = entry["source"]
        pid, _, column = s["field"].rpartition(":") if "pid" not in s else (s["pid"], "", s["field"])
        where = Source(s["key_type"], int(pid or 0), column, s.get("no_cache"))
        return {"default": entry["default"], "datatype": entry["type"], "source": where}

    check_names([f["out"] for f in doc["features"]], "features")
    for f in doc["features"]:
        name = f["out"]
        known = source_of(name) if name in left else {"default": "", "datatype": "String"}
        if f["expr"] == name:
            out.append(ProfileField(name, **known))
            continue
        if name not in exprs:
            raise KeyError(f"{name}: no Column function for expression {f['expr']!r}")
        consts = {k: c["value"] for k, c in f["consts"].items()} if f.get("consts") else None
        out.append(ProfileField(name, expr=exprs[name], expr_text=f["expr"], consts=consts, **known))
    for name in list(left):  # fetched for other features' expressions only
        known = source_of(name)
        out.append(ProfileField(name, expr=lambda name=name: F.col(name), expr_text=name, **known))
    return out


def expand_names(templates: Sequence[str]) -> list[str]:
    """``a_{14/7}d`` -> ``a_14d, a_7d``; blank lines and ``#`` lines are skipped."""
    out: list[str] = []
    for line in templates:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        names = [line]
        while any("{" in n for n in names):
            names = [
                head + choice + tail
                for n in names
                for head, _, rest in [n.partition("{")]
                for inner, _, tail in [rest.partition("}")]
                for choice in inner.split("/")
            ]
        out += names
    return out
