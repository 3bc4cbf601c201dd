"""Options, table schemas and document profiles: plain frozen data, checked when they are made."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from pathlib import Path

from paperlane.errors import Configuration, SourceUnreadable
from paperlane.model import INPUT_KINDS, TABULAR, TEXT_LAYER, TYPES

GROUPS = " \u00a0\u202f\u2009'"
NOISE = ("~$*", "*.bak", "*.tmp", ".~lock.*", "Thumbs.db", ".DS_Store")
ROUTES = {".csv": TABULAR, ".xlsx": TABULAR, ".xlsm": TABULAR, ".pdf": TEXT_LAYER}
SECRETS = ("key", "secret", "token", "password", "credential")


def _need(ok: bool, why: str) -> None:
    if not ok:
        raise Configuration(why)


def _known(cls: type, data: dict) -> dict:
    names = {f.name for f in dataclasses.fields(cls)}
    return {k: tuple(map(tuple, v)) if k == "unit_brackets" else tuple(v) if isinstance(v, list) else v for k, v in data.items() if k in names}


@dataclass(frozen=True)
class TabularOptions:
    """How tables are read; no default assumes a locale."""

    header_row: int = 1
    data_starts_after_header: int = 0
    sheet_name: str = ""
    max_rows: int = 0
    delimiter: str = ""
    delimiter_candidates: tuple[str, ...] = (";", ",", "\t", "|")
    encoding_candidates: tuple[str, ...] = ("utf-8-sig", "utf-8")
    casefold_headers: bool = True
    strip_header_accents: bool = False
    unit_brackets: tuple[tuple[str, str], ...] = (("(", ")"), ("[", "]"))
    decimal_separator: str = ""
    group_separators: str = GROUPS
    date_formats: tuple[str, ...] = ("%Y-%m-%d",)
    true_values: tuple[str, ...] = ("true",)
    false_values: tuple[str, ...] = ("false",)

    def __post_init__(self) -> None:
        _need(self.header_row >= 1, "header_row counts from 1")
        _need(self.data_starts_after_header >= 0 and self.max_rows >= 0, "row numbers can't be negative")
        _need(len(self.delimiter) <= 1 and all(len(c) == 1 for c in self.delimiter_candidates), "a delimiter is one character")
        _need(bool(self.delimiter or self.delimiter_candidates), "no delimiter to choose from")
        _need(bool(self.encoding_candidates), "no encoding to try")
        _need(self.decimal_separator in ("", ".", ","), "the decimal separator is . or , or not given")
        _need(not self.decimal_separator or self.decimal_separator not in self.group_separators, "one character can't separate both groups and decimals")
        _need(bool(self.date_formats), "no date format")
        low = lambda v: {x.casefold() for x in v}
        _need(bool(self.true_values and self.false_values) and not low(self.true_values) & low(self.false_values), "true and false values must be given and differ")
        _need(all(len(a) == len(b) == 1 for a, b in self.unit_brackets), "a bracket is one character")

    @classmethod
    def from_dict(cls, data: dict) -> TabularOptions:
        return cls(**_known(cls, data))


@dataclass(frozen=True)
class TextLayerOptions:
    """When the text layer of a page counts as its text."""

    min_usable_chars: int = 32
    ambiguous_from: int = 1
    merged_span_ratio: float = 0.6

    def __post_init__(self) -> None:
        _need(self.min_usable_chars >= 1 and 0 < self.ambiguous_from <= self.min_usable_chars, "thresholds must be positive and in order")
        _need(0 < self.merged_span_ratio <= 1, "the span ratio lies in (0, 1]")

    @classmethod
    def from_dict(cls, data: dict) -> TextLayerOptions:
        return cls(**_known(cls, data))


@dataclass(frozen=True)
class CaptureConfig:
    """Everything a capture run can be told."""

    input_root: str = "."
    extension_routing: dict[str, str] = field(default_factory=lambda: dict(ROUTES))
    excluded_name_patterns: tuple[str, ...] = NOISE
    run_active_content: bool = False
    allow_external_processing: bool = False
    external_audit_note: str = ""
    enabled_profiles: tuple[str, ...] = ()
    human_only_field_types: tuple[str, ...] = ()
    redundancy_tolerance: float = 0.01
    tabular: TabularOptions = field(default_factory=TabularOptions)
    text_layer: TextLayerOptions = field(default_factory=TextLayerOptions)

    def __post_init__(self) -> None:
        _need(bool(self.input_root), "input_root is empty")
        _need(set(self.extension_routing.values()) <= set(INPUT_KINDS), "unknown input kind in the routing")
        _need(all(k.startswith(".") and k == k.lower() for k in self.extension_routing), "extensions are lower case and begin with a dot")
        _need(self.redundancy_tolerance >= 0, "the tolerance can't be negative")
        _need(not self.allow_external_processing or bool(self.external_audit_note.strip()), "external processing needs an audit note")

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)

    @classmethod
    def from_dict(cls, data: dict) -> CaptureConfig:
        """Unknown keys are left out; nested options are built from their dictionaries."""
        known = _known(cls, data)
        for name, kind in (("tabular", TabularOptions), ("text_layer", TextLayerOptions)):
            if isinstance(known.get(name), dict):
                known[name] = kind.from_dict(known[name])
        return cls(**known)

    def external_processing(self, adapter: str) -> None:
        """Refuse ``adapter`` unless processing elsewhere is allowed and accounted for."""
        _need(self.allow_external_processing, f"{adapter} would process data elsewhere, which is not allowed")


def no_secrets(data: dict, path: str = "") -> None:
    """Refuse a configuration that holds what looks like a secret."""
    for name, value in data.items():
        here = f"{path}{name}"
        if isinstance(value, dict):
            no_secrets(value, f"{here}.")
        elif isinstance(value, str) and value and any(s in name.lower() for s in SECRETS):
            raise Configuration(f"{here} looks like a secret; configurations hold none")


def save_config(config: CaptureConfig, path: str) -> None:
    data = config.to_dict()
    no_secrets(data)  # before the file is opened
    Path(path).write_text(json.dumps(data, indent=2, ensure_ascii=False, sort_keys=True), encoding="utf-8")


def _json(path: str) -> dict:
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as why:
        raise SourceUnreadable(f"{Path(path).name}: {why}") from why
    if not isinstance(data, dict):
        raise SourceUnreadable(f"{Path(path).name}: not a JSON object")
    return data


def load_config(path: str) -> CaptureConfig:
    data = _json(path)
    no_secrets(data)
    return CaptureConfig.from_dict(data)


def _names(value: object, what: str) -> tuple[str, ...]:
    _need(not isinstance(value, str), f"{what} is a list, not one string")
    out = tuple(value or ())
    _need(all(isinstance(x, str) and x.strip() for x in out), f"{what} holds an empty name")
    return out


@dataclass(frozen=True)
class ColumnSpec:
    """A declared column: its key, the headers it may have, its type."""

    key: str
    headers: tuple[str, ...]
    column_type: str = "text"
    required: bool = False
    field_type: str = ""

    def __post_init__(self) -> None:
        _need(bool(self.key.strip()), "a column has no key")
        _need(bool(self.headers), f"{self.key} has no header")
        _need(self.column_type in TYPES, f"{self.key}: unknown type {self.column_type}")


@dataclass(frozen=True)
class TableSchema:
    columns: tuple[ColumnSpec, ...]
    identity_keys: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        keys = [c.key for c in self.columns]
        _need(bool(keys), "a schema has columns")
        _need(len(keys) == len(set(keys)), "a key is declared twice")
        _need(set(self.identity_keys) <= set(keys), "an identity key isn't a column")

    def spec_for(self, key: str) -> ColumnSpec | None:
        return next((c for c in self.columns if c.key == key), None)

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)

    @classmethod
    def from_dict(cls, data: dict) -> TableSchema:
        columns = [ColumnSpec(str(c.get("key", "")), _names(c.get("headers"), "headers"), c.get("column_type", "text"), bool(c.get("required", False)), c.get("field_type") or "") for c in data.get("columns", ())]
        return cls(tuple(columns), _names(data.get("identity_keys", ()), "identity_keys"))


@dataclass(frozen=True)
class FieldSpec:
    """A field of a document: its key, the labels before its value, its type."""

    key: str
    labels: tuple[str, ...]
    value_type: str = "text"
    required: bool = False
    field_type: str = ""

    def __post_init__(self) -> None:
        _need(bool(self.key.strip()), "a field has no key")
        _need(bool(self.labels), f"{self.key} has no label")
        _need(self.value_type in TYPES, f"{self.key}: unknown type {self.value_type}")


@dataclass(frozen=True)
class Rule:
    """``left`` equals the product or the sum of ``operands``; no other operations, by design."""

    name: str
    left: str
    operands: tuple[str, ...]
    operation: str = "product"
    tolerance: float | None = None
    derive: bool = True

    def __post_init__(self) -> None:
        _need(bool(self.name.strip() and self.left.strip()), "a rule needs a name and a left side")
        _need(len(self.operands) >= 2, f"{self.name}: two operands at least")
        _need(self.left not in self.operands, f"{self.name}: the left side is its own operand")
        _need(self.operation in ("product", "sum"), f"{self.name}: unknown operation {self.operation}")
        _need(self.tolerance is None or self.tolerance >= 0, f"{self.name}: negative tolerance")


@dataclass(frozen=True)
class Profile:
    """A type of document: the anchors that show it, its fields and its rules."""

    profile_id: str
    required_anchors: tuple[str, ...] = ()
    optional_anchors: tuple[str, ...] = ()
    fields: tuple[FieldSpec, ...] = ()
    rules: tuple[Rule, ...] = ()
    description: str = ""

    def __post_init__(self) -> None:
        _need(bool(self.profile_id.strip()), "a profile has no id")
        _need(bool(self.required_anchors or self.optional_anchors), f"{self.profile_id}: no anchor")
        keys = [f.key for f in self.fields]
        _need(len(keys) == len(set(keys)), f"{self.profile_id}: a key is declared twice")
        for rule in self.rules:
            _need({rule.left, *rule.operands} <= set(keys), f"{self.profile_id}: {rule.name} names an unknown field")

    def field_for(self, key: str) -> FieldSpec | None:
        return next((f for f in self.fields if f.key == key), None)

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)

    @classmethod
    def from_dict(cls, data: dict) -> Profile:
        fields = [FieldSpec(str(f.get("key", "")), _names(f.get("labels"), "labels"), f.get("value_type", "text"), bool(f.get("required", False)), f.get("field_type") or "") for f in data.get("fields", ())]
        rules = [Rule(str(r.get("name", "")), str(r.get("left", "")), _names(r.get("operands"), "operands"), r.get("operation", "product"), r.get("tolerance"), bool(r.get("derive", True))) for r in data.get("rules", ())]
        return cls(str(data.get("profile_id", "")), _names(data.get("required_anchors", ()), "anchors"), _names(data.get("optional_anchors", ()), "anchors"), tuple(fields), tuple(rules), data.get("description", ""))


def load_profile(path: str) -> Profile:
    try:
        return Profile.from_dict(_json(path))
    except (Configuration, SourceUnreadable) as why:
        raise Configuration(f"{Path(path).name}: {why}") from why


def load_profiles(folder: str) -> list[Profile]:
    """All profiles of a folder in the order of their file names; an id that comes twice is refused."""
    _need(Path(folder).is_dir(), f"{folder} isn't a folder")
    found: dict[str, Profile] = {}
    for path in sorted(Path(folder).glob("*.json")):
        profile = load_profile(str(path))
        _need(profile.profile_id not in found, f"{path.name}: profile {profile.profile_id} is there already")
        found[profile.profile_id] = profile
    return list(found.values())


def select_profiles(profiles: list[Profile], enabled: tuple[str, ...]) -> list[Profile]:
    """The enabled ones, or all where none is named."""
    unknown = set(enabled) - {p.profile_id for p in profiles}
    _need(not unknown, f"unknown profiles: {sorted(unknown)}")
    return [p for p in profiles if not enabled or p.profile_id in enabled]
