import json
import logging

import pytest

from paperlane import config as C
from paperlane.errors import Configuration, SourceUnreadable
from paperlane.observe import get_logger, log_step

JOB = {"profile_id": "job", "required_anchors": ["job"], "fields": [{"key": "a", "labels": ["A"], "value_type": "number"}, {"key": "b", "labels": ["B"]}, {"key": "c", "labels": ["C"]}], "rules": [{"name": "r", "left": "a", "operands": ["b", "c"]}]}


@pytest.mark.parametrize(
    "make",
    [
        lambda: C.TabularOptions(header_row=0), lambda: C.TabularOptions(max_rows=-1), lambda: C.TabularOptions(delimiter=";;"), lambda: C.TabularOptions(decimal_separator="'"), lambda: C.TabularOptions(decimal_separator=".", group_separators="."),
        lambda: C.TabularOptions(date_formats=()), lambda: C.TabularOptions(true_values=("X",), false_values=("x",)), lambda: C.TextLayerOptions(0), lambda: C.TextLayerOptions(merged_span_ratio=1.5), lambda: C.CaptureConfig(redundancy_tolerance=-1),
        lambda: C.CaptureConfig(extension_routing={".x": "nope"}), lambda: C.CaptureConfig(allow_external_processing=True), lambda: C.CaptureConfig().external_processing("ocr"), lambda: C.TableSchema(()), lambda: C.ColumnSpec("k", ()),
        lambda: C.ColumnSpec("k", ("h",), "money"), lambda: C.TableSchema((C.ColumnSpec("k", ("h",)),), ("x",)), lambda: C.TableSchema((C.ColumnSpec("k", ("h",)),) * 2), lambda: C.TableSchema.from_dict({"columns": [{"key": "k", "headers": "h"}]}),
        lambda: C.Profile.from_dict(JOB | {"required_anchors": []}), lambda: C.Profile.from_dict(JOB | {"fields": JOB["fields"][:2]}), lambda: C.Rule("r", "a", ("b",)), lambda: C.Rule("r", "a", ("a", "b")), lambda: C.Rule("r", "a", ("b", "c"), "quotient"),
    ],
)
def test_what_is_refused(make):
    with pytest.raises(Configuration):
        make()


def test_round_trips(tmp_path):
    config = C.CaptureConfig(input_root="in", human_only_field_types=("x",), tabular=C.TabularOptions(decimal_separator=","))
    C.save_config(config, str(tmp_path / "c.json"))
    assert C.load_config(str(tmp_path / "c.json")) == config
    assert C.CaptureConfig.from_dict({"unknown": 1, "tabular": {"max_rows": 3, "other": 2}}).tabular.max_rows == 3
    schema = C.TableSchema((C.ColumnSpec("k", ("h",), "date", True, "f"),), ("k",))
    assert C.TableSchema.from_dict(json.loads(json.dumps(schema.to_dict()))) == schema
    profile = C.Profile.from_dict(JOB)
    assert C.Profile.from_dict(json.loads(json.dumps(profile.to_dict()))) == profile and profile.field_for("a").value_type == "number"
    (tmp_path / "bad.json").write_text("[]")
    for name in ("bad.json", "none.json"):
        with pytest.raises(SourceUnreadable):
            C.load_config(str(tmp_path / name))


def test_no_secret_is_written(tmp_path):
    path = tmp_path / "c.json"
    path.write_text("before")
    with pytest.raises(Configuration):
        C.no_secrets({"a": {"api_token": "x"}})
    assert path.read_text() == "before"
    path.write_text(json.dumps({"password": "x"}))
    with pytest.raises(Configuration):
        C.load_config(str(path))


def test_profiles_of_a_folder(tmp_path):
    for name, data in (("b.json", JOB | {"profile_id": "two"}), ("a.json", JOB), ("x.txt", {})):
        (tmp_path / name).write_text(json.dumps(data))
    found = C.load_profiles(str(tmp_path))
    assert [p.profile_id for p in found] == ["job", "two"]
    assert [p.profile_id for p in C.select_profiles(found, ("two",))] == ["two"] and C.select_profiles(found, ()) == found
    with pytest.raises(Configuration):
        C.select_profiles(found, ("three",))
    (tmp_path / "c.json").write_text(json.dumps(JOB))
    with pytest.raises(Configuration, match="c.json"):
        C.load_profiles(str(tmp_path))
    (tmp_path / "c.json").write_text("{")
    with pytest.raises(Configuration, match="c.json"):
        C.load_profiles(str(tmp_path))


def test_the_log_has_no_content(caplog):
    with caplog.at_level(logging.INFO):
        log_step(get_logger("t"), "read", rows=3, kind="tabular")
        for bad in ("/home/x", "C:\\x", "x" * 200, "a\nb"):
            with pytest.raises(Configuration):
                log_step(get_logger("t"), "read", value=bad)
    assert "read kind=tabular rows=3" in caplog.text


def test_the_entry_can_be_imported_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], cwd=root, check=True)
