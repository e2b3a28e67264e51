"""Families as descriptors name them."""

import pytest

from keysnap.queries.registry import binary_descriptor
from keysnap.sources.descriptors import DescriptorError, format_descriptor, parse_descriptor, read_families
from keysnap.sources.listing import list_slice_files
from keysnap.sources.slice_files import copy_slice_files
from test_files_archive import put, slices

NAMES = ["f", "Größe", "x" * 127, "y" * 128, "z" * 300]


@pytest.mark.parametrize("form", [format_descriptor, binary_descriptor])
@pytest.mark.parametrize("families", [[], ["f"], NAMES])
def test_formats(form, families):
    assert parse_descriptor(form("tänzer", families)) == ("tänzer", families)


def test_objects_as_families():
    text = b' {"name": "t", "families": [{"name": "a", "versions": 3}, "b"], "other": 1}'
    assert parse_descriptor(text) == ("t", ["a", "b"])


def test_damaged_descriptors():
    whole = binary_descriptor("t", ["f", "g"])
    for n in range(len(whole)):
        with pytest.raises(DescriptorError):
            parse_descriptor(whole[:n])
    for bad in (b"", b"data", b"{", b'{"name": 1, "families": []}', b'{"name": "t"}', b'{"name": "t", "families": [""]}',
                b"\xff" * 40, (9).to_bytes(4, "big") + whole[4:], whole[:4] + b"\x88" + whole[5:]):
        with pytest.raises(DescriptorError):
            parse_descriptor(bad)


def test_a_table_with_a_bad_descriptor_fails_alone(spark, tmp_path):
    """Unreadable, naming a family without a directory, naming a path, naming nothing, and a good one."""
    described = {"bad": b"data", "lacks": format_descriptor("lacks", ["f", "g"]), "up": format_descriptor("up", ["../x"]),
                 "none": format_descriptor("none", []), "good": binary_descriptor("good", ["f"])}
    for name, data in described.items():
        put(tmp_path / name / ".tableinfo.1", data)
        put(tmp_path / name / "s0/.regioninfo", b"m")
        put(tmp_path / name / "s0/f/file", b"12345")
    rows = spark.createDataFrame([(n, str(tmp_path / n / ".tableinfo.1")) for n in described], "table_name string, path string")
    found = {(r.table_name, r.family, r.error and r.error.split(":")[0]) for r in read_families(rows).collect()}
    unreadable = "descriptor unreadable"
    assert found == {("bad", None, unreadable), ("up", None, unreadable), ("lacks", "f", None), ("lacks", "g", None), ("good", "f", None)}
    listed = list_slice_files(slices(spark, *[f"{n}/s0" for n in described]), str(tmp_path))
    outcomes = {r.table_name: (r.status, r.files) for r in copy_slice_files(listed, str(tmp_path), str(tmp_path / "copy")).collect()}
    assert outcomes == {"bad": ("failed", 0), "lacks": ("failed", 0), "up": ("failed", 0), "none": ("copied", 1), "good": ("copied", 2)}
