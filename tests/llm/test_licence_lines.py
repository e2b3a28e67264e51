"""Licence lines as they stand in the table, and the long licences."""

import os
from collections import Counter
from importlib import resources

from keysnap.llm import licences
from keysnap.llm.common import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
NAMES = {"GNU General Public License": "GPL-3.0", "Apache License": "Apache-2.0", "MIT License": "MIT", "CC BY-NC": "CC-BY-NC-4.0"}


def test_every_licence_line_of_the_table_is_found(spark):
    docs = table(spark, SF, "documents")
    want = Counter()
    for r in docs.collect():
        lines = [x for x in (r["text"] or "").split("\n") if "under" in x and len(x) < 100]
        for name in {v for x in lines for k, v in NAMES.items() if k in x}:
            want[name] += 1
    got = Counter(n for r in licences.scan_licences(docs).collect() for n in r["notices"].split(",") if n)
    assert got == want and set(want) == set(NAMES.values())


def test_wordings_and_long_texts(spark):
    under = [f"{s} under the GNU General Public License{v}." for s in ("Licensed", "This work is licensed", "Released")
             for v in (" v3", ", version 3", " Version 3.0", ", v. 3")]
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    folder = resources.files("keysnap.llm").joinpath("licence_files")
    long = {k: folder.joinpath(f"{k}.txt").read_text() for k in files}
    docs = [(x, x) for x in under] + [(k, " ".join(t.upper().split(" "))) for k, t in long.items()] + [("no", under[0] + " Not.")]
    frame = spark.createDataFrame(docs, "doc_id string, text string")
    got = {r["doc_id"]: r["licence"] for r in licences.scan_licences(frame).collect()}
    assert got == {**{x: "GPL-3.0" for x in under}, **files, "no": None}
