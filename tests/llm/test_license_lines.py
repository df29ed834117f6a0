"""Licence scan on notice lines as they stand in documents."""

from certus.llm.licenses import scan_licenses


def test_bare_all_rights_reserved(spark):
    rows = [(1, "kamu lomi ranka.\nAll rights reserved.\nkiki mura"), (2, "Copyright 2019 Some Company. All rights reserved."), (3, "all the rights of the reserved seats")]
    got = {r.doc_id: (r.families, r.n_notices) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("all-rights-reserved", 1), 2: ("all-rights-reserved", 1), 3: ("", 0)}
