from logloom.llm import licenses

APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at

#     http://www.apache.org/licenses/LICENSE-2.0

# Unless required"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def test_licenses_of_several_paragraphs_inside_other_texts(spark):
    inside = [(name, f"intro\n\nCopyright (c) 2020 X\n\n{cut.join(pieces)}\n\nend") for name, pieces in licenses.PIECES.items() for cut in ("\n\n", "\n \n\n\n")]
    inside += [(name, f"intro\n\n{text}\n\nend") for name, text in (("Apache-2.0", APACHE), ("GPL-3.0-or-later", GPL), ("MPL-2.0", MPL))]
    mit = licenses.PIECES["MIT"]
    texts = [t for _, t in inside] + ["x\n\n" + "\n\n".join([mit[0], "other", *mit[1:]]), "x\n\n" + "\n\n".join([*mit, *mit])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.license_id, r.n_notices, r.license_ids) for r in licenses.scan(docs).collect()}
    assert [got[i] for i in range(len(inside))] == [(None, 1, name) for name, _ in inside]
    assert got[len(inside)] == (None, 0, "") and got[len(inside) + 1] == (None, 2, "MIT")


def test_every_paragraph_of_a_run_passes_the_anchors():
    for _, run in licenses.known_runs():
        assert any(w in " ".join(run).lower() for w in licenses.RUN_WORDS) and any(a in " ".join(run).lower() for a in licenses.ANCHORS)
        assert all(any(a in p.lower() for a in licenses.RUN_ANCHORS) for p in run)
