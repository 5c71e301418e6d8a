"""Hand-labelled licence notices: tags, references and official sentences, inline, commented and wrapped."""

import duckdb
import pytest

from tabaudit.llm import licenses

TAGGED = [
    ("SPDX-License-Identifier: MIT", "MIT"), ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("// SPDX-License-Identifier: GPL-3.0-only", "GPL-3.0-only"),
    ("/* SPDX-License-Identifier: MIT */", "MIT"), ("# SPDX-License-Identifier: BSD-3-Clause\nimport os", "BSD-3-Clause"), ("SPDX-License-Identifier: MIT OR Apache-2.0", "Apache-2.0,MIT"),
    ("SPDX-License-Identifier: (MIT AND BSD-2-Clause) OR ISC", "BSD-2-Clause,ISC,MIT"), ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0-only"),
    ("<!-- SPDX-License-Identifier: LGPL-2.1+ -->", "LGPL-2.1-or-later"), ("SPDX-License-Identifier: GPL-2.0+ OR MPL-2.0", "GPL-2.0-or-later,MPL-2.0"),
    ("SPDX-License-Identifier: CC0-1.0", "CC0-1.0"), ("SPDX-License-Identifier: Unlicense", "Unlicense"), ("-- SPDX-License-Identifier: AGPL-3.0", "AGPL-3.0-only"),
    ("SPDX-License-Identifier: Zlib\nSPDX-License-Identifier: BSL-1.0", "BSL-1.0,Zlib"), ("code\n; SPDX-License-Identifier: EPL-2.0\ncode", "EPL-2.0"), ("SPDX-License-Identifier: Own-1.0", ""),
    ("SPDX-License-Identifier: GPL-3.0", "GPL-3.0-only"), ("\" SPDX-License-Identifier: CC-BY-SA-4.0", "CC-BY-SA-4.0"),
]
NOTICES = [
    ("This file is licensed under the MIT License.", "MIT"), ("This project is licensed under the MIT License - see the LICENSE file for details.", "MIT"),
    ("Licensed under the MIT License - see LICENSE.", "MIT"), ("Licensed under the Apache License, Version 2.0 (the \"License\");", "Apache-2.0"),
    ("This crate is licensed under the\nApache License, Version 2.0", "Apache-2.0"), ("This file is not licensed under the MIT License.", ""),
    ("# This module is licensed under the\n# ISC License.", "ISC"), ("This tool is licensed under the Mozilla Public License 2.0.", "MPL-2.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one.", "MPL-2.0"),
    ("This library is free software; you can redistribute it and/or\n modify it under the terms of the GNU Lesser General Public\n License as published by the Free Software Foundation; either\n version 2.1 of the License, or (at your option) any later version.", "LGPL-2.1-or-later"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "AGPL-3.0-or-later"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"), ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("Licensed under CC-BY-4.0.", "CC-BY-4.0"), ("This package is licensed under the BSD 3-Clause License.", "BSD-3-Clause"),
    ("Released under the MIT License.", "MIT"), ("All rights reserved.", "Proprietary"), ("This work is in the public domain.", "Public-Domain"),
    ("The museum has a permission desk: ask there.", ""), ("A driving licence is needed. Bring it.", ""), ("", ""), ("word " * 50_000 + "\nSPDX-License-Identifier: MIT\n" + "word " * 50_000, "MIT"),
]


def test_hand_labelled_notices(spark):
    every = TAGGED + NOTICES
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(every)] + [(None, None)], "doc_id long, text string").repartition(4)
    for r in licenses.scan_licenses(docs).collect():
        want = every[r["doc_id"]][1] if r["doc_id"] is not None else ""
        assert set(r["licenses"].split(",")) == set(want.split(",")), every[r["doc_id"]][0][:200]
    assert len(every) >= 40


@pytest.mark.parametrize("more", [0, 1])
def test_sql_reads_tags_by_its_own_rule(spark, more):
    texts = [t for t, _ in TAGGED] + ["a line\nand SPDX-License-Identifier: MIT\nmore"] * more
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: set(r["licenses"].split(",")) for r in licenses.scan_licenses(docs.filter(f"doc_id < {len(TAGGED)}")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    names = [c[0] for c in con.execute(licenses.ORACLE).description]
    rows = [dict(zip(names, r)) for r in con.execute(licenses.ORACLE).fetchall()]
    assert {r["doc_id"]: set(r["licenses"].split(",")) for r in rows if r["doc_id"] < len(TAGGED)} == got
