import duckdb

from millrace.llm import licenses as L


def run(spark, rows):
    return {r.doc_id: (r.own_license, r.license, r.inherited_from) for r in L.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}


FILLER = "plain words of a source file without any statement of terms\n" * 4


def test_statements_and_inheritance(spark):
    rows = [
        (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (2, "a/b/c/x.py", FILLER),
        (3, "a/b/LICENSE.txt", "Released under the MIT License."),
        (4, "a/y.py", FILLER),
        (5, "a/b/z.py", FILLER + "This work is licensed under the GNU General Public License, version 3.\n" + FILLER),
        (6, "q/z.py", FILLER),
        (7, "q/c.py", FILLER + "Licensed under CC BY-NC 4.0."),
        (8, "a/bb/x.py", FILLER + "a license to think freely about everything one wants to do today and tomorrow"),
        (9, None, "All rights reserved."),
        (10, "a/b/n.py", None),
        (11, "x.py", ""),
    ]
    got = run(spark, rows)
    assert got == {
        1: ("Apache-2.0", "Apache-2.0", None), 2: (None, "MIT", "a/b"), 3: ("MIT", "MIT", None), 4: (None, "Apache-2.0", "a"), 5: ("GPL-3.0", "GPL-3.0", None), 6: (None, None, None),
        7: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None), 8: (None, "Apache-2.0", "a"), 9: ("Proprietary", "Proprietary", None), 10: (None, "MIT", "a/b"), 11: (None, None, None),
    }


def test_awkward_rows(spark):
    rows = [(1, "a/x", None, "q"), (1, "a/x", None, "q"), (None, "a/COPYING", "Released under the MIT License.\n" * 3000, "q"), (2, "a/y", "word " * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string, row string")
    out = sorted((str(r.doc_id), r.license) for r in L.scan(df).collect())
    assert out == [("1", "MIT"), ("1", "MIT"), ("2", "MIT"), ("None", "MIT")]
    assert L.scan(df.limit(0)).count() == 0


def test_headers_titles_identifiers_and_whole_texts(spark):
    mit = "Copyright (c) 2020 Foo\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    bare = mit.split("\n\n")[1]
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    rows = {
        "SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0", "Copyright (c) 2020 Foo Inc. All rights reserved.": "Proprietary",
        gpl: "GPL-3.0", gpl.replace("\n", " "): "GPL-3.0", gpl.replace("version 3", "version 2"): "GPL-2.0", "Mozilla Public License Version 2.0": "MPL-2.0", mit: "MIT", bare: "MIT", "GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991": "GPL-2.0",
        "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": "LGPL-3.0", "Apache License\n Version 2.0, January 2004": "Apache-2.0", ("one two three four five six " * 20) + "Licensed under the Apache License, Version 2.0. " + ("seven eight nine ten " * 30): "Apache-2.0",
        FILLER + gpl + "\n" + FILLER: "GPL-3.0", "a license to print money is not what one gets from copyright": None,
    }
    got = run(spark, [(i, f"d{i}/x.c", t) for i, t in enumerate([*rows, *[FILLER] * 1000])])
    assert {t: got[i][0] for i, t in enumerate(rows)} == rows


def test_identifier_expressions(spark):
    rows = {
        "SPDX-License-Identifier: Zlib": "Zlib", "# SPDX-License-Identifier: BSL-1.0": "BSL-1.0", "SPDX-License-Identifier: (MIT OR Apache-2.0)": "MIT OR Apache-2.0", "/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */": "GPL-2.0 WITH Linux-syscall-note",
        "SPDX-License-Identifier: MPL-2.0 and LGPL-2.1-or-later": "MPL-2.0 AND LGPL-2.1", "SPDX-License-Identifier: LicenseRef-Own": "LicenseRef-Own", "SPDX-License-Identifier: GPL-3.0+": "GPL-3.0", "SPDX-License-Identifier:": None,
        "Released under the MIT License.\nSPDX-License-Identifier: ISC": "ISC", "<!-- SPDX-License-Identifier: WTFPL -->": "WTFPL",
    }
    got = run(spark, [(i, f"d{i}/x.c", t) for i, t in enumerate([*rows, *[FILLER] * 200])])
    assert {t: got[i][0] for i, t in enumerate(rows)} == rows


def test_more_statements(spark):
    zlib = "This software is provided 'as-is', without any express or implied\nwarranty.  In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:"
    boost = "Distributed under the Boost Software License, Version 1.0.\n   (See accompanying file LICENSE_1_0.txt or copy at\n   http://www.boost.org/LICENSE_1_0.txt)"
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
    clause = "Redistributions of source code must retain the above copyright notice, this\nlist of conditions and the following disclaimer."
    cueless = "some notes\ncopyright is mentioned far away\n\n" + FILLER + "\n" + "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the\nterms, or (at your option) any later version."
    rows = {
        zlib: "Zlib", boost: "BSL-1.0", isc: "ISC", clause: "BSD-2-Clause", "Licensed under the BSD license": "BSD", "This file is under the BSD license.": "BSD", "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": "MIT OR Apache-2.0",
        "Released under the Foo License.": None, "Licensed under the Bar License, Version 2.0": None, cueless: "GPL-3.0",
    }
    got = run(spark, [(i, f"d{i}/x.c", t) for i, t in enumerate([*rows, *[FILLER] * 200])])
    assert {t: got[i][0] for i, t in enumerate(rows)} == rows


def test_ties(spark):
    """Two licences stated equally often in a directory: the first name counts; equal cosines: the first template."""
    rows = [(1, "a/LICENSE", "Released under the MIT License.\n" + FILLER), (2, "a/COPYING", "Licensed under CC BY-NC 4.0.\n" + FILLER), (3, "a/x.c", FILLER), (4, "b/y.c", "Licensed under CC BY 4.0.\nLicensed under CC BY-SA 4.0.")]
    got = run(spark, rows)
    assert got[3][1] == "CC-BY-NC-4.0" and got[4][0] == "CC-BY-4.0"


def test_sql_agrees(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    key = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    want = sorted(map(key, con.execute(L.oracle()).fetchall()))
    got = sorted(key(r) for r in L.scan(L.with_paths(spark.read.parquet(f"{folder}/documents.parquet"))).collect())
    assert [r[0] for r in got] == [r[0] for r in want] and got == want
