import textwrap

from pagewarden.llm import license_scan


def gnu(name, what, version):
    return [
        "Copyright (C) 2021 Jo Doe",
        f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published by the Free Software Foundation, "
        f"either version {version} of the License, or (at your option) any later version.",
        f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  "
        f"See the GNU {name} General Public License for more details.",
        f"You should have received a copy of the GNU {name} General Public License along with this {what}.  If not, see <https://www.gnu.org/licenses/>.",
    ]


MPL = [
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
]
APACHE = [
    "Copyright 2020 Jo Doe",
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "    http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
    "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
]
MIT = [
    "MIT License",
    "Copyright (c) 2022 Jo Doe",
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
]
NOTICES = {
    "GPL-2.0": gnu("", "program", "2"), "GPL-3.0": gnu("", "program", "3"), "LGPL-2.1": gnu("Lesser", "library", "2.1"), "LGPL-3.0": gnu("Lesser", "library", "3"),
    "AGPL-3.0": gnu("Affero", "program", "3"), "MPL-2.0": MPL, "Apache-2.0": APACHE,
}
CODE = "\n".join(f"value_{i} = compute({i}) + other_{i}" for i in range(200))


def wrapped(paragraphs, mark="", width=66):
    lines = []
    for p in paragraphs:
        lines += [*textwrap.wrap(" ".join(p.split()), width), ""]
    return "\n".join(f"{mark} {x}".rstrip() if mark else x for x in lines[:-1])


def styles(paragraphs):
    yield wrapped(paragraphs, "#") + "\n" + CODE
    yield "import x\n" + wrapped(paragraphs, "//", 50) + "\n" + CODE
    yield "/*\n" + wrapped(paragraphs, " *") + "\n */\n" + CODE
    yield wrapped(paragraphs).replace("\n", "\r\n") + "\r\n\r\n" + CODE


def test_wrapped_headers_and_licence_files(spark):
    rows, want = [], {}
    for name, paragraphs in NOTICES.items():
        for i, text in enumerate(styles(paragraphs)):
            rows.append((f"{name}/{i}/a.c", text))
            want[rows[-1][0]] = (name, "header")
    files = {
        "mit/LICENSE": ("MIT", wrapped(MIT)),
        "gpl3/COPYING": ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n"
            " Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n\n" + "The freedom to share and change works. " * 200),
    }
    for path, (name, text) in files.items():
        rows += [(path, text), (path.split("/")[0] + "/src/x.py", "x = 1")]
        want[path], want[rows[-1][0]] = (name, "file"), (name, "inherited")
    rows += [("none/a.c", "# Redistribute the load\n# over all workers,\n# as the licence server does\n" + CODE)]
    want["none/a.c"] = (None, None)
    got = {r["path"]: (r["license"], r["origin"]) for r in license_scan.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {p: (got[p], w) for p, w in want.items() if got[p] != w} == {}
