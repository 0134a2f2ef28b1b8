"""Licence texts as they usually stand in files: wrapped over lines, plain or in comments."""

import textwrap

from driftpanel.llm import licenses

#: Texts of public licences as they stand in files.
MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL = """This program is free software%s you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version %d of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""


def test_wrapped_texts_are_found(spark):
    texts = [MIT, APACHE, GPL % (":", 3), GPL % (";", 2), BSD, ISC]
    forms = [lambda t: t, lambda t: textwrap.indent(t, " * ", lambda _: True), lambda t: textwrap.indent(t, "// ").replace("\n", "\r\n"), lambda t: "\n\n".join(textwrap.fill(p, 40) for p in t.split("\n\n"))]
    rows = [(100 * j + i, f(t)) for j, f in enumerate(forms) for i, t in enumerate(texts)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = [("mit-text", 2), ("apache2-header", 5), ("gpl3-header", 3), ("gpl2-header", 3), ("bsd-text", 3), ("isc-text", 1)]
    assert sorted((r.doc_id, r.rule, r.n_sentences) for r in found) == sorted((100 * j + i, *want[i]) for j in range(len(forms)) for i in range(len(texts)))


def test_blank_lines_and_sentence_ends_part_sentences(spark):
    texts = ["Released under\n\nthe MIT License", "Released under. The MIT License of old", "x. Released under\nthe MIT License\nAll rights\nreserved. y", "A thing\nthat is Released under\nthe MIT License", "note: all rights reserved", "All rights reserved: see it"]
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert sorted((r.doc_id, r.rule, r.first) for r in found) == [(2, "mit-notice", 1), (2, "reserved", 3)]
