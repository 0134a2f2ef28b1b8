"""Licences with owners' names, by identifier, without later versions, and of a foundation's header."""

import textwrap

import pytest

from driftpanel.llm import licenses

#: Texts of public licences as they stand in files.
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. {third}

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
"""
END = "may be used to endorse or promote products derived from this software without specific prior written permission."
ASF = """Licensed to the Apache Software Foundation (ASF) under one or more
contributor license agreements.  See the NOTICE file distributed with
this work for additional information regarding copyright ownership.
The ASF licenses this file to You under the Apache License, Version 2.0
(the "License"); you may not use this file except in compliance with
the License.  You may obtain a copy of the License at

   http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{only}

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of merchantability.
"""


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [set() for _ in texts]
    for r in licenses.scan(df).collect():
        out[r.doc_id].add(r.license)
    return out


def wrapped(text):
    return "\n".join("\n".join(textwrap.wrap(line, 60)) for line in text.split("\n"))


@pytest.mark.parametrize("shape", [str, wrapped, lambda t: "\n".join(f" * {x}" for x in wrapped(t).split("\n"))])
def test_probes(spark, shape):
    probes = [
        (BSD.format(third=f"Neither the name of the University nor the names of its contributors {END}"), {"BSD-3-Clause"}),
        (BSD.format(third=f"Neither the name of Some Very Long Company Name Limited nor the names of its contributors {END}"), {"BSD-3-Clause"}),
        (BSD.format(third=f"Neither the name of the copyright holder nor the names of its contributors {END}"), {"BSD-3-Clause"}),
        (BSD.format(third="The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission."), {"BSD-3-Clause"}),
        (BSD.replace("3. {third}\n", ""), {"BSD-2-Clause"}),
        (ASF, {"Apache-2.0"}),
        (GPL.format(only=", version 3."), {"GPL-3.0-only"}),
        (GPL.format(only="; version 2 of the License."), {"GPL-2.0-only"}),
        (GPL.format(only="; either version 2 of the License, or (at your option) any later version."), {"GPL-2.0-or-later"}),
        ("// SPDX-License-Identifier: MIT\nint main() {}", {"MIT"}),
        ("# SPDX-License-Identifier: GPL-2.0-or-later\n", {"GPL-2.0-or-later"}),
        ("This project is licensed under the MIT License - see the LICENSE file for details.", {"MIT"}),
        ("The name of the game may not be used to endorse a player. All of it is prose.", set()),
    ]
    assert found(spark, [shape(t) for t, _ in probes]) == [want for _, want in probes]


def test_names_have_a_limit(spark):
    long = BSD.format(third=f"Neither the name of {'very ' * 30} long nor the names of its contributors {END}")
    assert found(spark, [long]) == [{"BSD-2-Clause"}]  # an owner of more than eight words is not known
