"""Licence scans by sentence rules, in DataFrame expressions only.

A text is cut into pieces at its line ends and sentence ends, normalised to lower-case letters and
digits. A known sentence of public licences (in some, any name of up to eight words may stand for the owner's) is one piece, or the pieces of lines that follow one
another without a sentence end or a blank line between (the text is wrapped, maybe in a comment of
marks other than letters and digits); of two at one place the longer counts. A colon ends a sentence
if the texts before and after it are known. Known sentences become identifiers, and a rule names a
licence by an ordered sequence of identifiers that must follow one another among the known sentences
of a text. A match inside a longer one is dropped. All of it happens within the row: nothing is
shuffled.

Null and empty texts, and texts without a known sentence, give no rows; texts of any length are
read whole. Repeated rows each give their matches; of rules that match the same sentences each gives
a row; other columns are ignored, whatever their names; null ids stay null.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once

#: Sentences of public licences and notices as they are written.
SENTENCES: dict[str, str] = {
    "apache2-notice": "Licensed under the Apache License, Version 2.0",
    "apache2-grant": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache2-use": "you may not use this file except in compliance with the License",
    "apache2-copy": "You may obtain a copy of the License at",
    "apache2-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache2-limits": "See the License for the specific language governing permissions and limitations under the License",
    "mit-notice": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-title": "The MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl2-notice": "This work is licensed under the GNU General Public License, version 2",
    "gpl-free": "This program is free software",
    "gpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    "gpl-published": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl2-either": "either version 2 of the License, or (at your option) any later version",
    "gpl3-either": "either version 3 of the License, or (at your option) any later version",
    "agpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl-free": "This library is free software",
    "lgpl-published": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "lgpl21-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl21-either": "either version 2.1 of the License, or (at your option) any later version",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "lgpl3-notice": "This work is licensed under the GNU Lesser General Public License, version 3",
    "mpl2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "mpl2-copy-https": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "boost-notice": "Distributed under the Boost Software License, Version 1.0",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense-public": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "epl2-grant": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc-by-4": "Licensed under CC BY 4.0",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0",
    "cc-by-nd-4": "Licensed under CC BY-ND 4.0",
    "cc-by-nc-sa-4": "Licensed under CC BY-NC-SA 4.0",
    "cc0": "Licensed under CC0 1.0",
    "reserved": "All rights reserved",
    "apache2-asf": "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements",
    "apache2-asf-notice": "See the NOTICE file distributed with this work for additional information regarding copyright ownership",
    "apache2-asf-grant": 'The ASF licenses this file to you under the Apache License, Version 2.0 (the "License")',
    "mit-project": "This project is licensed under the MIT License",
    "mit-project-file": "This project is licensed under the MIT License - see the LICENSE file for details",
    "mit-project-md": "This project is licensed under the MIT License - see the LICENSE.md file for details",
    "gpl2-only-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2",
    "gpl2-only-license": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2 of the License",
    "gpl3-only-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3",
    "gpl3-only-license": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License",
    "gpl2-version": "version 2 of the License",
    "gpl3-version": "version 3 of the License",
    "bsd-endorse-owner": "Neither the name of <owner> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse-own": "Neither the name of <owner> nor the names of their contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse-author": "The name of <owner> may not be used to endorse or promote products derived from this software without specific prior written permission",
}
#: Identifiers that stand behind "SPDX-License-Identifier:".
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later",
    "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
SENTENCES |= {f"spdx-{x}": f"SPDX-License-Identifier: {x}" for x in SPDX}
#: Rule -> (licence, its sentences in order).
RULES: dict[str, tuple[str, tuple[str, ...]]] = {
    "apache2-notice": ("Apache-2.0", ("apache2-notice",)),
    "apache2-grant": ("Apache-2.0", ("apache2-grant",)),
    "apache2-header": ("Apache-2.0", ("apache2-grant", "apache2-use", "apache2-copy", "apache2-basis", "apache2-limits")),
    "mit-notice": ("MIT", ("mit-notice",)),
    "mit-licensed": ("MIT", ("mit-licensed",)),
    "mit-text": ("MIT", ("mit-grant", "mit-keep")),
    "mit-whole": ("MIT", ("mit-grant", "mit-keep", "mit-as-is", "mit-liability")),
    "mit-titled-whole": ("MIT", ("mit-title", "mit-grant", "mit-keep", "mit-as-is", "mit-liability")),
    "mit-titled-text": ("MIT", ("mit-title", "mit-grant", "mit-keep")),
    "gpl3-notice": ("GPL-3.0", ("gpl3-notice",)),
    "gpl2-notice": ("GPL-2.0", ("gpl2-notice",)),
    "gpl3-header": ("GPL-3.0-or-later", ("gpl-free", "gpl3-terms", "gpl-hope")),
    "gpl2-header": ("GPL-2.0-or-later", ("gpl-free", "gpl2-terms", "gpl-hope")),
    "gpl3-header-parted": ("GPL-3.0-or-later", ("gpl-free", "gpl-published", "gpl3-either", "gpl-hope")),
    "gpl2-header-parted": ("GPL-2.0-or-later", ("gpl-free", "gpl-published", "gpl2-either", "gpl-hope")),
    "agpl3-header": ("AGPL-3.0-or-later", ("gpl-free", "agpl3-terms", "gpl-hope")),
    "lgpl21-header": ("LGPL-2.1-or-later", ("lgpl-free", "lgpl21-terms", "lgpl-hope")),
    "lgpl21-header-parted": ("LGPL-2.1-or-later", ("lgpl-free", "lgpl-published", "lgpl21-either", "lgpl-hope")),
    "lgpl3-header": ("LGPL-3.0-or-later", ("lgpl-free", "lgpl3-terms", "lgpl-hope")),
    "lgpl3-header-parted": ("LGPL-3.0-or-later", ("lgpl-free", "lgpl-published", "gpl3-either", "lgpl-hope")),
    "lgpl3-notice": ("LGPL-3.0", ("lgpl3-notice",)),
    "mpl2-form": ("MPL-2.0", ("mpl2-form",)),
    "bsd-text": ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    "bsd3-text": ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    "bsd2-whole": ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    "bsd3-whole": ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    "zlib-text": ("Zlib", ("zlib-as-is", "zlib-grant")),
    "boost-text": ("BSL-1.0", ("boost-grant",)),
    "boost-notice": ("BSL-1.0", ("boost-notice",)),
    "mpl2-header": ("MPL-2.0", ("mpl2-form", "mpl2-copy")),
    "mpl2-header-https": ("MPL-2.0", ("mpl2-form", "mpl2-copy-https")),
    "epl2-header": ("EPL-2.0", ("epl2-grant",)),
    "unlicense-text": ("Unlicense", ("unlicense-public", "unlicense-anyone")),
    "isc-text": ("ISC", ("isc-grant",)),
    "unlicense": ("Unlicense", ("unlicense-public",)),
    "cc-by-4": ("CC-BY-4.0", ("cc-by-4",)),
    "cc-by-sa-4": ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    "cc-by-nc-4": ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    "cc-by-nd-4": ("CC-BY-ND-4.0", ("cc-by-nd-4",)),
    "cc-by-nc-sa-4": ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4",)),
    "cc0": ("CC0-1.0", ("cc0",)),
    "reserved": ("all-rights-reserved", ("reserved",)),
    "apache2-asf": ("Apache-2.0", ("apache2-asf", "apache2-asf-notice", "apache2-asf-grant")),
    "apache2-asf-header": ("Apache-2.0", ("apache2-asf", "apache2-asf-notice", "apache2-asf-grant", "apache2-use", "apache2-copy", "apache2-basis", "apache2-limits")),
    "mit-project": ("MIT", ("mit-project",)),
    "mit-project-file": ("MIT", ("mit-project-file",)),
    "mit-project-md": ("MIT", ("mit-project-md",)),
    "gpl2-only": ("GPL-2.0-only", ("gpl-free", "gpl2-only-terms", "gpl-hope")),
    "gpl2-only-license": ("GPL-2.0-only", ("gpl-free", "gpl2-only-license", "gpl-hope")),
    "gpl2-only-parted": ("GPL-2.0-only", ("gpl-free", "gpl-published", "gpl2-version", "gpl-hope")),
    "gpl3-only": ("GPL-3.0-only", ("gpl-free", "gpl3-only-terms", "gpl-hope")),
    "gpl3-only-license": ("GPL-3.0-only", ("gpl-free", "gpl3-only-license", "gpl-hope")),
    "gpl3-only-parted": ("GPL-3.0-only", ("gpl-free", "gpl-published", "gpl3-version", "gpl-hope")),
}
RULES |= {f"spdx-{x}": (x, (f"spdx-{x}",)) for x in SPDX}
for name in ("bsd-endorse-owner", "bsd-endorse-own", "bsd-endorse-author"):  # the third condition under other names
    RULES |= {f"{name}-text": ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", name)), f"{name}-whole": ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", name, "bsd-as-is"))}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SENTENCE_END, NOT_PLAIN = r"[.!?;]+[ \t\r\n]+", r"[^a-z0-9\n]+"
#: In a plain text, which is lower case, S is a sentence end, and B and E enclose known sentences.
PLAIN = r"[^a-z0-9:\nS]+"


#: In a sentence it stands for a name of one to OWNER_WORDS words.
OWNER, OWNER_WORDS = "<owner>", 8


def normal(sentence: str) -> str:
    """Words parted by blanks; a name is ``@``."""
    return " @ ".join(re.sub(r"[^a-z0-9]+", " ", x.lower()).strip() for x in sentence.split(OWNER))


def marks(sentences: dict[str, str]) -> str:
    """Pattern of a known sentence in a plain text, from one boundary to the next. Of two that match
    the longer stands first, those with names last."""
    ordered = sorted({normal(s) for s in sentences.values()}, key=lambda s: ("@" in s, -len(s), s))
    gap = r"(?:[ :]+|[ :]*\n[ :]*)"
    known = "|".join(s.replace(" ", gap).replace("@", rf"[a-z0-9]+(?:{gap}[a-z0-9]+){{0,{OWNER_WORDS - 1}}}?") for s in ordered)
    end = r"(?=[ :]*(?:[\nS]|\z))"
    return rf"((?:^|[\nS]|\G(?!^) *:)[ :]*)({known})(?:{end}|(?= *:[ :]*(?:{known}){end}))"


def with_names(sentences: dict[str, str]) -> dict[str, str]:
    """Patterns of the normalised sentences that have a name in them."""
    return {k: "^" + normal(s).replace("@", f"[a-z0-9]+( [a-z0-9]+){{0,{OWNER_WORDS - 1}}}") + "$" for k, s in sentences.items() if OWNER in s}


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules: dict[str, tuple[str, tuple[str, ...]]] = RULES) -> DataFrame:
    """One row for each match: the id, rule, license, first (the number of its first sentence in
    the text, from 0) and n_sentences."""
    known = F.create_map(*[F.lit(x) for k, s in sentences.items() if OWNER not in s for x in (normal(s), k)])
    named = with_names(sentences)
    which = lambda x: F.coalesce(F.try_element_at(known, x), *[F.when(x.rlike(p), F.lit(k)) for k, p in named.items()])
    ends = F.regexp_replace(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER), SENTENCE_END, "S")
    marked = F.regexp_replace(F.regexp_replace(ends, PLAIN, " "), marks(sentences), "$1B$2E")
    cut = docs.select(F.col(id_col), once(F.split(marked, "B")).alias("p")).filter(F.size("p") > 1)
    cut = cut.select(id_col, "p", once(F.transform("p", lambda x: F.length(x) - F.length(F.translate(x, "\nS", "")))).alias("n"))
    before = lambda i: F.aggregate(F.slice("n", 1, i + 1), F.lit(0), lambda a, x: a + x)
    sentence = lambda x: F.trim(F.regexp_replace(F.substring_index(x, "E", 1), "[ :\n]+", " "))
    each = F.transform(F.slice("p", 2, F.size("p")), lambda x, i: F.struct(which(sentence(x)).alias("k"), before(i).alias("i")))
    ids = cut.select(id_col, once(each).alias("m"))
    table = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(lic).alias("license"), F.array(*map(F.lit, seq)).alias("seq")) for r, (lic, seq) in rules.items()])
    ids = ids.select(id_col, "m", once(F.transform("m", lambda x: x["k"])).alias("k"))
    at = F.flatten(F.transform("m", lambda x, i: F.transform(F.filter(table, lambda r: F.slice("k", i + 1, F.size(r["seq"])) == r["seq"]), lambda r: F.struct(r["rule"].alias("rule"), r["license"].alias("license"), i.alias("a"), (i + F.size(r["seq"])).alias("b"), x["i"].alias("first")))))
    found = ids.select(id_col, once(at).alias("f"))
    whole = F.filter("f", lambda x: ~F.exists("f", lambda y: (y["a"] <= x["a"]) & (y["b"] >= x["b"]) & (y["b"] - y["a"] > x["b"] - x["a"])))
    rows = found.select(id_col, F.explode(whole).alias("r"))
    return rows.select(id_col, "r.rule", "r.license", F.col("r.first").cast("bigint").alias("first"), (F.col("r.b") - F.col("r.a")).cast("bigint").alias("n_sentences"))


def oracle_sql() -> str:
    """The same as DuckDB SQL."""
    values = ", ".join(f"('{normal(s)}', '{k}')" for k, s in SENTENCES.items() if OWNER not in s)
    named = " ".join(f"when regexp_matches(s, '{p}') then '{k}'" for k, p in with_names(SENTENCES).items())
    rules = ", ".join(f"('{r}', '{lic}', {list(seq)})" for r, (lic, seq) in RULES.items())
    return f"""
with known(s, k) as (values {values}), rules(rule, license, seq) as (values {rules}),
cut as (select doc_id, string_split(regexp_replace(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SENTENCE_END}', chr(10), 'g'), '{NOT_PLAIN}', ' ', 'g'), chr(10)) as ss from documents),
each as (select doc_id, trim(unnest(ss)) as s, generate_subscripts(ss, 1) - 1 as i from cut),
met as (select doc_id, i, coalesce(known.k, case {named} end) as k from each left join known using (s)),
m as (select doc_id, k, i, row_number() over (partition by doc_id order by i) as a from met where k is not null),
lists as (select doc_id, list(k order by a) as ks from m group by doc_id),
f as (select m.doc_id, rule, license, a, a + len(seq) as b, i as first from m join rules on rules.seq[1] = m.k join lists using (doc_id) where ks[a : a + len(seq) - 1] = seq)
select doc_id, rule, license, first::bigint as first, (b - a)::bigint as n_sentences from f
where not exists (select 1 from f g where g.doc_id = f.doc_id and g.a <= f.a and g.b >= f.b and g.b - g.a > f.b - f.a)"""
