"""License scans by sentence rules.

A text is read as words (lower case, letters, digits and inner dots), so line ends, indents, comment
marks and blank comment lines inside a sentence don't matter, and sentences known from licence texts
become identifiers; a licence rule is an ordered list of identifiers, and a document carries the licence
where its identifiers hold that list in order, with nothing but unknown sentences between. Of rules that
begin in one place, the one with most sentences wins. A full licence text is known by sentences that no other text holds.

Defined results: a null or empty text has no licence; a licence found twice is listed twice; rows keep
their ``doc_id``, repeated or null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massweave.llm.arrow import by_bytes, table
from massweave.llm.common import small_batches

#: Rules as (licence, its sentences in order), from the published licence texts and notices.
PUBLISHED: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    )),
    ("Apache-2.0", (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    )),
    ("Apache-2.0", (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    )),
    ("Apache-2.0", ("\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",)),
    ("GPL-3.0", (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    )),
    ("GPL-3.0", ("You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",)),
    ("GPL-3.0", ("The GNU General Public License is a free, copyleft license for software and other kinds of works.",)),
    ("GPL-2.0", ("You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",)),
    ("GPL-2.0", ("You can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",)),
    ("GPL-2.0", ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc.",)),
    ("LGPL-2.1", ("You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",)),
    ("LGPL-2.1", ("This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1.",)),
    ("LGPL-3.0", ("You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",)),
    ("LGPL-3.0", ("This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",)),
    ("AGPL-3.0", ("You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",)),
    ("AGPL-3.0", ("The GNU Affero General Public License is a free, copyleft license for software and other kinds of works",)),
    ("BSD-3-Clause", (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    )),
    ("BSD-3-Clause", (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "May be used to endorse or promote products derived from this software without specific prior written permission.",
    )),
    ("BSD-4-Clause", (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
        "May be used to endorse or promote products derived from this software without specific prior written permission.",
    )),
    ("BSD-2-Clause", (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    )),
    ("ISC", ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",)),
    ("ISC", ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",)),
    ("MPL-2.0", ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",)),
    ("MIT-0", ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",)),
    ("0BSD", ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",)),
    ("Apache-2.0", (
        "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions:",
    )),
    ("MPL-2.0", ("Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license:", "All distribution of Covered Software in Source Code Form, including any Modifications that You create or to which You contribute, must be under the terms of this License.")),
    ("EPL-1.0", ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",)),
    ("EPL-2.0", ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",)),
    ("EPL-2.0", ("THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\").",)),
    ("CC0-1.0", ("has waived all copyright and related or neighboring rights to this work.",)),
    ("CC0-1.0", ("To the greatest extent permitted by, but not in contravention of, applicable law, Affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives, abandons, and surrenders all of Affirmer's Copyright and Related Rights",)),
    ("Unlicense", ("This is free and unencumbered software released into the public domain.",)),
    ("Zlib", ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",)),
    ("BSL-1.0", ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",)),
    ("CDDL-1.0", ("The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\").", "You may not use this file except in compliance with the License.")),
    ("Artistic-2.0", ("This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed.",)),
    ("MS-PL", ("This license governs use of the accompanying software.", "If you use the software, you accept this license.")),
    ("GPL-2.0", ("The GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",)),
    ("GPL-3.0", ("The GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.",)),
    ("LGPL-2.0", ("You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2 of the License",)),
    ("LGPL-2.0", ("You can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License",)),
    ("LGPL-2.0", ("GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",)),
    ("JSON", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The Software shall be used for Good, not Evil.",
    )),
    ("MIT", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    )),
    ("BSD-2-Clause", (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    )),
    ("BSD-3-Clause", (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    )),
    ("WTFPL", ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",)),
    ("WTFPL", ("You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2, as published by Sam Hocevar.",)),
    ("PSF-2.0", ("This LICENSE AGREEMENT is between the Python Software Foundation (\"PSF\"), and the Individual or Organization (\"Licensee\") accessing and otherwise using this software (\"Python\") in source or binary form and its associated documentation.",)),
    ("OFL-1.1", ("This Font Software is licensed under the SIL Open Font License, Version 1.1.",)),
    ("PostgreSQL", ("Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",)),
)

#: Licence names as short notices give them; a version follows the name.
TITLES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License",), "ISC": ("ISC License",), "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"), "MPL-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPLv2"), "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPLv2.1"), "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPLv3"), "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPLv3"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, version 2.0"), "BSL-1.0": ("Boost Software License, Version 1.0",), "Unlicense": ("Unlicense",), "Zlib": ("zlib License",),
}
#: The public licences of one family, with their parts' names.
CREATIVE = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
VERSIONS = {"3.0": "Unported", "4.0": "International"}
OPENINGS = ("Licensed under", "Released under", "Distributed under", "This project is licensed under", "This work is licensed under", "This software is licensed under", "This code is licensed under")


def short_rules() -> Iterator[tuple[str, tuple[str, ...]]]:
    """Rules of one sentence: each opening with each title, and each licence's identifier line."""
    for name, titles in TITLES.items():
        for opening in OPENINGS:
            yield from ((name, (f"{opening} the {title}.",)) for title in titles)
    for kind, long in CREATIVE.items():
        for version, area in VERSIONS.items():
            for opening in OPENINGS:
                for title in (f"CC {kind} {version}", f"a Creative Commons {long} {version} {area} License", f"the Creative Commons {long} {version} {area} License"):
                    yield f"CC-{kind}-{version}", (f"{opening} {title}.",)
    names = dict.fromkeys([*(n for n, _ in PUBLISHED), *TITLES, *(f"CC-{k}-{v}" for k in CREATIVE for v in VERSIONS)])
    for name in names:
        for suffix in ("-only", "-or-later", "") if "GPL" in name else ("",):
            yield name, (f"SPDX-License-Identifier: {name}{suffix}",)


RULES: tuple[tuple[str, tuple[str, ...]], ...] = (*PUBLISHED, *short_rules())

#: A sentence ends at a stop, mark or colon before white space, unless the line goes on in lower case, and at a line's end unless the next line does.
BREAK = re.compile(r"(?<=[.!?:;])(?:[\x20\x09]+(?=[^a-z])|[\x20\x09]*[\x0A-\x0D]+)|\n(?![\x20\x09]*[a-z])")
#: Words of a text or sentence; a line comment's word at a line's start is none.
WORD = re.compile(r"[a-z0-9]+(?:\.[a-z0-9]+)*", re.ASCII | re.IGNORECASE)
REMARK = re.compile(r"^[\x20\x09]*(?:dnl|@?rem|c)(?=[\x20\x09])", re.ASCII | re.IGNORECASE | re.MULTILINE)
#: A known sentence of so many words is found anywhere, a shorter one between breaks only.
LONG = 12
#: Words by which a known sentence is looked up.
HEAD = 3


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


#: Each known sentence holds one of these.
SIGNS = ("licen", "permission", "redistribut", "warrant", "copyright", "acknowledg", "public domain", "gpl", "under cc", "derivative works", "good, not evil")


@lru_cache(maxsize=1)
def rulebook() -> tuple[dict[tuple[str, ...], int], list[tuple[str, tuple[int, ...]]]]:
    """Sentence to identifier, and the rules over identifiers."""
    ids: dict[tuple[str, ...], int] = {}
    rules = [(name, tuple(ids.setdefault(tuple(words_of(s)), len(ids)) for s in sentences)) for name, sentences in RULES]
    return ids, rules


@lru_cache(maxsize=1)
def heads() -> dict[tuple[str, ...], list[tuple[str, ...]]]:
    """Known sentences by their first words, the longest first."""
    out: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
    for s in sorted(rulebook()[0], key=len, reverse=True):
        out.setdefault(s[:HEAD], []).append(s)
    return out


@lru_cache(maxsize=1)
def openings() -> dict[int, list[tuple[str, tuple[int, ...]]]]:
    """Rules by their first sentence, the longest first."""
    out: dict[int, list[tuple[str, tuple[int, ...]]]] = {}
    for rule in sorted(rulebook()[1], key=lambda r: -len(r[1])):
        out.setdefault(rule[1][0], []).append(rule)
    return out


def known_sentences(text: str) -> list[tuple[int, int, int]]:
    """Known sentences as (identifier, first, last), in order; of those that begin at one word the longest."""
    low = text.lower()
    if not any(s in low for s in SIGNS):
        return []
    plain = REMARK.sub(lambda m: " " * len(m[0]), text)
    words = words_of(plain)
    ids, by_head = rulebook()[0], heads()
    spans = [m.span() for m in WORD.finditer(plain)]

    def breaks(i: int) -> list[tuple[int, int]]:
        """Breaks (begin, end) before word i; the text's begin and end count as breaks."""
        a, b = spans[i - 1][1] if i else 0, spans[i][0] if i < len(spans) else len(text)
        cuts = [(a + m.start(), a + m.end()) for m in BREAK.finditer(text[a : b + 1]) if a + m.end() <= b]
        return ([] if i else [(0, 0)]) + cuts + ([] if i < len(spans) else [(b, b)])

    found, at = [], 0
    while at < len(words):
        for s in by_head.get(tuple(words[at : at + HEAD]), ()):
            end = at + len(s)
            if tuple(words[at:end]) != s:
                continue
            before, after = breaks(at), breaks(end)
            line_end = s[0] == "spdx" and re.search(r"[\x0A-\x0D]", text[spans[end - 1][1] : spans[end][0] if end < len(spans) else len(text)])
            if len(s) >= LONG or (before and (after or line_end)):
                first = before[-1][1] if before else spans[at][0]
                last = after[0][0] if after else spans[end - 1][1]
                found.append((ids[s], first, last))
                at = end - 1
                break
        at += 1
    return found


def licences(text: str) -> list[tuple[str, int, int]]:
    """Licences as (name, first, last): at each known sentence the longest rule that begins there; its sentences are then used up."""
    by_first = openings()
    sentences, out, at = known_sentences(text), [], 0
    ids = [s[0] for s in sentences]
    while at < len(ids):
        best = next((r for r in by_first.get(ids[at], ()) if tuple(ids[at : at + len(r[1])]) == r[1]), None)
        if best:
            out.append((best[0], sentences[at][1], sentences[at + len(best[1]) - 1][2]))
        at += len(best[1]) if best else 1
    return out


#: An identifier line that names several licences, with AND, OR, WITH an exception, and parentheses.
EXPRESSION = re.compile(r"SPDX-License-Identifier:[\x20\x09]*((?:[(\x20\x09]*[A-Za-z0-9.+-]+[)\x20\x09]*)(?:(?:AND|OR|WITH)(?:[(\x20\x09]+[A-Za-z0-9.+-]+[)\x20\x09]*))+)", re.ASCII)
OPERAND = re.compile(r"(?:(AND|OR|WITH)[(\x20\x09]+)?[(\x20\x09]*([A-Za-z0-9.+-]+)", re.ASCII)


def expressions(text: str) -> list[tuple[str, int, int]]:
    """The known licences that identifier lines with operators name, each where it stands; what follows WITH is no licence."""
    if "SPDX" not in text:
        return []
    known, out = {name for name, _ in RULES}, []
    for line in EXPRESSION.finditer(text):
        for m in OPERAND.finditer(text, *line.span(1)):
            name = re.sub(r"(?:-only|-or-later|\+)$", "", m[2])
            if m[1] != "WITH" and name in known:
                out.append((name, *m.span(2)))
    return out


def named_licences(text: str) -> list[tuple[str, int, int]]:
    """Licences by rules and by expressions, in order."""
    return sorted(licences(text) + expressions(text), key=lambda x: (x[1], x[2], x[0]))


def license_scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_licenses, licenses, spans`` for each row; ``spans``: (license, first, last) in code points."""

    def scan(batches):
        schema = None
        span = pa.list_(pa.struct([("license", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
        for batch, texts in by_bytes(batches):
            schema = schema or pa.schema([batch.schema.field("doc_id"), ("spans", span)])
            yield table(schema, doc_id=batch.column("doc_id"), spans=[[{"license": n, "first": a, "last": b} for n, a, b in named_licences(t)] for t in texts])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = small_batches(rows).mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<license:string,first:bigint,last:bigint>>")
    return found.select("doc_id", F.size("spans").cast("bigint").alias("n_licenses"), F.array_join(F.array_sort(F.array_distinct("spans.license")), ",").alias("licenses"), "spans")


def license_digest(docs: DataFrame) -> DataFrame:
    """``license_scan`` with its spans as text."""
    named = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["license"], s["first"], s["last"])), ",")
    return license_scan(docs).withColumn("spans", named)
