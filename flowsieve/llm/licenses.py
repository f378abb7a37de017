"""Licence scan by sentence rules.

Sentences are normalised (lower case, letters and digits only) and mapped to the identifiers of known licence
sentences; the sequence of identifiers of a document is matched against ordered licence rules.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowsieve.llm.common import id_and_text

# Known licence sentences, by identifier.
SENTENCES = {
    "mit-line": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "This software is released under the MIT License."],
    "mit-title": ["The MIT License (MIT)", "MIT License", "The MIT License"],
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-as-is": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "apache-line": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License");', "Released under the Apache License, Version 2.0.", "Apache License, Version 2.0"],
    "apache-compliance": ["you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at"],
    "apache-as-is": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "gpl3-line": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License v3.0."],
    "gpl2-line": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."],
    "gpl3-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
                 "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl2-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
                 "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."],
    "lgpl3-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
                 "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl21-free": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
                 "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."],
    "agpl3-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "lgpl-hope": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "lgpl3-line": ["Licensed under the GNU Lesser General Public License, version 3."],
    "lgpl21-line": ["Licensed under the GNU Lesser General Public License, version 2.1."],
    "agpl-line": ["Licensed under the GNU Affero General Public License, version 3."],
    "bsd-redistribution": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-names": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "bsd-line": ["Licensed under the BSD License.", "Released under the BSD License."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "epl2-line": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License, version 2.0."],
    "mpl-line": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "cc-by-line": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-line": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc-line": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-nc-sa-line": ["Licensed under CC BY-NC-SA 4.0."],
    "cc-by-nd-line": ["Licensed under CC BY-ND 4.0."],
    "cc0-line": ["Licensed under CC0 1.0.", "This work is dedicated to the public domain."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "rights-reserved": ["All rights reserved."],
}

# Licences as ordered sequences of sentence identifiers; longer ones are tried first.
RULES = [
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "mit-as-is"]), ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]), ("MIT", ["mit-grant"]), ("MIT", ["mit-line"]), ("MIT", ["mit-title"]),
    ("Apache-2.0", ["apache-line", "apache-compliance", "apache-copy", "apache-as-is"]), ("Apache-2.0", ["apache-line", "apache-compliance"]), ("Apache-2.0", ["apache-line"]),
    ("GPL-3.0", ["gpl3-free", "gpl-hope"]), ("GPL-3.0", ["gpl3-free"]), ("GPL-3.0", ["gpl3-line"]), ("GPL-2.0", ["gpl2-free", "gpl-hope"]), ("GPL-2.0", ["gpl2-free"]), ("GPL-2.0", ["gpl2-line"]),
    ("LGPL-3.0", ["lgpl3-free", "lgpl-hope"]), ("LGPL-3.0", ["lgpl3-free", "gpl-hope"]), ("LGPL-3.0", ["lgpl3-free"]), ("LGPL-3.0", ["lgpl3-line"]),
    ("LGPL-2.1", ["lgpl21-free", "lgpl-hope"]), ("LGPL-2.1", ["lgpl21-free", "gpl-hope"]), ("LGPL-2.1", ["lgpl21-free"]), ("LGPL-2.1", ["lgpl21-line"]),
    ("AGPL-3.0", ["agpl3-free", "gpl-hope"]), ("AGPL-3.0", ["agpl3-free"]), ("AGPL-3.0", ["agpl-line"]), ("ISC", ["isc-grant"]), ("0BSD", ["0bsd-grant"]), ("EPL-2.0", ["epl2-line"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-names"]), ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]), ("BSD", ["bsd-line"]),
    ("MPL-2.0", ["mpl-line"]), ("CC-BY-4.0", ["cc-by-line"]), ("CC-BY-SA-4.0", ["cc-by-sa-line"]), ("CC-BY-NC-4.0", ["cc-by-nc-line"]), ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-line"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-line"]), ("CC0-1.0", ["cc0-line"]), ("Unlicense", ["unlicense"]), ("All-Rights-Reserved", ["rights-reserved"]),
]

# Licences that a line "SPDX-License-Identifier: <name>" may name.
SPDX = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later",
        "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense"]

for _name in SPDX:
    SENTENCES[f"spdx-{_name}"] = [f"SPDX-License-Identifier: {_name}"]
    RULES.append((_name.removesuffix("-only").removesuffix("-or-later"), [f"spdx-{_name}"]))

# Every known sentence holds one of these words (a test holds this); documents without any need no search.
MARKS = ["licen", "permission", "permitted", "warrant", "redistribut", "copyright", "copies of the software", "substantial portions", "apache", "free software", "mit license", "eclipse", "public domain", "rights reserved", "endorse", "unencumbered"]

#: Unknown parts (ends of sentences or lines) that may stand between two sentences of a rule.
MOST_BETWEEN = 6
_WORD = re.compile(r"[^\W_]+")
_BORDER = re.compile(r"[.!?;:]\S?\s|\n")


def normalise(sentence: str) -> str:
    return " ".join(w.lower() for w in _WORD.findall(sentence))


def sentence_index(sentences: dict[str, list[str]]) -> dict[tuple, list[tuple[list[str], str]]]:
    """First two words of the normalised forms -> (all words, identifier), longest first."""
    index: dict[tuple, list[tuple[list[str], str]]] = {}
    for name, forms in sentences.items():
        for form in forms:
            words = normalise(form).split()
            index.setdefault(tuple(words[:2]), []).append((words, name))
    for forms in index.values():
        forms.sort(key=lambda f: -len(f[0]))
    return index


def known_sentences(text: str, index: dict[tuple, list[tuple[list[str], str]]]) -> list[tuple[int, int, int, str, int]]:
    """(number of its first part, begin, end, identifier, number of its last part) of recognised sentences in order.

    Parts end at closing punctuation, a semicolon or colon followed by white space, or a line break. A known sentence begins and ends at such
    borders and may hold others, so it may run over several lines, comment marks between them. The longest form is taken, and no two
    overlap. A text is gone through once.
    """
    places = [m.span() for m in _WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in places]
    part, number, opens = 0, [0] * len(places), [True] * (len(places) + 1)
    for i in range(1, len(places)):
        opens[i] = _BORDER.search(text, places[i - 1][1], places[i][0]) is not None
        part += opens[i]
        number[i] = part
    out, i = [], 0
    while i < len(words):
        step = 1
        if opens[i]:
            for form, name in index.get(tuple(words[i : i + 2]), ()):
                end = i + len(form)
                if words[i:end] == form and opens[end]:
                    out.append((number[i], places[i][0], places[end - 1][1], name, number[end - 1]))
                    step = len(form)
                    break
        i += step
    return out


def match_rules(found: list[tuple[int, int, int, str, int]], rules: list[tuple[str, list[str]]], most_between: int = MOST_BETWEEN) -> list[tuple[str, int, int, int]]:
    """(licence, begin, end, sentences) from left to right, the longest rule first, no sentence in two matches."""
    out, i = [], 0
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    while i < len(found):
        for licence, names in ordered:
            part = found[i : i + len(names)]
            if [x[3] for x in part] == names and all(b[0] - a[4] - 1 <= most_between for a, b in zip(part, part[1:])):
                out.append((licence, part[0][1], part[-1][2], len(names)))
                i += len(names)
                break
        else:
            i += 1
    return out


OUTPUT = "doc_id bigint, licenses array<string>, n_sentences bigint, matches array<struct<license: string, begin: bigint, end: bigint, sentences: bigint>>"


def scan(docs: DataFrame, sentences: dict[str, list[str]] | None = None, rules: list[tuple[str, list[str]]] | None = None, marks: list[str] | None = None) -> DataFrame:
    """One row per document: licences found (sorted, distinct), recognised sentences, and the matches with character positions.

    Documents without any of the mark words (looked up inside the JVM) get empty lists and never reach Python. NULL and empty texts have no
    match; whole texts of any length; repeated rows get rows each; an empty table gives an empty result.
    """
    sentences, rules, marks = sentences or SENTENCES, rules or RULES, marks or MARKS
    index = sentence_index(sentences)
    narrow = id_and_text(docs)
    marked = F.lower("text").rlike("|".join(map(re.escape, marks)))
    kind = pa.list_(pa.struct([("license", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("sentences", pa.int64())]))

    def work(batches):
        for batch in batches:
            names, counts, spans = [], [], []
            for text in batch.column("text").to_pylist():
                found = known_sentences(text, index) if text else []
                matches = match_rules(found, rules)
                names.append(sorted({m[0] for m in matches}))
                counts.append(len(found))
                spans.append([dict(zip(("license", "begin", "end", "sentences"), m)) for m in matches])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.list_(pa.string())), pa.array(counts, pa.int64()), pa.array(spans, kind)], names=["doc_id", "licenses", "n_sentences", "matches"])

    return narrow.select("doc_id", F.when(marked, F.col("text")).otherwise(F.lit("")).alias("text")).mapInArrow(work, OUTPUT)
