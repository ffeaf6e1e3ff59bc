"""Licence scans by sentence rules.

A text is cut into pieces at punctuation and line breaks, and each is normalised (ASCII
letters lower-cased, everything but letters and digits made one space). The longest run of
pieces that spells a known licence sentence is one sentence, mapped to its identifier, so
hard-wrapped and commented licences, list numbers and abbreviations don't hide one; every
other piece is a sentence that maps to nothing. A rule is an ordered sequence of
identifiers; it matches where the identifiers of consecutive sentences of the text spell
it. Among rules that match at the same place the longest counts.

Defined results: null or empty text has no sentences and no licences; every row gives a row.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

NAME = "op6_license_scan"

# Sentences of public licence texts and notices with their variants, and the rules over them.
# "*" stands for one to GAP words inside a sentence, such as the name of a holder.
GAP = 16
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_DEAL = _GRANT + " (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"
_REDISTRIBUTE = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation"
_LATER = ("either version {0} of the License, or (at your option) any later version", "either version {0}, or (at your option) any later version", "version {0} of the License, or (at your option) any later version")
_ONLY = ("version {0} of the License", "version {0}", "version {0} only", "either version {0} of the License")
_GNU = {"gpl": "General Public License", "lgpl": "Lesser General Public License", "agpl": "Affero General Public License"}
_SUBJECTS = ("", "This project is ", "This work is ", "This software is ", "This code is ", "This file is ", "The code is ", "The source code is ", "Code is ")
_VERBS = ("licensed under ", "released under ", "distributed under ", "licensed under the terms of ", "released under the terms of ", "distributed under the terms of ", "available under ", "made available under ")
_FREE = ("This program is free software", "This library is free software", "This file is free software", "This software is free software")


def _named(*names: str) -> tuple[str, ...]:
    """What notices say of a licence by any of these names."""
    ends = ("", " - see the LICENSE file for details", " see the LICENSE file for details", " - see the LICENSE.md file for details", " (see LICENSE)")
    return tuple(s + v + the + n + e for s in _SUBJECTS for v in _VERBS for the in ("", "the ") for n in names for e in ends)


SENTENCES: dict[str, str | tuple[str, ...]] = {
    "apache2-licensed": (
        *_named("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License", "Apache 2.0"),
        "Licensed under the Apache License, Version 2.0 (the License)",
        *(f"{x} licenses this file to you under the Apache License, Version 2.0{y}" for x in ("The ASF", "The Apache Software Foundation") for y in ("", " (the License)")),
    ),
    "apache2-compliance": (
        "you may not use this file except in compliance with the License",
        "you may not use this software except in compliance with the License",
        "you may not use this work except in compliance with the License",
        "you may not use these files except in compliance with the License",
    ),
    "apache2-copy": ("You may obtain a copy of the License at", "You may obtain a copy of the License in the LICENSE file, or at"),
    "apache2-title": ("Apache License Version 2.0, January 2004", "Apache License Version 2.0"),
    "mit-released": tuple(x for x in _named("MIT License", "MIT Licence", "MIT Expat License") if "eleased" in x),
    "mit-licensed": tuple(x for x in _named("MIT License", "MIT Licence", "MIT Expat License") if "eleased" not in x),
    "mit-title": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "(The MIT License)", "The MIT License (Expat)"),
    "mit-grant": (_GRANT, _DEAL + ", subject to the following conditions", _DEAL + " subject to the following conditions"),
    "mit0-grant": _DEAL,
    "mit-notice": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software",
        "The above copyright notice and this permission notice shall be included in all copies of the Software",
    ),
    "mit-warranty": (_AS_IS, *(_AS_IS + f", INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE{x} NONINFRINGEMENT" for x in (" AND", ", AND", ", TITLE AND"))),
    "gpl3-work": tuple(x for v in ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GNU GPLv3", "GPLv3", "GPL-3.0 License") for x in _named(v)),
    "gpl-free": _FREE,
    "gpl-redistribute": tuple(_REDISTRIBUTE.format(x) for x in ("General Public License",)),
    "lgpl-redistribute": tuple(_REDISTRIBUTE.format(x) for x in ("Lesser General Public License", "Library General Public License")),
    "agpl-redistribute": _REDISTRIBUTE.format("Affero General Public License"),
    **{f"gnu{v}-{kind}".replace(".", ""): tuple(x.format(v) for x in forms) for v in ("2", "2.1", "3") for kind, forms in (("later", _LATER), ("only", _ONLY))},
    # with commas the notice goes on to the version
    **{
        f"{k}{v}-{kind}".replace(".", ""): tuple(f"{_REDISTRIBUTE.format(name)}, {x.format(v)}" for x in forms)
        for k, name in _GNU.items()
        for v in ("2", "2.1", "3")
        for kind, forms in (("later", _LATER), ("only", _ONLY))
    },
    "gpl-hope": tuple(f"{x} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY" for x in ("This program", "This library", "This file", "This software")),
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl11-subject": ("The contents of this file are subject to the Mozilla Public License Version 1.1 (the License)", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    "mpl11-title": "Mozilla Public License Version 1.1",
    "psf2-title": "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2",
    "mpl2-title": ("Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0"),
    "ccbync4-licensed": _named("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "ccbysa4-licensed": _named("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "ccby4-licensed": _named("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "cc0-title": ("CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal", "Creative Commons Legal Code CC0 1.0 Universal"),
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "isc-grant": tuple(f"Permission to use, copy, modify, {x}distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies" for x in ("and/or ", "and ")),
    "boost-title": ("Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0"),
    "zlib-granted": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistribution and use in source and binary forms of the software as well as documentation, with or without modification, are permitted provided that the following conditions are met",
    ),
    "bsd-source": tuple(f"{n}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer" for n in ("", "1. ", "a. ", "(1) ")),
    "bsd-binary": tuple(f"{n}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution" for n in ("", "2. ", "b. ", "(2) ")),
    "bsd-names": tuple(
        f"{n}{x} be used to endorse or promote products derived from this software without specific prior written permission"
        for n in ("", "3. ", "c. ", "(3) ", "4. ")
        for x in (*(f"Neither the name{y} of * nor the names of {z} contributors may" for y in ("", "s") for z in ("its", "their", "any", "other")), "The name of * may not", "The names of * may not")
    ),
    "bsd-provided": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS",
        "THIS SOFTWARE IS PROVIDED BY * AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    ),
    "rights-reserved": "All rights reserved",
    **{
        f"spdx-{x}": f"SPDX-License-Identifier: {x}"
        for x in ("Apache-2.0", "MIT", "MIT-0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "ISC", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Unlicense", "BSL-1.0", "Zlib")
    },
}


def _gnu(kind: str, version: str) -> list[list[str]]:
    """The notices of one GNU licence, with or without the sentences before and behind."""
    v = version.removesuffix(".0").replace(".", "")
    notices = [r for x in ("later", "only") for r in ([f"{kind}{v}-{x}"], [f"{kind}-redistribute", f"gnu{v}-{x}"])]
    return [h + r + t for r in notices for h in ([], ["gpl-free"]) for t in ([], ["gpl-hope"])]


_BSD = ["bsd-redistribution", "bsd-source", "bsd-binary"]
RULES = {
    "Apache-2.0": [["apache2-licensed", "apache2-compliance"], ["apache2-licensed"], ["apache2-compliance", "apache2-copy"], ["apache2-title"]],
    "MIT": [["mit-grant", "mit-notice", "mit-warranty"], ["mit-grant", "mit-notice"], ["mit-grant", "mit-warranty"], ["mit-released"], ["mit-licensed"], ["mit-title"]],
    "MIT-0": [["mit0-grant", "mit-warranty"], ["mit0-grant"]],
    "GPL-2.0": [["gpl2-title"], *_gnu("gpl", "2.0")],
    "GPL-3.0": [["gpl3-work"], ["gpl3-title"], *_gnu("gpl", "3.0")],
    "GPL": [["gpl-free", "gpl-redistribute"], ["gpl-free", "gpl-redistribute", "gpl-hope"], ["gpl-redistribute"]],
    "LGPL-2.1": [["lgpl21-title"], *_gnu("lgpl", "2.1")],
    "LGPL-3.0": [["lgpl3-title"], *_gnu("lgpl", "3.0")],
    "LGPL": [["gpl-free", "lgpl-redistribute"], ["gpl-free", "lgpl-redistribute", "gpl-hope"], ["lgpl-redistribute"], *_gnu("lgpl", "2.0")],
    "AGPL-3.0": [["agpl3-title"], ["agpl-redistribute"], *_gnu("agpl", "3.0")],
    "MPL-2.0": [["mpl2-subject"], ["mpl2-title"]],
    "MPL-1.1": [["mpl11-subject", "apache2-compliance", "apache2-copy"], ["mpl11-subject"], ["mpl11-title"]],
    "PSF-2.0": [["psf2-title"]],
    "CC-BY-NC-4.0": [["ccbync4-licensed"]],
    "CC-BY-SA-4.0": [["ccbysa4-licensed"]],
    "CC-BY-4.0": [["ccby4-licensed"]],
    "CC0-1.0": [["cc0-title"]],
    "Unlicense": [["unlicense-free"]],
    "ISC": [["isc-grant"]],
    "BSL-1.0": [["boost-title"]],
    "Zlib": [["zlib-granted"]],
    "BSD-2-Clause": [[*_BSD, "bsd-provided"]],
    "BSD-3-Clause": [[*_BSD, "bsd-names", "bsd-provided"]],
    "BSD": [["bsd-redistribution", "bsd-provided"], ["bsd-redistribution"]],
    "proprietary": [["rights-reserved"]],
}
for _x in [k for k in SENTENCES if k.startswith("spdx-")]:
    RULES.setdefault(re.sub("-(only|or-later)$", "", _x.removeprefix("spdx-")), []).append([_x])
# "All rights reserved" before a BSD licence or in the line above it is part of its head
for _x in ("BSD", "BSD-2-Clause", "BSD-3-Clause"):
    RULES[_x] += [["rights-reserved", *r] for r in RULES[_x] if r[0] == "bsd-redistribution"]

#: A piece ends at a line break, or at one of . ! ? ; : followed by white space or the text's end. A colon alone ends no sentence.
_END = re.compile(r"(\n+|[.!?;:]+(?=\s|$))")
_FOLD = {c: (chr(c + 32) if 65 <= c <= 90 else chr(c) if chr(c).isalnum() else " ") for c in range(128)} | dict.fromkeys(map(ord, "\u00a0\u00a9\u00ab\u00bb\u2010\u2011\u2012\u2013\u2014\u2018\u2019\u201c\u201d\u2022"), " ")
SCHEMA = "doc_id bigint, n_sentences bigint, sentence_ids array<string>, licences array<string>, rules array<struct<licence:string,first:bigint,length:bigint>>"
_RULE = pa.struct([("licence", pa.string()), ("first", pa.int64()), ("length", pa.int64())])


def normalised(sentence: str) -> str:
    return " ".join(sentence.translate(_FOLD).split())


def _forms():
    for k, forms in SENTENCES.items():
        for form in (forms,) if isinstance(forms, str) else forms:
            yield k, form


KNOWN = {normalised(f): k for k, f in _forms() if "*" not in f}
#: Known sentences with a gap by their first word: what is before it, behind it, identifier.
_GAPPED: dict[str, list[tuple[str, str, str]]] = {}
for _k, _f in _forms():
    if "*" in _f:
        _head, _tail = map(normalised, _f.split("*"))
        _GAPPED.setdefault(_head.split(" ", 1)[0], []).append((f"{_head} ", f" {_tail}", _k))
#: What a known sentence may begin with, cut after each of its words.
_BEGUN = {s[:i] for s in KNOWN for i in range(len(s)) if s[i] == " "}


def _gapped(s: str) -> tuple[str | None, bool]:
    """The identifier of a known sentence with a gap, and whether s may be the beginning of one."""
    begun = False
    for head, tail, k in _GAPPED.get(s.split(" ", 1)[0], ()):
        if s.startswith(head):
            if s.endswith(tail) and s.count(" ", len(head), len(s) - len(tail)) < GAP:
                return k, True
            begun |= s.count(" ", len(head)) < GAP + tail.count(" ")
        else:
            begun |= head.startswith(f"{s} ")
    return None, begun


def _longest(pieces: list[str], i: int) -> tuple[str | None, int]:
    """The identifier of the longest run of pieces from i that spells a known sentence, and where the run ends."""
    s, found, stop, j = "", None, i + 1, i
    begun = True
    while begun and j < len(pieces):
        s = f"{s} {pieces[j]}" if s else pieces[j]
        j += 1
        k, begun = _gapped(s)
        if k := KNOWN.get(s) or k:
            found, stop = k, j
        begun = begun or s in _BEGUN
    return found, stop


#: Rules by their first identifier, longest first.
_BY_FIRST: dict[str, list[tuple[str, list[str]]]] = {}
for _licence, _rules in RULES.items():
    for _rule in _rules:
        _BY_FIRST.setdefault(_rule[0], []).append((_licence, _rule))
for _rules in _BY_FIRST.values():
    _rules.sort(key=lambda x: (-len(x[1]), x[0]))


def identifiers(text: str | None) -> list[str | None]:
    """The identifier, or None, of each sentence; sentences without letters or digits don't count."""
    pieces: list[str] = []
    goes_on: list[bool] = []
    parts = _END.split(text or "")
    for part, end in zip(parts[::2], [*parts[1::2], "."], strict=True):
        if s := normalised(part):
            pieces.append(s)
            goes_on.append(end == ":")
        elif goes_on and end != ":":
            goes_on[-1] = False
    out: list[str | None] = []
    i, inside = 0, False
    while i < len(pieces):
        found, stop = _longest(pieces, i)
        if found or not inside:
            out.append(found)
        i, inside = stop, not found and goes_on[stop - 1]
    return out


def match(ids: list[str | None]) -> list[tuple[str, int, int]]:
    """(licence, first sentence, sentences) of the rules that match, left to right, not overlapping."""
    out, i = [], 0
    while i < len(ids):
        step = 1
        for licence, rule in _BY_FIRST.get(ids[i], ()) if ids[i] else ():
            if ids[i : i + len(rule)] == rule:
                out.append((licence, i, len(rule)))
                step = len(rule)
                break
        i += step
    return out


def _kernel(batches):
    for part in common.slices(batches, "text"):
        ids = [identifiers(t) for t in part.column("text").to_pylist()]
        found = [match(x) for x in ids]
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([[i for i in x if i] for x in ids], pa.list_(pa.string())),
                pa.array([sorted({licence for licence, _, _ in f}) for f in found], pa.list_(pa.string())),
                pa.array([[dict(zip(("licence", "first", "length"), r, strict=True)) for r in f] for f in found], pa.list_(_RULE)),
            ],
            ["doc_id", "n_sentences", "sentence_ids", "licences", "rules"],
        )


def licences(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licences, rules for every row of docs(doc_id, text). One narrow pass."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_kernel, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences(common.table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_sentences",
        F.size("sentence_ids").cast("bigint").alias("n_known"),
        F.size("rules").cast("bigint").alias("n_rules"),
        F.array_join("licences", ",").alias("licences"),
    )
