"""Operators on what their first form cut off."""

import random
import re
import textwrap

import pytest

from corpusloom.llm import license_scan, secrets

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD = """Copyright (c) 2020, A B
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the A. B. Company nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
GPL2 = "Foo is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
GPL3 = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
MPL2 = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."


def wrapped(text, width, mark):
    return "\n\n".join("\n".join(mark + x for x in textwrap.wrap(p, width)) for p in text.split("\n\n"))


@pytest.mark.parametrize(("text", "licence"), [(MIT, "MIT"), (BSD, "BSD-3-Clause"), (GPL2, "GPL-2.0"), (GPL3, "GPL-3.0"), (MPL2, "MPL-2.0")])
def test_licences_as_distributed(text, licence):
    forms = [text, re.sub(r"\s+", " ", text), re.sub(" ", " " * 40, text), *(wrapped(text, w, m) for w in (30, 72, 79) for m in ("", " * ", "# "))]
    for form in forms:
        got = {name for name, _, _ in license_scan.match(license_scan.identifiers(f"Some words before.\n\n{form}\n\nSome words behind."))}
        assert got == {licence}, form


def test_unknown_lines_stay_sentences():
    assert license_scan.identifiers("one\ntwo: three\nAll rights\nreserved\nfour") == [None, None, "rights-reserved", None]


def test_short_tokens_are_scored_and_one_credential_does_not_silence_the_rest():
    assert [v for v, _, _ in secrets.tokens("an abcdef tokens Xk3vQz9p password=Xk3vQz9pLm", [("assign", 26, 45)])] == ["abcdef", "tokens", "Xk3vQz9p"]
    assert [v for v, _, _ in secrets.tokens("an abcdef Xk3vQz9p", [])] == ["abcdef", "Xk3vQz9p"]
    r = random.Random(3)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(6, 14))) for _ in range(399)]
    model = secrets.Model({"assign": [hexes(r.randint(8, 20)) for _ in range(200)], "access": [], "hex": []}, [*words, "4e9d40e1b2c3d5f6"])
    fresh = [hexes(12) for _ in range(100)]
    found = [secrets.all_spans(f"the {w} end", model) for w in fresh]
    assert sum(bool(x) for x in found) >= 90
    assert not any(secrets.all_spans(w, model) for w in words)
