"""Wiki markup: bold, italic and quoted phrases, and balanced, nested links."""


import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

_QUOTES = re.compile(r"'{2,5}")
_FONT = re.compile(r"('{2,5})(.+?)\1", re.S)
_GLUE = re.compile(r"[^\W\d_]+")


def plain_link(inside: str) -> str:
    """What a link shows: its own links resolved, then what stands behind the first pipe."""
    label = inside.partition("|")[2] if "|" in inside else inside
    return links(label)[0]


def links(text: str) -> tuple[str, list[str]]:
    """Text with links as they show, and their labels; letters right behind a link belong to it. Unbalanced brackets stay."""
    out, anchors, i = [], [], 0
    while i < len(text):
        if text.startswith("[[", i):
            depth, j = 1, i + 2
            while j < len(text) and depth:
                if text.startswith("[[", j):
                    depth, j = depth + 1, j + 2
                elif text.startswith("]]", j):
                    depth, j = depth - 1, j + 2
                else:
                    j += 1
            if not depth:
                label = plain_link(text[i + 2 : j - 2])
                m = _GLUE.match(text, j)
                shown = label + (m[0] if m else "")
                out.append(shown)
                if label:
                    anchors.append(label)
                i = j + (len(m[0]) if m else 0)
                continue
        out.append(text[i])
        i += 1
    return "".join(out), anchors


def parse(text: str | None) -> dict:
    if text is None:
        return {"text": None, "fonts": [], "anchors": []}
    fonts = [links(m[2])[0].strip() for m in _FONT.finditer(text)]
    shown, anchors = links(_QUOTES.sub("", text))
    return {"text": shown, "fonts": list(dict.fromkeys(f for f in fonts if f)), "anchors": list(dict.fromkeys(anchors))}


def parse_markup(text: Column) -> Column:
    """struct(text, fonts, anchors) of a marked-up text; phrases are distinct, in order."""

    @pandas_udf("struct<text:string,fonts:array<string>,anchors:array<string>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(t) for t in texts], columns=["text", "fonts", "anchors"])

    return run(text)
