"""Article text out of the scripts of landed pages, and front matter (K-02, K-03, K-04, S-37).

The depth of embedded JSON is unknown, so it is searched in an Arrow-batched UDF; script blocks are found by
built-in regular expressions, so that only the scripts and not the pages go to Python.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scalars as S

# Least article length, deepest level searched, and the keys and types that name an article.
LEAST = 200
DEPTH = 8
BODY_KEYS = ("articlebody", "article_body", "bodyhtml", "articlebodyhtml", "articletext", "maincontent", "contentbody", "article_content")
HOLDERS = ("article", "page", "post")
HELD = ("body", "content")
ARTICLE_TYPES = ("newsarticle", "article", "blogposting")
LD_KEYS = ("articleBody", "article_body", "articlebody", "description")

# The scripts that hold a page's state and its linked data.
STATE = r"""(?is)<script[^>]*id=["']__NEXT_DATA__["'][^>]*>(.*?)</script>"""
LINKED = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
HIDDEN = r"(?is)<(script|style)\b[^>]*>.*?</\1>"


def _parsed(raw: str | None):
    try:
        return json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None


def strings(top) -> Iterator[tuple[str, bool]]:
    """Long strings in document order, and whether their keys name an article's body."""
    todo = [(top, 0, "", "")]
    while todo:
        x, depth, key, above = todo.pop()
        if isinstance(x, str):
            if len(x) >= LEAST:
                yield x, key in BODY_KEYS or (above in HOLDERS and key in HELD)
        elif depth < DEPTH and isinstance(x, (dict, list)):
            kids = x.items() if isinstance(x, dict) else ((f"[{i}]", y) for i, y in enumerate(x))
            todo += reversed([(y, depth + 1, k.lower(), key) for k, y in kids])


def state_text(raw: str | None) -> str | None:
    """K-02: the longest body string, else the longest string; the first of equals. None if it isn't an object."""
    top = _parsed(raw)
    if not isinstance(top, dict):
        return None
    found = list(strings(top))
    named = [s for s, body in found if body]
    return max(named or [s for s, _ in found], key=len, default=None)


def ld_text(blocks) -> str | None:
    """K-03: the first article node with a long body or description; a graph's nodes come before their holder."""
    for raw in [] if blocks is None else blocks:
        top = _parsed(raw.strip())
        for holder in top if isinstance(top, list) else [top]:
            if not isinstance(holder, dict):
                continue
            graph = holder.get("@graph")
            for node in [*(graph if isinstance(graph, list) else []), holder]:
                if not isinstance(node, dict):
                    continue
                kind = node.get("@type")
                kinds = {str(k).lower() for k in (kind if isinstance(kind, list) else [kind]) if k}
                if not kinds.isdisjoint(ARTICLE_TYPES):
                    for key in LD_KEYS:
                        if isinstance(text := node.get(key), str) and len(text) >= LEAST:
                            return text
    return None


@F.pandas_udf(T.StringType())
def _state(raw: pd.Series) -> pd.Series:
    return raw.map(state_text, na_action="ignore").astype(object)


@F.pandas_udf(T.StringType())
def _ld(blocks: pd.Series) -> pd.Series:
    return pd.Series([ld_text(b) for b in blocks], dtype=object)


def _long(text: Column) -> Column:
    return F.when(F.length(text) >= LEAST, text)


def from_state(html: Column) -> Column:
    """K-02: text of the page's embedded state, tags removed; null below LEAST characters, without or with bad state."""
    text = _state(F.trim(F.regexp_extract(html, STATE, 1)))
    return _long(F.when(F.contains(text, F.lit("<")), S.strip_tags(text)).otherwise(text))


def from_linked(html: Column) -> Column:
    """K-03: text of the page's linked data; null if no block qualifies."""
    return _ld(F.regexp_extract_all(html, F.lit(LINKED), F.lit(1)))


def extract(html: Column) -> Column:
    """K-04: struct (text, engine) of the first of embedded state, linked data and stripped page (without scripts and styles) that has LEAST characters, its text cleaned (S-08)."""
    one = lambda text, name: F.when(text.isNotNull(), F.struct(S.clean_extracted(text).alias("text"), F.lit(name).alias("engine")))
    return F.coalesce(one(from_state(html), "next_data"), one(from_linked(html), "json_ld"), one(_long(S.strip_tags(F.regexp_replace(html, HIDDEN, " "))), "page"))


FRONT = r"(?s)^---\s*\n(.*?)\n---\s*\n?"


def front_matter(text: Column) -> Column:
    """S-37: struct (body, metadata) of `key: value` lines between fences at the top; without fences the text and no keys.

    Flat scalars only: lists and nested maps stay out of the metadata.  Of equal keys the last one counts.
    """
    lines = F.split(F.regexp_extract(text, FRONT, 1), "\n")
    flat = F.filter(lines, lambda x: F.rlike(x, F.lit(r"^[A-Za-z_][\w-]*:\s+\S")))
    pairs = F.transform(flat, lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+):", 1).alias("k"), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[\w-]+:\s+(.*)$", 1)), r"""^(["'])(.*)\1$""", "$2").alias("v")))
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])))
    return F.struct(F.regexp_replace(text, FRONT, "").alias("body"), F.when(F.rlike(text, F.lit(FRONT)), last).otherwise(F.create_map().cast("map<string,string>")).alias("metadata"))


def _plain(x):
    """A YAML value in JSON's terms: keys, dates and numbers that JSON lacks become texts."""
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, set)):
        return [_plain(v) for v in x]
    return x if x is None or isinstance(x, (bool, int, str)) or isinstance(x, float) and math.isfinite(x) else str(x)


def front_matter_tree(text: Column) -> Column:
    """S-37: struct (body, metadata): as front_matter, but metadata is the JSON of all of it, lists and nested maps too.  Needs PyYAML.

    Metadata that can't be read, or is no map, is `{}`.
    """
    @F.pandas_udf("string")
    def tree(block: pd.Series) -> pd.Series:
        import yaml

        def one(raw):
            try:
                found = yaml.safe_load(raw) if raw else None
                return json.dumps(_plain(found), ensure_ascii=False) if isinstance(found, dict) else "{}"
            except (yaml.YAMLError, ValueError, TypeError, RecursionError):
                return "{}"

        return block.map(one)

    return F.struct(F.regexp_replace(text, FRONT, "").alias("body"), tree(F.regexp_extract(text, FRONT, 1)).alias("metadata"))
