"""Secret scans by a trigram inverted index, in DataFrame functions only.

Each rule's regex is parsed once on the driver into a Boolean query over trigrams: an OR of ANDs.
The index holds postings (trigram, document) of just the trigrams that some query names; a rule's
candidates are documents whose postings satisfy its query, and only these are verified with the
regex.  A rule that has no mandatory trigram scans all documents.

Nulls and empty texts: no spans, the hash of the empty string.  Repeated rows: one result row each.
Empty table: empty result.  Other columns of the input are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import re._constants as rc
import re._parser as rp
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flag_keys, key_bitmap, materialize, text_key


@dataclass(frozen=True)
class Rule:
    """pattern: Java and Python both read it. group: its least length. base: part of the fixed contract."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# Fixed values of the contract: the three base kinds, in order.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
)
#: Public token formats that the index adds.
EXTRA = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
)
RULES = BASE + EXTRA
_MOST = 64  # alternatives of a query
_BITS = 62
_GRAMS = 4  # trigrams of an alternative


def literals(pattern: str) -> list[set[str]] | None:
    """Alternatives, each a set of lower-case literal runs that any match must hold; None if too many."""

    def runs(items, parts: list[list]) -> list[list]:
        for op, av in items:
            if op is rc.LITERAL:
                parts = [p[:-1] + [p[-1] + chr(av).lower()] for p in parts]
            elif op is rc.IN and all(k is rc.LITERAL for k, _ in av) and len(av) <= 8:
                parts = [p[:-1] + [p[-1] + chr(c).lower()] for p in parts for _, c in av]
            elif op is rc.SUBPATTERN:
                parts = runs(av[-1], parts)
            elif op is rc.BRANCH:
                parts = [r for p in parts for b in av[1] for r in runs(b, [p])]
            elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and av[:2] == (0, 1) and len(av[2]) == 1 and av[2][0][0] is rc.LITERAL:
                parts = parts + runs(av[2], parts)
            elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and av[0] == av[1] and av[0] <= 8:
                for _ in range(av[0]):
                    parts = runs(av[2], parts)
            else:
                parts = [p + [""] for p in parts]
            if len(parts) > _MOST:
                raise OverflowError
        return parts

    try:
        found = runs(list(rp.parse(pattern)), [[""]])
    except OverflowError:
        return None
    return [{x for x in p if x} for p in found]


def trigram_query(pattern: str) -> list[list[str]] | None:
    """OR of ANDs of lower-case trigrams; None if some alternative has no mandatory trigram."""
    out = []
    for alt in literals(pattern) or [set()]:
        grams = sorted({r[i : i + 3] for r in alt for i in range(len(r) - 2)})
        if not grams:
            return None
        grams = grams[:: -(-len(grams) // _GRAMS)]  # fewer conditions keep the query necessary
        if grams not in out:
            out.append(grams)
    return out


def index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (gram, key): which of the named trigrams occur in which text, letters folded to lower case."""
    low = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hits = F.filter(F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(i)) for i, g in enumerate(trigrams)]), lambda x: x.isNotNull())
    return docs.select("key", low.alias("low")).select("key", F.explode(hits).alias("gram")).distinct()


def candidates(postings: DataFrame, trigrams: list[str], queries: dict[str, list[list[str]]]) -> DataFrame:
    """(key, kinds): rules whose Boolean query the document's postings satisfy; postings intersect as bit sets, of 62 trigrams a column."""
    bit = {g: i for i, g in enumerate(trigrams)}
    words = range(-(-len(bit) // _BITS))
    column = lambda w: F.bit_or(F.when(F.floor(F.col("gram") / _BITS) == w, F.expr(f"shiftleft(1L, gram % {_BITS})")).otherwise(F.lit(0).cast("long"))).alias(f"held{w}")
    held = postings.groupBy("key").agg(*map(column, words))
    kinds = []
    for kind, alts in queries.items():
        ok = F.lit(False)
        for alt in alts:
            every = F.lit(True)
            for w in words:
                mask = sum(1 << bit[g] % _BITS for g in alt if bit[g] // _BITS == w)
                if mask:
                    every = every & (F.col(f"held{w}").bitwiseAND(F.lit(mask).cast("long")) == F.lit(mask).cast("long"))
            ok = ok | every
        kinds.append(F.when(ok, F.lit(kind)))
    return held.select("key", F.filter(F.array(*kinds), lambda x: x.isNotNull()).alias("kinds")).where(F.size("kinds") > 0)


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start,ord,kind,end>> of the rule's leftmost matches, those that fail the length dropped."""
    pattern = F.lit(rule_pattern(rule))
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, rule_pattern(rule), -1)
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    rows = F.arrays_zip(whole.alias("w"), F.slice(gaps, F.lit(1), F.size(whole)).alias("g"), value.alias("v"))
    empty = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["w"])
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["v"]) >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    rows = F.transform(rows, lambda x: F.struct(x["w"].alias("w"), x["g"].alias("g"), x["v"].alias("v")))
    return F.when(F.rlike(text, pattern), F.aggregate(rows, zero, step, lambda a: a["out"])).otherwise(empty)


def rule_pattern(rule: Rule) -> str:
    """Same matches sooner: a run of too few characters never holds a longer one."""
    return {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}.get(rule.kind, rule.pattern)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, spans array<struct<start,ord,kind,end>>) with one row for each input row.

    Spans of added rules that overlap a base span are left out; base spans always stay.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", text_key(F.col("text")))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    full = [(i, r) for i, r in enumerate(rules) if r.kind not in queries]
    grams = sorted({g for q in queries.values() for a in q for g in a})
    none = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")
    scanned = F.concat(none, *[spans_of(F.col("text"), r, i) for i, r in full])
    if not queries:
        return base.select("id", scanned.alias("spans"))
    found = materialize(candidates(index(base, grams), grams, queries), "secret-candidates")
    flagged = flag_keys(base, "key", key_bitmap(found, "key"), "maybe")
    rest = flagged.where(~F.col("maybe")).select("id", scanned.alias("spans"))
    near = flagged.where("maybe").join(found, "key", "left")
    verified = [F.when(F.array_contains("kinds", r.kind), spans_of(F.col("text"), r, i)).otherwise(none) for i, r in enumerate(rules) if r.kind in queries]
    spans = F.array_sort(F.concat(scanned, *verified))
    n_base = sum(r.base for r in rules)
    near = near.select("id", spans.alias("all")).select(
        "id",
        F.filter(
            "all",
            lambda x: (x["ord"] < n_base) | ~F.exists("all", lambda y: (y["ord"] < n_base) & (y["start"] < x["end"]) & (x["start"] < y["end"])),
        ).alias("spans"),
    )
    return rest.unionByName(near)


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secrets_report(docs: DataFrame) -> DataFrame:
    """Digest of scan_secrets: counts and hash of base spans, and all spans by start, then kind as listed."""
    s = F.col("spans")
    base = F.filter(s, lambda x: x["ord"] < len(BASE))
    count = [F.size(F.filter(s, lambda x: x["kind"] == r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return scan_secrets(docs).select(F.col("id").alias("doc_id"), *count, F.sha2(written(base), 256).alias("base_sha256"), written(s).alias("spans"))
