"""Filters and predicates on event, mention and episode tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from .relational import fresh_name


@dataclass(frozen=True)
class FilterConfig:
    """F-05: wrong or missing parts of a given dict fall back to these, part by part."""

    mode: str = "prefix_match"
    codes: tuple[str, ...] = field(default=("14", "16", "17", "18", "19", "20"))
    min_abs: float = 5.0
    min_count: int = 5
    max_urls: int = 3

    @classmethod
    def of(cls, raw: dict | None) -> FilterConfig:
        d, raw = cls(), raw if isinstance(raw, dict) else {}
        part = lambda a, b: raw.get(a, {}).get(b) if isinstance(raw.get(a), dict) else None
        good = lambda v, least: v if isinstance(v, (int, float)) and not isinstance(v, bool) and v > 0 else least
        mode, codes = part("cameo_filter", "mode"), part("cameo_filter", "codes")
        return cls(
            mode if mode in ("prefix_match", "exact", "contains") else d.mode,
            tuple(map(str, codes)) if isinstance(codes, list) else d.codes,
            float(good(part("goldstein", "min_abs_value"), d.min_abs)), int(good(part("mentions", "min_count"), d.min_count)), int(good(part("url_resolution", "max_urls_per_event"), d.max_urls)),
        )


def code_matches(code: Column, mode: str, codes: tuple[str, ...]) -> Column:
    """F-01: trimmed codes of two characters or more; no codes match nothing."""
    c = F.trim(code)
    if not codes:
        return F.lit(False)
    hit = {"prefix_match": F.substring(c, 1, 2).isin(*codes), "exact": c.isin(*codes)}.get(mode)
    if hit is None:
        hit = reduce(lambda a, b: a | b, [F.contains(c, F.lit(x)) for x in codes])
    return F.coalesce((F.length(c) >= 2) & hit, F.lit(False))


def magnitude_at_least(value: Column, least: float) -> Column:
    """F-02: inclusive; null fails."""
    return F.coalesce(F.abs(value) >= least, F.lit(False))


def with_support(events: DataFrame, mentions: DataFrame, key: str, least: int) -> DataFrame:
    """F-03, A-04, J-01: adds n_mentions; keeps those with enough, or all if there are no mentions at all."""
    n = mentions.groupBy(key).agg(F.count("*").alias("n_mentions"))
    some_name = fresh_name(events, "some_mentions")
    some = mentions.limit(1).agg((F.count("*") > 0).alias(some_name))
    out = events.join(n, key, "left").withColumn("n_mentions", F.coalesce("n_mentions", F.lit(0).cast("long")))
    return out.crossJoin(F.broadcast(some)).where((F.col("n_mentions") >= least) | ~F.col(some_name)).drop(some_name)


def filter_events(events: DataFrame, mentions: DataFrame, cfg: FilterConfig, key: str, code: str, score: str) -> DataFrame:
    """F-04: the three filters in turn, with n_mentions; none of them is asked about rows that an earlier one drops."""
    return with_support(events.where(code_matches(F.col(code), cfg.mode, cfg.codes) & magnitude_at_least(F.col(score), cfg.min_abs)), mentions, key, cfg.min_count)


def relevant(host: Column, themes: Column, domains: list[str] | None = None, keywords: list[str] | None = None, fix_case: bool = False) -> Column:
    """F-06: an authoritative host, or a keyword as a whole word of the upper-cased themes (quirk Q1 unless fix_case)."""
    words = vocab.MACRO_THEMES if keywords is None else keywords
    domains = vocab.MEDIA_HOSTS if domains is None else domains
    if not words:
        return F.lit(True)
    words = [w.upper() for w in words] if fix_case else words
    hit = F.rlike(F.upper(themes), F.lit(r"\b(?:" + "|".join(words) + r")\b"))
    return F.coalesce(F.lower(F.trim(host)).isin(*domains), F.lit(False)) | F.coalesce(hit, F.lit(False))


def mentions_word(text: Column, words: list[str]) -> Column:
    """F-07: any of the words, whole, in the lower-cased text."""
    return F.coalesce(F.rlike(F.lower(text), F.lit(r"\b(?:" + "|".join(words) + r")\b")), F.lit(False))


def feed_relevant(title: Column, summary: Column, words: list[str] | None = None) -> Column:
    """F-07: any of the words in title and summary, joined by a space."""
    joined = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit("")))
    return mentions_word(joined, vocab.FEED_WORDS if words is None else words)


def excluded_url(url: Column) -> Column:
    """F-08: audio and video pages of one broadcaster."""
    return F.contains(url, F.lit("bbc.co.uk")) & (F.contains(url, F.lit("/sounds/")) | F.contains(url, F.lit("/play/")))


def fresh(ts: Column, now: Column, days: Column | int) -> Column:
    """F-09, F-10, F-14."""
    return ts >= now - F.make_dt_interval(F.lit(days) if isinstance(days, int) else days)


def fresh_or_latest(df: DataFrame, key: list[str], ts: str, now: Column, days: int) -> DataFrame:
    """F-11, W-05: fresh rows, or the newest row of a key that has none."""
    w = Window.partitionBy(*key)
    newest = F.row_number().over(w.orderBy(F.desc(ts), *[c for c in df.columns if c != ts]))
    any_fresh = F.max(fresh(F.col(ts), now, days)).over(w)
    n, f = fresh_name(df, "nth"), fresh_name(df, "any_fresh")
    return df.withColumns({n: newest, f: any_fresh}).where(fresh(F.col(ts), now, days) | ((F.col(n) == 1) & ~F.col(f))).drop(n, f)


def blocked_page(status: Column, html: Column) -> Column:
    """F-22: a refusing status and a small page with marks of a challenge."""
    low = F.lower(html)
    early = F.locate("<title>just a moment", low).between(1, 5000)
    marks = early | F.contains(low, F.lit("challenge-platform")) | F.contains(low, F.lit("cf-turnstile"))
    small = (F.length(html) < 5000) & F.contains(low, F.lit("ray id"))
    return status.isin(403, 429, 503) & (F.length(html) <= 15000) & (marks | small)


def in_replay_range(ts: Column, since: Column, until: Column) -> Column:
    """F-20: until is a day and counts whole (quirk Q13)."""
    return (ts >= since) & (ts < until + F.expr("interval 1 day"))


def present(value: Column) -> Column:
    """F-13: neither null nor NaN."""
    return value.isNotNull() & ~F.isnan(value.cast("double"))


def written_already(episodes: DataFrame, written: DataFrame, body_hash: str, name: str) -> DataFrame:
    """F-18: rows whose hash's first 12 signs end the name of a written episode."""
    tail = fresh_name(episodes, "tail")
    tails = written.select(F.right(F.col(name), F.lit(12)).alias(tail)).distinct()
    return episodes.withColumn(tail, F.left(F.col(body_hash), F.lit(12))).join(tails, tail, "left_semi").select(*episodes.columns)


def unclassified(severity: Column) -> Column:
    """F-19: no severity, an empty one or the default."""
    return severity.isNull() | severity.isin("", "medium")


def has_control(text: Column) -> Column:
    """F-21, first of three: control signs other than tab and line ends."""
    return F.coalesce(F.rlike(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")), F.lit(False))


def is_medium(name: Column) -> Column:
    """F-21: the name of a medium, which is no entity, anywhere in it, in any case."""
    return F.coalesce(F.rlike(name, F.lit("(?i)" + "|".join(vocab.MEDIA))), F.lit(False))


def has_leak(text: Column) -> Column:
    """F-21: marks of instructions that leaked into the text."""
    return F.coalesce(F.rlike(text, F.lit("(?i)" + "|".join(f"(?:{m})" for m in vocab.LEAK_MARKERS))), F.lit(False))
