"""Scalar functions on columns; survey ids in docstrings. None runs Python per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words]) if words else F.lit(False)


def unescape(text: Column) -> Column:
    """Common HTML entities, '&amp;' last so that nothing decodes twice."""
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), text)


def clean_text(text: Column) -> Column:
    """S-03: unescape, then strip control characters but tab and line ends."""
    return strip_control(unescape(text))


def strip_control(text: Column) -> Column:
    """S-04."""
    return F.regexp_replace(text, CONTROL, "")


def strip_html(text: Column) -> Column:
    """S-05: tags dropped, entities decoded, white space collapsed."""
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(text, "<[^>]+>", "")), r"\s+", " "))


def strip_html_telegraph(text: Column) -> Column:
    """S-06: four literal entities, '&amp;' before '&lt;', so '&amp;lt;' decodes twice."""
    out = F.regexp_replace(text, "<[^>]+>", "")
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(out)


def strip_tags(text: Column) -> Column:
    """S-07: tags become spaces, white space collapses."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"\s+", " "))


def clean_extracted(text: Column) -> Column:
    """S-08: entities to spaces, tags dropped, tabs and runs of spaces to one, control characters but line feed dropped."""
    out = F.regexp_replace(text, "&[a-zA-Z]+;|&#[0-9]+;", " ")
    out = F.regexp_replace(out, "<[^>]+>", "")
    out = F.regexp_replace(F.translate(out, "\t", " "), " +", " ")
    return F.trim(F.regexp_replace(out, r"[\x00-\x09\x0B-\x1F]", ""))


def keywords_first(text: Column, n: int = 8) -> Column:
    """S-09: the first n runs of letters, Latin or CJK."""
    return F.slice(F.regexp_extract_all(text, F.lit("[A-Za-z\\u4e00-\\u9fff]+"), F.lit(0)), 1, n)


def keywords_runs(text: Column, n: int = 10) -> Column:
    """S-10: CJK or Latin runs of two characters or more, the first n."""
    runs = F.regexp_extract_all(text, F.lit("[\\u4e00-\\u9fff]+|[A-Za-z]+"), F.lit(0))
    return F.slice(F.filter(runs, lambda x: F.length(x) >= 2), 1, n)


def entities(text: Column, cap: int = 10) -> Column:
    """S-11: array<struct<type,name>> of tickers (sorted), countries, commodities and themes, at most cap."""
    one = lambda kind, name: F.struct(F.lit(kind).alias("type"), F.lit(name).alias("name"))
    tickers = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\$([A-Z]{2,5})\b"), F.lit(1))))
    found = [F.when(F.rlike(text, F.lit(rf"(?i)\b{c}\b")), one("country", c)) for c in vocab.COUNTRIES]
    found += [F.when(F.rlike(text, F.lit("(?i)" + p)), one("commodity", n)) for n, p in vocab.COMMODITIES.items()]
    found += [F.when(F.rlike(text, F.lit("(?i)" + p)), one("theme", n)) for n, p in vocab.THEMES.items()]
    stocks = F.transform(tickers, lambda t: F.struct(F.lit("stock").alias("type"), t.alias("name")))
    return F.slice(F.concat(stocks, F.array_compact(F.array(*found))), 1, cap)


def severity_by_words(body: Column, n_sources: Column, words: dict[str, list[str]] | None = None) -> Column:
    """S-12: five sources are high; else the first level one of whose words occurs; else medium."""
    out = F.when(n_sources >= 5, "high")
    for level, ws in (words or vocab.SEVERITY_WORDS).items():
        out = out.when(_any(body, ws), level)
    return out.otherwise("medium")


def severity_tone(tone: Column) -> Column:
    """S-13: by the first comma item; unreadable is medium."""
    v = F.split_part(tone, F.lit(","), F.lit(1)).try_cast("double")
    return F.when(v.isNull(), "medium").when(v > 5, "low").when(v >= -5, "medium").when(v >= -10, "high").otherwise("critical")


def severity_goldstein(g: Column) -> Column:
    """S-14."""
    return F.when(g.isNull(), "medium").when(F.abs(g) >= 8, "critical").when(F.abs(g) >= 6, "high").when(F.abs(g) >= 4, "medium").otherwise("low")


def severity_series(series: Column, value: Column, previous: Column) -> Column:
    """S-15: jumps of rates, price indices, inventories and payrolls are high, all else medium."""
    d = value - previous
    high = (
        (series.isin("UNRATE", "LNS14000000") & (d >= 1)) | ((series == "DFF") & (F.abs(d) >= 0.75)) | (series.isin("CPIAUCSL", "PPIACO") & (d >= 1))
        | ((series == "WCRSTUS1") & (F.abs(d) >= 10000)) | ((series == "WGASUS1") & (F.abs(d) >= 0.25)) | ((series == "CES0000000001") & (d <= -500))
    )
    return F.when(high, "high").otherwise("medium")


def severity_fatalities(n: Column, kind: Column) -> Column:
    """S-15, conflict events."""
    return F.when(n >= 100, "critical").when(n >= 25, "high").when((n >= 1) | kind.isin("Battles", "Explosions/Remote violence"), "medium").otherwise("low")


def severity_china(indicator: Column, v: Column) -> Column:
    """S-15, bands of price and purchasing indices."""
    cpi = F.when((v > 3) | (v < 0), "high").when((v > 2) | (v < 0.5), "medium").otherwise("low")
    ppi = F.when(F.abs(v) > 5, "high").when(F.abs(v) > 2, "medium").otherwise("low")
    pmi = F.when((v > 52) | (v < 48), "high").when((v > 51) | (v < 49), "medium").otherwise("low")
    return F.when(indicator == "cpi", cpi).when(indicator == "ppi", ppi).when(indicator.isin("pmi", "caixin_pmi"), pmi).otherwise("medium")


def severity_curve(two: Column, ten: Column) -> Column:
    """S-15, yield curve: two years above ten is high, within a quarter point below is medium."""
    return F.when(two - ten > 0, "high").when(two - ten > -0.25, "medium").otherwise("low")


def curve_shape(two: Column, ten: Column) -> Column:
    """S-21: other bounds than the severity on purpose (quirk Q17)."""
    bp = (ten - two) * 100
    return F.when(bp > 0, "normal").when(bp > -25, "flat").otherwise("inverted")


def weight(severity: Column) -> Column:
    """S-16."""
    return F.when(severity == "critical", 4).when(severity == "high", 3).when(severity == "medium", 2).when(severity == "low", 1).otherwise(0)


def persons(text: Column) -> Column:
    """S-17: ';' list without blank items and items that hold '#'."""
    return F.filter(F.transform(F.split(text, ";"), lambda s: F.trim(s)), lambda s: (s != "") & ~F.contains(s, F.lit("#")))


def locations(text: Column) -> Column:
    """S-18: '|' list of '#' fields; of three or more comma parts the first and the last."""

    def name(part):
        full = F.get(F.split(part, "#"), F.lit(3))
        bits = F.transform(F.split(full, ","), lambda s: F.trim(s))
        return F.when(F.size(bits) >= 3, F.concat(F.get(bits, F.lit(0)), F.lit(", "), F.element_at(bits, -1))).otherwise(F.trim(full))

    return F.filter(F.transform(F.split(text, r"\|"), name), lambda s: s.isNotNull() & (s != ""))


def describe_theme(code: Column) -> Column:
    """S-22: the name of the longest known prefix, then the rest in title case."""
    plain = lambda c: F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
    out = plain(code)
    for prefix, name in sorted(vocab.THEME_PREFIXES.items(), key=lambda x: len(x[0])):  # the longest is asked last, so first
        rest = F.substr(code, F.lit(len(prefix) + 1))
        out = F.when(F.startswith(code, F.lit(prefix)), F.when(rest == "", name).otherwise(F.concat(F.lit(name + " - "), plain(rest)))).otherwise(out)
    return out


def edge_type(name: Column) -> Column:
    """S-23: first prefix rule of the upper-cased name."""
    up = F.trim(F.upper(name))
    out = F.when(up.isNull() | (up == ""), "RELATES_TO")
    for core, prefixes in vocab.EDGE_PREFIXES:
        hit = reduce(lambda a, b: a | b, [F.startswith(up, F.lit(p)) for p in prefixes])
        out = out.when(hit | (up == "IN") if core == "HAPPENED_IN" else hit, core)
    return out.otherwise("RELATES_TO")


def edge_type_of_fact(fact: Column, families=vocab.FACT_PATTERNS) -> Column:
    """S-24: first family one of whose patterns is found in the lower-cased fact; null if none."""
    low, out = F.lower(fact), None
    for core, patterns in families:
        hit = F.rlike(low, F.lit("|".join(f"(?:{p})" for p in patterns)))
        out = F.when(hit, core) if out is None else out.when(hit, core)
    return out


def legacy_edge_type(fact: Column) -> Column:
    """S-24: what the first pattern found in the lower-cased fact was once called; null if none."""
    low, out = F.lower(fact), None
    for core, patterns in vocab.FACT_PATTERNS:
        for p in patterns:
            name = vocab.LEGACY.get(p, vocab.LEGACY_DEFAULTS.get(core, core))
            hit = F.rlike(low, F.lit(p))
            out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def is_canonical(name: Column, aliases: dict[str, str]) -> Column:
    """S-02: the name stands for itself."""
    return F.coalesce(canonical_name(name, aliases) == name, F.lit(False))


def canonical_names(names: Column, aliases: dict[str, str]) -> Column:
    """S-02: of every name of an array, in order."""
    return F.transform(names, lambda n: canonical_name(n, aliases))


def types_meet(kinds: Column, wanted: list[str]) -> Column:
    """U-05: some type is wanted, in any case."""
    return F.coalesce(F.arrays_overlap(F.transform(kinds, lambda k: F.lower(k)), F.array(*[F.lit(w.lower()) for w in wanted])), F.lit(False))


def with_core_types(allowed: Column, core: list[str]) -> Column:
    """U-06: a map of allowed edge types, each list followed by the core types that it lacks."""
    return F.transform_values(allowed, lambda _, v: F.array_distinct(F.concat(v, F.array(*map(F.lit, core)))))


def truncate_leaked(text: Column) -> Column:
    """S-25: cut at the first leak marker, then quotes and spaces off both ends; empty becomes null."""
    cut = F.regexp_replace(text, "(?is)(?:" + "|".join(vocab.LEAK_MARKERS) + ").*$", "")
    return F.nullif(F.regexp_replace(cut, "^[\"'\\s]+|[\"'\\s]+$", ""), F.lit(""))


def programs(text: Column) -> Column:
    """S-26: 'A] [B' lists."""
    bits = F.transform(F.split(text, r"\] \["), lambda s: F.trim(F.translate(s, "[]", "")))
    return F.filter(bits, lambda s: (s != "") & (s != "-0-"))


def target_type(raw: Column) -> Column:
    """S-27."""
    t = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(t == "individual", "person").when(t.isin("vessel", "aircraft"), t).otherwise("legalEntity")


def exchange_of(code: Column) -> Column:
    """S-28: six digits by prefix, five digits Hong Kong."""
    six = F.lpad(code, 6, "0")
    return F.when(~F.rlike(code, F.lit("^[0-9]+$")), F.lit(None)).when(F.length(code) == 5, "HKEX").when(F.startswith(six, F.lit("6")), "SSE").when(F.rlike(six, F.lit("^[03]")), "SZSE")


def host(url: Column) -> Column:
    """S-32."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def episode_name(source: Column, valid_at: Column, group: Column, digest: Column) -> Column:
    """Source, day, group unless empty, and 12 characters of the content hash."""
    return F.concat_ws("-", source, F.date_format(valid_at, "yyyyMMdd"), F.nullif(group, F.lit("")), F.left(digest, F.lit(12)))


def first_line(body: Column, most: int = 200) -> Column:
    """S-34: the first line that isn't blank."""
    return F.left(F.get(F.filter(F.transform(F.split(body, "\n"), lambda s: F.trim(s)), lambda s: s != ""), F.lit(0)), F.lit(most))


def entity_type(labels: Column, ticker: Column) -> Column:
    """S-35."""
    up = F.transform(labels, F.upper)
    out = None
    for label, kind in vocab.LABELS.items():
        hit = F.array_contains(up, label)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.when(F.coalesce(ticker, F.lit("")) != "", "stock").otherwise("unknown")


def canonical_name(name: Column, aliases: dict[str, str]) -> Column:
    """S-01: alias lookup of the trimmed name, then of what is left as corporate suffixes fall off the end.

    If all words are suffixes, the trimmed name stays.  White space collapses.
    """
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else F.create_map().cast("map<string,string>")
    words = F.split(F.trim(name), r"\s+")
    suffixes = F.array(*map(F.lit, vocab.CORPORATE_SUFFIXES))
    is_suffix = F.transform(words, lambda w: F.array_contains(suffixes, F.lower(w)) | F.array_contains(suffixes, F.rtrim(F.lower(w), F.lit("."))))
    # words that remain when all trailing suffixes are gone
    kept = F.aggregate(is_suffix, F.struct(F.lit(0).alias("i"), F.lit(0).alias("last")), lambda a, s: F.struct((a["i"] + 1).alias("i"), F.when(s, a["last"]).otherwise(a["i"] + 1).alias("last")), lambda a: a["last"])
    tries = F.transform(F.sequence(F.size(words), F.greatest(kept, F.lit(1)), F.lit(-1)), lambda n: F.array_join(F.slice(words, 1, n), " "))
    hits = F.filter(F.transform(tries, lambda t: F.element_at(table, F.lower(t))), lambda x: x.isNotNull())
    base = F.when(kept == 0, F.array_join(words, " ")).otherwise(F.array_join(F.slice(words, 1, kept), " "))
    return F.when(F.trim(name) == "", F.trim(name)).otherwise(F.coalesce(F.get(hits, F.lit(0)), base))


def direction(delta: Column) -> Column:
    """M-01."""
    return F.when(delta > 0, "up").when(delta < 0, "down").otherwise("flat")


def backoff(attempts: Column) -> Column:
    """M-03: seconds until the next try."""
    return F.least(F.lit(21600.0), 600 * F.pow(F.lit(2.0), F.greatest(attempts, F.lit(0))))


def safe_double(text: Column) -> Column:
    """K-05."""
    return F.trim(text).try_cast("double")


def safe_int(text: Column) -> Column:
    """K-05: 0 when unreadable; separators dropped, decimals cut."""
    return F.coalesce(F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double").cast("int"), F.lit(0))


# Dates


def day(text: Column) -> Column:
    """D-01: yyyyMMdd; null when bad."""
    return F.to_date(F.try_to_timestamp(F.trim(text), F.lit("yyyyMMdd")))


def stamp(text: Column, now: Column) -> Column:
    """D-02: 14 digits; now when bad."""
    return F.coalesce(F.try_to_timestamp(F.left(F.trim(text), F.lit(14)), F.lit("yyyyMMddHHmmss")), now)


def period_date(year: Column, period: Column) -> Column:
    """D-03: M01 to M12 is the month's first day, M13 the year's last."""
    m = F.regexp_extract(period, "^M([0-9]{2})$", 1).try_cast("int")
    return F.when(m.between(1, 12), F.make_date(year.cast("int"), m, F.lit(1))).when(m == 13, F.make_date(year.cast("int"), F.lit(12), F.lit(31)))


def month_or_day(text: Column) -> Column:
    """D-04, D-11."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.try_to_timestamp(text, F.lit("yyyy-MM")), F.try_to_timestamp(text))


def chinese_date(text: Column) -> Column:
    """D-05: year and month, or year and quarter (a range counts by its last quarter), or ISO."""
    y = F.regexp_extract(text, "^([0-9]{4})年", 1).try_cast("int")
    m = F.regexp_extract(text, "年([0-9]{1,2})月", 1).try_cast("int")
    q = F.regexp_extract(text, "第(?:[0-9]-)?([1-4])季度", 1).try_cast("int")
    return F.coalesce(F.make_date(y, F.coalesce(m, q * 3), F.lit(1)), F.to_date(month_or_day(text)))


def china_time(text: Column) -> Column:
    """D-06: local time of UTC+8."""
    return F.to_utc_timestamp(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss")]), "+08:00")


def iso(ts: Column) -> Column:
    """D-09: one 'Z', unlike quirk Q5."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def from_epoch(value: Column) -> Column:
    """D-07: a timestamp of seconds, or of milliseconds from 100 billion on."""
    return F.when(value >= 100_000_000_000, F.timestamp_millis(value)).otherwise(F.timestamp_seconds(value))


def seconds_of(text: Column) -> Column:
    """M-04: seconds of '250ms', '3s', '1.5m' or '1h', of a bare number as well; null for other text."""
    shape = r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*(ms|s|m|h)?\s*$"
    n, unit = F.regexp_extract(text, shape, 1).try_cast("double"), F.lower(F.regexp_extract(text, shape, 2))
    return F.when(unit == "ms", n / 1000).when(unit == "m", n * 60).when(unit == "h", n * 3600).otherwise(n)


def event_id(uid: Column, now: Column) -> Column:
    """S-33: the day of now at UTC+8 and the first three signs of the id without '-'; ids of one day can collide (quirk Q6)."""
    day_there = F.date_format(F.from_utc_timestamp(now, "+08:00"), "yyyyMMdd")
    return F.concat(F.lit("evt-"), day_there, F.lit("-"), F.upper(F.left(F.replace(uid, F.lit("-"), F.lit("")), F.lit(3))))


def summary_of(body: Column, least: int = 10, most: int = 500) -> Column:
    """S-34: what follows the first line that isn't blank, stripped, if it is longer than `least`."""
    text = F.regexp_replace(body, r"^\s+", "")
    after = F.when(F.contains(text, F.lit("\n")), F.substr(text, F.instr(text, F.lit("\n")) + 1))
    rest = F.regexp_replace(after, r"^\s+|\s+$", "")
    return F.when(F.length(rest) > least, F.left(rest, F.lit(most)))


def signature(request: Column) -> Column:
    """S-31: md5 of the hexadecimal sha1."""
    return F.md5(F.sha1(request))
