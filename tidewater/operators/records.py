"""Episodes out of source records: entities, bodies, and lookups by url (S-19, S-20, F-24, J-03, J-20).

The bodies' headings and labels are fixed values: stored episodes are told apart by the hash of their body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocab


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("string")


def _items(c: Column | str, sign: str = ";") -> Column:
    """Trimmed parts that aren't empty."""
    return F.filter(F.transform(F.split(_text(c), sign), lambda x: F.trim(x)), lambda x: x != "")


def _lines(*lines: Column) -> Column:
    """Lines joined, those that are null left out."""
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def _line(label: str, value: Column, there: Column | None = None) -> Column:
    """`label`value; null if there is no value."""
    return F.when((value != "") if there is None else there, F.concat(F.lit(label), value))


def place_names(raw: Column, countries: dict[str, str] | None = None) -> Column:
    """S-18: the places of a '|' list of '#' fields, each the first and last of three or more comma parts, with its country's name if the code is known."""
    known = F.create_map(*[F.lit(x) for kv in (countries or {}).items() for x in kv]) if countries else None

    def one(part: Column) -> Column:
        sub = F.split(part, "#")
        bits = _items(F.get(sub, F.lit(3)), ",")
        name = F.when(F.size(bits) >= 3, F.concat_ws(", ", F.get(bits, F.lit(0)), F.element_at(bits, -1))).otherwise(F.array_join(bits, ", "))
        there = F.coalesce(F.trim(F.get(sub, F.lit(3))), F.lit("")) != ""
        if known is not None:
            land = known[F.trim(_text(F.get(sub, F.lit(4))))]
            name = F.concat(name, F.coalesce(F.concat(F.lit(" ("), land, F.lit(")")), F.lit("")))
        return F.when(there, name)

    return F.array_compact(F.transform(F.split(_text(raw), r"\|"), one))


def _places(raw: Column | str, countries: dict[str, str] | None) -> Column:
    """A text for each part of a ';' list that names a place."""
    return F.filter(F.transform(_items(raw), lambda x: F.array_join(place_names(x, countries), "; ")), lambda x: x != "")


def record_entities(countries: dict[str, str] | None = None) -> Column:
    """S-19: (type, name) of persons, organizations, locations and translated actors, in this order."""
    of = lambda kind, names: F.transform(names, lambda n: F.struct(F.lit(kind).alias("type"), n.alias("name")))

    def actor(i: int) -> Column:
        name, code = _text(f"actor{i}_name"), _text(f"actor{i}_code")
        return F.when((name != "") & (code != "") & (name != code), F.array(name)).otherwise(F.array().cast("array<string>"))

    return F.concat(of("person", _items("persons")), of("organization", _items("organizations")), of("location", _places("locations", countries)), of("country", actor(1)), of("country", actor(2)))


def _listed(names: Column) -> Column:
    """`a.`, `a and b.`, `a, b, and c.`"""
    n, last = F.size(names), F.element_at(names, -1)
    most = F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 1, F.get(names, F.lit(0))).when(n == 2, F.concat(F.get(names, F.lit(0)), F.lit(" and "), last)).otherwise(F.concat(most, F.lit(", and "), last))


def news_body(countries: dict[str, str] | None = None, theme=S.describe_theme) -> Column:
    """S-20: body of a record with valid_at, domain, themes, persons, organizations, locations, source_url; theme: what a code is called."""
    named = F.filter(F.transform(_items("themes"), lambda t: theme(F.trim(F.split_part(t, F.lit(","), F.lit(1))))), lambda x: x != "")
    places = _places("locations", countries)
    domain = _text("domain")
    five = F.slice(named, 1, 5)
    summary = F.when(F.size(named) > 0, F.concat(F.lit("News coverage related to "), _listed(five), F.lit("."))).when(domain != "", F.concat(F.lit("A news development from "), domain, F.lit("."))).otherwise("A news development from an unknown source.")
    block = lambda label, c, names, glue=", ": F.when(c, F.concat(F.lit(f"**{label}**: "), F.array_join(names, glue), F.lit("\n")))
    return _lines(
        F.lit("## GDELT News Report\n"), _line("**Date**: ", F.concat(_text("valid_at"), F.lit(" UTC")), _text("valid_at") != ""), _line("**Domain**: ", domain), F.lit(""), F.concat(F.lit("**Summary**: "), summary, F.lit("\n")),
        block("Key Topics", F.size(named) > 0, F.slice(named, 1, 10)), block("Key Persons", _text("persons") != "", _items("persons")), block("Key Organizations", _text("organizations") != "", _items("organizations")),
        block("Key Locations", F.size(places) > 0, places, "; "), _line("**Source**: ", _text("source_url")),
    )


def event_body(description: Column, urls: Column) -> Column:
    """S-20: body of an event; description: of its code; urls: those resolved."""
    first = lambda i: F.coalesce(F.nullif(_text(f"actor{i}_name"), F.lit("")), _text(f"actor{i}_code"))
    one, two = first(1), first(2)
    score = F.col("goldstein_scale")
    n = F.size(F.coalesce(urls, F.array().cast("array<string>")))
    numbered = F.array_join(F.transform(urls, lambda u, i: F.concat((i + 1).cast("string"), F.lit(". "), u)), "\n")
    return _lines(
        F.lit("## GDELT Events Report\n"), _line("**Date**: ", _text("event_date")), F.concat(F.lit("**Event**: "), description, F.lit(" (CAMEO "), _text("cameo_code"), F.lit(")")),
        F.when((one != "") | (two != ""), F.concat(F.lit("**Actors**: "), one, F.when(two != "", F.concat(F.lit(" → "), two)).otherwise(""))),
        F.when(score.isNotNull(), F.concat(F.lit("**Goldstein Score**: "), F.format_string("%+.1f", score), F.lit(" ("), S.severity_goldstein(score), F.lit(")"))), F.concat(F.lit("**Tone**: "), F.when(F.col("avg_tone").isNotNull(), F.format_string("%+.1f", "avg_tone"))), F.lit(""),
        F.when(n > 0, F.concat(F.lit("**Sources**:\n"), numbered)).otherwise(_line("**Source**: ", _text("source_url"))),
    )


def article_body(title: Column, summary: Column) -> Column:
    """S-20 of feeds and stock news."""
    return F.concat(F.lit("## "), _text(title), F.lit("\n\n"), F.trim(_text(summary)))


def research_body(title: Column, content: Column, org: Column, author: Column, rating: Column) -> Column:
    """S-20 of research reports; parts apart by an empty line."""
    org, author, rating, content = (_text(c) for c in (org, author, rating, content))
    who = F.when((org != "") & (author != ""), F.concat(F.lit("["), org, F.lit("] "), author)).otherwise(F.concat(org, author))
    meta = F.when((org != "") | (author != "") | (rating != ""), F.concat(who, F.when(rating != "", F.concat(F.lit(" | 评级: "), rating)).otherwise("")))
    return F.array_join(F.array_compact(F.array(_text(title), meta, F.nullif(content, F.lit("")))), "\n\n")


def series_body(source: str, series: Column, name: Column, day: Column, value: Column, previous: Column, units: Column, context: Column | None = None) -> Column:
    """S-20 of macro series: the newest value and its change; a previous value that is no number is told as it stands."""
    delta = S.safe_double(value) - S.safe_double(previous)
    change = F.concat(F.lit("- Change vs previous observation: "), F.format_string("%+.2f", delta), F.lit(" "), units, F.lit(" ("), S.direction(delta), F.lit(")"))
    told = F.when(previous.isNotNull(), F.when(delta.isNotNull(), change).otherwise(F.concat(F.lit("- Previous value: "), previous, F.lit(" "), units)))
    tail = F.lit(None).cast("string") if context is None else _line("\n**Context**: ", _text(context))
    return _lines(F.concat(F.lit(f"## {source}: "), name, F.lit(" ("), series, F.lit(")\n")), F.concat(F.lit("- Observation date: "), day), F.concat(F.lit("- Latest value: "), value, F.lit(" "), units), told, tail)


def notice_body(title: Column, content: Column) -> Column:
    """S-20 of telegraphs and announcements: the content follows if it is longer than the title."""
    title, content = _text(title), _text(content)
    return F.when(F.length(content) > F.length(title), F.concat(title, F.lit("\n\n"), content)).otherwise(title)


def _curve(rates: Column) -> tuple[Column, Column]:
    """The spread of ten over two years in basis points and the curve's shape, both null without the two rates."""
    two, ten = rates["2yr"], rates["10yr"]
    return (ten - two) * 100, F.when(two.isNotNull() & ten.isNotNull(), S.curve_shape(two, ten))


def curve_text(rates: Column, day: Column) -> Column:
    """S-20 of Treasury yields as sentences; rates: map of term to percent.  Terms without a name are left out; null without any rate."""
    items = [F.concat(F.lit(name), F.format_string("%.2f%%", rates[term])) for term, name in vocab.CURVE_TERMS.items()]
    told = [F.when(rates[term].isNotNull(), item) for term, item in zip(vocab.CURVE_TERMS, items)]
    spread, shape = _curve(rates)
    sentence = F.create_map(*[F.lit(x) for kv in vocab.CURVE_SHAPES.items() for x in kv])[shape]
    tail = F.concat(F.lit(vocab.CURVE_SPREAD), F.when(spread > 0, "+").otherwise(""), F.format_string("%.0fbp，", spread), sentence)
    head = F.concat(F.lit("美国国债收益率曲线（"), day, F.lit("）："), F.array_join(F.array_compact(F.array(*told)), "，"), F.lit("。"))
    return F.when(F.size(rates) > 0, F.concat(head, F.when(shape.isNotNull(), tail).otherwise("")))


def curve_list(rates: Column, day: Column) -> Column:
    """S-20 of Treasury yields as a list, where terms have no names; null without any rate."""
    rows = [F.when(rates[t].isNotNull(), F.concat(F.lit(f"- {t}: "), F.format_string("%.2f%%", rates[t]))) for t in vocab.CURVE_LISTED]
    spread, shape = _curve(rates)
    tail = F.when(shape.isNotNull(), F.concat(F.format_string("Spread (2s10s): %.1f bp | Shape: ", spread), shape))
    return F.when(F.size(rates) > 0, _lines(F.concat(F.lit("## US Treasury Yield Curve — "), day, F.lit("\n")), *rows, F.lit(""), tail))


def _of(indicator: Column, table: dict[str, tuple[str, ...]], i: int) -> Column:
    return F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v[i])])[indicator] if table else F.lit(None).cast("string")


def china_body(indicator: Column, value: Column, day: Column, told: dict[str, tuple[str, str, str]] | None = None) -> Column:
    """S-20 of China's series: a sentence for the indicators in `told` (name, unit, meaning), a list for others.

    Growth of `gdp` is told as such whatever its unit.  A value that is null or no number has no body.
    """
    told = vocab.CHINA_TOLD if told is None else told
    two = F.format_string("%.2f", value)
    name, unit, meaning = (_of(indicator, told, i) for i in range(3))
    amount = F.when(indicator == "gdp", F.concat(F.lit("同比增长"), two, F.lit("%"))).otherwise(F.concat(two, unit))
    stop = F.when((meaning == "") | F.endswith(meaning, F.lit("。")), "").otherwise("。")
    sentence = F.concat(F.lit("中国"), F.coalesce(F.nullif(name, F.lit("")), indicator), F.lit("，"), day, F.lit("："), amount, F.lit("。"), meaning, stop)
    listed_unit = F.coalesce(_of(indicator, vocab.CHINA_LISTED, 1), F.lit(""))
    mark = lambda *cases: F.coalesce(*[F.when(c, f"**Interpretation**: {text}") for c, text in cases])
    pmi, cpi, ppi = indicator.isin("pmi", "caixin_pmi"), indicator == "cpi", indicator == "ppi"
    meant = mark(
        (pmi & (value > 50), "Expansion (above 50 threshold)"), (pmi, "Contraction (below 50 threshold)"), (cpi & (value > 3), "High inflation (above 3% target)"), (cpi & (value < 0), "Deflation (negative CPI)"),
        (cpi, "Moderate inflation"), (ppi & (value > 0), "Producer price inflation"), (ppi, "Producer price deflation"),
    )
    listed = _lines(
        F.concat(F.lit("## China "), F.coalesce(_of(indicator, vocab.CHINA_LISTED, 0), indicator), F.lit(" — "), day, F.lit("\n")),
        F.concat(F.lit("- Value: "), two, F.when(listed_unit != "", F.concat(F.lit(" "), listed_unit)).otherwise("")),
        F.concat(F.lit("- Frequency: "), F.coalesce(_of(indicator, vocab.CHINA_LISTED, 2), F.lit("unknown"))), F.lit(""), meant,
    )
    return F.when(value.isNotNull() & ~F.isnan(value), F.when(name.isNotNull(), sentence).otherwise(listed))


def conflict_body(most: int = 500) -> Column:
    """S-20 of conflict events; notes over `most` characters are cut."""
    notes = _text("notes")
    short = F.when(F.length(notes) <= most, notes).otherwise(F.concat(F.left(notes, F.lit(most - 3)), F.lit("...")))
    return _lines(
        F.concat(F.lit("## ACLED: "), _text("event_type"), F.lit(" in "), _text("country"), F.lit("\n")), F.concat(F.lit("- Event ID: "), _text("event_id_cnty")), F.concat(F.lit("- Event date: "), _text("event_date")),
        F.concat(F.lit("- Event type: "), _text("event_type")), F.concat(F.lit("- Country: "), _text("country")), F.concat(F.lit("- Fatalities: "), _text("fatalities")),
        _line("- Actor 1: ", _text("actor1")), _line("- Actor 2: ", _text("actor2")), _line("- Notes: ", short, notes != ""),
    )


def sanction_body(names: dict[str, str] | None = None) -> Column:
    """S-20 of sanctions (entity_name, target_type, country, sanction_program, listing_date, source); names: what programs are called."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else F.create_map().cast("map<string,string>")
    told = F.transform(S.programs(_text("sanction_program")), lambda p: F.concat(p, F.coalesce(F.concat(F.lit(" — "), table[p]), F.lit(""))))
    return _lines(
        F.concat(F.lit("## Sanctions: "), _text("entity_name"), F.lit("\n")), F.concat(F.lit("- Target type: "), _text("target_type")), _line("- Country: ", _text("country")),
        F.when(F.size(told) > 0, F.concat(F.lit("- Sanction program: "), F.array_join(told, "; "))), _line("- Listing date: ", _text("listing_date")), F.concat(F.lit("- Source: "), _text("source")),
    )


def event_record(urls: Column) -> list[Column]:
    """F-24: columns of an event's record, which a news record has too; the event's day is its valid_at."""
    kept = ["cameo_code", "actor1_code", "actor1_name", "actor2_code", "actor2_name", "goldstein_scale", "avg_tone", "event_date"]
    empty = [F.lit("").alias(c) for c in ("domain", "themes", "locations", "persons", "organizations", "tone")]
    valid_at = F.concat(F.replace(_text("event_date"), F.lit("-"), F.lit("")), F.lit("000000"))
    return [*map(F.col, kept), F.coalesce(F.get(urls, F.lit(0)), F.lit("")).alias("source_url"), urls.alias("resolved_urls"), valid_at.alias("valid_at"), *empty]


def outcomes(asked: DataFrame, fetched: DataFrame, pos: str, url: str = "url") -> DataFrame:
    """J-20: asked (pos, url) with the last outcome (seq, status, html, error) of its url; one without any has an error. `retry`: an error and no page."""
    last = fetched.groupBy(url).agg(F.max_by(F.struct("status", "html", "error"), "seq").alias("x"))
    d = asked.join(last, url, "left")
    error = F.when(F.col("x").isNull(), "Unknown error: request never completed").otherwise(F.col("x.error"))
    html = F.coalesce("x.html", F.lit(""))
    return d.select(*asked.columns, F.coalesce("x.status", F.lit(0)).alias("status"), html.alias("html"), error.alias("error"), (error.isNotNull() & (html == "")).alias("retry"))


def attach_text(records: DataFrame, fetched: DataFrame, url: str = "source_url") -> DataFrame:
    """J-03: adds full_text and content_fetched from results (url, seq, success, text); the last result of a url counts."""
    last = fetched.groupBy(F.col("url").alias(url)).agg(F.max_by(F.struct("success", "text"), "seq").alias("x"))
    ok = F.coalesce(F.col("x.success") & (F.coalesce("x.text", F.lit("")) != ""), F.lit(False))
    return records.join(last, url, "left").select(*records.columns, F.when(ok, F.col("x.text")).alias("full_text"), ok.alias("content_fetched"))
