"""Timestamp texts of mixed makes, precisions and zones, normalised to one UTC instant.

Every text is read under each make that fits its form; some forms fit several (a date with slashes can put the day or
the month first). Every source is a mixture of makes, estimated by expectation-maximisation over its own values: a value
adds likelihood to each make under which it is valid, shared by the makes' weights, and the weights are the shares that
come out. A declared order in the source's row is a prior: other orders start with odds of one to DECLARED_ODDS. The
posteriors of a value choose its make; NOISE stands for "none of them", so a make that its source hardly writes wins
nothing by being the only valid one against the prior. What stays below CERTAIN is marked, never guessed.

Defined results: null, empty and unreadable texts are ``unreadable``; a wall time that its zone skipped is ``never``,
one that it had twice ``twice`` (zone letters or an offset in the text decide); a wall time without a known zone is
``no_zone``; a slash date whose order stays open is ``order_open``. Only ``ok`` rows carry ``utc_us``. Length does not
matter; runs of white space count as one blank.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The form that needs no normalising, and the pattern of dates with slashes.
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|\+00:00)$"
SLASHED = r"^\s*(\d{1,4})/(\d{1,2})/(\d{1,4})\b"

# The makes of a mixture and the forms that fit one make only.
MAKES = ["iso", "basic", "mail", "seconds", "milliseconds", "microseconds", "ymd", "dmy", "mdy"]
FORMS = {
    "iso": r"^\s*\d{4}-\d{2}-\d{2}[Tt\s]",
    "basic": r"^\s*\d{8}[Tt]\d{6}",
    "mail": r"^\s*([A-Za-z]{3},\s*)?\d{1,2}\s+[A-Za-z]{3}\s+\d{4}\s",
    "seconds": r"^\s*\d{10}(\.\d+)?\s*$",
    "milliseconds": r"^\s*\d{13}\s*$",
    "microseconds": r"^\s*\d{16}\s*$",
    "ymd": r"^\s*\d{4}/\d{1,2}/\d{1,2}\b",
}

#: Rounds start near the weights of the values that fit one make only, which is where they end without a prior.
EM_ROUNDS, TRACE = 50, 1e-4
CERTAIN, NOISE, DECLARED_ODDS = 0.99, 0.005, 1_000_000.0


def _reader():
    """Build the function (text, zone, order) -> (status, make, microseconds). Built on the executor, once a task."""
    import re
    from datetime import datetime, timedelta, timezone
    from zoneinfo import ZoneInfo

    clock = r"(?P<H>\d{1,2}):(?P<M>\d{2}):(?P<S>\d{2})(?:[.,](?P<f>\d+))?(?:\s*(?P<ap>[AaPp][Mm])(?![A-Za-z]))?"
    zone = r"(?:\s*(?P<off>[Zz]|[+-]\d{2}(?::?\d{2})?))?(?:\s*(?P<let>[A-Za-z]{2,6})(?![A-Za-z_/]))?(?:\s*\[?(?P<name>[A-Za-z_]+(?:/[A-Za-z0-9_+-]+)+)\]?)?\s*$"
    makes = [
        ("iso", re.compile(r"\s*(?P<Y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})(?:[Tt]|\s+)" + clock + zone)),
        ("basic", re.compile(r"\s*(?P<Y>\d{4})(?P<m>\d{2})(?P<d>\d{2})[Tt](?P<H>\d{2})(?P<M>\d{2})(?P<S>\d{2})(?:[.,](?P<f>\d+))?(?P<ap>)" + zone)),
        ("slash", re.compile(r"\s*(?P<a>\d{1,4})/(?P<b>\d{1,2})/(?P<c>\d{1,4})(?:[Tt]|,?\s+)" + clock + zone)),
        ("mail", re.compile(r"\s*(?:(?P<wd>[A-Za-z]{3}),\s*)?(?P<d>\d{1,2})\s+(?P<mon>[A-Za-z]{3})\s+(?P<Y>\d{4})\s+" + clock + zone)),
    ]
    number = re.compile(r"\s*(?:(\d{10})(?:\.(\d+))?|(\d{13})|(\d{16}))\s*$")
    months = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
    days = "mon tue wed thu fri sat sun".split()
    epoch = datetime(1970, 1, 1)
    zones: dict[str, ZoneInfo | None] = {}

    def named(name: str | None) -> ZoneInfo | None:
        if name not in zones:
            try:
                zones[name] = ZoneInfo(name) if name else None
            except (ValueError, OSError, LookupError):
                zones[name] = None
        return zones[name]

    def micros(moment: datetime) -> int:
        return (moment - epoch) // timedelta(microseconds=1)

    def letters_offset(z: ZoneInfo, wall: datetime, letters: str) -> timedelta | None:
        """Offset that the letters stand for in the zone, at that wall time if it uses them then."""
        for fold in (0, 1):
            at = wall.replace(tzinfo=z, fold=fold)
            if at.tzname() == letters:
                return at.utcoffset()
        for month in (1, 7):
            at = datetime(wall.year, month, 1, tzinfo=z)
            if at.tzname() == letters:
                return at.utcoffset()
        return None

    def read(text: str | None, own: str | None, order: str | None) -> tuple[str, str | None, int | None]:
        if text is None:
            return "unreadable", None, None
        text = " ".join(text.split())
        if n := number.match(text):
            if n[1]:
                return "ok", "seconds", int(n[1]) * 1_000_000 + int(((n[2] or "") + "000000")[:6])
            return ("ok", "milliseconds", int(n[3]) * 1000) if n[3] else ("ok", "microseconds", int(n[4]))
        for make, pattern in makes:
            if not (g := pattern.match(text)):
                continue
            g = g.groupdict()
            if make == "slash":
                a, b, c = g["a"], g["b"], g["c"]
                if len(a) == 4:
                    y, m, d = a, b, c
                elif len(c) != 4 or order not in ("dmy", "mdy"):
                    return ("unreadable" if order == "none" else "order_open"), make, None
                else:
                    y, m, d = (c, b, a) if order == "dmy" else (c, a, b)
            elif make == "mail":
                y, m, d = g["Y"], months.get(g["mon"].lower(), 0), g["d"]
            else:
                y, m, d = g["Y"], g["m"], g["d"]
            hour = int(g["H"])
            if g["ap"]:
                if not 1 <= hour <= 12:
                    return "unreadable", make, None
                hour = hour % 12 + 12 * (g["ap"][0] in "pP")
            try:
                wall = datetime(int(y), int(m), int(d), hour, int(g["M"]), int(g["S"]), int(((g["f"] or "") + "000000")[:6]))
            except ValueError:
                return "unreadable", make, None
            if make == "mail" and g["wd"] and days[wall.weekday()] != g["wd"].lower():
                return "unreadable", make, None
            if g["off"]:
                if g["off"] in "Zz":
                    return "ok", make, micros(wall)
                digits = g["off"][1:].replace(":", "") + "00"
                gap = timedelta(hours=int(digits[:2]), minutes=int(digits[2:4]))
                if int(digits[2:4]) > 59 or gap > timedelta(hours=18):
                    return "unreadable", make, None
                return "ok", make, micros(wall - gap if g["off"][0] == "+" else wall + gap)
            if g["let"] and g["let"].upper() in ("UTC", "GMT", "Z"):
                return "ok", make, micros(wall)
            z = named(g["name"] or own)
            if z is None:
                return "no_zone", make, None
            first, second = (wall.replace(tzinfo=z, fold=k).utcoffset() for k in (0, 1))
            try:
                back = (wall - first).replace(tzinfo=timezone.utc).astimezone(z).replace(tzinfo=None)
            except OverflowError:
                return "unreadable", make, None
            if back != wall and first != second:
                return "never", make, None
            if g["let"]:
                shift = letters_offset(z, wall, g["let"])
                return ("no_zone", make, None) if shift is None else ("ok", make, micros(wall - shift))
            return ("ok", make, micros(wall - first)) if first == second else ("twice", make, None)
        return "unreadable", None, None

    return read


def timestamp_texts(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Rows whose text is not yet canonical: ``key`` columns stay, ``text`` null rows go (they name nothing)."""
    return df.where(F.col(text).isNotNull() & ~F.col(text).rlike(CANONICAL))


def makes_of(text: Column) -> Column:
    """Places in MAKES of the makes under which a text may be valid."""
    a, b, c = (F.regexp_extract(text, SLASHED, i) for i in (1, 2, 3))
    slashed = text.rlike(SLASHED) & (F.length(a) < 4) & (F.length(c) == 4)
    day, month = lambda x: x.cast("int").between(1, 31), lambda x: x.cast("int").between(1, 12)
    fits = {**{m: text.rlike(p) for m, p in FORMS.items()}, "dmy": slashed & day(a) & month(b), "mdy": slashed & month(a) & day(b)}
    return F.array_compact(F.array(*[F.when(fits[m], F.lit(i)) for i, m in enumerate(MAKES)]))


def make_weights(texts: DataFrame, sources: DataFrame) -> DataFrame:
    """Expectation-maximisation of the makes of every source: source_id, scores (one a make: values times prior).

    ``texts``: source_id, text. ``sources``: source_id, declared (dmy, mdy, ymd or null). The values enter as counts of
    the sets of makes that fit them, at most a dozen a source, so the rounds run inside one row a source.
    """
    sets = texts.select("source_id", makes_of(F.col("text")).alias("fits")).where(F.size("fits") > 0).groupBy("source_id", "fits").agg(F.count("*").cast("double").alias("n"))
    seen = sets.groupBy("source_id").agg(F.collect_list(F.struct("fits", "n")).alias("seen"))
    table = sources.join(seen, "source_id", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<struct<fits:array<int>,n:double>>")))
    orders = ("ymd", "dmy", "mdy")
    prior = F.array(*[F.when(F.col("declared").isin(*orders) & (F.col("declared") != m), 1 / DECLARED_ODDS).otherwise(1.0) if m in orders else F.lit(1.0) for m in MAKES])
    table = table.withColumn("prior", prior)
    places = F.sequence(F.lit(0), F.lit(len(MAKES) - 1))

    def begin(i: Column) -> Column:
        """Values that fit ``i`` alone; sets of several makes add a trace, by the prior, so that no weight is stuck at 0."""
        part = lambda p: TRACE * F.get("prior", i) / F.aggregate(p["fits"], F.lit(0.0), lambda t, k: t + F.get("prior", k))
        return F.aggregate("seen", F.lit(0.0), lambda s, p: s + F.when(F.array_contains(p["fits"], i), F.when(F.size(p["fits"]) == 1, p["n"]).otherwise(part(p))).otherwise(0.0))

    table = table.withColumn("_begin", F.transform(places, begin))

    def share(weights: Column, i: Column) -> Column:
        """Values that make ``i`` gets under ``weights``; a set without any weight is split by the prior."""

        def of(s: Column, p: Column) -> Column:
            among = lambda of_one: F.aggregate(p["fits"], F.lit(0.0), lambda t, k: t + of_one(k))
            weigh = lambda k: F.get("prior", k) * F.get(weights, k)
            whole = among(weigh)
            part = F.when(whole > 0, weigh(i) / whole).otherwise(F.get("prior", i) / among(lambda k: F.get("prior", k)))
            return s + F.when(F.array_contains(p["fits"], i), p["n"] * part).otherwise(0.0)

        return F.aggregate("seen", F.lit(0.0), of)

    weights = F.aggregate(F.sequence(F.lit(1), F.lit(EM_ROUNDS)), F.col("_begin"), lambda w, _: F.transform(places, lambda i: share(w, i)))
    return table.withColumn("_w", weights).select("source_id", F.zip_with("_w", "prior", lambda w, p: w * p).alias("scores"))


def best_make(fits: Column, scores: Column) -> Column:
    """The make of a value and its posterior: struct of posterior and place in MAKES (null without a fitting make)."""
    whole = F.aggregate(fits, F.lit(NOISE), lambda s, k: s + F.get(scores, k))
    return F.array_max(F.transform(fits, lambda k: F.struct((F.get(scores, k) / whole).alias("posterior"), (-k).alias("place"))))


def slash_orders(texts: DataFrame, sources: DataFrame) -> DataFrame:
    """The order in which every source writes a slash date that leaves it open: source_id, order, posterior.

    Ties, mixed sources and sources without slash dates keep a null order.
    """
    best = best_make(F.array(*[F.lit(MAKES.index(m)) for m in ("dmy", "mdy")]), F.col("scores"))
    named = F.element_at(F.array(*[F.lit(m) for m in MAKES]), 1 - F.col("best.place"))
    weights = make_weights(texts, sources).withColumn("best", best)
    return weights.select("source_id", F.when(F.col("best.posterior") >= CERTAIN, named).alias("order"), F.col("best.posterior").alias("posterior"))


def normalise(texts: DataFrame, sources: DataFrame) -> DataFrame:
    """Add posterior, status, make and utc_us to ``texts`` (which has source_id and text, and any other columns).

    ``sources``: source_id, zone, declared; one row a source. A text whose source has no row has no zone and no
    order. The join side is one row a source, so Spark broadcasts it only when its measured size allows.
    """
    weights = make_weights(texts.select("source_id", "text"), sources.select("source_id", "declared"))
    rows = texts.join(sources.select("source_id", F.col("zone").alias("_zone")).join(weights.withColumnRenamed("scores", "_scores"), "source_id"), "source_id", "left")
    fits = makes_of(F.col("text"))
    rows = rows.withColumn("_fits", fits).withColumn("_best", best_make(F.col("_fits"), F.coalesce("_scores", F.array(*[F.lit(0.0)] * len(MAKES)))))
    place = -F.col("_best.place")
    order = F.when(F.size("_fits") == 0, "none").when(F.col("_best.posterior") >= CERTAIN, F.element_at(F.array(*[F.lit(m) for m in MAKES]), place + 1))
    rows = rows.withColumn("posterior", F.col("_best.posterior")).withColumn("_order", order)

    @F.pandas_udf("status string, make string, utc_us bigint")
    def read_all(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        read = _reader()
        for text, zone, order in parts:
            got = [read(*x) for x in zip(text.tolist(), zone.tolist(), order.tolist())]
            status, make, micros = zip(*got) if got else ((), (), ())
            yield pd.DataFrame({"status": status, "make": make, "utc_us": pd.array(micros, dtype="Int64")})

    # Marked as not deterministic, so that a later filter on the status does not run the reading twice.
    read = rows.withColumn("_read", read_all.asNondeterministic()("text", "_zone", "_order"))
    return read.select("*", "_read.*").drop("_read", "_zone", "_order", "_scores", "_fits", "_best")


def capture_timestamps(captures: DataFrame, traces: DataFrame, recorders: DataFrame) -> DataFrame:
    """All timestamp texts of the two tables that need normalising, with what they mean.

    Returns table_name, row_id, sequence_index (-1 for created_at), source_id, text, posterior, status, make, utc_us. An event
    without a sequence_index keeps null there. Missing events arrays give no rows.
    """

    def events(df: DataFrame, name: str, at: str) -> DataFrame:
        pairs = F.arrays_zip(F.col(f"{at}.sequence_index").alias("i"), F.col(f"{at}.timestamp").alias("t"))
        return df.select("row_id", F.col("recorder_id").alias("source_id"), F.explode(pairs).alias("e")).select(
            F.lit(name).alias("table_name"), "row_id", F.col("e.i").cast("long").alias("sequence_index"), "source_id", F.col("e.t").alias("text")
        )

    made = captures.select(
        F.lit("multi_round_tools").alias("table_name"), "row_id", F.lit(-1).cast("long").alias("sequence_index"), F.col("recorder_id").alias("source_id"), F.col("created_at").alias("text")
    )
    every = made.unionByName(events(captures, "multi_round_tools", "trace.events")).unionByName(events(traces, "source_traces", "events"))
    sources = recorders.select(F.col("recorder_id").alias("source_id"), F.col("tz_name").alias("zone"), F.col("date_order").alias("declared"))
    return normalise(timestamp_texts(every, "row_id", "text", "source_id"), sources)
