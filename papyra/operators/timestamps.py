"""Problem 4: free-text publication dates to one UTC instant.

An ordered cascade of anchored patterns for the date, then one strict pattern for what follows
(time, day half, zone). Everything is a Column expression; nothing leaves the JVM.

Policies
* zone: offset, zone word or listed abbreviation in the text, else the zone of the row's source, else no row;
* a local time that occurs twice is the first of the two, a skipped one takes the offset before the change
  (both are what java.time does in ``to_utc_timestamp``);
* all-number dates that do not lead with the year need the source's order; without a source they are
  read only if one of the two numbers exceeds 12 (only one reading is a date);
* null, empty, relative, day-less and impossible texts give no row; an unknown abbreviation counts as none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.operators.common import latest, strip

# Month names by number, in the languages of the sources.
MONTHS = [
    "january jan enero ene januar janvier janv janeiro",
    "february feb febrero februar février fevrier févr fevereiro fev",
    "march mar marzo märz maerz mrz mars março marco",
    "april apr abril abr avril avr",
    "may mayo mai maio",
    "june jun junio juni juin junho",
    "july jul julio juli juillet juil julho",
    "august aug agosto ago août aout",
    "september sep sept septiembre septembre setembro set",
    "october oct octubre oktober okt octobre outubro out",
    "november nov noviembre novembre novembro",
    "december dec diciembre dic dezember dez décembre déc decembre dezembro",
]
# Words that may stand before a date, and zone words of the texts with their offset in minutes.
LEAD = r"published on|published|posted on|posted|last updated|updated on|updated|发布时间|更新时间|发布于|公開日|veröffentlicht am|veröffentlicht|publié le|publicado el|publicado em"
ZONE_WORDS = {"北京时间": 480, "日本時間": 540}

_MIDDLE = r"(?:\s*[,T\-]?\s*|\s*,?\s+(?:um|at|à|a las|às|kl\.)\s+)"
_ZONE = r"(z|[+\-−]\d{1,2}:?\d{2}|[+\-−]\d{2}|\p{L}{2,5}|[（(]\s*[\p{L}]+\s*[)）])?"
DATES = {  # name: (pattern, (year, month, day, rest))
    "ymd": (r"^(\d{4})(?:-|/|\.|\s*年\s*)(\d{1,2})(?:-|/|\.|\s*月\s*)(\d{1,2})日?+((?:(?:(?<=日)|[^\d]).*)?)$", (1, 2, 3, 4)),
    "compact": (r"^(\d{4})(\d{2})(\d{2})((?:T\d.*)?)$", (1, 2, 3, 4)),
    "numeric": (r"^(\d{1,2})[./\-](\d{1,2})[./\-](\d{4})((?:[^\d].*)?)$", None),
    "day_first": (r"^(\d{1,2})(?:st|nd|rd|th|er|º|\.)?\s+(?:de\s+)?(\p{L}+)\.?\s+(?:de\s+)?(\d{4})((?:[^\d].*)?)$", (3, 2, 1, 4)),
    "month_first": (r"^(\p{L}+)\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})((?:[^\d].*)?)$", (3, 1, 2, 4)),
}
TIME = rf"^{_MIDDLE}(上午|下午|午前|午後)?\s*(\d{{1,2}})\s*[:h时時]\s*(\d{{2}}|\d(?=分))(?:[:分](\d{{2}}))?(?:[.,](\d+))?\s*([ap]\.?\s?m\.?)?\s*(?:uhr|h|分|秒)?\s*{_ZONE}$"
PACKED = rf"^T(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d+))?\s*{_ZONE}$"
BARE = rf"^\s*{_ZONE}$"
_F = "(?iu)"
DAY = 86_400_000_000


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, _F + pattern, group), F.lit(""))


def clean(c: Column) -> Column:
    """Digits and colons to ASCII, one blank for each run of white space, lead words and weekday removed."""
    c = F.translate(c, "０１２３４５６７８９：／－．", "0123456789:/-.")
    c = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    c = F.regexp_replace(c, rf"(?iu)^(?:{LEAD})\s*[:：]?\s*", "")
    return F.regexp_replace(c, r"(?iu)^\p{L}{2,10}\.?,\s+(?=\d)", "")


def _month(c: Column) -> Column:
    words = F.create_map(*[F.lit(x) for i, names in enumerate(MONTHS, 1) for w in names.split() for x in (w, i)])
    return F.coalesce(F.expr("try_cast(_m AS int)") if c is None else c.try_cast("int"), F.try_element_at(words, F.lower(c)))


def parse_local(df: DataFrame, text: str, order: str) -> DataFrame:
    """Add ``_us`` (local or absolute microseconds), ``_zone`` (zone token of the text), ``_abs`` (a bare count) and ``pattern``."""
    names = set(df.columns)
    df = df.withColumn("_c", clean(F.col(text)))
    hit = lambda n: F.col("_c").rlike(_F + DATES[n][0])
    kind = F.when(F.col("_c").rlike(r"^\d{9,20}$"), "count")
    for n in DATES:
        kind = kind.when(hit(n), n)
    df = df.withColumn("pattern", kind)

    def pick(i: int) -> Column:
        out = None
        for n, (p, groups) in DATES.items():
            if groups:
                cond = F.col("pattern") == n
                out = (out.when if out is not None else F.when)(cond, _part(F.col("_c"), p, groups[i]))
        p = DATES["numeric"][0]
        a, b = _part(F.col("_c"), p, 1), _part(F.col("_c"), p, 2)
        first_is_day = F.when(F.col(order) == "DMY", True).when(F.col(order) == "MDY", False).when(a.try_cast("int") > 12, True).when(b.try_cast("int") > 12, False)
        value = [_part(F.col("_c"), p, 3), F.when(first_is_day, b).when(~first_is_day, a), F.when(first_is_day, a).when(~first_is_day, b), F.regexp_extract(F.col("_c"), _F + p, 4)][i]
        return out.when(F.col("pattern") == "numeric", value)

    df = df.select("*", pick(0).try_cast("int").alias("_y"), pick(1).alias("_m"), pick(2).try_cast("int").alias("_d"), F.coalesce(pick(3), F.lit("")).alias("_r"))
    df = df.withColumn("_m", _month(F.col("_m")))
    form = F.when(F.col("_r").rlike(_F + TIME), "time").when(F.col("_r").rlike(_F + PACKED), "packed").when(F.col("_r").rlike(_F + BARE), "bare")
    df = df.withColumn("_f", form)
    r, at = F.col("_r"), lambda t, p: F.when(F.col("_f") == "time", _part(F.col("_r"), TIME, t)).when(F.col("_f") == "packed", _part(F.col("_r"), PACKED, p) if p else None)
    df = df.select(
        "*", at(1, 0).alias("_half"), at(2, 1).try_cast("int").alias("_h"), at(3, 2).try_cast("int").alias("_mi"), at(4, 3).try_cast("int").alias("_s"), at(5, 4).alias("_fr"),
        F.lower(F.substring(at(6, 0), 1, 1)).alias("_ap"),
        F.regexp_replace(F.coalesce(at(7, 5), F.when(F.col("_f") == "bare", _part(r, BARE, 1))), r"[（()）\s]", "").alias("_zone"),
    )
    half = F.when((F.col("_ap") == "a") | F.col("_half").isin("上午", "午前"), 0).when((F.col("_ap") == "p") | F.col("_half").isin("下午", "午後"), 12)
    h = F.when(half.isNull(), F.coalesce("_h", F.lit(0))).when((F.col("_h") <= 12) & (F.col("_half").isNotNull() | (F.col("_h") >= 1)), F.col("_h") % 12 + half)
    leap = ((F.col("_y") % 4 == 0) & (F.col("_y") % 100 != 0)) | (F.col("_y") % 400 == 0)
    days = F.when(F.col("_m") == 2, F.when(leap, 29).otherwise(28)).when(F.col("_m").isin(4, 6, 9, 11), 30).otherwise(31)
    mi, s = F.coalesce("_mi", F.lit(0)), F.coalesce("_s", F.lit(0))
    real = (F.col("_y") >= 1) & F.col("_m").between(1, 12) & (F.col("_d") >= 1) & (F.col("_d") <= days) & h.between(0, 23) & mi.between(0, 59) & s.between(0, 59) & F.col("_f").isNotNull()
    date = F.when(real, F.make_date("_y", "_m", "_d"))
    frac = F.coalesce(F.rpad(F.substring("_fr", 1, 6), 6, "0").cast("long"), F.lit(0))
    local = F.unix_date(date).cast("long") * DAY + ((h * 60 + mi) * 60 + s).cast("long") * 1_000_000 + frac
    n, size = F.col("_c").try_cast("decimal(20,0)"), F.length("_c")
    count = F.when(size <= 11, n * 1_000_000).when(size <= 14, n * 1000).when(size <= 17, n).otherwise(F.floor(n / 1000))
    df = df.withColumn("_us", F.when(F.col("pattern") == "count", F.when(count <= 253402300799999999, count.try_cast("long"))).when(real, local))
    keep = ["_us", "_zone"] + ["pattern"] * ("pattern" not in names)
    return df.select(*[c for c in df.columns if c in names], *keep)


def iso_micros(us: Column) -> Column:
    """Microseconds since 1970 as YYYY-MM-DDTHH:MM:SS.ffffffZ, whatever the session's zone."""
    sod = F.pmod(us, F.lit(DAY))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    part = lambda size, mod: F.floor(sod / size) % mod
    return F.concat(
        F.date_from_unix_date(((us - sod) / DAY).cast("int")).cast("string"), F.lit("T"), two(part(3_600_000_000, 24)), F.lit(":"), two(part(60_000_000, 60)), F.lit(":"),
        two(part(1_000_000, 60)), F.lit("."), F.lpad((sod % 1_000_000).cast("string"), 6, "0"), F.lit("Z"),
    )


def normalise_timestamps(docs: DataFrame, zones: DataFrame, abbrevs: DataFrame, key: str = "file_id", text: str = "published", source: str = "source", arrived: str = "ingested_at") -> DataFrame:
    """(key, utc, pattern, zone_from): one row per key whose latest text names a calendar day.

    ``zones`` and ``abbrevs`` are fixed lookups, joined on the folded source and on the abbreviation;
    a doubled lookup key takes its smallest entry, so no record is multiplied. Columns of ``docs``
    other than the four named are not read; clashing names there do no harm.
    """
    d = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.lower(strip(F.col(source))).alias("_src"), F.col(arrived).alias("_at"))
    z = zones.groupBy(F.lower(strip(F.col("source"))).alias("_src")).agg(F.min(F.struct("zone_name", "date_order")).alias("_z"))
    a = abbrevs.groupBy(F.upper(strip(F.col("abbr"))).alias("_abbr")).agg(F.min("offset_min").alias("_ab"))
    d = d.join(z, "_src", "left").withColumn("_order", F.col("_z.date_order"))
    d = parse_local(d, "_text", "_order").withColumn("_abbr", F.upper("_zone")).join(a, "_abbr", "left")
    sign, hh, mm = (F.regexp_extract("_zone", r"^([+\-−])(\d{1,2}?):?(\d{2})?$", i) for i in (1, 2, 3))
    minutes = hh.try_cast("int") * 60 + F.coalesce(mm.try_cast("int"), F.lit(0))
    offset = F.when(F.upper("_zone") == "Z", 0).when(sign != "", F.when(minutes <= 1080, F.when(sign == "+", minutes).otherwise(-minutes)))
    for word, m in ZONE_WORDS.items():
        offset = offset.when(F.col("_zone") == word, m)
    offset = offset.otherwise(F.col("_ab"))
    bad = (sign != "") & (minutes > 1080)
    d = d.withColumn("_off", offset)
    zoned = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("_us"), F.col("_z.zone_name")))
    us = F.when(F.col("pattern") == "count", F.col("_us")).when(F.coalesce(bad, F.lit(False)), None).when(F.col("_off").isNotNull(), F.col("_us") - F.col("_off").cast("long") * 60_000_000).when(F.col("_z.zone_name").isNotNull(), zoned)
    came = F.when(F.col("pattern") == "count", "count").when(F.col("_off").isNotNull(), "text").otherwise("source")
    out = latest(d.select("_key", "_at", us.alias("_us"), "pattern", came.alias("zone_from")), ["_key"], "_at")
    return out.where("_us IS NOT NULL AND _key IS NOT NULL").select(F.col("_key").alias(key), iso_micros(F.col("_us")).alias("utc"), "pattern", "zone_from")
