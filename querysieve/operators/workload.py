"""The relational workload behind the statement templates, as parameterised DataFrame queries.

Tables follow ``schemas.AIRPORT_TABLES``. Values enter as literals, never by building text.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import log2, radians, sin, sqrt

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from querysieve.session import broadcast_if_small, materialise

EARTH_RADIUS_KM = 6371
# Cells of ten metres at the equator; computed distances of near places are off by less than the rounding.
FINEST_LEVEL = 22
ROUNDING_KM = 0.001


def by_equality(df: DataFrame, column: str, value, columns: Sequence[str] | None = None) -> DataFrame:
    """Point lookup (airport by ICAO code, airports of a country, frequencies of an airport)."""
    out = df.where(F.col(column) == F.lit(value))
    return out.select(*columns) if columns else out


def by_range(df: DataFrame, column: str, low, high, columns: Sequence[str]) -> DataFrame:
    return df.where(F.col(column).between(low, high)).select(*columns)


def by_like(df: DataFrame, column: str, pattern: str, columns: Sequence[str]) -> DataFrame:
    return df.where(F.col(column).like(pattern)).select(*columns)


def by_either(df: DataFrame, first: tuple, second: tuple) -> DataFrame:
    """One of two equalities on nullable columns."""
    return df.where((F.col(first[0]) == F.lit(first[1])) | (F.col(second[0]) == F.lit(second[1])))


def by_equality_and_like(df: DataFrame, equal: tuple, like: tuple) -> DataFrame:
    return df.where((F.col(equal[0]) == F.lit(equal[1])) & F.col(like[0]).like(like[1]))


def by_list_and_equality(df: DataFrame, column: str, values: Sequence, equal: tuple, columns: Sequence[str]) -> DataFrame:
    return df.where(F.col(column).isin(list(values)) & (F.col(equal[0]) == F.lit(equal[1]))).select(*columns)


def region_counts(airport: DataFrame, regions: DataFrame, country: str) -> DataFrame:
    """Airports per region name inside a country.

    Airports are counted per region code before the join, so a huge region moves one row.
    """
    counts = airport.where(F.col("iso_country") == country).groupBy("iso_region").agg(
        F.count("id").alias("n")
    )
    return (
        counts.join(regions.select("code", "name"), F.col("iso_region") == F.col("code"))
        .groupBy(F.col("name").alias("region_name")).agg(F.sum("n").alias("airport_count"))
        .orderBy("region_name")
    )


def keyword_or_name(airport: DataFrame, keyword: str, name: str) -> DataFrame:
    """Rows whose id is among the keyword matches, or whose name matches.

    ``id`` is the relation's primary key, so an id is among the matches if its own row matches; no join.
    """
    hit = F.col("id").isNotNull() & F.col("keywords").like(keyword)
    return airport.where(hit | F.col("name").like(name)).select("id", "name", "municipality", "iso_country")


def above_average(airport: DataFrame, country: str, floor) -> DataFrame:
    """Elevation above a country's average or above a constant."""
    average = airport.where(F.col("iso_country") == country).agg(F.avg("elevation_ft"))
    high = F.col("elevation_ft")
    return airport.where((high > average.scalar()) | (high > F.lit(floor))).select(
        "id", "name", "type", "iso_country", "municipality"
    )


def runways_of(runways: DataFrame, airport: DataFrame, name: str, column: str = "name") -> DataFrame:
    """Runways of the one airport of that name; several such airports raise."""
    owner = airport.where(F.col(column) == name).select("id")
    return runways.where(F.col("airport_ref") == owner.scalar()).select("id", "length_ft", "surface")


def frequency_search(
    frequencies: DataFrame, airport: DataFrame, navaids: DataFrame,
    airport_range: tuple, navaid_range: tuple,
) -> DataFrame:
    """Airport and navaid frequencies inside two ranges, in one ordered list."""
    of_airports = (
        frequencies.where(F.col("frequency_mhz").between(*airport_range))
        .join(airport.select("ident", "name", "municipality", "iso_country"), F.col("airport_ident") == F.col("ident"))
        .select(
            F.lit("Airport Frequency").alias("source_type"), F.col("airport_ident").alias("code"),
            F.col("name").alias("location_name"), F.col("type").alias("frequency_type"),
            F.col("frequency_mhz").alias("frequency"), "description", "municipality", "iso_country",
        )
    )
    mhz = F.col("frequency_khz") / F.lit(1000.0)
    of_navaids = navaids.where(F.col("frequency_khz").isNotNull() & mhz.between(*navaid_range)).select(
        F.lit("Navaid Frequency").alias("source_type"), F.col("ident").alias("code"),
        F.col("name").alias("location_name"), F.col("type").alias("frequency_type"),
        mhz.alias("frequency"), F.col("usageType").alias("description"),
        F.lit("N/A").alias("municipality"), "iso_country",
    )
    return of_airports.unionByName(of_navaids).orderBy("frequency")


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in kilometres; the cosine is clamped against rounding."""
    cosine = (
        F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2) - F.radians(lon1))
        + F.sin(F.radians(lat1)) * F.sin(F.radians(lat2))
    )
    return F.lit(EARTH_RADIUS_KM) * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def _cells(lat: Column, lon: Column, level: int) -> tuple[Column, Column]:
    """Row and column of a place in a grid of ``2 ** level`` columns around the globe."""
    size = 360.0 / 2**level
    column = F.pmod(F.floor((lon + 180) / size), F.lit(2**level))
    return F.floor((lat + 90) / size).cast("bigint"), column.cast("bigint")


def covered_km(lat: Column, level: int) -> Column:
    """Everything this near to a place of that latitude lies in its cell or one beside it."""
    size = 360.0 / 2**level
    if size >= 180:
        return F.lit(float("inf"))
    # The next row but one begins a cell's height away; a meridian that far off comes nearer towards a pole.
    across = F.asin(F.cos(F.radians(lat)) * F.lit(sin(radians(min(size, 90.0)))))
    return F.lit(EARTH_RADIUS_KM) * F.least(F.lit(radians(size)), across) - F.lit(ROUNDING_KM)


def pairs_in_cells(airport: DataFrame, origin: DataFrame, level: int) -> DataFrame:
    """Airports beside the origins (``_id, _lat, _lon, _north, _east``), met by grid cell."""
    row, column = _cells(F.col("_north"), F.col("_east"), level)
    beside = lambda c: F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda step: c + step)
    columns = F.array_distinct(F.transform(beside(column), lambda c: F.pmod(c, F.lit(2**level))))
    asked = origin.withColumn("_row", F.explode(beside(row))).withColumn("_column", F.explode(columns))
    row, column = _cells(F.col("_north"), F.col("_east"), level)
    held = airport.withColumns({"_row": row, "_column": column}).drop("_north", "_east")
    distance = great_circle(F.col("latitude_deg"), F.col("longitude_deg"), F.col("_lat"), F.col("_lon"))
    met = held.join(asked.drop("_north", "_east"), ["_row", "_column"]).where(F.col("id") != F.col("_id"))
    return met.select("id", "ident", "name", "latitude_deg", "longitude_deg", distance.alias("distance"), "_id")


def nearest(airport: DataFrame, name: str, n: int = 50) -> DataFrame:
    """The ``n`` airports nearest to the airports of a given name, by distance and id.

    Origins meet the airports of their own and the eight neighbouring cells of a grid whose cells hold about as many
    pairs as are asked for. Origins whose neighbours could still be nearer than the n-th pair go on with larger cells,
    until none is left or the cells cover the globe. Of airports at one place only the first ``n + 1`` can be among
    the ``n`` rows, as origins and as neighbours, so a crowded place stays small. The driver holds ``n`` rows.

    Airports without a place have no distance; such pairs come first, as nulls do. ``id`` is the key.
    """
    columns = ["id", "ident", "name", "latitude_deg", "longitude_deg"]
    lat, lon = F.radians("latitude_deg"), F.radians("longitude_deg")
    # The same place in the usual ranges, whatever turns the coordinates hold.
    north = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(lat)))))
    east = F.degrees(F.atan2(F.cos(lat) * F.sin(lon), F.cos(lat) * F.cos(lon)))
    known = F.col("latitude_deg").isNotNull() & F.col("longitude_deg").isNotNull()
    here = Window.partitionBy("latitude_deg", "longitude_deg").orderBy("id")

    def few(df: DataFrame) -> DataFrame:
        return df.where(known).withColumn("_at", F.row_number().over(here)).where(F.col("_at") <= n + 1).select(
            *columns, north.alias("_north"), east.alias("_east")
        )

    origins = airport.where(F.col("name") == name).select(*columns)
    held = materialise(few(airport.select(*columns)), "places")
    asked = materialise(few(origins).select(
        F.col("id").alias("_id"), F.col("latitude_deg").alias("_lat"), F.col("longitude_deg").alias("_lon"), "_north", "_east"
    ), "origins")
    pairs = held.count() * asked.count()
    level = max(0, min(FINEST_LEVEL, int(log2(360 / sqrt(4 * n * 64800 / (9 * max(pairs, 1)))))))
    best: dict[tuple, Row] = {}
    while pairs:
        for row in pairs_in_cells(held, asked, level).orderBy("distance", "id", "_id").limit(n).collect():
            best[row["id"], row["_id"]] = row
        ranked = sorted(best.values(), key=lambda r: (r["distance"], r["id"], r["_id"]))[:n]
        best = {(r["id"], r["_id"]): r for r in ranked}
        reached = ranked[-1]["distance"] if len(ranked) == n else float("inf")
        asked = asked.where(covered_km(F.col("_north"), level) < reached)
        if level <= 1 or asked.isEmpty():
            break
        level = max(1, level - 2)
    spark, schema = airport.sparkSession, airport.select(*columns).schema.simpleString()[7:-1] + ",distance:double"
    placed = spark.createDataFrame([tuple(r)[:6] for r in best.values()], schema)

    def without_distance(rows: DataFrame, of: DataFrame) -> DataFrame:
        first = [r["id"] for r in of.orderBy("id").limit(n + 1).select("id").collect()]
        rows = rows.orderBy("id").limit(n + 1).withColumn("_id", F.explode(F.array(*map(F.lit, first)).cast("array<bigint>")))
        return rows.where(F.col("id") != F.col("_id")).select(*columns, F.lit(None).cast("double").alias("distance"))

    every = airport.select(*columns)
    unplaced = without_distance(every.where(~known), origins).unionByName(without_distance(every.where(known), origins.where(~known)))
    return unplaced.unionByName(placed).orderBy("distance", "id").limit(n)


def airports_in_region(airport: DataFrame, regions: DataFrame, region: str) -> DataFrame:
    """Airports of the regions of a given name."""
    side = regions.where(F.col("name") == region).select("code", F.col("name").alias("region_name"))
    return airport.join(side, F.col("iso_region") == F.col("code")).select("ident", "name", "region_name")


def keyword_union(airport: DataFrame, regions: DataFrame, countries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct (name, entity_type) whose keywords hold the key of their table; ``%`` and ``_`` in it are wildcards."""
    def part(df: DataFrame, key: str, kind: str) -> DataFrame:
        return df.where(F.col("keywords").like(f"%{key}%")).select("name", F.lit(kind).alias("entity_type"))

    parts = [part(airport, keys[0], "airport"), part(regions, keys[1], "region"), part(countries, keys[2], "country")]
    return reduce(DataFrame.union, parts).distinct()


def runway_stats(runways: DataFrame) -> DataFrame:
    """Runway count and length sum per airport: the reduction that precedes every join below.

    Lengths are added as decimals, so a mean that ends in a half does not depend on the order of the rows.
    """
    length, exact = F.col("length_ft"), F.col("length_ft").try_cast("decimal(28,6)")
    whole = F.count(length) == F.count(exact)
    return runways.groupBy("airport_ref").agg(
        F.count("id").alias("runway_count"), F.count(length).alias("_lens"),
        # Lengths that no decimal holds (not a number, beyond 10^22) are added as they are.
        F.when(whole, F.sum(exact)).alias("_len"), F.when(~whole, F.sum(length.cast("double"))).alias("_rough"),
    )


def busy_airports(airport: DataFrame, runways: DataFrame, country: str, more_than: int) -> DataFrame:
    """Airports of a country with more than so many runways."""
    return (
        airport.where(F.col("iso_country") == country)
        .join(runway_stats(runways).where(F.col("runway_count") > more_than), F.col("id") == F.col("airport_ref"))
        .select(F.col("name").alias("airport_name"), F.col("ident").alias("airport_code"), "municipality", "runway_count")
        .orderBy(F.desc("runway_count"), "airport_name")
    )


def navaid_types(navaids: DataFrame, countries: DataFrame, code: str, name_part: str, more_than: int) -> DataFrame:
    """Navaids per type and country, for a country code or a part of a country name."""
    wanted = countries.where((F.col("code") == code) | F.col("name").like(f"%{name_part}%")).select(
        "code", F.col("name").alias("country_name")
    )
    counts = navaids.groupBy("type", "iso_country").agg(F.count("id").alias("n"))
    return (
        counts.join(wanted, F.col("iso_country") == F.col("code"))
        .groupBy("type", "country_name").agg(F.sum("n").alias("navaid_count"))
        .where(F.col("navaid_count") > more_than).orderBy(F.desc("navaid_count"))
    )


def display_codes(airport: DataFrame, municipality: str) -> DataFrame:
    """Codes with defaults and a short name, by municipality pattern."""
    return airport.where(F.col("municipality").like(municipality)).select(
        "name",
        F.coalesce("iata_code", F.lit("NO_IATA")).alias("iata_display"),
        F.coalesce("icao_code", F.lit("NO_ICAO")).alias("icao_display"),
        F.substring("name", 1, 5).alias("short_name"),
        "municipality",
    )


def long_runways(airport: DataFrame, runways: DataFrame, country: str, at_least) -> DataFrame:
    """Airports with runways of a length, their count and rounded mean length."""
    longs = runway_stats(runways.where(F.col("length_ft") >= F.lit(at_least).cast("bigint")))
    return (
        airport.where(F.col("iso_country") == country)
        .join(longs, F.col("id") == F.col("airport_ref"))
        .select(
            F.col("name").alias("airport_name"), "municipality", "runway_count",
            F.coalesce(F.round(F.col("_len") / F.col("_lens")).cast("bigint"), F.round(F.col("_rough") / F.col("_lens")).cast("bigint"))
            .alias("avg_runway_length"),
        )
        .orderBy(F.desc("avg_runway_length"))
    )


def search(df: DataFrame, columns: Sequence[str], **criteria) -> DataFrame:
    """Conjunction of optional predicates.

    A criterion is ``column=value`` or ``column=(kind, ...)`` with kind one of eq, like, in,
    ge, le, between, in_set (any of the words in a comma-separated column), any_like.
    """
    kinds = {
        "eq": lambda c, v: c == F.lit(v),
        "like": lambda c, v: c.like(v),
        "in": lambda c, *v: c.isin(list(v)),
        "ge": lambda c, v: c >= F.lit(v),
        "le": lambda c, v: c <= F.lit(v),
        "between": lambda c, lo, hi: c.between(lo, hi),
        "in_set": lambda c, *words: reduce(lambda a, b: a | b, [F.find_in_set(F.lit(w), c) > 0 for w in words]),
        "any_like": lambda c, *patterns: reduce(lambda a, b: a | b, [c.like(p) for p in patterns]),
    }
    def predicate(column: str, spec) -> Column:
        kind, *args = spec if isinstance(spec, tuple) else ("eq", spec)
        return kinds[kind](F.col(column), *args)

    return df.where(reduce(lambda a, b: a & b, [predicate(c, s) for c, s in criteria.items()])).select(*columns)


def update(df: DataFrame, assignments: dict, where: Column) -> DataFrame:
    """A new table with columns set on matching rows (unknown counts as no match)."""
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({
        c: F.when(hit, F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in assignments.items()
    })


def insert(df: DataFrame, rows: DataFrame, key: str | None = None) -> DataFrame:
    """The table plus rows with a subset of its columns, the others null.

    With ``key``, a row whose key exists already, or comes twice, raises.
    """
    typed = rows.select(*[F.col(c).cast(df.schema[c].dataType).alias(c) for c in rows.columns])
    if key is not None:
        # The table is filtered by the new keys; only its few hits are shuffled.
        fresh_keys = broadcast_if_small(typed.where(F.col(key).isNotNull()).select(key).distinct())
        held = df.select(key).join(fresh_keys, key, "left_semi")
        clashes = held.unionByName(key_violations(typed, key).select(key)).distinct()
        fresh = typed.join(clashes.withColumn("_dup", F.lit(True)), key, "left")
        typed = fresh.where(
            F.when(F.col("_dup"), F.raise_error(F.lit(f"duplicate {key}")).cast("boolean")).otherwise(F.lit(True))
        ).select(*rows.columns)
    return df.unionByName(typed, allowMissingColumns=True)


def key_violations(df: DataFrame, key: str) -> DataFrame:
    """Key values that occur more than once."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def missing_references(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose reference names no parent row."""
    return child.where(F.col(column).isNotNull()).join(
        parent.select(F.col(key).alias(column)), column, "left_anti"
    )


def delete(df: DataFrame, where: Column) -> DataFrame:
    """Rows that do not match; rows where the predicate is unknown stay."""
    return df.where(~F.coalesce(where, F.lit(False)))
