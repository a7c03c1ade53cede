"""A crawl over a lattice of makes, years, models and key types that can stop anywhere and go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.shared import save

COMBO = ["make", "year", "model"]
KEY = [*COMBO, "recnum"]
#: Marks of levels without anything below them, and of finished ones; states of vehicles. Fixed values.
NO_YEARS, NO_MODELS, NO_KEYS, DONE = "no_years", "no_models", "no_keys", "done"
OK, NO_TABLE, NO_KEY_TYPES, ERROR = "ok", "no wire table", "no key types", "error"


def resume(makes: DataFrame, years: DataFrame, models: DataFrame, keys: DataFrame, pages: DataFrame, marks: DataFrame, vehicles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both ledgers, ``marks`` (make, year, model, state) and ``vehicles`` (make, year, model, recnum, key_type, status, problem), after a run.

    ``makes``: make; ``years``: make, year; ``models``: make, year, model; ``keys``: make, year, model, recnum,
    key_type; ``pages``: make, year, model, recnum, wires, problem (what fetching a vehicle brought). A level
    with nothing below it is marked once, with "" for what is missing. A combination that is marked isn't
    visited again; of the others, vehicles that are recorded are left alone unless as an error. A combination is
    done when none of the vehicles fetched now failed; one without key types leaves a row that says so.
    A run over a part of the lattice followed by one over the rest leaves what one over all does.
    """
    empty = F.lit("")
    seen = marks.select(*COMBO)
    bare = makes.select("make").distinct().join(years, "make", "left_anti").select("make", empty.alias("year"), empty.alias("model"), F.lit(NO_YEARS).alias("state"))
    hollow = years.select("make", "year").distinct().join(models, ["make", "year"], "left_anti").select("make", "year", empty.alias("model"), F.lit(NO_MODELS).alias("state"))
    todo = models.select(*COMBO).distinct().join(seen, COMBO, "left_anti")
    keyless = todo.join(keys, COMBO, "left_anti")
    recorded = vehicles.where((F.col("status") != ERROR) & F.col("recnum").isNotNull()).select(*KEY)
    # Dealt before repeats go, so that no task sorts all keys of a part of a file to find that few repeat.
    wanted = keys.join(todo, COMBO, "left_semi").repartition(*KEY).dropDuplicates(KEY).join(recorded, KEY, "left_anti")
    problem = F.when(F.col("problem").isNotNull() | F.col("wires").isNull(), F.coalesce("problem", F.lit("no page")))
    fetched = wanted.join(pages.select(*KEY, "wires", "problem"), KEY, "left").withColumn("problem", problem)
    status = F.when(F.col("problem").isNotNull(), ERROR).when(F.col("wires") == 0, NO_TABLE).otherwise(OK)
    # Both ledgers and the next run read what was fetched, so it is written once.
    fetched = save(fetched.select(*KEY, "key_type", status.alias("status"), "problem"), "fetched")
    failed = fetched.where(F.col("status") == ERROR).select(*COMBO)
    done = todo.join(keys, COMBO, "left_semi").join(failed, COMBO, "left_anti").withColumn("state", F.lit(DONE))
    fresh = bare.unionByName(hollow).join(seen, COMBO, "left_anti").unionByName(done).unionByName(keyless.withColumn("state", F.lit(NO_KEYS)))
    without = keyless.select(*COMBO, F.lit(None).cast("string").alias("recnum"), F.lit(None).cast("string").alias("key_type"), F.lit(NO_KEY_TYPES).alias("status"), F.lit(None).cast("string").alias("problem"))
    # A file's size says little of its rows in memory, so they are not broadcast.
    kept = vehicles.join(fetched.select(*KEY).hint("merge"), KEY, "left_anti")
    return marks.unionByName(fresh), kept.select(without.columns).unionByName(fetched).unionByName(without)


def store_pictures(fetched: DataFrame, sources: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What pictures' addresses mean now, (url, image_id, how), and the images to store, (image_id, hash).

    ``fetched``: seq, url, hash (null where the download failed); ``sources``: url, image_id; ``images``: image_id,
    hash. An address that is known keeps its image, whatever it holds today (``url``). A new one is
    known by its first content: that of a stored image, or of an earlier address, is linked (``content``);
    what is left is ``new``. So a picture that is reached by either key is one. Addresses whose every
    download failed stay out, and are tried again.
    """
    first = fetched.where("url IS NOT NULL AND hash IS NOT NULL").groupBy("url").agg(F.min(F.struct("seq", "hash")).alias("f")).select("url", "f.*")
    known = sources.select("url", F.col("image_id").alias("_had"))
    stored = images.groupBy("hash").agg(F.min("image_id").alias("_stored"))
    new = first.join(known, "url", "left_anti").join(stored, "hash", "left")
    # Many addresses may hold one picture: the earliest of each content by an aggregate, not by a window.
    leads = new.where("_stored IS NULL").groupBy("hash").agg(F.min(F.struct("seq", "url")).alias("lead"))
    placed = new.join(leads, "hash", "left")
    own = F.sha2(F.col("hash"), 256)
    how = F.when(F.col("_stored").isNull() & (F.col("lead.url") == F.col("url")), "new").otherwise("content")
    out = placed.select("url", F.coalesce("_stored", own).alias("image_id"), how.alias("how"))
    seen = fetched.select("url").distinct().join(known, "url").select("url", F.col("_had").alias("image_id"), F.lit("url").alias("how"))
    return seen.unionByName(out), leads.select(own.alias("image_id"), "hash")


#: Functions of the wires that a report shows, and photos that one sheet can hold. Fixed values.
POWER, IGNITION = r"(?i)^constant\s*\+?\s*12\s*v(olts?)?(\s*\(\d+\))?$", r"(?i)^ignition(\s*\(\d+\))?$"
EMBED_CAP = 1000
WIRE = ["function", "color", "polarity", "location"]


def circuit_flags(wires: DataFrame) -> DataFrame:
    """For each vehicle of ``wires`` (vehicle, function, photo) whether each circuit was found, and with a photo."""
    power, ignition, photo = F.coalesce(F.col("function").rlike(POWER), F.lit(False)), F.coalesce(F.col("function").rlike(IGNITION), F.lit(False)), F.col("photo").isNotNull()
    return wires.groupBy("vehicle").agg(F.bool_or(power).alias("found_power"), F.bool_or(power & photo).alias("photo_power"), F.bool_or(ignition).alias("found_ignition"), F.bool_or(ignition & photo).alias("photo_ignition"))


def described() -> Column:
    """A wire in words: ``Constant +12 Volts: Red (+) Fuse box (30A)``."""
    said = F.concat_ws(" ", *[F.when((F.lower(c) != "null") & (F.col(c) != ""), F.col(c)) for c in WIRE[1:]])
    notes = F.when(F.coalesce("notes", F.lit("")) != "", F.concat(F.lit(" ("), "notes", F.lit(")"))).otherwise("")
    return F.concat(F.coalesce("function", F.lit("")), F.lit(": "), said, notes)


def tracker(vehicles: DataFrame, wires: DataFrame, photo_cap: int = EMBED_CAP) -> DataFrame:
    """The report's rows: vehicle, make, year, model, ordinal, both circuits' options and photos, labels, and ``embedded``.

    ``vehicles``: vehicle, make, year, model, status; ``wires``: vehicle, pos, function, color, polarity, location,
    notes, photo (a content hash). A vehicle's wires of each circuit, equal ones with one photo once,
    stand side by side in their order; a vehicle without any has one row. A year is a number where it reads
    as one (``year_number``). A label is ``Error`` for a vehicle that failed; ``Found`` for a wire with a photo;
    ``Not found on site`` for one without, for the first row of a circuit without wires and for a vehicle that couldn't be read;
    and blank beyond a circuit's wires. Up to ``photo_cap`` photos are embedded, otherwise all are links.
    """
    sides = {}
    for name, function in (("power", POWER), ("ignition", IGNITION)):
        same = [F.coalesce(c, F.lit("")).alias(f"_{c}") for c in (*WIRE, "photo")]
        own = wires.where(F.col("function").rlike(function)).withColumn("option", described())
        own = own.groupBy("vehicle", *same).agg(F.min(F.struct("pos", "option")).alias("o"), F.first("photo").alias(f"{name}_photo"))
        place = F.row_number().over(Window.partitionBy("vehicle").orderBy("o"))
        sides[name] = own.select("vehicle", place.alias("ordinal"), F.col("o.option").alias(f"{name}_option"), f"{name}_photo")
    both = sides["power"].join(sides["ignition"], ["vehicle", "ordinal"], "full")
    out = vehicles.select("vehicle", "make", "year", "model", "status").join(both, "vehicle", "left").withColumn("ordinal", F.coalesce("ordinal", F.lit(1)))

    def label(name: str) -> Column:
        found = F.when(F.col(f"{name}_photo").isNotNull(), "Found").otherwise("Not found on site")
        first = F.when(F.col("ordinal") == 1, "Not found on site").otherwise("")
        return F.when(F.col("status") == ERROR, "Error").when(F.coalesce(F.col("status") != OK, F.lit(True)), "Not found on site").when(F.col(f"{name}_option").isNotNull(), found).otherwise(first)

    out = out.withColumns({**{f"{n}_label": label(n) for n in sides}, "year_number": F.expr("try_cast(year AS int)")})
    photos = out.agg((F.count("power_photo") + F.count("ignition_photo")).alias("_photos"))
    return out.crossJoin(F.broadcast(photos)).withColumn("embedded", F.col("_photos") <= photo_cap).drop("_photos", "status")


def report_order() -> list[Column]:
    """Makes, then years as numbers before years as texts, then models and rows."""
    return [F.asc("make"), F.asc_nulls_last("year_number"), F.asc("year"), F.asc("model"), F.asc("vehicle"), F.asc("ordinal")]
