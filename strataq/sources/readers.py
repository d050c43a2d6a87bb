"""Sources: strict CSV, structural profiles, GeoJSON, prepared packs, blobs, records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACK_ROW = (
    "id string, event_group string, entity string, endpoint string, timezone string, source_id string, split string, contract string, source_span string, "
    "predicate string, threshold double, unit string, event_time string, rules_available_at string, observed_at string, available_at string, cutoff string, "
    "resolved_at string, price double, label int"
)
#: Columns that would leak the outcome into a prediction.
PROTECTED = ("label", "resolved_at", "split")
OFFSET = r"(Z|[+-]\d\d:?\d\d)$"


def strict_csv(spark: SparkSession, path: str, header: Sequence[str] | None = None) -> DataFrame:
    """Every column as text; the header must be unique, present, unpadded and, if given, exactly this one.

    Rows of another width raise when they are read.
    """
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ValueError(f"{path}: empty file")
    names = spark.read.csv(path, header=True, inferSchema=False).columns
    if len(names) > 256 or len(set(names)) != len(names) or any(not n or n != n.strip() for n in names):
        raise ValueError(f"{path}: header is not unique, nonempty and unpadded: {names}")
    if header is not None and list(header) != names:
        raise ValueError(f"{path}: expected header {list(header)}, found {names}")
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST")


def truncated(df: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The first ``most`` rows, and whether there are more."""
    return df.limit(most), df.limit(most + 1).count() > most


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """Files with their digest: name, size, sha256, content."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")


def verified(blob: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, sha256) expected, and whether the stored bytes have that digest."""
    found = blob.select("name", F.col("sha256").alias("found"))
    return expected.join(found, "name", "left").select("name", "sha256", F.coalesce(F.col("found") == F.col("sha256"), F.lit(False)).alias("intact"))


GEO = "type string, features array<struct<type: string, geometry: struct<type: string, coordinates: string>, properties: map<string,string>>>"


def geojson(collections: DataFrame, column: str) -> DataFrame:
    """One row per feature of FeatureCollections: kind, vertices, fault (null if admitted).

    Points and polygons only; rings are closed and have four positions or more;
    longitudes and latitudes stay inside the globe.
    """
    parsed = collections.select(F.from_json(column, GEO, {"mode": "PERMISSIVE"}).alias("g"))
    f = parsed.select(F.col("g.type").alias("collection"), F.posexplode_outer("g.features").alias("feature", "f"))
    f = f.select("collection", "feature", F.col("f.type").alias("type"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    point = F.from_json("c", "array<double>")
    rings = F.when(F.col("kind") == "Polygon", F.from_json("c", "array<array<array<double>>>")).otherwise(F.array(F.array(point)))
    f = f.withColumn("rings", rings).withColumn("positions", F.flatten("rings"))
    inside = F.forall("positions", lambda p: F.coalesce((F.size(p) == 2) & F.abs(p[0]).between(0, 180) & F.abs(p[1]).between(0, 90), F.lit(False)))
    closed = F.forall("rings", lambda r: (F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -1)))
    fault = (
        F.when(F.coalesce(F.col("collection"), F.lit("")) != "FeatureCollection", "not_a_collection")
        .when(F.coalesce(F.col("type"), F.lit("")) != "Feature", "not_a_feature").when(~F.coalesce(F.col("kind"), F.lit("")).isin("Point", "Polygon"), "unsupported_geometry")
        .when(F.col("positions").isNull() | ~inside, "outside_the_globe").when((F.col("kind") == "Polygon") & ~closed, "open_ring")
    )
    return f.select("feature", "kind", F.size("positions").alias("vertices"), fault.alias("fault"))


def prepared_pack(spark: SparkSession, path: str) -> DataFrame:
    """Rows of prepared packs; times stay text until they are admitted."""
    schema = f"domain string, synthetic boolean, provenance map<string,string>, rows array<struct<{PACK_ROW.replace(' ', ': ').replace(',:', ',')}>>"
    return spark.read.schema(schema).json(path, multiLine=True).select("domain", F.explode("rows").alias("r")).select("domain", "r.*")


SPLITS = ("train", "development", "confirmation")  # Fixed values, in order


def admit(rows: DataFrame) -> DataFrame:
    """Every row with ``faults``: the point-in-time rules it breaks, in order.

    Times need an offset; observed <= available <= cutoff < resolved, rules <=
    cutoff < event; a group has one split and one cutoff; ids do not repeat; labels of
    one split are resolved before the first cutoff of the next.
    """
    times = ("event_time", "rules_available_at", "observed_at", "available_at", "cutoff", "resolved_at")
    at = {c: F.when(F.col(c).rlike(OFFSET), F.col(c).try_cast("timestamp")) for c in times}
    group = rows.groupBy("event_group").agg(F.countDistinct("split").alias("_splits"), F.countDistinct("cutoff").alias("_cutoffs"))
    seen = rows.groupBy("id").agg(F.count("*").alias("_same"))
    splits = rows.groupBy("split").agg(F.countDistinct("event_group").alias("_groups"))
    place = F.create_map(*[F.lit(x) for i, split in enumerate(SPLITS) for x in (split, i)])
    ends = rows.select("split", at["resolved_at"].alias("r"), at["cutoff"].alias("c")).groupBy("split").agg(F.max("r").alias("_last"), F.min("c").alias("_first")).where(F.col("split").isin(*SPLITS))
    before = ends.where(F.col("split") != SPLITS[-1]).select(F.array(*map(F.lit, SPLITS))[place[F.col("split")] + 1].alias("split"), "_last")
    chronology = before.join(ends.select("split", "_first"), "split").select("split", (F.col("_last") < F.col("_first")).alias("_follows"))
    splits = splits.join(chronology, "split", "left")
    out = rows.join(group, "event_group", "left").join(seen, "id", "left").join(splits, "split", "left")
    ok = lambda c: F.coalesce(c, F.lit(False))
    rules = [
        ("repeated_id", ok(F.col("_same") == 1)), ("split", F.col("split").isin(*SPLITS)), ("unit", F.col("unit").isin("F", "C", "count", "USD", "percent")),
        ("predicate", F.col("predicate") == "greater_than"), ("price", F.col("price").between(0, 1)), ("label", F.col("label").isin(0, 1)), ("span", F.contains("contract", "source_span")),
        ("time_text", F.array_size(F.array_compact(F.array(*at.values()))) == len(times)), ("observed_late", at["observed_at"] <= at["available_at"]), ("available_late", at["available_at"] <= at["cutoff"]),
        ("resolved_early", at["cutoff"] < at["resolved_at"]), ("rules_late", at["rules_available_at"] <= at["cutoff"]), ("event_early", at["cutoff"] < at["event_time"]),
        ("mixed_group", (F.col("_splits") == 1) & (F.col("_cutoffs") == 1)), ("few_groups", F.col("_groups") >= 2), ("splits_overlap", F.coalesce("_follows", F.lit(True))),
    ]
    return out.withColumn("faults", F.array_compact(F.array(*[F.when(~ok(c), F.lit(n)) for n, c in rules]))).drop("_splits", "_cutoffs", "_same", "_groups", "_follows")


def prediction_rows(rows: DataFrame) -> DataFrame:
    """The columns a prediction may see."""
    return rows.drop(*PROTECTED)


def current(records: DataFrame, kind: str, parent: str) -> DataFrame:
    """Records of a kind under a parent that are not stale, oldest first."""
    return records.where((F.col("kind") == kind) & (F.col("parent") == parent) & ~F.col("stale")).orderBy("created", "id")


def csv_context(texts: DataFrame, key: str, text: str, shown: int = 5) -> DataFrame:
    """Uploaded CSV texts: columns, number of rows and the first ``shown`` rows; a ragged row is a fault.

    Plain fields only: quoted commas are read by ``strict_csv``.
    """
    lines = F.filter(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), lambda x: x != "")
    cells = F.transform(lines, lambda x: F.split(x, ","))
    width = F.size(cells[0])
    rows = F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(1)))
    fault = F.when(F.size(lines) < 2, "no_rows").when(F.exists(cells, lambda r: F.size(r) != width), "ragged").when(F.size(F.array_distinct(cells[0])) != width, "repeated_column")
    return texts.select(key, cells[0].alias("columns"), (F.size(lines) - 1).alias("n_rows"), F.slice(rows, 1, shown).alias("sample"), fault.alias("fault"))


CATALOG = "domains array<struct<id: string, title: string, use_cases: array<struct<id: string, title: string>>>>"


def catalog(json_rows: DataFrame, text: str) -> DataFrame:
    """Domains and their use cases, one row for each, from catalog documents."""
    d = json_rows.select(F.explode(F.from_json(text, CATALOG)["domains"]).alias("d"))
    return d.select(F.col("d.id").alias("domain"), F.col("d.title").alias("title"), F.explode_outer("d.use_cases").alias("u")).select("domain", "title", F.col("u.id").alias("use_case"), F.col("u.title").alias("use_case_title"))
