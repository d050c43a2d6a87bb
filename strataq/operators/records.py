"""Records, views, diffs and exports: closed projections over tables of things."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIDDEN_KINDS = ("dataset", "model_call", "model_response")  # Fixed values


def visible(records: DataFrame, kind: str = "kind", hidden: Sequence[str] = HIDDEN_KINDS) -> DataFrame:
    """Records of kinds that may be shown; a null kind is shown."""
    return records.where(F.col(kind).isNull() | ~F.col(kind).isin(*hidden))


def view(df: DataFrame, observable: Sequence[str]) -> DataFrame:
    """The observable columns only; an unknown name is an error."""
    if missing := set(observable) - set(df.columns):
        raise ValueError(f"no such columns: {sorted(missing)}")
    return df.select(*observable)


def without(df: DataFrame, protected: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in protected])


def scene_frames(df: DataFrame, frame: str, agent: str, columns: Sequence[str], most_agents: int | None = None) -> DataFrame:
    """Agents of every frame in order, with their place and number; one row for each agent and frame.

    Two rows of one agent in one frame are an error, and so are more than ``most_agents``.
    """
    w = Window.partitionBy(frame).orderBy(agent)
    n = F.count("*").over(Window.partitionBy(frame))
    place = F.when(F.lag(agent).over(w) == F.col(agent), F.raise_error(F.lit("an agent stands twice in one frame")).cast("int")).otherwise(F.row_number().over(w))
    if most_agents is not None:
        n = F.when(n <= most_agents, n).otherwise(F.raise_error(F.lit("too many agents in one frame")).cast("long"))
    return df.select(frame, agent, *columns, place.alias("place"), n.alias("agents"))


SCENE = "frames array<struct<time: double, agents: array<struct<id: string, x: double, y: double>>>>"


def load_scene(scenes: DataFrame, key: str, text: str) -> DataFrame:
    """Nested JSON scenes to rows (key, time, id, x, y)."""
    frames = scenes.select(key, F.explode(F.from_json(text, SCENE)["frames"]).alias("f"))
    return frames.select(key, F.col("f.time").alias("time"), F.explode("f.agents").alias("a")).select(key, "time", "a.*")


def delta(before: DataFrame, after: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Key, change (added, removed, changed, unchanged) between two snapshots with unique keys."""
    b, a = before.select(*key, F.col(value).alias("_b"), F.lit(True).alias("_in_b")), after.select(*key, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    change = F.when(F.col("_in_b").isNull(), "added").when(F.col("_in_a").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("changed")
    return b.join(a, list(key), "full").select(*key, change.alias("change"), "_b", "_a").withColumnsRenamed({"_b": "before", "_a": "after"})


def field_diff(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row for each key and field whose value differs; keys on both sides."""
    pairs = before.select(key, *[F.col(f).cast("string").alias(f"b_{f}") for f in fields]).join(after.select(key, *[F.col(f).cast("string").alias(f"a_{f}") for f in fields]), key)
    rows = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"b_{f}").alias("before"), F.col(f"a_{f}").alias("after")) for f in fields]), lambda r: ~r["before"].eqNullSafe(r["after"]))
    return pairs.select(key, F.explode(rows).alias("r")).select(key, "r.*")


def check_model_map(bindings: DataFrame, components: DataFrame, states: DataFrame, columns: DataFrame) -> DataFrame:
    """(finding, item) of a map (component, state, unit, column) against what is declared.

    ``components`` (component), ``states`` (state, unit) and ``columns`` (column) are sets.
    """
    b = bindings.select("component", "state", "unit", "column")
    found = lambda df, name, item: df.select(F.lit(name).alias("finding"), F.col(item).cast("string").alias("item"))
    known = b.join(states.withColumnRenamed("unit", "declared"), "state")
    parts = [
        found(components.join(b, "component", "left_anti"), "component_without_binding", "component"),
        found(b.join(components, "component", "left_anti").select("component").distinct(), "unknown_component", "component"),
        found(b.join(states, "state", "left_anti").select("state").distinct(), "unknown_state", "state"),
        found(known.where("unit <> declared").select("component").distinct(), "unit_differs", "component"),
        found(b.join(columns, "column", "left_anti").select("column").distinct(), "missing_column", "column"),
        found(b.groupBy("component").count().where("count > 1"), "bound_twice", "component"),
    ]
    return reduce(DataFrame.unionByName, parts)


def contained_successors(runs: DataFrame, key: str, parent: str, manifest: str) -> DataFrame:
    """Runs whose manifest holds everything in that of the run they follow."""
    old = runs.select(F.col(key).alias(parent), F.col(manifest).alias("_old"))
    return runs.join(old, parent).where(F.size(F.array_except("_old", manifest)) == 0).select(key, parent)


def blobs(df: DataFrame, content: str) -> DataFrame:
    """Contents by digest, once each: what a content-addressed store writes."""
    c = F.col(content).cast("binary")
    return df.where(c.isNotNull()).groupBy(F.sha2(c, 256).alias("sha256")).agg(F.count("*").alias("copies"), F.first(F.octet_length(c)).cast("long").alias("n_bytes"), F.first(c).alias("content"))


def to_turtle(triples: DataFrame, base: str) -> DataFrame:
    """(subject, predicate, object, is_literal) as lines of Turtle."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace("object", r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    name = lambda c: F.concat(F.lit(f"<{base}"), F.col(c), F.lit(">"))
    return triples.select(F.concat_ws(" ", name("subject"), name("predicate"), F.when(F.col("is_literal"), quoted).otherwise(name("object")), F.lit(".")).alias("line"))


def from_turtle(lines: DataFrame, base: str, line: str = "line") -> DataFrame:
    """The triples of such lines."""
    part = lambda i: F.regexp_extract(line, rf'^<{base}([^>]*)> <{base}([^>]*)> (?:<{base}([^>]*)>|"(.*)") \.$', i)
    literal = F.rlike(line, F.lit(r'" \.$'))
    plain = F.regexp_replace(F.regexp_replace(part(4), r'\\"', '"'), r"\\\\", r"\\")
    return lines.select(part(1).alias("subject"), part(2).alias("predicate"), F.when(literal, plain).otherwise(part(3)).alias("object"), literal.alias("is_literal"))


def project_spec(components: DataFrame, couplings: DataFrame) -> DataFrame:
    """Distinct triples of a specification.

    Components (id, kind, label, scale) give four, couplings (id, source, target, sign) four
    and an ``influences`` edge.
    """
    row = lambda s, p, o: F.struct(s.cast("string").alias("subject"), F.lit(p).alias("predicate"), o.cast("string").alias("object"))
    c = F.array(row(F.col("id"), "type", F.lit("component")), *[row(F.col("id"), p, F.col(p)) for p in ("kind", "label", "scale")])
    k = F.array(row(F.col("id"), "type", F.lit("coupling")), *[row(F.col("id"), p, F.col(p)) for p in ("source", "target", "sign")], row(F.col("source"), "influences", F.col("target")))
    out = components.select(F.explode(c).alias("t")).unionByName(couplings.select(F.explode(k).alias("t")))
    return out.select("t.*").where("object IS NOT NULL").distinct()


# Rules for values: each gives a column that is true where the value is in order.


def number(c: Column, low: float | None = None, high: float | None = None) -> Column:
    ok = c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    ok = ok if low is None else ok & (c >= low)
    return ok if high is None else ok & (c <= high)


def nonempty(c: Column, most: int | None = None) -> Column:
    ok = c.isNotNull() & (F.trim(c) != "")
    return ok if most is None else ok & (F.length(c) <= most)


def string_list(c: Column, most: int) -> Column:
    return c.isNotNull() & (F.size(c) <= most) & F.forall(c, lambda x: x.isNotNull() & (F.trim(x) != ""))


def closed(json: Column, keys: Sequence[str]) -> Column:
    """The object has these keys and no other."""
    got = F.json_object_keys(json)
    return got.isNotNull() & (F.size(F.array_except(got, F.array(*map(F.lit, keys)))) == 0) & (F.size(got) == len(keys))


def faults(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule, in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"f{i}") for i, ok in enumerate(rules.values())])
    rows = [F.struct(F.lit(name).alias("rule"), F.col("n").alias("n_rows"), F.col(f"f{i}").alias("n_faults")) for i, name in enumerate(rules)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


EXCEPTION = r"([A-Z][A-Za-z]*(?:Error|Exception))"
OFFSET = r"(Z|[+-]\d\d:?\d\d)$"


def failure_class(text: Column) -> Column:
    """The first exception named in a text, or what else says that something failed."""
    name = F.regexp_extract(text, EXCEPTION, 1)
    return F.when(name != "", name).when(F.rlike(text, F.lit(r"(?i)timed out|timeout")), "timeout").when(F.rlike(text, F.lit(r"(?i)\bfail(ed|ure)?\b")), "failed").otherwise("none")


def utc_offset(text: Column) -> Column:
    """Seconds ahead of UTC of an ISO timestamp; null if it names no offset."""
    z = F.regexp_extract(text, OFFSET, 1)
    sign = F.when(F.startswith(z, F.lit("-")), -1).otherwise(1)
    digits = F.regexp_replace(z, "[^0-9]", "")
    return F.when(z == "Z", 0).when(z != "", sign * (F.substring(digits, 1, 2).cast("int") * 3600 + F.substring(digits, 3, 2).cast("int") * 60))


def time_axis(df: DataFrame, row: str, candidates: Sequence[str]) -> DataFrame:
    """Each candidate with the rows where it does not rise; the first that always rises is the axis.

    ``row`` is the number of the row; if nothing rises, no candidate is marked and it is the axis.
    """
    from .ordered import lagged

    seen = lagged(df.select(row, *[F.col(c).cast("double").alias(c) for c in candidates]), [], row, [], {f"p_{c}": c for c in candidates}, bucket=65536)
    one = seen.agg(*[F.count_if(F.col(c).isNull() | (F.col(c) <= F.col(f"p_{c}"))).alias(c) for c in candidates])
    rows = [F.struct(F.lit(i).alias("place"), F.lit(c).alias("candidate"), F.col(c).alias("n_not_rising")) for i, c in enumerate(candidates)]
    first = F.array_min(F.filter(F.array(*[F.when(F.col(c) == 0, F.lit(i)) for i, c in enumerate(candidates)]), lambda x: x.isNotNull()))
    return one.select(F.explode(F.array(*rows)).alias("r"), first.alias("first")).select("r.*", F.coalesce(F.col("r.place") == F.col("first"), F.lit(False)).alias("is_axis"))


def state_columns(numeric: DataFrame, axis: str, most: int = 12) -> DataFrame:
    """(column_name, place, is_numeric) to the first ``most`` numeric columns that are not the axis."""
    w = Window.orderBy("place")
    rows = numeric.where(F.col("is_numeric") & (F.col("column_name") != axis)).groupBy("column_name").agg(F.min("place").alias("place"))
    return rows.withColumn("state", F.row_number().over(w)).where(F.col("state") <= most)  # one row per column
