"""Entity graph as vertex and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinetrace.functions.times import mmss_to_seconds
from cinetrace.operators.ordering import first_per_key, position

# Colours of entity types and of behaviours, and the defaults.
ENTITY_COLOURS = {
    "person": "#4A90D9",
    "dog": "#E8943A",
    "cat": "#9B59B6",
    "vehicle": "#2ECC71",
    "object": "#95A5A6",
}
ENTITY_DEFAULT = "#BDC3C7"
BEHAVIOR_COLOURS = {
    "approach": "#4A90D9",
    "depart": "#95A5A6",
    "interact": "#2ECC71",
    "follow": "#9B59B6",
    "idle": "#BDC3C7",
    "group": "#E74C3C",
    "avoid": "#34495E",
    "chase": "#F1C40F",
    "observe": "#7F8C8D",
}
BEHAVIOR_DEFAULT = "#7F8C8D"


def colour(kind: Column, table: dict[str, str], default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.coalesce(F.try_element_at(pairs, kind), F.lit(default))


def palette_colour(position: Column, palette: list[str]) -> Column:
    """Colours repeat once the palette is used up."""
    return F.element_at(F.array(*[F.lit(c) for c in palette]), (F.pmod(position, F.lit(len(palette))) + 1).cast("int"))


def edges(events: DataFrame) -> DataFrame:
    """One edge per event with two or more entities, between the first two."""
    seconds = lambda c: F.when(
        F.col(c).contains(":"), mmss_to_seconds(F.col(c))
    ).otherwise(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)))
    return events.filter(F.size("entities") >= 2).select(
        "run_id",
        F.concat(F.lit("ve_"), F.col("ev_idx").cast("string")).alias("key"),
        "ev_idx",
        F.get("entities", F.lit(0)).alias("source"),
        F.get("entities", F.lit(1)).alias("target"),
        F.col("type").alias("behavior"),
        seconds("start_time").alias("start"),
        seconds("end_time").alias("end"),
        "description",
        "confidence",
        colour(F.col("type"), BEHAVIOR_COLOURS, BEHAVIOR_DEFAULT).alias("colour"),
    )


def vertices(entities: DataFrame, links: DataFrame) -> DataFrame:
    """Entities, and bare vertices for edge ends that are not among them."""
    known = entities.select(
        "run_id", "id", "type", "description",
        colour(F.lower("type"), ENTITY_COLOURS, ENTITY_DEFAULT).alias("colour"),
    )
    ends = endpoints(links).select("run_id", "id").distinct()
    bare = ends.join(known, ["run_id", "id"], "left_anti")
    return known.unionByName(bare, allowMissingColumns=True)


def endpoints(links: DataFrame) -> DataFrame:
    return links.select("run_id", F.explode(F.array("source", "target")).alias("id"))


def document_parts(points: DataFrame, links: DataFrame) -> DataFrame:
    """Node-link document as JSON lines: a section name and one element per row.

    A run's graph has no size limit, so it is written as lines and not as one value.
    """
    nodes = points.select("run_id", F.lit("nodes").alias("section"), F.col("id").alias("name"), F.to_json(F.struct("id", "type", "colour")).alias("element"))
    arcs = links.select("run_id", F.lit("links").alias("section"), F.col("key").alias("name"), F.to_json(F.struct("key", "source", "target", "behavior")).alias("element"))
    return nodes.union(arcs)


def between(links: DataFrame, a: str, b: str) -> DataFrame:
    """Edges that join two entities, in either direction."""
    return links.filter(
        ((F.col("source") == a) & (F.col("target") == b)) | ((F.col("source") == b) & (F.col("target") == a))
    )


def active_edges(links: DataFrame, at: float) -> DataFrame:
    """Edges whose time span contains an instant, ends included."""
    return links.filter((F.col("start") <= at) & (F.col("end") >= at))


def merged_timeline(visual: DataFrame, audio: DataFrame) -> DataFrame:
    """Visual and audio events in one order of start time."""
    v = visual.select("run_id", F.lit("visual").alias("source"), "ev_idx", "type", mmss_to_seconds(F.col("start_time")).alias("start"))
    a = audio.select("run_id", F.lit("audio").alias("source"), "ev_idx", "type", mmss_to_seconds(F.col("start_time")).alias("start"))
    rows = v.union(a)
    order = [F.col("start"), F.col("source").desc(), F.col("ev_idx")]
    return position(rows, ["run_id"], order, [F.floor(F.col("start") / 10)])


def stats(entities: DataFrame, links: DataFrame) -> DataFrame:
    """Entity and edge counts, best connected vertex, most frequent behaviour."""
    runs = entities.select("run_id").union(links.select("run_id")).distinct()
    counts = entities.groupBy("run_id").agg(F.count(F.lit(1)).alias("entities"))
    arcs = links.groupBy("run_id").agg(F.count(F.lit(1)).alias("edges"))
    degree = endpoints(links).groupBy("run_id", "id").agg(F.count(F.lit(1)).alias("degree"))
    hub = first_per_key(degree, ["run_id"], [F.col("degree").desc(), F.col("id")])
    per_type = links.groupBy("run_id", "behavior").agg(F.count(F.lit(1)).alias("n"))
    top = first_per_key(per_type, ["run_id"], [F.col("n").desc(), F.col("behavior")])
    return (
        runs.join(counts, "run_id", "left")
        .join(arcs, "run_id", "left")
        .join(hub, "run_id", "left")
        .join(top.drop("n"), "run_id", "left")
        .select(
            "run_id",
            F.coalesce("entities", F.lit(0)).alias("entities"),
            F.coalesce("edges", F.lit(0)).alias("edges"),
            F.col("id").alias("most_connected"),
            "degree",
            F.col("behavior").alias("dominant_behavior"),
        )
    )
